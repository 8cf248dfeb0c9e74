"""Path signatures of unbounded streams: Chen's product makes a key's signature a running state.

The state of a key is its last point and its levels so far, so a batch of new points costs its own length only. Points must
arrive in order of time by key; those at or before the last point are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.signature import chen, path_levels, signature_dim

DEPTH = 2


def update(state: tuple | None, points: np.ndarray, depth: int = DEPTH) -> tuple[tuple, int]:
    """New state (last point, flat levels, points so far, late points) after an (n, 2) array of points ordered by time."""
    last, flat, seen, late = state if state is not None else (None, None, 0, 0)
    fresh = points if last is None else points[points[:, 0] > last[0]]
    late += len(points) - len(fresh)
    if len(fresh):
        path = fresh if last is None else np.vstack([last, fresh])
        step = path_levels(path, depth)
        if flat is not None:
            split = np.split(np.asarray(flat), np.cumsum([2**k for k in range(1, depth)]))
            step = chen(split, step)
        flat, last = np.concatenate(step), fresh[-1]
    return (tuple(map(float, last)), [float(v) for v in flat], seen + len(fresh), late) if last is not None else (None, None, seen, late), len(fresh)


def running_signatures(points: DataFrame, depth: int = DEPTH) -> DataFrame:
    """From a stream (oid long, t double, mag double): (oid, n_points, n_late, sig array<double>) after each batch that touched oid."""
    width = signature_dim(2, depth)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t")
        old = None
        if state.exists:
            t, m, sig, seen, late = state.get
            old = ((t, m), list(sig), seen, late)
        new, _ = update(old, rows[["t", "mag"]].to_numpy(float), depth)
        state.update((new[0][0], new[0][1], new[1], new[2], new[3]))
        yield pd.DataFrame({"oid": [key[0]], "n_points": [new[2]], "n_late": [new[3]], "sig": [new[1][:width]]})

    return points.groupBy("oid").applyInPandasWithState(
        step, "oid long, n_points long, n_late long, sig array<double>", "t double, m double, sig array<double>, seen long, late long", "update", "NoTimeout"
    )
