"""Truncated path signatures in long form: one shuffle, one window per level.

A path is rows with keys, an order and channel columns. With P the signature of the path before a step and d the step, Chen's
identity gives the step's share of level k as the sum over j = 1..k of P[k-j] (x) d^j / j!. Level k of P is the running sum
of its shares, over the same partitions and order for each level, so the plan has one exchange whatever the depth.

Words are tuples of channel numbers; the column of word (0, 1) is ``s_12``. Wide signatures (hundreds of words) use
:func:`wide_signature`, the same sums in numpy by task, whose parts are folded by Chen's product.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import in_order, pieces

Word = tuple[int, ...]


def words(channels: int, level: int) -> list[Word]:
    return list(itertools.product(range(channels), repeat=level))


def name(word: Word) -> str:
    return "s_" + "".join(str(c + 1) for c in word)


def signature_dim(channels: int, depth: int) -> int:
    """Number of terms of levels 1 to depth."""
    if channels < 1 or depth < 1:
        raise ValueError("channels and depth must be 1 or more")
    return sum(channels**k for k in range(1, depth + 1))


def steps(path: DataFrame, keys: Sequence[str], order: Sequence[str], channels: Sequence[str], base: bool = False) -> DataFrame:
    """Adds d_0, d_1, ... : each channel's change from the point before. The first point's is 0, or with base its value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = lambda c: F.lit(0.0) if base else F.col(c)
    return path.withColumns({f"d_{i}": F.col(c) - F.coalesce(F.lag(c).over(w), first(c)) for i, c in enumerate(channels)})


def lead_lag_steps(path: DataFrame, order: Sequence[str], channels: int) -> tuple[DataFrame, list[str]]:
    """From steps of d channels, steps of the lead-lag path of 2 d: first the leads move, then the lags. Returns its order too."""
    zero = F.lit(0.0)
    move = lambda lead: F.struct(
        F.lit(0 if lead else 1).alias("half"),
        *[(F.col(f"d_{i}") if lead else zero).alias(f"e_{i}") for i in range(channels)],
        *[(zero if lead else F.col(f"d_{i}")).alias(f"e_{channels + i}") for i in range(channels)],
    )
    rows = path.withColumn("_m", F.explode(F.array(move(True), move(False)))).drop(*[f"d_{i}" for i in range(channels)])
    return rows.select("*", "_m.half", *[F.col(f"_m.e_{i}").alias(f"d_{i}") for i in range(2 * channels)]).drop("_m"), [*order, "half"]


def signature(stepped: DataFrame, keys: Sequence[str], order: Sequence[str], channels: int, depth: int) -> DataFrame:
    """One row per key with a column for each word of levels 1 to depth; a path of one point has zeros."""
    signature_dim(channels, depth)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = stepped

    def share(word: Word) -> Column:
        total = None
        for j in range(1, len(word) + 1):
            head, tail = word[: len(word) - j], word[len(word) - j :]
            term = F.lit(1.0 / math.factorial(j))
            for c in tail:
                term = term * F.col(f"d_{c}")
            if head:
                term = term * F.col("p" + name(head))
            total = term if total is None else total + term
        return total

    for level in range(1, depth + 1):
        df = df.withColumns({"i" + name(w): share(w) for w in words(channels, level)})
        if level < depth:
            df = df.withColumns({"p" + name(w): F.coalesce(F.sum("i" + name(w)).over(before), F.lit(0.0)) for w in words(channels, level)})
    every = [w for level in range(1, depth + 1) for w in words(channels, level)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *[F.sum("i" + name(w)).alias(name(w)) for w in every])


def chen(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Levels of the signature of path a followed by path b; level k has channels^k entries in row-major order."""
    out = []
    for k in range(len(a)):
        level = a[k] + b[k]
        for j in range(k):
            level = level + np.outer(a[j], b[k - j - 1]).ravel()
        out.append(level)
    return out


def path_levels(points: np.ndarray, depth: int) -> list[np.ndarray]:
    """Levels of the signature of an (n, d) array of points, by running sums over all steps at once."""
    points = np.asarray(points, float)
    if points.ndim != 2 or depth < 1:
        raise ValueError("points must be two-dimensional and depth 1 or more")
    channels = points.shape[1]
    if len(points) < 2:
        return [np.zeros(channels**k) for k in range(1, depth + 1)]
    d = np.diff(points, axis=0)
    power = [np.ones((len(d), 1))]
    for j in range(1, depth + 1):
        power.append((power[-1][:, :, None] * d[:, None, :] / j).reshape(len(d), -1))
    prefix, out = [np.ones((len(d), 1))], []
    for k in range(1, depth + 1):
        share = sum((prefix[k - j][:, :, None] * power[j][:, None, :]).reshape(len(d), -1) for j in range(1, k + 1))
        total = np.cumsum(share, axis=0)
        out.append(total[-1])
        prefix.append(np.vstack([np.zeros((1, total.shape[1])), total[:-1]]))
    return out


def lead_lag(points: np.ndarray) -> np.ndarray:
    n = len(points)
    i = np.arange(2 * n - 1)
    return np.hstack([points[(i + 1) // 2], points[i // 2]])


def wide_signature(path: DataFrame, keys: str | Sequence[str], order: Sequence[str], channels: Sequence[str], depth: int, doubled: bool = False, parts: int | None = None) -> DataFrame:
    """(keys, n_points, sig array<double>): all levels of each key's path, or of its lead-lag path, in one array.

    For signatures of hundreds of words, where a column per word would swamp the plan. A scan in two levels: rows are sorted over
    all tasks by key and order, a task folds its batches of a key's path by :func:`chen`, and the parts of a key, one for each task that
    it reaches into, are folded in order with the steps between them. So a key of any length is many tasks, and no task holds one.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    levels_of = lambda points: path_levels(lead_lag(points) if doubled else points, depth)
    split = np.cumsum([(len(channels) * (2 if doubled else 1)) ** k for k in range(1, depth + 1)])[:-1]
    kinds = ", ".join(f"`{k}` {dict(path.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        done: list[tuple] = []
        state: list = []

        def flush() -> pa.RecordBatch:
            columns = [pa.concat_arrays([d[0].column(k) for d in done]) for k in keys]
            rest = [pa.array([task] * len(done), pa.int64()), pa.array([d[1] for d in done], pa.int64()), *[pa.array([np.asarray(d[i], float) for d in done], pa.list_(pa.float64())) for i in (2, 3, 4)]]
            done.clear()
            return pa.RecordBatch.from_arrays([*columns, *rest], names=[*keys, "_task", "n_points", "_first", "_last", "sig"])

        for piece, fresh in pieces(batches, keys):
            points = np.column_stack([piece.column(c).to_numpy(zero_copy_only=False) for c in channels]).astype(float)
            if fresh:
                if state:
                    done.append((*state[:4], np.concatenate(state[4])))
                    if len(done) * len(done[-1][4]) >= 1 << 18:
                        yield flush()
                state = [piece.slice(0, 1), len(points), points[0], points[-1], levels_of(points)]
            else:
                state[4] = chen(state[4], levels_of(np.vstack([state[3], points])))
                state[1], state[3] = state[1] + len(points), points[-1]
        if state:
            done.append((*state[:4], np.concatenate(state[4])))
            yield flush()

    def fold(group: pa.Table) -> pa.Table:
        t = group.sort_by("_task")
        first, last, sig = (t.column(c).to_pylist() for c in ("_first", "_last", "sig"))
        whole = np.split(np.array(sig[0]), split)
        for i in range(1, len(t)):
            whole = chen(chen(whole, levels_of(np.array([last[i - 1], first[i]]))), np.split(np.array(sig[i]), split))
        n = sum(t.column("n_points").to_pylist())
        return pa.table({**{k: t.column(k)[:1] for k in keys}, "n_points": pa.array([n], pa.int64()), "sig": pa.array([np.concatenate(whole)], pa.list_(pa.float64()))})

    rows = in_order(path.select(*dict.fromkeys([*keys, *order, *channels])), keys, order, parts)
    partial = rows.mapInArrow(run, f"{kinds}, _task bigint, n_points bigint, _first array<double>, _last array<double>, sig array<double>")
    return partial.groupBy(*keys).applyInArrow(fold, f"{kinds}, n_points bigint, sig array<double>")


def relative_difference(a: Column, b: Column) -> Column:
    """Largest |a - b| of two arrays over the largest |a| or |b|; 0 where both are next to 0."""
    scale = F.greatest(F.array_max(F.transform(a, F.abs)), F.array_max(F.transform(b, F.abs)))
    gap = F.array_max(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.abs(z["x"] - z["y"])))
    return F.when(scale < 1e-14, 0.0).otherwise(gap / scale)
