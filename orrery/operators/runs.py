"""Long ordered groups as many tasks: rows sorted over all tasks by key and order, so that a key of any length is split between them.

What a task can't know is what came before its first run of rows; that is joined on afterwards from one small row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df sorted by keys and order, over tasks of even ranges; parts is their number, else Spark's choice by size."""
    by = [*keys, *order]
    return (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of one key each, in order, and whether a slice begins its key's run in this task. Null is a key of its own."""
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for k in keys:
            code = batch.column(k).dictionary_encode("encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        held = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, len(batch) - 1)]
        change[0] = True
        starts = np.flatnonzero(change).tolist()
        for i, j in zip(starts, [*starts[1:], len(batch)], strict=True):
            yield batch.slice(i, j - i), i > 0 or held[0] != last
        last = held[1]


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compositions of y -> a y + b up to each place, by doubling: no quotients, so nothing overflows."""
    a, b = a.astype(float), b.astype(float)
    shift = 1
    while shift < len(a):
        b = np.concatenate([b[:shift], a[shift:] * b[:-shift] + b[shift:]])
        a = np.concatenate([a[:shift], a[shift:] * a[:-shift]])
        shift *= 2
    return a, b
