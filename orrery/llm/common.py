"""Shared helpers: working tables in the shared folder, folded literals, byte-level word hashing in numpy."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..staging import discard, shared_dir  # noqa: F401

WS = "[\\x20\\x09-\\x0D]+"
NON_WS = "[^\\x20\\x09-\\x0D]+"
#: numpy works on texts in pieces of about this many bytes, so a task's memory doesn't follow the batch. Hashing takes about 100 times a piece.
CHUNK_BYTES = 1 << 18


#: Rows of an Arrow batch, so that a batch of long texts stays a few MB in the JVM and in Python.
TEXT_BATCH_ROWS = 1000


#: Bytes of an Arrow batch, for rows that are larger than usual.
TEXT_BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to TEXT_BATCH_ROWS and TEXT_BATCH_BYTES, unless they are smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)):
        held = int(re.match("-?[0-9]*", spark.conf.get(key))[0] or 0)
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """A working table as of staging.stage; then the driver's garbage is collected, as only that lets Spark drop the shuffle files of ended plans."""
    out = staging.stage(df, name)
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return out


#: glibc's malloc_trim; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with Arrow's unused memory handed back after each, and the C library's at the end.

    Python workers live on from stage to stage, and either would keep the peak of every task that they ever ran.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()
    pool.release_unused()
    if _TRIM:
        _TRIM(0)


def dense(rows: DataFrame, size: int, at: str, value: str, default: int = 0) -> Column:
    """An array<bigint> of a fixed size as a scalar subquery: value at each position of rows, default elsewhere.

    Plans hold the subquery, not its values. rows has a bigint position below size, at most once each, and a bigint value.
    """
    every = rows.sparkSession.range(0, size, 1, 1).select(F.col("id").alias("_at"), F.lit(None).cast("bigint").alias("_value"))
    both = rows.select(F.col(at).alias("_at"), F.col(value).alias("_value")).unionByName(every).groupBy("_at").agg(F.max("_value").alias("_value"))
    whole = both.agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_value", F.lit(default)).alias("_value")))).alias("_all"))
    return whole.select(F.col("_all")["_value"]).scalar()


def sentinel(df: DataFrame, column: str, dtype: str) -> Column:
    """The column when df has it, else a typed null: tables may lack optional columns."""
    return F.col(column).cast(dtype) if column in df.columns else F.lit(None).cast(dtype)


# --- words of UTF-8 texts, a whole batch at a time -------------------------------------------------

_WS_BYTES = np.zeros(256, bool)
_WS_BYTES[[32, 9, 10, 11, 12, 13]] = True
#: 0 white space and controls, 1 letters, digits and bytes of other scripts, 2 punctuation.
_KINDS = np.array([0 if b <= 32 or b == 127 else 1 if b > 127 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_STEP, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all rows, in order, and n+1 word offsets by row.

    Every 8 bytes of a word are mixed with their place, and the sum of these is mixed with the word's length: no polynomial, for which
    words of equal hash can be made whatever its base. With punctuation, runs of ASCII punctuation are words of their own.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    if lower:
        data = _LOWER[data]
    solid = ~_WS_BYTES[data]
    first = np.empty(len(data), bool)
    first[0] = True
    if punctuation:
        kind = _KINDS[data]
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
    else:
        np.logical_not(solid[:-1], out=first[1:])
    inner = offsets[1:-1]
    first[inner[inner < len(data)]] = True
    first &= solid
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(solid)
    word = np.cumsum(first)[at] - 1
    pos = at - starts[word]
    place = pos & 7
    value = data[at].astype(np.uint64) << (place << 3).astype(np.uint64)
    block = np.flatnonzero(place == 0)  # the first byte of each 8
    eight = np.add.reduceat(value, block)
    mixed = mix64(eight ^ mix64((pos[block] >> 3).astype(np.uint64) * _STEP + _KEY))
    begin = np.flatnonzero(pos[block] == 0)
    length = np.diff(np.append(np.searchsorted(at, starts), len(at))).astype(np.uint64)
    hashes = np.add.reduceat(mixed, begin) ^ length * _STEP
    return mix64(hashes), np.searchsorted(starts, offsets)


_SHINGLE_CODE = mix64(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and row offsets. A row of 1 to k-1 words has one, of all its words."""
    count = np.diff(offsets)
    many = np.maximum(count - k + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(many)])
    total = int(out_offsets[-1])
    if not total:
        return np.zeros(0, np.uint64), out_offsets
    row = np.repeat(np.arange(len(count)), many)
    start = np.arange(total) - out_offsets[row] + offsets[row]
    size = np.minimum(count[row], k)
    acc = size.astype(np.uint64) * _M2
    for j in range(k):
        use = j < size
        acc[use] += words[start[use] + j] * _SHINGLE_CODE[j]
    return mix64(acc), out_offsets


# --- a bitmap of fixed size, to leave out before a shuffle rows that can't join --------------------

#: 1 MB, whatever the data; where it fills up, more rows pass and the join after it decides alone.
BITMAP_BITS = 1 << 23


def bitmap(keys: DataFrame, key: str) -> Column:
    """A bitmap of the 64-bit keys modulo BITMAP_BITS, as a scalar subquery."""
    at = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    words = (
        keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    return dense(words, BITMAP_BITS // 64, "word", "bits")


def in_bitmap(key: Column, bits: Column) -> Column:
    """False only where the key is surely not among the bitmap's keys; false for null."""
    at = F.pmod(key, F.lit(BITMAP_BITS))
    word = F.get(bits, F.shiftright(at, 6).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
