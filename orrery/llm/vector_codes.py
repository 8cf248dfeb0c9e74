"""Product codes of vectors in exact integers, nearest codebook entries found by VA-file filtering.

A component x is the integer floor(scale * x). Vectors are cut into equal consecutive parts, each with a codebook. A codebook's
entries are an approximation file: each coordinate is quantised to a few bits, that is, to one of a few cells, and of a cell the
least and the greatest coordinate are known. For a part of a vector, lookup tables by coordinate and cell hold the least and the
greatest squared difference; their sums over an entry's cells bound its distance from below and above. Entries whose lower bound
exceeds the least upper bound can't be nearest. Only where several are left are integer distances computed.

Training is Lloyd's algorithm: a round is a map-only pass in which each task sums its vectors by entry, and a merge of a
row for each task and entry. Integers add up alike in any order, so reruns and lost executors change nothing. The driver holds
the codebooks alone, parts x entries x positions numbers.

Edge cases: a vector that is null, or holds null or non-finite components, is left out. Components of any finite size are exact: numbers
beyond 64 bits are computed as Python integers; an error too large for a long is null, and so is a label's error that is or holds
one. Repeated rows and ids count each; the smallest ids begin the codebooks, of equal ids the smallest vectors, null ids last.
With fewer vectors than entries a codebook is smaller. Ties go to the lower entry. Vectors of different lengths have
codebooks of their own (one pass more for each length), and where a length isn't divisible the first parts are longer. A null label is
a label. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Bits of a cell number: 4 cells for each coordinate.
BITS = 2
#: Vectors computed at a time.
ROWS = 4096
LARGEST = (1 << 63) - 1

#: By length of vectors: for each part an (entries, positions) array of integers, int64 or of Python integers.
Codebooks = dict[int, list[np.ndarray]]


def fixed_point(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, exactly; int64 where all fit into 40 bits, else Python integers. scale is a power of two."""
    if not x.size or np.abs(x).max() < (1 << 40) / scale:
        return np.floor(x * scale).astype(np.int64)
    # where scale times x isn't a double x is a whole number
    exact = lambda v: int(v) * scale if abs(v) > 2.0**53 else math.floor(v * scale)
    return np.array([exact(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def cuts(length: int, parts: int) -> list[int]:
    return [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]


class ApproximationFile:
    """The cells of a codebook's entries. entries: (n, positions) integers."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, positions = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        cells = 1 << bits
        #: Cell of each coordinate: even shares of the sorted entries, equal coordinates together.
        self.cell = np.zeros((n, positions), np.int64)
        self.low, self.high = np.empty((cells, positions), entries.dtype), np.empty((cells, positions), entries.dtype)
        for j in range(positions):
            ordered = entries[order[:, j], j]
            first = np.searchsorted(ordered, ordered, "left") if ordered.dtype != object else np.array([ordered.tolist().index(v) for v in ordered.tolist()])
            self.cell[order[:, j], j] = first * cells // n
            self.low[:, j] = self.high[:, j] = ordered[0]
            for c in range(cells):
                own = entries[self.cell[:, j] == c, j]
                if len(own):
                    self.low[c, j], self.high[c, j] = own.min(), own.max()

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of queries, of the same kind of integers; ties to the lower entry."""
        n = len(queries)
        least, most = self.bounds(queries)
        left = least <= most.min(1)[:, None]
        row, entry = np.nonzero(left)
        # rows come in order, and within a row entries do, so the first of the least distances is the lowest entry
        gap = queries[row] - self.entries[entry]
        distance = (gap * gap).sum(1)
        if not queries.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
        best = np.minimum.reduceat(distance, start) if len(row) else distance
        hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(start, len(row)))))
        _, first = np.unique(row[hit], return_index=True)
        return entry[hit[first]], best

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, (queries, entries), from tables of a query's coordinates and the cells."""
        shape = (len(queries), len(self.entries))
        least, most = np.zeros(shape, self.entries.dtype), np.zeros(shape, self.entries.dtype)
        for j in range(queries.shape[1]):
            below, above = self.low[:, j][None, :] - queries[:, j][:, None], queries[:, j][:, None] - self.high[:, j][None, :]
            outside, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            least += (outside * outside)[:, self.cell[:, j]]
            most += (far * far)[:, self.cell[:, j]]
        return least, most


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) of entries and of squared distances. x: (rows, length) integers."""
    ends = np.cumsum([0, *[b.shape[1] for b in books]])
    top = max([0, *[int(np.abs(a).max()) for a in (x, *books) if a.size]])
    if x.dtype == object or any(b.dtype == object for b in books) or 4 * top * top * max(1, x.shape[1]) >= 1 << 62:
        x, books = x.astype(object), [b.astype(object) for b in books]
    found = [ApproximationFile(b).nearest(x[:, i:j]) for b, i, j in zip(books, ends[:-1], ends[1:], strict=True)]
    return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def _chunks(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integers) of a batch's vectors, some rows of one length at a time."""
    column = batch.column("embedding")
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)])
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            yield length, part, fixed_point(flat[ends[part][:, None] + np.arange(length)], scale)


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows whose vector is finite throughout."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    return v.where(F.forall("embedding", lambda c: F.coalesce((c == c) & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """Codebooks of the first vectors by id, of each length."""
    sized = rows.select("vec_id", "embedding", F.size("embedding").alias("length"))
    books: Codebooks = {}
    for r in sized.select("length").distinct().collect():  # lengths, of which tables have one or a few
        own = sized.where(F.col("length") == r.length).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
        x = fixed_point(np.array([v.embedding for v in own], float).reshape(len(own), r.length), scale)
        at = cuts(r.length, parts)
        books[r.length] = [x[:, i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return books


def next_books(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: every part to its nearest entry, then each entry to the floor of its parts' mean; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: [[[0] * (1 + b.shape[1]) for _ in range(len(b))] for b in book] for n, book in books.items()}
        for batch in batches:
            for length, _, x in _chunks(batch, scale):
                entry, _ = assign(x, books[length])
                at = cuts(length, len(books[length]))
                for p, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    for e in np.unique(entry[:, p]).tolist():
                        own = x[entry[:, p] == e, i:j]
                        total[length][p][e] = [a + int(b) for a, b in zip(total[length][p][e], [len(own), *own.sum(0)], strict=True)]
        found = [(n, p, e, [str(v) for v in sums]) for n, book in total.items() for p, part in enumerate(book) for e, sums in enumerate(part) if sums[0]]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())))], names=["length", "part", "entry", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        sums = [str(sum(map(int, c))) for c in zip(*group.column("sums").to_pylist(), strict=True)]
        return pa.table({**{k: group.column(k)[:1] for k in ("length", "part", "entry")}, "sums": pa.array([sums], pa.list_(pa.string()))})

    kinds = "length int, part int, entry int, sums array<string>"
    merged = rows.select("embedding").mapInArrow(run, kinds).groupBy("length", "part", "entry").applyInArrow(merge, kinds)
    out = {n: [b.astype(object) for b in book] for n, book in books.items()}
    for r in merged.collect():  # a row for each entry in use
        count, *sums = map(int, r.sums)
        out[r.length][r.part][r.entry] = np.array([s // count for s in sums], object)
    return {n: [narrow(b) for b in book] for n, book in out.items()}


def narrow(b: np.ndarray) -> np.ndarray:
    """As int64 where all fit into 40 bits."""
    return b.astype(np.int64) if not b.size or max(abs(int(v)) for v in b.ravel()) < 1 << 40 else b.astype(object)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks by a number of rounds over all vectors (vec_id, label, embedding). vectors is read rounds + 2 times."""
    rows = sound(vectors)
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = next_books(rows, books, scale)
    return books


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all entries' numbers by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for part in book for v in part.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every sound vector: two hex digits for each part's entry.

    Vectors of a length without codebooks are left out.
    """
    marks = {n: digest(b) for n, b in books.items()}
    rows = sound(vectors).where(F.size("embedding").isin(*books) if books else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error, mark = [""] * len(batch), [None] * len(batch), [""] * len(batch)
            for length, at, x in _chunks(batch, scale):
                entry, distance = assign(x, books[length])
                for i, c, d in zip(at.tolist(), entry.astype(np.uint8), distance.sum(1).tolist(), strict=True):
                    code[i], error[i], mark[i] = c.tobytes().hex(), d if d <= LARGEST else None, marks[length]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(mark, pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint, codebooks_sha256 string")


def decode(codes: DataFrame, books: Codebooks, length: int, scale: int = SCALE) -> DataFrame:
    """codes with column decoded, array<double>: the entries' numbers over scale, for vectors of one length."""
    book = books[length]

    @F.pandas_udf("array<double>")
    def run(code):
        return code.map(lambda c: np.concatenate([b[k] for b, k in zip(book, bytes.fromhex(c), strict=True)]).astype(float) / scale)

    return codes.withColumn("decoded", run("code"))


def code_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every sound vector, by codebooks trained on all of them."""
    if entries > 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    codes = stage(encode(vectors, train(vectors, parts, entries, rounds, scale), scale), "codes")
    # a row for each label; the join on a hot label is one that adaptive execution splits
    whole = F.count("error") == F.count(F.lit(1))
    labels = codes.groupBy(F.col("label").alias("_label")).agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    joined = codes.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of code_vectors over embeddings, for vectors of one length that divides into parts."""
    gap = "list_sum(list_transform(list_zip(q.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"q AS MATERIALIZED (SELECT r, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS s FROM v, (SELECT unnest(range({parts})) AS p))",
        f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS c FROM v ORDER BY vec_id, e LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT p, c, s FROM q JOIN f USING (r))",
    ]
    for k in range(rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT q.r, q.p, any_value(q.s) AS s, arg_min(b.c, ({gap}, b.c)) AS c, min({gap}) AS d FROM q JOIN b{k} b ON q.p = b.p GROUP BY q.r, q.p)")
        if k < rounds:
            ctes.append(
                f"m{k} AS (SELECT p, c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS s FROM (SELECT p, c, i, sum(s[i]) AS t, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1025)) AS i) WHERE i <= len(s) GROUP BY p, c, i) GROUP BY p, c),"
                f" b{k + 1} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.s, b.s) AS s FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.c = m.c)"
            )
    ctes.append(f"o AS (SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(ctes) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r), h"
