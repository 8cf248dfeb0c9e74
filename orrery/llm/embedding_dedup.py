"""Embedding near-duplicates by int8 quantised tile products with error bounds for each vector.

Vectors are compared only within one label (and one length). A label's vectors are dealt by hash over tiles of bounded size;
each pair of tiles is one task. There, unit vectors u = s q + e are coded as int8 q with scale s. Products of codes are exact
(BLAS in float32 on integers below 2^24), and |u.v - s_u s_v q_u.q_v| <= |s_u q_u| |e_v| + |e_u| |v| holds for every pair, with the norms
computed for each vector. Only pairs whose product plus bound reaches the threshold are computed in double precision.

A task returns for each vector its number of links and one edge to its component within the task, never all pairs, so a
group of m near copies costs m rows, not m squared.

Edge cases: a null label, a null vector, a zero vector, and one with a null, NaN or infinite component link with nothing, as
does a null vec_id. Components may be as large or small as doubles are. A vec_id that repeats within a label counts as one vector, the smallest of its embeddings; each of
its rows gets the result. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .graph import components

THRESHOLD = 0.98
#: Vectors in a tile on average; a task holds two tiles.
TILE = 4096
#: Rows of one tile multiplied at a time.
ROWS = 256
#: int8 products of so many dimensions at most stay below 2^24, where float32 is exact.
EXACT_DIMS = 1024
#: Slack over the rounding of double arithmetic in the bounds.
SLACK = 1e-9


def tamed(x: np.ndarray) -> np.ndarray:
    """Rows over the power of two of their largest component: an exact change that keeps squares from overflowing or vanishing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, norms of the coded vectors, norms of the errors, norms of the inputs, by row of x."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / length[:, None]
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = code * scale[:, None]
    error = unit - coded
    return code, scale, np.sqrt(np.einsum("ij,ij->i", coded, coded)), np.sqrt(np.einsum("ij,ij->i", error, error)), length


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, as float64."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def tile_links(left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Yields (rows of left, rows of right) of linked pairs; without right, pairs i < j within left."""
    left, right = tamed(left), None if right is None else tamed(right)
    qa = quantise(left)
    x, y, qb = (left, left, qa) if right is None else (left, right, quantise(right))
    for i in range(0, len(x), ROWS):
        part = slice(i, i + ROWS)
        approx = code_products(qa[0][part], qb[0]) * qa[1][part, None] * qb[1][None, :]
        bound = qa[2][part, None] * qb[3][None, :] + qa[3][part, None] * (1 + SLACK) + SLACK
        a, b = np.nonzero(approx + bound >= threshold)
        a = a + i
        if right is None:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 100_000):
            p, q = a[k : k + 100_000], b[k : k + 100_000]
            cosine = np.einsum("ij,ij->i", x[p], y[q]) / (qa[4][p] * qb[4][q])
            hit = cosine >= threshold
            yield p[hit], q[hit]


class Forest:
    """Components of few nodes, fed with arrays of edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.arange(len(self.label))
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
            self.label = low[self.label]


def _tile_task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, tile = table.column("vec_id").to_numpy(), table.column("tile").to_numpy()
        flat = table.column("embedding").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.lexsort((*x.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
        ids, tile, x = ids[order], tile[order], x[order]
        ids, first = np.unique(ids, return_index=True)
        tile, x = tile[first], x[first]
        sides = np.unique(tile)
        own = bool(table.column("lo")[0].as_py() == table.column("hi")[0].as_py())
        count, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        if own or len(sides) == 2:
            at = [np.flatnonzero(tile == s) for s in sides]
            for p, q in tile_links(x[at[0]], None if own else x[at[1]], threshold):
                p, q = at[0][p], at[0 if own else 1][q]
                count += np.bincount(p, minlength=len(ids)) + np.bincount(q, minlength=len(ids))
                forest.add(p, q)
        hit = count > 0
        return pa.table({"vec_id": pa.array(ids[hit], pa.int64()), "n": pa.array(count[hit]), "root": pa.array(ids[forest.label[hit]], pa.int64())})

    return run


def link_embeddings(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    v = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists("embedding", lambda c: c != 0)
    good = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)).where(sound & some)
    good = good.withColumn("dims", F.size("embedding"))
    tiles = good.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).cast("bigint").alias("tiles"))
    dealt = good.join(tiles, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    paired = paired.select("label", "dims", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "vec_id", "embedding")
    found = stage(paired.groupBy("label", "dims", "lo", "hi").applyInArrow(_tile_task(threshold), "vec_id bigint, n bigint, root bigint"), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    parts = components(found, "vec_id", "root").withColumnRenamed("node", "vec_id")
    out = v.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
