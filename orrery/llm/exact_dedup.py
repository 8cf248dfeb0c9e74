"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a set of distinct digests with the smallest document id and the number of rows of each. It never changes,
so each of its hash shards gets one static binary-fuse filter (Graf and Lemire, 2022). An incoming batch is first grouped
by itself; only its distinct digests meet the filters, and only those that a filter lets through meet the snapshot's
exact buckets. All rows of a group are compared byte for byte with the row that stays.

Edge cases: null text is empty text; texts are equal when identical after each run of white space becomes one space. A
null id never stays unless all ids of its group are null. Repeated rows with one id each give a row, and all of them are kept where
that id is the one that stays. Empty tables give
empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, bitmap, in_bitmap, mix64, stage

#: Digests in a filter shard, on average; one Python call holds a shard of the filter and of the batch.
SHARD_KEYS = 4096
MIN_SHARDS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WS, " ")


# --- binary fuse filter, 8-bit fingerprints -------------------------------------------------------


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in neighbouring segments, and the fingerprint, of each key."""
    h = mix64(keys + np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    low = np.uint64(segment - 1)
    slots = np.stack([base, (base + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low), (base + np.uint64(2 * segment)) ^ (h & low)])
    return slots.astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """Header (seed, segment length, segments as little-endian 64-bit) and fingerprints, for distinct 64-bit keys."""
    n = len(keys)
    segment = 4 if n < 2 else 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    factor = 2.0 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, int(np.ceil(n * factor / segment)) - 2)
    for seed in range(1, 1000):
        slots, prints = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        ids = np.arange(n)
        for s in slots:
            np.bitwise_xor.at(owner, s, ids)
        layers, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            key, pick = np.unique(owner[alone], return_index=True)
            layers.append((key, alone[pick]))
            for s in slots[:, key]:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(owner, s, key)
            left -= len(key)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(layers):
            table[slot] = prints[key] ^ table[slots[0, key]] ^ table[slots[1, key]] ^ table[slots[2, key]] ^ table[slot]
        return np.array([seed, segment, segments], "<u8").tobytes() + table.tobytes()
    raise RuntimeError("no seed peels; are the keys distinct?")


def may_contain(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = np.frombuffer(data, "<u8", 3)
    table = np.frombuffer(data, np.uint8, offset=24)
    slots, prints = _slots(keys, int(seed), int(segment), int(segments))
    return (table[slots[0]] ^ table[slots[1]] ^ table[slots[2]]) == prints


# --- the operator ---------------------------------------------------------------------------------


def group_digests(digests: DataFrame) -> DataFrame:
    """(sha, keep_id, n) of (doc_id, sha); combined before the shuffle, so a hot text is one row per task."""
    return digests.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))


def snapshot_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): one binary-fuse filter for each shard of the snapshot's digests."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(table.column("h").to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([build_filter(keys)], pa.binary())})

    keyed = snapshot.select(F.xxhash64("sha").alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)))
    return keyed.groupBy("shard").applyInArrow(build, "shard bigint, filter binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's groups with ``maybe``: false where the snapshot surely lacks the digest."""

    def look(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        h = rows.column("h").to_numpy().view(np.uint64)
        maybe = may_contain(found.column("filter")[0].as_py(), h) if len(found) else np.zeros(len(h), bool)
        return rows.select(["sha", "keep_id", "n"]).append_column("maybe", pa.array(maybe))

    keyed = batch.withColumn("h", F.xxhash64("sha")).withColumn("shard", F.pmod("h", F.lit(shards)))
    schema = f"sha binary, keep_id {dict(batch.dtypes)['keep_id']}, n bigint, maybe boolean"
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look, schema)


def merge_batch(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: the next snapshot. Both are (sha, keep_id, n) with distinct sha."""
    # a shard holds keys of both, so the larger decides
    size = max(snapshot.count(), batch.count())
    shards = max(MIN_SHARDS, 1 << max(0, (size // SHARD_KEYS)).bit_length())
    screened = stage(screen(batch, snapshot_filters(snapshot, shards), shards), "screened")
    maybe = screened.where("maybe")
    hits = snapshot.join(maybe.select("sha", F.col("keep_id").alias("k"), F.col("n").alias("m")), "sha", "left")
    grown = hits.select("sha", F.least("keep_id", "k").alias("keep_id"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    fresh = screened.where("not maybe").unionByName(maybe.join(snapshot, "sha", "left_anti")).select("sha", "keep_id", "n")
    return grown.unionByName(fresh)


def dedup(documents: DataFrame, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of documents.

    The rows arrive as ``batches`` ranges of ids in ascending order, of about as many rows each, each screened against the snapshot of those before
    it, so the smallest id of a group is in the snapshot when later copies come in.
    """
    rows = documents.select("doc_id", normalised(F.col("text")).alias("body"))
    digests = stage(rows.select("doc_id", F.unhex(F.sha2("body", 256)).alias("sha")), "digests")
    cuts = digests.agg(F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / batches) for i in range(batches - 1)]), F.lit(1000))).first()[0] if batches > 1 else []
    slot = sum((F.when(F.col("doc_id") <= c, 0).otherwise(1) for c in cuts or []), F.lit(0))
    snapshot = None
    for i in range(batches):
        batch = stage(group_digests(digests.where(slot == i)), f"batch{i}")
        snapshot = batch if snapshot is None else stage(merge_batch(snapshot, batch), f"snapshot{i}")
    single = digests.join(snapshot.where("n = 1"), "sha").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "sha")

    repeated = snapshot.where("n > 1")
    bits = bitmap(repeated.select(F.xxhash64("sha").alias("h")), "h")
    # the text travels only where its digest repeats
    texts = rows.withColumn("sha", F.unhex(F.sha2("body", 256))).where(in_bitmap(F.xxhash64("sha"), bits))
    members = stage(texts.join(repeated, "sha"), "members")
    stays = members.where("doc_id <=> keep_id").groupBy("sha").agg(F.first("body").alias("stays"))
    same = members.join(stays, "sha").where(F.when(F.col("body") == F.col("stays"), True).otherwise(F.raise_error(F.lit("two texts have one SHA-256 digest"))))
    grouped = same.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
