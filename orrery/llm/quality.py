"""Quality classifier by importance resampling (Xie et al., 2023): log ratio of two hashed n-gram models, Gumbel top-k.

The raw model counts the hashed unigrams and bigrams of all documents; the target model those of the documents labelled good,
from a bounded sample of labels. A document's weight is the sum of log target minus log raw over its n-grams. Its key is
that weight plus Gumbel noise from a hash of its id, and the k documents with the largest keys are kept. k is the number of
documents whose weight reaches a threshold set on labelled documents, so good documents aren't cut to meet a quota.

The k-th key is found exactly by counting 16 bits of the keys at a time: at most 65,536 counts reach the driver.

Edge cases: null text has no n-grams and weight 0. Null ids share one noise value. Equal keys at the cut all stay, so repeated
rows stand or fall together. Without labels of both kinds everything is kept. Empty tables give empty results. Columns
other than the id and text pass through unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, stage, text_buffers, thrifty, word_hashes

#: Labelled rows used at most, the smallest by a hash of their id. The model's size and the driver's memory follow from this.
MAX_LABELS = 20_000
BUCKETS_LOG2 = 16
SMOOTHING = 1.0
SEED = 11
#: One in so many labelled documents sets the threshold; the rest make the target model.
HELD_OUT = 4


def n_gram_buckets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, the row (from the first) and the bucket of every unigram and bigram."""
    data, offsets = text_buffers(texts)
    shift = np.uint64(64 - BUCKETS_LOG2)
    for i, j in chunks(offsets):
        words, ends = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], punctuation=True)
        row = np.repeat(np.arange(j - i), np.diff(ends))
        same = row[1:] == row[:-1]
        pairs = mix64(words[:-1] * np.uint64(3) + words[1:])[same]
        yield i, np.concatenate([row, row[1:][same]]), (np.concatenate([words, pairs]) >> shift).astype(np.int64)


def label_sample(labels: DataFrame, limit: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and their quality, limit at most; of several labels of one id the lowest counts."""
    rows = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    found.sort(key=lambda r: r.doc_id)
    return np.array([r.doc_id for r in found], np.int64), np.array([r.quality for r in found], np.int64)


def _labels_of(ids: pa.Array, known: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Quality of each id, -1 without a label."""
    out = np.full(len(ids), -1, np.int64)
    if len(known):
        x = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = (known[at] == x) & ids.is_valid().to_numpy(zero_copy_only=False)
        out[hit] = quality[at[hit]]
    return out


def _held_out(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.uint64) + np.uint64(SEED)) % np.uint64(HELD_OUT) == 0


@dataclass
class Model:
    weight: np.ndarray  # log target minus log raw, by bucket
    threshold: float | None = None
    cut: int | None = None

    def weights(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, row, bucket in n_gram_buckets(texts):
            part = np.bincount(row, self.weight[bucket])
            out[first : first + len(part)] += part
        return out

    def keys(self, ids: pa.Array, weights: np.ndarray) -> np.ndarray:
        """Weight plus Gumbel noise, as 64-bit integers in the same order."""
        x = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64)
        u = ((mix64(mix64(x) + np.uint64(SEED)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        bits = (weights - np.log(-np.log(u)) + 0.0).view(np.int64)
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _count_models(rows: DataFrame, known: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """Counts (raw, target) by bucket; each task sends one row of fixed size for each."""
    size = 1 << BUCKETS_LOG2
    train = ~_held_out(known) & (quality > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), np.int64)
        for batch in thrifty(batches):
            good = _labels_of(batch.column("doc_id"), known[train], quality[train]) > 0
            for first, row, bucket in n_gram_buckets(batch.column("text")):
                counts[0] += np.bincount(bucket, minlength=size)
                mine = good[first + row]
                if mine.any():
                    counts[1] += np.bincount(bucket[mine], minlength=size)
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    found = rows.mapInArrow(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, size))
    for r in found.toLocalIterator():
        counts[:, r.bucket] = r.raw, r.target
    return counts


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the staged rows (doc_id, log_ratio, ord) of all documents."""
    known, quality = label_sample(labels)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = _count_models(rows, known, quality) if len(known) else np.zeros((2, 1 << BUCKETS_LOG2))
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
    model = Model(np.log(share[1]) - np.log(share[0]) if counts[1].any() else np.zeros(1 << BUCKETS_LOG2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            ids = batch.column("doc_id")
            w = model.weights(batch.column("text"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(w), pa.array(model.keys(ids, w)), pa.array(_labels_of(ids, known, quality))], names=["doc_id", "log_ratio", "ord", "label"])

    scored = stage(rows.mapInArrow(run, "doc_id bigint, log_ratio double, ord bigint, label bigint"), "quality")
    if counts[1].any():
        # one row for each labelled id, MAX_LABELS at most, however often an id is repeated
        held = scored.where("label >= 0").groupBy("doc_id").agg(F.max("log_ratio").alias("log_ratio"), F.max("label").alias("label")).collect()
        model.threshold = best_threshold(held)
        if model.threshold is not None:
            model.cut = kth_largest(scored, scored.where(F.col("log_ratio") >= model.threshold).count())
    return model, scored


def best_threshold(rows: list) -> float | None:
    """The weight that separates held-out good and bad documents with the best balanced accuracy; of a gap, its middle."""
    ids = np.array([r.doc_id for r in rows], np.int64)
    x, y = np.array([r.log_ratio for r in rows]), np.array([r.label > 0 for r in rows])
    held = _held_out(ids) if len(ids) else np.zeros(0, bool)
    if y[held].any() and not y[held].all():
        x, y = x[held], y[held]
    if not y.any() or y.all():
        return None
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    lost = np.concatenate([[0], np.cumsum(y)]) / y.sum()
    caught = np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
    i = int(np.argmax(caught - lost))
    return float(x[0] if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def kth_largest(scored: DataFrame, k: int) -> int | None:
    """The k-th largest ord; every row has ord >= None where k is at least their number, no row the result for k = 0."""
    if k <= 0:
        return np.iinfo(np.int64).max
    # unsigned order, 16 bits at a time
    bits = F.col("ord").bitwiseXOR(F.lit(-(2**63)))
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = scored if prefix is None else scored.where(F.shiftrightunsigned(bits, shift + 16) == prefix)
        found = rows.groupBy(F.shiftrightunsigned(bits, shift).alias("b")).count().collect()
        for r in sorted(found, key=lambda r: -r.b if r.b >= 0 else -(r.b + 2**64)):
            if k <= r["count"]:
                prefix = r.b
                break
            k -= r["count"]
        else:
            return None
    value = (prefix % 2**64) ^ 2**63
    return value - 2**64 if value >= 2**63 else value


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_ratio, kept) of every row of documents."""
    model, scored = fit(documents, labels)
    kept = F.lit(True) if model.cut is None else F.col("ord") >= F.lit(model.cut)
    return scored.select("doc_id", "log_ratio", kept.alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns. Texts are scored again rather than shuffled to join the verdicts."""
    model, _ = fit(documents, labels)
    if model.cut is None:
        return documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            ids = batch.column("doc_id").cast(pa.int64())
            keep = model.keys(ids, model.weights(batch.column("text"))) >= model.cut
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
