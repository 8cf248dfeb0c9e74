"""Mixing sources to target weights.

1. Sizes: words of each text; sources in code point order (null last) get weights 3, 1, 2 in turn, and share 150 % of all words;
   a target stops at 2 times its source's size and the excess is shared again by weight.
2. Packing: each source's words, in a fixed pseudorandom order of documents, are cut into blocks of BLOCK_WORDS. Word offsets
   are two-level prefix sums (within hash buckets, then over bucket totals), so a source of a third of all rows is many tasks.
3. Drawing: each output shard draws multinomial source counts, with what is left of each source's quota as weights, so
   the totals are the quotas exactly.
4. The k-th slot of a source takes block P(k mod blocks) of epoch k div blocks, P being a keyed Feistel permutation of the block indices
   of that source and epoch. In one epoch each block comes once at most, and a quota has two epochs at most, so no word is taken
   more than twice. Slots and blocks meet in an equi-join on (source, block).

Everything is a function of the rows and the seed, so reruns agree.

Edge cases: null text has size 0; an empty source has target 0; null ids and repeated rows are rows of their own. An
empty table gives an empty result. Other columns are ignored. A source smaller than a block is one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_WS, bitmap, in_bitmap, mix64, stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 64
#: Slots in an output shard, until there are MAX_SHARDS shards; then shards grow.
SHARD_SLOTS = 4096
MAX_SHARDS = 4096
#: Rows of a bucket of the prefix sums, until there are MAX_BUCKETS buckets; then buckets grow.
BUCKET_ROWS = 500
MAX_BUCKETS = 4096
SEED = 17
_STEP = 65_536
#: A word and the white space after it.
_UNIT = "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(NON_WS)), F.lit(0)).cast("bigint")


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target words of each source from {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict = {}
    left, free = share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of range(size) at index, elementwise: four Feistel rounds, walked until the value is in range."""
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) for n in np.unique(size)], np.uint64)[np.unique(size, return_inverse=True)[1]]
    low = (np.uint64(1) << half) - np.uint64(1)
    x, limit, key = index.astype(np.uint64), size.astype(np.uint64), mix64(key.astype(np.uint64))
    todo = np.ones(len(x), bool)
    while todo.any():
        h, m, k = half[todo], low[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix64(right + k + np.uint64(r * 0x9E3779B9)) & m)
        x[todo] = left << h | right
        todo &= x >= limit
    return x.astype(np.int64)


def draw_shards(quotas: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Counts by (shard, source). Each shard is multinomial over what is left of the quotas; columns sum to the quotas."""
    rng = np.random.default_rng(seed)
    total = int(quotas.sum())
    shards = int(min(MAX_SHARDS, max(1, -(-total // SHARD_SLOTS))))
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    for i in range(shards):
        need = total // shards + (i < total % shards)
        while need:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def plan(sized: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (doc_id, source, size): rows with places, block pieces, and drawn slots.

    rows: doc_id, source, size, source_id, source_size, target, start (first word's place in the source).
    pieces: source_id, block, start (of its row), word (first, within the row), words.
    slots: shard, source_id, epoch, block, place (order within the shard).
    """
    spark = sized.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    sizes = {r.source: r.size for r in found}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes)
    blocks = np.array([-(-sizes[s] // block_words) for s in order], np.int64)
    quotas = np.array([min(2 * int(b), round(goal[s] * int(b) / sizes[s])) if sizes[s] else 0 for s, b in zip(order, blocks, strict=True)], np.int64)
    # from Arrow tables: rows would go through Python workers of a kind of their own, which live on beside the others
    catalogue = spark.createDataFrame(
        pa.table({"s": pa.array(order, pa.string()), "source_id": pa.array(range(len(order)), pa.int32()), "source_size": pa.array([sizes[s] for s in order], pa.int64()), "target": pa.array([goal[s] for s in order], pa.float64())})
    )

    buckets = int(min(MAX_BUCKETS, max(1, -(-sum(r.n for r in found) // BUCKET_ROWS))))
    rows = sized.join(F.broadcast(catalogue), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(buckets)))
    totals = rows.groupBy("source_id", "bucket").agg(F.sum("size").alias("t"))
    before = F.sum("t").over(_running(["source_id"], ["bucket"])) - F.col("t")
    totals = totals.select("source_id", "bucket", before.alias("base"))
    inner = F.sum("size").over(_running(["source_id", "bucket"], ["doc_id", "size"])) - F.col("size")
    rows = rows.withColumn("inner", inner).join(totals, ["source_id", "bucket"])
    rows = stage(rows.withColumn("start", F.col("base") + F.col("inner")).drop("bucket", "base", "inner"), "mix-rows")

    full = F.lit(block_words).cast("bigint")
    span = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    pieces = rows.where("size > 0").select("source_id", "start", "size", F.explode(span).alias("block"))
    lo = F.greatest(F.lit(0).cast("bigint"), F.col("block") * full - F.col("start"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * full - F.col("start"))
    pieces = pieces.select("source_id", "block", "start", lo.alias("word"), (hi - lo).alias("words"))

    drawn = draw_shards(quotas, seed) if quotas.sum() else np.zeros((0, len(order)), np.int64)
    first = np.cumsum(drawn, axis=0) - drawn
    i, j = np.nonzero(drawn)
    cells = pa.table({"shard": i.astype(np.int32), "source_id": j.astype(np.int32), "n": drawn[i, j], "first": first[i, j], "blocks": blocks[j]})
    table = spark.createDataFrame(cells).repartition(max(8, min(len(cells), 512)), "shard", "source_id")
    # in two steps, so no array is longer than _STEP
    slots = table.withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(_STEP).cast("bigint"))))
    slots = slots.withColumn("i", F.explode(F.sequence("a", F.least(F.col("a") + _STEP, "n") - 1)))
    slots = slots.select("shard", "source_id", "blocks", (F.col("first") + F.col("i")).alias("k"))
    slots = slots.withColumn("epoch", F.expr("cast(k div blocks as int)"))

    @F.pandas_udf("bigint")
    def block_of(k: pd.Series, size: pd.Series, source: pd.Series, epoch: pd.Series) -> pd.Series:
        key = (np.uint64(seed) << np.uint64(48)) + (source.to_numpy().astype(np.uint64) << np.uint64(16)) + epoch.to_numpy().astype(np.uint64)
        return pd.Series(permute((k % size).to_numpy(), size.to_numpy(), key))

    place = F.xxhash64(F.lit(seed), "shard", "source_id", "k")
    slots = slots.select("shard", "source_id", "epoch", block_of("k", "blocks", "source_id", "epoch").alias("block"), place.alias("place"))
    # Spark takes slots for as small as the table that it is exploded from; unhinted, it would be broadcast
    return rows, pieces, slots.hint("merge")


def _running(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sized = stage(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    rows, pieces, slots = plan(sized, block_words, seed)
    taken = slots.join(pieces, ["source_id", "block"]).groupBy("source_id", "start").agg(F.sum("words").alias("taken"))
    # rows of size 0 share a start with the row after them, and take nothing
    out = rows.join(taken, ["source_id", "start"], "left")
    count = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", count.alias("taken"))


def mixed_documents(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each document, epoch and run of neighbouring blocks a row with the text of the words taken.

    Texts are slices of the original, white space between their words included; a document taken whole keeps its text as it is.
    Columns as in documents, n_chars counted anew. A document taken in neither epoch is left out, as is one without words. Rows
    of one id, text and source are mixed as rows of their own, but all carry the other columns of one of them. An empty table
    gives an empty result.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.xxhash64("doc_id", text, source)
    sized = stage(documents.select("doc_id", source.alias("source"), word_count(F.col("text")).alias("size"), key.alias("row")), "mix-sizes")
    rows, pieces, slots = plan(sized, block_words, seed)
    drawn = slots.join(pieces, ["source_id", "block"]).groupBy("source_id", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("word", "words"))).alias("_parts"))
    chosen = rows.where("size > 0").join(drawn, ["source_id", "start"]).select(F.col("row").alias("_row"), F.col("size").alias("_size"), _runs().alias("_runs"))
    # the caller's columns travel in one struct, so no name of theirs can clash with ours
    columns = [c for c in documents.columns if c not in ("text", "n_chars")]
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_own"), text.alias("_text"), key.alias("_key"))
    again = stage(sized.groupBy("row").count().where("count > 1").select("row"), "mix-again")
    touched = in_bitmap(F.col("_key"), bitmap(again, "row"))
    keyed = keyed.where(~touched).unionByName(keyed.where(touched).dropDuplicates(["_key"]))
    joined = keyed.join(chosen, F.col("_key") == F.col("_row"))
    # the one-element array binds the words, which would else be split anew for each run
    once = F.transform(F.array(F.regexp_extract_all(F.col("_text"), F.lit(_UNIT), F.lit(0))), lambda units: F.transform("_runs", lambda r: _cut(units, r)))
    # unlike explode, explode_outer gets no filter that would cut all texts a second time; no row is without runs
    out = joined.select("_own", F.explode_outer(F.element_at(once, 1)).alias("_cut"))
    made = {"text": F.col("_cut")}
    if "n_chars" in documents.columns:
        made["n_chars"] = F.length("_cut").cast(dict(documents.dtypes)["n_chars"])
    return out.select(*[made[c].alias(c) if c in made else F.col("_own").getField(c).alias(c) for c in documents.columns])


def _runs() -> Column:
    """Parts that follow on one another as one: (word, words) of each run of _parts."""
    at = lambda i: F.get("_parts", i)
    end = lambda p: p["word"] + p["words"]
    firsts = F.filter("_parts", lambda p, i: F.coalesce(end(at(i - 1)) != p["word"], F.lit(True)))
    lasts = F.filter("_parts", lambda p, i: F.coalesce(at(i + 1)["word"] != end(p), F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["word"].alias("word"), (end(b) - a["word"]).alias("words")))


def _cut(units: Column, run: Column) -> Column:
    """The text of a run; units are words with the white space after them, of which the last word's is left out."""
    first, n = (run["word"] + 1).cast("int"), run["words"].cast("int")
    body, last = F.array_join(F.slice(units, first, n - 1), ""), F.regexp_extract(F.get(units, first + n - 2), NON_WS, 0)
    return F.when(run["words"] == F.col("_size"), F.col("_text")).otherwise(F.concat(body, last))
