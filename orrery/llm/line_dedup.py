"""Line dedup: an exact set-similarity join of the lines of all documents, in DataFrame operations only.

A line's tokens are its distinct runs of five words; a line of one to four words has one token, all its words. Lines whose token
sets have a Jaccard similarity of 0.8 or more match, and of matching lines the later one (by document id, then place) goes. Lines
without words have no token and always stay.

1. A line's tokens are sorted by hash, so equal sets are equal arrays. Equal sets become one node, with the place of its first line;
   its later lines go.
2. Prefix filter: whatever the order of tokens, two sets of n tokens can reach 0.8 only if they share one of their first
   n - ceil(0.8 n) + 1. Nodes that share none of these by hash order match nothing, and are left out; the tokens of all others are staged.
3. Rarity: the tokens of the nodes left are counted in 65,536 hash buckets, and each node's are sorted anew by their bucket's rank by
   count. The prefix filter is applied again in this order, in which a passage that many unlike lines share comes last. Prefix
   tokens that only one node has are dropped; of tokens that the same nodes have, the first stands for all.
4. First pass: every node is held against the earliest node (the hub) of each shared token, under the length and the
   positional filter. Near copies of an earlier line fall here, without pairs inside their group.
5. Second pass: nodes that no earlier node has removed meet all earlier nodes of their shared tokens, under the same
   filters. So no match is missed, and pairs are made only for lines that stay.

Survivors of the filters are verified by their whole sets. Order of places: document id (nulls last), then row (by a hash of
id and text), then line number. Words are separated by white space (the line feed ends the line) and compared as they are.
A set is told by 128 bits of hash, a token by 64.

Edge cases: null text stays null, empty text stays empty. Identical repeated rows count as one row, and keep the same lines. Lines
that stay are joined by line feeds as before. An empty table gives an empty result. Other columns pass through unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, dense, discard, in_bitmap, stage

SHINGLE = 5
#: Similarity as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 4, 5
BUCKETS = 1 << 16
#: White space other than the blank and the line feed.
_ODD_SPACE = r"[\x09\x0B-\x0D]"


def _words(line: Column) -> Column:
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.array_remove(F.split(F.when(odd, F.regexp_replace(line, _ODD_SPACE, " ")).otherwise(line), " "), "")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def lines_of(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line) of every line that isn't empty."""
    return documents.select(_row_key().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")


def rarity_ranks(sets: DataFrame) -> Column:
    """Of each hash bucket the rank by count over the tokens of all sets, in a token's top 16 bits. A scalar subquery."""
    each = sets.select(F.explode("tokens").alias("token"))
    found = each.groupBy(F.shiftrightunsigned("token", 48).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))
    counts = dense(stage(found, "rarity"), BUCKETS, "bucket", "n")
    one = sets.sparkSession.range(1).select(counts.alias("counts")).select(F.array_sort(F.transform("counts", lambda n, i: F.struct(n.alias("n"), i.cast("bigint").alias("i")))).alias("order"))
    ranked = one.select(F.posexplode("order").alias("rank", "x")).select(F.col("x.i").alias("bucket"), F.shiftleft(F.col("rank").cast("bigint") - BUCKETS // 2, 48).alias("top"))
    return dense(stage(ranked, "ranks"), BUCKETS, "bucket", "top")


def _hashes(words: Column) -> Column:
    """The tokens of a line's words: hashes of runs of SHINGLE word hashes, or of all where there are fewer."""
    runs = lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE, F.lit(0))),
        # of a shorter line the missing words are nulls, which the hash passes over
        lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]),
    )
    # the one-element array binds the word hashes; a line of white space has none
    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(F.array().cast("array<bigint>"))), 1)


def _by_rarity(tokens: Column, ranks: Column) -> Column:
    low = F.lit((1 << 48) - 1)
    # arrays without nulls are sorted as primitives, and what stands around a higher-order function is compiled
    ranked = lambda r: F.transform(tokens, lambda t: F.coalesce(F.get(r, F.shiftrightunsigned(t, 48).cast("int")).bitwiseOR(t.bitwiseAND(low)), F.lit(0)))
    return F.array_distinct(F.sort_array(F.element_at(F.transform(F.array(ranks), ranked), 1)))


def _prefix(tokens: Column) -> Column:
    """The first tokens of a set, of which a set with the similarity shares one at least with its own first ones."""
    n = F.size(tokens)
    return F.slice(tokens, F.lit(1), (n - F.floor((n * NUMERATOR + (DENOMINATOR - 1)) / DENOMINATOR) + 1).cast("int"))


def _needed(m: Column, n: Column) -> Column:
    """Smallest overlap of sets of m and n tokens with the similarity: ceil(t (m + n) / (1 + t))."""
    d = NUMERATOR + DENOMINATOR
    return F.floor(((m + n) * NUMERATOR + (d - 1)) / d)


def _length_fits(m: Column, n: Column) -> Column:
    return F.least(m, n) * DENOMINATOR >= F.greatest(m, n) * NUMERATOR


def nodes_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, line_no, h1, h2) of every line with words, and nodes: (id, h1, h2, place, copies, n, prefix)."""
    tokens = lines_of(documents).select("row", "doc_id", "line_no", F.array_distinct(F.sort_array(_hashes(_words(F.col("line"))))).alias("tokens"))
    whole = stage(
        tokens.select("row", "doc_id", "line_no", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(1), "tokens").alias("h2"), F.size("tokens").alias("n"), _prefix(F.col("tokens")).alias("prefix")),
        "lines",
    )
    found = whole.where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("line_no").alias("l"))
    best = found.groupBy("h1", "h2").agg(F.min(F.struct(place.alias("place"), "n", "prefix")).alias("best"), F.count("*").alias("copies"))
    nodes = stage(best.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "best.place", "copies", "best.n", "best.prefix"), "nodes")
    lines = stage(found.select("row", "doc_id", "line_no", "h1", "h2"), "lines")
    discard(whole)
    return lines, nodes


def shared_prefixes(nodes: DataFrame) -> DataFrame:
    """(token, id, n, pos, place) of prefix tokens that several nodes have, one token for each set of nodes."""
    entries = nodes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    tokens = stage(entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "tokens")
    shared = stage(entries.where(in_bitmap(F.col("token"), bitmap(tokens, "token"))).join(tokens, "token"), "shared")
    discard(tokens)
    # of tokens that the same nodes have, the first in the order stands for all: the first common token of a pair is always kept
    print1, print2 = F.xxhash64("id", F.lit(1)), F.xxhash64("id", F.lit(2))
    told = shared.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(print1).alias("x1"), F.bit_xor(print2).alias("x2"))
    one = told.groupBy("x1", "x2", "size").agg(F.min("token").alias("token")).select("token")
    blocks = stage(shared.join(one, "token").join(nodes.select("id", "place"), "id").select("token", "id", "n", "pos", "place"), "blocks")
    discard(shared)
    return blocks


def near_nodes(nodes: DataFrame) -> DataFrame:
    """(id, n, place) of the nodes that share a token of their prefixes with another."""
    entries = nodes.select("id", F.explode("prefix").alias("token"))
    tokens = stage(entries.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "tokens")
    some = entries.where(in_bitmap(F.col("token"), bitmap(tokens, "token"))).join(tokens, "token").select("id").distinct()
    near = stage(nodes.select("id", "n", "place").join(some, "id"), "near")
    discard(tokens)
    return near


def token_sets(documents: DataFrame, near: DataFrame) -> DataFrame:
    """(row, line_no, doc, tokens) of the lines that the nodes are first on, cut again.

    Bitmaps of fixed size choose the lines, so a few others are there too. Repeated rows give a line more than once.
    """
    wanted = near.select(F.col("place.r").alias("row"), F.col("place.l").alias("line_no"))
    key = F.xxhash64("row", "line_no")
    rows = documents.where(in_bitmap(_row_key(), bitmap(wanted, "row")))
    chosen = lines_of(rows).where(in_bitmap(key, bitmap(wanted.select(key.alias("key")), "key")))
    return stage(chosen.select("row", "line_no", F.col("doc_id").alias("doc"), F.array_distinct(_hashes(_words(F.col("line")))).alias("tokens")), "sets")


def by_rarity(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes (id, n, place) with their prefixes in the order of rarity over the sets, which hold each node's."""
    # a subquery may not stand within a higher-order function; the optimiser puts it there, so no row carries it
    ranked = sets.select("row", "line_no", "doc", "tokens", rarity_ranks(sets).alias("ranks"))
    ranked = ranked.select("row", "line_no", "doc", _by_rarity(F.col("tokens"), F.col("ranks")).alias("tokens")).select("row", "line_no", "doc", _prefix(F.col("tokens")).alias("prefix"))
    at = (F.col("place.r") == F.col("row")) & (F.col("place.l") == F.col("line_no")) & F.col("place.d").eqNullSafe(F.col("doc"))
    # repeated rows give a set more than once; by the keys of the join the groups need no further exchange
    return stage(near.join(ranked, at).groupBy("row", "line_no", "id", "n", "place").agg(F.min("prefix").alias("prefix")).select("id", "n", "place", "prefix"), "ranked")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose token sets have the similarity. pairs: a, b and their places x and y, staged.

    Only sets that the pairs name are shuffled, as far as bitmaps of fixed size can tell.
    """
    out = pairs
    for p in "xy":
        named = bitmap(pairs.select(F.xxhash64(f"{p}.r", f"{p}.l").alias("key")), "key")
        side = sets.where(in_bitmap(F.xxhash64("row", "line_no"), named)).select(F.col("row").alias(f"{p}r"), F.col("line_no").alias(f"{p}l"), F.col("doc").alias(f"{p}d"), F.col("tokens").alias(f"{p}t"))
        at = F.col(f"{p}.r"), F.col(f"{p}.l"), F.col(f"{p}.d")
        out = out.join(side, (at[0] == F.col(f"{p}r")) & (at[1] == F.col(f"{p}l")) & at[2].eqNullSafe(F.col(f"{p}d")))
    shared = F.size(F.array_intersect("xt", "yt"))
    return out.where(shared >= _needed(F.size("xt"), F.size("yt"))).select("a", "b")


def _passes(x: str, y: str) -> Column:
    """Length and positional filter of two entries of one token."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    return _length_fits(nx, ny) & (most >= _needed(nx, ny))


def removed_lines(documents: DataFrame) -> DataFrame:
    """(row, doc_id, line_no) of every line that goes."""
    documents = documents.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    lines, nodes = nodes_of(documents)
    near = near_nodes(nodes)
    sets = token_sets(documents, near)
    ranked = by_rarity(near, sets)
    blocks = shared_prefixes(ranked)
    discard(near, ranked)

    hubs = blocks.groupBy("token").agg(F.min(F.struct("place", "id", "n", "pos")).alias("hub")).select("token", "hub.*")
    pair = F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.place").alias("x"), F.col("y.place").alias("y")
    met = blocks.alias("x").join(hubs.alias("y"), F.col("x.token") == F.col("y.token")).where((F.col("x.id") != F.col("y.id")) & _passes("x", "y"))
    tried = stage(met.select(*pair).distinct(), "tried")
    gone = stage(verified(tried, sets).select(F.col("a").alias("id")).distinct(), "gone")

    left = blocks.join(gone, "id", "left_anti")
    fits = (F.col("x.token") == F.col("y.token")) & (F.col("y.place") < F.col("x.place")) & _passes("x", "y")
    pairs = left.select(*blocks.columns).alias("x").join(blocks.alias("y"), fits).select(*pair).distinct()
    untried = stage(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "untried")
    more = verified(untried, sets).select(F.col("a").alias("id"))
    gone = stage(gone.unionByName(more).distinct().withColumn("whole", F.lit(True)), "gone")
    discard(sets, blocks, tried, untried)

    # nodes of one line that stays need no look at their lines
    some = nodes.select("id", "h1", "h2", "place", "copies").join(gone, "id", "left").where("copies > 1 or whole")
    first = (F.col("row") == F.col("place.r")) & F.col("doc_id").eqNullSafe(F.col("place.d")) & (F.col("line_no") == F.col("place.l"))
    return lines.join(some.select("h1", "h2", "place", "whole"), ["h1", "h2"]).where(F.col("whole").isNotNull() | ~first).select("row", "doc_id", "line_no").distinct()


def dedup_lines(documents: DataFrame, count: str | None = "n_removed") -> DataFrame:
    """All columns of documents with text less the lines that go, and in the column count (none with None) the number of them, an int.

    Only rows that lose lines are shuffled to meet them, as far as a bitmap of fixed size can tell.
    """
    lost = removed_lines(documents).groupBy(F.col("row").alias("_row"), F.col("doc_id").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    gone = stage(lost, "removed")
    columns = [c for c in documents.columns if c != count]
    # the caller's columns travel in one struct, so no name of theirs can clash with ours
    text = F.col("text").cast("string")
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("_own"), F.col("doc_id").alias("_id"), text.alias("_text"), F.xxhash64("doc_id", text).alias("_key"))
    touched = in_bitmap(F.col("_key"), bitmap(gone, "_row"))
    some = keyed.where(touched).join(gone, (F.col("_key") == F.col("_row")) & F.col("_id").eqNullSafe(F.col("_doc")), "left")
    kept = F.filter(F.split("_text", "\n"), lambda line, i: ~F.array_contains("_gone", i))
    some = some.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")))
    out = lambda df, left, n: df.select(*[left.alias("text") if c == "text" else F.col("_own").getField(c).alias(c) for c in columns], *([n.cast("int").alias(count)] if count else []))
    return out(keyed.where(~touched), F.col("_text"), F.lit(0)).unionByName(out(some, F.col("_left"), F.coalesce(F.size("_gone"), F.lit(0))))
