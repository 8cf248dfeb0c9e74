"""Lines that match nothing are left out before their tokens are staged; a passage of many unlike lines makes no pairs."""

from pyspark.sql import functions as F

from orrery.llm import line_dedup

from .test_line_dedup import check

PASSAGE = [f"p{i}" for i in range(12)]


def documents():
    own = lambda i: [f"w{i}x{j}" for j in range(40)]
    docs = [(i, " ".join(own(i)) + f"\nshort {i}") for i in range(30)]
    docs += [(100 + i, " ".join(own(100 + i)[:20] + PASSAGE + own(100 + i)[20:])) for i in range(60)]
    near = lambda i: " ".join([*own(1)[:39], f"e{i}"])
    return docs + [(200 + i, near(i) + "\n" + " ".join(PASSAGE)) for i in range(5)] + [(204, near(4) + "\n" + " ".join(PASSAGE))]


def test_passages(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    check(docs, df)


def test_only_lines_that_share_tokens_are_staged(spark):
    df = spark.createDataFrame(documents(), "doc_id bigint, text string").repartition(3)
    _, nodes = line_dedup.nodes_of(df)
    near = line_dedup.near_nodes(nodes)
    ids = {r.d for r in near.select("place.d").collect()}
    assert ids.isdisjoint({i for i in range(30) if i != 1}) and {1, *range(200, 205)} <= ids
    sets = line_dedup.token_sets(df, near)
    ranked = line_dedup.by_rarity(near, sets)
    # a repeated row gives a set twice, but a node has one prefix
    assert ranked.count() == near.count() == ranked.select("id").distinct().count()
    # the passage's tokens come last by rarity, so of the unlike lines with it none is left to pair
    blocks = line_dedup.shared_prefixes(ranked)
    assert blocks.where(F.col("place.d").between(100, 199)).count() == 0
