import corpus_pipeline as c
from orrery.llm import mixing, quality

from .test_jaccard_join import brute as groups_of
from .test_line_dedup import brute as lines_of
from .test_mixed_text import WORD


def test_stages_in_turn(spark, smoke, tmp_path):
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, f in c.STAGES:
        out = f(spark, docs, smoke)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = {r.doc_id: r for r in docs.collect()} if name != "encoding" else None
        rows = after.collect()
        if name != "encoding":
            assert after.columns == columns and all(r.n_chars == len(r.text) for r in rows)
        if name == "quality":
            want = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{smoke}/labels.parquet")).where("kept").collect()}
            assert {r.doc_id for r in rows} == want
        elif name == "line_dedup":
            want = lines_of([(r.doc_id, r.text) for r in before.values()])
            assert {(r.doc_id, r.text): r.text for r in before.values()}.keys() == want.keys()
            assert {r.doc_id: r.text for r in rows} == {i: t for (i, _), t in want.items()}
        elif name == "near_dedup":
            want = {d for d, n, _, keep in groups_of([(r.doc_id, r.text) for r in before.values()]) if keep or not n}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        elif name == "mixing":
            taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
                assert r.text in before[r.doc_id].text
            assert got == {i: n for i, n in taken.items() if n}
        else:
            assert len(rows) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in rows)
        kept.append(len(rows))
        docs = after
    assert kept[0] >= kept[1] >= kept[2] and c.run(spark, smoke).count() == kept[-1]


def test_near_dedup_keeps_one_of_odd_rows(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, "p q r s t u", "s"), (None, "P q r s t u", "s"), (3, None, "s"), (4, "", "s"), (4, "", "s"), (5, "x1 x2 x3 x4 x5", "s"), (5, "y1 y2 y3 y4 y5", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((repr(r.doc_id), r.text if r.text is None else r.text.lower()) for r in c.near_dedup(spark, df, "").collect())
    assert got == sorted([("1", "a b c d e f"), ("None", "p q r s t u"), ("3", None), ("4", ""), ("5", "x1 x2 x3 x4 x5"), ("5", "y1 y2 y3 y4 y5")])
