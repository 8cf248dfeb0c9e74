import numpy as np
import pyarrow as pa

from orrery.llm import queries, quality
from orrery.llm.common import shingle_hashes, text_buffers, word_hashes


def test_words_and_shingles_match_plain_python():
    texts = ["a b  c", None, "", " \n", "A b\tC d E f", "é漢 é漢", "one two three four five six", "x" * 5000, "a b  c"]
    data, offsets = text_buffers(pa.array(texts))
    words, ends = word_hashes(data, offsets)
    plain = [[w for w in (t or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w] for t in texts]
    assert np.diff(ends).tolist() == [len(p) for p in plain]
    seen = {}
    for w, h in zip([w for p in plain for w in p], words.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    s, so = shingle_hashes(words, ends, 5)
    assert np.diff(so).tolist() == [max(len(p) - 4, min(1, len(p))) for p in plain]
    assert s[so[0]] == s[so[8]] and len(set(s[so[6] : so[7]].tolist())) == 2


def test_held_out_accuracy_and_edges(spark, smoke):
    d = smoke.replace("0.001", "0.01")
    out = {r.doc_id: r.kept for r in queries.op1_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    ids = np.array([r.doc_id for r in labels])
    held = quality._held_out(ids)
    pairs = [(r.quality > 0, out[r.doc_id]) for r, h in zip(labels, held, strict=True) if h]
    good = [k for q, k in pairs if q]
    bad = [k for q, k in pairs if not q]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.25
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a", "x"), (3, "a", "x")], "doc_id bigint, text string, kept string")
    few = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1)], "doc_id bigint, quality int")
    assert quality.classify(docs, few).count() == 5
    assert quality.keep_good(docs, few.limit(0)).count() == 5 and quality.classify(docs.limit(0), few).count() == 0


def test_kth_largest(spark):
    values = [5, -7, 2**62, -(2**63), 0, 5, 2**63 - 1, -1]
    df = spark.createDataFrame([(v,) for v in values], "ord bigint")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_keep_good_equals_classify(spark, smoke):
    docs, labels = (spark.read.parquet(f"{smoke}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept
