"""Edge cases of operators and pipeline stages, and a plain twin of the quality classifier."""

import math
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as c
from orrery.llm import embedding_dedup as ed
from orrery.llm import exact_dedup, html_text, mixing, queries, quality
from orrery.llm.line_dedup import dedup_lines

from .test_embedding_dedup import brute as embeddings_of

STAGES = dict(c.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def grams(text):
    """Buckets of a text's unigrams and bigrams, one word at a time."""
    for _, _, buckets in quality.n_gram_buckets(pa.array([text])):
        return buckets.tolist()
    return []


def test_quality_equals_plain_counts(spark, smoke):
    docs = spark.read.parquet(f"{smoke}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{smoke}/labels.parquet").collect()}
    held = {i: bool(quality._held_out(np.array([i]))[0]) for i in labels}
    raw, target = {}, {}
    for d in docs:
        for b in grams(d.text):
            raw[b] = raw.get(b, 0) + 1
            if labels.get(d.doc_id, 0) > 0 and not held[d.doc_id]:
                target[b] = target.get(b, 0) + 1
    size = 1 << quality.BUCKETS_LOG2
    total = [sum(x.values()) + size * quality.SMOOTHING for x in (raw, target)]
    weight = {b: math.log((target.get(b, 0) + quality.SMOOTHING) / total[1]) - math.log((raw[b] + quality.SMOOTHING) / total[0]) for b in raw}
    want = {d.doc_id: sum(weight[b] for b in grams(d.text)) for d in docs}
    out = queries.op1_quality(spark, smoke).collect()
    assert len(out) == len(docs) and all(math.isclose(r.log_ratio, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-6) for r in out)
    # as many stay as reach the threshold, those of the largest noisy keys
    model = quality.Model(np.zeros(size))
    keys = {r.doc_id: int(model.keys(pa.array([r.doc_id]), np.array([r.log_ratio]))[0]) for r in out}
    kept = [r.doc_id for r in out if r.kept]
    assert 0 < len(kept) < len(out) and min(keys[i] for i in kept) > max(keys[r.doc_id] for r in out if not r.kept)
    chosen = [r for r in out if r.doc_id in labels and held[r.doc_id]]
    low = quality.best_threshold([type("R", (), {"doc_id": r.doc_id, "log_ratio": r.log_ratio, "label": labels[r.doc_id]}) for r in chosen])
    assert len(kept) == sum(r.log_ratio >= low for r in out)


def test_quality_of_repeated_labels_and_long_texts(spark):
    rows = [(i % 5, ("good words here " if i % 5 < 3 else "bad junk stuff ") * (1 + (i == 7) * 200_000), 1.0, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, log_ratio double, ord int")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(5)] * 4, "doc_id bigint, quality int")
    out = quality.classify(df, labels).collect()
    assert len(out) == 60 and quality.keep_good(df, labels).columns == df.columns


def test_components_as_large_and_small_as_doubles(spark):
    rows = [(1, 0, [1e200, 2e200]), (2, 0, [1e-200, 2e-200]), (3, 0, [1.0, 2.0]), (4, 0, [-1.0, 2.0]), (5, 0, [5e-324, 0.0]), (6, 0, [1.7e308, 1.0])]
    out = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_embeddings(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")).collect()}
    assert out == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
    plain = [r for r in rows if r[0] in (3, 4)]
    assert sorted(map(tuple, ed.link_embeddings(spark.createDataFrame(plain, "vec_id bigint, label int, embedding array<double>")).collect())) == embeddings_of(plain, ed.THRESHOLD)


def test_exact_dedup_with_an_outlying_id(spark):
    rows = [(i, f"t{i % 7}") for i in range(50)] + [(2**62, "t1"), (2**62, "t1"), (None, "t1"), (None, "alone"), (-(2**62), "t1")]
    out = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.kept == (r.doc_id == r.keep_id)
    # ids 1, 8 ... 43 and 50 less one have text t1, as have four of the odd rows
    same = sum(i % 7 == 1 for i in range(50)) + 4
    assert {r.keep_id for r in out if r.doc_id in (1, 8, -(2**62))} == {-(2**62)} and [r.group_size for r in out if r.doc_id == 2**62] == [same, same]


def test_names_in_an_article():
    """Within an article a name drops a block only where it can't be the article's own section."""
    page = '<article><p>a</p><section class="legal"><p>b</p></section><div class="related"><p>c</p></div><div class="share-buttons">d</div><section id="comments"><p>e</p></section><p><math><mi>x</mi><mo>+</mo></math></p></article><div class="legal">f</div>'
    lines, zones = html_text.page_lines(page)
    assert html_text.main_text(lines, zones, np.zeros(len(lines), bool)) == "a\nb\nc\nx+"


def test_stages_of_an_empty_table(spark, smoke):
    docs = spark.createDataFrame([], SCHEMA)
    for name, f in c.STAGES:
        out = f(spark, docs, smoke)
        assert out.count() == 0, name
        if name != "encoding":
            assert out.columns == docs.columns


def test_stages_with_odd_rows_and_clashing_names(spark, smoke):
    extra = "_row string, _gone string, _parts string, _own string, _key string, _text string, n_removed int, id string, place string"
    rows = [(1, "one line here of words\nsecond line of words here", "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "a null id has this text", "en", "a"), (4, "w " * 120_000, "en", "b"), (5, "tie tie tie", "de", "b"), (5, "tie tie tie", "de", "b"), (6, " \n\t ", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *"rgpoktx"[:6], 7, "i", "p") for r in rows], f"{SCHEMA}, {extra}").repartition(3)
    for name in ("quality", "line_dedup", "near_dedup", "mixing"):
        out = STAGES[name](spark, docs, smoke)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r["_row"] == "r" and r.id == "i" and r.n_removed == 7 for r in got), name
        if name == "near_dedup":
            assert len(got) == 7 and sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "5", "6", "None"]
    assert STAGES["encoding"](spark, docs, smoke).count() == len(rows)
    out = {(r.doc_id, r.text): r.n_removed for r in dedup_lines(docs).collect()}
    assert out[4, rows[4][1]] == 0 and out[None, "a null id has this text"] == 0


def test_mix_of_rows_of_one_id_and_text(spark):
    """Repeated rows are mixed as rows of their own: no more than twice their words each."""
    rows = [(i, f"w{i} " * 70, "a") for i in range(20)] + [(99, "again " * 500, "a")] * 4
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, lang string")
    want, got = {}, {}
    for r in mixing.mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    for r in mixing.mixed_documents(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"\S+", r.text))
    assert got == {i: n for i, n in want.items() if n} and want[99] <= 4 * 2 * 500
