import re

import numpy as np

from orrery.llm import mixing as m


def test_targets_reshare_the_excess():
    got = m.targets({"a": 100, "b": 10, None: 50, "c": 0})
    assert got == {"a": 120, "b": 20, None: 100, "c": 0}
    assert m.targets({}) == {} and m.targets({"x": 7}) == {"x": 10.5}
    for sizes in ({"s%02d" % i: (i * 37) % 91 for i in range(20)}, {"z": 1, "é": 5, "A": 5}):
        got = m.targets(sizes)
        assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        i = np.arange(n)
        for key in (0, 99):
            assert sorted(m.permute(i, np.full(n, n), np.full(n, key))) == i.tolist()
    assert m.permute(np.arange(500), np.full(500, 500), np.full(500, 1)).tolist() != list(range(500))


def test_shards_sum_to_quotas():
    q = np.array([5000, 1, 0, 12345])
    drawn = m.draw_shards(q)
    assert (drawn.sum(0) == q).all() and drawn.sum(1).max() - drawn.sum(1).min() <= 1


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(int(rng.integers(0, 900)))), "abc"[min(2, i % 5)]) for i in range(300)]
    rows += [(900, None, "a"), (901, "", None), (902, " \t one word \n", None), (None, "x y", "b"), (3, "x y", "b"), (3, "x y", "b"), (903, "solo " * 20000, "big")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, size int, target int")
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    out = m.mix(df).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, m.mix(df.repartition(7)).collect()))
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(i), size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = m.targets(sizes)
    assert {(r.source_size, r.target) for r in out} == {(sizes[s], want[s]) for s in sizes}
    assert all(r.taken <= 2 * r.size for r in out)
    for s in ("a", "b", "c", "big"):
        taken = sum(r.taken for r in out if (r.source_size, r.target) == (sizes[s], want[s]))
        assert abs(taken - want[s]) < 0.02 * want[s] + 64
    assert m.mix(df.limit(0)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, f"t{i} " * (i * 7 % 400), "ab"[i % 2], "en", 1) for i in range(80)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    taken = {r.doc_id: r.taken for r in m.mix(df).collect()}
    got = {}
    for r in m.mixed_documents(df).collect():
        assert set(r.text.split()) == {f"t{r.doc_id}"} and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: n for i, n in taken.items() if n}


def test_plan_has_no_rows_from_python(spark):
    """Rows that createDataFrame gets as Python objects go through Python workers of a second kind, which live on beside the first."""
    sized = spark.createDataFrame([(i, "ab"[i % 2], 50) for i in range(40)], "doc_id bigint, source string, size bigint").selectExpr("*")
    seen, make = [], spark.createDataFrame
    spark.createDataFrame = lambda *a, **b: seen.append(out := make(*a, **b)) or out
    try:
        rows, _, slots = m.plan(sized)
    finally:
        del spark.createDataFrame
    assert len(seen) == 2 and all("LogicalRDD" not in d._jdf.queryExecution().analyzed().toString() for d in seen)
    assert rows.count() == 40 and slots.count()
