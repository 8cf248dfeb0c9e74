import hashlib
import re

import numpy as np

from orrery.llm import exact_dedup as ed


def brute(rows):
    groups, out = {}, []
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 5000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        data = ed.build_filter(keys)
        assert ed.may_contain(data, keys).all()
        assert ed.may_contain(data, rng.integers(0, 2**63, 20000, dtype=np.uint64)).mean() < 0.01


def test_dedup_equals_brute_force(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3) + "end") for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, " "), (None, "text 1 end"), (None, "only null"), (104, "\u00a0"), (5, "text 5  end"), (105, "x" * 300_000), (-9, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, sha string, n int")
    for batches in (1, 2, 5):
        got = sorted((tuple(r) for r in ed.dedup(df, batches).collect()), key=repr)
        assert got == brute(rows)
    assert ed.dedup(df.limit(0)).count() == 0


def test_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    got = ed.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {0} and sum(r.kept for r in got) == 1
