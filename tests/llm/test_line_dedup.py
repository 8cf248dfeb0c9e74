import re

import numpy as np

from orrery.llm import queries
from orrery.llm.line_dedup import dedup_lines


def tokens(line):
    w = [x for x in re.split("[\x20\x09\x0b-\x0d]+", line) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(docs):
    """{(id, text): text left}, where all ids differ or rows repeat."""
    rows = sorted({r for r in docs if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, index, out = [], {}, {}
    for r in rows:
        keep = []
        for line in r[1].split("\n"):
            t = tokens(line)
            if t:
                near = {k for x in t for k in index.get(x, ())}
                hit = any(5 * len(t & seen[k]) >= 4 * len(t | seen[k]) for k in near)
                for x in t:
                    index.setdefault(x, []).append(len(seen))
                seen.append(t)
                if hit:
                    continue
            keep.append(line)
        out[r] = "\n".join(keep)
    return out


def check(docs, df):
    want = brute(docs)
    out = dedup_lines(df).collect()
    assert len(out) == len(docs)
    for d in docs:
        same = [r for r in out if r.doc_id == d[0]]
        got = sorted(r.text if r.text is not None else "\0" for r in same)
        assert got == sorted(want[x] if x[1] is not None else "\0" for x in docs if x[0] == d[0])


def test_small_cases(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = [(1, base + "\nshort one\n\nshort one"), (2, base.replace("a ", "A ") + "\nnew words in this line here\tnow"), (3, "new words in  this line here now\nx"), (4, None), (5, ""), (6, "\n\n"), (7, base + "\n" + base), (0, base.replace("m", "M")), (None, base), (8, "one two three four five"), (9, "one two three four five six"), (10, ("w%d " * 3000) % tuple(range(3000)))]
    docs += [(11, base.upper()), (11, base.upper())]
    check(docs, spark.createDataFrame([(*d, "k", 3) for d in docs], "doc_id bigint, text string, row string, n_removed int"))
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_edited_copies(spark):
    rng = np.random.default_rng(8)
    base = [[f"w{rng.integers(0, 60)}" for _ in range(int(rng.integers(5, 60)))] for _ in range(25)]
    docs = []
    for i in range(160):
        lines = []
        for _ in range(3):
            w = list(base[rng.integers(0, len(base))])
            for _ in range(int(rng.integers(0, 4))):
                w[rng.integers(0, len(w))] = f"e{rng.integers(0, 9)}"
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    check(docs, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))


def test_query_equals_brute_force(spark, smoke):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: r.text for r in queries.op3_line_dedup(spark, smoke).collect()}
    assert got == {i: want[i, t] for i, t in docs}
