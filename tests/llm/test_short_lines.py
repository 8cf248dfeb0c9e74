"""Lines of one to four words, against a brute force in which such a line has one token, all its words."""

import re

from orrery.llm import queries
from orrery.llm.line_dedup import dedup_lines


def tokens(line):
    w = [x for x in re.split("[\x20\x09\x0b-\x0d]+", line) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def brute(docs):
    """{id: text left}, where all ids differ."""
    seen, index, out = [], {}, {}
    for i, text in sorted(docs):
        keep = []
        for line in text.split("\n"):
            t = tokens(line)
            near = {k for x in t for k in index.get(x, ())}
            if not any(5 * len(t & seen[k]) >= 4 * len(t | seen[k]) for k in near):
                keep.append(line)
            for x in t:
                index.setdefault(x, []).append(len(seen))
            seen.append(t)
        out[i] = "\n".join(keep)
    return out


def test_short_lines(spark):
    docs = [
        (1, "All rights reserved.\nHome\n\none two three four five\nLes."),
        (2, "Home\none two three four\n\n  All\trights  reserved. \nall rights reserved."),
        (3, "one two three four five\none two three four\nHome Home\nHome"),
        (4, "rights All reserved.\nAllrights reserved.\n \nLes.\nLes.\na b c d\na b c d e\na b c"),
        (5, "All rights reserved.\nHome\n\none two three four five\nLes."),
    ]
    out = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert {i: t for i, (t, _) in out.items()} == brute(docs)
    assert out[5] == ("", 4) and out[2] == ("one two three four\n\nall rights reserved.", 2)


def test_query_equals_brute_force(spark, smoke):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    assert {r.doc_id: r.text for r in queries.op3_line_dedup(spark, smoke).collect()} == brute(docs)
