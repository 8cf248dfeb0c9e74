import re

import numpy as np
import pyarrow as pa

from orrery.llm import jaccard_join as j
from orrery.llm import queries
from orrery.llm.common import text_buffers, word_hashes
from orrery.llm.graph import components


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    index, parent = {}, list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for k in {k for x in s for k in index.get(x, ())}:
            if 100 * len(s & sets[k]) >= 80 * len(s | sets[k]):
                parent[root(i)] = root(k)
        for x in s:
            index.setdefault(x, []).append(i)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [x for x in groups[root(i)] if x is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 60, (70, 2))] + [(200 + i, 201 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 300)] + [(None, 3), (7, 7)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_tree_finds_every_pair_within_bound():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (300, 16))
    points[100:200] = points[:100] + (rng.random((100, 16)) < 0.1)
    size = points.sum(1)
    for query, member in ((np.ones(300, bool), np.ones(300, bool)), (rng.random(300) < 0.3, rng.random(300) < 0.8), (np.arange(300) < 90, np.arange(300) >= 90)):
        found = [(min(a, b), max(a, b)) for x, y, _ in j.tree_pairs(points, query, member) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(found) == len(set(found))
        want = {
            (a, b) for a in range(300) for b in range(a + 1, 300)
            if np.minimum(points[a], points[b]).sum() >= j.needed(size[a], size[b]) and (query[a] and member[b] or query[b] and member[a])
        }
        # a leaf with a query and a member may yield other pairs too; the roles of rows are settled after the tree
        assert want <= set(found)
        assert len(found) < 300 * 299 / 4


def test_tree_prunes_node_pairs():
    """Two clusters far apart never meet below the root."""
    points = np.zeros((64, 8), int)
    points[:32, :4], points[32:, 4:] = 5, 5
    tree = j.Tree(points, points.sum(1), np.ones(64, bool), np.ones(64, bool))
    _, _, left, right = tree.nodes[0]
    assert np.minimum(tree.corner[left], tree.corner[right]).sum() < j.needed(tree.low[left], tree.low[right])
    assert {tuple(sorted(tree.order[i:k] // 32)) for i, k, x, _ in tree.nodes if x < 0} == {(0,) * 16, (1,) * 16}


def test_points_bound_the_overlap():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, n)) for n in rng.integers(1, 400, 60)] + [""]
    flat, ends = j.flat_sets(pa.array(texts), np.arange(j.BUCKETS, dtype=np.uint64))
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    points = np.stack([np.bincount((s % np.uint64(j.GROUPS)).astype(np.int64), minlength=j.GROUPS) for s in sets])
    points[0], points[1, 3] = 300, 17
    assert (j.unpacked(j.packed(points)) == points).all()
    for x in range(2, 60):
        for y in range(2, x):
            if y:
                assert np.minimum(points[x], points[y]).sum() >= len(np.intersect1d(sets[x], sets[y]))
    f1, f2 = j.fingerprints(flat, ends)
    assert len({*zip(f1.tolist(), f2.tolist(), strict=True)}) == len({tuple(s) for s in sets}) and f1[-1] == f2[-1] == 0


def test_all_candidates_come_from_the_trees(spark, monkeypatch):
    docs = [(i, " ".join(f"w{k}" for k in range(60)) + f" x{i}") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows(j.link_documents(df)) == brute(docs) and {r[2] for r in rows(j.link_documents(df))} == {0}
    monkeypatch.setattr(j, "block_pairs", lambda blocks, *_: blocks.limit(0).selectExpr("id as a", "id as b", "true as best", "id as rest"))
    assert {r[2] for r in rows(j.link_documents(df))} == set(range(5))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (None, "one two"), (7, "a b c d e"), (8, "a b c d e f"), (9, "É a b c d"), (10, "é a b c d")]
    docs += [(11, "only null "), (None, "x y z u v w"), (None, "X y z u v w"), (12, "rep " * 50), (13, "rep " * 70), (5, "one two"), (5, "quite other words in this row"), (14, "quite other words in this row"), (15, "long " + " ".join(f"w{i}" for i in range(30000)))]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id bigint, text string, node string, n_shingles int")
    assert rows(j.link_documents(df)) == brute(docs)
    assert j.link_documents(df.limit(0)).count() == 0


def test_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    docs = []
    for i in range(260):
        family = int(rng.integers(0, 9))
        w = [f"f{family}w{k}" for k in range(40 + 13 * family)]
        for _ in range(int(rng.integers(0, 6))):
            w[rng.integers(0, len(w))] = f"e{rng.integers(0, 5)}"
        docs.append((i * 3 % 260, " ".join(["common passage of five words in many documents"] * (i % 2) + w)))
    monkeypatch.setattr(j, "TILE", 16)
    monkeypatch.setattr(j, "NEAREST", 2)
    assert rows(j.link_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4))) == brute(docs)


def test_query_equals_brute_force(spark, smoke):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    assert rows(queries.op6_jaccard_join(spark, smoke)) == brute(docs)


def test_sets_equal_plain_shingles():
    texts = ["a b c d e f a b c d e", None, "x", "A b C d e f"]
    got = j.shingle_sets(pa.array(texts), np.arange(j.BUCKETS, dtype=np.uint64))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts] and len(np.intersect1d(got[0], got[3])) == 2


def thue_morse(n, first):
    """A word over {a, b} that no polynomial hash modulo 2^64 tells from its complement, from 1,024 letters on."""
    return "".join("ab"[(i.bit_count() + first) % 2] for i in range(n))


def test_words_of_equal_polynomials_are_told_apart(spark):
    x, y = thue_morse(4096, 0), thue_morse(4096, 1)
    rows = [(1, f"one two three four {x}"), (2, f"one two three four {y}"), (3, x), (4, y), (5, f"{x} {x} {y} {x} {y}"), (6, f"{x} {x} {y} {y} {x}")]
    rows += [(10 + n, "a" * n) for n in (7, 8, 9, 15, 16, 17, 64)] + [(30, "aaaaaaaab"), (31, "baaaaaaaa"), (32, "aaaaaaaa b")]
    out = j.link_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.component_id == r.doc_id for r in out) and len(out) == len(rows)
    data, offsets = text_buffers(pa.array([t for _, t in rows]))
    hashes, _ = word_hashes(data, offsets)
    assert len(set(hashes.tolist())) == len({w for _, t in rows for w in t.split()})
