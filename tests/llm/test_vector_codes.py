"""Product codes against plain Python integers, the bounds, and odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np

from orrery.llm import queries
from orrery.llm import vector_codes as vc

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def exact(x):
    m, e = math.frexp(x)
    return math.floor(math.ldexp(m, min(e + 12, 1000))) if abs(x) < 1e290 else int(x) * 4096


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [exact(x) for x in e]) for i, label, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    m = len(kept[0][2]) // parts
    cut = [[e[p * m : (p + 1) * m] for p in range(parts)] for _, _, e in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((square(s, b), c) for c, b in enumerate(books[p])) for p, s in enumerate(v)] for v in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for c in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == c]
                if own:
                    books[p][c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assigned()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    fits = lambda n: n if n < 1 << 63 else None
    by_label = {}
    for (_, label, _), n in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + n
    bad = {label for (_, label, _), n in zip(kept, error, strict=True) if fits(n) is None}
    return sorted(
        ((i, "".join(f"{c:02x}" for _, c in f), fits(n), None if label in bad else fits(by_label[label]), sha) for (i, label, _), f, n in zip(kept, found, error, strict=True)), key=str
    )


def got(df):
    return sorted((tuple(r) for r in vc.code_vectors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_query_equals_plain_integers_and_sql(spark, smoke):
    rows = [tuple(r) for r in spark.read.parquet(f"{smoke}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    out = queries.op11_vector_codes(spark, smoke)
    have = sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert have == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{smoke}/embeddings.parquet')")
    assert sorted(con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({queries.ORACLES['op11_vector_codes']})").fetchall(), key=str) == have


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, i % 3 or None, [r.gauss(0, 0.1) for _ in range(16)]) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [None] * 16), (102, 1, [math.nan] * 16), (103, 1, [0.0] * 15 + [math.inf]), (104, None, [0.0] * 16), (None, 2, [0.5] * 16), (3, 2, rows[3][2]), (3, 2, rows[3][2])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == brute(rows)
    assert got(df.selectExpr("*", "'x' as code", "1L as error", "2 as _label", "'y' as sums")) == brute(rows)
    few = rows[:5]
    assert got(spark.createDataFrame(few, SCHEMA)) == brute(few)
    same = [(7, 0, [0.25] * 16)] * 20
    assert got(spark.createDataFrame(same, SCHEMA)) == brute(same)
    empty = vc.code_vectors(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_components_of_any_size(spark):
    r = random.Random(8)
    rows = [(i, i % 2, [r.choice((1e-300, 3.0, -1e18, 1.7e308, 5e-324, -0.0, 2.0**53 + 2, r.random() * 1e6)) for _ in range(8)]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)


def test_lengths_of_their_own(spark):
    r = random.Random(9)
    rows = [(i, 0, [r.random() for _ in range(8 + 8 * (i % 2))]) for i in range(80)]
    out = {x[0]: x[1:3] + x[4:] for x in got(spark.createDataFrame(rows, SCHEMA))}
    for odd in (0, 1):
        for x in brute([row for row in rows if row[0] % 2 == odd]):
            assert out[x[0]] == x[1:3] + x[4:]
    uneven = [(i, 0, [r.random() for _ in range(n)]) for i, n in enumerate([11] * 30 + [3] * 20 + [0] * 2)]
    assert len(got(spark.createDataFrame(uneven, SCHEMA))) == len(uneven)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    entries, q = rng.integers(-2000, 2000, (16, 8)), rng.integers(-2000, 2000, (500, 8))
    file = vc.ApproximationFile(entries)
    least, most = file.bounds(q)
    d = ((q[:, None, :] - entries[None]) ** 2).sum(2)
    assert (least <= d).all() and (d <= most).all()
    entry, best = file.nearest(q)
    assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()
    assert (least <= most.min(1)[:, None]).mean() < 0.6  # most entries need no distance


def test_decode_is_as_near_as_the_error_says(spark, smoke):
    vectors = spark.read.parquet(f"{smoke}/embeddings.parquet")
    books = vc.train(vectors)
    out = vc.decode(vc.encode(vectors, books), books, 64).join(vectors.select("vec_id", "embedding"), "vec_id").limit(20).collect()
    for r in out:
        x = np.floor(4096 * np.array(r.embedding, float))
        assert ((x - 4096 * np.array(r.decoded)) ** 2).sum() == r.error
