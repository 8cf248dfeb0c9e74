import math

import numpy as np

from orrery.llm import embedding_dedup as ed


def brute(rows, threshold):
    first = {}
    for v, label, e in sorted(rows, key=repr):
        ok = v is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        if ok:
            first[v] = min(first.get(v, (label, e)), (label, e))
    links = {}
    for a, (la, ea) in first.items():
        for b, (lb, eb) in first.items():
            if a != b and la == lb and len(ea) == len(eb):
                x, y = np.array(ea, float), np.array(eb, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.setdefault(a, set()).add(b)
    out = []
    for v, _, _ in rows:
        seen, todo = {v}, [v]
        while todo:
            for w in links.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        c = min(seen) if v is not None else None
        out.append((v, len(links.get(v, ())), c, v == c))
    return sorted(out, key=repr)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 33)), rng.normal(size=(50, 33)) ** 9, np.eye(33)])
    code, scale, coded, error, length = ed.quantise(x)
    unit = x / length[:, None]
    gap = np.abs(unit @ unit.T - ed.code_products(code, code) * scale[:, None] * scale[None, :])
    assert (gap <= coded[:, None] * error[None, :] + error[:, None] * (1 + ed.SLACK) + ed.SLACK).all()
    assert (ed.code_products(code, code) == code.astype(int) @ code.astype(int).T).all()


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), int(i % 3), [float(np.float32(v)) for v in base[i % 12] + rng.normal(size=8) * 0.12]) for i in range(150)]
    odd = [(500, 0, None), (501, 0, []), (502, 0, [0.0] * 8), (503, 0, [1.0, None] + [0.0] * 6), (504, 0, [float("nan")] + [1.0] * 7), (505, 0, [float("inf")] + [1.0] * 7)]
    odd += [(506, None, [1.0] * 8), (None, 0, [1.0] * 8), (507, 0, [1.0] * 7), (508, 0, [2.0] * 7), (509, 0, [1.0] * 8), (509, 0, [1.0] * 8), (510, 0, [3.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id bigint, label int, embedding array<float>, n_links string")
    for tile in (4096, 16):
        got = sorted((tuple(r) for r in ed.link_embeddings(df, 0.95, tile).collect()), key=repr)
        assert got == brute(rows + odd, 0.95)
    assert ed.link_embeddings(df.limit(0)).count() == 0
