"""The mix takes slices of the original texts, white space included."""

import re

import pytest

from orrery.llm import mixing as m

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(spark, df, block_words):
    """[(id, text)] of every run of neighbouring blocks drawn in an epoch, from the plan's own draws."""
    sized = df.select("doc_id", "source", m.word_count(df.text).alias("size"))
    rows, pieces, slots = m.plan(sized, block_words)
    place = {(r.source_id, r.start): r.doc_id for r in rows.collect() if r.size}
    cut, drawn = {}, {}
    for p in pieces.collect():
        cut.setdefault((p.source_id, p.block), []).append(p)
    for s in slots.collect():
        for p in cut[s.source_id, s.block]:
            drawn.setdefault((place[p.source_id, p.start], s.epoch), set()).update(range(p.word, p.word + p.words))
    texts, out = {r.doc_id: r.text for r in df.collect()}, []
    for (i, _), words in drawn.items():
        spans = [x.span() for x in WORD.finditer(texts[i])]
        if len(words) == len(spans):
            out.append((i, texts[i]))
            continue
        for a in words:
            if a - 1 not in words:
                b = next(b for b in range(a, len(spans)) if b + 1 not in words)
                out.append((i, texts[i][spans[a][0] : spans[b][1]]))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 64])
def test_slices_of_the_text(spark, block):
    odd = ["\n", " ", "\t\t", "  ", "\r\n\n", " \x0b"]
    rows = [(i, "\n " * (i % 2) + "".join(f"é{i}w{k}{odd[(i * k + k) % 6]}" for k in range(i * 7 % 40 + (i % 9 == 0) * 150)), "abc"[i % 3]) for i in range(90)]
    rows += [(100, None, "a"), (101, " \n ", "a"), (102, " one\n", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    out = m.mixed_documents(df, block).collect()
    assert sorted((r.doc_id, r.text) for r in out) == brute(spark, df, block)
    texts = {i: t for i, t, _ in rows}
    assert all(r.text in texts[r.doc_id] and r.n_chars == len(r.text) for r in out)
    assert any("\n" in r.text for r in out) and (block == 3 or any(r.text == texts[r.doc_id] for r in out if r.doc_id % 2))
    taken = {r.doc_id: r.taken for r in m.mix(df, block).collect()}
    got = dict.fromkeys(taken, 0)
    for r in out:
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == taken
