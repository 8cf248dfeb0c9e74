"""Packing: the search against exhaustive search, the operator against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import bin_completion as bc
from orrery.llm import packing, queries


def fewest(items, capacity):
    """Exhaustive: the least number of bins, each item into every open bin or a new one."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0] if items else 0


def checked(counts, capacity, found):
    used = {}
    for filling, times in found:
        assert times > 0 and sum(s * n for s, n in filling) <= capacity
        for s, n in filling:
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    return sum(t for _, t in found)


def test_search_is_exact_on_small_inputs():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice((10, 20, 30, 100))
        items = [r.randint(1 if r.random() < 0.3 else capacity // 5, capacity * 3 // 4) for _ in range(r.randint(1, 10))]
        counts = {s: items.count(s) for s in items}
        found, proven = bc.pack(counts, capacity)
        n = checked(counts, capacity, found)
        fit = checked(counts, capacity, bc.best_fit(counts, capacity))
        assert bc.least_bins(counts, capacity) <= n <= fit
        if proven:
            assert n == fewest(items, capacity), (items, capacity)
        assert proven
    # the search finds what best fit misses, however often it occurs
    items = {44: 1, 24: 2, 22: 1, 21: 1, 17: 1, 8: 2, 6: 2}
    for times in (1, 7, 10**9):
        many = {s: n * times for s, n in items.items()}
        found, proven = bc.pack(many, 60)
        assert proven and checked(many, 60, found) == 3 * times < checked(many, 60, bc.best_fit(many, 60))


def test_best_fit_equals_one_item_at_a_time():
    r = random.Random(5)
    for _ in range(100):
        capacity = r.choice((12, 50))
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 60))), reverse=True)
        rooms = []
        for s in items:
            fits = [k for k, room in enumerate(rooms) if room >= s]
            if fits:
                k = min(fits, key=lambda k: rooms[k])
                rooms[k] -= s
            else:
                rooms.append(capacity - s)
        counts = {s: items.count(s) for s in items}
        assert checked(counts, capacity, bc.best_fit(counts, capacity)) == len(rooms)


def test_fillings_are_whole_and_undominated():
    counts = {9: 1, 6: 1, 5: 2, 4: 1, 3: 2, 1: 1}
    found = list(bc.fillings(counts, 20))
    sums = [sum(s * n for s, n in f) for f in found]
    assert sums == sorted(sums, reverse=True) and max(sums) == 20 and all(f[0][0] == 9 for f in found)
    assert len(set(found)) == len(found)
    assert not any(dict(f).get(1) and dict(f).get(5) and not dict(f).get(6) for f in found)  # 6 would replace 5 and 1


def test_counts_of_any_size_cost_the_same():
    counts = {s: 10**12 + s for s in range(1, 1025)}
    found, proven = bc.pack(counts, 1024)
    assert proven and checked(counts, 1024, found) == bc.least_bins(counts, 1024) and len(found) < 20_000
    halves = {700: 10**9, 400: 10**9, 330: 10**9, 320: 5}
    found, _ = bc.pack(halves, 1024)
    assert checked(halves, 1024, found) <= 2 * 10**9 + 2
    with pytest.raises(ValueError):
        bc.pack({1025: 1}, 1024)
    assert bc.pack({}, 1024) == ([], True)


def library():
    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def valid(out, texts, length):
    """Every document's tokens, in order and once; sequences without gaps; returns the number of sequences."""
    t = library()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in texts)
    assert sum(len(w) for w in want) == sum(r.length for r in out)
    for k, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        rows = sorted(by_doc[k], key=lambda r: (r.piece, r.sequence_id))
        copies = sum(i == k for i, _ in texts)
        lengths = [len(ids) % length or length] + [length] * (-(-len(ids) // length) - 1)
        assert [r.length for r in rows[::copies]] == lengths
        start = 0
        for r in rows[::copies]:
            data = np.array(ids[start : start + r.length], "<u4").tobytes()
            assert r.start == start and r.ids_crc32 == zlib.crc32(data)
            start += r.length
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_seq)


def test_query_equals_tokenizers_and_needs_no_more_than_the_bound(spark, smoke):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()]
    out = queries.op12_packing(spark, smoke).collect()
    n = valid(out, texts, 1024)
    counts = {}
    for r in out:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert n <= bc.least_bins(counts, 1024) + 1 and n <= sum(t for _, t in bc.best_fit(counts, 1024))
    assert sorted(map(tuple, out)) == sorted(map(tuple, queries.op12_packing(spark, smoke).collect()))


def test_repacking_betters_best_fit():
    r = random.Random(6)
    counts = {}
    for _ in range(20_000):
        s = min(1024, max(1, round(r.gauss(360, 120))))
        counts[s] = counts.get(s, 0) + 1
    n, fit, bound = checked(counts, 1024, bc.pack(counts, 1024)[0]), sum(t for _, t in bc.best_fit(counts, 1024)), bc.least_bins(counts, 1024)
    assert n - bound < (fit - bound) / 2


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (None, "no id"), (4, "word " * 3000), (5, "x" * 5000), (6, " \n\t  "), (7, "日本語 é " * 40), (8, "same"), (8, "same")]
    df = spark.createDataFrame([(*t, "c", 7) for t in texts], "doc_id bigint, text string, task string, nth int").repartition(3)
    for length in (16, 1024):
        out = packing.pack_documents(df, queries.tokenizer_path(), length).collect()
        valid(out, texts, length)
    empty = packing.pack_documents(df.where("false"), queries.tokenizer_path())
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_sequences_hold_their_pieces(spark, smoke):
    docs = spark.read.parquet(f"{smoke}/documents.parquet").limit(40)
    packed = packing.pack_documents(docs, queries.tokenizer_path(), 256, keep_ids=True)
    parts = {}
    for r in packed.collect():
        parts.setdefault(r.sequence_id, []).append((r.offset, bytes(r.ids)))
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(parts[r.sequence_id])) and r.n_tokens * 4 == len(r.ids) <= 1024
