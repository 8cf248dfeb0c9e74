import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n\n  x", "hello world's it'll 123,456 \t end ", "aaaaaaaaaaaaaaaaaaaa", "éèê ñandú 漢字 🙂🙂 ﷺ", "<|endoftext|>a<|endoftext|><|endoftext|> b",
    "x" * 3000 + " " * 500, "don't Don'T 'S 's's", "\u00a0\u2003tab\u3000", "e\u0301 \u200d", "\x00\x01\x7f", "<|endoftext", "AB" * 999,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_codec_equals_library(library):
    codec = bpe.Codec(PATH)
    for text, got in zip(TEXTS, codec.encode(TEXTS), strict=True):
        ids, back = expected(library, text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids, text
        assert codec.decode(got) == back == text


def test_cache_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(PATH)
    for _ in range(2):
        for text in TEXTS:
            (got,) = codec.encode([text])
            assert len(got) // 4 == len(expected(library, text)[0])


def test_invalid_utf8_is_replaced_as_in_library(library):
    codec = bpe.Codec(PATH)
    some = [codec.encode(["é漢🙂"])[0]]
    ids = [int.from_bytes(some[0][i : i + 4], "little") for i in range(0, len(some[0]), 4)]
    for part in (ids[:1], ids[1:], ids[:-1], ids[::-1]):
        assert codec.decode(b"".join(i.to_bytes(4, "little") for i in part)) == library.decode(part, skip_special_tokens=False)


def test_documents(spark, smoke, library):
    rows = [(i, t, "extra", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, 2), (1, "again", "x", 3), (1, "again", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    out = bpe.encode_documents(df, PATH).collect()
    assert len(out) == len(rows)
    for got, want in zip(sorted(out, key=lambda r: (r.ids_sha256)), sorted(rows, key=lambda r: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in expected(library, r[1] or "")[0])).hexdigest()), strict=True):
        ids, back = expected(library, want[1] or "")
        assert got.n_tokens == len(ids) and got.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode_documents(docs, PATH, keep_ids=False).collect():
        ids = expected(library, text[r.doc_id])[0]
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_index_holds_every_occurrence():
    codec = bpe.Codec(PATH)
    words = ["aaaa", "abab", "ba", "zzb", "a", "é"]
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw])
    symbols = codec.start[np.frombuffer(b"".join(raw), np.uint8)]
    rank, index = codec.occurrences(symbols, ends)
    want = {}
    for k, end in enumerate(ends.tolist()):
        for p in range(end - len(raw[k]), end - 1):
            r = codec.rank.get(int(symbols[p]) << 32 | int(symbols[p + 1]))
            if r is not None:
                want.setdefault(r, []).append(p)
                assert rank[p] == r
    assert {r: list(x) for r, x in index.items()} == want and list(index) == sorted(index)


def test_random_words_equal_library(library):
    r = random.Random(2)
    codec = bpe.Codec(PATH)
    texts = ["".join(r.choice(s) for _ in range(r.randint(1, 400))) for s in ("ab", "aA ", "etaoin ", "01", "é漢x", " \n", "'st ", "=-") for _ in range(30)]
    for text, got in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == expected(library, text)[0]


def test_a_word_of_a_million_letters_takes_seconds(library):
    r = random.Random(3)
    for text in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "ab" * 500_000):
        start = time.perf_counter()
        (got,) = bpe.Codec(PATH).encode([text])
        assert time.perf_counter() - start < 10
        assert np.frombuffer(got, "<u4").tolist() == expected(library, text)[0]
