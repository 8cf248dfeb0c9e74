"""Byte-level BPE by a pair occurrence index, equal to the tokenizers library for the same vocabulary file.

Texts are split into pre-tokens; those not seen before by this worker are laid out together as one chain of symbols, in which
pre-tokens don't touch. An index maps each pair of symbols that has a rank to all its positions in the chain. The active ranks are
applied in ascending order, each at all its positions from left to right, and a merge updates the lists of the two pairs next to it. A position
whose pair has changed since it was listed is passed over. No rank below the one applied can appear, as a merge comes after those
that make its parts, so each pre-token gets what merging it alone gives. Work is a few steps for each merge, however long a pre-token is.

Edge cases: null and empty texts have no tokens. Strings of added tokens inside a text become those tokens. Texts are
encoded whole. Repeated rows are rows of their own. An empty table gives an empty result. The vocabulary's path must be readable on every executor.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import thrifty

#: The split pattern of byte-level BPE. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a generation; a worker remembers two, which bounds its memory.
CACHE_ENTRIES = 200_000
#: Characters are encoded in blocks of about this many, cut at rows.
BLOCK_CHARS = 1_000_000
#: Above all ranks.
NO_RANK = 1 << 30


def byte_characters() -> dict[str, int]:
    """The byte each character of a vocabulary entry stands for: printable bytes stand for themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_characters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(letters[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        pieces = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_size = np.array([len(x) for x in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.start = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in parts], np.int32)
        #: Rank of each pair, two symbols in one number.
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(parts)}
        born = {m: r for r, m in enumerate(self.made.tolist())}
        if any(max(born.get(vocab[a], -1), born.get(vocab[b], -1)) >= r for r, (a, b) in enumerate(parts)):
            raise ValueError("a merge must come after those that make its parts")
        self.keys = np.array(sorted(self.rank), np.int64)
        self.key_ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Pre-tokens met lately, and those of the generation before, which are forgotten unless they are met again.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NO_RANK where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_RANK)

    def occurrences(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, dict[int, array]]:
        """Rank of the pair that begins at each position (NO_RANK for none), and by rank its positions, ranks and positions ascending."""
        rank = np.full(len(symbols), NO_RANK, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK  # no pair goes beyond a pre-token
        order = np.argsort(rank, kind="stable").astype(np.int32)
        order = order[: np.searchsorted(rank[order], NO_RANK)]
        cuts = [0, *(np.flatnonzero(np.diff(rank[order])) + 1).tolist(), len(order)]
        return rank, {int(rank[order[i]]): array("i", order[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i}

    def merge_all(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols after all merges, at the places of their first bytes, and which places are left."""
        rank_at, index = self.occurrences(symbols, ends)
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        before[np.concatenate([[0], ends[:-1]])] = -1
        text, right, left, at = (array("i", x.astype(np.int32).tobytes()) for x in (symbols, after, before, rank_at))
        heap, look, made = list(index), self.rank.get, self.made.tolist()  # ascending, so a heap
        while heap:
            rank = heappop(heap)
            new = made[rank]
            for p in sorted(index.pop(rank)):
                if at[p] != rank:
                    continue
                gone = right[p]
                text[p], at[gone], text[gone] = new, NO_RANK, -1
                far, near = right[gone], left[p]
                right[p] = far
                fresh = NO_RANK
                if far >= 0:
                    left[far] = p
                    fresh = look(new << 32 | text[far], NO_RANK)
                at[p] = fresh
                if fresh != NO_RANK:
                    if fresh in index:
                        index[fresh].append(p)
                    else:
                        index[fresh] = array("i", (p,))
                        heappush(heap, fresh)
                if near >= 0:
                    fresh = at[near] = look(text[near] << 32 | new, NO_RANK)
                    if fresh != NO_RANK:
                        if fresh in index:
                            index[fresh].append(near)
                        else:
                            index[fresh] = array("i", (near,))
                            heappush(heap, fresh)
        out = np.frombuffer(text, np.int32)
        return out, out >= 0

    def learn(self, words: list[str]) -> None:
        """Encode distinct pre-tokens together and remember their ids as little-endian 32-bit bytes."""
        raw = [w.encode("utf-8") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        merged, there = self.merge_all(self.start[np.frombuffer(b"".join(raw), np.uint8)], ends)
        data, young = merged[there].astype("<u4").tobytes(), self.young
        cuts = np.concatenate([[0], np.cumsum(there)[ends - 1]]) * 4
        for w, a, b in zip(words, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            young[w] = data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        find = self.split.findall
        split: list[list[str]] = []
        marked: dict[int, list] = {}
        for text in texts:
            if self.cut and any(s in text for s in self.added):
                # pre-tokens and ids of added tokens, in order
                parts = [x for piece in self.cut.split(text) for x in ([self.added[piece]] if piece in self.added else find(piece))]
                marked[len(split)] = parts
                split.append([x for x in parts if isinstance(x, str)])
            else:
                split.append(find(text))
        if len(self.young) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        new = set(chain.from_iterable(split)).difference(self.young)
        old = self.old
        self.young.update((w, old[w]) for w in new.intersection(old))
        new.difference_update(old)
        if new:
            self.learn(sorted(new))
        look = self.young.__getitem__
        out = [b"".join(map(look, parts)) for parts in split]
        for i, parts in marked.items():
            out[i] = b"".join([x.to_bytes(4, "little") if isinstance(x, int) else look(x) for x in parts])
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The texts of little-endian 32-bit ids; bytes that aren't UTF-8 become U+FFFD."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = self.piece_size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.piece_start[flat] - ends[:-1], size) + np.arange(ends[-1])
        data = self.piece_bytes[at].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec, with its cache, for each worker process."""
    return Codec(path)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    block, size, start = [], 0, 0
    for i, t in enumerate(texts):
        s = t.as_py() or ""
        block.append(s)
        size += len(s)
        if size >= BLOCK_CHARS:
            yield start, block
            block, size, start = [], 0, i + 1
    if block:
        yield start, block


def encode_documents(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256): the ids, and digests of them and of the text decoded from them.

    A map-only job. ids is binary, little-endian unsigned 32-bit; left out with keep_ids=False.
    """
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in thrifty(batches):
            for start, texts in _blocks(batch.column("_text")):
                ids = bpe.encode(texts)
                columns = {
                    id_col: batch.column(id_col).slice(start, len(texts)),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    **({"ids": pa.array(ids, pa.binary())} if keep_ids else {}),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in bpe.decode_all(ids)], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    kind = dict(rows.dtypes)[id_col]
    ids_field = "ids binary, " if keep_ids else ""
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, {ids_field}ids_sha256 string, decoded_sha256 string")
