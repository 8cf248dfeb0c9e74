"""Best-fit packing of tokenised documents into sequences of a fixed length, by bin completion.

1. Tokens. A map-only job encodes every whole text, ends it with an end token and cuts only what is longer than a sequence: the first
   piece takes the remainder, all others are full. A task numbers its pieces within each length as it goes.
2. Histogram. Pieces of one length are alike, so what the search sees are the counts by length, of which there are as many as a
   sequence has places, whatever the data. bin_completion.pack turns them into fillings and how often each is used.
3. Places. The n-th piece of a length takes the n-th place for that length in the list of fillings. A piece's number is its number
   within its task and length plus those of the tasks before, from the counts by (length, task); so no window runs over the documents and
   no group is collected, be a third of all pieces of one length.

Edge cases: a null or empty text is the end token alone. Repeated rows are packed each. Null ids pass through. Very long texts are
whole: as many pieces as they need. An empty table gives an empty result. Strings of added tokens inside a text become those
tokens, as the tokenizers library has it. Other columns are ignored. Ties don't matter: pieces of one length are alike, and the numbers
follow the rows' order in the written table of pieces, so a lost executor changes nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bin_completion import pack
from .bpe import PATTERN, byte_characters
from .common import stage

LENGTH = 1024
END = 2
#: Tokens of an Arrow batch of pieces, where ids are kept.
BATCH_TOKENS = 1 << 20


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    """A byte-level BPE of a tokenizers file whose ids are in the order of its merges."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_characters()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in added}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("ids must be in the order of the merges")
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in s): i for s, i in vocab.items()}, special_tokens=added)


def token_ids(text: str, vocabulary: str, end: int = END) -> np.ndarray:
    """The text's ids and the end token."""
    return np.append(encoder(vocabulary).encode_to_numpy(text, allowed_special="all").astype("<u4"), np.uint32(end)).astype("<u4")


def cut_pieces(documents: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): every document's pieces; nth counts a task's pieces of one length.

    With keep_ids, also ids: binary, little-endian unsigned 32-bit.
    """
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, out, tokens = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [np.array([r[i] for r in out], np.int64) for i in range(4)]
                size = columns[2]
                order = np.argsort(size, kind="stable")
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - np.searchsorted(size[order], size[order]) + seen[size[order]]
                seen[:] += np.bincount(size, minlength=length + 1)
                arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *map(pa.array, columns[1:]), pa.array(np.full(len(size), task, np.int64)), pa.array(nth)]
                return pa.RecordBatch.from_arrays([*arrays, *([pa.array([r[4] for r in out], pa.binary())] if keep_ids else [])], names=names)

            for i, text in enumerate(batch.column("text")):
                ids = token_ids(text.as_py() or "", vocabulary, end)
                first = len(ids) % length or length
                for piece, start in enumerate([0, *range(first, len(ids), length)]):
                    data = ids[start : first if piece == 0 else start + length].tobytes()
                    rows.append(i)
                    out.append((piece, start, len(data) // 4, zlib.crc32(data), data if keep_ids else b""))
                tokens += len(ids)
                if keep_ids and tokens >= BATCH_TOKENS:
                    yield flush()
                    rows, out, tokens = [], [], 0
            if out:
                yield flush()

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, nth bigint" + (", ids binary" if keep_ids else ""))


def place_table(packing: list) -> dict[str, np.ndarray]:
    """The packing as runs of places, sorted: of a length, from its first-th piece on, each pieces go to each bin from bin on, from offset on."""
    used: dict[int, int] = {}
    runs, bins = [], 0
    for filling, times in packing:
        offset = 0
        for size, each in filling:
            first = used.get(size, 0)
            runs.append((size, first, each, bins, offset))
            used[size] = first + each * times
            offset += size * each
        bins += times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return dict(zip(("size", "first", "each", "bin", "offset"), columns, strict=True))


def places_of(size: np.ndarray, number: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of the number-th piece of each size."""
    lo, hi = np.searchsorted(table["size"], size, "left"), np.searchsorted(table["size"], size, "right")
    while (lo + 1 < hi).any():  # the last run of the size that begins at or before the number
        mid = (lo + hi) // 2
        right = (lo + 1 < hi) & (table["first"][np.minimum(mid, len(table["first"]) - 1)] <= number)
        hi = np.where(right | (lo + 1 >= hi), hi, mid)
        lo = np.where(right, mid, lo)
    within = number - table["first"][lo]
    return table["bin"][lo] + within // table["each"][lo], table["offset"][lo] + within % table["each"][lo] * size


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces with sequence_id and offset instead of task and nth. pieces: length, task, nth, as cut_pieces gives them, written down."""
    counts = stage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length, of which a sequence bounds the number
    packing, _ = pack({r.length: r.n for r in total}, length)
    table = place_table(packing)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    bases = counts.select(F.col("length").alias("_length"), F.col("task").alias("_task"), before.alias("_base"))
    same = (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task"))
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    numbered = pieces.join(bases, same).select(*kept, (F.col("_base") + F.col("nth")).alias("_number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offset = places_of(batch.column("length").to_numpy(), batch.column("_number").to_numpy(), table)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(bins, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document; with keep_ids also ids."""
    return pack_pieces(stage(cut_pieces(documents, vocabulary, length, end, keep_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from packed pieces with ids: the sequences to train on, each of a bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
