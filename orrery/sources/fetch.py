"""Fetching from services in batches, with the call given by the caller, and decoding of what they send.

A fetch function takes a list of keys and returns rows as dicts; it runs on executors, so it must be picklable. Nothing here opens a
connection by itself.
"""

from __future__ import annotations

import base64
import gzip
import os
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of one call at most.
MOST_KEYS = 5000

Fetch = Callable[[list], list[dict]]


def fetch_halving(keys: list, fetch: Fetch, retries: int = 4, wait: float = 0.0, inner: int = 2) -> tuple[list[dict], list]:
    """(rows, keys that failed). A batch that keeps failing is halved, down to single keys, so one bad key costs only itself.

    Waits grow twofold between tries; halves get inner tries.
    """
    if not keys:
        return [], []
    if len(keys) > MOST_KEYS:
        raise ValueError(f"a batch of {len(keys)} keys exceeds {MOST_KEYS}")
    for attempt in range(retries):
        try:
            return fetch(keys), []
        except Exception:  # noqa: BLE001  whatever a service raises
            if attempt < retries - 1:
                time.sleep(wait * 2**attempt)
    if len(keys) == 1:
        return [], keys
    middle = len(keys) // 2
    left, right = (fetch_halving(part, fetch, inner, wait, inner) for part in (keys[:middle], keys[middle:]))
    return left[0] + right[0], left[1] + right[1]


def fetch_table(keys: DataFrame, key: str, fetch: Fetch, schema: T.StructType, batch: int = 500, retries: int = 4, wait: float = 0.0) -> DataFrame:
    """Rows of schema for the distinct keys, and status: 'ok', 'empty' for a key without rows, 'failed' for one whose call fails alone.

    Keys are spread over tasks and asked for in batches; keys of empty and failed rows are in the column key, other columns null.
    schema must have the column key. Filter by status, and land the result, before anything else: a rerun asks again.
    """
    if key not in schema.names:
        raise ValueError(f"the schema lacks {key}")
    whole = T.StructType([*schema.fields, T.StructField("status", T.StringType())])
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in whole.fields])
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(nullable)

        def ask(some: list) -> pa.RecordBatch:
            rows, failed = fetch_halving(some, fetch, retries, wait)
            found = {r[key] for r in rows}
            lost = set(failed)
            told = [{**r, "status": "ok"} for r in rows] + [{key: k, "status": "failed" if k in lost else "empty"} for k in some if k not in found]
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in told], schema=arrow)

        held: list = []
        for b in batches:
            held += b.column(0).to_pylist()
            while len(held) >= batch:
                yield ask(held[:batch])
                held = held[batch:]
        if held:
            yield ask(held)

    return distinct.mapInArrow(run, nullable)


def land_text(names: Sequence[str], folder: str, fetch: Callable[[str], bytes | None], retries: int = 3, wait: float = 0.0) -> list[str]:
    """Paths of the files of names under a local folder, fetched where they aren't there yet; a name without content is left out.

    A file is written beside its place and renamed, so no half of one is ever read. For a driver that lands a few files; a
    failing name raises after its tries.
    """
    os.makedirs(folder, exist_ok=True)
    out = []
    for name in names:
        path = os.path.join(folder, name)
        if not (os.path.exists(path) and os.path.getsize(path)):
            for attempt in range(retries):
                try:
                    body = fetch(name)
                    break
                except Exception:  # noqa: BLE001
                    if attempt == retries - 1:
                        raise
                    time.sleep(wait * 2**attempt)
            if not body:
                continue
            with open(f"{path}.part", "wb") as f:
                f.write(body)
            os.replace(f"{path}.part", path)
        out.append(path)
    return out


#: Bytes of a block of the image format, and of a card of its header. Fixed values.
BLOCK, CARD = 2880, 80
#: numpy types by bits per pixel.
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def read_image(data: bytes) -> tuple[list[int], np.ndarray] | None:
    """(shape, pixels as doubles, row after row) of the first image of a FITS file that has one; null pixels are NaN."""
    at = 0
    while at + BLOCK <= len(data):
        cards: dict[str, str] = {}
        ended = False
        while not ended and at + BLOCK <= len(data):
            for i in range(at, at + BLOCK, CARD):
                card = data[i : i + CARD].decode("ascii", "replace")
                if card[:8].strip() == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    cards[card[:8].strip()] = card[10:].split("/", 1)[0].strip().strip("'").strip()
            at += BLOCK
        bits, axes = int(cards.get("BITPIX", 8)), int(cards.get("NAXIS", 0))
        shape = [int(cards[f"NAXIS{k}"]) for k in range(axes, 0, -1)]
        count = int(np.prod(shape)) if shape else 0
        size = count * abs(bits) // 8
        if count and cards.get("XTENSION", "IMAGE") == "IMAGE":
            if at + size > len(data):
                return None
            raw = np.frombuffer(data, PIXELS[bits], count, at)
            pixels = raw.astype(float)
            if "BLANK" in cards and bits > 0:
                pixels[raw == int(cards["BLANK"])] = np.nan
            return shape, pixels * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
        at += -(-size // BLOCK) * BLOCK
    return None


def decode_images(files: DataFrame) -> DataFrame:
    """(plate_id, height, width, px) of base64 text columns (plate_id, body) of gzipped images. A body that is no image has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for body in batch.column("body").to_pylist():
                try:
                    data = base64.b64decode(body, validate=True) if body else b""
                    found.append(read_image(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data))
                except (ValueError, OSError, EOFError, KeyError):
                    found.append(None)
            two = [f if f and len(f[0]) == 2 else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("plate_id"), pa.array([f and f[0][0] for f in two], pa.int32()), pa.array([f and f[0][1] for f in two], pa.int32()), pa.array([f and f[1].tolist() for f in two], pa.list_(pa.float64()))],
                names=["plate_id", "height", "width", "px"],
            )

    kind = dict(files.dtypes)["plate_id"]
    return files.select("plate_id", F.col("body").cast("string").alias("body")).mapInArrow(run, f"plate_id {kind}, height int, width int, px array<double>")


def search_plates(positions: DataFrame, search: Callable[[float, float], list[str]]) -> DataFrame:
    """(ra, dec, plate_id): plates that a search names for each distinct position, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ra, dec, p) for ra, dec in zip(batch.column("ra").to_pylist(), batch.column("dec").to_pylist(), strict=True) for p in dict.fromkeys(search(ra, dec))]
            yield pa.RecordBatch.from_pydict({"ra": pa.array([r[0] for r in rows], pa.float64()), "dec": pa.array([r[1] for r in rows], pa.float64()), "plate_id": pa.array([r[2] for r in rows], pa.string())})

    return positions.select(F.col("ra").cast("double"), F.col("dec").cast("double")).distinct().mapInArrow(run, "ra double, dec double, plate_id string")
