"""URL filters: explicit rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small table of labelled URLs, of at most MAX_LABELLED rows, that a caller may give; the
default is invented by rule. Its weights have a fixed size.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule, and the model's verdict on nothing
(allow). An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_buffers

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Words from which the default table of labelled URLs is made. Fixed values.
UNWANTED_WORDS = (
    "casino poker bingo jackpot slots roulette blackjack betting bet wager lottery gamble pills pill pharmacy meds viagra tablets steroids "
    "adult porn xxx sex cams nude escort erotic dating ads adserver adclick banner popup tracker tracking pixel affiliate clicks "
    "spam scam phishing linkfarm farm clickbait malware warez crack loans payday cash credit cheap free win winner bonus prize discount replica"
).split()
ORDINARY_WORDS = (
    "news library school museum garden weather kitchen history river mountain science physics music theatre gallery travel city "
    "health nursing forum docs wiki archive journal review letters research university college teacher reading writing stories "
    "nature animals forest ocean island harbour station market bakery village council parish football cricket tennis running "
    "software compiler database network hardware engine motor bicycle railway thread stitch therapy address roads winter window "
    "freedom farmer trackside spanish adults clinic credits cashmere better alphabet pillow cheese prized bonfire sextant "
    "cooking painting housing morning building singing sewing knitting sailing hiking printing engineering"
).split()
NEUTRAL_PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}/index.html", "/2020/05/{}", "/about", "/it/{}", "/item?id={}")
UNWANTED_PATHS = ("/offer/{}", "/bonus/claim", "/buy/cheap-{}", "/click?ad={}", "/win/prize", "/xxx/{}", "/free/spins")
_TOPS = ("com", "org", "net", "info")
_SUBDOMAINS = ("", "www.", "m.", "blog.")


def _plain_name(i: int) -> str:
    """An invented name of two to four syllables, from the number i by a fixed rule."""
    x = (i + 1) * 2654435761 % 2**32
    out = ""
    for _ in range(2 + x % 3):
        x = (x * 1103515245 + 12345) % 2**31
        out += "bcdfghjklmnprstvwz"[x >> 8 & 15] + ("h" if x >> 12 & 7 == 0 else "") + "aeiou"[(x >> 16) % 5] + ("nrstl"[(x >> 24) % 5] if x >> 20 & 1 else "")
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The default table: (url, 1 unwanted or 0 ordinary), invented by rule. Paths are dealt alike to both, so hosts decide."""
    n, out = len(UNWANTED_WORDS), []

    def add(i: int, name: str, label: int, path: str) -> None:
        host = f"{_SUBDOMAINS[i % 4]}{name}.{('example.' if i % 3 else '')}{_TOPS[i // 4 % 4]}"
        out.append((f"https://{host}{path.format(100 + i * 37 % 9000)}", label))

    for i, w in enumerate(UNWANTED_WORDS):
        for k, join in ((0, ""), (7, "-"), (20, ""), (31, "-"), (45, "-")):
            name = w if not k else w + join + UNWANTED_WORDS[(i + k) % n]
            add(len(out), name, 1, NEUTRAL_PATHS[len(out) % len(NEUTRAL_PATHS)])
    for i in range(len(out)):
        a, b = ORDINARY_WORDS[i % len(ORDINARY_WORDS)], ORDINARY_WORDS[i * 7 % len(ORDINARY_WORDS)]
        add(i, (a, f"{a}-{b}", f"{a}{b}", _plain_name(i), f"{_plain_name(i)}-{_plain_name(i + 5000)}")[i % 5] if i % 2 else _plain_name(i), 0, NEUTRAL_PATHS[i % len(NEUTRAL_PATHS)])
    for i in range(4 * len(UNWANTED_PATHS)):
        add(i, _plain_name(i + 9000), 1, UNWANTED_PATHS[i % len(UNWANTED_PATHS)])
    return out


BUCKETS_LOG2 = 15
SIZES = (3, 4, 5)
THRESHOLD = 0.5
#: Rows of a table of labelled URLs at most.
MAX_LABELLED = 20_000
_CODE = mix64(np.arange(2001, 2001 + 2 * max(SIZES) + 2, dtype=np.uint64)) | np.uint64(1)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    start = F.instr(url, "://")
    rest = F.coalesce(F.when(start > 0, F.substring(url, start + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules is a bounded driver-side list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(column: pa.Array, field: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram (of UTF-8 bytes) of a column; the ends of a value are marked."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    size = np.diff(offsets) + 2 * (np.diff(offsets) > 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) - ends[row]
    text = np.full(len(row), 256, np.uint64)
    text[(at > 0) & (at < size[row] - 1)] = data
    rows, buckets = [], []
    for k in SIZES:
        if len(row) < k:
            continue
        h = np.full(len(row) - k + 1, field * 16 + k, np.uint64) * _CODE[-1]
        for j in range(k):
            h = h + (text[j : len(row) - k + 1 + j] + np.uint64(1)) * _CODE[j]
        inside = row[: len(h)] == row[k - 1 :]
        rows.append(row[: len(h)][inside])
        buckets.append((mix64(h[inside]) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) triples; a row's values have Euclidean length 1 if it has any, counted per gram."""
    parts = [_grams(host, 1), _grams(path, 2)]
    row, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(row, minlength=len(host)) if len(row) else np.zeros(len(host))
    return row, bucket, 1 / np.sqrt(np.maximum(count, 1))[row]


def _split(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1] if "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    return rest[:n].lower(), rest[n:].split("#", 1)[0].split("?", 1)[0]


@lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, int], ...], steps: int = 400, rate: float = 4.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent over (url, label) rows, both classes weighing the same; deterministic."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    y = np.array([v for _, v in labelled], float)
    if not 0 < y.sum() < len(y):
        raise ValueError("labelled URLs of both classes are needed")
    host, path = (pa.array(x) for x in zip(*(_split(u) for u, _ in labelled), strict=True))
    row, bucket, value = features(host, path)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(1 << BUCKETS_LOG2), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[bucket], minlength=len(y)) + b)))
        g = (p - y) * weight
        w -= rate * (np.bincount(bucket, value * g[row], minlength=len(w)) + l2 * w)
        b -= rate * g.sum()
    return w, float(b)


def scores(host: pa.Array, path: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    row, bucket, value = features(host, path)
    return 1 / (1 + np.exp(-(np.bincount(row, value * model[0][bucket], minlength=len(host)) + model[1])))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD, labelled: DataFrame | list[tuple[str, int]] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest fitting rule's verdict, else block where score >= threshold.

    labelled has the URLs to train on with their labels (1 unwanted, 0 ordinary), as a list or as a DataFrame of url and label.
    A map-only job: parsing and rules are JVM expressions, only host and path go to Python, in Arrow batches.
    """
    if isinstance(labelled, DataFrame):
        labelled = [(r.url, int(r.label)) for r in labelled.where("url is not null and label is not null").select("url", "label").orderBy("url", "label").limit(MAX_LABELLED + 1).collect()]
    model = train(tuple(labelled_urls() if labelled is None else labelled))
    host, path = host_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)).select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_given"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column("host"), batch.column("path"), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    schema = f"`{id_col}` {dict(parsed.dtypes)[id_col]}, host string, path string, rule string, _given string, score double"
    verdict = F.coalesce("_given", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return parsed.mapInArrow(score, schema).select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
