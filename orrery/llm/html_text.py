"""Main text of web pages by nearest-URL page differencing.

Every page is cut into text blocks (lines). The distinct line lists of a host are put in the order of their URL paths (copies of
a page by their first path), and each is paired with the nearest other: of the two neighbours the one that shares the
longer path prefix. The two pages' lines are aligned by their longest common subsequence, and shared lines are
template, and deleted.

Two corrections follow, as pages may share real text and templates may differ between neighbours: lines inside the page's article
(<article>, <main>) stay even if shared, for copies of an article are still its text; and lines inside navigation, headers, footers,
sidebars, forms, notices, adverts or comments go even if not shared. Where a page has an article, only lines within it are its text.

Edge cases: null html is empty; a page without text has text "" and n_chars 0. A null url counts as host and path "". Repeated rows
and copies on one host are one line list, so they are compared with the nearest page that differs; a list alone on its host is
compared with no one. Unclosed and stray tags are tolerated. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, discard, in_bitmap, stage
from .url_filter import host_path

#: Elements by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page: code, titles, and what forms hold.
RAW = {"script", "style", "template", "textarea", "title", "head", "select", "datalist"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = set("nav header footer aside form menu dialog button search fieldset".split())
MAIN = {"article", "main"}
#: What closes an open p, or an open element of its own kind.
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "optgroup", "legend"}
CHROME_ROLE = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|footer|site-header|page-header|masthead|cookies?|consent|gdpr|notice|popup|modal|"
    r"newsletter|subscribe|signup|sign-up|login|share|sharing|social|related|recommend\w*|comments?|comment-\w+|disqus|respond|replies|reply|widget|toolbar|pagination|pager|tags?-list|tag-cloud|skip-link|copyright|legal|disclaimer|alert)(?=$|[\s_-])",
    re.I,
)
#: Names that outside an article mark template, and within one may be its own sections.
AMBIGUOUS_NAME = re.compile(r"^(?:legal|copyright|related|recommend\w*|disclaimer|alert|notice|banner|promo\w*|login|signup|sign-up|social|menu\w*|nav\w*|footer|reply|replies|respond|comment-(?!form|list|respond)\w+)$", re.I)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Tags of a page whose quotes don't close that are looked at to the page's end; after them a tag ends at the next >, quoted or not.
OPEN_QUOTES = 8
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"[\s ]+")
#: Zones of a line.
BODY, ARTICLE, TEMPLATE = 0, 1, 2


def _names_chrome(value: str, zone: int) -> bool:
    """Whether a class or id names template; within an article only by a name that can't be a section of its own."""
    found = [m[0].strip(" \t\r\n\f_-") for m in CHROME_NAME.finditer(value)]
    return any(zone != ARTICLE or not AMBIGUOUS_NAME.match(n) for n in found)


def _is_chrome(tag: str, attributes: str, zone: int) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if zone != ARTICLE and (name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name == "role" and value.lower() in CHROME_ROLE or name in ("class", "id") and tag not in ("body", "html", "article", "main") and _names_chrome(value, zone):
            return True
    return False


def _tokens(html: str) -> Iterator[tuple[str, str, str | None, int]]:
    """(kind, text, attributes, end) in order: kind is text, or open or close with the tag's name as text. Time is linear in the page.

    The caller may send a place to go on from.
    """
    at, n, last, failed = 0, len(html), html.rfind(">"), 0
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            sent = yield "text", html[at:end], None, end
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        elif at > last:  # no tag ends any more
            end = n
            sent = yield "text", html[at:], None, end
        elif html[at + 1] in "!?":
            at = html.index(">", at) + 1
            continue
        else:
            m = (_TAG if failed < OPEN_QUOTES else _PLAIN_TAG).match(html, at)
            if m:
                end = m.end()
                sent = yield "close" if html[at + 1] == "/" else "open", m[1].lower(), m[2], end
            else:
                failed += html[at + 1 : at + 3].lstrip("/")[:1].isalpha()
                end = at + 1
                sent = yield "text", "<", None, end
        at = end if sent is None else sent


class _Open:
    """The open elements, with the places of each tag and of blocks among them, so that no step searches the whole stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []  # tag, zone inside
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, zone: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, zone))

    def cut(self, place: int) -> None:
        """Close all elements from place on."""
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An end tag: its last element closes with all in it; a stray inline end tag doesn't close blocks."""
        own = self.places.get(tag)
        if own and (tag in BLOCK or not self.blocks or self.blocks[-1] < own[-1]):
            self.cut(own[-1])

    def last_block(self) -> str | None:
        return self.stack[self.blocks[-1]][0] if self.blocks else None

    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else BODY


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """Text blocks of a page in order, and their zones."""
    lines: list[str] = []
    zones: list[int] = []
    elements = _Open()
    buffer: list[str] = []
    unclosed: set[str] = set()  # raw elements of which no end tag is left
    zone = BODY

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                lines.append(text)
                zones.append(zone)

    tokens, to = _tokens(html), None
    while True:
        try:
            kind, tag, attributes, at = tokens.send(to) if to is not None else next(tokens)
        except StopIteration:
            break
        to = None
        if kind == "text":
            buffer.append(tag)
            continue
        if kind == "close":
            if tag in BLOCK:
                flush()
            elements.close(tag)
            zone = elements.zone()
            continue
        if tag in RAW:
            if tag != "head" and not attributes.rstrip().endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
                if end:
                    to = end.end()
                else:
                    unclosed.add(tag)
                    to = len(html) if tag in ("script", "style") else None
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            outer = elements.last_block()
            if tag in CLOSES_P and outer == "p" or tag in ("li", "td", "th", "tr", "dd", "dt", "option") and outer == tag:
                elements.cut(elements.blocks[-1])
                zone = elements.zone()
        inside = zone
        if tag in CHROME and not (tag == "header" and zone == ARTICLE) or _is_chrome(tag, attributes, zone):
            inside = TEMPLATE
        elif tag in MAIN and zone != TEMPLATE:
            inside = ARTICLE
        elements.push(tag, inside)
        if inside != zone and tag not in BLOCK:
            flush()
        zone = inside
    flush()
    return lines, zones


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a are in a longest common subsequence with b; lines are 64-bit hashes.

    Bit-parallel (Hyyro, 2004): one big-integer step for each line of a that occurs in b. Lines that the other page lacks can't be
    matched and are left out first.
    """
    out = np.zeros(len(a), bool)
    i = np.flatnonzero(np.isin(a, b))
    j = np.flatnonzero(np.isin(b, a))
    _common(a[i].tolist(), b[j].tolist(), i, out)
    return out


#: Bits of one alignment kept at a time; longer pages are halved (Hirschberg).
LCS_BITS = 1 << 26


def _rows(a: list, b: list, keep: bool) -> list[int] | int:
    """After each prefix of a, the bits of b where the length of the common subsequence doesn't grow."""
    where: dict = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else v


def _common(a: list, b: list, names: np.ndarray, out: np.ndarray) -> None:
    if not a or not b:
        return
    if len(a) * len(b) > LCS_BITS and len(a) > 1:
        half = len(a) // 2
        head, tail = _rows(a[:half], b, False), _rows(a[half:][::-1], b[::-1], False)
        bits = lambda v: np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer((v ^ ((1 << len(b)) - 1)).to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)])])
        cut = int(np.argmax(bits(head) + bits(tail)[::-1]))
        _common(a[:half], b[:cut], names[:half], out)
        _common(a[half:], b[cut:], names[half:], out)
        return
    rows = _rows(a, b, True)
    i, j = len(a), len(b)
    while i and j:
        # zero bits of a row count the length of the common subsequence
        if not rows[i] >> (j - 1) & 1 and rows[i - 1] >> (j - 1) & 1 and a[i - 1] == b[j - 1]:
            out[names[i - 1]] = True
            i, j = i - 1, j - 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1


def main_text(lines: list[str], zones: list[int], shared: np.ndarray) -> str:
    """Shared lines go, but article lines stay and template lines go; with an article, only its lines."""
    article = ARTICLE in zones
    return "\n".join(t for t, z, s in zip(lines, zones, shared, strict=True) if z == ARTICLE or z == BODY and not article and not s)


def _line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in lines], np.uint64).view(np.int64)


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(uid, near): for each page the nearest by path on its host, null if it has none. pages: uid, host, path.

    Pages are sorted over all tasks by (host, path, uid), so a large host is many tasks. Neighbours across the ends of tasks
    come from one small table of the first and last page of each task.
    """
    columns = ["host", "path", "uid"]
    spark = pages.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(pages.select(*columns).repartitionByRange(parts, *columns).withColumn("task", F.spark_partition_id()), "page-order")
    w = Window.partitionBy("task").orderBy(*columns)
    page = F.struct("host", "path", "uid")
    inner = ranged.select("task", *columns, F.lag(page).over(w).alias("before"), F.lead(page).over(w).alias("after"))
    ends = ranged.groupBy("task").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    order = Window.orderBy("first")  # one row for each task of the sort
    ends = ends.select("task", F.lag("last").over(order).alias("b"), F.lead("first").over(order).alias("a"))
    joined = inner.join(F.broadcast(ends), "task")
    joined = joined.select(*columns, F.coalesce("before", "b").alias("before"), F.coalesce("after", "a").alias("after"))

    def prefix(other: str):
        letters = lambda c: F.split(F.col(c), "")
        same = F.transform(F.arrays_zip(letters("path").alias("x"), letters(f"{other}.path").alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
        first = F.array_position(same, False)
        return F.when(F.col(f"{other}.host") == F.col("host"), F.when(first > 0, first - 1).otherwise(F.length("path"))).otherwise(-1)

    p, q = F.coalesce(prefix("before"), F.lit(-1)), F.coalesce(prefix("after"), F.lit(-1))
    return joined.select("uid", F.when((p >= q) & (p >= 0), F.col("before.uid")).when(q >= 0, F.col("after.uid")).alias("near"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row; n_shared lines were shared with the nearest page."""
    host, path = host_path(F.col("url"))
    # rows are told apart by id and content, so repeated rows have one result
    uid = F.xxhash64("page_id", "url", "html")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), uid.alias("uid"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_line_hashes(page_lines(h.as_py())[0]).tolist() for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "host", "path")), pa.array(lines, pa.list_(pa.int64()))], names=["uid", "host", "path", "lines"])

    places = pages.select(uid.alias("uid"), host.alias("host"), path.alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = places.mapInArrow(hashes, "uid bigint, host string, path string, lines array<bigint>")
    hashed = stage(hashed.withColumn("list", F.xxhash64("lines")), "page-lines")
    # one page stands for all of its host with the same lines
    lists = hashed.groupBy("host", "list").agg(F.min(F.struct("path", "uid")).alias("first")).select("host", "first.path", "first.uid", "list")
    near = stage(nearest_pages(lists).where("near is not null"), "page-pairs")
    once = hashed.select("uid", "host", "list", "lines").dropDuplicates(["uid"])
    other = once.select(F.col("uid").alias("near"), F.col("lines").alias("other"))
    paired = near.join(once, "uid").join(other, "near")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(shared_lines(np.array(a.as_py(), np.int64), np.array(b.as_py(), np.int64))).tolist() for a, b in zip(batch.column("lines"), batch.column("other"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("list"), pa.array(found, pa.list_(pa.int32()))], names=["host", "list", "shared"])

    aligned = paired.select("host", "list", "lines", "other").mapInArrow(align, "host string, list bigint, shared array<int>").where(F.size("shared") > 0)
    shared = stage(hashed.select("uid", "host", "list").distinct().join(aligned, ["host", "list"]).select("uid", "shared"), "page-shared")
    discard(hashed, near)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, many = [], []
            for h, s in zip(batch.column("html"), batch.column("shared"), strict=True):
                lines, zones = page_lines(h.as_py())
                mark = np.zeros(len(lines), bool)
                mark[s.as_py() or []] = True
                out.append(main_text(lines, zones, mark))
                many.append(int(mark.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out), pa.array([len(t) for t in out], pa.int64()), pa.array(many, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    # only pages that may have shared lines are shuffled to meet them
    touched = in_bitmap(F.col("uid"), bitmap(shared, "uid"))
    some = rows.where(touched).join(shared, "uid", "left").select("page_id", "url", "html", "shared")
    rest = rows.where(~touched).select("page_id", "url", "html", F.lit(None).cast("array<int>").alias("shared"))
    return rest.unionByName(some).mapInArrow(texts, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint, n_shared bigint")
