"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct runs of five words. Two documents link when 5 * intersection >= 4 * union. Sets are 64-bit
shingle hashes. The shingles are hashed into GROUPS groups; a set's counts by group are a point, and the sum of coordinate minima of two
points bounds their overlap from above.

1. Partition. A tree over all points prunes little, as every box of many documents covers them all. Two linked sets of n
   shingles share one of their first n - ceil(0.8 n) + 1 in any common order, so points are dealt into blocks by prefix
   shingle. The order is by rarity (counts of all shingles of all documents in 65,536 hash buckets), which puts the passages
   that many documents share last. Shingles with the same members make one block.
2. Index. The points of a block, in tiles of bounded size, are packed into a tree: halved along the coordinate of the widest
   spread down to leaves, each node with the maxima of its coordinates and the range of its sizes. The tree is joined with
   itself; pairs of nodes, then of points, are pruned by the sum of minima against the overlap that their sizes need. All
   candidates come from here. A pair is emitted only in the first of the blocks that its two sets share.
3. Verification of the surviving pairs by their whole sets.
4. Rounds. At first a point proposes its NEAREST best pairs in a block at most, and a tile meets only itself and its block's first tile,
   so a group of copies yields about as many pairs as members. Best pairs are verified first, and their links make
   components; of the others only pairs of different components are verified. Blocks that had more pairs or tiles come again, with
   pairs within one component left out, and at last with all pairs that are left and members outside the block's largest
   component as queries.

Every link between different components is found, so components are exact up to collisions of 64-bit shingle hashes, which are
not polynomials of the text: two different shingles share one with a chance of 2^-64. Equal sets of hashes are one node. Links within
a component are not all enumerated, so the result names components and not numbers of links.

Edge cases: null or wordless text has an empty set, links with nothing, and is its own component. One to four words are one
shingle. A null doc_id takes part but can't be a component's smallest id; if all ids of a component are null it is null. Repeated
rows each give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, chunks, discard, in_bitmap, mix64, shingle_hashes, stage, text_buffers, thrifty, word_hashes
from .graph import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
BUCKETS = 1 << 16
#: Coordinates of a point.
GROUPS = 256
#: Points in a leaf of the tree, and sets in a tile of a block.
LEAF = 16
TILE = 512
#: Pairs that a set proposes in a block at first.
NEAREST = 4

def raw_shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, shingle hashes, and row offsets into them."""
    data, offsets = text_buffers(texts)
    for i, j in chunks(offsets):
        words, ends = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, *shingle_hashes(words, ends, SHINGLE)


def shingle_sets(texts: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct shingles, the rarest first: the bucket in the top 16 bits is replaced by its rank."""
    out: list[np.ndarray] = []
    for _, s, offsets in raw_shingles(texts):
        s = ranks[(s >> np.uint64(48)).astype(np.int64)] << np.uint64(48) | s & np.uint64((1 << 48) - 1)
        out += [np.unique(s[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def rarity_ranks(documents: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in thrifty(batches):
            for _, s, _ in raw_shingles(batch.column("text")):
                counts += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in documents.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket] = r.n
    ranks = np.empty(BUCKETS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return ranks


def needed(m, n):
    """Smallest overlap with which sets of m and n shingles link: ceil(t (m + n) / (1 + t))."""
    d = NUMERATOR + DENOMINATOR
    return ((m + n) * NUMERATOR + d - 1) // d


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set: sums of remixed members, so of any order; 0 for the empty set."""
    out = []
    size = np.diff(offsets)
    for salt in (77, 1_000_003):
        total = np.zeros(len(size), np.uint64)
        if len(flat):
            total[size > 0] = np.add.reduceat(mix64(flat + np.uint64(salt)), offsets[:-1][size > 0])
        out.append(np.where(size > 0, mix64(total + size.astype(np.uint64)), np.uint64(0)).view(np.int64))
    return out[0], out[1]


def flat_sets(texts: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingle_sets one after the other, and offsets by row."""
    sets = shingle_sets(texts, ranks)
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def packed(points: np.ndarray) -> list[bytes]:
    """Points as bytes: half a byte for each coordinate, or one or four where a count needs them."""
    most = points.max(1) if len(points) else np.zeros(0, int)
    halves = (points[:, 0::2] << 4 | points[:, 1::2]).astype(np.uint8)
    return [h.tobytes() if m < 16 else p.astype(np.uint8 if m < 256 else "<u4").tobytes() for p, h, m in zip(points, halves, most, strict=True)]


def unpacked(column: list[bytes]) -> np.ndarray:
    out = np.zeros((len(column), GROUPS), np.int32)
    size = np.array([len(p) for p in column], int)
    small = np.flatnonzero(size == GROUPS // 2)
    if len(small):
        halves = np.frombuffer(b"".join([column[i] for i in small.tolist()]), np.uint8).reshape(len(small), -1)
        out[small, 0::2], out[small, 1::2] = halves >> 4, halves & 15
    for i in np.flatnonzero(size != GROUPS // 2).tolist():
        out[i] = np.frombuffer(column[i], np.uint8 if size[i] == GROUPS else "<u4")
    return out


# --- the tree -------------------------------------------------------------------------------------


class Tree:
    """A binary tree over points, in arrays: rows first to last of order, children, upper corner, least and most size, roles below."""

    def __init__(self, points: np.ndarray, size: np.ndarray, query: np.ndarray, member: np.ndarray):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # first, last, left child, right child
        todo = [(0, len(points), -1, 0)]
        while todo:
            i, j, parent, place = todo.pop()
            me = len(self.nodes)
            self.nodes.append((i, j, -1, -1))
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, me, right) if place == 0 else (a, b, left, me)
            if j - i > LEAF:
                own = points[self.order[i:j]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                self.order[i:j] = self.order[i:j][np.lexsort((size[self.order[i:j]], own[:, widest]))]
                half = (i + j) // 2
                todo += [(half, j, me, 1), (i, half, me, 0)]
        rows = [self.order[i:j] for i, j, _, _ in self.nodes]
        self.corner = np.stack([points[r].max(0) for r in rows])
        self.low, self.high = np.array([size[r].min() for r in rows]), np.array([size[r].max() for r in rows])
        self.query, self.member = np.array([query[r].any() for r in rows]), np.array([member[r].any() for r in rows])


def tree_pairs(points: np.ndarray, query: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a query and a member, either first, that may link, with bound over need; each pair once."""
    if len(points) < 2:
        return
    size = points.sum(1)
    tree = Tree(points, size, query, member)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        (i, j, left, right), (k, m, left2, right2) = tree.nodes[x], tree.nodes[y]
        if not (tree.query[x] & tree.member[y] | tree.query[y] & tree.member[x]):
            continue
        if tree.low[x] * NUMERATOR > tree.high[y] * DENOMINATOR or tree.low[y] * NUMERATOR > tree.high[x] * DENOMINATOR:
            continue
        if x != y and np.minimum(tree.corner[x], tree.corner[y]).sum() < needed(tree.low[x], tree.low[y]):
            continue
        if x == y and left >= 0:
            todo += [(left, left), (left, right), (right, right)]
        elif left >= 0 and (left2 < 0 or j - i >= m - k):
            todo += [(left, y), (right, y)]
        elif left2 >= 0:
            todo += [(x, left2), (x, right2)]
        else:
            a, b = tree.order[i:j], tree.order[k:m]
            bound = np.minimum(points[a][:, None, :], points[b][None, :, :]).sum(2)
            need = needed(size[a][:, None], size[b][None, :])
            good = bound >= need
            if x == y:
                good = np.triu(good, 1)
            u, v = np.nonzero(good)
            if len(u):
                yield a[u].astype(np.int32), b[v].astype(np.int32), (bound[u, v] / need[u, v]).astype(np.float32)


#: Roles of a row in a tile task: it looks for members, is found, or both; a member that looks elsewhere too is met by smaller ids only.
QUERY, MEMBER, BOTH, MEMBER_TOO = 0, 1, 2, 3


def task_pairs(ids: np.ndarray, component: np.ndarray, side: np.ndarray, points: np.ndarray, earlier: list[np.ndarray], most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(a, b, best, whole) of one tile task: pairs a < b of the tree, of different components, whose first shared block this is.

    earlier are the smaller blocks that each row has: a pair with a common one is emitted there. With most, only pairs among the
    most best of one of their ends; whole tells whether that left none out. best marks the best pair of either end.
    """
    query, member, also = (side == QUERY) | (side == BOTH), side != QUERY, side >= BOTH
    found = list(tree_pairs(points, query, member))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), True
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    forward = query[i] & member[j] & (~also[j] | (ids[i] < ids[j]))
    back = query[j] & member[i] & (~also[i] | (ids[j] < ids[i])) & ~forward
    i, j, score = np.concatenate([i[forward], j[back]]), np.concatenate([j[forward], i[back]]), np.concatenate([score[forward], score[back]])
    keep = (ids[i] != ids[j]) & (component[i] != component[j])
    i, j, score = i[keep], j[keep], score[keep]
    if len(i):
        names, at, many = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        if (many > 1).any():
            several = many[at] > 1
            held = np.zeros((len(ids), int((many > 1).sum())), np.float32)
            held[np.repeat(np.arange(len(ids)), [len(x) for x in earlier])[several], (np.cumsum(many > 1) - 1)[at[several]]] = 1
            common = held @ held.T > 0
            keep = ~common[i, j]
            i, j, score = i[keep], j[keep], score[keep]
    whole = True
    if most is not None and len(i):
        keep = _best(ids[i], score, ids[j], most) | _best(ids[j], score, ids[i], most)
        whole = bool(keep.all())
        i, j, score = i[keep], j[keep], score[keep]
    best = _best(ids[i], score, ids[j], 1) | _best(ids[j], score, ids[i], 1) if len(i) else np.zeros(0, bool)
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), best, whole


def _best(node: np.ndarray, score: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Which rows are among their node's most best scores; of equal ones the smallest others."""
    order = np.lexsort((other, -score, node))
    start = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
    place = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    out = np.zeros(len(node), bool)
    out[order] = place < most
    return out


# --- stages ---------------------------------------------------------------------------------------


def document_sets(documents: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(doc_id, row, n_shingles, f1, f2, prefix, point) of every row; row is a hash of id and text, f1 and f2 the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            flat, offsets = flat_sets(batch.column("text"), ranks)
            size = np.diff(offsets)
            first = size - (size * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR + (size > 0)
            at = np.arange(len(flat)) - np.repeat(offsets[:-1], size)
            prefix = flat[at < np.repeat(first, size)].view(np.int64)
            f1, f2 = fingerprints(flat, offsets)
            points: list[bytes] = []
            for i in range(0, len(size), 256):
                j = min(i + 256, len(size))
                cell = np.repeat(np.arange(j - i), size[i:j]) * GROUPS + (flat[offsets[i] : offsets[j]] % np.uint64(GROUPS)).astype(np.int64)
                points += packed(np.bincount(cell, minlength=(j - i) * GROUPS).reshape(j - i, GROUPS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(size), pa.array(f1), pa.array(f2),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(prefix)), pa.array(points, pa.binary()),
                ],
                names=["doc_id", "row", "n_shingles", "f1", "f2", "prefix", "point"],
            )

    rows = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, n_shingles bigint, f1 bigint, f2 bigint, prefix array<bigint>, point binary")


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return int((q[at] == p).sum()) if len(q) else 0


def verified(pairs: DataFrame, texts: DataFrame, ranks: np.ndarray) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = np.concatenate([part.column("a").to_numpy(), part.column("b").to_numpy()])
                # a text that is in many pairs of the batch is cut once
                _, first, again = np.unique(ids, return_index=True, return_inverse=True)
                sets = shingle_sets(pa.concat_arrays([part.column("x"), part.column("y")]).take(pa.array(first)), ranks)
                x, y = ([sets[i] for i in half] for half in (again[: len(part)], again[len(part) :]))
                shared = np.array([_overlap(p, q) for p, q in zip(x, y, strict=True)], np.int64)
                good = shared >= needed(np.array([len(p) for p in x], np.int64), np.array([len(q) for q in y], np.int64))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _texts(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(id, text) of the pairs' nodes. A bitmap of fixed size holds back most other texts before the shuffle."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    chosen = stage(nodes.join(wanted, "id").select("id", "row", "f1", "f2"), "chosen")
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("row"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thrifty(batches):
            f1, f2 = fingerprints(*flat_sets(batch.column("text"), ranks))
            same = (f1 == batch.column("f1").to_numpy()) & (f2 == batch.column("f2").to_numpy())
            yield batch.select(["id", "text"]).filter(pa.array(same))

    some = keyed.where(in_bitmap(F.col("row"), bitmap(chosen, "row")))
    # a hash of id and text may be another row's too, so the set of each text is checked
    return some.join(chosen, "row").select("id", "f1", "f2", "text").mapInArrow(check, "id bigint, text string").dropDuplicates(["id"])


def shared_blocks(nodes: DataFrame) -> DataFrame:
    """(shingle, id, size): prefix shingles that several nodes have, one for each set of members, with the number of members."""
    entries = nodes.select("id", F.explode("prefix").alias("shingle"))
    several = stage(entries.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle"), "several")
    shared = stage(entries.where(in_bitmap(F.col("shingle"), bitmap(several, "shingle"))).join(several, "shingle"), "shared")
    discard(several)
    print1, print2 = F.xxhash64("id", F.lit(1)), F.xxhash64("id", F.lit(2))
    told = shared.groupBy("shingle").agg(F.count("*").alias("size"), F.bit_xor(print1).alias("h1"), F.bit_xor(print2).alias("h2"))
    one = told.groupBy("h1", "h2", "size").agg(F.min("shingle").alias("shingle")).select("shingle", "size")
    blocks = stage(shared.join(one, "shingle"), "blocks")
    discard(shared)
    return blocks


def _tasks(tile: str, tiles: str, full: bool) -> Column:
    """(q, m, side) of the tile tasks that a row takes part in.

    Not full: each tile with itself and with the block's first. Full: queries are the rows outside the block's largest component
    (query tile qt of qts, null for the others), against all tiles.
    """
    span = lambda n: f"sequence(0L, {n} - 1)"
    if not full:
        own = f"array(struct({tile} as q, {tile} as m, {BOTH} as side))"
        hub = f"if({tile} > 0, array(struct({tile} as q, 0L as m, {QUERY} as side)), transform(filter({span(tiles)}, x -> x > 0), x -> struct(x as q, 0L as m, {MEMBER} as side)))"
        return F.expr(f"concat({own}, {hub})")
    looks = f"transform({span(tiles)}, x -> struct(qt as q, x as m, if(x = {tile}, {BOTH}, {QUERY}) as side))"
    met = f"transform(filter({span('qts')}, x -> x <> qt), x -> struct(x as q, {tile} as m, {MEMBER_TOO} as side))"
    rest = f"transform({span('qts')}, x -> struct(x as q, {tile} as m, {MEMBER} as side))"
    return F.expr(f"if(qt is null, {rest}, concat({looks}, {met}))")


def open_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(shingle, id, size, component) of the blocks that join several components."""
    labelled = blocks.join(found.withColumnRenamed("node", "id"), "id", "left").select("shingle", "id", "size", F.coalesce("component_id", "id").alias("component"))
    several = labelled.groupBy("shingle").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("shingle")
    return labelled.join(several, "shingle")


def block_pairs(blocks: DataFrame, members: DataFrame, most: int | None) -> DataFrame:
    """(a, b, best, rest) from the trees of the blocks (shingle, id, size, component).

    Rows are candidate pairs of different components; a row without a and b names in rest a block that has more of them.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("bigint")
    dealt = blocks.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("id"), tiles)})
    if most is None:
        largest = dealt.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("top"))
        dealt = dealt.join(largest.select("shingle", "top.main", "top.n"), "shingle")
        qts = F.ceil((F.col("size") - F.col("n")) / TILE).cast("bigint")
        dealt = dealt.withColumn("qts", qts).withColumn("qt", F.when(F.col("component") != F.col("main"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("qts"))))
    split = (F.col("tiles") > 1) & F.lit(most is not None)
    dealt = dealt.select("shingle", "id", "component", split.alias("split"), F.explode(_tasks("tile", "tiles", most is None)).alias("task"))
    keys = ["shingle", "q", "m"]
    rows = dealt.select("shingle", "task.q", "task.m", "task.side", "split", "id", "component").join(members, "id")
    rows = rows.withColumn("earlier", F.filter("shingles", lambda x: x < F.col("shingle")))
    rows = rows.select(*keys, "side", "split", "id", "component", "point", "earlier").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(table)]
            ids, component, side, split = (table.column(c).to_numpy() for c in ("id", "component", "side", "split"))
            points = unpacked(table.column("point").to_pylist())
            lists = table.column("earlier").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            found, rest = [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                *part, whole = task_pairs(ids[i:j], component[i:j], side[i:j], points[i:j], [flat[ends[k] : ends[k + 1]] for k in range(i, j)], most)
                found.append(part)
                if split[i] or not whole:
                    rest.append(int(key[0, i]))
            a, b, best = (np.concatenate(x) for x in zip(*found, strict=True))
            none = [None] * len(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(a, pa.int64()), pa.array(none, pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.array(none, pa.int64())]),
                    pa.concat_arrays([pa.array(best, pa.bool_()), pa.array(none, pa.bool_())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(rest, pa.int64())]),
                ],
                names=["a", "b", "best", "rest"],
            )

        held: list[pa.RecordBatch] = []  # the last task's rows so far, of three tiles at most
        for batch in thrifty(batches):
            if not len(batch):
                continue
            last = [batch.column(c)[len(batch) - 1].as_py() for c in keys]
            same = np.all([batch.column(c).to_numpy() == v for c, v in zip(keys, last, strict=True)], axis=0)
            if held and [held[0].column(c)[0].as_py() for c in keys] == last:
                held.append(batch)
                continue
            start = int(np.argmax(same))
            if held or start:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, start)]))
            held = [batch.slice(start)]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a bigint, b bigint, best boolean, rest bigint")


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are of different components."""
    side = lambda n: found.select(F.col("node").alias(n), F.col("component_id").alias(f"c{n}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def grouped(documents: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, group) of every row; rows of one group are linked. Rows without words have a null group."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = rarity_ranks(documents)
    whole = stage(document_sets(documents, ranks).withColumn("rid", F.monotonically_increasing_id()), "sets")
    told = whole.select("doc_id", "row", "n_shingles", "f1", "f2", "rid")
    names = told.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("rid").alias("id"))
    told = stage(told.join(names, ["f1", "f2"], "left"), "told")

    # one row of each set; only rows that may be repeats are shuffled to be left out
    again = stage(told.where("rid <> id").select("rid"), "again")
    touched = in_bitmap(F.col("rid"), bitmap(again, "rid"))
    some = whole.where("n_shingles > 0")
    nodes = some.where(~touched).unionByName(some.where(touched).join(again, "rid", "left_anti"))
    nodes = stage(nodes.withColumnRenamed("rid", "id").select("id", "row", "f1", "f2", "prefix", "point"), "nodes")
    discard(whole, again)

    blocks = shared_blocks(nodes)
    lists = blocks.groupBy("id").agg(F.sort_array(F.collect_list("shingle")).alias("shingles"))
    members = stage(lists.join(nodes.select("id", "point"), "id"), "members")
    slim = stage(nodes.select("id", "row", "f1", "f2"), "slim")
    discard(nodes)

    def check(pairs: DataFrame) -> DataFrame:
        texts = stage(_texts(documents, slim, pairs, ranks), "texts")
        new = stage(verified(pairs, texts, ranks), "links")
        discard(texts)
        return new

    first = stage(block_pairs(blocks.withColumn("component", F.col("id")), members, NEAREST), "pairs")
    found_pairs = first.where("a is not null")
    links = check(found_pairs.where("best").select("a", "b").distinct())
    more = stage(across(found_pairs.where("not best").select("a", "b").distinct(), components(links)), "pairs")
    links = links.unionByName(check(more))
    tried = found_pairs.select("a", "b")
    for most in (NEAREST, None):
        rest = first.where("rest is not null").select(F.col("rest").alias("shingle")).distinct()
        left = stage(open_blocks(blocks.join(rest, "shingle"), components(links)), "open")
        if left.isEmpty():
            break
        again = block_pairs(left, members, most).where("a is not null").select("a", "b").distinct()
        pairs = stage(again.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(check(pairs))
        tried = tried.unionByName(pairs)
    found = components(links)
    discard(members, blocks)
    linked = told.join(found.withColumnRenamed("node", "id"), "id", "left")
    return stage(linked.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "id").alias("group")), "groups")


def link_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; kept marks the row of the component's smallest id."""
    told = grouped(documents)
    least = told.where("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = told.join(least, "group", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns: the smallest id's (nulls last, then by a hash of the row).

    Rows of one id and text are one document, whichever of them stays; rows without words all stay otherwise. Null ids and texts, empty
    tables and very long texts are as in link_documents.
    """
    told = grouped(documents)
    order = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "row")
    best = told.where("n_shingles > 0").groupBy("group").agg(F.min(order).alias("best")).select("group", "best.row")
    gone = told.where("n_shingles > 0").join(best, ["group", "row"], "left_anti").select("row").distinct().withColumn("gone", F.lit(True))
    again = told.groupBy("row").count().where("count > 1").select("row", F.lit(False).alias("gone"))
    marked = stage(gone.unionByName(again).groupBy("row").agg(F.max("gone").alias("_gone")).withColumnRenamed("row", "_row"), "dropped")
    touched = in_bitmap(F.col("_key"), bitmap(marked, "_row"))
    # the caller's columns travel in one struct, so no name of theirs can clash with ours
    own = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_own")
    keyed = documents.select(own, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("_key"))
    some = keyed.where(touched).join(marked, F.col("_key") == F.col("_row"), "left").where(~F.coalesce("_gone", F.lit(False)))
    once = some.where("_gone is null").unionByName(some.where("_gone is not null").dropDuplicates(["_key"]))
    return keyed.where(~touched).select("_own.*").unionByName(once.select("_own.*"))
