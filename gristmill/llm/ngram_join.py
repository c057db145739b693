"""Jaccard join on word shingles with count-vector R-trees.

Shingles of a document are hashed into groups; the counts of its groups are a
point. The overlap of two documents can't exceed the sum of the lesser counts,
group by group, nor that of two boxes of points the sum over their upper
corners. An R-tree of points with dual-tree descent thus finds every pair whose
bound reaches what the threshold asks for, and what survives is verified on
shingles. There are about as many groups as shingles (a power of two), so the
bound is as close for long documents as for short ones; documents of one power
meet those of the next one with adjacent groups added up.

Points of unlike documents of one size lie about as near as the threshold
reaches, so one tree over a corpus would visit most pairs of leaves. Trees are
therefore built in blocks. Documents that link share a shingle among the first
quarter (and one) of each other's, in any fixed order of shingles; a block
holds the documents with a shingle that early. The order is rarest first by a
count of fixed size over all documents, so what many share comes last. Blocks
with the same documents are one block. No block is capped: a large one is dealt
in pieces, and every two pieces meet in a task of their own.

The pairs that the trees of a block leave over are reported as the groups that
they connect, so a block of k documents sends fewer than k rows however many
pairs it has. Groups of all blocks merge into candidate groups, and each of
these is verified: exact intersections of all its pairs, each pair in one
task. Members of a large group are told by their differences from a reference
set, and dealt in chunks; two chunks meet in one task. Links leave
such a task as counts by document and, again, as what they connect. Hence work
in a group of near copies grows with the square of its different texts, as its
links do, but no table ever has a row for each pair.

Equal sets are one node from the start. A text without words has no shingles
and links with nothing; one of fewer than five words has its whole sequence as
its only shingle. Null texts have no words. Rows of equal sets share a
component whatever their doc_id; rows of one doc_id stay rows; rows without
doc_id have the component of their set (null if only such rows have it). An
empty table gives no rows. Sets are told apart by 64-bit hashes. Columns other
than doc_id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACED, Words, discard, freed, grams, member, mixed, perhaps_in, settled, slices, stored, unused

#: Words of a shingle, and the least number of groups.
SHINGLE, GROUPS = 5, 64
#: Links: 100 * intersection >= 75 * union. With sizes a and b: intersection >= 3/7 (a + b).
PERCENT = 75
#: Counters of the order of shingles: one number for any corpus.
COUNTERS = 1 << 21
#: Members of a piece of a block. Members and shingles of a chunk of a candidate group. Bytes of points, and shingles, that one call of Python works on.
PIECE, CHUNK, CHUNK_SHINGLES = 1024, 1024, 1 << 19
#: Members of a large group that its reference is taken from. Rows of candidates up to which they are broadcast.
SAMPLED, BROADCAST_ROWS = 16, 1 << 17
BIN_BYTES, BIN_SHINGLES = 1 << 22, 1 << 20
#: Postings of a class of shingles that go to one task.
HOT = 1 << 20


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows in a row, each row's in ascending order, and n + 1 offsets."""
    words = Words(column, SPACED)
    full = words.grams(shingle)
    keep = words.room(shingle)
    few = np.flatnonzero((words.count > 0) & (words.count < shingle))
    row = words.row()[keep]
    marks = full[keep]
    if len(few):
        own = np.array([mixed(grams(words.hash[words.first[i] : words.first[i + 1]], int(words.count[i]))[:1])[0] for i in few], np.uint64)
        marks, row = np.concatenate([marks, own]), np.concatenate([row, few])
        order = np.argsort(row, kind="stable")
        marks, row = marks[order], row[order]
    each = np.bincount(row, minlength=len(words.count)) if len(row) else np.zeros(len(words.count), np.int64)
    ends = np.cumsum(each)
    for a, b in zip(ends - each, ends, strict=True):
        marks[a:b].sort()
    new = np.ones(len(marks), bool)
    new[1:] = (marks[1:] != marks[:-1]) | (row[1:] != row[:-1])
    return marks[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(words.count)) if len(row) else each)])


def names(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(marks + np.uint64(0x2545F4914F6CDD1D)))])
    return mixed(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(np.uint64)).view(np.int64)


def unseen(name: np.ndarray, seen: set) -> np.ndarray:
    """Mask of the names that this task meets for the first time: copies count once."""
    out = np.zeros(len(name), bool)
    for k, x in enumerate(name.tolist()):
        if x not in seen:
            seen.add(x)
            out[k] = True
    return out


def group_bits(n: np.ndarray) -> np.ndarray:
    """Of sizes of sets, the power of two that is their number of groups."""
    return np.ceil(np.log2(np.maximum(n, GROUPS))).astype(np.int64)


def nibbles(counts: np.ndarray) -> np.ndarray:
    """Counts of pairs of groups in one byte. 15 stands for that or more: it bounds as no limit."""
    few = np.minimum(counts, 15).astype(np.uint8)
    return few[0::2] << 4 | few[1::2]


def counts_of(points: list[bytes]) -> np.ndarray:
    """Rows of counts from nibbles; 255 where there is no limit."""
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)
    out = np.stack([raw >> 4, raw & 15], 2).reshape(len(points), -1)
    out[out == 15] = 255
    return out


def folded(points: np.ndarray) -> np.ndarray:
    """Points of half as many groups. 255 stays 255 or more."""
    return np.minimum(points.reshape(len(points), -1, 2).sum(2, dtype=np.int32), 255).astype(np.uint8)


def counters(docs: DataFrame, text: str) -> np.ndarray:
    """How often shingles of each of COUNTERS classes occur: the table has one size for any corpus."""
    piece = COUNTERS // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size, seen = np.zeros(COUNTERS, np.int64), [], 0, set()
        for batch in batches:
            for part in slices(batch, text):
                marks, ends = shingle_sets(part.column(text))
                keep = np.repeat(unseen(names(marks, ends), seen) if len(ends) > 1 else [], np.diff(ends))
                held.append((marks[keep.astype(bool)] & np.uint64(COUNTERS - 1)).astype(np.int32))
                size += len(held[-1])
                if size > COUNTERS:
                    n += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            n += np.bincount(np.concatenate(held), minlength=COUNTERS)
        n = np.minimum(n, (1 << 32) - 1).astype("<u4")
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(16), pa.int32()), "n": [zlib.compress(n[k * piece : (k + 1) * piece].tobytes(), 1) for k in range(16)]})
        settled()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(piece, np.int64)
        for batch in batches:
            for x in batch.column("n").to_pylist():
                n += np.frombuffer(zlib.decompress(x), "<u4")
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int32()), "n": [zlib.compress(np.minimum(n, (1 << 32) - 1).astype("<u4").tobytes(), 1)]})

    rows = docs.select(text).mapInArrow(count, "k int, n binary").groupBy("k").applyInArrow(add, "k int, n binary").collect()
    out = np.zeros(COUNTERS, np.uint32)
    for r in rows:
        out[r["k"] * piece : (r["k"] + 1) * piece] = np.frombuffer(zlib.decompress(r["n"]), "<u4")
    return out


def described(docs: DataFrame, text: str, order: np.ndarray) -> DataFrame:
    """doc_id, n, node (hash of the set; null without shingles) of each row; of each node in each task once: point (counts
    of the groups), early (shingles by which it can be found), salt (where some of these are hot: the part of their block that it goes to)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    hot = max(HOT, 8 * int(order.sum(dtype=np.int64)) // COUNTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, text):
                marks, ends = shingle_sets(part.column(text))
                n = np.diff(ends)
                name = names(marks, ends)
                some = np.flatnonzero(unseen(name, seen) & (n > 0))
                own = np.zeros(len(n), bool)
                own[some] = True
                row = np.repeat(np.arange(len(n)), n)
                marks, row = marks[own[row]], np.repeat(np.arange(len(some)), n[some])
                bits = group_bits(n[some])
                corner = np.concatenate([[0], np.cumsum(1 << bits)])
                points = np.bincount(corner[row] + (marks >> (64 - bits[row]).astype(np.uint64)).astype(np.int64), minlength=corner[-1])
                points, corner = nibbles(points), corner // 2
                at = (marks & np.uint64(COUNTERS - 1)).astype(np.int64)
                often = table[at].astype(np.uint64)
                by = np.lexsort((marks, often, row))
                size = n[some]
                early = size - (PERCENT * size + 99) // 100 + 1
                keep = np.arange(len(marks)) - (np.cumsum(size) - size)[row] < early[row]
                marks, often, row = marks[by][keep], often[by][keep].astype(np.int64), row[keep]
                first = np.concatenate([[0], np.cumsum(early)])
                parts = np.where(often > hot, often // HOT, 0)
                salt = np.where(parts > 0, 1 + (mixed(name[some].view(np.uint64)) >> np.uint64(33)).astype(np.int64)[row] % np.maximum(parts, 1), 0)
                made = dict(zip(some.tolist(), range(len(some)), strict=True))
                k = [made.get(i) for i in range(len(n))]
                lists = marks.view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n": n, "node": pa.array(name, pa.int64(), mask=n == 0),
                    "point": pa.array([None if j is None else points[corner[j] : corner[j + 1]].tobytes() for j in k], pa.binary()),
                    "early": pa.array([None if j is None else lists[first[j] : first[j + 1]] for j in k], pa.list_(pa.int64())),
                    "salt": pa.array([None if j is None or not parts[first[j] : first[j + 1]].any() else salt[first[j] : first[j + 1]] for j in k], pa.list_(pa.int64())),
                })
        settled()

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n long, node long, point binary, early array<long>, salt array<long>")


def pieces(postings: DataFrame) -> DataFrame:
    """block, piece, members: blocks of two nodes at least, in pieces, from rows key, part, node. Rows stream by in the order of part and node, so no block is held.

    A block that fits a piece is named by its members, so that equal ones can be told; others by their key.
    """

    def out(block: np.ndarray, piece: np.ndarray, node: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(node))
        return pa.RecordBatch.from_pydict({"block": block, "piece": piece, "members": members})

    def whole(part: np.ndarray, key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of blocks (and salted parts of blocks) that are complete, in order."""
        if not len(part):
            return
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(start, len(part)))
        salted = part[start] != key[start]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(node.view(np.uint64) + np.uint64(0x8CB92BA72F3D8DD7)))])
        name = mixed(sums[start + size] - sums[start] + size.astype(np.uint64)).view(np.int64)
        one = np.flatnonzero((size > 1) & (size <= PIECE) & ~salted)
        one = one[np.unique(name[one], return_index=True)[1]]
        if len(one):
            at = np.repeat(start[one] - (np.cumsum(size[one]) - size[one]), size[one]) + np.arange(size[one].sum())
            yield out(name[one], np.zeros(len(one), np.int64), node[at], np.cumsum(size[one]))
        for k in np.flatnonzero((size > PIECE) | salted).tolist():
            a, b = start[k], start[k] + size[k]
            for at in range(a, b, PIECE):
                yield out(key[a : a + 1], part[a : a + 1] + (at - a) // PIECE, node[at : min(b, at + PIECE)], np.array([min(b, at + PIECE) - at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, given = [np.zeros(0, np.int64)] * 3, 0  # rows of the block that may go on; pieces of it that are out
        for batch in batches:
            part, key, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("part", "key", "node"), strict=True))
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (node[1:] != node[:-1])
            part, key, node = part[new], key[new], node[new]
            if given:  # the end of a block of which pieces are out
                end = int(np.searchsorted(part, part[0], "right"))
                if end < len(part):
                    yield out(key[:1], part[:1] + given, node[:end], np.array([end]))
                    part, key, node, given = part[end:], key[end:], node[end:], 0
            last = int(np.searchsorted(part, part[-1], "left"))
            yield from whole(part[:last], key[:last], node[:last])
            part, key, node = part[last:], key[last:], node[last:]
            while len(part) > 2 * PIECE:
                yield out(key[:1], part[:1] + given, node[:PIECE], np.array([PIECE]))
                part, key, node, given = part[PIECE:], key[PIECE:], node[PIECE:], given + 1
            held = [part, key, node]
        if given:
            yield out(held[1][:1], held[0][:1] + given, held[2], np.array([len(held[2])]))
        else:
            yield from whole(*held)

    dealt = postings.repartition("part").sortWithinPartitions("part", "node")
    found = dealt.select("part", "key", "node").mapInArrow(run, "block long, piece long, members array<long>")
    return found.groupBy("block", "piece").agg(F.first("members").alias("members"))


def enough(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether an overlap reaches the threshold; sizes: of both sets together."""
    return 100 * overlap >= PERCENT * (sizes - overlap)


class Forest:
    """Packed R-trees of points, one for each run of equal `tree` (ascending): level 0 the points, each further one boxes of 16 of one tree, the last one box a tree."""

    def __init__(self, points: np.ndarray, n: np.ndarray, tree: np.ndarray):
        self.levels = [(points, n, n)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while len(tree) and (tree[1:] == tree[:-1]).any():
            start = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            nth = np.arange(len(tree)) - np.repeat(start, np.diff(np.append(start, len(tree))))
            at = np.flatnonzero(nth % 16 == 0)
            upper, low, high = self.levels[-1]
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
            self.children.append((at, np.append(at[1:], len(tree))))
            tree = tree[at]
        self.roots = tree

    def bound(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair of boxes can hold a pair that links: by their sizes and by the sum of lesser upper corners. A count of 255 stands for that or more."""
        upper, low, high = self.levels[level]
        keep = (100 * high[i] >= PERCENT * low[j]) & (100 * high[j] >= PERCENT * low[i])
        at = np.flatnonzero(keep)
        both = np.minimum(upper[i[at]], upper[j[at]])
        keep[at] = enough(both.sum(1, dtype=np.int32), low[i[at]] + low[j[at]]) | (both == 255).any(1)
        return keep

    def pairs(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, in lots, that lie below the pairs of roots i, j (i <= j) and whose bounds hold down to their leaves. The bound of the points is left to the caller."""
        at_once = max(64, (1 << 21) // self.levels[0][0].shape[1])  # a few MB of corners
        for level in range(len(self.levels) - 1, 0, -1):
            ok = np.concatenate([self.bound(level, i[k : k + at_once], j[k : k + at_once]) for k in range(0, len(i), at_once)] or [np.zeros(0, bool)])
            i, j = i[ok], j[ok]
            if level > 1:
                i, j = self._below(level, i, j)
        if len(self.levels) == 1:
            yield i[i < j], j[i < j]
            return
        lot = max(1, at_once // 64)
        for k in range(0, len(i), lot):
            x, y = self._below(1, i[k : k + lot], j[k : k + lot])
            yield x[x < y], y[x < y]

    def _below(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, end = self.children[level - 1]
        wide, high = end[j] - first[j], end[i] - first[i]
        total = wide * high
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        wide = np.repeat(wide, total)
        x, y = np.repeat(first[i], total) + k // wide, np.repeat(first[j], total) + k % wide
        return x[x <= y], y[x <= y]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after joining a and b. label[k] <= k names the set of k."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def tile_groups(tile: np.ndarray, side: np.ndarray, node: np.ndarray, n: np.ndarray, points: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group) of the nodes that pairs of surviving points connect. A tile is a piece (side 0) or two that meet.

    Each side of a tile has a tree for each number of groups; sizes that can link have the same or the next one.
    """
    bits = group_bits(n)
    names_, at = np.unique(node, return_inverse=True)
    label = np.arange(len(names_))
    two = {t for t, s in zip(tile.tolist(), side.tolist(), strict=True) if s}
    for few in np.unique(bits).tolist():
        own = np.flatnonzero((bits == few) | (bits == few + 1))
        rows = np.empty((len(own), 1 << few), np.uint8)
        for b in (few, few + 1):
            some = np.flatnonzero(bits[own] == b)
            if len(some):
                values = counts_of([points[k] for k in own[some].tolist()])
                rows[some] = values if b == few else folded(values)
        order = np.lexsort((rows[:, 1], rows[:, 0], n[own], bits[own], side[own], tile[own]))
        own, rows = own[order], rows[order]
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(tile[own]) != 0) | (np.diff(side[own]) != 0) | (np.diff(bits[own]) != 0)
        first = own[new]
        root = {x: k for k, x in enumerate(zip(tile[first].tolist(), side[first].tolist(), bits[first].tolist(), strict=True))}
        meet = []
        for (t, s, b), k in root.items():
            if b == few:
                others = [(t, 1 - s, few), (t, 1 - s, few + 1)] if t in two else [(t, s, few), (t, s, few + 1)]
                meet += [(k, root[x]) for x in others if x in root and (s == 0 or x[2] > few)]
        if not meet:
            continue
        i, j = np.sort(np.array(meet), 1).T
        forest = Forest(rows, n[own], np.cumsum(new) - 1)
        for x, y in forest.pairs(i, j):
            a, b = at[own[x]], at[own[y]]
            open_ = label[a] != label[b]
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            ok = forest.bound(0, x, y)
            label = merged(label, a[ok], b[ok])
    some = label != np.arange(len(label))
    return names_[some], names_[label[some]]


def searched(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """a, b: nodes that surviving pairs connect. blocks: of pieces(), stored; points: node, n, point.

    Tiles with the same least member go to one call of Python, where a node's point is sent once for all its tiles.
    """
    meets = blocks.join(blocks.select("block", F.col("piece").alias("other")), "block")
    tile = F.xxhash64("block", F.least("piece", "other"), F.greatest("piece", "other"))
    place = F.when(F.col("piece") == 0, F.xxhash64(F.array_min("members"))).otherwise(tile)  # those in several pieces are large enough to stand alone
    dealt = meets.select(tile.alias("tile"), place.alias("place"), (F.col("piece") > F.col("other")).cast("int").alias("side"), F.explode("members").alias("node"))
    size = dealt.select("place", "node").distinct().groupBy("node").agg(F.count("*").alias("k")).join(points.select("node", "n"), "node").agg(F.sum(F.col("k") * (F.col("n") + GROUPS))).first()[0]
    bins = F.lit(max(least_parts(blocks), int(size or 0) // BIN_BYTES))
    dealt = dealt.withColumn("bin", F.pmod("place", bins))
    sent = dealt.select("bin", "node").distinct().join(points, "node").select(F.col("bin").alias("of"), F.col("node").alias("met"), "n", "point")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tile, side, node = (left.column(c).to_numpy() for c in ("tile", "side", "node"))
        there, n = right.column("met").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(there)
        ok, at = member(node, there[order])  # nodes without a doc_id have no point
        at = order[at[ok]]
        point = right.column("point").to_pylist()
        a, b = tile_groups(tile[ok], side[ok], node[ok], n[at], [point[k] for k in at.tolist()])
        settled()
        return pa.table({"a": pa.array(b, pa.int64()), "b": pa.array(a, pa.int64())})

    found = dealt.groupBy("bin").cogroup(sent.groupBy("of")).applyInArrow(run, "a long, b long")
    return found.distinct()


def least_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def representatives(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that are linked to a document of a lesser doc_id. Of rows that repeat doc_id and text one stays (that
    of the least JSON of all columns). Rows without doc_id stay; so do rows of one doc_id with other texts, unless they are linked to a lesser one."""
    rows = joined(docs, text).select("doc_id", (F.col("component_id") < F.col("doc_id")).alias("gone"))
    odd = stored(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).filter("gone or n > 1").select("doc_id", "gone"), "odd")
    kept = perhaps_in(docs, odd, False)
    asked = perhaps_in(docs, odd, True).alias("d").join(odd.alias("o"), F.col("d.doc_id").cast("long") == F.col("o.doc_id"), "left")
    single = asked.filter("o.doc_id is null").select("d.*")
    key, row = unused(docs, "_k", "_r")
    repeated = asked.filter("o.doc_id is not null and not o.gone").select("d.*")
    repeated = repeated.groupBy(F.struct(F.col("doc_id"), F.col(text)).alias(key)).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(row)).select(f"{row}.*")
    return kept.unionByName(single).unionByName(repeated)


def overlaps(marks: np.ndarray, ends: np.ndarray, left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all from `left` on (with each other if left is their number).

    Shingles of few sets are counted pair by pair, those of many by a product of 0/1 matrices, some columns at a time.
    """
    m = len(ends) - 1
    from_, wide = (0, m) if left == m else (left, m - left)
    row = np.repeat(np.arange(m), np.diff(ends))
    order = np.argsort(marks, kind="stable")
    marks, row = marks[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(marks)))
    out = np.zeros((left, wide), np.int32)
    for d in range(2, 9):
        rows = row[start[df == d][:, None] + np.arange(d)]
        for p in range(d):
            for q in range(p + 1, d):
                x, y = rows[:, p], rows[:, q]
                own = (x < left) & (y >= from_)
                x, y = x[own], y[own] - from_
                np.add.at(out, (x, y), 1)
                if left == m:
                    np.add.at(out, (y, x), 1)
    many = start[df > 8], df[df > 8]
    for k in range(0, len(many[0]), 2048):
        first, size = many[0][k : k + 2048], many[1][k : k + 2048]
        has = np.zeros((m, len(first)), np.float32)
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        has[row[at], np.repeat(np.arange(len(first)), size)] = 1
        out += (has[:left] @ has[from_:].T).astype(np.int32)
    return out


def chunks_of(k, total) -> F.Column:
    return F.greatest(F.ceil(k / CHUNK), F.ceil(total / CHUNK_SHINGLES), F.lit(1)).cast("int")


def differences(texts: DataFrame) -> DataFrame:
    """node, copies, side, kept (shingles of its group's reference), lost (of these, those it lacks), diff (lost shingles and those
    it has besides) of texts (node, copies, side, k, chunks, text) of large groups.

    The reference holds what most of some members have (about SAMPLED of them by a hash of the node). Near copies differ from
    it by little, so that groups are verified by their differences; any reference gives the same result, the better one the fewer bytes.
    """
    some = texts.filter(F.pmod(F.xxhash64("node", F.lit("sample")), F.ceil(F.col("k") / SAMPLED)) == 0).select("side", "node", "text")

    def refer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {}
        for batch in batches:
            for part in slices(batch):
                marks, ends = shingle_sets(part.column("text"))
                sets |= {node: marks[ends[k] : ends[k + 1]].copy() for k, node in enumerate(part.column("node").to_pylist())}
        values, n = np.unique(np.concatenate([*sets.values()]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"side": pa.array([key[0].as_py()], pa.int64()), "reference": [values[2 * n > len(sets)].tobytes()]})

    reference = some.groupBy("side").applyInArrow(refer, "side long, reference binary")
    texts = texts.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
    owned = texts.select("side", "own").distinct().join(reference, "side").toDF("of", "part", "reference")

    def differ(left: pa.Table, right: pa.Table) -> pa.Table:
        ref = np.frombuffer(right.column("reference")[0].as_py(), np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        out = []
        for batch in left.to_batches():
            for part in slices(batch):
                marks, ends = shingle_sets(part.column("text"))
                same = names(marks, ends) == part.column("node").to_numpy()  # else a row of that doc_id with another text
                for k in np.flatnonzero(same).tolist():
                    own = marks[ends[k] : ends[k + 1]]
                    lost, more = ref[~member(ref, own)[0]], own[~member(own, ref)[0]]
                    out.append((*(part.column(c)[k].as_py() for c in ("node", "copies", "side")), len(ref), len(lost), np.concatenate([lost, more]).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        cols = zip(*out, strict=True) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "copies", "side", "kept", "lost", "diff"])

    made = texts.groupBy("side", "own").cogroup(owned.groupBy("of", "part")).applyInArrow(differ, "node long, copies long, side long, kept long, lost long, diff binary")
    return made.dropDuplicates(["node"])


def verified(groups: DataFrame, docs: DataFrame, text: str, about: DataFrame) -> tuple[DataFrame, bool]:
    """node, others (rows that it links with, its copies aside), least (the least node that it is connected to) of every task
    that a node is in, and whether some group has several tasks.

    groups: node, side (the candidate group). about: node, doc_id, n, copies. A text goes once to the one task of a small
    group; in a large group its difference from the group's reference goes once to each task.
    """
    wanted = groups.join(about, "node")
    sizes = wanted.groupBy("side").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
    wanted = stored(wanted.join(sizes, "side").select("node", "doc_id", "copies", "n", "side", "k", chunks_of(F.col("k"), F.col("all")).alias("chunks")), "wanted")
    total = wanted.agg(F.count("*").alias("k"), F.sum(F.when(F.col("chunks") == 1, F.col("n"))).alias("s"), F.max("chunks").alias("c")).first()
    some = perhaps_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), wanted, True)
    met = some.join(F.broadcast(wanted) if total["k"] <= BROADCAST_ROWS else wanted, "doc_id")
    none = [F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("lost"), F.lit(None).cast("binary").alias("diff")]
    tiles = met.filter("chunks = 1").select("node", "copies", F.xxhash64("side").alias("tile"), F.lit(0).alias("part"), F.lit(True).alias("alone"), "text", *none)
    size, deep = total["s"] or 0, (total["c"] or 1) > 1
    if deep:
        large = stored(differences(met.filter("chunks > 1")), "differences")
        sizes = large.groupBy("side").agg(F.count("*").alias("k"), F.sum(F.length("diff") / 8).alias("all"))
        dealt = large.join(sizes, "side").withColumn("chunks", chunks_of(F.col("k"), F.col("all"))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
        size += int(dealt.agg(F.sum(F.length("diff") / 8 * F.col("chunks")).alias("s")).first()["s"] or 0)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        x, y = F.least("own", "other"), F.greatest("own", "other")
        dealt = dealt.select("node", "copies", F.xxhash64("side", x, y).alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("part"), (F.col("own") == F.col("other")).alias("alone"), F.lit("").alias("text"), "kept", "lost", "diff")
        tiles = tiles.unionByName(dealt)
    tiles = tiles.withColumn("bin", F.pmod("tile", F.lit(max(least_parts(docs), size // BIN_SHINGLES))))

    def verify(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, dict] = {}  # sides of each tile: node -> copies, shingles or differences, size, shingles of the reference that it has
        for batch in batches:
            for part in slices(batch):
                marks, ends = shingle_sets(part.column("text"))
                name = names(marks, ends)
                for k, (node, copies, tile, side, alone, kept, lost, diff) in enumerate(zip(*(part.column(c).to_pylist() for c in ("node", "copies", "tile", "part", "alone", "kept", "lost", "diff")), strict=True)):
                    if diff is None and name[k] != node:  # a row of that doc_id with another text
                        continue
                    own = marks[ends[k] : ends[k + 1]].copy() if diff is None else np.frombuffer(diff, np.uint64)
                    tiles.setdefault(tile, {"alone": alone, "kept": kept, 0: {}, 1: {}})[side][node] = copies, own, kept - lost + len(own) - lost, lost
        for tile in tiles.values():
            left = len(tile[0])
            ids = np.array([*tile[0], *tile[1]], np.int64)
            copies, sets, n, lost = zip(*tile[0].values(), *tile[1].values(), strict=True)
            copies, n, lost, m = np.array(copies, np.int64), np.array(n), np.array(lost), len(ids)
            if not tile["alone"] and left in (0, m):
                continue
            from_ = 0 if tile["alone"] else left
            both = overlaps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), m - from_ if not from_ else left)
            both = both + tile["kept"] - lost[: len(both), None] - lost[from_:]  # shingles of the reference that neither lacks, and others that both have
            link = np.zeros((m, m), bool)
            link[: len(both), from_:] = enough(both, n[: len(both), None] + n[from_:])
            np.fill_diagonal(link, False)
            link |= link.T
            order = np.argsort(ids)
            rank = np.argsort(order)
            a, b = np.nonzero(np.triu(link))
            label = merged(np.arange(m), rank[a], rank[b])
            yield pa.RecordBatch.from_pydict({"node": ids, "others": link @ copies, "least": ids[order][label[rank]]})
        settled()

    out = stored(tiles.groupBy("bin").applyInArrow(verify, "node long, others long, least long"), "verified")
    for x in [wanted, large] if deep else [wanted]:
        discard(x)
    freed(docs.sparkSession)
    return out, deep


def components(links: DataFrame) -> DataFrame:
    """node, side: the least node of the component of every node with a link. Alternating large and small stars (Kiveris et al. 2014)."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        new = stored(small, "edges")
        total = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
        done = edges.agg(total.alias("t")).first() == new.agg(total.alias("t")).first()
        discard(edges)
        edges = new
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("side"))


def named(stars: DataFrame) -> DataFrame:
    """stars (node, side of all nodes but the least ones) with the least nodes themselves."""
    return stars.unionByName(stars.select(F.col("side").alias("node"), "side").distinct())


def joined(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs.

    component_id is the least doc_id that links reach; n_links counts the other rows that a row
    links with, copies included. A set that only rows without doc_id have links with nothing.
    """
    spark = docs.sparkSession
    whole = stored(described(docs, text, counters(docs, text)), "described")
    rows = stored(whole.select("doc_id", "n", "node"), "rows")
    about = stored(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies")).filter("doc_id is not null"), "about")
    found = whole.filter("early is not null").select("node", "salt", F.posexplode("early").alias("pos", "key"))
    salt = F.coalesce(F.get("salt", F.col("pos")), F.lit(0))
    blocks = stored(pieces(found.select("key", F.when(salt > 0, F.xxhash64("key", salt)).otherwise(F.col("key")).alias("part"), "node")), "blocks")
    freed(spark)
    points = whole.filter("point is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point")).join(about.select("node"), "node")
    edges = stored(searched(blocks, points), "edges")
    discard(whole)
    discard(blocks)
    freed(spark)
    out, deep = verified(named(components(edges)), docs, text, about)
    discard(edges)
    sides = named(components(out.select(F.col("node").alias("a"), F.col("least").alias("b")))) if deep else out.select("node", F.col("least").alias("side"))
    names_ = about.select("node", "doc_id", "copies").join(sides, "node", "left").select("node", "doc_id", "copies", F.coalesce("side", "node").alias("side"))
    least = names_.groupBy("side").agg(F.min("doc_id").alias("component_id"))
    others = out.groupBy("node").agg(F.sum("others").alias("others"))
    ends = names_.join(least, "side").join(others, "node", "left").select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "n", "node").join(ends, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
