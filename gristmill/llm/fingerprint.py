"""Document fingerprints from improbable features.

Byte windows start at every word, at the start of a text and so that one ends
with it; where the next start is more than a window away (long words, texts
without spaces, runs of white space) at every byte between. So every byte of a
text that holds a window is in one. The entropy of a window (of its 64 bytes'
32 classes) is rare or common by how often its level occurs over the whole
corpus; of every few neighbouring windows the one of the rarest level is a
feature (its hash decides ties). Features go in text order into Bloom filters
of 2,048 bits with five hashes each; a full filter is followed by the next, and
the chain is the fingerprint. Two fingerprints are as alike as their filters'
common bits, less what chance gives, are of the bits that could be common:
each filter of the shorter chain counts its best match, weighed by its bits.

Null and empty texts have the fingerprint '' and are like each other (1.0) and
like nothing else (0.0). Texts of under 256 bytes have all their windows of 8 bytes
as features besides; a text without any window is one feature. Equal texts
have equal fingerprints under one table of levels.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SPACED, Words, _power, mixed, slices, texts

WINDOW, NEIGHBOURS = 32, 4
#: Texts of fewer bytes also have every window of so many bytes as a feature.
SHORT, SMALL = 256, 8
BITS, HASHES, FULL = 2048, 5, 128
LEVELS = 256
_SUM = np.zeros(256, np.float32)
_SUM[1:] = np.arange(1, 256) * np.log2(np.arange(1, 256))


class Windows:
    """Windows of a column of texts: where they start, their entropy levels and hashes, by row."""

    def __init__(self, column: pa.Array):
        words = Words(column, SPACED)
        data, n = words.data, len(words.data)
        ends = np.repeat(words.off[1:], words.count)
        whole = words.start + WINDOW <= ends
        roomy = np.flatnonzero(np.diff(words.off) >= WINDOW)
        start = np.concatenate([words.start[whole], words.off[roomy], words.off[roomy + 1] - WINDOW])
        start, at = np.unique(start, return_index=True)
        row = np.concatenate([words.row()[whole], roomy, roomy])[at]
        gap = np.ones(len(start), np.int64)  # starts from each one on: one, or all bytes to the next of its row
        gap[:-1][row[1:] == row[:-1]] = np.diff(start)[row[1:] == row[:-1]]
        gap[gap <= WINDOW] = 1
        start = np.repeat(start, gap) + np.arange(gap.sum()) - np.repeat(np.cumsum(gap) - gap, gap)
        self.start, self.count = start, np.bincount(np.repeat(row, gap), minlength=len(words.count))
        # counts of 32 classes of bytes, eight to a 64-bit sum: differences of sums are counts in a window
        kind = LOWER[data] & 31
        total = np.zeros(len(start), np.float32)
        for group in range(4):
            one = np.zeros(256, np.uint64)
            for k in range(8):
                one[group * 8 + k] = np.uint64(1) << np.uint64(8 * k)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(one[kind], out=sums[1:])
            inside = sums[start + WINDOW] - sums[start]
            total += _SUM[inside.view(np.uint8).reshape(-1, 8)].sum(1)
        entropy = np.log2(WINDOW) - total / WINDOW
        self.level = np.clip(np.rint(entropy * (LEVELS - 1) / np.log2(WINDOW)), 0, LEVELS - 1).astype(np.int64)
        powers, inverse = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        self.hash = mixed((sums[start + WINDOW] - sums[start]) * inverse[start])
        self.whole = mixed((sums[words.off[1:]] - sums[words.off[:-1]]) * inverse[words.off[:-1]])  # of each text
        self.size = np.diff(words.off)
        some = np.flatnonzero((self.size < SHORT) & (self.size >= SMALL))
        each = self.size[some] - SMALL + 1
        self.small_row = np.repeat(some, each)
        at = words.off[self.small_row] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.small = mixed((sums[at + SMALL] - sums[at]) * inverse[at])


def level_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Rank of every entropy level, the rarest in the corpus first: LEVELS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                n += np.bincount(Windows(part.column(text)).level, minlength=LEVELS)
        yield pa.RecordBatch.from_pydict({"level": pa.array(np.arange(LEVELS), pa.int32()), "n": n})

    rows = docs.select(text).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS, np.int64)
    for r in rows:
        n[r["level"]] = r["n"]
    ranks = np.empty(LEVELS, np.int64)
    ranks[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return ranks


def chains(column: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text: an array of bits for each, one row a filter."""
    w = Windows(column)
    n, row = len(w.hash), np.repeat(np.arange(len(w.count)), w.count)
    key = (ranks[w.level].astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16))
    first = np.concatenate([[0], np.cumsum(w.count)])
    least = key.copy()
    span = np.minimum(NEIGHBOURS, w.count)[row]  # of rows with fewer windows: all of them
    room = np.repeat(first[1:], w.count) - np.arange(n)
    for j in range(1, min(NEIGHBOURS, n)):
        near = (room[: n - j] > j) & (span[: n - j] > j)
        least[: n - j][near] = np.minimum(least[: n - j][near], key[j:][near])
    ok = room >= span
    chosen = np.zeros(n, bool)
    for j in range(min(NEIGHBOURS, n)):
        chosen[j:] |= ok[: n - j] & (room[: n - j] > j) & (key[j:] == least[: n - j])
    features, row = w.hash[chosen], row[chosen]
    lone = np.flatnonzero((w.count == 0) & (w.size > 0) & ((w.size < SMALL) | (w.size >= SHORT)))
    features, row = np.concatenate([features, w.small, w.whole[lone]]), np.concatenate([row, w.small_row, lone])
    order = np.argsort(row, kind="stable")
    features, row = features[order], row[order]
    each = np.bincount(row, minlength=len(w.count))
    filters = -(-each // FULL)
    base = np.concatenate([[0], np.cumsum(filters)])
    nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(each)])[row]
    bits = np.zeros((int(base[-1]), BITS), bool)
    for k in range(HASHES):
        bits[base[row] + nth // FULL, (features >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(base, base[1:], strict=False)]


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    in_a, in_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    for k in range(len(a)):
        both = np.bitwise_count(a[k] & b).sum(1, dtype=np.int64)
        chance = in_a[k] * in_b / BITS
        room = np.minimum(in_a[k], in_b) - chance
        best[k] = np.clip((both - chance) / np.maximum(room, 1e-9), 0, 1).max()
    score = float((best * in_a).sum() / in_a.sum())
    return 1.0 if len(a) == len(b) and (a == b).all() else min(score, 1.0)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the column fingerprint."""
    from ._common import add_columns

    return add_columns(docs, lambda part: {"fingerprint": [encoded(x) for x in chains(part.column(text), ranks)]}, "fingerprint string", text, keep)


def in_turn(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part, extra: dealt by doc_id ranges, so that in the order (part, extra, doc_id
    descending, text) each row with extra 0 is followed by its next document. The first row of
    each range is there twice: as extra 1 it ends the range before, and the last range goes on
    with the first. Rows without doc_id come last."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = sorted({int(x) for x in cuts})
    part = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col("doc_id"))) if cuts else F.lit(0)
    dealt = docs.withColumn("part", part)
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top")).orderBy(F.desc("part")).collect()  # at most `parts` rows
    if not tops:
        return dealt.withColumn("extra", F.lit(0))
    before = {r["part"]: tops[k - 1]["part"] for k, r in enumerate(tops)}
    heads = docs.sparkSession.createDataFrame([(r["part"], r["top"], before[r["part"]]) for r in tops], "part int, doc_id long, to int")
    heads = dealt.join(F.broadcast(heads), ["part", "doc_id"]).groupBy("doc_id", "to").agg(F.min("text").alias("text"))
    return dealt.withColumn("extra", F.lit(0)).unionByName(heads.select("doc_id", "text", F.col("to").alias("part"), F.lit(1).alias("extra")))


def compared_with_next(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Fingerprints of every text, of its edit by the next document, and how alike they are.

    The edit replaces the last third (rounded down) of the code points by the
    first as many of the next document in descending doc_id, or all it has; the
    first document follows the last. Rows of one doc_id follow by text.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: part, doc_id, text, chain
        for batch in batches:
            for some in slices(batch):
                rows = list(zip(some.column("part").to_pylist(), some.column("extra").to_pylist(), some.column("doc_id").to_pylist(), texts(some.column("text")), chains(some.column("text"), ranks), strict=True))
                pairs = []
                for part, extra, doc_id, text, chain in rows:
                    if held is not None and held[0] == part:
                        pairs.append((held[1], held[2], held[3], text, chain))
                    held = None if extra else (part, doc_id, text, chain)
                if not pairs:
                    continue
                edited = [x[: len(x) - len(x) // 3] + y[: len(x) // 3] for _, x, _, y, _ in pairs]
                new = chains(pa.array(edited, pa.string()), ranks)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if p[0] == -(1 << 63) else p[0] for p in pairs], pa.int64()), "n_chars": pa.array([len(p[1]) for p in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited], "fingerprint": [encoded(p[2]) for p in pairs], "edited_fingerprint": [encoded(x) for x in new],
                    "near_edited": [likeness(p[2], x) for p, x in zip(pairs, new, strict=True)], "near_next": [likeness(p[2], p[4]) for p in pairs],
                })

    return in_turn(docs, parts).repartition("part").sortWithinPartitions("part", "extra", F.desc("doc_id"), "text").mapInArrow(run, schema)
