"""Best-fit packing into sequences of a fixed capacity, bulk-synchronously.

Pieces and gaps (what is left in open sequences) are kept in sorted order.
Since lengths are whole numbers up to the capacity, that order is a run-length
code: pieces of one length are alike, and so are gaps of one size and history.
A sweep takes the longest unplaced pieces, finds the successor gap (the
smallest that holds them) and matches run to run; where more pieces want a gap
size than there are gaps, rank within the run decides who gets one, and the
rest go to the next sweep. Then gaps shrink and sweeps repeat until no piece
is left. The runs number a few times the capacity at most, whatever the
corpus, so the sweeps cost nothing; what grows with the corpus is distributed:
encoding, counting by length, ranking pieces within their length and giving
each piece the sequence and offset of its rank.

The result is exactly that of best-fit decreasing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import settled, slices, stored
from .tokens import AT_ONCE, END, encoder, ids_of

#: Bytes of text that are encoded at a time: half as many as elsewhere, since packing comes last in pipelines, when executors are full.
SLICE = AT_ONCE // 2

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of counts[length] pieces. Rows (length, first rank, end rank, per sequence, first sequence, offset)."""
    gaps: list[tuple[int, int]] = []  # size, index of run: sorted
    runs: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # sequences; (length, per sequence, first rank, offset)

    def put(size: int, n: int, held: list[tuple[int, int, int, int]]) -> None:
        runs.append((n, held))
        insort(gaps, (size, len(runs) - 1))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, (length, -1))
            if at == len(gaps):  # no gap holds it: open sequences and fill each with as many as fit
                each = capacity // length
                if left >= each:
                    size, n, held = capacity, left // each, []
                else:
                    size, n, held, each = capacity, 1, [], left
            else:  # a gap may hold several: the first takes it, and what remains is then the best fit for the next
                size, run = gaps.pop(at)
                n, held = runs[run]
                each = min(size // length, left)
                if left < n * each:
                    take = max(1, left // each)
                    put(size, n - take, [(m, q, first + take * q, off) for m, q, first, off in held])
                    n = take
            used = n * each
            put(size - each * length, n, [*held, (length, each, rank, capacity - size)])
            left, rank = left - used, rank + used
    out, seq = [], 0
    for _, run in gaps:  # those still listed: the others were split or filled on
        n, held = runs[run]
        out += [(m, first, first + n * q, q, seq, off) for m, q, first, off in held]
        seq += n
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int | None = END) -> DataFrame:
    """Encodes and cuts. A document of up to `capacity` ids is one piece; of a longer one
    all pieces but the first are full. pid, nth: the task and the rank among its pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pid, met = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, most=SLICE):
                rows = []
                for doc_id, data in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text")), strict=True):
                    data += tail
                    n = len(ids_of(data))
                    bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]), pid, int(met[b - a])))
                        met[b - a] += 1
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])
        settled()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int | None = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of doc_id, text.

    Null texts are empty: with an end id they still are a piece of one id; without one, a document
    of no ids has no piece. Repeated rows and ties are pieces of their own; equal lengths are
    interchangeable. An empty table gives no rows.
    """
    cut = stored(pieces(docs, tokenizer, capacity, end), "pieces")
    tally = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    within = Window.partitionBy("length").orderBy("pid")
    tally = stored(tally.select("length", "pid", "n", (F.sum("n").over(within) - F.col("n")).alias("before")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = np.array(sweeps(counts, capacity) or np.zeros((0, 6)), np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (np.searchsorted(table[:, 0], np.arange(capacity + 2), side) for side in ("left", "right"))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                row[own] = low[n] + np.searchsorted(table[low[n] : high[n], 1], rank[own], "right") - 1
            _, first, _, each, seq, off = table[row].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq + nth // each), pa.array(off + nth % each * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(tally.select("length", "pid", "before"), ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
