"""Token-id files: fixed-width bit packing in blocks, with offsets.

A file set is a folder of Parquet files of blocks (so that any store that Spark
can write serves). A block holds whole documents in ascending order of doc_id:

    part, block   place in the order of all blocks
    width         bits of an id: the fewest that hold the vocabulary
    payload       ids, id k in bits [k * width, (k + 1) * width), little-endian
    doc_ids       documents of the block
    ends          where each ends, in ids from the block's start

so id j of document d sits at a bit offset that two small arrays give, and a
block unpacks by one numpy expression. Blocks end with the first document that
brings them to `block_ids` ids; a longer document has a block of its own.

Null texts count as empty (the end id alone). Rows of one doc_id lie next to
each other, ordered by text. Rows without doc_id come first. An empty table
gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_path, settled, slices
from .tokens import AT_ONCE, END, encoder

BLOCK_IDS = 1 << 18
FILE_SCHEMA = "part int, block int, width int, payload binary, doc_ids array<bigint>, ends array<bigint>"


def bits_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 2) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, end: int) -> np.ndarray:
    """ids start to end of a block; reads only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}")[start:end].astype(np.uint32)
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8)[first : -(-end * width // 8)]
    bits = np.unpackbits(raw, bitorder="little")[start * width - first * 8 :][: (end - start) * width]
    return (bits.reshape(-1, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, block_ids: int = BLOCK_IDS) -> None:
    """Encodes doc_id, text into a file set at path."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = bits_for(max(coder.vocabulary, (end or 0) + 1))
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        held: list[bytes] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, ids, size, block
            out = {
                "part": [part], "block": [block], "width": [width], "payload": [pack(np.frombuffer(b"".join(held), "<u4"), width)],
                "doc_ids": [ids], "ends": [np.cumsum([len(x) // 4 for x in held])],
            }
            kinds = {"part": pa.int32(), "block": pa.int32(), "width": pa.int32(), "payload": pa.binary(), "doc_ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
            held, ids, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

        for batch in batches:
            for some in slices(batch, most=AT_ONCE):
                for doc_id, x in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text")), strict=True):
                    held.append(x + tail)
                    ids.append(doc_id)
                    size += len(x) // 4 + 1
                    if size >= block_ids:
                        yield flush()
        if held:
            yield flush()
        settled()

    (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole set), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = unpack(row["payload"], row["width"], 0, int(ends[-1]))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(ends), pa.int32()), "block": pa.array([row["block"]] * len(ends), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "local": starts, "n_tokens": ends - starts, "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                })

    # ids in each block: a few numbers for each; prefix sums by part, then within it
    sizes = files.select("part", "block", F.element_at("ends", -1).alias("n"))
    from pyspark.sql import Window

    parts = sizes.groupBy("part").agg(F.sum("n").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    at = sizes.join(parts, "part").select("part", "block", (F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("base"))
    rows = files.mapInArrow(decode, "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """ids of the documents of one doc_id, from the blocks that hold it alone."""
    out = []
    for row in spark.read.schema(FILE_SCHEMA).parquet(path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).toLocalIterator():
        ends = [0, *row["ends"]]
        out += [unpack(row["payload"], row["width"], ends[k], ends[k + 1]).tolist() for k, x in enumerate(row["doc_ids"]) if x == doc_id]
    return out


def token_files(docs: DataFrame, tokenizer: str, end: int | None = END) -> DataFrame:
    """Writes the file set into the shared folder and reads it back."""
    write_token_files(docs, path := scratch_path(docs.sparkSession, "ids"), tokenizer, end)
    return read_token_files(docs.sparkSession, path)
