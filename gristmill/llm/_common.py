"""Pieces that several operators of this subpackage share.

Everything that runs on executors works on Arrow batches and numpy arrays and
holds one slice of a batch at a time, so memory is bounded by the slice size
(or by one document, where a document is longer than a slice).
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into numpy arrays at a time.
SLICE_BYTES = 1 << 20


# --- shared folder -----------------------------------------------------------


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; in a local session
    without one (tests), a temporary folder that goes at exit. On a cluster it has to be set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_gristmill_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + (local := tempfile.mkdtemp(prefix="gristmill-"))
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext._gristmill_scratch = base
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/gristmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there,
    and losing an executor loses nothing of it."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._gristmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._gristmill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers live on between tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names, alike to those given, that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def freed(spark: SparkSession) -> None:
    """Lets go of shuffle files of finished jobs now, not when the driver's JVM happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of the filter of perhaps_in: one size for any corpus.
FILTER_BITS = 1 << 23


def perhaps_in(docs: DataFrame, ids: DataFrame, within: bool, on: str = "doc_id") -> DataFrame:
    """Rows of docs whose `on` may be in ids (all that are, few others), or the rest. A bit table of one size for any corpus, so it is broadcast."""
    word, of, bits_ = unused(docs, "_w", "_b", "_bits")
    value = F.col(on).cast("long") if on == "doc_id" else F.col(on)
    slot = F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    bits = ids.select(F.floor(slot / 64).alias(word), one.alias(of)).groupBy(word).agg(F.bit_or(of).alias(bits_))
    hit = F.coalesce(F.col(bits_).bitwiseAND(one) != 0, F.lit(False))
    return docs.withColumn(word, F.floor(slot / 64)).join(F.broadcast(bits), word, "left").filter(hit if within else ~hit).select(*docs.columns)


# --- Arrow -------------------------------------------------------------------


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", most: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives fn slices of about `most` bytes of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
        settled()

    return run


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    _, off = text_bytes(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and n + 1 offsets into them. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


# --- words and their hashes ---------------------------------------------------

#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space (x20, x09-x0D) ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, letters and all that isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


_place = np.zeros(0, np.uint64)


def place_keys(n: int) -> np.ndarray:
    """A random odd 64-bit factor for each place in a word. Unlike powers of one base they collide on no patterned words."""
    global _place
    if len(_place) < n:
        _place = mixed(np.arange(1, (1 << max(10, (n - 1).bit_length())) + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _place


class Words:
    """Words of a column of texts: byte ranges and 64-bit hashes, with the range of words of each row."""

    def __init__(self, column: pa.Array, letters: np.ndarray):
        self.data, self.off = text_bytes(column)
        n, is_word = len(self.data), letters[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = is_word[:-1], is_word[1:]
            before[self.off[:-1][self.off[:-1] < n]] = False
            after[self.off[1:][self.off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        size = self.end - self.start
        ends = np.cumsum(size)
        letters_, place = np.flatnonzero(is_word), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        sums = np.zeros(len(letters_) + 1, np.uint64)
        np.cumsum((LOWER[self.data[letters_]].astype(np.uint64) + np.uint64(1)) * place_keys(int(size.max()) if len(size) else 1)[place], out=sums[1:])
        self.hash = mixed(sums[ends] - sums[ends - size] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, self.off)  # words of row i: first[i] to first[i + 1]
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        """Of each word, its row."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on. Those that reach beyond their row aren't to be used."""
        return grams(self.hash, k)

    def room(self, k: int) -> np.ndarray:
        """Of each word, whether k words from it on are in its row."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start)) >= k


def grams(words: np.ndarray, k: int) -> np.ndarray:
    n, out = len(words), np.zeros(len(words), np.uint64)
    for j in range(min(k, n)):
        out[: n - j] += words[j:] * np.uint64(pow(0xA0761D6478BD642F, j + 1, 1 << 64))
    return mixed(out + np.uint64(k))


def member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted array, and where."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values, at


def add_columns(docs: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the columns `added` (a schema string), which fn makes from slices of docs.

    Columns of docs with the same names, in either case, are replaced. keep: the columns of docs
    that go into the result (default all).
    """
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(added)
    kinds = [pa_type(f.dataType) for f in new]
    gone = {n.lower() for n in new.names}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in gone]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(part)
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(made[n], k) for n, k in zip(new.names, kinds, strict=True))], names=[*kept, *new.names])

    source = docs.select(*dict.fromkeys([*kept, text]))
    return source.mapInArrow(per_slice(run, text), T.StructType([docs.schema[c] for c in kept] + list(new)))


def where(docs: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs for which fn, given slices of docs, is true. No column is added, so none can clash."""
    return docs.mapInArrow(per_slice(lambda part: part.filter(pa.array(np.asarray(fn(part), bool))), text), docs.schema)


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
