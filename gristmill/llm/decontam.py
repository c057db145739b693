"""Benchmark decontamination by winnowing.

Of every document and every item the k-gram hashes that are least in some
window of w neighbours are kept. With k + w - 1 = 13, two texts that share 13
words in a row keep a common hash at the same place of the shared span, so
looking up a document's kept hashes among the items' finds every such span;
each find is extended word by word to both sides as far as the texts agree.
Items of fewer words are looked up as a whole, one table for each length.

Items of up to INDEX_BYTES of text are read in blocks of a fixed size, whose
indexes are broadcast: a document meets them where it is read and no row is
shuffled. More items meet the documents in a join of their kept hashes; only
documents that share one with an item are shuffled, with the items they met.
The results are the same.

Null texts have no words. Without words a document has no hits and isn't
contaminated. Items without words are never met; items without item_id mark
words, but aren't listed; an item_id met in several rows is listed once.
Repeated documents are judged each; very long texts are judged whole. Empty
tables give no hits, or no rows. Other columns pass through; those named like an
added column are replaced by contamination(), and kept by clean().
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, Words, add_columns, grams, member, perhaps_in, settled, slices, stored, unused, where

WINDOW, GRAM = 13, 8
BLOCK_BYTES, INDEX_BYTES = 16 << 20, 64 << 20
#: Bits of the filter over the items' hashes, of one size for any number of them.
FILTER_BITS = 1 << 26


class ItemIndex:
    """Fingerprints and words of a block of items."""

    def __init__(self, item_ids: list, texts: list[str | None], window: int = WINDOW, gram: int = GRAM):
        words = Words(pa.array(texts, pa.string()), ALNUM)
        self.ids, self.window, self.gram = [None if x is None else str(x) for x in item_ids], window, gram
        self.words, self.first, self.item = words.hash, words.first, words.row()
        chosen = np.flatnonzero(winnowed(words, window, gram))
        marks = words.grams(gram)[chosen]
        order = np.argsort(marks, kind="stable")
        self.marks, self.places = marks[order], chosen[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            own = np.flatnonzero(words.count == n)
            if len(own):
                hashes = grams(words.hash, n)[words.first[own]]
                order = np.argsort(hashes, kind="stable")
                self.short[n] = hashes[order], own[order]


def winnowed(words: Words, window: int, gram: int) -> np.ndarray:
    """Mask of words whose k-gram is kept: the least hash of some w consecutive ones, ties all."""
    marks, width, n = words.grams(gram), window - gram + 1, len(words.hash)
    room = words.room(window)
    least = marks.copy()
    for j in range(1, min(width, n)):
        np.minimum(least[: n - j], marks[j:], out=least[: n - j])
    kept = np.zeros(n, bool)
    for j in range(min(width, n)):
        kept[j:] |= room[: n - j] & (marks[j:] == least[: n - j])
    return kept


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements agree from the start on. Reads little more than these."""
    at, step = 0, 64
    while at < len(x):
        differ = np.flatnonzero(x[at : at + step] != y[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return len(x)


def spans(words: Words, index: ItemIndex) -> list[tuple[int, int, int]]:
    """(first word, end word, item) of the shared spans, words counted over the whole slice."""
    out = []
    kept = np.flatnonzero(winnowed(words, index.window, index.gram))
    marks = words.grams(index.gram)[kept]
    found, low = member(marks, index.marks)
    row = words.row()
    seen: dict[int, int] = {}  # diagonal (document place less item place): where its last span ends
    for p, mark, q0 in zip(kept[found].tolist(), marks[found], low[found].tolist(), strict=True):
        bounds = words.first[row[p]], words.first[row[p] + 1]
        for at in range(q0, int(np.searchsorted(index.marks, mark, "right"))):
            q = int(index.places[at])
            if seen.get(p - q, -1) > p:
                continue
            item = int(index.item[q])
            back = min(p - bounds[0], q - index.first[item])
            ahead = min(bounds[1] - p, index.first[item + 1] - q)
            a = p - agreeing(words.hash[p - back : p][::-1], index.words[q - back : q][::-1])
            b = p + agreeing(words.hash[p : p + ahead], index.words[q : q + ahead])
            seen[p - q] = b
            if b - a >= index.window:
                out.append((a, b, item))
    for n, (hashes, items) in index.short.items():
        marks = words.grams(n)
        found, low = member(marks, hashes)
        for p in np.flatnonzero(found & words.room(n)).tolist():
            for at in range(int(low[p]), int(np.searchsorted(hashes, marks[p], "right"))):
                out.append((p, p + n, int(items[at])))
    return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Indexes of the items, a block of at most about block_bytes of text at a time."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").filter(F.length("text") > 0).toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size >= block_bytes:
            yield ItemIndex(ids, texts)
            ids, texts, size = [], [], 0
    yield ItemIndex(ids, texts)


def met(column: pa.Array, indexes: list[ItemIndex]) -> dict:
    """n_words, n_hit and the ids of the items met, of each text."""
    words = Words(column, ALNUM)
    cover, row = np.zeros(len(words.hash) + 1, np.int64), words.row()
    found: list[set] = [set() for _ in range(len(column))]
    for index in indexes:
        for a, b, item in spans(words, index):
            cover[a] += 1
            cover[b] -= 1
            if index.ids[item] is not None:
                found[row[a]].add(index.ids[item])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return {"n_words": words.count, "n_hit": hit[words.first[1:]] - hit[words.first[:-1]], "hit_items": [sorted(x) for x in found]}


def contaminated(n_words, n_hit):
    """The rule, for numbers, arrays and columns: a twentieth of the words, one at least, is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def small(items: DataFrame, index_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) <= index_bytes


def shared_index(items: DataFrame) -> Callable[[pa.Array], dict]:
    """met() against all items, whose index is sent to every executor."""
    context = items.sparkSession.sparkContext
    shared = [context.broadcast(pickle.dumps(x)) for x in item_blocks(items)]
    return lambda column: met(column, [_loaded(block) for block in shared])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (or its columns `keep`) with n_words, n_hit, hit_items (sorted ids as strings), contaminated.

    Items of up to index_bytes of text are indexed once and the index is broadcast; more of them meet the documents in a join of fingerprints.
    """
    added = "n_words long, n_hit long, hit_items array<string>, contaminated boolean"
    if small(items, index_bytes):
        find = shared_index(items)

        def judge(part: pa.RecordBatch) -> dict:
            out = find(part.column(text))
            return out | {"contaminated": contaminated(out["n_words"], out["n_hit"])}

        return add_columns(docs, judge, added, text, keep)
    names = {"n_words", "n_hit", "hit_items", "contaminated"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    key, = unused(docs, "_key")
    given = docs.withColumn(key, _key(text))
    counted = add_columns(given, lambda part: {"n_words": Words(part.column(text), ALNUM).count}, "n_words long", text, [*kept, key])
    hits = hits_by_join(docs, items, text).select(F.col("key").alias(key), "n_hit", "hit_items")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = counted.join(hits, key, "left").withColumn("n_hit", n_hit)
    return out.select(*kept, "n_words", "n_hit", F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, all columns as they are."""
    if small(items, index_bytes):
        find = shared_index(items)

        def fine(part: pa.RecordBatch) -> np.ndarray:
            out = find(part.column(text))
            return ~contaminated(out["n_words"], out["n_hit"])

        return where(docs, fine, text)
    bad = hits_by_join(docs, items, text).filter(contaminated(F.col("n_words"), F.col("n_hit"))).select("key")
    key, = unused(docs, "_key")
    return docs.withColumn(key, _key(text)).join(bad.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)


def _key(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def hits_by_join(docs: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """key (of a distinct text), n_words, n_hit, hit_items of the texts that share a fingerprint with an item: a join of
    the kept hashes of both sides, then the spans of each pair that meets. A filter of fixed size over the items' hashes
    keeps others of the documents' from being shuffled. Items of one text are one item here; their ids come back at the end.
    """
    spark = docs.sparkSession
    given = items.filter(F.length("text") > 0).select(F.col("item_id").cast("string").alias("item_id"), _key("text").alias("item"), "text")
    texts_ = stored(given.groupBy("item").agg(F.first("text").alias("text")), "items")
    item_marks = stored(texts_.mapInArrow(_marks(None, None), "key string, mark long, size int"), "item-marks")
    sizes = sorted(r["size"] for r in item_marks.select("size").distinct().collect())  # WINDOW numbers at most
    word = F.floor(F.pmod("mark", F.lit(FILTER_BITS)) / 64)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod("mark", F.lit(FILTER_BITS)) % 64).cast("int"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in item_marks.groupBy(word.alias("w")).agg(F.bit_or(one).alias("b")).toLocalIterator():
        bits[r["w"]] = r["b"]
    sent = spark.sparkContext.broadcast(bits)
    marks = docs.select(_key(text).alias("item"), F.col(text).alias("text")).mapInArrow(_marks(sent, sizes), "key string, mark long, size int")
    pairs = stored(marks.join(item_marks.select(F.col("key").alias("item"), "mark", "size"), ["mark", "size"]).select("key", "item").distinct(), "pairs")
    asked = perhaps_in(docs.select(_key(text).alias("key"), F.col(text).alias("text")), pairs, True, "key").join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    bins = F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 1024))
    there = pairs.join(texts_, "item").select(F.pmod(F.xxhash64("key"), bins).alias("of"), "key", "item", "text")
    asked = asked.withColumn("bin", F.pmod(F.xxhash64("key"), bins))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        own: dict[str, tuple[list, list]] = {}
        for key, item, x in zip(*(right.column(c).to_pylist() for c in ("key", "item", "text")), strict=True):
            own.setdefault(key, ([], []))[0].append(item)
            own[key][1].append(x)
        out: dict[str, list] = {"key": [], "n_words": [], "n_hit": [], "hits": []}
        for key, x in zip(left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True):
            found = met(pa.array([x], pa.string()), [ItemIndex(*own[key])])
            out["key"].append(key)
            for name, value in zip(("n_words", "n_hit", "hits"), found.values(), strict=True):
                out[name].append(value[0])
        return pa.table({"key": pa.array(out["key"], pa.string()), "n_words": pa.array(out["n_words"], pa.int64()), "n_hit": pa.array(out["n_hit"], pa.int64()), "hits": pa.array(out["hits"], pa.list_(pa.string()))})

    judged = stored(asked.groupBy("bin").cogroup(there.groupBy("of")).applyInArrow(judge, "key string, n_words long, n_hit long, hits array<string>"), "judged")
    ids = judged.select("key", F.explode("hits").alias("item")).join(given.filter("item_id is not null").select("item", "item_id").distinct(), "item")
    ids = ids.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("hit_items"))
    return judged.join(ids, "key", "left").select("key", "n_words", "n_hit", F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def _marks(bits, sizes: list[int] | None):
    """A function for mapInArrow from (item, text): key, mark and size (words of a whole short item, else WINDOW) of each text.

    Without bits: of items. With them: of documents, with the marks that some item may have, for the sizes that items have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM)
                row = words.row()
                at = np.flatnonzero(winnowed(words, WINDOW, GRAM))
                found = [(row[at], words.grams(GRAM)[at], WINDOW)]
                for n in range(1, WINDOW):
                    if sizes is None or n in sizes:
                        at = np.flatnonzero(words.room(n) & (np.repeat(words.count, words.count) == n if sizes is None else True))
                        found.append((row[at], words.grams(n)[at], n))
                for rows, marks, n in found:
                    if sizes is not None and n not in sizes:
                        continue
                    if bits is not None:
                        slot = (marks.view(np.int64) % FILTER_BITS).astype(np.int64)
                        ok = (bits.value[slot // 64] >> (slot % 64)) & 1 == 1
                        rows, marks = rows[ok], marks[ok]
                    if len(rows):
                        pairs = np.unique(np.stack([rows.astype(np.uint64), marks], 1), axis=0)
                        yield pa.RecordBatch.from_pydict({"key": part.column("item").take(pa.array(pairs[:, 0].astype(np.int64))), "mark": np.ascontiguousarray(pairs[:, 1]).view(np.int64), "size": pa.array(np.full(len(pairs), n), pa.int32())})
        settled()

    return run


_indexes: dict = {}


def _loaded(block) -> ItemIndex:
    """Unpickled once for each Python worker and block; a few are kept."""
    key = id(block)
    if key not in _indexes or _indexes[key][0] is not block:
        if len(_indexes) > 8:
            _indexes.clear()
        _indexes[key] = block, pickle.loads(block.value)
    return _indexes[key][1]
