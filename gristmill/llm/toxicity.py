"""Toxicity by maximum-scoring segments.

Tokens of a word are the word itself and its first 4, 5 and 6 bytes (stems
inflect). Each token gets the log-odds ratio of toxic against clean labelled
documents with an informative Dirichlet prior, and its z-score (Monroe,
Colaresi and Quinn 2008); tokens beyond a z-score are the lexicon. A word
scores its best token's log-odds; a word outside the lexicon costs a little.

A linear scan (Ruzzo and Tompa 1999) then gives every maximal-scoring segment
of a document: its toxic passages. Under the Karlin-Altschul extreme-value law
a text of n words has about K n exp(-lambda S) segments of score S by chance;
the surprise of its significant passages is summed, and a logistic curve
fitted on the labelled documents turns the sum into a score from 0 to 1.

Fitting takes at most `sample` labelled documents (those of the least hash of
doc_id); scoring covers every document and every word.

Null texts count as empty. Empty texts score as a text without toxic passages.
Without labels of both kinds the score is the share of toxic labels (0 if
there are none). A document with several labels is toxic if one of them says
so; rows of one doc_id are scored each; very long texts are scored whole, in
time in proportion to their length; an empty table gives no rows. Other columns
pass through; those named like an added column (score, predicted,
toxic_passages) are replaced by scored(), and kept by clean().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM, LOWER, Words, add_columns, member, mixed, place_keys, settled, slices, stored, where

#: The bound of labelled documents that the fit takes.
SAMPLE = 30_000
PREFIXES = (4, 5, 6)
LEAST_Z = 3.2


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cost: float = -0.1  # of a word outside the lexicon
    lam: float = 1.0
    k: float = 0.1
    a: float = -20.0  # score = logistic(a + b * surprise)
    b: float = 0.0


def features(words: Words) -> list[np.ndarray]:
    """Token hashes of every word: itself and, where it is longer, its prefixes (0 elsewhere)."""
    out, length = [words.hash], words.end - words.start
    keys = place_keys(max(PREFIXES))
    sums = np.zeros(len(words.start), np.uint64)
    for k in range(max(PREFIXES)):
        at = np.minimum(words.start + k, max(len(words.data) - 1, 0))
        sums = sums + (LOWER[words.data[at]].astype(np.uint64) + np.uint64(1)) * keys[k] if len(at) else sums
        if k + 1 in PREFIXES:
            out.append(np.where(length > k + 1, mixed(sums + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), np.uint64(0)))
    return out


def segments(at: np.ndarray, gain: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end word, score); `at`: places of the words that gain, in order."""
    # first, end, sum before, sum at the end, and the last segment held before that starts from a lower sum (Ruzzo and Tompa's link)
    held: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, 0
    for p, g in zip(at.tolist(), gain.tolist(), strict=True):
        before = total + cost * (p - last)
        total, last = before + g, p + 1
        first, left, k = p, before, len(held) - 1
        while True:
            while k >= 0 and held[k][2] >= left:
                k = held[k][4]
            if k < 0 or held[k][3] >= total:
                held.append((first, p + 1, left, total, k))
                break
            first, _, left, _, link = held[k]
            del held[k:]
            k = link
    return [(a, b, high - low) for a, b, low, high, _ in held]


def word_gains(words: Words, model: Model) -> np.ndarray:
    gain = np.zeros(len(words.hash))
    for tokens in features(words):
        found, at = member(tokens, model.tokens)
        np.maximum(gain, np.where(found, model.odds[at] if len(model.odds) else 0.0, 0.0), out=gain)
    return gain


def surprises(words: Words, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Of each row the summed surprise of its significant passages, and these passages (in words of the row)."""
    gain = word_gains(words, model)
    places = np.flatnonzero(gain > 0)
    cut = np.searchsorted(places, words.first)
    out, passages = np.zeros(len(words.count)), [[] for _ in words.count]
    for i in np.flatnonzero(np.diff(cut)):
        at = places[cut[i] : cut[i + 1]]
        chance = math.log(max(model.k * words.count[i], 1e-9))
        for a, b, s in segments(at - words.first[i], gain[at], model.cost):
            if (x := model.lam * s - chance) > 0:
                out[i] += x
                passages[i].append((a, b, s))
    return out, passages


def fit(train: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Fits on rows of text and a 0/1 label: at most as many as the caller bounds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words, toxic = Words(part.column(text), ALNUM), part.column(label).to_numpy(zero_copy_only=False) == 1
                tokens = np.stack(features(words), 1)
                new = np.ones(tokens.shape, bool)
                new &= tokens != 0
                pairs = np.stack([np.repeat(words.row(), tokens.shape[1])[new.ravel()].astype(np.uint64), tokens.ravel()[new.ravel()]], 1)
                order = np.lexsort((pairs[:, 0], pairs[:, 1]))
                pairs = pairs[order]
                first = np.ones(len(pairs), bool)
                first[1:] = (pairs[1:] != pairs[:-1]).any(1)
                pairs = pairs[first]
                values, at = np.unique(pairs[:, 1], return_index=True)
                is_toxic = np.concatenate([[0], np.cumsum(toxic[pairs[:, 0].astype(np.int64)])])
                ends = np.append(at[1:], len(pairs))
                in_toxic = is_toxic[ends] - is_toxic[at]
                yield pa.RecordBatch.from_pydict({"token": values.view(np.int64), "t": in_toxic.astype(np.int64), "c": (ends - at - in_toxic).astype(np.int64)})
        settled()

    model = Model()
    sizes = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    if not n_t or not n_c:
        share = n_t / max(1, n_t + n_c)
        model.a = math.log((share + 1e-9) / (1 - share + 1e-9))
        return model
    counts = train.select(text, label).mapInArrow(count, "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    prior = 0.01  # pseudo-documents for each document that has the token
    a = prior * (F.col("t") + F.col("c"))
    all_t, all_c = n_t * (1 + prior), n_c * (1 + prior)
    share = (n_t / (n_t + n_c), n_c / (n_t + n_c))
    yt, yc = F.col("t") + a * share[0], F.col("c") + a * share[1]
    odds = F.log(yt / (all_t - yt + 1)) - F.log(yc / (all_c - yc + 1))
    lexicon = (counts.filter("t >= 3").select("token", odds.alias("odds"), (odds / F.sqrt(1 / (yt + 0.5) + 1 / (yc + 0.5))).alias("z"))
        .filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= 1.5)).toPandas().sort_values("token"))
    tokens = lexicon["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    model.tokens, model.odds = tokens[order], np.minimum(lexicon["odds"].to_numpy(float)[order], 10.0)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), ALNUM)
                gain = word_gains(words, model)
                toxic = np.repeat(part.column(label).to_numpy(zero_copy_only=False) == 1, words.count)
                yield pa.RecordBatch.from_pydict({"wt": [int(toxic.sum())], "wc": [int((~toxic).sum())], "gt": [int((gain > 0)[toxic].sum())], "gc": [int((gain > 0)[~toxic].sum())], "sc": [float(gain[~toxic].sum())]})

    r = train.select(text, label).mapInArrow(rates, "wt long, wc long, gt long, gc long, sc double").agg(*[F.sum(c).alias(c) for c in ("wt", "wc", "gt", "gc", "sc")]).first()
    clean, toxic = ((r["gc"] or 0) + 1) / ((r["wc"] or 0) + 100), ((r["gt"] or 0) + 1) / ((r["wt"] or 0) + 100)
    model.cost = min(-1e-3, math.log((1 - min(toxic, 0.5)) / (1 - min(clean, 0.4))))
    mean = (r["sc"] or 0) / r["gc"] if r["gc"] else float(model.odds.mean()) if len(model.odds) else 1.0
    low, high = 1e-6, 50.0 / max(mean, 0.1)  # the positive root of E[exp(lambda * score)] = 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.log(clean) + mid * mean < math.log(max(1e-300, 1 - (1 - clean) * math.exp(mid * model.cost))) else (low, mid)
    model.lam, model.k = low, clean

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x, _ = surprises(Words(part.column(text), ALNUM), model)
                yield pa.RecordBatch.from_pydict({"x": x, "y": part.column(label).cast(pa.int64())})

    # one row for each step of the surprise, of 1/8 up to 64 and of a sixteenth of an octave beyond: the curve needs no more
    scored = train.select(text, label).mapInArrow(rate, "x double, y long")
    step = F.when(F.col("x") < 64, F.floor(F.col("x") * 8) / 8).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("x") * 16) / 16))
    table = scored.groupBy(step.alias("x")).agg(F.sum("y").alias("t"), F.count("*").alias("n")).toPandas().astype(float)
    x, t, n = table["x"].to_numpy(), table["t"].to_numpy(), table["n"].to_numpy()
    a, b = math.log((t.sum() + 1) / (n.sum() - t.sum() + 1)), 0.1
    for _ in range(100):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(t - n * p).sum(), ((t - n * p) * x).sum() - 0.1 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + step[0], b + step[1]
    model.a, model.b = float(a), float(max(b, 0.0))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `sample` labelled documents that aren't held out, written once: the fit reads them several times."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return stored(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(own), "doc_id").select("text", "toxic"), "training")


def _scores(docs: DataFrame, model: Model, text: str, threshold: float, passages: bool) -> Callable[[pa.RecordBatch], dict]:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(part: pa.RecordBatch) -> dict:
        m = shared.value
        x, found = surprises(Words(part.column(text), ALNUM), m)
        score = 1 / (1 + np.exp(-np.clip(m.a + m.b * x, -30, 30)))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32), "toxic_passages": [[{"first": a, "end": b, "score": s} for a, b, s in y] for y in found] if passages else None}

    return fn


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3, passages: bool = True) -> DataFrame:
    """docs (or its columns `keep`) with score, predicted and (on wish) toxic_passages in words of ASCII letters, digits and all beyond ASCII."""
    added = "score double, predicted int" + ", toxic_passages array<struct<first:int,end:int,score:double>>" * passages
    return add_columns(docs, _scores(docs, model, text, threshold, passages), added, text, keep)


def clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score stays below the threshold, all columns as they are."""
    fn = _scores(docs, model, text, threshold, False)
    return where(docs, lambda part: fn(part)["predicted"] == 0, text)
