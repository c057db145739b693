"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded where they are read; each task sends one row for each
length it met, so the shuffle holds a histogram and no text. Suffix sums over
the distinct lengths then answer, for every context limit at once, how many
documents go over it and how many tokens are left after truncation.

Null texts count as empty (0 tokens); an empty table gives no rows; repeated
rows each count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import settled, slices, stored
from .tokens import AT_ONCE, encoder

#: Lengths in one block of the suffix sums: each block is summed in a task of its own.
BLOCK = 1 << 14


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", extra: int = 0) -> DataFrame:
    """n_tokens, n_docs: how many texts have that many ids. extra: ids that every document gets besides."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, text, AT_ONCE):
                for ids in encoder(tokenizer).encode(part.column(text)):
                    n = len(ids) // 4 + extra
                    found[n] = found.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(found.keys(), pa.int64()), "n_docs": pa.array(found.values(), pa.int64())})
        settled()

    return docs.select(text).mapInArrow(count, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row for each length L in the histogram, read as a context limit:
    n_docs (of that length), docs_over (longer), tokens_up_to (in documents of at most L),
    total_tokens (of all), truncated_total (left when every document is cut to L),
    quantile (share of documents of at most L). A limit between two lengths has the
    lower one's docs_over and tokens_up_to; at_limit() does that sum.

    The histogram is written first: it is read twice, and texts should be encoded once."""
    one = stored(histogram, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = one.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy("block")
    blocks = blocks.select("block", *[(F.sum(c).over(every) - F.col(c)).alias(f"{c}0") for c in "dt"], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}1") for c in "dt"])
    w = Window.partitionBy("block").orderBy("n_tokens")
    docs, tokens = F.sum("n_docs").over(w) + F.col("d0"), F.sum("tokens").over(w) + F.col("t0")
    return one.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("d1") - docs).alias("docs_over"), tokens.alias("tokens_up_to"), F.col("t1").alias("total_tokens"),
        (tokens + (F.col("d1") - docs) * F.col("n_tokens")).alias("truncated_total"), (docs / F.col("d1")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """total_tokens, docs_over, truncated_total at any one context limit; no row for an empty table."""
    below = F.col("n_tokens") <= limit
    return limits.groupBy("total_tokens").agg(
        F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        (F.coalesce(F.sum(F.when(below, F.col("n_tokens") * F.col("n_docs"))), F.lit(0)) + limit * F.coalesce(F.sum(F.when(~below, F.col("n_docs"))), F.lit(0))).alias("truncated_total"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """n_tokens: the smallest length that a share q of the documents doesn't exceed."""
    return limits.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
