"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. The first four return the columns of documents; the last returns pieces
of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontam, ngram_join, packing, secret_scan, toxicity
from gristmill.llm._common import stored
from gristmill.llm.tokens import default_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Null and empty texts score as texts without toxic passages and stay;
    rows of one doc_id are judged each; without labels all rows stay; an empty table gives no rows; other columns, of any name, stay as they are."""
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the least doc_id stays. Texts without words link with nothing and stay; so do
    rows without doc_id; of rows that repeat doc_id and text one stays; an empty table gives no rows; other columns, of any name, stay as they are."""
    return ngram_join.representatives(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts have no words and stay; repeated rows are judged each; an empty
    benchmark lets all rows stay; an empty table gives no rows; other columns, of any name, stay as they are."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, and n_chars follows; every row stays, null texts as null; an empty table gives no
    rows; other columns, of any name, stay as they are."""
    return secret_scan.redacted(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens. Null and empty texts are a piece of one id; repeated rows are pieces
    of their own; an empty table gives no rows; columns but doc_id and text are not read."""
    return packing.pack(docs, default_path())


STAGES = [("toxicity", toxic), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark), ("secrets", secrets), ("packing", packed)]

#: Toxicity scores and token ids have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
