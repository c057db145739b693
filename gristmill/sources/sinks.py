"""Sinks of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_json(df: DataFrame) -> F.Column:
    """A row as JSON with its top-level keys in order, nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    """Canonical lines in order of id: ranges are sorted apart, files are in order."""
    df.repartitionByRange("id").sortWithinPartitions("id").select(canonical_json(df)).write.text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder of canonical lines for each split."""
    df.select(canonical_json(df).alias("value"), "split").write.partitionBy("split").text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.option("header", True).csv(path)
