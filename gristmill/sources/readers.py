"""Scans of record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """csv or tsv: every value stays a string."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).options(header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped, anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, records_path: str = "") -> DataFrame:
    """key, record (VARIANT): elements of the list, or entries of the object, at a dotted path of each file. key: position or name."""
    docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    inner = docs.select(F.variant_get("v", "$" + "".join(f".{p}" for p in records_path.split(".") if p), "variant").alias("v")) if records_path else docs
    each = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return each.select(F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.col("value").alias("record"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), text of one file's lines, line ends stripped."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r?\n$", "").alias("v"))
    return whole.select(F.posexplode(F.split("v", "\r?\n"))).select((F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def duplicate_keys(json: F.Column) -> F.Column:
    """Whether a JSON object names a key of its top level twice, which parsers pass over."""
    keys = F.json_object_keys(json)
    return F.size(keys) != F.size(F.array_distinct(keys))


def strict_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value, record, error: JSON lines with what a strict reader refuses: blank or malformed lines, repeated keys or ids."""
    rows = spark.read.text(path).select("value", F.from_json("value", schema).alias("record"))
    ids = rows.groupBy("record.id").agg(F.count("*").alias("n"))
    rows = rows.join(ids.withColumnRenamed("id", "_id"), F.col("record.id") == F.col("_id"), "left")
    error = F.when(F.trim("value") == "", "blank line").when(F.json_object_keys("value").isNull(), "not an object").when(duplicate_keys(F.col("value")), "duplicate key").when(F.col("n") > 1, "duplicate id")
    return rows.select("value", "record", error.alias("error"))


def release(spark: SparkSession, folder: str, schema: str, without: tuple[str, ...] = ()) -> DataFrame:
    """All split files of a release but those named; of rows of one id that of the first file stays."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(folder).withColumn("_file", F.col("_metadata.file_name"))
    rows = rows.filter(~F.col("_file").isin(*without)) if without else rows
    cols = [c for c in rows.columns if c not in ("id", "_file")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*cols), "_file").alias("_r")).select("id", "_r.*")


def archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """member, content of zip files: only names with an allowed suffix, none that leave the archive."""

    def members(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for data in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = [n for n in z.namelist() if n.endswith(suffixes) and not n.startswith("/") and ".." not in n.split("/")]
                    yield pa.RecordBatch.from_pydict({"member": pa.array(names, pa.string()), "content": pa.array([z.read(n).decode("utf-8") for n in names], pa.string())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(members, "member string, content string")


def python_constants(spark: SparkSession, path: str, allowed: tuple[str, ...]) -> DataFrame:
    """name, value (JSON) of module-level literals of Python files, which aren't run. Missing and repeated names fail."""

    def read(batches):
        import ast
        import json

        import pyarrow as pa

        for batch in batches:
            for source in batch.column("value").to_pylist():
                found = [(t.id, ast.literal_eval(node.value)) for node in ast.parse(source).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name) and t.id in allowed]
                if sorted(n for n, _ in found) != sorted(allowed):
                    raise ValueError("each allowed name has to be assigned once")
                yield pa.RecordBatch.from_pydict({"name": [n for n, _ in found], "value": [json.dumps(v, sort_keys=True) for _, v in found]})

    return spark.read.text(path, wholetext=True).mapInArrow(read, "name string, value string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
