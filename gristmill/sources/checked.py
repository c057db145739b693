"""Sources that are verified before they are read, and settings with closed keys."""

from __future__ import annotations

import hashlib
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.authoring import interpolated

SNAPSHOT = "suites array<struct<suite_id: string, user_tasks: array<struct<id: string, prompt: string>>, injection_tasks: array<struct<id: string, goal: string>>>>"
POLICY = "policy_id string, domain string, rules array<struct<rule_id: string, effect: string, actions: array<string>, source_roles: array<string>>>"


def strict_json(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """path, value (canonical JSON or null), error (or null) of whole JSON files: those that aren't UTF-8, are larger than `most` bytes, repeat
    a key at any depth, or say NaN or Infinity are errors. Larger files are never opened."""

    def parse(batches):
        import json

        import pyarrow as pa

        def once(pairs):
            if len({k for k, _ in pairs}) != len(pairs):
                raise ValueError("duplicate key")
            return dict(pairs)

        def no(name):
            raise ValueError(f"{name} is no JSON")

        def one(data: bytes) -> tuple[str | None, str | None]:
            try:
                return json.dumps(json.loads(data.decode("utf-8"), object_pairs_hook=once, parse_constant=no), sort_keys=True, ensure_ascii=False, separators=(",", ":")), None
            except UnicodeDecodeError:
                return None, "not UTF-8"
            except (ValueError, RecursionError) as e:
                return None, str(e) if "key" in str(e) or "no JSON" in str(e) else "malformed"

        for batch in batches:
            got = [one(x) for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "value": pa.array([v for v, _ in got], pa.string()), "error": pa.array([e for _, e in got], pa.string())})

    files = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    read = files.filter(F.col("length") <= most).select("path", "content").mapInArrow(parse, "path string, value string, error string")
    large = files.filter(F.col("length") > most).select("path", F.lit(None).cast("string").alias("value"), F.lit("too large").alias("error"))
    return read.unionByName(large)


def snapshot_cases(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """suite_id, user_task, injection_task, prompt, goal: every pair of tasks of each suite of a snapshot whose bytes have the given digest."""
    body = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("d"))
    checked = F.when(F.col("d") == sha256, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("the snapshot's digest differs from the pinned one")).cast("string"))
    s = body.select(F.explode(F.from_json(checked, SNAPSHOT)["suites"]).alias("s"))
    u = s.select("s.suite_id", F.explode("s.user_tasks").alias("u"), F.col("s.injection_tasks").alias("all"))
    return u.select("suite_id", "u", F.explode("all").alias("i")).select("suite_id", F.col("u.id").alias("user_task"), F.col("i.id").alias("injection_task"), F.col("u.prompt").alias("prompt"), F.col("i.goal").alias("goal"))


def policy_catalogue(spark: SparkSession, folder: str, domains: tuple[str, ...]) -> DataFrame:
    """policy_id, domain, rule_id, effect, actions, source_roles, error of a folder of policies: a policy or rule id that is there twice, an unknown domain. A domain without policies is a row of its own."""
    files = spark.read.schema(POLICY).option("multiLine", True).json(folder)
    policies = files.groupBy("policy_id").agg(F.count("*").alias("_np"))
    rules = files.select("policy_id", "domain", F.explode_outer("rules").alias("r")).select("policy_id", "domain", "r.*")
    ids = rules.groupBy("rule_id").agg(F.count("*").alias("_nr"))
    out = rules.join(policies, "policy_id").join(ids, "rule_id", "left")
    error = F.when(F.col("_np") > 1, "duplicate policy").when(F.col("_nr") > 1, "duplicate rule").when(~F.col("domain").isin(*domains), "unknown domain")
    cols = ["policy_id", "domain", "rule_id", "effect", "actions", "source_roles"]
    want = spark.createDataFrame([(d,) for d in domains], "domain string")
    missing = want.join(rules.select("domain").distinct(), "domain", "left_anti").withColumn("error", F.lit("no policy"))
    return out.select(*cols, error.alias("error")).unionByName(missing, allowMissingColumns=True)


def toml_settings(path: str, keys: dict[str, type], env: dict[str, str] | None = None) -> dict:
    """A flat TOML file whose keys are those given, each of its type; ${NAME} in strings is replaced."""
    with open(path, "rb") as f:
        got = tomllib.load(f)
    if set(got) != set(keys):
        raise ValueError(f"unknown or missing settings: {sorted(set(got) ^ set(keys))}")
    out = {k: interpolated(v, env) if isinstance(v, str) else v for k, v in got.items()}
    for k, kind in keys.items():
        if type(out[k]) is not kind:
            raise TypeError(f"{k} has to be of type {kind.__name__}")
    return out


def checksum_lines(folder: str) -> list[str]:
    """`sha256  path` of the files under a local folder, by path: the index of a release, whose files are few."""
    out = []
    for base, _, files in os.walk(folder):
        for name in files:
            path = os.path.join(base, name)
            with open(path, "rb") as f:
                out.append((os.path.relpath(path, folder), hashlib.file_digest(f, "sha256").hexdigest()))
    return [f"{d}  {p}" for p, d in sorted(out)]


def checksum_faults(folder: str, lines: list[str]) -> list[str]:
    """Paths of an index that leave the folder, are there twice, are missing or differ; files that no line names."""
    now, faults, seen = {x.split("  ", 1)[1]: x[:64] for x in checksum_lines(folder)}, [], set()
    for line in lines:
        digest, _, path = line.partition("  ")
        if os.path.isabs(path) or ".." in path.split("/"):
            faults.append(f"outside: {path}")
        elif path in seen:
            faults.append(f"twice: {path}")
        elif now.get(path) != digest:
            faults.append(f"{'differs' if path in now else 'missing'}: {path}")
        seen.add(path)
    return faults + [f"not listed: {p}" for p in sorted(set(now) - seen)]
