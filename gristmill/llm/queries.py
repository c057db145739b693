"""The queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprint, ngram_join, packing, pii, secret_scan, token_counts, token_output, toxicity
from .tokens import default_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spans) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprint.compared_with_next(docs, fingerprint.level_ranks(docs))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(table(spark, sf_dir, "documents"), default_path()))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(table(spark, sf_dir, "documents"), default_path())


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.conversations_back(chat.examples(given.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secret_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, model, keep=["doc_id"], passages=False).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_token_output": op7_token_output,
    "op8_chat": op8_chat,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
}
_CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/s>|s>|INST\]|/INST\])"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, coalesce(any_value(k.k), 0) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) AS k ON k.a = r.doc_id GROUP BY r.doc_id""",
    "op6_decontamination": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 13) AS m, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS t FROM b WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM win),
pl AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, ms WHERE len(ws) >= m),
hit AS MATERIALIZED (SELECT doc_id, p, pl.m, item_id FROM pl JOIN win ON win.m = pl.m AND win.t = array_to_string(ws[p:p + pl.m - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_chat": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(length('<|im_start|><|im_end|>') + 2 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_CONTROL}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
