"""The queries of the library's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import dedup, metrics, selection
from ..vocabulary import SEED, SEMANTIC, SYNONYMS, VARIANT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- records: documents and labels in the annotation model -----------------------

#: Axes of a record from its label and id: the test tables have no annotations of their own.
AXES = {
    "presence": "CASE WHEN toxic IS NULL THEN 'UNDETERMINED' WHEN toxic = 1 THEN 'INSTRUCTION_PRESENT' ELSE 'NO_INSTRUCTION' END",
    "presentation": "CASE WHEN toxic IS NULL THEN 'UNKNOWN' WHEN toxic = 0 THEN 'NOT_APPLICABLE' WHEN quality = 1 THEN 'OPERATIVE' ELSE 'QUOTED_OR_REPORTED' END",
    "addressee": "CASE WHEN toxic IS NULL THEN 'UNKNOWN' WHEN toxic = 0 THEN 'NOT_APPLICABLE' WHEN doc_id % 3 = 0 THEN 'HUMAN' ELSE 'MODEL_OR_AGENT' END",
    "authority": "CASE WHEN toxic IS NULL OR doc_id % 4 = 3 THEN 'UNKNOWN' WHEN toxic = 0 THEN 'NOT_APPLICABLE' WHEN doc_id % 4 = 0 THEN 'SPOOFED' WHEN doc_id % 4 = 1 THEN 'OUTSIDE_AUTHORITY' ELSE 'WITHIN_AUTHORITY' END",
    "goal": "CASE WHEN toxic IS NULL THEN 'UNDETERMINED' WHEN toxic = 1 THEN 'MISALIGNED' ELSE 'ALIGNED' END",
    "policy": "CASE WHEN toxic IS NULL OR doc_id % 5 = 0 THEN 'UNDETERMINED' WHEN toxic = 1 THEN 'CONFLICTING' ELSE 'COMPLIANT' END",
    "status": "CASE WHEN quality = 1 THEN 'CONFIRMED' WHEN quality = 0 AND doc_id % 2 = 0 THEN 'DISAGREEMENT' ELSE 'INSUFFICIENT_CONTEXT' END",
    "confidence": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 0.5 + 0.0625 * (doc_id % 8) END",
    "manual": "quality IS NOT NULL AND quality = 0",
}
REC = "WITH rec AS (SELECT d.doc_id, printf('doc_%08d', d.doc_id) AS id, text, lang, source, n_chars, quality, toxic, " + ", ".join(f"CAST({v.replace('doc_id', 'd.doc_id')} AS {'DOUBLE' if k == 'confidence' else 'BOOLEAN' if k == 'manual' else 'VARCHAR'}) AS {k}" for k, v in AXES.items()) + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    axes = [F.expr(v).cast("double" if k == "confidence" else "boolean" if k == "manual" else "string").alias(k) for k, v in AXES.items()]
    return docs.select("doc_id", F.format_string("doc_%08d", "doc_id").alias("id"), "text", "lang", "source", "n_chars", "quality", "toxic", *axes)


def verdicts(rec: DataFrame) -> DataFrame:
    return rec.withColumn("verdict", rules.verdict(*[F.col(c) for c in ("presence", "presentation", "addressee", "authority", "status")]))


VERDICT = "CASE WHEN presence = 'INSTRUCTION_PRESENT' AND presentation = 'OPERATIVE' AND addressee = 'MODEL_OR_AGENT' AND authority IN ('OUTSIDE_AUTHORITY', 'SPOOFED') THEN 'DETECTED' WHEN status IN ('INSUFFICIENT_CONTEXT', 'DISAGREEMENT') OR presence = 'UNDETERMINED' OR presentation = 'UNKNOWN' OR addressee = 'UNKNOWN' OR authority = 'UNKNOWN' THEN 'UNCERTAIN' ELSE 'NOT_DETECTED' END"
NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SYNONYMS.items()) + "}"
WORDS = rf"list_transform(list_filter(regexp_extract_all({NORM}, '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ('all', 'any', 'the')), lambda x: coalesce({_MAP}[x], x))"
TOKS = rf"list_filter(string_split(regexp_replace(list_aggregate(list_transform({WORDS}, lambda x: ' ' || x || ' '), 'string_agg', ''), ' instruction (( previous )+)', '\1 instruction ', 'g'), ' '), lambda x: x <> '')"
FEAT = f"f0 AS MATERIALIZED (SELECT *, sha256({NORM}) AS hash, coalesce({TOKS}, []) AS a FROM rec), f AS MATERIALIZED (SELECT * EXCLUDE (a), list_distinct(a) AS tk, array_to_string(a, ' ') AS joined, CASE WHEN len(a) > 1 THEN list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) ELSE [] END AS bi FROM f0)"


# --- hashes, exact groups ---------------------------------------------------------


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).withColumn("hash", F.sha2(text.normalize_text("text"), 256))


def exact(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal normalised text, language and source role."""
    h = hashed(spark, sf)
    return dedup.exact_groups(h, F.sha2(F.concat_ws("|", "hash", "lang"), 256))


EXACT = REC + f", h AS (SELECT *, sha256(sha256({NORM}) || '|' || lang) AS exact_key, sha256({NORM}) AS hash FROM rec), e AS (SELECT *, min(id) OVER (PARTITION BY exact_key) AS exact_first FROM h)"


@query(EXACT + " SELECT id, exact_first, CASE WHEN id = exact_first THEN 'KEEP' ELSE 'DROP_EXACT_DUPLICATE' END AS decision FROM e")
def exact_dedup(spark, sf):
    return exact(spark, sf).select("id", "exact_first", F.when(F.col("kept"), "KEEP").otherwise("DROP_EXACT_DUPLICATE").alias("decision"))


@query(EXACT + " SELECT CASE WHEN id = exact_first THEN 'KEEP' ELSE 'DROP_EXACT_DUPLICATE' END AS decision, count(*) AS n FROM e GROUP BY 1")
def dedup_decisions(spark, sf):
    return exact_dedup(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))


@query(EXACT + " SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM e GROUP BY exact_key) GROUP BY size")
def exact_group_sizes(spark, sf):
    return exact(spark, sf).groupBy("exact_key").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


@query(EXACT + " SELECT hash, count(DISTINCT source) AS n_sources, count(*) AS n FROM e GROUP BY hash HAVING count(DISTINCT source) > 1")
def normalized_hash_conflicts(spark, sf):
    return hashed(spark, sf).groupBy("hash").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n")).filter("n_sources > 1")


@query(REC + " SELECT id, sha256(text) AS text_sha256, sha256('{\"id\":\"' || id || '\",\"lang\":\"' || lang || '\",\"quality\":' || coalesce(CAST(quality AS VARCHAR), 'null') || '}') AS json_sha256, 'rec_' || substr(sha256('{\"dataset\":\"' || source || '\",\"source_record_id\":\"' || doc_id || '\"}'), 1, 24) AS canonical_id FROM rec")
def canonical_json_ids(spark, sf):
    keep = {"ignoreNullFields": "false"}
    body = F.to_json(F.struct(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("source_record_id")), keep)
    return records(spark, sf).select("id", F.sha2("text", 256).alias("text_sha256"), F.sha2(F.to_json(F.struct("id", "lang", "quality"), keep), 256).alias("json_sha256"), F.concat(F.lit("rec_"), F.substring(F.sha2(body, 256), 1, 24)).alias("canonical_id"))


def feats(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the records. Of labels only how often they name a document matters: those named more than once are broadcast, and no text is shuffled."""
    docs = t(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    often = t(spark, sf, "labels").groupBy("doc_id").agg(F.count("*").cast("int").alias("k")).filter("k > 1")
    rows = docs.join(F.broadcast(often), "doc_id", "left").withColumn("k", F.explode(F.array_repeat(F.lit(1), F.coalesce("k", F.lit(1)))))
    return dedup.features(rows.select(F.format_string("doc_%08d", "doc_id").alias("id"), "text", "source", "lang"))


@query(REC + ", " + FEAT + " SELECT id, hash, len(tk) AS n_tokens, len(bi) AS n_bigrams, sha256(joined) AS joined_sha256, CASE WHEN length(joined) = 0 THEN 0 WHEN length(joined) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(joined) - 1), lambda i: substr(joined, i, 3)))) END AS n_trigrams FROM f")
def token_features(spark, sf):
    counted = feats(spark, sf).select("id", "hash", "joined", text.token_counts(F.col("joined")).alias("c"))
    return counted.select("id", "hash", "c.n_tokens", "c.n_bigrams", F.sha2("joined", 256).alias("joined_sha256"), "c.n_trigrams")


PAIRS = (
    REC + ", " + FEAT + ", w AS MATERIALIZED (SELECT id, len(tk) AS n, unnest(tk) AS t FROM f), o AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM w x JOIN w y ON x.t = y.t AND x.id < y.id GROUP BY ALL HAVING count(*) >= 0.44 * (x.n + y.n - count(*)) - 1e-9), "
    "tri AS MATERIALIZED (SELECT id, hash, joined, bi, CASE WHEN length(joined) = 0 THEN [] WHEN length(joined) <= 3 THEN [joined] ELSE list_distinct(list_transform(range(1, length(joined) - 1), lambda i: substr(joined, i, 3))) END AS tg FROM f WHERE id IN (SELECT a FROM o UNION SELECT b FROM o)), "
    "j AS (SELECT a, b, na, nb, k, x.hash = y.hash OR x.joined = y.joined AS same, len(list_intersect(x.bi, y.bi)) AS kb, len(x.bi) + len(y.bi) AS sb, len(list_intersect(x.tg, y.tg)) AS kt, len(x.tg) + len(y.tg) AS st FROM o JOIN tri x ON x.id = a JOIN tri y ON y.id = b), "
    "s AS (SELECT a, b, CASE WHEN same THEN 1.0 ELSE 0.5 * k / (na + nb - k) + 0.25 * (CASE WHEN sb = 0 THEN 1.0 ELSE kb / (sb - kb) END) + 0.25 * (CASE WHEN st = 0 THEN 1.0 ELSE kt / (st - kt) END) END AS similarity FROM j)"
)


@query(PAIRS + f" SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= {SEMANTIC}")
def near_dup_pairs(spark, sf):
    return dedup.similar_pairs(feats(spark, sf), SEMANTIC).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def semantic_clusters(spark, sf):
    return dedup.clusters(feats(spark, sf), SEMANTIC, VARIANT)


@query()
def group_bound_clusters(spark, sf):
    return dedup.clusters(feats(spark, sf), SEMANTIC, VARIANT, F.when(F.col("lang") == "es", F.concat_ws(":", "source", "lang")))


@query()
def cluster_report(spark, sf):
    c = semantic_clusters(spark, sf).groupBy("representative").agg(F.count("*").alias("size"), F.min("similarity").alias("least"))
    return c.groupBy("size").agg(F.count("*").alias("n_clusters"), F.round(F.avg("least"), 6).alias("mean_least"))


@query()
def cross_source_clusters(spark, sf):
    rec = records(spark, sf).select("id", "source")
    return semantic_clusters(spark, sf).join(rec, "id").groupBy("representative").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("k")).filter("k > 1")


# --- verdicts, mapping, review ------------------------------------------------------


@query(REC + f" SELECT id, {VERDICT} AS verdict FROM rec")
def verdict(spark, sf):
    return verdicts(records(spark, sf)).select("id", "verdict")


@query(REC + f" SELECT source, {VERDICT} AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS rate FROM rec GROUP BY 1, 2")
def verdict_by_source(spark, sf):
    out = verdicts(records(spark, sf)).groupBy("source", "verdict").agg(F.count("*").alias("n"))
    return out.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


COND = "concat_ws(',', CASE WHEN confidence IS NULL THEN 'MAPPING_CONFIDENCE_MISSING' WHEN confidence < 0.85 THEN 'MAPPING_CONFIDENCE_BELOW_THRESHOLD' END, CASE WHEN manual THEN 'REQUIRES_MANUAL_REVIEW' END, CASE WHEN authority = 'UNKNOWN' THEN 'AUTHORITY_STATUS_UNKNOWN' END, CASE WHEN goal = 'UNDETERMINED' THEN 'USER_GOAL_ALIGNMENT_UNDETERMINED' END, CASE WHEN policy = 'UNDETERMINED' THEN 'PROTECTED_POLICY_ALIGNMENT_UNDETERMINED' END)"


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).withColumn("conds", rules.review_conditions(*[F.col(c) for c in ("confidence", "manual", "authority", "goal", "policy")]))


@query(REC + f" SELECT source, id, {COND} AS conditions, substr(text, 1, 240) AS preview FROM rec WHERE {COND} <> ''")
def review_queue(spark, sf):
    return conditions(spark, sf).filter(F.size("conds") > 0).select("source", "id", F.array_join("conds", ",").alias("conditions"), F.substring("text", 1, 240).alias("preview"))


@query(REC + f" SELECT count(*) AS n, count(*) FILTER ({COND} <> '') AS queued, round(count(*) FILTER ({COND} <> '') / count(*), 6) AS rate FROM rec")
def review_rate(spark, sf):
    queued = F.count(F.when(F.size("conds") > 0, 1))
    return conditions(spark, sf).agg(F.count("*").alias("n"), queued.alias("queued"), F.round(queued / F.count("*"), 6).alias("rate"))


@query(REC + " SELECT id, CASE WHEN quality IS NULL THEN 'UNANNOTATED' WHEN quality = 1 THEN 'GOLD' ELSE 'SILVER_HEURISTIC' END AS tier, CASE WHEN quality IS NULL THEN 0.0 ELSE coalesce(confidence, 0.0) END AS mapping_confidence, manual OR quality IS NULL OR status <> 'CONFIRMED' AS requires_manual_review FROM rec")
def mapping_quality(spark, sf):
    q = F.col("quality")
    return records(spark, sf).select("id", F.when(q.isNull(), "UNANNOTATED").when(q == 1, "GOLD").otherwise("SILVER_HEURISTIC").alias("tier"), F.when(q.isNull(), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("mapping_confidence"), (F.col("manual") | q.isNull() | (F.col("status") != "CONFIRMED")).alias("requires_manual_review"))


@query(REC + " SELECT id, CASE source WHEN 'src0' THEN 'agentic' WHEN 'src1' THEN 'benign' WHEN 'src2' THEN 'indirect' ELSE 'manual_review' END AS family, CASE WHEN source IN ('src0', 'src1') THEN source || ':' || lang WHEN source = 'src2' THEN source || ':' || (doc_id % 7) END AS group_key FROM rec")
def family_rules(spark, sf):
    s = F.col("source")
    fam = F.when(s == "src0", "agentic").when(s == "src1", "benign").when(s == "src2", "indirect").otherwise("manual_review")
    return records(spark, sf).select("id", fam.alias("family"), F.when(s.isin("src0", "src1"), F.concat_ws(":", "source", "lang")).when(s == "src2", F.concat_ws(":", "source", F.col("doc_id") % 7)).alias("group_key"))


AUDIT = {
    "missing_mapping_confidence": "confidence IS NULL",
    "alignment_without_user_goal": "goal IN ('ALIGNED', 'MISALIGNED') AND doc_id % 6 = 0",
    "no_instruction_with_attack_labels": "presence = 'NO_INSTRUCTION' AND policy = 'CONFLICTING'",
    "not_applicable_inconsistent_with_no_instruction": "presence = 'NO_INSTRUCTION' AND authority <> 'NOT_APPLICABLE'",
    "not_applicable_inconsistent_with_instruction": "presence = 'INSTRUCTION_PRESENT' AND presentation = 'NOT_APPLICABLE'",
    "spoofed_without_authority_claim": "authority = 'SPOOFED' AND doc_id % 8 = 0",
    "source_derived_marked_confirmed": "status = 'CONFIRMED' AND manual",
}


@query(REC + " SELECT issue, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS issue FROM rec WHERE {v}" for k, v in AUDIT.items()) + ") GROUP BY issue")
def audit_issues(spark, sf):
    out = records(spark, sf).select(F.explode(rules.issues({k: F.expr(v) for k, v in AUDIT.items()})).alias("issue"))
    return out.groupBy("issue").agg(F.count("*").alias("n"))


@query(EXACT + f", v AS (SELECT *, {VERDICT} AS verdict FROM e) SELECT exact_key, count(DISTINCT verdict) AS n_verdicts, count(*) AS n FROM v GROUP BY exact_key HAVING count(DISTINCT verdict) > 1")
def conflict_clusters(spark, sf):
    return verdicts(exact(spark, sf)).groupBy("exact_key").agg(F.count_distinct("verdict").alias("n_verdicts"), F.count("*").alias("n")).filter("n_verdicts > 1")


PRIORITY = "CASE WHEN manual OR coalesce(confidence, 0) < 0.85 THEN 20 ELSE 0 END + CASE WHEN authority = 'UNKNOWN' THEN 8 ELSE 0 END + CASE WHEN goal = 'UNDETERMINED' THEN 8 ELSE 0 END + CASE WHEN policy = 'UNDETERMINED' THEN 8 ELSE 0 END + CASE WHEN coalesce(text, '') = '' THEN 30 ELSE 0 END + CASE WHEN presentation IN ('QUOTED_OR_REPORTED', 'HYPOTHETICAL') THEN 6 ELSE 0 END + CASE WHEN authority = 'SPOOFED' THEN 5 ELSE 0 END + CASE WHEN length(coalesce(text, '')) > 500 THEN 3 ELSE 0 END"


@query(REC + f", p AS (SELECT id, text, {PRIORITY} + CASE WHEN count(*) OVER (PARTITION BY source) <= 40 THEN 4 ELSE 0 END AS score FROM rec) SELECT id, score, CASE WHEN score >= 35 AND coalesce(text, '') = '' THEN 'P0' WHEN score >= 25 THEN 'P1' WHEN score >= 15 THEN 'P2' WHEN score >= 8 THEN 'P3' ELSE 'P4' END AS band FROM p")
def priority_scores(spark, sf):
    rec = records(spark, sf)
    sizes = rec.groupBy("source").agg(F.count("*").alias("k"))  # combined before the shuffle: a hot source is one row a task
    out = rec.join(sizes, "source").withColumn("score", (F.expr(PRIORITY) + F.when(F.col("k") <= 40, 4).otherwise(0)).cast("long"))
    s = F.col("score")
    return out.select("id", "score", F.when((s >= 35) & (F.coalesce("text", F.lit("")) == ""), "P0").when(s >= 25, "P1").when(s >= 15, "P2").when(s >= 8, "P3").otherwise("P4").alias("band"))


@query(REC + " SELECT source, lang, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) <= 20")
def rare_flags(spark, sf):
    return records(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n")).filter("n <= 20")


# --- statistics -----------------------------------------------------------------------


AXIS_NAMES = ("lang", "source", "presence", "presentation", "addressee", "authority", "goal", "policy", "status")


@query(REC + ", x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value FROM rec" for a in AXIS_NAMES) + ") SELECT axis, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY axis), 6) AS rate FROM x GROUP BY axis, value")
def corpus_statistics(spark, sf):
    stacked = records(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXIS_NAMES])).alias("x")).select("x.*")
    out = stacked.groupBy("axis", "value").agg(F.count("*").alias("n"))
    return out.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("axis")), 6))


@query(REC + ", x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS value FROM rec" for a in AXIS_NAMES[2:]) + ") SELECT axis, count(*) FILTER (value = 'UNKNOWN') AS n_unknown, count(*) FILTER (value = 'UNDETERMINED') AS n_undetermined, round(count(*) FILTER (value IN ('UNKNOWN', 'UNDETERMINED')) / count(*), 6) AS rate FROM x GROUP BY axis")
def unknown_rates(spark, sf):
    stacked = records(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXIS_NAMES[2:]])).alias("x")).select("x.*")
    u, d = (F.count(F.when(F.col("value") == v, 1)) for v in ("UNKNOWN", "UNDETERMINED"))
    return stacked.groupBy("axis").agg(u.alias("n_unknown"), d.alias("n_undetermined"), F.round((u + d) / F.count("*"), 6).alias("rate"))


@query("SELECT count(*) AS n, min(n_chars) AS least, round(avg(n_chars), 6) AS mean, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95, max(n_chars) AS most FROM documents")
def length_summary(spark, sf):
    return t(spark, sf, "documents").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 6).alias("mean"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY n_chars)").alias("median"), F.expr("CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS DOUBLE)").alias("p95"), F.max("n_chars").alias("most"))


@query("SELECT lang, " + ", ".join(f"CAST(quantile_disc(n_chars, {q}) AS DOUBLE) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) + " FROM documents GROUP BY lang")
def length_percentiles(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(*[F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY n_chars) AS DOUBLE)").alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)])


@query("SELECT source, lang, GROUPING(source) + 2 * GROUPING(lang) AS level, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((), (source), (lang), (source, lang))")
def grouping_sets_counts(spark, sf):
    return t(spark, sf, "documents").cube("source", "lang").agg((F.grouping("source") + 2 * F.grouping("lang")).cast("long").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CASE WHEN len(x) = 0 THEN 'NONE' ELSE v END AS label, count(*) AS n FROM (SELECT x, unnest(CASE WHEN len(x) = 0 THEN ['NONE'] ELSE x END) AS v FROM (SELECT list_filter([CASE WHEN toxic = 1 THEN 'TOXIC' END, CASE WHEN quality = 0 THEN 'LOW_QUALITY' END], lambda z: z IS NOT NULL) AS x FROM labels)) GROUP BY 1")
def multi_label_counts(spark, sf):
    x = F.array_compact(F.array(F.when(F.col("toxic") == 1, "TOXIC"), F.when(F.col("quality") == 0, "LOW_QUALITY")))
    return t(spark, sf, "labels").select(F.explode(F.when(F.size(x) == 0, F.array(F.lit("NONE"))).otherwise(F.array_distinct(x))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# --- splits ---------------------------------------------------------------------------

RATIOS = {"TRAIN": 0.7, "VALIDATION": 0.15, "TEST_ID": 0.15}
DRAW = "CAST(('0x' || substr(sha256('{\"seed\":3202,\"semantic_cluster_id\":\"' || exact_key || '\"}'), 1, 13)) AS BIGINT) / 4503599627370496.0"
SPLIT = EXACT + f", k AS (SELECT *, bool_or(source = 'src7') OVER (PARTITION BY exact_key) AS held, {DRAW} AS draw FROM e), sp AS (SELECT *, CASE WHEN id <> exact_first THEN 'DROPPED_EXACT' WHEN held THEN 'TEST_SOURCE_OOD' WHEN draw < 0.7 THEN 'TRAIN' WHEN draw < 0.7 + 0.15 THEN 'VALIDATION' ELSE 'TEST_ID' END AS split FROM k)"


@query(EXACT + f", k AS (SELECT DISTINCT exact_key, {DRAW} AS draw FROM e) SELECT exact_key AS cluster, CASE WHEN draw < 0.7 THEN 'TRAIN' WHEN draw < 0.7 + 0.15 THEN 'VALIDATION' ELSE 'TEST_ID' END AS split FROM k")
def split_hash_ratio(spark, sf):
    return exact(spark, sf).select(F.col("exact_key").alias("cluster")).distinct().withColumn("split", selection.ratio_split(F.col("cluster"), SEED, RATIOS))


def with_splits(spark: SparkSession, sf: str) -> DataFrame:
    return selection.cluster_splits(exact(spark, sf).withColumnRenamed("exact_key", "cluster"), SEED, RATIOS, F.col("source") == "src7")


@query(SPLIT + " SELECT id, exact_key AS cluster, split FROM sp")
def split_with_holdouts(spark, sf):
    return with_splits(spark, sf).select("id", "cluster", "split")


@query(SPLIT + " SELECT split, lang, count(*) AS n FROM sp GROUP BY ALL")
def split_distribution(spark, sf):
    return with_splits(spark, sf).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(SPLIT + ", k2 AS (SELECT 'hash' AS field, hash AS value, split FROM sp WHERE split <> 'DROPPED_EXACT' UNION ALL SELECT 'source', source, split FROM sp WHERE split <> 'DROPPED_EXACT') SELECT field, value, count(DISTINCT split) AS n_splits FROM k2 GROUP BY ALL HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf):
    kept = with_splits(spark, sf).filter("split != 'DROPPED_EXACT'")
    stacked = kept.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("hash", "source")])).alias("x")).select("split", "x.*")
    return stacked.groupBy("field", "value").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


@query()
def components(spark, sf):
    o = t(spark, sf, "orders")
    one = o.select(F.col("o_orderkey").alias("node"), F.concat(F.lit("c"), "o_custkey").alias("key"))
    two = o.select(F.col("o_orderkey").alias("node"), F.concat(F.lit("d"), F.col("o_orderdate").cast("date")).alias("key"))
    return dedup.components(one.unionByName(two))


@query("WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS \"group\", count(*) AS size FROM orders GROUP BY 1), r AS (SELECT *, sum(size) OVER (ORDER BY sha256('3202:policy:' || \"group\"), \"group\") - size AS before FROM g) SELECT \"group\", size, before < (SELECT 0.2 * sum(size) FROM g) AS taken FROM r")
def policy_take(spark, sf):
    groups = t(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("group")).agg(F.count("*").alias("size"))
    target = groups.agg(F.sum("size")).first()[0] * 0.2
    return selection.take_to_target(groups, F.lit(target), SEED, "policy")


@query("WITH w AS (SELECT n_name AS key, count(*) AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), q AS (SELECT *, CAST(floor(weight * 1000 / (SELECT sum(weight) FROM w)) AS BIGINT) AS f, weight * 1000 % (SELECT sum(weight) FROM w) AS rest FROM w), z AS (SELECT *, row_number() OVER (ORDER BY rest DESC, key) AS rn, 1000 - sum(f) OVER () AS left_ FROM q) SELECT key, CAST(f + CASE WHEN rn <= left_ THEN 1 ELSE 0 END AS BIGINT) AS quota FROM z")
def apportion_quota(spark, sf):
    w = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("weight"))
    return selection.apportion(w, 1000)


@query("WITH c AS (SELECT DISTINCT source FROM documents), l AS (SELECT DISTINCT lang FROM documents), p AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 5000) SELECT c.source, l.lang FROM c, l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = c.source AND p.lang = l.lang)")
def coverage_gaps(spark, sf):
    d = t(spark, sf, "documents")
    cells = d.select("source").distinct().crossJoin(d.select("lang").distinct())
    return cells.join(d.filter("n_chars > 5000").select("source", "lang").distinct(), ["source", "lang"], "left_anti")


@query(EXACT + ", r AS (SELECT *, row_number() OVER (PARTITION BY exact_key ORDER BY sha256('3401:gold:' || id), id) AS rn FROM e) SELECT exact_key, id, lang FROM r WHERE rn = 1")
def gold_selection(spark, sf):
    return selection.one_per_group(exact(spark, sf).select("exact_key", "id", "lang"), "exact_key", 3401, "gold")


@query(REC + ", c AS (SELECT id FROM rec WHERE quality = 0), b AS (SELECT id, printf('candidate_%04d', row_number() OVER (ORDER BY id)) AS blind FROM c) SELECT blind, a.annotator, row_number() OVER (PARTITION BY a.annotator ORDER BY sha256('3401:' || a.annotator || ':' || blind)) AS place FROM b, (SELECT unnest(['A', 'B']) AS annotator) a")
def blinded_packets(spark, sf):
    low = records(spark, sf).filter("quality = 0").select("id")
    blind = selection.placed(low, F.col("id")).select(F.format_string("candidate_%04d", "place").alias("blind"))
    packet = lambda who: selection.placed(blind, F.sha2(F.concat_ws(":", F.lit("3401"), F.lit(who), "blind"), 256)).select("blind", F.lit(who).alias("annotator"), "place")
    return packet("A").unionByName(packet("B"))


@query("WITH x AS (SELECT doc_id, doc_id % 5 <> 0 AS in_a, doc_id % 3 <> 0 AS in_b, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic ELSE toxic END AS other FROM labels) SELECT doc_id, CASE WHEN NOT in_a OR NOT in_b THEN 'INCOMPLETE' WHEN toxic IS NOT DISTINCT FROM other THEN 'AGREED' ELSE 'DISAGREEMENT' END AS state FROM x")
def adjudication(spark, sf):
    labels, d = t(spark, sf, "labels"), F.col("doc_id")
    a = labels.select("doc_id", F.when(d % 5 != 0, F.struct("quality", "toxic")).alias("a"))  # an annotation that is missing is null
    b = labels.select("doc_id", F.when(d % 3 != 0, F.struct("quality", F.when(d % 7 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))).alias("b"))
    return a.join(b, "doc_id", "full").select("doc_id", F.when(F.col("a").isNull() | F.col("b").isNull(), "INCOMPLETE").when(F.col("a").eqNullSafe(F.col("b")), "AGREED").otherwise("DISAGREEMENT").alias("state"))


# --- metrics ---------------------------------------------------------------------------

SCORE = "WITH m AS (SELECT doc_id, toxic AS truth, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 4)) AS BIGINT) % 101 / 100.0 AS score FROM labels), p AS (SELECT *, CAST(score >= 0.5 AS INT) AS pred FROM m)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    s = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 4), 16, 10).cast("long") % 101 / F.lit(100.0)
    return t(spark, sf, "labels").select("doc_id", F.col("toxic").alias("truth"), s.alias("score")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query(SCORE + " SELECT a.v AS truth, b.v AS pred, count(p.doc_id) AS n FROM (SELECT unnest([0, 1]) AS v) a CROSS JOIN (SELECT unnest([0, 1]) AS v) b LEFT JOIN p ON truth = a.v AND pred = b.v GROUP BY ALL")
def confusion(spark, sf):
    return metrics.confusion(scores(spark, sf), [0, 1])


@query(SCORE + ", c AS (SELECT v AS label, count(*) FILTER (truth = v) AS support, count(*) FILTER (pred = v) AS said, count(*) FILTER (truth = v AND pred = v) AS tp FROM p, (SELECT unnest([0, 1]) AS v) GROUP BY v) SELECT label, support, CASE WHEN said > 0 THEN tp / said ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, 2 * tp / (support + said) AS f1 FROM c")
def single_label_metrics(spark, sf):
    return metrics.per_class(metrics.confusion(scores(spark, sf), [0, 1]))


@query(SCORE + ", c AS (SELECT CAST(count(*) FILTER (truth = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (truth = 0 AND pred = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (truth = 0 AND pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (truth = 1 AND pred = 0) AS DOUBLE) AS fn FROM p) SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc, (tp + tn) / (tp + tn + fp + fn) AS accuracy, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr FROM c")
def mcc(spark, sf):
    n = lambda a, b: F.count(F.when((F.col("truth") == a) & (F.col("pred") == b), 1)).cast("double")
    c = scores(spark, sf).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    return c.select(F.expr("round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9)").alias("mcc"), F.expr("(tp + tn) / (tp + tn + fp + fn)").alias("accuracy"), F.expr("fp / (fp + tn)").alias("fpr"), F.expr("fn / (fn + tp)").alias("fnr"))


CURVE = SCORE + ", b AS (SELECT score, sum(truth) AS t, count(*) AS k FROM m GROUP BY score), cv AS (SELECT score, t, k - t AS f, sum(t) OVER w AS tp, sum(k) OVER w - sum(t) OVER w AS fp FROM b WINDOW w AS (ORDER BY score DESC))"


@query(CURVE + " SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / (tp + fp) AS precision FROM cv")
def pr_curve(spark, sf):
    return metrics.curve(scores(spark, sf)).select("score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


@query(CURVE + " SELECT round(sum(t * tp / (tp + fp)) / sum(t), 9) AS average_precision FROM cv")
def average_precision(spark, sf):
    return metrics.average_precision(scores(spark, sf)).select(F.round("average_precision", 9).alias("average_precision"))


@query(CURVE + " SELECT round(sum(f * (tp - t / 2)) / nullif(sum(t) * sum(f), 0), 9) AS roc_auc FROM cv")
def roc_auc(spark, sf):
    return metrics.roc_auc(scores(spark, sf)).select(F.round("roc_auc", 9).alias("roc_auc"))


EDGES = "CASE " + " ".join(f"WHEN score < {e!r} THEN {i}" for i, e in enumerate((0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9))) + " ELSE 9 END"


@query(SCORE.replace("/ 100.0", "/ CAST(100 AS DOUBLE)") + f", b AS (SELECT {EDGES} AS bin, score, truth FROM m), g AS (SELECT bin, count(*) AS n, avg(score) AS conf, avg(truth) AS acc FROM b GROUP BY bin) SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) AS ece, (SELECT round(avg((score - truth) * (score - truth)), 9) FROM m) AS brier FROM g")
def ece_brier(spark, sf):
    s = scores(spark, sf).withColumn("bin", F.expr(EDGES))
    g = s.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg("truth").alias("acc"), F.sum((F.col("score") - F.col("truth")) * (F.col("score") - F.col("truth"))).alias("sq"))
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 9).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 9).alias("brier"))


@query(SCORE + ", g AS (SELECT (unnest(range(10, 91)) / 100.0) AS th), c AS (SELECT th, count(*) FILTER (truth = 1 AND score >= th) AS tp, count(*) FILTER (score >= th) AS said, count(*) FILTER (truth = 1) AS pos FROM g, m GROUP BY th) SELECT th, 2.0 * tp / (said + pos) AS f1 FROM c ORDER BY f1 DESC, th LIMIT 1")
def threshold_grid(spark, sf):
    by = scores(spark, sf).groupBy("score").agg(F.sum("truth").alias("t"), F.count("*").alias("k"))  # a row a distinct score meets the grid
    grid = spark.range(10, 91).select((F.col("id") / 100.0).alias("th"))
    c = grid.crossJoin(by).groupBy("th").agg(F.sum(F.when(F.col("score") >= F.col("th"), F.col("t")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") >= F.col("th"), F.col("k")).otherwise(0)).alias("said"), F.sum("t").alias("pos"))
    return c.select("th", (2 * F.col("tp") / (F.col("said") + F.col("pos"))).alias("f1")).orderBy(F.desc("f1"), "th").limit(1)


@query(SCORE + " SELECT lang, source, count(*) FILTER (truth = 0) AS negatives, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 0 AND pred = 1) / nullif(count(*) FILTER (truth = 0), 0) AS fpr FROM p JOIN documents USING (doc_id) GROUP BY lang, source")
def hard_negative_fpr(spark, sf):
    d = scores(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    neg, fp = F.count(F.when(F.col("truth") == 0, 1)), F.count(F.when((F.col("truth") == 0) & (F.col("pred") == 1), 1))
    return d.groupBy("lang", "source").agg(neg.alias("negatives"), fp.alias("fp"), (fp / F.nullif(neg, F.lit(0))).alias("fpr"))


@query(SCORE + ", s AS (SELECT lang, avg(CAST(truth = pred AS INT)) AS accuracy, count(*) AS n FROM p JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))) SELECT coalesce(lang, 'ALL') AS stratum, n, round(accuracy, 9) AS accuracy FROM s")
def stratified_metrics(spark, sf):
    d = scores(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return d.rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 9).alias("accuracy")).select(F.coalesce("lang", F.lit("ALL")).alias("stratum"), "n", "accuracy")


@query(SCORE + ", s AS (SELECT lang, avg(CAST(truth = pred AS INT)) AS a FROM p JOIN documents USING (doc_id) GROUP BY lang) SELECT x.lang, round(x.a - y.a, 9) AS gap FROM s x, s y WHERE y.lang = 'en' AND x.lang <> 'en'")
def language_gap(spark, sf):
    d = scores(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    s = d.groupBy("lang").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("a"))
    return s.filter("lang != 'en'").crossJoin(s.filter("lang = 'en'").select(F.col("a").alias("b"))).select("lang", F.round(F.col("a") - F.col("b"), 9).alias("gap"))


@query("SELECT toxic AS label, count(*) AS n, least(greatest((SELECT count(*) FROM labels) / (2.0 * count(*)), 0.25), 4.0) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, sf):
    g = t(spark, sf, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"))
    return g.select("label", "n", F.least(F.greatest(F.sum("n").over(Window.partitionBy()) / (2.0 * F.col("n")), F.lit(0.25)), F.lit(4.0)).alias("weight"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, least(greatest(sqrt(max(n) OVER () / n) * CASE WHEN source = 'src3' THEN 1.25 ELSE 1 END, 1), 3) AS weight FROM c")
def sampling_weights(spark, sf):
    c = t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.select("source", "n", F.least(F.greatest(F.sqrt(F.max("n").over(Window.partitionBy()) / F.col("n")) * F.when(F.col("source") == "src3", 1.25).otherwise(1.0), F.lit(1.0)), F.lit(3.0)).alias("weight"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS pred, label FROM embeddings")
def softmax_argmax(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", text.argmax(text.softmax(F.col("embedding"))).alias("pred"), "label")


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS x FROM embeddings), p AS (SELECT vec_id, list_transform(x, lambda v: greatest(v / list_sum(x), 1e-8)) AS p FROM e), q AS (SELECT vec_id, p, greatest(1.0 / len(p), 1e-8) AS u FROM p) SELECT vec_id, round(list_sum(list_transform(p, lambda a: (a * ln(a / ((a + u) / 2)) + u * ln(u / ((a + u) / 2))) / 2)), 6) AS divergence FROM q")
def js_divergence(spark, sf):
    p = text.softmax(F.col("embedding"))
    return t(spark, sf, "embeddings").select("vec_id", F.round(text.js_divergence(p, F.transform(p, lambda v: F.lit(1.0) / F.size(F.col("embedding")))), 6).alias("divergence"))


# --- conversations, text checks, sources -------------------------------------------------


@query("WITH p AS (SELECT conv_id, turn // 2 AS pair, max(text) FILTER (role = 'user') AS parent, max(text) FILTER (role = 'assistant') AS sibling, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, pair, n, parent IS NOT NULL AND sibling IS NOT NULL AS complete, coalesce(length(sibling), 0) - coalesce(length(parent), 0) AS change FROM p")
def counterfactual_pairs(spark, sf):
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("text")))
    p = t(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(side("user").alias("parent"), side("assistant").alias("sibling"), F.count("*").alias("n"))
    return p.select("conv_id", "pair", "n", (F.col("parent").isNotNull() & F.col("sibling").isNotNull()).alias("complete"), (F.coalesce(F.length("sibling"), F.lit(0)) - F.coalesce(F.length("parent"), F.lit(0))).cast("long").alias("change"))


@query("WITH c AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT role, next, count(*) AS n FROM c WHERE next IS NOT NULL GROUP BY ALL")
def transition_matrix(spark, sf):
    c = t(spark, sf, "conversations").select("role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next"))
    return c.filter("next is not null").groupBy("role", "next").agg(F.count("*").alias("n"))


@query("WITH u AS (SELECT conv_id, sha256(string_agg(text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY 1) SELECT conv_id, min(conv_id) OVER (PARTITION BY h) AS representative, conv_id = min(conv_id) OVER (PARTITION BY h) AS kept FROM u")
def atomic_unit_dedup(spark, sf):
    u = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "|"), 256).alias("h"))
    first = u.groupBy("h").agg(F.min("conv_id").alias("representative"))
    return u.join(first, "h").select("conv_id", "representative", (F.col("conv_id") == F.col("representative")).alias("kept"))


@query("SELECT doc_id, strpos(text, 'th') - 1 AS first, CASE WHEN strpos(text, 'th') = 0 THEN -1 WHEN strpos(substr(text, strpos(text, 'th') + 1), 'th') = 0 THEN -1 ELSE strpos(text, 'th') + strpos(substr(text, strpos(text, 'th') + 1), 'th') - 1 END AS second FROM documents")
def nth_occurrence(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.nth_occurrence(F.col("text"), "th", 0).alias("first"), text.nth_occurrence(F.col("text"), "th", 1).alias("second"))


@query("WITH w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS k FROM documents), c AS (SELECT *, len(list_filter(k, lambda x: x IN ('the', 'and', 'of', 'to', 'that'))) AS en, len(list_filter(k, lambda x: x IN ('le', 'la', 'les', 'des', 'et'))) AS fr FROM w) SELECT doc_id, en, fr, CASE WHEN lang = 'en' THEN fr >= 3 AND fr >= en + 2 WHEN lang = 'fr' THEN en >= 3 AND en >= fr + 2 ELSE false END AS mismatch FROM c")
def language_mismatch(spark, sf):
    k = text.tokens(F.lower("text"))
    hits = lambda *w: F.size(F.filter(k, lambda x: x.isin(*w))).cast("long")
    c = t(spark, sf, "documents").select("doc_id", "lang", hits("the", "and", "of", "to", "that").alias("en"), hits("le", "la", "les", "des", "et").alias("fr"))
    en, fr = F.col("en"), F.col("fr")
    return c.select("doc_id", "en", "fr", F.when(F.col("lang") == "en", (fr >= 3) & (fr >= en + 2)).when(F.col("lang") == "fr", (en >= 3) & (en >= fr + 2)).otherwise(False).alias("mismatch"))


@query(r"WITH u AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'https?://[^\s\"''<>]+')) AS x, url FROM pages) SELECT page_id, len(list_filter(x, lambda v: v <> url)) AS foreign_urls FROM u")
def url_whitelist(spark, sf):
    found = F.regexp_extract_all("html", F.lit("https?://[^\\s\"'<>]+"), F.lit(0))
    return t(spark, sf, "pages").select("page_id", F.size(F.array_except(found, F.array("url"))).cast("long").alias("foreign_urls"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_paths(spark, sf):
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return t(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT page_id, string_split(url, '/') AS parts FROM pages) SELECT page_id, i - 1 AS pos, parts[i] AS part, sha256(page_id || ':' || (i - 1)) AS source_id FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM w)")
def nested_explode_import(spark, sf):
    e = t(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("pos", "part"))
    return e.select("page_id", F.col("pos").cast("long").alias("pos"), "part", F.sha2(F.concat_ws(":", "page_id", "pos"), 256).alias("source_id"))


@query("WITH a AS (SELECT DISTINCT event_type FROM events), b AS (SELECT DISTINCT r_name FROM region) SELECT event_type, r_name, sha256(event_type || '|' || r_name) AS case_id FROM a, b")
def cross_product_complete(spark, sf):
    a, b = t(spark, sf, "events").select("event_type").distinct(), t(spark, sf, "region").select("r_name").distinct()
    return a.crossJoin(b).select("event_type", "r_name", F.sha2(F.concat_ws("|", "event_type", "r_name"), 256).alias("case_id"))


@query("SELECT doc_id, item_id FROM (SELECT d.doc_id, b.item_id, (length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS k FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE k = 1")
def payload_once(spark, sf):
    d, b = t(spark, sf, "documents"), t(spark, sf, "benchmark").select("item_id", F.col("text").alias("payload"))
    # words 2 to 4 of a payload of five words or more are whole words of the text: looked up in its runs of three, an equi-join whatever the number of payloads
    flat = F.split(F.regexp_replace("payload", "\n", " "), " ")
    long, short = b.filter(F.size(flat) >= 5), b.filter((F.size(flat) < 5) & (F.col("payload") != ""))
    words = d.select("doc_id", "text", F.split(F.regexp_replace("text", "\n", " "), " ").alias("w"))
    key = lambda w, i: F.array_join(F.slice(w, i, 3), " ")
    runs = words.filter(F.size("w") >= 3).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(key(F.col("w"), i))))).alias("h"))
    inner = long.select("item_id", "payload", F.xxhash64(key(flat, 2)).alias("h"))
    near = runs.join(inner, "h").select("doc_id", "item_id", "payload").distinct().join(d.select("doc_id", "text"), "doc_id")
    # shorter ones may begin and end inside words: each is held against every text
    every = d.select("doc_id", "text").join(short, F.contains("text", F.col("payload"))).select("doc_id", "item_id", "payload", "text")
    return near.select(*every.columns).unionByName(every).filter(F.contains("text", F.col("payload")) & (F.length("text") - F.length(F.replace("text", F.col("payload"), F.lit(""))) == F.length("payload"))).select("doc_id", "item_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def usage_costs(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"), F.count_distinct("user_id").alias("users"))


@query("WITH r AS (SELECT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'DENY' ELSE 'ALLOW' END AS effect FROM lineitem) SELECT l_suppkey, l_partkey FROM r GROUP BY ALL HAVING count(DISTINCT effect) > 1")
def policy_contradictions(spark, sf):
    r = t(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("deny"))
    return r.groupBy("l_suppkey", "l_partkey").agg(F.bool_or("deny").alias("some"), F.bool_and("deny").alias("all")).filter("some and not all").select("l_suppkey", "l_partkey")


@query("WITH c AS (SELECT c_custkey, c_nationkey FROM customer), o AS (SELECT DISTINCT o_custkey FROM orders) SELECT c_nationkey, count(*) FILTER (o_custkey IS NOT NULL) AS matched, count(*) FILTER (o_custkey IS NULL) AS missing FROM c LEFT JOIN o ON o_custkey = c_custkey GROUP BY c_nationkey")
def required_lookup(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left")
    return c.groupBy("c_nationkey").agg(F.count("hit").alias("matched"), (F.count("*") - F.count("hit")).alias("missing"))


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS missing, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS shared")
def key_set_overlap(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.subtract(o).agg(F.count("*").alias("missing")).crossJoin(c.intersect(o).agg(F.count("*").alias("shared")))
