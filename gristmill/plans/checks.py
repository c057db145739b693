"""Queries of record checks, importers, policy rules, splits and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import dedup, selection
from .catalogue import REC, SPLIT, VERDICT, query, records, t, verdicts, with_splits

# --- records and their checks ------------------------------------------------------------

#: What the test tables lack: stored verdicts and families of which some break a rule.
STORED = f"CASE WHEN doc_id % 17 = 0 THEN 'DETECTED' ELSE {VERDICT} END"
FAMILIES = "CASE WHEN toxic = 1 AND doc_id % 5 = 0 THEN ['OTHER_PROMPT_ATTACK', 'PROMPT_INJECTION'] WHEN toxic = 1 THEN ['PROMPT_INJECTION'] WHEN doc_id % 19 = 0 THEN ['OTHER_PROMPT_ATTACK'] ELSE [] END"


def annotated(spark, sf):
    v = verdicts(records(spark, sf))
    none = F.array().cast("array<string>")
    bad = F.array(F.lit("OTHER_PROMPT_ATTACK"), F.lit("PROMPT_INJECTION"))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    fam = F.when(toxic & (F.col("doc_id") % 5 == 0), bad).when(toxic, F.array(F.lit("PROMPT_INJECTION"))).when(F.col("doc_id") % 19 == 0, F.array(F.lit("OTHER_PROMPT_ATTACK"))).otherwise(none)
    return v.withColumn("families", fam).withColumn("stored", F.when(F.col("doc_id") % 17 == 0, "DETECTED").otherwise(F.col("verdict")))


@query(REC + f", a AS (SELECT *, {VERDICT} AS verdict, {STORED} AS stored, {FAMILIES} AS families FROM rec), e AS (SELECT id, list_filter([CASE WHEN presence = 'NO_INSTRUCTION' AND (presentation <> 'NOT_APPLICABLE' OR addressee <> 'NOT_APPLICABLE' OR authority <> 'NOT_APPLICABLE') THEN 'annotations.axes: not applicable without an instruction' END, CASE WHEN presence = 'NO_INSTRUCTION' AND len(families) > 0 THEN 'annotations.families: must be empty without an instruction' END, CASE WHEN list_contains(families, 'OTHER_PROMPT_ATTACK') AND len(families) <> 1 THEN 'annotations.families: the fallback must stand alone' END, CASE WHEN stored <> verdict THEN 'annotations.verdict: differs from the one derived, ' || verdict END, CASE WHEN coalesce(text, '') = '' THEN 'content.text: must not be empty' END], lambda x: x IS NOT NULL) AS errors FROM a) SELECT id, array_to_string(list_sort(list_distinct(errors)), '; ') AS errors FROM e WHERE len(errors) > 0")
def record_errors(spark, sf):
    a = annotated(spark, sf)
    out = a.select("id", rules.record_errors(F.col("presence"), [F.col(c) for c in ("presentation", "addressee", "authority")], F.col("families"), F.col("stored"), F.col("verdict"), F.col("text")).alias("errors"))
    return out.filter(F.size("errors") > 0).select("id", F.array_join("errors", "; ").alias("errors"))


MAPPING = "CASE WHEN quality = 1 THEN 'DETERMINISTIC' WHEN quality = 0 THEN 'NEEDS_REVIEW' ELSE 'UNMAPPED' END AS status_, CASE WHEN doc_id % 6 = 0 THEN ['goal'] ELSE [] END AS unmapped, CASE WHEN quality = 0 AND doc_id % 4 <> 0 THEN ['ambiguous'] ELSE [] END AS reasons"


@query(REC + f", m AS (SELECT id, {MAPPING} FROM rec) SELECT id, CASE WHEN status_ = 'DETERMINISTIC' AND (len(unmapped) > 0 OR len(reasons) > 0) THEN 'DETERMINISTIC_WITH_OPEN_FIELDS' WHEN status_ = 'NEEDS_REVIEW' AND len(reasons) = 0 THEN 'REVIEW_WITHOUT_REASON' WHEN status_ = 'UNMAPPED' AND len(unmapped) = 0 THEN 'UNMAPPED_WITHOUT_FIELDS' END AS error FROM m")
def mapping_errors(spark, sf):
    none = F.array().cast("array<string>")
    q, d = F.col("quality"), F.col("doc_id")
    m = records(spark, sf).select("id", F.when(q == 1, "DETERMINISTIC").when(q == 0, "NEEDS_REVIEW").otherwise("UNMAPPED").alias("s"), F.when(d % 6 == 0, F.array(F.lit("goal"))).otherwise(none).alias("unmapped"), F.when((q == 0) & (d % 4 != 0), F.array(F.lit("ambiguous"))).otherwise(none).alias("reasons"))
    return m.select("id", rules.mapping_error(F.col("s"), F.col("unmapped"), F.col("reasons")).alias("error"))


@query(REC + ", c AS (SELECT id, sha256(text) AS now, CASE WHEN doc_id % 10 = 0 THEN sha256('old' || text) ELSE sha256(text) END AS stored, CASE WHEN doc_id % 7 <> 0 THEN sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') ELSE 'none' END AS original, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS fields FROM rec) SELECT id, now = stored AS text_ok, original = fields AS original_ok FROM c")
def checksum_checks(spark, sf):
    stored = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat(F.lit("old"), "text"), 256)).otherwise(F.sha2("text", 256))
    fields = F.sha2(F.to_json(F.struct("lang", "source")), 256)
    original = F.when(F.col("doc_id") % 7 != 0, fields).otherwise("none")
    return records(spark, sf).select("id", (F.sha2("text", 256) == stored).alias("text_ok"), (original == fields).alias("original_ok"))


@query(SPLIT + ", r AS (SELECT id, split, CASE WHEN id <> exact_first AND id <> 'doc_00000777' THEN 'DROP_EXACT_DUPLICATE' ELSE 'KEEP' END AS decision, CASE WHEN lang = 'es' THEN source END AS key, CASE WHEN lang IN ('es', 'de') THEN 'SOURCE_TEMPLATE_GROUP' ELSE 'LEXICAL_SIMILARITY' END AS method FROM sp) SELECT count(*) AS n, count(*) FILTER ((decision = 'DROP_EXACT_DUPLICATE') <> (split = 'DROPPED_EXACT')) AS bad_drop, count(*) FILTER ((method = 'SOURCE_TEMPLATE_GROUP') <> (key IS NOT NULL)) AS bad_method FROM r")
def release_errors(spark, sf):
    r = with_splits(spark, sf).select("split", F.when(~F.col("kept") & (F.col("id") != "doc_00000777"), "DROP_EXACT_DUPLICATE").otherwise("KEEP").alias("decision"), F.when(F.col("lang") == "es", F.col("source")).alias("key"), F.when(F.col("lang").isin("es", "de"), "SOURCE_TEMPLATE_GROUP").otherwise("LEXICAL_SIMILARITY").alias("method"))
    drop, method = rules.release_faults(F.col("decision"), F.col("split"), F.col("method"), F.col("key"))
    return r.agg(F.count("*").alias("n"), F.count(F.when(drop, 1)).alias("bad_drop"), F.count(F.when(method, 1)).alias("bad_method"))


IDENTITY = "'{\"artifact\":' || CASE WHEN doc_id % 2 = 0 THEN '\"main.jsonl\"' ELSE 'null' END || ',\"dataset\":\"' || source || '\",\"revision\":\"r1\",\"source_record_id\":\"' || rid || '\",\"split\":\"' || lang || '\",\"version\":null}'"


@query(REC + f", i AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'main:' || n_chars END AS rid FROM rec) SELECT id, rid, 'rec_' || regexp_replace(regexp_replace(lower('Set ' || source || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || substr(sha256({IDENTITY}), 1, 24) AS canonical FROM i")
def canonical_records(spark, sf):
    rid = text.first_present(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")), fallback=F.concat_ws(":", F.lit("main"), "n_chars"))
    parts = {"dataset": F.col("source"), "revision": F.lit("r1"), "version": F.lit(None).cast("string"), "artifact": F.when(F.col("doc_id") % 2 == 0, "main.jsonl"), "split": F.col("lang"), "source_record_id": F.col("rid")}
    return records(spark, sf).withColumn("rid", rid).select("id", "rid", text.canonical_id("rec", F.concat(F.lit("Set "), "source", F.lit("!")), parts).alias("canonical"))


@query("WITH w AS (SELECT doc_id, length(text) AS n, [{'s': doc_id % 50, 'e': doc_id % 50 + 10}, {'s': doc_id % 50 + 2, 'e': doc_id % 50 + (doc_id % 3) * 4 + 2}, {'s': doc_id % 50 + (doc_id % 2) * 2, 'e': doc_id % 50 + 10 + (doc_id % 2)}] AS x FROM documents) SELECT doc_id, list_bool_and(list_transform(x, lambda v: v.s >= 0 AND v.s < v.e AND v.e <= n)) AND len(list_distinct(x)) = len(x) AS valid, len(list_filter(x[2:], lambda v: v.s >= x[1].s AND v.e <= x[1].e)) AS inside FROM w")
def span_checks(spark, sf):
    d = F.col("doc_id")
    a = d % 50
    span = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    x = F.array(span(a, a + 10), span(a + 2, a + (d % 3) * 4 + 2), span(a + (d % 2) * 2, a + 10 + d % 2))
    out = t(spark, sf, "documents").select("doc_id", "text", x.alias("x"))
    return out.select("doc_id", text.valid_spans(F.col("x"), F.col("text")).alias("valid"), F.size(text.contained(F.slice("x", 2, 2), F.slice("x", 1, 1))).cast("long").alias("inside"))


@query("SELECT doc_id, sha256(substr(text, 1, 3) || CASE WHEN length(text) >= 12 THEN '    ' || substr(text, 8, 2) || '   ' || substr(text, 13) ELSE substr(text, 4) END) AS masked FROM documents")
def masked_directives(spark, sf):
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(7).alias("end")), F.struct(F.lit(9).alias("start"), F.lit(12).alias("end")))
    return t(spark, sf, "documents").select("doc_id", F.sha2(F.when(F.length("text") >= 12, text.masked(F.col("text"), spans)).otherwise(F.col("text")), 256).alias("masked"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, len(w) > 20 AS cut, sha256(array_to_string(CASE WHEN len(w) > 20 THEN w[1:14] || w[len(w) - 5:] ELSE w END, ' ')) AS kept FROM w")
def head_tail_tokens(spark, sf):
    w = F.split("text", " ")
    return t(spark, sf, "documents").select("doc_id", (F.size(w) > 20).alias("cut"), F.sha2(F.array_join(text.head_tail(w, 20, 0.7), " "), 256).alias("kept"))


@query("SELECT doc_id, CAST(CAST(('0x' || substr(sha256(source || doc_id), 1, 15)) AS BIGINT) * 16 % 7 + CAST(('0x' || substr(sha256(source || doc_id), 16, 1)) AS BIGINT) AS BIGINT) % 7 AS choice FROM documents".replace("CAST(CAST(('0x' || substr(sha256(source || doc_id), 1, 15)) AS BIGINT) * 16 % 7", "CAST((CAST(('0x' || substr(sha256(source || doc_id), 1, 15)) AS BIGINT) % 7) * 16 % 7"))
def hash_choices(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.hash_choice(F.concat("source", F.col("doc_id").cast("string")), 7).cast("long").alias("choice"))


_OPEN, _CLOSE = "\"'(«“[", "\"')»”]"


@query("WITH q AS (SELECT doc_id, strpos(text, 'th') AS pos, text FROM documents), s AS (SELECT doc_id, pos, right(rtrim(substr(text, 1, greatest(pos - 1, 0))), 1) AS l, left(ltrim(substr(text, pos + 2)), 1) AS r FROM q) SELECT doc_id, pos > 0 AND l <> '' AND r <> '' AND strpos('\"''(«“[', l) > 0 AND strpos('\"''(«“[', l) = strpos('\"'')»”]', r) AS quoted FROM s")
def quote_enclosure(spark, sf):
    at = F.locate("th", F.col("text"))
    return t(spark, sf, "documents").select("doc_id", (at > 0).alias("has"), text.quoted(F.col("text"), at - 1, at + 1, _OPEN, _CLOSE).alias("q")).select("doc_id", (F.col("has") & F.col("q")).alias("quoted"))


@query("SELECT page_id, regexp_matches(html, '(?i)\\b(DETECTED|NOT_DETECTED|user_goal_alignment|href|class)\\b') AS leaks, replace(replace(replace(substr(html, 1, 80), '\\', '\\\\'), '|', '\\|'), chr(10), ' ') AS cell, printf('%.2f%%', CAST(100.0 * (page_id % 8) / 8 AS DOUBLE)) AS share FROM pages")
def report_cells(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", text.leaks(F.col("html"), ["DETECTED", "NOT_DETECTED", "user_goal_alignment", "href", "class"]).alias("leaks"), text.cell(F.substring("html", 1, 80)).alias("cell"), text.percent(F.col("page_id") % 8, F.lit(8)).alias("share"))


@query(REC + " SELECT id, sha256('<policy>' || chr(10) || coalesce(policy, '[MISSING]') || chr(10) || '</policy>' || chr(10) || '<confidence>' || chr(10) || coalesce(CAST(CAST(confidence * 10000 AS BIGINT) AS VARCHAR), '[MISSING]') || chr(10) || '</confidence>' || chr(10) || '<text>' || chr(10) || coalesce(text, '[MISSING]') || chr(10) || '</text>') AS context, 'semantic_' || substr(sha256(id), 1, 24) AS cluster FROM rec")
def context_blocks(spark, sf):
    parts = {"policy": F.col("policy"), "confidence": (F.col("confidence") * 10000).cast("long").cast("string"), "text": F.col("text")}
    return records(spark, sf).select("id", F.sha2(text.sections(parts), 256).alias("context"), text.cluster_id(F.col("id")).alias("cluster"))


CATEGORY = "CASE WHEN presence = 'UNDETERMINED' THEN 'INSUFFICIENT_CONTEXT' WHEN presence = 'NO_INSTRUCTION' THEN 'BENIGN_CONTENT' WHEN presentation = 'QUOTED_OR_REPORTED' THEN 'QUOTED_INSTRUCTION' WHEN addressee = 'HUMAN' THEN 'HUMAN_DIRECTED' WHEN authority = 'SPOOFED' THEN 'SPOOFED_AUTHORITY' WHEN authority = 'WITHIN_AUTHORITY' THEN 'AUTHORIZED_INSTRUCTION' WHEN policy = 'CONFLICTING' THEN 'POLICY_CONFLICT' ELSE 'OTHER_INSTRUCTION' END"


@query(REC + f" SELECT id, {CATEGORY} AS category, array_to_string(list_filter(['EXFILTRATION', 'GOAL_HIJACKING', 'POLICY_BYPASS'], lambda o: CASE o WHEN 'EXFILTRATION' THEN toxic = 1 AND doc_id % 2 = 0 AND authority <> 'WITHIN_AUTHORITY' WHEN 'GOAL_HIJACKING' THEN goal = 'MISALIGNED' WHEN 'POLICY_BYPASS' THEN policy = 'CONFLICTING' END), ',') AS objectives FROM rec")
def category_rules(spark, sf):
    r = records(spark, sf)
    base = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), F.array(F.lit("EXFILTRATION"))).otherwise(F.array().cast("array<string>"))
    objectives = rules.objectives(base, ["EXFILTRATION", "GOAL_HIJACKING", "POLICY_BYPASS"], add={"GOAL_HIJACKING": F.col("goal") == "MISALIGNED", "POLICY_BYPASS": F.col("policy") == "CONFLICTING"}, remove={"EXFILTRATION": F.col("authority") == "WITHIN_AUTHORITY"})
    return r.select("id", rules.category(*[F.col(c) for c in ("presence", "presentation", "addressee", "authority", "policy")]).alias("category"), F.array_join(objectives, ",").alias("objectives"))


@query("WITH c AS (SELECT source, lang, CASE WHEN lang = 'fr' AND CAST(substr(source, 4) AS INT) % 4 = 1 THEN 'unknown' WHEN lang = 'de' THEN 'restricted' ELSE 'allowed' END AS redistribution FROM (SELECT DISTINCT source, lang FROM documents)) SELECT source, bool_or(redistribution = 'unknown') AS blocked, coalesce(string_agg(lang, ',' ORDER BY lang) FILTER (redistribution = 'unknown'), '') AS blockers FROM c GROUP BY source")
def licence_decision(spark, sf):
    c = t(spark, sf, "documents").select("source", "lang").distinct()
    c = c.withColumn("redistribution", F.when((F.col("lang") == "fr") & (F.expr("try_cast(substr(source, 4) AS INT)") % 4 == 1), "unknown").when(F.col("lang") == "de", "restricted").otherwise("allowed"))
    return rules.publication(c, "source", "lang", "redistribution")


# --- importers ----------------------------------------------------------------------------

@query("SELECT r_name || ':' || left(n_name, 1) || ':' || (row_number() OVER (PARTITION BY r_name, left(n_name, 1) ORDER BY n_name) - 1) AS source_id, n_name AS instruction, CASE WHEN r_name < 'B' THEN 'text' ELSE 'code' END AS modality FROM nation JOIN region ON n_regionkey = r_regionkey")
def mapped_arrays_import(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.groupBy("r_name", F.left("n_name", F.lit(1)).alias("domain")).agg(F.array_sort(F.collect_list("n_name")).alias("texts"))  # one map of arrays a file, from 25 names
    files = files.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("domain", "texts"))).alias("m"))
    e = files.select("r_name", F.explode("m").alias("domain", "texts")).select("r_name", "domain", F.posexplode("texts").alias("i", "instruction"))
    return e.select(F.concat_ws(":", "r_name", "domain", "i").alias("source_id"), "instruction", F.when(F.col("r_name") < "B", "text").otherwise("code").alias("modality"))


@query("WITH a AS (SELECT DISTINCT l_returnflag AS attacker FROM lineitem), u AS (SELECT DISTINCT l_linestatus AS u_ser FROM lineitem), o AS (SELECT DISTINCT l_returnflag AS attacker, l_linestatus AS u_ser FROM lineitem) SELECT (SELECT count(*) FROM a, u) AS expected, (SELECT count(*) FROM o) AS observed, (SELECT count(*) FROM (SELECT attacker, u_ser FROM a, u EXCEPT SELECT * FROM o)) AS missing, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT attacker, u_ser FROM a, u)) AS unexpected")
def product_completeness(spark, sf):
    o = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("attacker"), F.col("l_linestatus").alias("user")).distinct()
    return rules.completeness(o, o.select("attacker").distinct(), o.select("user").distinct())


@query("SELECT o_orderkey, c_mktsegment, n_name, array_to_string(list_distinct_ordered, '>') AS capabilities FROM (SELECT o_orderkey, c_mktsegment, n_name, CASE WHEN c_mktsegment = 'BUILDING' THEN ['BUILDING', o_orderstatus] ELSE [c_mktsegment, o_orderstatus, 'BUILDING'] END AS list_distinct_ordered FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)")
def support_table_import(spark, sf):
    cases = t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    users = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = rules.must_match(cases, users, "c_custkey")
    joined = rules.must_match(joined.withColumnRenamed("c_nationkey", "n_nationkey"), t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    tools = F.array_distinct(F.concat(F.array("c_mktsegment"), F.array("o_orderstatus", F.lit("BUILDING"))))
    return joined.select("o_orderkey", "c_mktsegment", "n_name", F.array_join(tools, ">").alias("capabilities"))


@query("SELECT r_name || '/' || a.n_name || '/' || b.n_name AS case_id FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey")
def suite_product_import(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    suites = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list("n_name").alias("user_tasks"), F.collect_list("n_name").alias("injection_tasks"))
    return suites.select("r_name", F.explode("user_tasks").alias("u"), "injection_tasks").select("r_name", "u", F.explode("injection_tasks").alias("i")).select(F.concat_ws("/", "r_name", "u", "i").alias("case_id"))


# --- splits --------------------------------------------------------------------------------

STAGED = "WITH g AS (SELECT o_custkey, c_nationkey AS nation, c_mktsegment AS domain, count(*) AS size FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), tt AS (SELECT sum(size) AS total FROM g), s1 AS (SELECT *, CASE WHEN nation = 6 THEN 'TEST_LANGUAGE_OOD' WHEN domain = 'MACHINERY' AND nation < 12 THEN 'TEST_DOMAIN_OOD' END AS early FROM g), s2 AS (SELECT *, sum(size) OVER (PARTITION BY early IS NULL ORDER BY sha256('3202:policy:' || o_custkey), o_custkey) - size AS before1 FROM s1), s3 AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN before1 < greatest(1, round_even(0.1 * (SELECT total FROM tt), 0)) THEN 'TEST_POLICY_OOD' END AS mid FROM s2), s4 AS (SELECT *, sum(size) OVER (PARTITION BY mid IS NULL ORDER BY sha256('3202:validation:' || o_custkey), o_custkey) - size AS before2 FROM s3), z AS (SELECT o_custkey, size, CASE WHEN mid IS NOT NULL THEN mid WHEN before2 < greatest(1, round_even(0.15 * (SELECT sum(size) FROM s3 WHERE mid IS NULL), 0)) THEN 'VALIDATION' ELSE 'TRAIN' END AS split FROM s4)"


def staged(spark, sf):
    o = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("size"))
    g = o.join(t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey").withColumn("group", F.col("c_custkey").cast("string"))
    out = F.when(F.col("c_nationkey") == 6, "TEST_LANGUAGE_OOD").when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") < 12), "TEST_DOMAIN_OOD")
    total = g.agg(F.sum("size")).first()[0] or 0
    return selection.staged_splits(g.withColumn("split", out), 3202, [("policy", "TEST_POLICY_OOD", 0.1, total), ("validation", "VALIDATION", 0.15, None)], "TRAIN")


@query(STAGED + " SELECT o_custkey, split FROM z")
def staged_splits(spark, sf):
    return staged(spark, sf).select(F.col("c_custkey").alias("o_custkey"), "split")


@query(STAGED + ", w AS (SELECT unnest([{'split': 'TEST_POLICY_OOD', 'share': 0.1}, {'split': 'VALIDATION', 'share': 0.15}, {'split': 'TRAIN', 'share': 0.5}, {'split': 'REVIEW', 'share': 0.05}]) AS w), c AS (SELECT split, sum(size) AS n FROM z GROUP BY split) SELECT w.split AS split, coalesce(n, 0) AS n, n IS NULL AS missing, coalesce(n, 0) < 50 AS underpowered, abs(coalesce(n, 0) - w.share * (SELECT total FROM tt)) > (SELECT max(size) FROM g) AS deviates FROM w LEFT JOIN c ON c.split = w.split")
def split_guards(spark, sf):
    return selection.guards(staged(spark, sf), {"TEST_POLICY_OOD": 0.1, "VALIDATION": 0.15, "TRAIN": 0.5, "REVIEW": 0.05}, 50)


@query(STAGED + " SELECT max(size) AS largest, sum(size) AS active, max(size) > 0.5 * sum(size) AS collapsed FROM z WHERE split <> 'TEST_LANGUAGE_OOD'")
def collapse_guard(spark, sf):
    return staged(spark, sf).filter("split != 'TEST_LANGUAGE_OOD'").agg(F.max("size").alias("largest"), F.sum("size").alias("active"), (F.max("size") > 0.5 * F.sum("size")).alias("collapsed"))


@query(SPLIT + " SELECT (SELECT count(*) FROM sp) AS rows, (SELECT count(DISTINCT id) FROM sp) AS ids, (SELECT count(*) FROM (SELECT id FROM sp GROUP BY id HAVING count(DISTINCT split) > 1)) AS in_two, (SELECT count(*) FROM documents WHERE printf('doc_%08d', doc_id) NOT IN (SELECT id FROM sp)) AS uncovered")
def set_partition(spark, sf):
    sp, want = with_splits(spark, sf).select("id", "split"), records(spark, sf).select("id")
    per = sp.groupBy("id").agg(F.count("*").alias("k"), F.count_distinct("split").alias("s")).agg(F.sum("k").alias("rows"), F.count("*").alias("ids"), F.count(F.when(F.col("s") > 1, 1)).alias("in_two"))
    return per.join(want.join(sp, "id", "left_anti").agg(F.count("*").alias("uncovered")))


@query("WITH RECURSIVE s AS (SELECT DISTINCT source AS c, lang || ':' || (n_chars % 5) AS f FROM documents WHERE source <> 'src0' AND n_chars % 3 = 0), r(c) AS (SELECT DISTINCT c FROM s WHERE f = 'fr:0' UNION SELECT s2.c FROM r JOIN s s1 ON s1.c = r.c JOIN s s2 ON s2.f = s1.f) SELECT c AS cluster FROM r")
def family_closure(spark, sf):
    d = t(spark, sf, "documents").filter("source != 'src0' and n_chars % 3 = 0").select(F.col("source").alias("node"), F.concat_ws(":", "lang", F.col("n_chars") % 5).alias("key"))
    return dedup.closure(d, F.col("key") == "fr:0").select(F.col("node").alias("cluster"))


@query(SPLIT + ", p AS (SELECT split, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'a' || (doc_id % 40) END, CASE WHEN doc_id % 3 = 1 THEN 'b' || (doc_id % 90) END) AS parent FROM sp WHERE split <> 'DROPPED_EXACT') SELECT parent, count(DISTINCT split) AS n_splits FROM p WHERE parent IS NOT NULL GROUP BY parent HAVING count(DISTINCT split) > 1")
def parent_leakage(spark, sf):
    d = F.col("doc_id")
    parent = text.first_present(F.when(d % 3 == 0, F.concat(F.lit("a"), (d % 40).cast("string"))), F.when(d % 3 == 1, F.concat(F.lit("b"), (d % 90).cast("string"))))
    p = with_splits(spark, sf).filter("split != 'DROPPED_EXACT'").select("split", parent.alias("parent")).filter("parent is not null")
    return p.groupBy("parent").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


@query(SPLIT + ", v AS (SELECT DISTINCT source, split FROM sp), tr AS (SELECT source FROM v WHERE split = 'TRAIN') SELECT split, count(*) AS n, string_agg(source, ',' ORDER BY source) AS sources FROM v WHERE split <> 'TRAIN' AND source IN (SELECT source FROM tr) GROUP BY split")
def train_overlap(spark, sf):
    v = with_splits(spark, sf).select("source", "split").distinct()
    met = v.filter("split != 'TRAIN'").join(v.filter("split = 'TRAIN'").select("source"), "source", "left_semi")
    return met.groupBy("split").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


# --- order and reports -----------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id, source, n_chars % 50 AS score FROM documents) SELECT doc_id, row_number() OVER (ORDER BY score DESC, printf('doc_%08d', doc_id)) AS place FROM r")
def priority_ranking(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 50).alias("score"))
    return selection.placed(d, -F.col("score"), F.format_string("doc_%08d", "doc_id")).select("doc_id", "place")


@query(REC + ", q AS (SELECT id, source FROM rec WHERE manual OR confidence IS NULL) SELECT id, row_number() OVER (ORDER BY source, id) AS place FROM q")
def queue_order(spark, sf):
    q = records(spark, sf).filter("manual or confidence is null").select("id", "source")
    return selection.placed(q, F.col("source"), F.col("id")).select("id", "place")


@query(REC + ", r AS (SELECT id, coalesce(toxic = 1, false) AS protected, sha256('3401:fill:' || id) AS rank FROM rec), z AS (SELECT *, row_number() OVER (ORDER BY NOT protected, rank, id) AS place FROM r) SELECT id, protected FROM z WHERE protected OR place <= 120")
def protected_selection(spark, sf):
    r = records(spark, sf).select("id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("protected"))
    return selection.fill_to_target(r, "protected", 120, 3401, "fill", "id")


@query("SELECT event_type, coalesce(nullif(json_extract_string(props, '$.model'), ''), 'UNKNOWN') AS model, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS VARCHAR) AS cost, max(user_id) AS last_user FROM events GROUP BY ALL")
def usage_report(spark, sf):
    model = F.coalesce(F.nullif(F.get_json_object("props", "$.model"), F.lit("")), F.lit("UNKNOWN"))
    return t(spark, sf, "events").groupBy("event_type", model.alias("model")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("string").alias("cost"), F.max("user_id").alias("last_user"))


@query("WITH c AS (SELECT doc_id, lang, len(string_split(text, ' ')) AS n FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (n > 256) AS cut, round(count(*) FILTER (n > 256) / count(*), 6) AS cut_rate, round(avg(greatest(n - 256, 0)), 6) AS lost FROM c GROUP BY lang")
def truncation_summary(spark, sf):
    c = t(spark, sf, "documents").select("lang", F.size(F.split("text", " ")).alias("n"))
    over = F.count(F.when(F.col("n") > 256, 1))
    return c.groupBy("lang").agg(F.count("*").alias("n"), over.alias("cut"), F.round(over / F.count("*"), 6).alias("cut_rate"), F.round(F.avg(F.greatest(F.col("n") - 256, F.lit(0))), 6).alias("lost"))


@query("WITH a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality, toxic FROM labels), b AS (SELECT doc_id, quality, CASE WHEN doc_id % 7 = 0 THEN 1 - toxic WHEN doc_id % 3 = 0 THEN NULL ELSE toxic END AS toxic FROM labels) SELECT a.doc_id, array_to_string(list_filter([CASE WHEN a.quality IS NULL THEN 'A.quality' END, CASE WHEN b.toxic IS NULL THEN 'B.toxic' END], lambda x: x IS NOT NULL), ',') AS missing, CASE WHEN a.quality IS NULL OR b.toxic IS NULL THEN 'INCOMPLETE' WHEN a.quality = b.quality AND a.toxic = b.toxic THEN 'AGREED' ELSE 'DISAGREEMENT' END AS state FROM a JOIN b ON a.doc_id = b.doc_id")
def annotator_comparison(spark, sf):
    base, d = t(spark, sf, "labels"), F.col("doc_id")
    a = base.select("doc_id", F.when(d % 5 != 0, F.col("quality")).alias("quality"), "toxic")
    b = base.select("doc_id", "quality", F.when(d % 7 == 0, 1 - F.col("toxic")).when(d % 3 != 0, F.col("toxic")).alias("toxic"))
    return rules.compared(a, b, "doc_id", ["quality", "toxic"])


@query(REC + ", e AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'EXCLUDED' ELSE status END AS status, CASE WHEN doc_id % 9 = 0 THEN 'REJECTED' ELSE 'PENDING' END AS review, CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'PASSED' END AS chk FROM rec) SELECT doc_id, status, review, chk, review = 'PENDING' AND status <> 'EXCLUDED' AND chk = 'PASSED' AS eligible FROM e")
def exclusion_marks(spark, sf):
    r = records(spark, sf).select("doc_id", F.struct("status", F.lit("PENDING").alias("review"), F.lit("PASSED").alias("chk")).alias("m"))
    return rules.marked(r, "m", F.col("doc_id") % 9 == 0).select("doc_id", "m.*", rules.eligible("m").alias("eligible"))
