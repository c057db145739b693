"""Queries of authored records: spans, policies, budgets, audit, priorities, pairs, samples and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import authoring
from ..operators import sampling
from .catalogue import REC, SPLIT, VERDICT, query, records, t, verdicts, with_splits

# --- spans and preserved content ---------------------------------------------------------

ANCHORS = (("an", "doc_id % 3", "DIRECTIVE"), ("e", "doc_id % 2", "INJECTION_PAYLOAD"), ("an", "1", "AUTHORITY_CLAIM"))


def _at(part: str, n: int) -> str:
    """SQL of the 1-based start of the n-th (from 0) occurrence, 0 without one."""
    if n == 0:
        return f"strpos(text, '{part}')"
    before = _at(part, n - 1)
    found = f"strpos(substr(text, {before} + 1), '{part}')"
    return f"CASE WHEN {before} = 0 OR {found} = 0 THEN 0 ELSE {before} + {found} END"


_SPAN = ", ".join(f"{{'s': CASE {k} WHEN 0 THEN {_at(p, 0)} WHEN 1 THEN {_at(p, 1)} ELSE {_at(p, 2)} END - 1, 'n': {len(p)}, 'r': {i}}}" for i, (p, k, _) in enumerate(ANCHORS))


@query(f"WITH x AS (SELECT doc_id, list_sort(list_transform([{_SPAN}], lambda v: [CAST(v.s AS BIGINT), CASE WHEN v.s >= 0 THEN v.s + v.n ELSE -1 END, v.r])) AS x FROM documents) SELECT doc_id, array_to_string(list_transform(x, lambda v: v[1] || '-' || v[2] || '-' || v[3]), ',') AS spans, list_bool_and(list_transform(x, lambda v: v[1] >= 0)) AS found FROM x")
def resolved_spans(spark, sf):
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.expr(k).cast("int").alias("nth"), F.lit(kind).alias("type")) for p, k, kind in ANCHORS])
    x = t(spark, sf, "documents").select("doc_id", authoring.anchored(F.col("text"), parts).alias("x"))
    line = F.array_join(F.transform("x", lambda s: F.concat_ws("-", s["start"], s["end"], s["rank"])), ",")
    return x.select("doc_id", line.alias("spans"), F.forall("x", lambda s: s["start"] >= 0).alias("found"))


_EDGE = r"[^\p{L}\p{N}_.]"


@query(rf"SELECT doc_id, regexp_matches(text, '(^|{_EDGE})' || (doc_id % 40) || '($|{_EDGE})') AS number_kept, contains(lower(text), lower(replace(lang || '_' || 'THE', '_', ' '))) OR contains(lower(text), lower(lang || '_' || 'THE')) AS words_kept, list_bool_or(list_transform(['Data', 'model'], lambda x: contains(lower(text), lower(x)))) AS action_kept FROM documents")
def preserved_content(spark, sf):
    x, number = F.col("text"), (F.col("doc_id") % 40).cast("string")
    return t(spark, sf, "documents").select("doc_id", authoring.keeps_number(x, number).alias("number_kept"), authoring.keeps_words(x, F.concat("lang", F.lit("_THE"))).alias("words_kept"), authoring.says_any(x, F.array(F.lit("Data"), F.lit("model"))).alias("action_kept"))


REASONS = "CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['Span out of text', 'odd'] WHEN 2 THEN ['duplicate url in JSON'] WHEN 3 THEN ['schema: user_goal'] ELSE [lang] END"
_CODES = ", ".join(f"CASE WHEN contains(lower(x), '{w}') THEN '{c}' END" for w, c in authoring.REJECTIONS.items())


@query(f"WITH r AS (SELECT doc_id, CAST({REASONS} AS VARCHAR[]) AS reasons FROM documents), c AS (SELECT doc_id, list_transform(reasons, lambda x: list_filter([{_CODES}], lambda y: y IS NOT NULL)) AS c FROM r) SELECT doc_id, CASE WHEN len(c) = 0 THEN '{authoring.NO_REASON}' ELSE array_to_string(list_sort(list_distinct(flatten(list_transform(c, lambda x: CASE WHEN len(x) = 0 THEN ['{authoring.UNKNOWN_REASON}'] ELSE x END)))), ',') END AS codes FROM c")
def rejection_codes(spark, sf):
    d, lit = F.col("doc_id") % 5, lambda *xs: F.array(*[F.lit(x) for x in xs])
    reasons = F.when(d == 0, F.array().cast("array<string>")).when(d == 1, lit("Span out of text", "odd")).when(d == 2, lit("duplicate url in JSON")).when(d == 3, lit("schema: user_goal")).otherwise(F.array("lang"))
    return t(spark, sf, "documents").select("doc_id", F.array_join(authoring.rejection_codes(reasons), ",").alias("codes"))


@query("SELECT n_nationkey, 'Policy ' || n_name || ' of region ' || n_regionkey || '; {' || n_name || '}' AS prompt FROM nation")
def rendered_prompts(spark, sf):
    body = authoring.rendered("Policy {policy} of region {region}; {quoted}", {"policy": F.col("n_name"), "region": F.col("n_regionkey"), "quoted": F.concat(F.lit("{"), "n_name", F.lit("}"))})
    return t(spark, sf, "nation").select("n_nationkey", body.alias("prompt"))


# --- policies ------------------------------------------------------------------------------

#: A policy a nation, its actions the market segments of customers, by numbers of the key.
_CASE = "SELECT c_custkey, c_mktsegment AS action, ['BUILDING', 'MACHINERY'] AS allowed, CASE WHEN c_nationkey % 3 = 0 THEN ['MACHINERY'] ELSE [] END AS forbidden, ['FURNITURE'] AS confirm, c_custkey % 2 = 0 AS bypassed, CASE WHEN c_custkey % 7 = 0 THEN 'CLAIMED' ELSE 'NONE' END AS claim, CASE c_custkey % 4 WHEN 0 THEN ['ALLOW_AUTHORITY'] WHEN 1 THEN ['DENY_AUTHORITY'] WHEN 2 THEN ['ALLOW_AUTHORITY', 'DENY_AUTHORITY'] ELSE [] END AS effects, CASE c_nationkey % 3 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'TOOL' ELSE 'USER' END AS role FROM customer"


@query(f"WITH c AS ({_CASE}) SELECT c_custkey, CASE WHEN list_contains(forbidden, action) OR (list_contains(confirm, action) AND bypassed) THEN 'CONFLICTING' WHEN list_contains(allowed, action) THEN 'COMPLIANT' ELSE 'UNDETERMINED' END AS alignment, CASE WHEN claim <> 'NONE' THEN 'SPOOFED' WHEN effects = ['ALLOW_AUTHORITY'] THEN 'WITHIN_AUTHORITY' WHEN effects = ['DENY_AUTHORITY'] THEN 'OUTSIDE_AUTHORITY' WHEN role = 'SYSTEM' THEN 'WITHIN_AUTHORITY' WHEN role = 'TOOL' THEN 'OUTSIDE_AUTHORITY' END AS authority FROM c")
def policy_authority(spark, sf):
    key, nation, none = F.col("c_custkey"), F.col("c_nationkey"), F.array().cast("array<string>")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    alignment = authoring.policy_alignment(F.col("c_mktsegment"), lit("BUILDING", "MACHINERY"), F.when(nation % 3 == 0, lit("MACHINERY")).otherwise(none), lit("FURNITURE"), key % 2 == 0)
    effects = F.when(key % 4 == 0, lit("ALLOW_AUTHORITY")).when(key % 4 == 1, lit("DENY_AUTHORITY")).when(key % 4 == 2, lit("ALLOW_AUTHORITY", "DENY_AUTHORITY")).otherwise(none)
    role = F.when(nation % 3 == 0, "SYSTEM").when(nation % 3 == 1, "TOOL").otherwise("USER")
    status = authoring.authority_status(F.when(key % 7 == 0, "CLAIMED").otherwise("NONE"), effects, role)
    return t(spark, sf, "customer").select("c_custkey", alignment.alias("alignment"), status.alias("authority"))


_RULES = "SELECT o_custkey % 50 AS policy, o_orderpriority AS rule, o_orderstatus AS action, CASE WHEN o_orderkey % 3 = 0 THEN 'DENY' ELSE 'ALLOW' END AS effect, o_orderkey % 2 = 0 AS conditional FROM orders"


@query(f"WITH r AS ({_RULES}), a AS (SELECT policy, action, bool_or(effect = 'ALLOW') FILTER (NOT conditional) AS al, bool_or(effect = 'DENY') FILTER (NOT conditional) AS de FROM r GROUP BY ALL), d AS (SELECT policy, rule FROM r GROUP BY ALL HAVING count(*) > 1), p AS (SELECT policy, count(*) AS n_rules, count(DISTINCT action) FILTER (action NOT IN ('F', 'O')) AS unknown_actions FROM r GROUP BY policy) SELECT p.policy AS policy, n_rules, unknown_actions, (SELECT count(*) FROM a WHERE a.policy = p.policy AND al AND de) AS contradictions, (SELECT count(*) FROM d WHERE d.policy = p.policy) AS repeated_rules FROM p")
def catalogue_faults(spark, sf):
    key = F.col("o_orderkey")
    r = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("policy"), F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("action"), F.when(key % 3 == 0, "DENY").otherwise("ALLOW").alias("effect"), (key % 2 == 0).alias("conditional"))
    free = lambda e: F.max(((F.col("effect") == e) & ~F.col("conditional")).cast("int"))
    cells = r.groupBy("policy", "rule", "action").agg(F.count("*").alias("k"), free("ALLOW").alias("al"), free("DENY").alias("de"))  # one shuffle of rules, two of cells
    actions = cells.groupBy("policy", "action").agg(F.max("al").alias("al"), F.max("de").alias("de")).groupBy("policy")
    actions = actions.agg(F.count(F.when(~F.col("action").isin("F", "O"), 1)).alias("unknown_actions"), F.count(F.when((F.col("al") == 1) & (F.col("de") == 1), 1)).alias("contradictions"))
    rules = cells.groupBy("policy", "rule").agg(F.sum("k").alias("k")).groupBy("policy").agg(F.sum("k").alias("n_rules"), F.count(F.when(F.col("k") > 1, 1)).alias("repeated_rules"))
    return rules.join(actions, "policy")


# --- budgets, reuse ------------------------------------------------------------------------

_POUR = "list_transform(range(1, 6), lambda i: greatest(0, least({room}[i], {amount} - coalesce(list_sum({room}[1:i - 1]), 0))))"
_NOMINAL = [authoring.SECTIONS[n] for n in authoring.GIVEN_TO]
_CAP = 300
_LENGTHS = "[len(string_split(text, ' ')), doc_id % 400, doc_id % 3 * 70, doc_id % 5 * 30, doc_id % 2]"


@query(f"WITH a AS (SELECT doc_id, list_transform({_LENGTHS}, lambda x: CAST(x AS BIGINT)) AS n FROM documents), b AS (SELECT *, list_transform(n, lambda x: least(x, 1)) AS lo, list_transform(range(1, 6), lambda i: greatest({[_CAP * x // sum(_NOMINAL) for x in _NOMINAL]}[i], least(n[i], 1))) AS f FROM a), c AS (SELECT *, list_reverse(list_transform(range(1, 6), lambda i: f[i] - lo[i])) AS spare, greatest(list_sum(f) - {_CAP}, 0) AS over FROM b), d AS (SELECT *, list_reverse({_POUR.format(room='spare', amount='over')}) AS lost FROM c), e AS (SELECT *, list_transform(range(1, 6), lambda i: f[i] - lost[i]) AS cut FROM d), g AS (SELECT *, list_transform(range(1, 6), lambda i: greatest({_NOMINAL}[i] - cut[i], 0)) AS below, {_CAP} - list_sum(cut) AS free FROM e), h AS (SELECT *, {_POUR.format(room='below', amount='free')} AS got FROM g), k AS (SELECT *, list_transform(range(1, 6), lambda i: cut[i] + got[i] + CASE WHEN i = 1 THEN free - list_sum(got) ELSE 0 END) AS budget FROM h), l AS (SELECT *, list_transform(range(1, 6), lambda i: least(n[i], budget[i])) AS used FROM k), m AS (SELECT *, list_transform(range(1, 6), lambda i: n[i] - used[i]) AS want, {_CAP} - list_sum(used) AS unused FROM l), o AS (SELECT *, {_POUR.format(room='want', amount='unused')} AS more FROM m) SELECT doc_id, array_to_string(list_transform(range(1, 6), lambda i: CAST(used[i] + more[i] AS BIGINT)), ',') AS tokens FROM o")
def section_budgets(spark, sf):
    d = F.col("doc_id")
    lengths = F.array(*[x.cast("long") for x in (F.size(F.split("text", " ")), d % 400, d % 3 * 70, d % 5 * 30, d % 2)])
    got = authoring.section_tokens(t(spark, sf, "documents").select("doc_id", lengths.alias("n")), "n", _CAP)
    return got.select("doc_id", F.array_join(F.transform("n", lambda v: v.cast("string")), ",").alias("tokens"))


@query("WITH w AS (SELECT doc_id, sha256(source || ':' || lang) AS plan, sha256(text) AS prompt FROM documents), s AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'old' ELSE plan END AS plan, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE prompt END AS prompt FROM w WHERE doc_id % 4 <> 1) SELECT w.doc_id AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'ABSENT' WHEN s.plan = w.plan AND s.prompt = w.prompt THEN 'REUSED' ELSE 'STALE' END AS state FROM w LEFT JOIN s ON s.doc_id = w.doc_id")
def reusable_artifacts(spark, sf):
    d = F.col("doc_id")
    want = t(spark, sf, "documents").select("doc_id", F.struct(F.sha2(F.concat_ws(":", "source", "lang"), 256).alias("plan"), F.sha2("text", 256).alias("prompt")).alias("w"))
    held = want.filter(d % 4 != 1).select("doc_id", F.struct(F.when(d % 6 == 0, "old").otherwise(F.col("w.plan")).alias("plan"), F.when(d % 10 == 0, "old").otherwise(F.col("w.prompt")).alias("prompt")).alias("s"))
    return want.join(held, "doc_id", "left").select("doc_id", F.when(F.col("s").isNull(), "ABSENT").when(F.col("s") == F.col("w"), "REUSED").otherwise("STALE").alias("state"))


# --- audit and priorities --------------------------------------------------------------------

#: What the test tables lack, by numbers of the id: families, objectives, spans, goals, policies, errors.
_FULL = REC + f", f AS (SELECT *, {VERDICT} AS verdict, doc_id % 23 <> 0 AS provenance, CASE WHEN doc_id % 29 = 0 THEN '' ELSE source || ':' || doc_id END AS source_record_id, CASE WHEN doc_id % 31 = 0 THEN ['e'] ELSE [] END AS errors, CASE WHEN toxic = 1 OR doc_id % 19 = 0 THEN ['PROMPT_INJECTION'] ELSE [] END AS families, CASE WHEN doc_id % 13 = 0 THEN ['GOAL_HIJACKING'] ELSE [] END AS objectives, CASE WHEN doc_id % 6 <> 0 THEN 'goal' END AS user_goal, CASE WHEN doc_id % 7 <> 0 THEN 'policy' END AS protected_policy, CASE WHEN doc_id % 8 = 0 THEN [{{'s': 0, 'e': 3, 't': 'AUTHORITY_CLAIM'}}, {{'s': 2, 'e': 2 + doc_id % 3, 't': 'DIRECTIVE'}}] ELSE [{{'s': 0, 'e': 3, 't': 'DIRECTIVE'}}] END AS spans, doc_id % 17 <> 0 AS rationale, doc_id % 3 = 0 AS agentic FROM rec)"


def full(spark, sf):
    """records with every field that the audit reads."""
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    lit = lambda x: F.array(F.lit(x))
    span = lambda s, e, kind: F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end") if isinstance(e, int) else e.alias("end"), F.lit(kind).alias("type"))
    new = {
        "provenance": d % 23 != 0, "source_record_id": F.when(d % 29 == 0, "").otherwise(F.concat_ws(":", "source", "doc_id")), "errors": F.when(d % 31 == 0, lit("e")).otherwise(none),
        "families": F.when((F.coalesce("toxic", F.lit(0)) == 1) | (d % 19 == 0), lit("PROMPT_INJECTION")).otherwise(none), "objectives": F.when(d % 13 == 0, lit("GOAL_HIJACKING")).otherwise(none),
        "user_goal": F.when(d % 6 != 0, "goal"), "protected_policy": F.when(d % 7 != 0, "policy"),
        "spans": F.when(d % 8 == 0, F.array(span(0, 3, "AUTHORITY_CLAIM"), span(2, 2 + d % 3, "DIRECTIVE"))).otherwise(F.array(span(0, 3, "DIRECTIVE"))), "rationale": d % 17 != 0, "agentic": d % 3 == 0,
    }
    return verdicts(records(spark, sf)).withColumns(new)


HEURISTIC, CONFIRMABLE = ("src1", "src2", "src3"), ("src0",)
ISSUES = {
    "missing_provenance": "NOT provenance",
    "invalid_source_record_id": "NOT provenance OR source_record_id = ''",
    "schema_or_structural_error": "len(errors) > 0",
    "span_error": "len(list_filter(spans, lambda v: v.s < 0 OR v.s >= v.e OR v.e > length(text))) > 0",
    "no_instruction_with_attack_labels": "presence = 'NO_INSTRUCTION' AND (len(families) > 0 OR len(objectives) > 0)",
    "not_applicable_inconsistent_with_no_instruction": "presence = 'NO_INSTRUCTION' AND NOT (presentation = 'NOT_APPLICABLE' AND addressee = 'NOT_APPLICABLE' AND goal = 'NOT_APPLICABLE' AND policy = 'NOT_APPLICABLE' AND authority = 'NOT_APPLICABLE')",
    "not_applicable_inconsistent_with_instruction": "presence = 'INSTRUCTION_PRESENT' AND (presentation = 'NOT_APPLICABLE' OR addressee = 'NOT_APPLICABLE')",
    "objective_without_family": "len(objectives) > 0 AND len(families) = 0",
    "alignment_without_user_goal": "goal IN ('ALIGNED', 'MISALIGNED') AND user_goal IS NULL",
    "policy_alignment_without_policy": "policy IN ('COMPLIANT', 'CONFLICTING') AND protected_policy IS NULL",
    "spoofed_without_authority_claim": "authority = 'SPOOFED' AND len(list_filter(spans, lambda v: v.t = 'AUTHORITY_CLAIM')) = 0",
    "within_authority_without_boundary": "authority = 'WITHIN_AUTHORITY' AND user_goal IS NULL",
    "missing_mapping_confidence": "confidence IS NULL",
    "missing_mapping_rationale": "NOT rationale",
    "source_mapping_not_flagged_for_review": "NOT manual AND source IN ('src1', 'src2', 'src3')",
    "source_derived_marked_confirmed": "status = 'CONFIRMED' AND source <> 'src0'",
}


@query(_FULL + ", i AS (" + " UNION ALL ".join(f"SELECT '{k}' AS issue, id FROM f WHERE {v}" for k, v in ISSUES.items()) + " UNION ALL SELECT 'duplicate_canonical_id', id FROM rec GROUP BY id HAVING count(*) > 1) SELECT issue, count(*) AS n, min(id) AS first FROM i GROUP BY issue")
def corpus_audit(spark, sf):
    f = full(spark, sf)
    rows = f.select("id", F.explode(authoring.corpus_issues({c: F.col(c) for c in f.columns}, HEURISTIC, CONFIRMABLE)).alias("issue"))
    twice = f.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id", F.lit("duplicate_canonical_id").alias("issue"))
    return rows.unionByName(twice).groupBy("issue").agg(F.count("*").alias("n"), F.min("id").alias("first"))


HOLDS = {
    "structural_validation_error": "len(errors) > 0", "heuristic_or_low_confidence_mapping": "manual OR coalesce(confidence, 0) < 0.85", "uncertain_authority_status": "authority = 'UNKNOWN'",
    "uncertain_user_goal_alignment": "goal = 'UNDETERMINED'", "uncertain_protected_policy_alignment": "policy = 'UNDETERMINED'", "missing_content": "coalesce(text, '') = ''", "agentic_scenario": "agentic",
    "hard_negative_coverage": "source = 'src4'", "quoted_or_hypothetical": "presentation IN ('QUOTED_OR_REPORTED', 'HYPOTHETICAL')", "claimed_authority": "authority = 'SPOOFED'", "multiple_spans": "len(spans) > 1",
    "long_context": "length(coalesce(text, '')) > 500", "rare_source": "k_source <= 40", "rare_attack_family": "k_families <= 20", "rare_attack_objective": "k_objectives <= 20", "license_sensitive_source": "source IN ('src1', 'src2')",
}
_SCORE = " + ".join(f"CASE WHEN {HOLDS[k]} THEN {p} ELSE 0 END" for k, p in authoring.POINTS.items())
_WHY = ", ".join(f"CASE WHEN {HOLDS[k]} THEN '{k}' END" for k in authoring.POINTS)


@query(_FULL + f", k AS (SELECT *, count(*) OVER (PARTITION BY source) AS k_source, count(*) OVER (PARTITION BY families) AS k_families, count(*) OVER (PARTITION BY objectives) AS k_objectives FROM f), s AS (SELECT id, {_SCORE} AS score, len(errors) > 0 AS broken, coalesce(text, '') = '' OR NOT provenance AS bare, list_filter([{_WHY}], lambda x: x IS NOT NULL) AS why FROM k), b AS (SELECT *, CASE WHEN broken OR (score >= 35 AND bare) THEN 'P0_BLOCKING_ERROR' WHEN score >= 25 THEN 'P1_GOLD_CANDIDATE' WHEN score >= 15 THEN 'P2_MAPPING_AUDIT' WHEN score >= 8 THEN 'P3_COVERAGE' ELSE 'P4_LOW_PRIORITY' END AS band FROM s) SELECT id, CAST(score AS BIGINT) AS score, band, array_to_string(list_sort(list_append(why, band)), ',') AS reasons FROM b")
def review_priorities(spark, sf):
    f = full(spark, sf)
    for c in ("source", "families", "objectives"):  # counts of a vocabulary, combined before the shuffle
        f = f.join(f.groupBy(c).agg(F.count("*").alias(f"k_{c}")), c)
    translated = {k: F.expr(v.replace("len(", "size(")) for k, v in HOLDS.items()}
    score, band, reasons = authoring.priority(translated, (F.coalesce("text", F.lit("")) == "") | ~F.col("provenance"))
    return f.select("id", score.alias("score"), band.alias("band"), F.array_join(reasons, ",").alias("reasons"))


@query(_FULL + ", n AS (SELECT id, lang, source, verdict, status FROM f), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, 'UNKNOWN') AS value FROM n" for c in ("lang", "source", "verdict", "status")) + ") SELECT field, value, count(*) AS n FROM x GROUP BY ALL")
def selection_distributions(spark, sf):
    cols = ("lang", "source", "verdict", "status")
    x = full(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit("UNKNOWN")).alias("value")) for c in cols])).alias("x"))
    return x.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


@query(_FULL + " SELECT presence || ' + ' || presentation || ' + ' || addressee || ' + ' || authority || ' + ' || goal AS axes, count(*) AS n, count(*) FILTER (verdict = 'DETECTED') AS detected, round(avg(confidence), 9) AS mean_confidence FROM f GROUP BY ALL")
def conditional_probability(spark, sf):
    axes = F.concat_ws(" + ", "presence", "presentation", "addressee", "authority", "goal")
    return full(spark, sf).groupBy(axes.alias("axes")).agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "DETECTED", 1)).alias("detected"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


@query(_FULL + ", e AS (SELECT id, list_filter([CASE WHEN len(errors) > 0 THEN 'structure' END, CASE WHEN doc_id % 37 = 0 THEN 'duplicate id' END, CASE WHEN verdict = 'DETECTED' AND NOT list_contains(families, 'PROMPT_INJECTION') THEN 'detected without family' END, CASE WHEN authority = 'SPOOFED' AND len(list_filter(spans, lambda v: v.t = 'AUTHORITY_CLAIM')) = 0 THEN 'spoofed without claim' END], lambda x: x IS NOT NULL) AS errors FROM f) SELECT count(*) AS n, count(*) FILTER (len(errors) > 0) AS failed, CAST(sum(len(errors)) AS BIGINT) AS n_errors, CASE WHEN count(*) FILTER (len(errors) > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS state FROM e")
def collection_report(spark, sf):
    rules = {
        "structure": F.size("errors") > 0, "duplicate id": F.col("doc_id") % 37 == 0, "detected without family": (F.col("verdict") == "DETECTED") & ~F.array_contains("families", "PROMPT_INJECTION"),
        "spoofed without claim": (F.col("authority") == "SPOOFED") & ~F.exists("spans", lambda s: s["type"] == "AUTHORITY_CLAIM"),
    }
    e = full(spark, sf).select(F.size(authoring.names(rules)).alias("k"))
    failed = F.count(F.when(F.col("k") > 0, 1))
    return e.agg(F.count("*").alias("n"), failed.alias("failed"), F.sum("k").alias("n_errors"), F.when(failed == 0, "PASS").otherwise("FAIL").alias("state"))


# --- pairs, releases, reports ------------------------------------------------------------------


@query("WITH r AS (SELECT d.doc_id // 2 AS g, d.doc_id AS id, lang, source, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id), p AS (SELECT a.g AS g, a.lang IS DISTINCT FROM b.lang AS l, a.source IS DISTINCT FROM b.source AS s, a.quality IS DISTINCT FROM b.quality AS q, a.toxic IS DISTINCT FROM b.toxic AS t, a.g % 3 = 0 AS dq, a.g % 4 <> 0 AS must FROM r a JOIN r b ON a.g = b.g AND a.id < b.id) SELECT g AS \"group\", array_to_string(list_sort(list_filter([CASE WHEN l THEN 'invariant:lang' END, CASE WHEN s THEN 'invariant:source' END, CASE WHEN dq AND NOT q THEN 'not made:quality' END, CASE WHEN NOT dq AND q THEN 'not declared:quality' END, CASE WHEN NOT dq AND NOT t THEN 'not made:toxic' END, CASE WHEN dq AND t THEN 'not declared:toxic' END, CASE WHEN must AND NOT q AND NOT t THEN 'no label changed' END, CASE WHEN NOT must AND (q OR t) THEN 'label changed' END], lambda x: x IS NOT NULL)), ',') AS faults FROM p")
def pair_faults(spark, sf):
    from ..operators import selection

    r = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select(F.expr("doc_id div 2").alias("group"), F.col("doc_id").alias("id"), "lang", "source", "quality", "toxic")
    p = selection.exact_pairs(r, "group", "id")
    g = F.col("group")
    faults = authoring.pair_faults("x", "y", ["lang", "source"], ["quality", "toxic"], F.when(g % 3 == 0, F.array(F.lit("quality"))).otherwise(F.array(F.lit("toxic"))), g % 4 != 0)
    return p.select("group", F.array_join(faults, ",").alias("faults"))


@query(SPLIT + f", q AS (SELECT split, CASE WHEN coalesce(text, '') = '' THEN 'REJECTED' ELSE 'RELEASED' END AS state, source, confidence IS NULL OR confidence < 0.85 OR manual AS review, {VERDICT} AS verdict FROM sp) SELECT split, state, count(*) AS n, count(*) FILTER (review) AS to_review, count(*) FILTER (verdict = 'DETECTED') AS detected, count(DISTINCT source) AS sources FROM q GROUP BY ALL")
def release_summary(spark, sf):
    r = verdicts(with_splits(spark, sf))
    state = F.when(F.coalesce("text", F.lit("")) == "", "REJECTED").otherwise("RELEASED")
    review = F.col("confidence").isNull() | (F.col("confidence") < 0.85) | F.col("manual")
    out = r.groupBy("split", state.alias("state"))
    return out.agg(F.count("*").alias("n"), F.count(F.when(review, 1)).alias("to_review"), F.count(F.when(F.col("verdict") == "DETECTED", 1)).alias("detected"), F.count_distinct("source").alias("sources"))


@query("WITH e AS (SELECT event_type, user_id, value, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['span'] WHEN 2 THEN ['span', 'json'] ELSE ['url'] END AS failed FROM events), n AS (SELECT event_type, count(*) AS attempts, CAST(sum(len(failed)) AS BIGINT) AS retries, CAST(sum(CAST(value AS DECIMAL(38, 6))) AS VARCHAR) AS cost FROM e GROUP BY event_type), c AS (SELECT event_type, r, count(*) AS k FROM (SELECT event_type, unnest(failed) AS r FROM e) GROUP BY ALL) SELECT n.event_type AS event_type, attempts, retries, cost, (SELECT string_agg(r || ':' || k, ',' ORDER BY r) FROM c WHERE c.event_type = n.event_type) AS reasons FROM n")
def quality_report(spark, sf):
    i, lit = F.col("event_id") % 4, lambda *xs: F.array(*[F.lit(x) for x in xs])
    e = t(spark, sf, "events").withColumn("failed", F.when(i == 0, F.array().cast("array<string>")).when(i == 1, lit("span")).when(i == 2, lit("span", "json")).otherwise(lit("url")))
    n = e.groupBy("event_type").agg(F.count("*").alias("attempts"), F.sum(F.size("failed")).alias("retries"), F.sum(F.col("value").cast("decimal(28,6)")).cast("string").alias("cost"))
    c = e.select("event_type", F.explode("failed").alias("r")).groupBy("event_type", "r").agg(F.count("*").alias("k"))
    c = c.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "r", "k"))), ",").alias("reasons"))  # a line a reason
    return n.join(c, "event_type", "left")


@query("WITH r AS (SELECT doc_id, source, lang, sha256('3202:pick:' || doc_id) AS k FROM documents), z AS (SELECT * FROM r ORDER BY k, doc_id LIMIT 60) SELECT count(*) AS n, sha256(string_agg(sha256('3202' || chr(10) || doc_id || chr(10) || source || chr(10) || lang), chr(10) ORDER BY doc_id)) AS digest FROM z")
def selection_manifest(spark, sf):
    from ..operators import selection

    picked = selection.take_ranked(t(spark, sf, "documents").select("doc_id", "source", "lang"), 60, 3202, "pick", "doc_id")
    return sampling.manifest(picked, "doc_id", ["source", "lang"], 3202)


@query("WITH c AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT a || ':' || b || ':' || i AS slot, 'cell' AS why, a, b FROM c, (SELECT unnest([1, 2]) AS i)), x AS (SELECT n_name AS v, unnest(range(1, n_regionkey + 1)) AS i FROM nation), y AS (SELECT r_name AS v, unnest(range(1, 11)) AS i FROM region), p AS (SELECT v AS a, row_number() OVER (ORDER BY sha256('5:a:' || v || ':' || i), v, i) AS rn FROM x), q AS (SELECT v AS b, row_number() OVER (ORDER BY sha256('5:b:' || v || ':' || i), v, i) AS rn FROM y) SELECT * FROM f UNION ALL SELECT 'rest:' || rn, 'rest', a, b FROM p JOIN q USING (rn) WHERE rn <= 40")
def quota_plan(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    cells = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    marginals = {"a": n.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("n")), "b": r.select(F.col("r_name").alias("value"), F.lit(10).alias("n"))}
    return sampling.quota_plan(cells, 2, marginals, 40, 5)


@query()
def coverage_sample(spark, sf):
    """Whole units of up to 120 rows together that cover languages and labels, then others by rank; its test is a sequential model."""
    r = records(spark, sf)
    units = r.groupBy(F.concat_ws(":", "source", F.col("doc_id") % 60).alias("unit")).agg(F.count("*").cast("long").alias("size"), F.collect_set(F.concat_ws(":", F.lit("lang"), "lang")).alias("l"), F.collect_set("presentation").alias("p"))
    return sampling.set_cover(units.select("unit", "size", F.concat("l", "p").alias("covers")), 120, 3301)
