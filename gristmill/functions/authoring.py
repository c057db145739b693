"""Rules of authored records: spans, preserved content, policies, budgets, audit and priorities, as Column builders."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import SPAN_TYPES

#: What a word in a rejection's reason says, and the codes where no word is known and where there is no reason.
REJECTIONS = {
    "span": "SPAN_VALIDATION_FAILED", "language": "LANGUAGE_VALIDATION_FAILED", "declared action": "DECLARED_ACTION_VALIDATION_FAILED",
    "authority": "AUTHORITY_VALIDATION_FAILED", "counterfactual": "COUNTERFACTUAL_VALIDATION_FAILED", "duplicate": "DUPLICATE_VALIDATION_FAILED",
    "url": "UNEXPECTED_URL", "schema": "STRUCTURE_VALIDATION_FAILED", "json": "STRUCTURE_VALIDATION_FAILED", "scenario_id": "SCENARIO_ID_MISMATCH",
    "protected_policy": "POLICY_VALIDATION_FAILED", "user_goal": "USER_GOAL_VALIDATION_FAILED",
}
UNKNOWN_REASON, NO_REASON = "SEMANTIC_VALIDATION_FAILED", "UNSPECIFIED_GENERATION_REJECTION"

#: Sections of a context in order with their shares, and the order in which unused tokens are given away.
SECTIONS = {"protected_policy": 120, "user_goal": 64, "source": 36, "available_capabilities": 36, "candidate": 240}
GIVEN_TO = ("candidate", "protected_policy", "user_goal", "source", "available_capabilities")

#: Points of a review priority.
POINTS = {
    "structural_validation_error": 100, "heuristic_or_low_confidence_mapping": 20, "uncertain_authority_status": 8, "uncertain_user_goal_alignment": 8,
    "uncertain_protected_policy_alignment": 8, "missing_content": 30, "agentic_scenario": 6, "hard_negative_coverage": 7, "quoted_or_hypothetical": 6,
    "claimed_authority": 5, "multiple_spans": 3, "long_context": 3, "rare_source": 4, "rare_attack_family": 4, "rare_attack_objective": 4, "license_sensitive_source": 3,
}


def names(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold; a rule that is null doesn't."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


# --- spans and preserved content ---------------------------------------------------------


def occurrence(text: Column, part: Column, nth: Column) -> Column:
    """0-based start of the nth (from 0) occurrence of part, which may overlap; -1 without one, or for an empty part."""
    find = lambda at: F.call_function("locate", part, text, at)
    step = lambda at, _: F.when(at <= 0, F.lit(0)).otherwise(find(at + 1))
    at = F.aggregate(F.sequence(F.lit(0), F.greatest(nth, F.lit(0))), F.lit(-1), lambda a, i: F.when(i == 0, find(F.lit(1))).otherwise(step(a, i)))
    return F.when((part == "") | (nth < 0), F.lit(-1)).otherwise(at - 1)


def anchored(text: Column, anchors: Column, types: tuple[str, ...] = SPAN_TYPES) -> Column:
    """Spans (start, end, rank of the type) of anchors (part, nth, type) by start, end and rank. Anchors not found start at -1."""
    rank = lambda a: F.array_position(F.array(*[F.lit(x) for x in types]), a["type"]).cast("int") - 1

    def span(a: Column) -> Column:
        at = occurrence(text, a["part"], a["nth"])
        return F.struct(at.alias("start"), F.when(at >= 0, at + F.length(a["part"])).otherwise(F.lit(-1)).alias("end"), rank(a).alias("rank"))

    return F.array_sort(F.transform(anchors, span))


def says_any(text: Column, terms: Column) -> Column:
    """Whether a text has one of the terms, in any case."""
    low = F.lower(text)
    return F.exists(terms, lambda x: F.contains(low, F.lower(x)))


def keeps_number(text: Column, number: Column) -> Column:
    """Whether a text has a number that no letter, digit, underscore or dot touches."""
    edge = r"[^\p{L}\p{N}_.]"
    literal = F.regexp_replace(number, r"([.+\-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(f"(^|{edge})"), literal, F.lit(f"($|{edge})")))


def keeps_words(text: Column, value: Column) -> Column:
    """Whether a text has a symbolic value with its underscores as spaces, or as it is, in any case."""
    low = F.lower(text)
    return F.contains(low, F.lower(value)) | F.contains(low, F.replace(F.lower(value), F.lit("_"), F.lit(" ")))


# --- rejections, templates, settings -------------------------------------------------------


def rejection_codes(reasons: Column) -> Column:
    """Sorted codes of an array of reasons; a reason that no word explains has a code of its own, and so has an empty array."""

    def codes(reason: Column) -> Column:
        low = F.lower(reason)
        found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), code) for word, code in REJECTIONS.items()]))
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNKNOWN_REASON)))

    every = F.array_sort(F.array_distinct(F.flatten(F.transform(reasons, codes))))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(NO_REASON)))


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with its {fields}. Fields that it lacks, or that lack here, are an error before anything runs; values aren't searched for fields."""
    parts = re.split(r"\{([a-z_]+)\}", template)
    if set(parts[1::2]) != set(fields):
        raise ValueError(f"fields of the template and of the call differ: {sorted(set(parts[1::2]) ^ set(fields))}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])


def interpolated(value: str, env: dict[str, str] | None = None) -> str:
    """A setting with ${NAME} and ${NAME:-default} replaced; a name that is not set and has no default is an error."""
    env = os.environ if env is None else env

    def one(m: re.Match) -> str:
        got = env.get(m["name"], m["default"])
        if got is None:
            raise KeyError(f"{m['name']} is not set")
        return got

    return re.sub(r"\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]*)(:-(?P<default>[^}]*))?\}", one, value)


# --- policies ------------------------------------------------------------------------------


def policy_alignment(action: Column, allowed: Column, forbidden: Column, confirm: Column, bypassed: Column) -> Column:
    """Forbidden actions, and those that need a confirmation and bypass it, conflict; others that are allowed comply."""
    has = lambda actions: F.coalesce(F.array_contains(actions, action), F.lit(False))
    return F.when(has(forbidden) | (has(confirm) & bypassed), "CONFLICTING").when(has(allowed), "COMPLIANT").otherwise("UNDETERMINED")


def authority_status(claim: Column, effects: Column, role: Column) -> Column:
    """A claim is spoofed; else the one effect of the rules that apply; else what the role may do by itself, or null."""
    one = F.when(F.size(F.array_distinct(effects)) == 1, effects[0])
    return (
        F.when(claim != "NONE", "SPOOFED").when(one == "ALLOW_AUTHORITY", "WITHIN_AUTHORITY").when(one == "DENY_AUTHORITY", "OUTSIDE_AUTHORITY")
        .when(role.isin("SYSTEM", "DEVELOPER"), "WITHIN_AUTHORITY").when(role.isin("TOOL", "EXTERNAL_CONTENT", "MEMORY", "ASSISTANT"), "OUTSIDE_AUTHORITY")
    )


# --- token budgets -------------------------------------------------------------------------


def poured(amount: Column, room: Column) -> Column:
    """What each element of `room` gets of an amount that is poured into them in order."""
    before = lambda i: F.aggregate(F.slice(room, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(room, lambda r, i: F.greatest(F.lit(0).cast("long"), F.least(r, amount - before(i))))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def section_tokens(rows: DataFrame, lengths: str, capacity: int, shares: dict[str, int] | None = None, order: tuple[str, ...] = GIVEN_TO) -> DataFrame:
    """rows whose column `lengths` (an array of longs, the tokens of each section in `order`) is cut to what each section keeps. Shares of the
    capacity are rounded down; where they are too many, the last in order lose first, down to one token of a section that isn't empty; what is
    left goes to sections below their nominal share in order, then to the first; what a section does not use goes to the longer ones in order."""
    shares = SECTIONS if shares is None else shares
    nominal = [shares[n] for n in order]
    zero = F.lit(0).cast("long")
    arr = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    n, x = F.col(lengths), F.col("_x")
    out = rows.withColumn("_m", F.transform(n, lambda v: F.least(v, F.lit(1).cast("long"))))
    out = out.withColumn("_x", F.zip_with(arr([capacity * v // sum(nominal) for v in nominal]), "_m", lambda a, b: F.greatest(a, b)))
    out = out.withColumn("_r", F.reverse(less(x, F.col("_m")))).withColumn("_a", F.greatest(_sum(x) - capacity, zero))
    out = out.withColumn("_x", less(x, F.reverse(poured(F.col("_a"), F.col("_r")))))
    out = out.withColumn("_r", F.transform(less(arr(nominal), x), lambda v: F.greatest(v, zero))).withColumn("_a", F.lit(capacity) - _sum(x))
    out = out.withColumn("_x", _plus(x, poured(F.col("_a"), F.col("_r")))).withColumn("_a", F.lit(capacity) - _sum(x))
    out = out.withColumn("_x", F.transform(x, lambda v, i: F.when(i == 0, v + F.col("_a")).otherwise(v)))
    out = out.withColumn("_x", F.zip_with(n, x, lambda a, b: F.least(a, b)))
    out = out.withColumn("_r", less(n, x)).withColumn("_a", F.lit(capacity) - _sum(x))
    return out.withColumn(lengths, _plus(x, poured(F.col("_a"), F.col("_r")))).drop("_m", "_x", "_r", "_a")


# --- audit and priorities --------------------------------------------------------------------


def corpus_issues(r: dict[str, Column], heuristic: tuple[str, ...], confirmed: tuple[str, ...]) -> Column:
    """Issues of a record, in order (a repeated id, which one row can't show, aside). `heuristic` sources need a review, only `confirmed` ones
    may be confirmed. r: provenance, source_record_id, errors, presence, presentation, addressee, goal, policy, authority, families, objectives,
    spans (start, end, type), text, user_goal, protected_policy, confidence, rationale, manual, source, status."""
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    none, there = r["presence"] == "NO_INSTRUCTION", r["presence"] == "INSTRUCTION_PRESENT"
    axes = ("presentation", "addressee", "goal", "policy", "authority")
    applies = F.array_contains(F.array(*[F.coalesce(r[a] != "NOT_APPLICABLE", F.lit(True)) for a in axes]), True)
    return names({
        "missing_provenance": ~r["provenance"],
        "invalid_source_record_id": ~r["provenance"] | empty(r["source_record_id"]),
        "schema_or_structural_error": some(r["errors"]),
        "span_error": F.exists(r["spans"], lambda s: ~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(r["text"])))),
        "no_instruction_with_attack_labels": none & (some(r["families"]) | some(r["objectives"])),
        "not_applicable_inconsistent_with_no_instruction": none & applies,
        "not_applicable_inconsistent_with_instruction": there & ((r["presentation"] == "NOT_APPLICABLE") | (r["addressee"] == "NOT_APPLICABLE")),
        "objective_without_family": some(r["objectives"]) & ~some(r["families"]),
        "alignment_without_user_goal": r["goal"].isin("ALIGNED", "MISALIGNED") & empty(r["user_goal"]),
        "policy_alignment_without_policy": r["policy"].isin("COMPLIANT", "CONFLICTING") & empty(r["protected_policy"]),
        "spoofed_without_authority_claim": (r["authority"] == "SPOOFED") & ~F.exists(r["spans"], lambda s: s["type"] == "AUTHORITY_CLAIM"),
        "within_authority_without_boundary": (r["authority"] == "WITHIN_AUTHORITY") & empty(r["user_goal"]),
        "missing_mapping_confidence": r["confidence"].isNull(),
        "missing_mapping_rationale": ~r["rationale"],
        "source_mapping_not_flagged_for_review": ~r["manual"] & r["source"].isin(*heuristic),
        "source_derived_marked_confirmed": (r["status"] == "CONFIRMED") & ~r["source"].isin(*confirmed),
    })


def priority(holds: dict[str, Column], no_text_or_provenance: Column) -> tuple[Column, Column, Column]:
    """Score, band and sorted reasons (the band among them) of the conditions that POINTS names."""
    score = sum((F.when(holds[k], p).otherwise(0) for k, p in POINTS.items()), F.lit(0)).cast("long")
    blocking = F.coalesce(holds["structural_validation_error"], F.lit(False)) | ((score >= 35) & no_text_or_provenance)
    band = F.when(blocking, "P0_BLOCKING_ERROR").when(score >= 25, "P1_GOLD_CANDIDATE").when(score >= 15, "P2_MAPPING_AUDIT").when(score >= 8, "P3_COVERAGE").otherwise("P4_LOW_PRIORITY")
    return score, band, F.array_sort(F.concat(F.array(band), names({k: holds[k] for k in POINTS})))


# --- pairs that differ in one respect ----------------------------------------------------------


def pair_faults(a: str, b: str, fixed: list[str], labels: list[str], declared: Column, must_change: Column) -> Column:
    """Faults of a counterfactual pair of structs: fixed fields that differ, declared changes that aren't made and the reverse, no label changed where one must, or one where none may."""
    same = lambda f: F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))
    made = F.array_compact(F.array(*[F.when(~same(f), f) for f in labels]))
    parts = [
        F.array_compact(F.array(*[F.when(~same(f), f"invariant:{f}") for f in fixed])),
        F.transform(F.array_except(declared, made), lambda f: F.concat(F.lit("not made:"), f)),
        F.transform(F.array_except(made, declared), lambda f: F.concat(F.lit("not declared:"), f)),
        names({"no label changed": must_change & (F.size(made) == 0), "label changed": ~must_change & (F.size(made) > 0)}),
    ]
    return F.array_sort(F.concat(*parts))
