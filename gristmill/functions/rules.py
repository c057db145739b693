"""Rule tables as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import REVIEW_BELOW


def verdict(presence: Column, presentation: Column, addressee: Column, authority: Column, status: Column) -> Column:
    """DETECTED wins over an insufficient status."""
    found = (presence == "INSTRUCTION_PRESENT") & (presentation == "OPERATIVE") & (addressee == "MODEL_OR_AGENT") & authority.isin("OUTSIDE_AUTHORITY", "SPOOFED")
    open_ = (presence == "UNDETERMINED") | (presentation == "UNKNOWN") | (addressee == "UNKNOWN") | (authority == "UNKNOWN")
    return F.when(found, "DETECTED").when(status.isin("INSUFFICIENT_CONTEXT", "DISAGREEMENT") | open_, "UNCERTAIN").otherwise("NOT_DETECTED")


def review_conditions(confidence: Column, manual: Column, authority: Column, goal: Column, policy: Column, below: float = REVIEW_BELOW) -> Column:
    """Reasons for review, in a fixed order."""
    rules = [
        F.when(confidence.isNull(), "MAPPING_CONFIDENCE_MISSING").when(confidence < below, "MAPPING_CONFIDENCE_BELOW_THRESHOLD"),
        F.when(manual, "REQUIRES_MANUAL_REVIEW"),
        F.when(authority == "UNKNOWN", "AUTHORITY_STATUS_UNKNOWN"),
        F.when(goal == "UNDETERMINED", "USER_GOAL_ALIGNMENT_UNDETERMINED"),
        F.when(policy == "UNDETERMINED", "PROTECTED_POLICY_ALIGNMENT_UNDETERMINED"),
    ]
    return F.array_compact(F.array(*rules))


def issues(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def decision(exact_first: Column, representative: Column, similarity: Column, variant: float) -> Column:
    return F.when(~exact_first, "DROP_EXACT_DUPLICATE").when(representative, "KEEP").when(similarity >= variant, "KEEP_VARIANT").otherwise("REVIEW")


def record_errors(presence: Column, axes: list[Column], families: Column, stored: Column, derived: Column, text: Column, fallback: str = "OTHER_PROMPT_ATTACK") -> Column:
    """Errors of a record as `path: message`, in order, each once."""
    none = presence == "NO_INSTRUCTION"
    applicable = axes[0] != "NOT_APPLICABLE"
    for a in axes[1:]:
        applicable = applicable | (a != "NOT_APPLICABLE")
    found = [
        F.when(none & applicable, "annotations.axes: not applicable without an instruction"),
        F.when(none & (F.size(families) > 0), "annotations.families: must be empty without an instruction"),
        F.when(F.array_contains(families, fallback) & (F.size(families) != 1), "annotations.families: the fallback must stand alone"),
        F.when(stored != derived, F.concat(F.lit("annotations.verdict: differs from the one derived, "), derived)),
        F.when(F.coalesce(text, F.lit("")) == "", "content.text: must not be empty"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def mapping_error(status: Column, unmapped: Column, reasons: Column) -> Column:
    """What a mapping status leaves open, or null."""
    some = lambda x: F.size(x) > 0
    return (
        F.when((status == "DETERMINISTIC") & (some(unmapped) | some(reasons)), "DETERMINISTIC_WITH_OPEN_FIELDS")
        .when(status.isin("NEEDS_REVIEW", "EXCLUDED") & ~some(reasons), "REVIEW_WITHOUT_REASON")
        .when((status == "UNMAPPED") & ~some(unmapped), "UNMAPPED_WITHOUT_FIELDS")
    )


def release_faults(decision: Column, split: Column, method: Column, key: Column) -> tuple[Column, Column]:
    """Dropped rows and their split have to go together, and so have grouped rows and their key."""
    return (decision == "DROP_EXACT_DUPLICATE") != (split == "DROPPED_EXACT"), (method == "SOURCE_TEMPLATE_GROUP") != key.isNotNull()


def category(presence: Column, presentation: Column, addressee: Column, authority: Column, policy: Column) -> Column:
    """The first category whose condition holds."""
    return (
        F.when(presence == "UNDETERMINED", "INSUFFICIENT_CONTEXT").when(presence == "NO_INSTRUCTION", "BENIGN_CONTENT").when(presentation == "QUOTED_OR_REPORTED", "QUOTED_INSTRUCTION")
        .when(addressee == "HUMAN", "HUMAN_DIRECTED").when(authority == "SPOOFED", "SPOOFED_AUTHORITY").when(authority == "WITHIN_AUTHORITY", "AUTHORIZED_INSTRUCTION")
        .when(policy == "CONFLICTING", "POLICY_CONFLICT").otherwise("OTHER_INSTRUCTION")
    )


def objectives(base: Column, vocabulary: list[str], add: dict[str, Column], remove: dict[str, Column]) -> Column:
    """base with objectives added and removed by conditions, in the vocabulary's order."""
    some = lambda rules: F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    now = F.array_except(F.array_union(base, some(add)), some(remove))
    return F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(now, v))


def publication(components: DataFrame, work: str, part: str, redistribution: str) -> DataFrame:
    """work, blocked, blockers: a work with any component of unknown redistribution can't be published."""
    unknown = F.col(redistribution) == "unknown"
    return components.groupBy(work).agg(F.bool_or(unknown).alias("blocked"), F.array_join(F.array_sort(F.collect_list(F.when(unknown, F.col(part)))), ",").alias("blockers"))


def must_match(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined N:1 with a support table. A key that the table lacks or has twice fails the job where the row is read."""
    keyed = table.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in table.columns if c != key])).alias("_t"))
    bad = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several matches for "), F.col(key).cast("string"))))
    out = rows.join(keyed, key, "left").withColumn("_n", F.coalesce(bad.cast("long"), F.col("_n"))).filter("_n = 1")
    return out.select(*rows.columns, "_t.*")


def completeness(observed: DataFrame, *sides: DataFrame) -> DataFrame:
    """expected, observed, missing, unexpected: whether the observed combinations are the whole product of the sides (small vocabularies)."""
    product = sides[0]
    for s in sides[1:]:
        product = product.crossJoin(s)
    product = product.select(*observed.columns)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(product, "expected").join(n(observed, "observed")).join(n(product.subtract(observed), "missing")).join(n(observed.subtract(product), "unexpected"))


def compared(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, missing (annotator.field, in order), state of two annotations of the same rows; a row that one side lacks misses all its fields."""
    x, y = (df.select(key, F.struct(*fields).alias(name)) for df, name in ((a, "A"), (b, "B")))
    missing = F.array_compact(F.array(*[F.when(F.col(f"{s}.{f}").isNull(), f"{s}.{f}") for s in ("A", "B") for f in fields]))
    out = x.join(y, key, "full").withColumn("missing", missing)
    return out.select(key, F.array_join("missing", ",").alias("missing"), F.when(F.size("missing") > 0, "INCOMPLETE").when(F.col("A").eqNullSafe(F.col("B")), "AGREED").otherwise("DISAGREEMENT").alias("state"))


def marked(rows: DataFrame, column: str, rejected: Column) -> DataFrame:
    """rows whose nested marks say that they are out, where `rejected`."""
    m = F.col(column)
    out = m.withField("status", F.lit("EXCLUDED")).withField("review", F.lit("REJECTED")).withField("chk", F.lit("FAILED"))
    return rows.withColumn(column, F.when(rejected, out).otherwise(m))


def eligible(column: str) -> Column:
    return (F.col(f"{column}.review") == "PENDING") & (F.col(f"{column}.status") != "EXCLUDED") & (F.col(f"{column}.chk") == "PASSED")
