"""Selections whose steps depend on what was taken before: each step is one distributed query, and the driver holds one row of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_key
from .shared import cut


def fit_in_order(units: DataFrame, room: int, seed: int, salt: str) -> DataFrame:
    """The units (unit, size) that a walk in rank order takes when it skips each that no longer fits.

    Each step takes the longest run that fits, of units small enough for what is left; after it the room is smaller than the unit that
    ended it, so there are no more steps than unlike sizes. A step reads `room` rows of the order at most, since sizes are one or more.
    """
    ranked = units.select("unit", "size", rank_key(seed, salt, F.col("unit")).alias("rank")).filter("size > 0")
    w = Window.orderBy("rank", "unit").rowsBetween(Window.unboundedPreceding, 0)
    taken, after = ranked.limit(0), None
    while room > 0:
        open_ = ranked.filter(F.col("size") <= room)
        if after is not None:
            open_ = open_.filter(F.struct("rank", "unit") > F.struct(F.lit(after[0]), F.lit(after[1])))
        run = open_.orderBy("rank", "unit").limit(room).withColumn("upto", F.sum("size").over(w)).filter(F.col("upto") <= room).drop("upto")
        got = run.agg(F.sum("size").alias("n"), F.max(F.struct("rank", "unit")).alias("last")).first()
        if not got.n:
            break
        taken, room, after = taken.unionByName(run), room - got.n, (got["last"]["rank"], got["last"]["unit"])
    return taken.select("unit", "size")


def set_cover(units: DataFrame, target: int, seed: int) -> DataFrame:
    """unit, size, why (coverage, fill) of units (unit, size, covers: array of strings), whole units of up to `target` rows together.

    Again and again the unit that covers most of what is not covered yet is taken (then the least size, rank, unit), while it fits or is
    the first; then others by rank while they fit. There are as many steps as values to cover at most, each one aggregate over units.
    """
    units = cut(units.select("unit", "size", F.array_distinct("covers").alias("covers")))
    left = {x.v for x in units.select(F.explode("covers").alias("v")).distinct().collect()}  # a vocabulary of labels
    picked, n = [], 0
    while left and n < target:
        new = F.size(F.array_intersect("covers", F.array(*[F.lit(v) for v in sorted(left)])))
        open_ = units.filter(~F.col("unit").isin(picked)) if picked else units
        if n:
            open_ = open_.filter(F.col("size") <= target - n)
        best = open_.select(F.struct((-new).alias("new"), "size", rank_key(seed, "coverage", F.col("unit")).alias("rank"), "unit", "covers").alias("u")).filter("u.new < 0")
        u = best.agg(F.min("u").alias("u")).first().u
        if u is None:
            break
        picked.append(u.unit)
        n += u.size
        left -= set(u.covers)
    cover = units.filter(F.col("unit").isin(picked)).select("unit", "size", F.lit("coverage").alias("why"))
    others = units.filter(~F.col("unit").isin(picked)).select("unit", "size") if picked else units.select("unit", "size")
    fill = fit_in_order(others, target - n, seed, "fill").withColumn("why", F.lit("fill"))
    return cover.unionByName(fill)


def quota_plan(cells: DataFrame, each: int, marginals: dict[str, DataFrame], total: int, seed: int) -> DataFrame:
    """slot, why and a column for each marginal: `each` rows of every cell, and up to `total` rows of marginals (value, n), each
    spread over its values' counts, ordered by rank and zipped by place. A plan's size is a parameter, not the data's."""
    names = list(marginals)
    full = cells.select(*names, F.explode(F.sequence(F.lit(1), F.lit(each))).alias("i"))
    key = F.concat_ws(":", *names, F.col("i").cast("string"))
    full = full.select(key.alias("slot"), F.lit("cell").alias("why"), *names)
    rest = None
    for name, counts in marginals.items():
        spread = counts.filter("n > 0").select("value", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
        w = Window.orderBy(rank_key(seed, name, F.concat_ws(":", "value", F.col("i").cast("string"))), "value", "i")
        placed = spread.select(F.col("value").alias(name), F.row_number().over(w).alias("rn")).filter(F.col("rn") <= total)
        rest = placed if rest is None else rest.join(placed, "rn")
    return full.unionByName(rest.select(F.concat(F.lit("rest:"), F.col("rn").cast("string")).alias("slot"), F.lit("rest").alias("why"), *names))


def manifest(rows: DataFrame, key: str, body: list[str], seed: int) -> DataFrame:
    """n, digest of a selection: SHA-256 over its rows' own digests in order of the key. Selections have a set size; what is brought together is 64 characters a row."""
    one = F.sha2(F.concat_ws("\n", F.lit(str(seed)), F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in body]), 256)
    lines = F.array_sort(F.collect_list(F.struct(F.col(key), one.alias("d"))))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(lines, lambda x: x["d"]), "\n"), 256).alias("digest"))
