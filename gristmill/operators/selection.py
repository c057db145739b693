"""Splits, apportionment and ranked selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank_key, stable_draw
from .shared import cut


def ratio_split(cluster: Column, seed: int, ratios: dict[str, float]) -> Column:
    """A split by the cluster's stable draw against cumulative ratios; the last takes the rest."""
    draw, at, out = stable_draw(seed, cluster), 0.0, None
    names = list(ratios)
    for name in names[:-1]:
        at += ratios[name]
        out = F.when(draw < at, name) if out is None else out.when(draw < at, name)
    return out.otherwise(names[-1])


def cluster_splits(members: DataFrame, seed: int, ratios: dict[str, float], held_out: Column) -> DataFrame:
    """members (id, cluster, kept, ...) with split: held-out clusters whole, others by ratio, dropped rows apart."""
    per = members.groupBy("cluster").agg(F.max(held_out.cast("int")).alias("held"))
    split = F.when(~F.col("kept"), "DROPPED_EXACT").when(F.col("held") == 1, "TEST_SOURCE_OOD").otherwise(ratio_split(F.col("cluster"), seed, ratios))
    return members.join(per, "cluster").withColumn("split", split).drop("held")


def take_to_target(groups: DataFrame, target: Column, seed: int, salt: str) -> DataFrame:
    """groups (group, size) with taken: in rank order while the sizes before don't reach the target.

    Sums run within 256 ranges of the rank hash first, so no task sees all groups.
    """
    ranked = groups.withColumn("rank", rank_key(seed, salt, F.col("group"))).withColumn("range", F.substring("rank", 1, 2))
    sums = ranked.groupBy("range").agg(F.sum("size").alias("s"))
    w = Window.orderBy("range")
    sums = sums.select("range", (F.sum("s").over(w) - F.col("s")).alias("before"))
    inner = F.sum("size").over(Window.partitionBy("range").orderBy("rank", "group")) - F.col("size")
    return ranked.join(F.broadcast(sums), "range").withColumn("taken", F.col("before") + inner < target).drop("range", "rank", "before")


def apportion(weights: DataFrame, total: int, order: str = "key") -> DataFrame:
    """key, quota by largest remainder of total * weight / sum of weights, ties in order. weights: one row for each category."""
    every = Window.partitionBy()
    exact = F.col("weight").cast("decimal(28,10)") * total
    whole = weights.withColumn("all", F.sum("weight").over(every)).withColumn("quota", F.floor(exact / F.col("all")).cast("long"))
    whole = whole.withColumn("left", F.lit(total) - F.sum("quota").over(every)).withColumn("rest", exact - F.col("quota") * F.col("all"))
    nth = F.row_number().over(Window.orderBy(F.desc("rest"), order))
    return whole.select("key", (F.col("quota") + F.when(nth <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def one_per_group(rows: DataFrame, group: str, seed: int, salt: str) -> DataFrame:
    """The row of least rank hash of each group: an aggregate, so hot groups meet combined."""
    cols = [c for c in rows.columns if c != group]
    best = rows.groupBy(group).agg(F.min_by(F.struct(*cols), F.struct(rank_key(seed, salt, F.col("id")), F.col("id"))).alias("_r"))
    return best.select(group, "_r.*")


def take_ranked(rows: DataFrame, k: int, seed: int, salt: str, key: str) -> DataFrame:
    """The k rows of least rank hash, with it."""
    return rows.withColumn("rank", rank_key(seed, salt, F.col(key).cast("string"))).orderBy("rank", key).limit(k)


def numbered(rows: DataFrame, part: str, seed: int, salt: str, key: str) -> DataFrame:
    """rows with ordinal: place from 1 within its part, in rank order."""
    w = Window.partitionBy(part).orderBy(rank_key(seed, salt, F.col(key).cast("string")), key)
    return rows.withColumn("ordinal", F.row_number().over(w).cast("long"))


def first_in_cells(rows: DataFrame, cell: list[str], capacity: int, seed: int, salt: str, key: str) -> DataFrame:
    """Of each cell the first `capacity` rows in rank order, with nth. A window group limit keeps a hot cell to its first rows in each task."""
    w = Window.partitionBy(*cell).orderBy(rank_key(seed, salt, F.col(key).cast("string")), key)
    return rows.withColumn("nth", F.row_number().over(w).cast("long")).filter(F.col("nth") <= capacity)


def running(rows: DataFrame, order: Column | list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with running sums (new column: summed column) in a global order of unlike keys. Ranges are summed apart and begin after
    the totals of those before, so no task sees all rows."""
    order = order if isinstance(order, list) else [order]
    keys = [f"_k{i}" for i in range(len(order))]
    # one written copy: ranges are sampled anew in each run of a plan, and totals and rows have to agree
    ranged = cut(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_t{n}") for n, v in sums.items()])
    before = [(F.sum(f"_t{n}").over(Window.orderBy("_range")) - F.col(f"_t{n}")).alias(f"_b{n}") for n in sums]  # a row a range
    inner = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(totals.select("_range", *before)), "_range")
    return out.withColumns({n: F.col(f"_b{n}") + F.sum(v).over(inner) for n, v in sums.items()}).drop(*keys, "_range", *[f"_b{n}" for n in sums])


def placed(rows: DataFrame, *order) -> DataFrame:
    """rows with place: row number from 1 in a global order."""
    return running(rows.withColumn("_one", F.lit(1)), list(order), {"place": "_one"}).withColumn("place", F.col("place").cast("long")).drop("_one")


def positions(rows: DataFrame, seed: int, salt: str, key: str) -> DataFrame:
    """rows with rn: place from 1 in rank order."""
    return placed(rows, rank_key(seed, salt, F.col(key).cast("string")), F.col(key)).withColumnRenamed("place", "rn")


def interleave(rows: DataFrame, side: str, seed: int, salt: str, key: str) -> DataFrame:
    """rows with place: ranked within each side, the sides alternate."""
    return placed(numbered(rows, side, seed, salt, key), F.col("ordinal"), F.col(side)).drop("ordinal")


def rotate(rows: DataFrame, by: int, seed: int, salt: str, key: str) -> DataFrame:
    """rows with place from 0: the ranked list with its first `by` at the end."""
    n = F.count("*").over(Window.partitionBy())
    return positions(rows, seed, salt, key).withColumn("place", F.pmod(F.col("rn") - 1 - by, n)).drop("rn")


def at_ranks(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """q, value: the element at index round((n - 1) q), halves to even, of the sorted values. Equal values are one row in the running count."""
    by = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("k"))
    total = by.agg(F.sum("k").alias("n"))
    upto = by.select("value", "k", F.sum("k").over(Window.orderBy("value")).alias("upto"))
    asked = total.select("n", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("q")).select("q", F.bround((F.col("n") - 1) * F.col("q"), 0).cast("long").alias("at"))
    return upto.join(F.broadcast(asked), (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("k"))).select("q", "value")


def exact_pairs(rows: DataFrame, group: str, key: str) -> DataFrame:
    """group, a, b, x, y: the two rows of each group of exactly two, the lesser key first."""
    two = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(F.struct(key, F.struct(*rows.columns).alias("r"))).alias("p"), F.max(F.struct(key, F.struct(*rows.columns).alias("r"))).alias("q")).filter("n = 2")
    return two.select(group, F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"), F.col("p.r").alias("x"), F.col("q.r").alias("y"))


def staged_splits(groups: DataFrame, seed: int, stages: list[tuple[str, str, float, int | None]], rest: str) -> DataFrame:
    """groups (group, size, split or null) with every split set: each stage (salt, split, ratio, total) takes open groups in rank
    order until its target is reached. The target is ratio times the total (of open groups if None), halves to even, one at least."""
    out = cut(groups)
    for salt, name, ratio, total in stages:
        open_ = out.filter("split is null")
        n = total if total is not None else open_.agg(F.sum("size")).first()[0] or 0
        target = max(1, round(ratio * n)) if ratio > 0 else 0
        taken = take_to_target(open_.select("group", "size"), F.lit(target), seed, salt).filter("taken").select("group", F.lit(name).alias("_s"))
        out = cut(out.join(taken, "group", "left").withColumn("split", F.coalesce("split", "_s")).drop("_s"))
    return out.withColumn("split", F.coalesce("split", F.lit(rest)))


def guards(groups: DataFrame, shares: dict[str, float], least: int) -> DataFrame:
    """split, n, missing, underpowered, deviates (by more than the largest group) of the splits that have a share of all."""
    spark = groups.sparkSession
    whole = groups.agg(F.sum("size").alias("total"), F.max("size").alias("largest"))
    want = spark.createDataFrame(list(shares.items()), "split string, share double")
    got = want.join(groups.groupBy("split").agg(F.sum("size").alias("n")), "split", "left").join(whole)
    n = F.coalesce("n", F.lit(0).cast("long"))
    return got.select("split", n.alias("n"), F.col("n").isNull().alias("missing"), (n < least).alias("underpowered"), (F.abs(n - F.col("share") * F.col("total")) > F.col("largest")).alias("deviates"))


def fill_to_target(rows: DataFrame, protected: str, target: int, seed: int, salt: str, key: str) -> DataFrame:
    """All protected rows, and others in rank order until there are `target` rows."""
    room = max(0, target - rows.filter(protected).count())
    rest = rows.filter(f"not {protected}").orderBy(rank_key(seed, salt, F.col(key)), key).limit(room)
    return rows.filter(protected).unionByName(rest)
