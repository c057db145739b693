"""Classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import running


def confusion(rows: DataFrame, labels: list) -> DataFrame:
    """truth, pred, n over the whole vocabulary (0 where there are no rows)."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(t, p) for t in labels for p in labels], "truth int, pred int")
    counts = rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return cells.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 (0 where undefined)."""
    truth, pred = conf.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support")), conf.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    hit = conf.filter("truth = pred").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    p, r = (F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(0.0) for d in ("said", "support"))
    return truth.join(pred, "label").join(hit, "label").select("label", "support", p.alias("precision"), r.alias("recall"), F.when(F.col("support") + F.col("said") > 0, 2 * F.col("tp") / (F.col("support") + F.col("said"))).otherwise(0.0).alias("f1"))


def curve(rows: DataFrame) -> DataFrame:
    """score, tp, fp at or above each distinct score. Counts by score are combined before the running sums, which run within ranges of scores."""
    by = rows.groupBy("score").agg(F.sum("truth").alias("t"), F.count("*").alias("k"))
    return running(by, -F.col("score"), {"tp": "t", "all": "k"}).select("score", "tp", (F.col("all") - F.col("tp")).alias("fp"), "t", (F.col("k") - F.col("t")).alias("f"))


def average_precision(rows: DataFrame) -> DataFrame:
    return curve(rows).agg((F.sum(F.col("t") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("t")).alias("average_precision"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area by trapezoids over distinct scores; null with one class only."""
    return curve(rows).agg((F.sum(F.col("f") * (F.col("tp") - F.col("t") / 2)) / F.nullif(F.sum("t") * F.sum("f"), F.lit(0))).alias("roc_auc"))


def by_label(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """label, support, said, tp, positive_rate, f1 of rows (label, truth, p)."""
    yes, said = F.col("truth") == 1, F.col("p") >= least
    c = rows.groupBy("label").agg(F.count(F.when(yes, 1)).alias("support"), F.count(F.when(said, 1)).alias("said"), F.count(F.when(yes & said, 1)).alias("tp"), F.count("*").alias("n"))
    return c.select("label", "support", "said", "tp", F.round(F.col("said") / F.col("n"), 9).alias("positive_rate"), F.round(2 * F.col("tp") / F.greatest(F.col("support") + F.col("said"), F.lit(1)), 9).alias("f1"))


def multi_label(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """micro_f1, macro_f1, samples_f1, subset_accuracy of rows (doc_id, label, truth, p); 0 where a ratio is undefined."""
    yes, said = F.col("truth") == 1, F.col("p") >= least
    tp, both = F.count(F.when(yes & said, 1)), F.count(F.when(yes, 1)) + F.count(F.when(said, 1))
    f1 = 2 * F.col("tp") / F.greatest(F.col("both"), F.lit(1))
    labels = rows.groupBy("label").agg(tp.alias("tp"), both.alias("both")).agg((2 * F.sum("tp") / F.greatest(F.sum("both"), F.lit(1))).alias("micro_f1"), F.avg(f1).alias("macro_f1"))
    docs = rows.groupBy("doc_id").agg(tp.alias("tp"), both.alias("both"), F.bool_and(yes == said).alias("same")).agg(F.avg(f1).alias("samples_f1"), F.avg(F.col("same").cast("int")).alias("subset_accuracy"))
    return labels.join(docs)


def calibrated(rows: DataFrame, support: int) -> DataFrame:
    """label, threshold, f1: the best threshold of each label on a grid of hundredths from 0.10 to 0.90.

    Thresholds that say yes to all rows don't count, nor labels with less support of either kind; ties go to the threshold closest to 0.5, then the larger.
    Rows meet the grid by distinct score.
    """
    by = rows.groupBy("label", "p").agg(F.sum("truth").alias("pos"), F.count("*").alias("k"))
    grid = by.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(10), F.lit(90)), lambda k: k / F.lit(100.0))))
    over = F.col("p") >= F.col("threshold")
    c = grid.groupBy("label", "threshold").agg(F.sum("pos").alias("pos"), F.sum("k").alias("n"), F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("k")).otherwise(0)).alias("said"))
    c = c.filter((F.col("said") < F.col("n")) & (F.col("pos") >= support) & (F.col("n") - F.col("pos") >= support)).withColumn("f1", 2 * F.col("tp") / (F.col("pos") + F.col("said")))
    best = c.groupBy("label").agg(F.max(F.struct("f1", (-F.abs(F.col("threshold") - 0.5)).alias("close"), "threshold")).alias("b"))
    return best.select("label", "b.threshold", "b.f1")


def class_audit(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """label, support, negatives, absent of every label of the vocabulary, and the number of documents without any label."""
    spark = rows.sparkSession
    zero = rows.groupBy("doc_id").agg(F.sum("truth").alias("s")).agg(F.count(F.when(F.col("s") == 0, 1)).alias("all_zero_rows"))
    have = rows.groupBy("label").agg(F.count(F.when(F.col("truth") == 1, 1)).alias("support"), F.count(F.when(F.col("truth") == 0, 1)).alias("negatives"))
    every = spark.createDataFrame([(v,) for v in vocabulary], "label string").join(have, "label", "left")
    support = F.coalesce("support", F.lit(0).cast("long"))
    return every.select("label", support.alias("support"), F.coalesce("negatives", F.lit(0).cast("long")).alias("negatives"), (support == 0).alias("absent")).join(zero)


def averages(classes: DataFrame) -> DataFrame:
    """Balanced accuracy (of classes that occur), macro and weighted figures and accuracy from per_class()."""
    n = F.sum("support")
    return classes.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("support") * F.col("f1")) / n).alias("weighted_f1"), (F.sum(F.col("support") * F.col("recall")) / n).alias("accuracy"))


def bce(truth, p, floor: float = 1e-6):
    """Binary cross-entropy of one row."""
    q = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return -(truth * F.log(q) + (1 - truth) * F.log(1 - q))


def focal(truth, p, power: float, floor: float = 1e-6):
    """Focal loss of one row."""
    return -(truth * F.pow(1 - p, F.lit(power)) * F.log(F.greatest(p, F.lit(floor))) + (1 - truth) * F.pow(p, F.lit(power)) * F.log(F.greatest(1 - p, F.lit(floor))))
