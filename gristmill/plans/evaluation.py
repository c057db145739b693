"""Queries of evaluation: multi-label metrics, calibration, derived verdicts, weights, losses and ranked selection, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions
from ..operators import metrics, selection
from .catalogue import EXACT, REC, SCORE, exact, query, records, scores, t

#: Two labels of a document with a probability each: a hash draw that leans to the truth.
LABELS2 = (
    "WITH h AS (SELECT doc_id, toxic, quality, sha256('p:' || doc_id) AS h FROM labels), m AS ("
    "SELECT doc_id, 'TOXIC' AS label, toxic AS truth, (CAST(('0x' || substr(h, 1, 4)) AS BIGINT) % 100 + 60 * toxic) / CAST(160 AS DOUBLE) AS p FROM h "
    "UNION ALL SELECT doc_id, 'LOW_QUALITY', 1 - quality, (CAST(('0x' || substr(h, 5, 4)) AS BIGINT) % 100 + 60 * (1 - quality)) / CAST(160 AS DOUBLE) FROM h)"
)


def label_scores(spark, sf):
    """doc_id, label, truth, p of two labels."""
    h = t(spark, sf, "labels").withColumn("h", F.sha2(F.concat(F.lit("p:"), F.col("doc_id").cast("string")), 256))
    draw = lambda at, truth: (F.conv(F.substring("h", at, 4), 16, 10).cast("long") % 100 + 60 * truth) / F.lit(160.0)
    low = 1 - F.col("quality")
    both = F.array(F.struct(F.lit("TOXIC").alias("label"), F.col("toxic").alias("truth"), draw(1, F.col("toxic")).alias("p")), F.struct(F.lit("LOW_QUALITY").alias("label"), low.alias("truth"), draw(5, low).alias("p")))
    return h.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")


@query(LABELS2 + " SELECT label, count(*) FILTER (truth = 1) AS support, count(*) FILTER (p >= 0.5) AS said, count(*) FILTER (truth = 1 AND p >= 0.5) AS tp, round(count(*) FILTER (p >= 0.5) / count(*), 9) AS positive_rate, round(2 * count(*) FILTER (truth = 1 AND p >= 0.5) / greatest(count(*) FILTER (truth = 1) + count(*) FILTER (p >= 0.5), 1), 9) AS f1 FROM m GROUP BY label")
def multi_label_by_label(spark, sf):
    return metrics.by_label(label_scores(spark, sf))


@query(LABELS2 + ", c AS (SELECT label, CAST(count(*) FILTER (truth = 1 AND p >= 0.5) AS DOUBLE) AS tp, count(*) FILTER (truth = 1) + count(*) FILTER (p >= 0.5) AS both_ FROM m GROUP BY label), d AS (SELECT doc_id, count(*) FILTER (truth = 1 AND p >= 0.5) AS tp, count(*) FILTER (truth = 1) + count(*) FILTER (p >= 0.5) AS both_, bool_and((truth = 1) = (p >= 0.5)) AS same FROM m GROUP BY doc_id) SELECT round((SELECT 2 * sum(tp) / sum(both_) FROM c), 9) AS micro_f1, round((SELECT avg(2 * tp / greatest(both_, 1)) FROM c), 9) AS macro_f1, round((SELECT avg(CASE WHEN both_ = 0 THEN 0.0 ELSE 2 * tp / both_ END) FROM d), 9) AS samples_f1, round((SELECT avg(CAST(same AS INT)) FROM d), 9) AS subset_accuracy")
def multi_label_metrics(spark, sf):
    return metrics.multi_label(label_scores(spark, sf)).select(*[F.round(c, 9).alias(c) for c in ("micro_f1", "macro_f1", "samples_f1", "subset_accuracy")])


@query(LABELS2 + ", g AS (SELECT unnest(range(10, 91)) / CAST(100 AS DOUBLE) AS th), b AS (SELECT label, p, sum(truth) AS pos, count(*) AS k FROM m GROUP BY ALL), c AS (SELECT label, th, sum(pos) AS pos, sum(k) AS n, sum(CASE WHEN p >= th THEN pos ELSE 0 END) AS tp, sum(CASE WHEN p >= th THEN k ELSE 0 END) AS said FROM b, g GROUP BY ALL), r AS (SELECT *, 2.0 * tp / (pos + said) AS f1 FROM c WHERE said < n AND pos >= 5 AND n - pos >= 5), z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, abs(th - 0.5), th DESC) AS rn FROM r) SELECT label, th AS threshold, round(f1, 9) AS f1 FROM z WHERE rn = 1")
def calibrated_thresholds(spark, sf):
    return metrics.calibrated(label_scores(spark, sf), 5).select("label", "threshold", F.round("f1", 9).alias("f1"))


@query(LABELS2 + " SELECT label, round(least(greatest(count(*) FILTER (truth = 0) / greatest(count(*) FILTER (truth = 1), 1), 0.25), 10.0), 9) AS weight FROM m GROUP BY label")
def positive_weights(spark, sf):
    pos, neg = (F.count(F.when(F.col("truth") == v, 1)) for v in (1, 0))
    return label_scores(spark, sf).groupBy("label").agg(F.round(F.least(F.greatest(neg / F.greatest(pos, F.lit(1)), F.lit(0.25)), F.lit(10.0)), 9).alias("weight"))


@query(LABELS2 + ", v AS (SELECT unnest(['TOXIC', 'LOW_QUALITY', 'OTHER']) AS label), a AS (SELECT label, count(*) FILTER (truth = 1) AS support, count(*) FILTER (truth = 0) AS negatives FROM m GROUP BY label), z AS (SELECT count(*) AS zero FROM (SELECT doc_id FROM m GROUP BY doc_id HAVING sum(truth) = 0)) SELECT v.label, coalesce(support, 0) AS support, coalesce(negatives, 0) AS negatives, coalesce(support, 0) = 0 AS absent, zero AS all_zero_rows FROM v LEFT JOIN a ON a.label = v.label, z")
def class_audit(spark, sf):
    return metrics.class_audit(label_scores(spark, sf), ["TOXIC", "LOW_QUALITY", "OTHER"])


@query(LABELS2 + " SELECT label, round(avg(-(truth * ln(greatest(least(p, 0.999999), 0.000001)) + (1 - truth) * ln(1 - greatest(least(p, 0.999999), 0.000001)))), 6) AS bce, round(avg(-(truth * pow(1 - p, 2) * ln(greatest(p, 0.000001)) + (1 - truth) * pow(p, 2) * ln(greatest(1 - p, 0.000001)))), 6) AS focal FROM m GROUP BY label")
def loss_values(spark, sf):
    m = label_scores(spark, sf)
    return m.groupBy("label").agg(F.round(F.avg(metrics.bce(F.col("truth"), F.col("p"))), 6).alias("bce"), F.round(F.avg(metrics.focal(F.col("truth"), F.col("p"), 2)), 6).alias("focal"))


@query(SCORE + ", v AS (SELECT unnest([0, 1]) AS v), c AS (SELECT v, count(*) FILTER (truth = v) AS s, count(*) FILTER (pred = v) AS said, count(*) FILTER (truth = v AND pred = v) AS tp FROM p, v GROUP BY v) SELECT round(avg(tp / s) FILTER (s > 0), 9) AS balanced_accuracy, round(avg(CASE WHEN said > 0 THEN tp / said ELSE 0 END), 9) AS macro_precision, round(avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END), 9) AS macro_recall, round(avg(2 * tp / greatest(s + said, 1)), 9) AS macro_f1, round(sum(s * 2 * tp / greatest(s + said, 1)) / sum(s), 9) AS weighted_f1, round(sum(tp) / sum(s), 9) AS accuracy FROM c")
def averaged_metrics(spark, sf):
    out = metrics.averages(metrics.per_class(metrics.confusion(scores(spark, sf), [0, 1])))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(SCORE + ", b AS (SELECT least(CAST(floor(CAST(score AS DOUBLE) * 10 + 1e-9) AS BIGINT), 9) AS bin, truth FROM m) SELECT bin, count(*) AS n, sum(truth) AS positives FROM b GROUP BY bin")
def score_histogram(spark, sf):
    b = scores(spark, sf).select(F.least(F.floor(F.col("score") * 10 + 1e-9), F.lit(9)).cast("long").alias("bin"), "truth")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.sum("truth").alias("positives"))


#: Weights of the heads in the robust score and what false alarms cost.
ROBUST, FALSE_ALARM = {"verdict": 0.5, "lang": 0.3, "source": 0.2}, 0.25


@query(SCORE + ", x AS (SELECT truth, pred, lang, source FROM p JOIN documents USING (doc_id)), o AS (SELECT avg(CAST(truth = pred AS INT)) AS verdict FROM x), l AS (SELECT avg(a) AS lang FROM (SELECT avg(CAST(truth = pred AS INT)) AS a FROM x GROUP BY lang)), s AS (SELECT avg(a) AS source FROM (SELECT avg(CAST(truth = pred AS INT)) AS a FROM x GROUP BY source)), f AS (SELECT count(*) FILTER (truth = 0 AND pred = 1) / count(*) FILTER (truth = 0) AS fpr FROM x) SELECT round((verdict + lang + source) / 3, 9) AS core_mean, round(0.5 * verdict + 0.3 * lang + 0.2 * source - 0.25 * fpr, 9) AS robust FROM o, l, s, f")
def robust_score(spark, sf):
    x = scores(spark, sf).join(t(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("hit", (F.col("truth") == F.col("pred")).cast("int"))
    cells = x.groupBy("lang", "source").agg(F.sum("hit").alias("h"), F.count("*").alias("n"), F.count(F.when((F.col("truth") == 0) & (F.col("pred") == 1), 1)).alias("fp"), F.count(F.when(F.col("truth") == 0, 1)).alias("neg"))
    mean = lambda *by: cells.groupBy(*by).agg((F.sum("h") / F.sum("n")).alias("a"), F.sum("fp").alias("fp"), F.sum("neg").alias("neg"))
    one = mean().select(F.col("a").alias("verdict"), (F.col("fp") / F.col("neg")).alias("fpr"))
    for by in ("lang", "source"):
        one = one.join(mean(by).agg(F.avg("a").alias(by)))
    heads = list(ROBUST)
    return one.select(F.round(sum(F.col(h) for h in heads) / len(heads), 9).alias("core_mean"), F.round(sum(F.col(h) * w for h, w in ROBUST.items()) / sum(ROBUST.values()) - FALSE_ALARM * F.col("fpr"), 9).alias("robust"))


# --- heads and verdicts from vectors ---------------------------------------------------

_SOFT = "list_transform({x}, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max({x}) AS DOUBLE)))"


def _soft(a: int, b: int) -> str:
    x = f"embedding[{a}:{b}]"
    return f"list_transform({_SOFT.format(x=x)}, lambda v: v / list_sum({_SOFT.format(x=x)}))"


HEADS = f"WITH e AS (SELECT vec_id, {_soft(1, 3)} AS presence, {_soft(4, 8)} AS presentation, {_soft(9, 13)} AS addressee, {_soft(14, 18)} AS authority, 1 / (1 + exp(-CAST(embedding[19] AS DOUBLE) * 8)) AS direct FROM embeddings), q AS (SELECT *, least(greatest(presence[2] * presentation[1] * addressee[1] * (authority[2] + authority[3]), 0.0), 1.0) AS derived FROM e)"


def heads(spark, sf):
    return decisions.heads(t(spark, sf, "embeddings"))


@query(HEADS + " SELECT vec_id, round(derived, 9) AS derived, round(direct, 9) AS direct FROM q")
def derived_probability(spark, sf):
    return heads(spark, sf).select("vec_id", F.round("derived", 9).alias("derived"), F.round("direct", 9).alias("direct"))


@query(HEADS + " SELECT vec_id, CASE WHEN direct >= 0.5 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS direct, CASE WHEN list_position(presence, list_max(presence)) = 3 THEN 'UNCERTAIN' WHEN derived >= 0.02 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS derived, CASE WHEN 0.5 * direct + 0.5 * derived >= 0.3 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS blended FROM q")
def verdict_strategies(spark, sf):
    return decisions.strategies(heads(spark, sf), direct=0.5, derived=0.02, blended=0.3, alpha=0.5)


@query(HEADS + ", l AS (SELECT *, CAST(label % 2 AS INT) AS truth FROM q JOIN (SELECT vec_id AS v2, label FROM embeddings) ON v2 = vec_id), g AS (SELECT unnest(range(0, 11)) / CAST(10 AS DOUBLE) AS alpha), c AS (SELECT alpha, count(*) FILTER (truth = 1 AND s >= 0.3) AS tp, count(*) FILTER (truth = 1 AND s < 0.3) AS fn, count(*) FILTER (truth = 0 AND s >= 0.3) AS fp, count(*) FILTER (truth = 0 AND s < 0.3) AS tn FROM (SELECT alpha, truth, alpha * direct + (1 - alpha) * derived AS s FROM l, g) GROUP BY alpha), r AS (SELECT alpha, round((2 * tp / greatest(2 * tp + fp + fn, 1) + 2 * tn / greatest(2 * tn + fp + fn, 1)) / 2 - 0.5 * fp / greatest(fp + tn, 1), 9) AS objective FROM c) SELECT alpha, objective FROM r ORDER BY objective DESC, alpha LIMIT 1")
def alpha_selection(spark, sf):
    truth = t(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).alias("truth"))
    return decisions.best_alpha(heads(spark, sf).join(truth, "vec_id"), 0.3, 0.5)


@query("SELECT vec_id, list_transform(range(1, 5), lambda i: CASE WHEN 1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))) >= 0.5 THEN 1 ELSE 0 END) AS bits FROM embeddings".replace(" AS bits", "::VARCHAR AS bits"))
def sigmoid_decode(spark, sf):
    bits = F.transform(F.slice("embedding", 1, 4), lambda v: (decisions.sigmoid(v) >= 0.5).cast("int").cast("string"))
    return t(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(bits, ", "), F.lit("]")).alias("bits"))


@query("SELECT c_custkey, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS label_id, array_to_string(list_transform(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], lambda v: CASE WHEN v = c_mktsegment THEN '1' ELSE '0' END), '') AS multi_hot FROM customer")
def label_ids(spark, sf):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    c = t(spark, sf, "customer")
    return c.select("c_custkey", decisions.label_id(F.col("c_mktsegment"), names).alias("label_id"), F.array_join(F.transform(decisions.multi_hot(F.array("c_mktsegment"), names), lambda x: x.cast("int").cast("string")), "").alias("multi_hot"))


# --- ranked selection -------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id, sha256('7:take:' || doc_id) AS rank FROM documents) SELECT doc_id, rank FROM r ORDER BY rank, doc_id LIMIT 25")
def rank_and_take(spark, sf):
    return selection.take_ranked(t(spark, sf, "documents").select("doc_id"), 25, 7, "take", "doc_id")


@query("WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('7:donor:' || doc_id), doc_id) AS nth FROM documents) SELECT doc_id, source, lang, nth FROM r WHERE nth <= 3")
def capacity_selection(spark, sf):
    return selection.first_in_cells(t(spark, sf, "documents").select("doc_id", "source", "lang"), ["source", "lang"], 3, 7, "donor", "doc_id")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:slot:' || doc_id), doc_id) AS ordinal FROM documents) SELECT doc_id, lang, ordinal, (ordinal - 1) % 4 AS policy FROM r")
def round_robin(spark, sf):
    return selection.numbered(t(spark, sf, "documents").select("doc_id", "lang"), "lang", 7, "slot", "doc_id").withColumn("policy", (F.col("ordinal") - 1) % 4)


@query("WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('7:side:' || doc_id), doc_id) AS nth FROM labels) SELECT doc_id, toxic, row_number() OVER (ORDER BY nth, toxic) AS place FROM r")
def interleaved(spark, sf):
    return selection.interleave(t(spark, sf, "labels").select("doc_id", "toxic"), "toxic", 7, "side", "doc_id")


@query("WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY sha256('7:turn:' || n_nationkey)) AS rn, count(*) OVER () AS n FROM nation) SELECT n_nationkey, (rn - 1 - 5 + n) % n AS place FROM r")
def rotated(spark, sf):
    return selection.rotate(t(spark, sf, "nation").select("n_nationkey"), 5, 7, "turn", "n_nationkey")


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY sha256('7:a:' || n_nationkey)) AS rn FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY sha256('7:b:' || r_regionkey)) AS rn FROM region) SELECT rn, n_name, r_name FROM a JOIN b USING (rn)")
def zipped_marginals(spark, sf):
    a, b = (selection.positions(t(spark, sf, name).select(key, val), 7, salt, key).select("rn", val) for name, key, val, salt in (("nation", "n_nationkey", "n_name", "a"), ("region", "r_regionkey", "r_name", "b")))
    return a.join(b, "rn").select("rn", "n_name", "r_name")


@query(EXACT + " SELECT exact_key, min_by(source, id) FILTER (lang = 'en') AS group_key FROM e GROUP BY exact_key")
def first_group_key(spark, sf):
    e = exact(spark, sf)
    return e.groupBy("exact_key").agg(F.min_by(F.when(F.col("lang") == "en", F.col("source")), F.when(F.col("lang") == "en", F.col("id"))).alias("group_key"))


@query("WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS rn, count(*) OVER () AS n FROM documents), q AS (SELECT unnest([0.0, 0.25, 0.5, 0.9, 0.95, 1.0]) AS q) SELECT CAST(q AS DOUBLE) AS q, n_chars AS value FROM s JOIN q ON rn = round_even((n - 1) * CAST(q AS DOUBLE), 0)")
def linear_percentiles(spark, sf):
    return selection.at_ranks(t(spark, sf, "documents"), "n_chars", [0.0, 0.25, 0.5, 0.9, 0.95, 1.0])


@query(REC + ", g AS (SELECT source || ':' || quality AS grp, id, toxic FROM rec WHERE quality IS NOT NULL), two AS (SELECT grp FROM g GROUP BY grp HAVING count(*) = 2) SELECT a.grp AS \"group\", a.id AS a, b.id AS b, a.toxic = b.toxic AS same FROM g a JOIN g b ON a.grp = b.grp AND a.id < b.id JOIN two ON two.grp = a.grp")
def pairs_of_two(spark, sf):
    g = records(spark, sf).filter("quality is not null").select(F.concat_ws(":", "source", "quality").alias("group"), "id", "toxic")
    return selection.exact_pairs(g, "group", "id").select("group", "a", "b", (F.col("x.toxic") == F.col("y.toxic")).alias("same"))
