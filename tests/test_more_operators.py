"""Operators that have no SQL: against models, exact round trips, and what has to fail."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gristmill.functions import decisions, rules, text
from gristmill.operators import dedup, selection
from gristmill.plans import catalogue
from gristmill.sources import readers, sinks
from gristmill.streaming import events


def test_components_are_those_of_union_find(spark):
    r = random.Random(1)
    rows = [(n, f"k{r.randrange(90)}") for n in range(150) for _ in range(r.choice([1, 1, 2]))] + [(500, "alone"), (3, "x"), (3, "x")]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for n, k in rows:
        label[root(n)] = root(k)
    least = defaultdict(lambda: 10**9)
    for n, _ in rows:
        least[root(n)] = min(least[root(n)], n)
    out = dedup.components(spark.createDataFrame(rows, "node long, key string"))
    assert {x["node"]: x["component"] for x in out.collect()} == {n: least[root(n)] for n, _ in rows}
    assert dedup.components(spark.createDataFrame([], "node long, key string")).count() == 0


def test_closure(spark):
    links = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3")], "node string, key string")
    assert {x["node"] for x in dedup.closure(links, F.col("key") == "2").collect()} == {"a", "b", "c"}


def words(r, base, n):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randrange(9)}"
    return " ".join(w)


def test_similar_pairs_with_copies(spark):
    """All pairs that reach the threshold, with their similarity, copies and texts without tokens among them."""
    r = random.Random(2)
    bases = [[f"w{r.randrange(300)}" for _ in range(r.choice([4, 9, 25]))] for _ in range(8)]
    given = [words(r, r.choice(bases), r.choice([0, 0, 1, 2, 5])) for _ in range(70)] + ["", "!!", "?", "the all"]
    feats = dedup.features(spark.createDataFrame([(f"r{k:03}", x) for k, x in enumerate(given)], "id string, text string")).cache()
    rows = {x["id"]: x for x in feats.collect()}
    jac = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    want = {}
    for a in rows:
        for b in rows:
            if a < b:
                x, y = rows[a], rows[b]
                s = 1.0 if x["joined"] == y["joined"] else 0.5 * jac(x["tokens"], y["tokens"]) + 0.25 * jac(x["bigrams"], y["bigrams"]) + 0.25 * jac(x["trigrams"], y["trigrams"])
                if s >= 0.72:
                    want[a, b] = s
    got = {(x["a"], x["b"]): x["similarity"] for x in dedup.similar_pairs(feats, 0.72).collect()}
    assert got == pytest.approx(want) and len(want) > 40


def test_support_tables_must_match_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    assert {(x["n"], x["v"]) for x in rules.must_match(rows, table, "k").collect()} == {(1, 10), (2, 20)}
    for bad in (table.filter("k = 'a'"), table.unionByName(table.filter("k = 'b'"))):
        with pytest.raises(Exception, match="match"):
            rules.must_match(rows, bad, "k").collect()
    out = rules.completeness(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string"), spark.createDataFrame([("a",), ("b",)], "p string"), spark.createDataFrame([("x",), ("y",)], "q string")).first()
    assert tuple(out) == (4, 3, 1, 0)
    with pytest.raises(Exception, match="unknown label"):
        rows.select(decisions.label_id(F.col("k"), ["a"])).collect()


def test_text_rules(spark):
    one = lambda x: spark.range(1).select(x).first()[0]
    assert one(text.canonical_id("rec", F.lit("  My Set-2! "), {"b": F.lit(None).cast("string"), "a": F.lit("x")})).startswith("rec_my_set_2_")
    assert one(text.quoted(F.lit("say ( go ) now"), F.lit(6), F.lit(8), "([", ")]")) and not one(text.quoted(F.lit("say ( go ] now"), F.lit(6), F.lit(8), "([", ")]"))
    assert one(text.cell(F.lit("a|b\\c\nd"))) == "a\\|b\\\\c d" and one(text.percent(F.lit(1), F.lit(0))) == "0.00%"
    assert one(text.nth_occurrence(F.lit("aaaa"), "aa", 2)) == 2 and one(text.nth_occurrence(F.lit("aaaa"), "aa", 3)) == -1


def test_running_sums_and_places(spark):
    rows = [(k * 37 % 101, k) for k in range(101)]
    out = selection.running(spark.createDataFrame(rows, "k int, v long").repartition(5), F.col("k"), {"s": "v"})
    want, total = {}, 0
    for k, v in sorted(rows):
        want[k] = total = total + v
    assert {x["k"]: x["s"] for x in out.collect()} == want
    assert selection.placed(spark.createDataFrame([], "k int"), F.col("k")).count() == 0


def test_readers_and_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame(rows, "id string, n int") for rows in ([("1", 1), ("2", 2)], [("2", 3), ("3", 4)]))
    (tmp_path / "rel").mkdir()
    for name, df in (("a", a), ("b", b)):
        (tmp_path / "rel" / f"{name}.jsonl").write_text("\n".join(df.toJSON().collect()) + "\n")
    assert {(x["id"], x["n"]) for x in readers.release(spark, str(tmp_path / "rel"), "id string, n int").collect()} == {("1", 1), ("2", 2), ("3", 4)}
    assert {x["id"] for x in readers.release(spark, str(tmp_path / "rel"), "id string, n int", ("a.jsonl",)).collect()} == {"2", "3"}
    assert readers.json_lines(spark, str(tmp_path / "rel"), "id string, n int").count() == 4
    assert len({x["sha256"] for x in readers.file_digests(spark, str(tmp_path / "rel")).collect()}) == 2
    (tmp_path / "x.json").write_text('{"data": {"rows": [{"v": 1}, {"v": 2}]}}')
    got = readers.json_records(spark, str(tmp_path / "x.json"), "data.rows").select("key", F.variant_get("record", "$.v", "int").alias("v")).collect()
    assert {(x["key"], x["v"]) for x in got} == {("0", 1), ("1", 2)}
    sinks.write_metrics(a, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["id", "n"]


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.unionByName(src).repartition(3).write.parquet(str(tmp_path / "in"))

    def run(name, make, mode):
        q = make(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run("dedup_stream", lambda s: events.deduplicated(s, "60 days"), "append")
    assert got.count() == src.select("user_id", "event_type", "value").distinct().count()
    total = run("window_stream", lambda s: events.windowed(s), "complete")
    assert total.agg(F.sum("n")).first()[0] == 2 * src.count()


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_candidates_lose_no_pair_and_are_few(spark):
    """Near copies of long texts, one of them with its words shuffled, among unlike ones: bounds drop the unlike pairs and no link."""
    from gristmill.functions.text import token_sets
    from gristmill.operators import near

    r = random.Random(5)
    bases = [[f"v{r.randrange(4000)}" for _ in range(r.choice([1, 30, 300]))] for _ in range(40)]
    given = [" ".join(b) for b in bases] + [words(r, b, 3) for b in bases] + [" ".join(r.sample(b, len(b))) for b in bases]
    rows = [(f"r{k:03}", x) for k, x in enumerate(given)]
    texts = spark.createDataFrame(rows, "id string, joined string").select("id", near.node(F.col("joined")).alias("node"), "joined").cache()
    node = {x["joined"]: x["node"] for x in texts.collect()}
    sets = {n: tuple(map(set, token_sets(x))) for x, n in node.items()}
    want = {(a, b): s for a in sets for b in sets if a < b and (s := near.weighted(sets[a], sets[b])) >= 0.72}
    got = {(x["x"], x["y"]): x["similarity"] for x in near.links(texts, 0.72).collect()}
    assert got == pytest.approx(want) and len(want) > 40
    assert near.candidates(texts.select("node", "joined"), (0.69, 0.5), len(given)).distinct().count() < 4 * len(want)


def test_token_features_hold_counts_alone(spark):
    """The plan makes no arrays of strings."""
    plan = catalogue.QUERIES["token_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "trigrams" not in plan.replace("n_trigrams", "")
