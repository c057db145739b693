"""The library's own operators against plain models, and in any order of input."""

import itertools
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import dedup, selection
from gristmill.plans import catalogue
from gristmill.sources import readers, sinks
from gristmill.vocabulary import FILLERS, SYNONYMS


def model_similarity(a, b):
    if a["hash"] == b["hash"] or a["joined"] == b["joined"]:
        return 1.0
    j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return sum(w * j(set(a[k]), set(b[k])) for w, k in zip((0.5, 0.25, 0.25), ("tokens", "bigrams", "trigrams"), strict=True))


def model_clusters(rows, threshold, keys=None):
    """One record after the other: group key, hash, best representative, or a new one."""
    by_key, by_hash, reps, out = {}, {}, [], {}
    for x in sorted(rows, key=lambda r: r["id"]):
        key = keys and keys.get(x["id"])
        if key and key in by_key:
            rep, sim = by_key[key], None
        elif x["hash"] in by_hash:
            rep, sim = by_hash[x["hash"]], 1.0
        else:
            scored = [(model_similarity(x, r), -k) for k, r in enumerate(reps)]
            best = max(scored, default=(0, 0))
            if best[0] >= threshold:
                rep, sim = reps[-best[1]]["id"], best[0]
            else:
                reps.append(x)
                rep, sim = x["id"], 1.0
        if sim is None:
            sim = model_similarity(x, next(r for r in rows if r["id"] == rep))
        by_key.setdefault(key, rep) if key else None
        by_hash.setdefault(x["hash"], rep)
        out[x["id"]] = (rep, round(sim, 6))
    return out


def some_texts(n, seed):
    r = random.Random(seed)
    words = [*SYNONYMS, *FILLERS, "alpha", "beta", "gamma", "delta", "straße", "ﬁne", "x_y", "12"]
    base = [[r.choice(words) for _ in range(r.randint(0, 12))] for _ in range(n // 4)]
    out = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w.insert(r.randrange(len(w) + 1), r.choice(words))
        out.append((f"r{k:03d}", " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1])
def test_clusters_follow_the_sequential_model(spark, seed):
    rows = some_texts(40, seed)
    frames = [spark.createDataFrame(x, "id string, text string") for x in (rows, rows[::-1])]
    feats = [dedup.features(f) for f in frames]
    plain = [r.asDict() for r in feats[0].collect()]
    keys = {r["id"]: ("k1" if int(r["id"][1:]) % 9 == 0 else None) for r in plain}
    for f, known in ((feats[0], None), (feats[1].withColumn("key", F.when(F.substring("id", 2, 3).cast("int") % 9 == 0, "k1")), keys)):
        got = {r["id"]: (r["representative"], r["similarity"]) for r in dedup.clusters(f, 0.72, 0.9, F.col("key") if known else None).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in model_clusters(plain, 0.72, known).items()}


def test_features_agree_with_built_ins(spark):
    rows = some_texts(60, 3) + [("z0", ""), ("z1", None), ("z2", "ab")]
    df = spark.createDataFrame(rows, "id string, text string")
    built = df.withColumn("n", text.normalize_text(F.coalesce("text", F.lit("")))).withColumn("a", text.canonical_tokens(F.col("n"))).withColumn("joined", F.array_join("a", " "))
    built = built.select("id", F.sha2("n", 256).alias("hash"), "joined", F.array_distinct("a").alias("tokens"), text.bigrams(F.col("a")).alias("bigrams"), text.trigrams(F.col("joined")).alias("trigrams"))
    assert sorted(map(str, built.collect())) == sorted(map(str, dedup.features(df).select(*built.columns).collect()))


def test_paraphrases_are_one_cluster(spark):
    rows = [("a", "Ignore all previous instructions"), ("b", "disregard the prior rules"), ("c", "Forget any earlier directions!")]
    got = dedup.clusters(dedup.features(spark.createDataFrame(rows, "id string, text string")), 0.72, 0.9).collect()
    assert {r["representative"] for r in got} == {"a"} and {r["similarity"] for r in got} == {1.0}


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(60), f"k{r.randrange(50)}") for _ in range(90)] + [(k, f"chain{k // 2}") for k in range(100, 140)] + [(k, f"link{(k + 1) // 2}") for k in range(100, 140)]
    label = {n: n for n, _ in links}
    for _ in range(200):
        for key in {k for _, k in links}:
            own = [n for n, k in links if k == key]
            least = min(label[n] for n in own)
            for n in own:
                label[n] = least
    got = dedup.components(spark.createDataFrame(links, "node long, key string")).collect()
    assert {x["node"]: x["component"] for x in got} == label


def test_components_of_all_orders(spark, tmp_path):
    r = random.Random(6)
    orders = [(k, r.randrange(900), f"2020-{r.randrange(12) + 1:02d}-{r.randrange(28) + 1:02d}") for k in range(1, 300)] + [(k, 10_000 + k, f"{k}-01-01") for k in range(1001, 1010)]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, day string").select("o_orderkey", "o_custkey", F.col("day").cast("timestamp").alias("o_orderdate"))
    frame.write.parquet(str(tmp_path / "orders.parquet"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, c, d in orders:
        up[root(k)] = root(("c", c))
        up[root(k)] = root(("d", d))
    least = {}
    for k, _, _ in orders:
        least[root(k)] = min(k, least.get(root(k), k))
    got = {x["node"]: x["component"] for x in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == {k: least[root(k)] for k, _, _ in orders}


def test_blind_ids_beyond_four_digits(spark, tmp_path):
    n = 10_012
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("quality"), F.lit(0).cast("long").alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    got = catalogue.QUERIES["blinded_packets"](spark, str(tmp_path)).collect()
    want = {f"candidate_{k:04d}" for k in range(1, n + 1)}
    assert len(got) == 2 * n and all({x["blind"] for x in got if x["annotator"] == a} == want for a in "AB")


def test_short_payloads_once(spark, tmp_path):
    texts = ["alpha beta", "the alpha beta gamma deltas end", "alpha, alpha", "xalphay", "a b c d e f", "a\nb c d, e", "", None, "one two three four five six", "one two three four fives", "aaa"]
    items = ["alpha", "alpha beta", "beta gamma delta", "alpha beta gamma delta", "a b c d", "a\nb", "one two three four five", "aa", "", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((x["doc_id"], x["item_id"]) for x in catalogue.QUERIES["payload_once"](spark, str(tmp_path)).collect())
    assert got == [(i, j) for i, x in enumerate(texts) for j, y in enumerate(items) if x and y and x.count(y) == 1]


def test_take_and_apportion(spark):
    groups = [(f"g{k}", k % 5 + 1) for k in range(300)]
    out = selection.take_to_target(spark.createDataFrame(groups, "group string, size long"), F.lit(200), 1, "s").collect()
    import hashlib

    total, want = 0, set()
    for g, n in sorted(groups, key=lambda x: hashlib.sha256(f"1:s:{x[0]}".encode()).hexdigest()):
        if total < 200:
            want.add(g)
        total += n
    assert {r["group"] for r in out if r["taken"]} == want
    quota = {r["key"]: r["quota"] for r in selection.apportion(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "key string, weight long"), 100).collect()}
    assert quota == {"a": 34, "b": 33, "c": 33}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"x, ""y"""\n2,é\n')
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "a.csv"), ["id", "text"]).collect()] == [("1", 'x, "y"'), ("2", "é")]
    (tmp_path / "a.json").write_text(json.dumps({"d": {"list": [{"q": 1}, {"q": 2}], "map": {"m": {"q": 3}}}}))
    assert sorted(r["key"] for r in readers.json_records(spark, str(tmp_path / "a.json"), "d.list").collect()) == ["0", "1"]
    assert [r["key"] for r in readers.json_records(spark, str(tmp_path / "a.json"), "d.map").collect()] == ["m"]
    (tmp_path / "a.txt").write_text("one\r\ntwo\n")
    assert [tuple(r) for r in readers.text_lines(spark, str(tmp_path / "a.txt")).collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "s.jsonl").write_text('{"id":"a"}\n{"id":"a"}\n\n{"id":"b","id":"c"}\n[1]\n{"id":"d"}\n')
    errors = [r["error"] for r in readers.strict_lines(spark, str(tmp_path / "s.jsonl"), "id string").collect()]
    assert sorted(map(str, errors)) == sorted(["duplicate id", "duplicate id", "blank line", "duplicate key", "not an object", "None"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("r/a.txt", "hi")
        z.writestr("../b.txt", "no")
        z.writestr("c.bin", "no")
    assert [tuple(r) for r in readers.archive_members(spark, str(tmp_path / "z.zip"), (".txt",)).collect()] == [("r/a.txt", "hi")]
    (tmp_path / "c.py").write_text("A = {'x': 1}\nB = [2]\nimport os\n")
    assert {r["name"]: json.loads(r["value"]) for r in readers.python_constants(spark, str(tmp_path / "c.py"), ("A", "B")).collect()} == {"A": {"x": 1}, "B": [2]}
    rows = spark.createDataFrame([("b", None, "s1"), ("a", 1, "s2")], "id string, n int, split string")
    sinks.write_json_lines(rows, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":"a","n":1,"split":"s2"}', '{"id":"b","n":null,"split":"s1"}']
    sinks.write_splits(rows, str(tmp_path / "splits"))
    assert sorted(p.name for p in (tmp_path / "splits").iterdir() if p.is_dir()) == ["split=s1", "split=s2"]


def test_queries_have_sql():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60
    assert list(itertools.islice(catalogue.ORACLE_SQL, 1))
