"""Authored records: against sequential models, and what has to fail."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import authoring
from gristmill.operators import sampling
from gristmill.sources import checked


def rank(seed, salt, key):
    return hashlib.sha256(f"{seed}:{salt}:{key}".encode()).hexdigest(), key


def walk(units, room, seed, salt):
    out = set()
    for u in sorted(units, key=lambda u: rank(seed, salt, u)):
        if units[u] <= room:
            out.add(u)
            room -= units[u]
    return out


@pytest.mark.parametrize("room", [0, 1, 7, 23, 500])
def test_fit_in_order_is_the_walk_that_skips(spark, room):
    r = random.Random(room)
    units = {f"u{i}": r.choice([1, 1, 2, 3, 9]) for i in range(60)}
    got = sampling.fit_in_order(spark.createDataFrame(list(units.items()), "unit string, size long"), room, 5, "fill")
    assert {x.unit for x in got.collect()} == walk(units, room, 5, "fill")


@pytest.mark.parametrize("target", [4, 15, 40])
def test_set_cover_is_the_greedy_one(spark, target):
    r = random.Random(target)
    units = {f"u{i}": (r.choice([1, 2, 3]), r.sample("abcdefghijkl", r.choice([0, 1, 2, 3]))) for i in range(40)}
    left, picked, n = {v for _, c in units.values() for v in c}, [], 0
    while left and n < target:
        fits = [u for u, (s, c) in units.items() if u not in picked and left & set(c) and (not n or n + s <= target)]
        if not fits:
            break
        u = min(fits, key=lambda u: (-len(left & set(units[u][1])), units[u][0], rank(3, "coverage", u)))
        picked.append(u)
        n += units[u][0]
        left -= set(units[u][1])
    fill = walk({u: s for u, (s, _) in units.items() if u not in picked}, target - n, 3, "fill")
    got = sampling.set_cover(spark.createDataFrame([(u, s, c) for u, (s, c) in units.items()], "unit string, size long, covers array<string>"), target, 3).collect()
    assert {x.unit for x in got if x.why == "coverage"} == set(picked) and {x.unit for x in got if x.why == "fill"} == fill


def test_section_tokens_keep_every_section_and_fill_the_capacity(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([0, 1, 5, 40, 130, 700]) for _ in authoring.GIVEN_TO], c) for i, c in enumerate([5, 20, 100, 300, 496, 900] * 8)]
    nominal = [authoring.SECTIONS[n] for n in authoring.GIVEN_TO]

    def model(lengths, capacity):
        least = [min(n, 1) for n in lengths]
        b = [max(capacity * v // sum(nominal), m) for v, m in zip(nominal, least, strict=True)]
        for i in reversed(range(5)):  # token by token, the last first
            while sum(b) > capacity and b[i] > least[i]:
                b[i] -= 1
        for i in range(5):
            while sum(b) < capacity and b[i] < nominal[i]:
                b[i] += 1
        b[0] += capacity - sum(b)
        used = [min(n, v) for n, v in zip(lengths, b, strict=True)]
        for i in range(5):
            while sum(used) < capacity and used[i] < lengths[i]:
                used[i] += 1
        return used

    for capacity in sorted({c for *_, c in rows}):
        df = spark.createDataFrame([(i, n) for i, n, c in rows if c == capacity], "i int, n array<long>")
        for x in authoring.section_tokens(df, "n", capacity).collect():
            assert x.n == model(rows[x.i][1], capacity), (rows[x.i], capacity)


def test_occurrences_may_overlap(spark):
    rows = [("aaaa", "aa", 0, 0), ("aaaa", "aa", 2, 2), ("aaaa", "aa", 3, -1), ("", "a", 0, -1), ("abc", "", 0, -1), ("xéab", "ab", 0, 2), ("ab", "ab", -1, -1), (None, "a", 0, None)]
    df = spark.createDataFrame(rows, "t string, p string, n int, want int")
    assert [x.got for x in df.select(authoring.occurrence(F.col("t"), F.col("p"), F.col("n")).alias("got")).collect()] == [w for *_, w in rows]


def test_numbers_are_kept_whole(spark):
    rows = [("pay 42 now", True), ("pay 142", False), ("v4.42", False), ("42", True), ("é42", False), ("42.", False), ("(42)", True)]
    df = spark.createDataFrame(rows, "t string, want boolean").select("want", authoring.keeps_number(F.col("t"), F.lit("42")).alias("got"))
    assert all(x.got == x.want for x in df.collect())


def test_settings_and_templates(tmp_path):
    assert authoring.interpolated("${A}/${B:-x}/${C:-}", {"A": "1"}) == "1/x/"
    with pytest.raises(KeyError):
        authoring.interpolated("${A}", {})
    for fields in ({}, {"a": None, "b": None}):
        with pytest.raises(ValueError):
            authoring.rendered("say {a}", fields)
    (tmp_path / "s.toml").write_text('seed = 3\nmodel = "${M:-small}"\n')
    assert checked.toml_settings(str(tmp_path / "s.toml"), {"seed": int, "model": str}, {}) == {"seed": 3, "model": "small"}
    with pytest.raises(ValueError):
        checked.toml_settings(str(tmp_path / "s.toml"), {"seed": int}, {})
    with pytest.raises(TypeError):
        checked.toml_settings(str(tmp_path / "s.toml"), {"seed": str, "model": str}, {})


def test_strict_json(spark, tmp_path):
    bodies = {"a": b'{"b":1,"a":{"x":2}}', "b": b'{"a":{"x":1,"x":2}}', "c": b'{"a":NaN}', "d": b"\xff", "e": b"{", "f": b'{"a":"' + b"x" * 100 + b'"}', "g": b"[" * 100 + b"]" * 20}
    for k, v in bodies.items():
        (tmp_path / f"{k}.json").write_bytes(v)
    got = {x.path[-6]: (x.value, x.error) for x in checked.strict_json(spark, str(tmp_path), 105).collect()}
    assert got["a"] == ('{"a":{"x":2},"b":1}', None)
    assert {k: e for k, (_, e) in got.items() if k != "a"} == {"b": "duplicate key", "c": "NaN is no JSON", "d": "not UTF-8", "e": "malformed", "f": "too large", "g": "too large"}


def test_snapshots_are_pinned(spark, tmp_path):
    body = json.dumps({"suites": [{"suite_id": "s", "user_tasks": [{"id": "u1", "prompt": "p"}, {"id": "u2", "prompt": "q"}], "injection_tasks": [{"id": "i1", "goal": "g"}, {"id": "i2", "goal": "h"}]}]}).encode()
    (tmp_path / "x.json").write_bytes(body)
    got = checked.snapshot_cases(spark, str(tmp_path / "x.json"), hashlib.sha256(body).hexdigest()).collect()
    assert sorted((x.user_task, x.injection_task) for x in got) == [(u, i) for u in ("u1", "u2") for i in ("i1", "i2")]
    with pytest.raises(Exception, match="digest differs"):
        checked.snapshot_cases(spark, str(tmp_path / "x.json"), "0" * 64).collect()


def test_policy_catalogue(spark, tmp_path):
    policies = {"a": ("p1", "mail", ["r1", "r2"]), "b": ("p2", "bank", ["r2"]), "c": ("p3", "odd", ["r4"]), "d": ("p4", "mail", [])}
    for name, (p, d, rules) in policies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"policy_id": p, "domain": d, "rules": [{"rule_id": r, "effect": "ALLOW", "actions": ["x"], "source_roles": ["USER"]} for r in rules]}, indent=1))
    got = {(x.policy_id, x.domain, x.rule_id): x.error for x in checked.policy_catalogue(spark, str(tmp_path), ("mail", "bank", "home")).collect()}
    assert got == {("p1", "mail", "r1"): None, ("p1", "mail", "r2"): "duplicate rule", ("p2", "bank", "r2"): "duplicate rule", ("p3", "odd", "r4"): "unknown domain", ("p4", "mail", None): None, (None, "home", None): "no policy"}


def test_checksums(tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a", "d/b"):
        (tmp_path / name).write_text(name)
    lines = checked.checksum_lines(str(tmp_path))
    assert checked.checksum_faults(str(tmp_path), lines) == []
    (tmp_path / "a").write_text("other")
    bad = checked.checksum_faults(str(tmp_path), [lines[0], lines[0], f"{'0' * 64}  ../x", f"{'0' * 64}  gone"])
    assert bad == ["differs: a", "twice: a", "outside: ../x", "missing: gone", "not listed: d/b"]
