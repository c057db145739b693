"""Operators against brute force, on texts with nulls, empties, ties, repeated rows and long ones."""

import base64
import hashlib
import json
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import chat, decontam, fingerprint, ngram_join, packing, pii, queries, secret_scan, token_counts, token_output, toxicity
from gristmill.llm.tokens import END, Encoder, default_path

UP = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, n_words int, Score double"


def rand_texts(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "Über", "x.", "12", "a-b", "<|endoftext|>", "l\nm"]
    out = [None, "", " ", "one", "one two three", "a\tb\x0bc  d", "x" * 5000, "word " * 3000, "1 2 " * 4000]
    base = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(6)]
    for _ in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 4, 30])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(r.choice([" ", " ", "  ", "\n"]).join(w))
    return out + out[-3:]


@pytest.fixture(scope="module")
def rows():
    t = rand_texts(1)
    out = [(k * 7 % 1009, x, 5, 0.5) for k, x in enumerate(t)]
    return out + [out[12], (None, t[13], 1, 0.1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_path())


def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids(coder, text):
    return coder.whole(text or "") + END.to_bytes(4, "little")


def test_encoder_is_the_library(coder):
    r = random.Random(3)
    bits = ["a", "bc", "'s", "1", "23", ".", ",", "!", " ", "  ", "\n", " \n", "\n ", "\t", " ", "é", "<|endoftext|>", "　", "-", "'", "日本", "$$$", "\r\n", "²", "ª", "Word", "x" * 40]
    given = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    assert coder.encode(given) == [coder.whole(x) for x in given]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(x[1]) for x in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for k, x in enumerate(rows):
        if x[0] is not None:
            least[root(k)] = x[0] if least[root(k)] is None else min(x[0], least[root(k)])
    return sorted([(x[0], len(sets[k]), least[root(k)]) for k, x in enumerate(rows)], key=str)


def test_ngram_join(spark, docs, rows):
    out = ngram_join.joined(docs)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()], key=str) == brute_components(rows)
    assert ngram_join.joined(empty(spark)).count() == 0
    kept = ngram_join.representatives(docs)
    want = {c for d, n, c in brute_components(rows) if d is not None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == want and kept.columns == docs.columns
    assert kept.filter("doc_id is not null").count() == len(want)


def test_all_links_are_counted(spark):
    r = random.Random(11)
    base = [[f"v{r.randrange(900)}" for _ in range(120)] for _ in range(3)]
    given = []
    for k in range(36):
        w = list(base[k % 3])
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"u{k}"
        given.append((k, " ".join(w), 120, 0.5))
    given += [(40, given[1][1], 120, 0.5), (41, "few words", 2, 0.5), (42, None, 0, 0.5)]
    sets = [shingles(x[1]) for x in given]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)
    want = [sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    out = ngram_join.joined(spark.createDataFrame(given, DOCS).repartition(3))
    assert {x["doc_id"]: x["n_links"] for x in out.collect()} == {x[0]: n for x, n in zip(given, want, strict=True)} and max(want) > 9


def near_group(r, n, words=90, edits=6):
    """Near copies of one text: their links form one component, but not all pairs link."""
    base, out = [f"v{r.randrange(5000)}" for _ in range(words)], []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"u{k}_{r.randrange(99)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_large_groups_in_pieces_and_chunks(spark, monkeypatch, small):
    """One large group of near copies, of copies, and pairs; with blocks in pieces, groups in chunks and hot shingles in salted parts."""
    r = random.Random(13)
    given = near_group(r, 160) + near_group(r, 1) * 70 + [t for _ in range(20) for t in near_group(r, 2, 40, 4)]
    rows = [(1000 - k, t, 1, 0.5) for k, t in enumerate(given)]
    if small:
        for name, value in (("PIECE", 7), ("CHUNK", 9), ("SAMPLED", 5), ("HOT", 20), ("BIN_BYTES", 3000), ("BIN_SHINGLES", 500), ("COUNTERS", 1 << 12)):
            monkeypatch.setattr(ngram_join, name, value)
    sets = [shingles(t) for t in given]
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = [sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    out = {x["doc_id"]: x for x in ngram_join.joined(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert [out[x[0]]["n_links"] for x in rows] == want and 100 < sum(n < 159 for n in want[:160])
    assert sorted([(x["doc_id"], x["n_shingles"], x["component_id"]) for x in out.values()], key=str) == brute_components(rows)


@pytest.mark.parametrize("seed", range(4))
def test_forest_finds_all_pairs(seed):
    r = np.random.default_rng(seed)
    points = (np.repeat(r.integers(0, 9, (80, ngram_join.GROUPS)), 5, 0) + (r.random((400, ngram_join.GROUPS)) < 0.1)).astype(np.uint8)
    points = points[r.permutation(400)]
    points[r.integers(0, 400, 30), r.integers(0, ngram_join.GROUPS, 30)] = 255
    n = points.sum(1, dtype=np.int64)
    tree = np.sort(r.integers(0, 7, 400))
    f = ngram_join.Forest(points, n, tree)
    roots = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    i, j = np.array([0, 1, 2, 3, 4, 5, 6, 0, 2]), np.array([0, 1, 2, 3, 4, 5, 6, 3, 4])
    assert len(roots) == 7 and len(f.roots) == 7
    got = {(a, b) for x, y in f.pairs(i, j) for a, b in zip(x.tolist(), y.tolist(), strict=True) if f.bound(0, np.array([a]), np.array([b]))[0]}
    meet = set(zip(i.tolist(), j.tolist(), strict=True))
    low = np.where(points == 255, 1 << 20, points.astype(np.int64))
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if (tree[a], tree[b]) in meet and 100 * n[a] >= 75 * n[b] and 100 * n[b] >= 75 * n[a] and ngram_join.enough(np.minimum(low[a], low[b]).sum(), n[a] + n[b])}
    assert got == want and any(tree[a] != tree[b] for a, b in want)


def test_tiles_find_all_that_the_bound_leaves():
    """Documents of sizes around powers of two, in whole tiles and in tiles of two sides: as connected as by all pairs of points."""
    r = random.Random(17)
    given = [x for n in (60, 63, 66, 120, 140, 250, 270) for _ in range(3) for x in near_group(r, 6, n, 14)] + [" ".join(f"q{r.randrange(40)}" for _ in range(70)) for _ in range(20)]
    marks, ends = ngram_join.shingle_sets(pa.array(given))
    n = np.diff(ends)
    points = []
    for k, b in enumerate(ngram_join.group_bits(n).tolist()):
        points.append(ngram_join.nibbles(np.bincount((marks[ends[k] : ends[k + 1]] >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b)).tobytes())
    assert len({len(x) for x in points}) > 2
    sets = [set(marks[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    tile, side, node = np.zeros(len(n), np.int64), np.array([r.randrange(2) for _ in n]), np.arange(len(n))
    for sides, meet in ((np.zeros(len(n), np.int64), lambda i, j: True), (side, lambda i, j: side[i] != side[j])):
        ids, least = ngram_join.tile_groups(tile, sides, node, n, points)
        label = dict(zip(ids.tolist(), least.tolist()))
        for i in range(len(n)):
            for j in range(i):
                if meet(i, j) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    assert label.get(i, i) == label.get(j, j)
        assert len(set(label.get(i, i) for i in range(len(n)))) > 20


def test_overlaps():
    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(60), r.randrange(60))), np.uint64) for _ in range(25)]
    marks, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    size = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    whole = ngram_join.overlaps(marks, ends, 25)
    assert all(whole[i, j] == size(sets[i], sets[j]) for i in range(25) for j in range(25) if i != j)
    assert ngram_join.overlaps(marks, ends, 9).tolist() == [[size(a, b) for b in sets[9:]] for a in sets[:9]]


def test_patterned_words_have_own_hashes():
    """Words of the Thue-Morse sequence and their complements collide under powers of any one base modulo 2^64."""
    from gristmill.llm._common import SPACED, Words

    a = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    given = [x for n in (1024, 2048, 4096) for x in (a[:n], a[:n].translate(str.maketrans("ab", "ba")))]
    assert len(set(Words(pa.array([" ".join(given)]), SPACED).hash.tolist())) == 6


def test_fingerprints(spark, docs, rows):
    ranks = fingerprint.level_ranks(docs)
    got = sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.compared_with_next(docs, ranks).collect()], key=str)
    order = sorted([(x[0] if x[0] is not None else -(1 << 63), x[1] or "") for x in rows], key=lambda x: (-x[0], x[1].encode()))
    want = []
    for k, (d, t) in enumerate(order):
        y = order[(k + 1) % len(order)][1]
        want.append((None if d == -(1 << 63) else d, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + y[: len(t) // 3]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    prints = {r["text"]: r["fingerprint"] for r in fingerprint.fingerprints(docs, ranks).collect()}
    a, b = (fingerprint.decoded(prints[t]) for t in (rows[9][1], rows[30][1]))
    assert fingerprint.likeness(a, a) == 1 and 0 <= fingerprint.likeness(a, b) == fingerprint.likeness(b, a) <= 1
    assert prints[""] == "" and fingerprint.likeness(a, fingerprint.decoded("")) == 0 and fingerprint.likeness(fingerprint.decoded(""), fingerprint.decoded("")) == 1
    r = random.Random(5)
    long = [" ".join(str(r.random())[2:8] for _ in range(300)) for _ in range(2)]
    one, two, near = fingerprint.chains(pa.array([*long, long[0][:1500] + long[1][1500:]]), ranks)
    assert fingerprint.likeness(one, two) < 0.1 < 0.5 < fingerprint.likeness(one, near)
    assert fingerprint.compared_with_next(empty(spark), ranks).count() == 0


def test_windows_cover_every_byte():
    r = random.Random(8)
    blob = lambda n: base64.b64encode(r.randbytes(n)).decode()
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(n))
    given = [blob(900), han(500), " " * 40 + "word " * 9 + " " * 90 + blob(60) + " end", "a" * 31, "a" * 32, "a" * 33, "word " * 20 + "tail", "", None, *rand_texts(2, 5)]
    w, off = fingerprint.Windows(pa.array(given, pa.string())), 0
    firsts = np.concatenate([[0], np.cumsum(w.count)])
    for k, text in enumerate(given):
        size = len((text or "").encode())
        starts = w.start[firsts[k] : firsts[k + 1]] - off
        assert size < 32 and not len(starts) or {i + j for i in starts.tolist() for j in range(32)} == set(range(size))
        off += size
    ranks = np.arange(fingerprint.LEVELS)
    for make in (blob, han):
        a, b = make(900), make(900)
        one, two, near, moved = fingerprint.chains(pa.array([a, a[:40] + b[40:], a[: len(a) - len(a) // 3] + b[: len(a) // 3], "x" + a]), ranks)
        assert fingerprint.likeness(one, two) < 0.2 < fingerprint.likeness(one, near) < 0.95 and fingerprint.likeness(one, moved) > 0.9


def test_token_counts(spark, docs, rows, coder):
    lengths = [len(coder.whole(x[1] or "")) // 4 for x in rows]
    limits = token_counts.context_limits(token_counts.length_histogram(docs, default_path()))
    got = {r["n_tokens"]: (r["n_docs"], r["docs_over"], r["tokens_up_to"], r["total_tokens"], r["truncated_total"], r["quantile"]) for r in limits.collect()}
    x = np.array(lengths, np.int64)
    want = {int(n): (int((x == n).sum()), int((x > n).sum()), int(x[x <= n].sum()), int(x.sum()), int(np.minimum(x, n).sum()), float((x <= n).mean())) for n in np.unique(x)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for limit in (0, 50, 10**6):
        r = token_counts.at_limit(limits, limit).first()
        assert (r["total_tokens"], r["docs_over"], r["truncated_total"]) == (sum(lengths), sum(n > limit for n in lengths), sum(min(n, limit) for n in lengths))
    assert token_counts.quantile(limits, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.context_limits(token_counts.length_histogram(empty(spark), default_path())).count() == 0


def best_fit(counts, capacity):
    bins = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            room = min((b for b in bins if b >= n), default=None)
            if room is not None:
                bins.remove(room)
            bins.append((capacity if room is None else room) - n)
    return len(bins)


def test_sweeps_are_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.choice([5, 16, 40, 100])
        counts = {r.randint(1, capacity): r.randint(1, 60) for _ in range(r.randint(1, 20))}
        placed, held = set(), defaultdict(list)
        for n, a, b, each, seq, off in packing.sweeps(counts, capacity):
            for k in range(a, b):
                placed.add((n, k))
                held[seq + (k - a) // each].append((off + (k - a) % each * n, n))
        assert placed == {(n, k) for n in counts for k in range(counts[n])}
        for x in held.values():
            at = 0
            for off, n in sorted(x):
                assert off == at
                at += n
            assert at <= capacity
        assert len(held) == best_fit(counts, capacity)


def check_packing(out, rows, coder, capacity):
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    whole = defaultdict(list)
    for x in rows:
        data = ids(coder, x[1])
        n = len(data) // 4
        first = n % capacity or min(n, capacity)
        cuts = [0, *range(first, n + 1, capacity)]
        whole[x[0]] += [(k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {d: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for d, v in by_doc.items()} == {d: sorted(v) for d, v in whole.items()}
    for x in seqs.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= capacity
    lengths = [r["length"] for r in out]
    assert len(seqs) == best_fit({n: lengths.count(n) for n in set(lengths)}, capacity)


def test_packing(spark, docs, rows, coder):
    check_packing(packing.pack(docs, default_path(), 128).collect(), rows, coder, 128)
    assert packing.pack(empty(spark), default_path()).count() == 0


def test_token_files(spark, docs, rows, coder, tmp_path):
    out = token_output.token_files(docs, default_path()).collect()
    order, at, want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())), 0, []
    for x in order:
        data = ids(coder, x[1])
        want.append((x[0], at, len(data) // 4, zlib.crc32(data)))
        at += len(data) // 4
    assert sorted([tuple(r) for r in out], key=str) == sorted(want, key=str)
    assert token_output.token_files(empty(spark), default_path()).count() == 0
    token_output.write_token_files(docs, path := f"file://{tmp_path}/ids", default_path(), block_ids=50)
    assert sorted([tuple(r) for r in token_output.read_token_files(spark, path).collect()], key=str) == sorted(want, key=str)
    assert token_output.read_ids(spark, path, rows[20][0]) == [np.frombuffer(ids(coder, rows[20][1]), "<u4").tolist()]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing(width):
    given = np.random.default_rng(width).integers(0, 1 << width, 999).astype(np.uint32)
    data = token_output.pack(given, width)
    assert len(data) == -(-999 * width // 8)
    for a, b in ((0, 999), (0, 0), (17, 18), (501, 999)):
        assert (token_output.unpack(data, width, a, b) == given[a:b]).all()


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    luhn = sum((int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in v.split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15


def test_pii(spark, rows):
    r = random.Random(7)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "@", "c_x@y.z", "1.2.3.4", "001.2.3.255", "300.1.1.1", ".5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "+12345678", "+4", "(", "é日", " ", "\n", "-", "%", "9" * 30, "5"]
    given = ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(400)] + [x[1] for x in rows] + ["7 " * 9000 + "a" * 20000, "1" * 30000]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"))
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["base"]] for x in out.collect()}
    for k, t in enumerate(given):
        assert got[k] == [(kind, *m.span()) for kind in PII for m in re.finditer(PII[kind], t or "") if good(kind, m[0])], t
    # a context that seeds support finds an identifier that no expression knows
    known = [f"call my number +1 555 010 {k}000 today" for k in range(1, 9)] + ["pay and call my number 0800-FLOWERS9 today", "a plain 0800-FLOWERS8 text"]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")).collect()
    spans = {x["doc_id"]: [tuple(s) for s in x["spans"]] for x in out}
    assert spans[8] == [("phone", known[8].index("0800"), known[8].index(" today"))] and spans[9] == []
    # contexts on the right and on both sides, words without digits, of any length, far into a text
    names = ["jane(at)example", "x" * 300 + "(at)y", "(bob.at.z)"]
    known = ["lorem " * 3000 + f"user{k}@mail.org is my mail" for k in range(6)] + [f"{'ipsum ' * 500}{x} is my mail" for x in names] + ["is my mail here"]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")).collect()
    for x in out:
        want = {"jane(at)example", "x" * 300 + "(at)y", "bob.at.z"} if 6 <= x["doc_id"] < 9 else set()
        more = [known[x["doc_id"]][b["start"] : b["end"]] for b in x["spans"] if b not in x["base"]]
        assert set(more) <= want and len(more) == (6 <= x["doc_id"] < 9)
    assert pii.personal_data(empty(spark)).count() == 0


def test_pii_patterns_are_counted_in_every_text(spark):
    def more(given):
        out = pii.personal_data(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()
        return {(x["doc_id"], given[x["doc_id"]][b["start"] : b["end"]]) for x in out for b in x["spans"] if b not in x["base"]}

    # common in texts without seeds: no sign of personal data
    seeds = [f"user{k}@mail.org is my mail" for k in range(8)]
    assert more(seeds + ["plain is my mail"] * 100) == set()
    # the same far behind seeds, in their own texts
    assert more([x + " lorem" * 60 + " plain is my mail" * 13 for x in seeds]) == set()
    # common before seeds, but not in the texts at large; copies of all rows change nothing
    known = [f"call my number ask-me or if there is none then please do call my number +1 555 010 {k}000 today" for k in range(1, 9)]
    known += [" ".join(f"w{k}x{j}" for j in "abcdefgh") for k in range(200)]
    assert more(known) == {(k, "ask-me") for k in range(8)}
    assert more(known * 3) == {(k + c * len(known), "ask-me") for k in range(8) for c in range(3)}


def test_pii_counts_of_pairs(spark):
    r = random.Random(11)
    bits = ["a@b.co", "1.2.3.4", "300.1.1.1", "4111 1111-1111 1111", "+1 (555) 010-9999", "(x@y.z),", "+1 4111111111111111", "my", "Number", "is", "7", "#", "é日", "a@"]
    given = [r.choice([" ", "\n", "  ", ""]).join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)] + [" ", None]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at, ids, counts = pii.seed_words(F.col("text")), {}, defaultdict(int)
    got = {x["doc_id"]: x for x in docs.select("doc_id", at.alias("at"), pii.keys_beside(F.col("text"), at).alias("keys")).collect()}
    for k, t in enumerate(given):
        t = t or ""
        spans = [m.span() for kind in PII for m in re.finditer(PII[kind], t) if good(kind, m[0])]
        words = list(re.finditer(r"[^ \n]+", t))
        w = [re.sub("[0-9]", "0", m[0].lower()) for m in words]
        at = [i for i, m in enumerate(words) if any(m.start() < b and a < m.end() for a, b in spans)]
        assert got[k]["at"] == at, t
        pairs = [i for i in dict.fromkeys(j for i in at for j in (i - 2, i + 1)) if 0 <= i < len(w) - 1]
        want = [(0, *w[i : i + 2]) for i in pairs] + [(2, w[i - 1], w[i + 1]) for i in at if 0 < i < len(w) - 1]
        assert len(got[k]["keys"]) == len(want)
        for g, x in zip(got[k]["keys"], want, strict=True):  # one key a pair, one pair a key
            assert ids.setdefault(g, x) == x and ids.setdefault(x, g) == g
        for i in range(len(w)):
            for x in ([(0, *w[i : i + 2])] if i + 1 < len(w) else []) + ([(2, w[i], w[i + 2])] if i + 2 < len(w) else []):
                counts[x] += 1
    sought = spark.createDataFrame([(x,) for x in ids if isinstance(x, int)], "key long")
    found = {x["key"]: x["c"] for x in pii.counted(docs, sought).collect()}
    assert {x: found[k] for k, x in ids.items() if isinstance(k, int)} == {x: counts[x] for x in ids if not isinstance(x, int)}


def test_decontamination(spark, docs, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    r = random.Random(9)
    items = [(k, " ".join((x[1] or "").split(" ")[a : a + r.choice([2, 9, 13, 14, 30])])) for k, x in enumerate(rows[9:40]) for a in [r.randrange(20)]] + [(5, None), (6, ""), (7, "one"), (None, "w1 w2"), (3, "日本")]
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    want = []
    for x in rows:
        w, hit, met = words(x[1]), set(), set()
        for k in range(len(w)):
            for n in range(1, 14):
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    met |= windows[tuple(w[k : k + n])]
        want.append((x[0], len(w), len(hit), sorted(str(i) for i in met if i is not None), len(hit) > 0 and 20 * len(hit) >= len(w)))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(docs, table)
    assert sorted([(x["doc_id"], x["n_words"], x["n_hit"], x["hit_items"], x["contaminated"]) for x in out.collect()], key=str) == sorted(want, key=str)
    assert out.columns == ["doc_id", "text", "Score", "n_words", "n_hit", "hit_items", "contaminated"]
    joined = decontam.contamination(docs, table, index_bytes=0)  # by a join of fingerprints
    assert sorted([(x["doc_id"], x["n_words"], x["n_hit"], x["hit_items"], x["contaminated"]) for x in joined.collect()], key=str) == sorted(want, key=str)
    assert joined.columns == out.columns
    for limit in (0, decontam.INDEX_BYTES):
        kept = decontam.clean(docs, table, index_bytes=limit)
        assert kept.columns == docs.columns and sorted([x["doc_id"] for x in kept.collect()], key=str) == sorted([x[0] for x in want if not x[4]], key=str)
    decontam_blocks = list(decontam.item_blocks(table, 40))
    assert len(decontam_blocks) > 3
    assert decontam.contamination(docs, table.limit(0)).filter("n_hit > 0").count() == decontam.contamination(empty(spark), table).count() == 0


def check_chat(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(table)
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in chat.conversations_back(made).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, (role or "").encode(), (text or "").encode()))
    for c, turns in want.items():
        turns = [(b.decode(), x.decode()) for _, b, x in sorted(turns)]
        assert got[c][0] == turns
        assert "".join(got[c][1]) == "".join(x for b, x in turns if b == "assistant")
    return made


def test_chat(spark):
    control = ["<|im_end|>\n", "<|im_start|>", "</s>", "[INST]", "<\\/s>", "[\\\\/INST]", "\\", "<", "[", "\n", "é", "a", "<|im_start|>assistant\n"]
    r = random.Random(4)
    said = lambda: r.choice([None, "", "".join(r.choice(control) for _ in range(r.randint(0, 9)))])
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<s>", "a\\n\nb\\"]), said()) for c in range(30) for t in range(r.randint(1, 7))]
    rows += [rows[3], (5, 1, "assistant", "tie"), (5, None, "user", "first"), (None, 0, "user", "no id")]
    made = check_chat(spark, rows)
    assert made.filter("conv_id = 5").count() >= 1
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_secrets(spark, docs):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    r = random.Random(11)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "abc123", "0f" * 13, "AKIA", "AKIA" + "Q" * 18, "é", "\n", "x" * 30, "deadbeef" * 3]
    given = ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    for t in given:
        want = [(*m.span(), "assign") for m in assign.finditer(t) if len(m[1]) >= 6] + [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.scan(t) == sorted(want, key=lambda x: (x[0], secret_scan.KINDS.index(x[2]))), t
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    token = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()))
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + "." + "s" * 20
    pem = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(bytes([0x30, 3, 1, 2, 3])).decode()}\n-----END PRIVATE KEY-----"
    assert [x[2] for x in secret_scan.scan(f"é {token} {token[:-1]}z {jwt} {pem}")] == ["github", "jwt", "pem"]
    assert secret_scan.redact(f"a {token} b") == "a [github] b"
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000 + b"]" * 100_000 + b"}").decode()
    short = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 2500 + b"]" * 2500 + b"}").decode().rstrip("=")  # as deep as a header can be
    assert secret_scan.scan(f"{deep}.eyJzdWIi.{'s' * 20}") == []
    assert [x[2] for x in secret_scan.scan(f"{short}.eyJzdWIi.{'s' * 20}")] in ([], ["jwt"])
    began = time.time()
    assert secret_scan.scan("eyJ" * 200_000 + ".eyJab." + "s" * 20) == [] and time.time() - began < 5
    assert [x[2] for x in secret_scan.scan("eyJeyJ" + jwt)] in ([], ["jwt"])
    out = secret_scan.redacted(docs.withColumn("n_chars", docs.doc_id), length="n_chars")
    assert out.count() == docs.count() and out.filter("n_chars != length(text)").count() == 0
    assert secret_scan.secret_spans(empty(spark)).count() == 0


def brute_segments(at, gain, cost):
    """All maximal-scoring subsequences by their definition: the best one, then left and right of it."""
    scores = {}
    n = max(at) + 1
    x = [cost] * n
    for p, g in zip(at, gain, strict=True):
        x[p] = g

    def split(a, b):
        best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 1e-12:
            scores[best[2], best[3]] = best[0]
            split(a, best[2])
            split(best[3], b)

    split(0, n)
    return scores


def test_segments_are_maximal():
    r = random.Random(6)
    for _ in range(150):
        at = sorted(r.sample(range(25), r.randint(1, 8)))
        gain = [r.choice([0.5, 1.3, 2.7]) + r.random() / 100 for _ in at]
        got = {(a, b): s for a, b, s in toxicity.segments(np.array(at), np.array(gain), -0.6)}
        assert got == pytest.approx(brute_segments(at, gain, -0.6))


def test_segments_take_linear_time():
    n = 200_000
    began = time.time()
    assert len(toxicity.segments(np.arange(n) * 3, np.ones(n), -0.6)) == n
    assert len(toxicity.segments(np.arange(n) * 3, np.linspace(1, 1.1, n), -0.6)) > 0 and time.time() - began < 10


def test_toxicity(spark):
    r = random.Random(8)
    plain, bad = [f"word{i}" for i in range(300)], ["vileone", "vileish", "grubby", "nastyx"]
    rows, labels = [], []
    for d in range(1500):
        w = [r.choice(plain) for _ in range(r.randint(3, 120))]
        toxic = d % 8 == 0
        for _ in range((2 + len(w) // 20) * toxic):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    got = {x["doc_id"]: x for x in toxicity.scored(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    assert {d for d, x in got.items() if x["held"]} == held
    assert sum(got[d]["predicted"] == y for d, y in labels if d in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "grubby vileone " * 3), (4, "x " * 9000)], "doc_id long, text string")
    out = {x["doc_id"]: x for x in toxicity.scored(odd, model).collect()}
    assert out[1]["predicted"] == out[2]["predicted"] == out[4]["predicted"] == 0 and out[3]["predicted"] == 1 and out[3]["toxic_passages"]
    none = toxicity.fit(toxicity.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.scored(odd, none).agg({"score": "max"}).first()[0] < 1e-3 and toxicity.scored(odd.limit(0), none).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, sf)
        assert given.columns == docs.columns
        given = spark.createDataFrame(given.toPandas(), docs.schema)
    assert 0 < given.count() <= docs.count()
    assert corpus_pipeline.run(spark, sf).count() == corpus_pipeline.packed(spark, given, sf).count()
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline_stages_keep_columns_of_any_name(spark):
    """Nulls, repeated rows, empty tables, and columns named like those that the operators make."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    for k, name in enumerate(("score", "Predicted", "n_words", "hit_items", "contaminated", "_w", "_bits", "_key", "secrets")):
        given = given.withColumn(name, F.lit(99 + k))
    odd = given.limit(1)
    given = given.unionByName(odd).unionByName(odd.withColumn("text", F.lit(None).cast("string"))).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf)
        assert out.columns == given.columns, name
        assert {(x["score"], x["Predicted"], x["_w"], x["_key"], x["secrets"]) for x in out.select("score", "Predicted", "_w", "_key", "secrets").distinct().collect()} == {(99, 100, 104, 106, 107)}, name
        assert stage(spark, given.limit(0), sf).count() == 0, name
