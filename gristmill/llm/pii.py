"""Personal data by bootstrapped contextual extraction, with DataFrame functions alone.

Seeds are what four expressions and their checks find. The words around a seed
are its lexical patterns: the two or three before it, the one before and the
one after, the two after (lower-cased, digits as 0). Every word of every text
that stands in a pattern that three distinct seeds support, and is no part of a
seed, is another instance. Patterns have to be sixteen times as common at seeds
(distinct ones, of all kinds) as their pair of words is at the words that are no
part of a seed; pairs are counted in every text whole. Pattern-instance pairs
form a graph that is scored in turns: a pattern of a kind is as good as the mean
score of its distinct instances, an instance as good as the noisy-or of its
patterns. In the mean, seeds of the kind are sure; one bad instance is added, so that few instances
weigh little; others weigh a quarter of the square root of how often they occur
there, so that many plain ones don't drown a pattern but a common word does; and
a score counts from the threshold on alone, so that patterns don't raise
themselves. Instances that reach the threshold are discovered: identifiers that
no expression knows. They are single words of any length, without the
punctuation around them.

Expressions are given in forms that Java's matcher runs without recursion or
repeated starts inside one run; they match what the contract's do.

Null texts count as empty. Repeated rows are searched each; ties of score go
to the kind that comes last in the alphabet; an identifier that two rows share
is one instance. An empty table gives no rows. Very long texts are searched
whole. Columns but doc_id and the text are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Words, and what is cut off at both ends of a candidate.
WORD, EDGE = r"\S++", r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$"
LEAST_SEEDS, LEAST_SCORE, ROUNDS = 3, 0.6, 3
#: How many times as common a pattern has to be at seeds as its pair of words at other words.
LIFT = 16
#: Bits of the filters over patterns (one size for any number of them), and lengths that are summed at a time.
FILTER_BITS, RUN = 1 << 18, 128


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that a lambda mentions would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """Of each element of an array of ints, the sum of those before it. Summed in runs, since appending to a long array copies it."""
    empty = F.array().cast("array<int>")
    add = lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
    prefix = lambda x: F.aggregate(x, F.struct(F.lit(0).alias("sum"), empty.alias("out")), add)
    last = F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / RUN).cast("int")
    add_up = lambda runs: F.flatten(F.zip_with(runs, prefix(F.transform(runs, lambda r: r["sum"]))["out"], lambda r, before: F.transform(r["out"], lambda x: x + before)))
    return let(lengths, lambda given: let(F.transform(F.sequence(F.lit(0), last), lambda k: prefix(F.slice(given, k * RUN + 1, RUN))), add_up))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, value, left, right) of the matches, with the stretches of text before and after each: starts follow from their lengths."""

    def found(gaps: Column, values: Column) -> Column:
        n = F.size(values)
        zipped = lambda both: F.arrays_zip(values.alias("v"), F.slice(gaps, 1, n).alias("l"), F.slice(gaps, 2, n).alias("r"), sums_before(both).alias("s"))
        each = let(F.zip_with(F.slice(gaps, 1, n), values, lambda g, v: F.length(g) + F.length(v)), zipped)
        return F.transform(each, lambda m: F.struct((m["s"] + F.length(m["l"])).alias("start"), m["v"].alias("value"), m["l"].alias("left"), m["r"].alias("right")))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: found(gaps, values)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    d = F.reverse(digits(value))
    of = lambda i: F.substr(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(of(i) > 9, of(i) - 9).otherwise(of(i))), F.lit(0), lambda a, b: a + b) % 10 == 0


def finds(text: Column) -> dict[str, tuple]:
    """Of each kind: whether text may have matches, its expression, and the check of a match (None: all pass)."""
    has_digit = text.rlike("[0-9]")
    n = lambda m: F.length(digits(m["value"]))
    return {
        "email": (F.contains(text, F.lit("@")), EMAIL, None),
        "ip": (has_digit, IP, lambda m: F.forall(F.split(m["value"], "\\."), lambda p: p.rlike(BYTE))),
        "card": (has_digit, CARD, lambda m: (n(m) <= 19) & luhn(m["value"])),
        "phone": (has_digit & F.contains(text, F.lit("+")), PHONE, lambda m: n(m).between(9, 15)),
    }


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value, left, right) of the four expressions, by kind, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>")
    out = []
    for kind, (maybe, pattern, good) in finds(text).items():
        found = matches(text, pattern)
        found = F.filter(found, good) if good else found
        name = F.lit(kind)
        spans = F.transform(found, lambda m: F.struct(name.alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right")))  # noqa: B023
        out.append(F.when(maybe, spans).otherwise(none))
    return F.concat(*out)


def plain(words: Column) -> Column:
    return F.translate(F.lower(words), "123456789", "000000000")


def next_to(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(0), a, b)


def around(a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(2), a, b)


def patterns(b: list[Column], a: list[Column]) -> Column:
    """Patterns of a place from the three words before it (nearest first) and the two after it (null where there are none), as
    hashes: id of the pattern, key of two words of it by which places are looked up."""
    pair, both, after = next_to(b[1], b[0]), around(b[0], a[0]), next_to(a[0], a[1])
    all_ = [(b[1].isNotNull(), F.xxhash64(F.lit(0), pair), pair), (b[2].isNotNull(), F.xxhash64(F.lit(1), b[2], pair), pair), (b[0].isNotNull() & a[0].isNotNull(), both, both), (a[1].isNotNull(), F.xxhash64(F.lit(3), after), after)]
    return F.array_compact(F.array(*[F.when(there, F.struct(id_.alias("id"), key.alias("key"))) for there, id_, key in all_]))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def seed_words(text: Column) -> Column:
    """Indexes of the words of text that overlap a span of the four expressions."""

    def covered(maybe: Column, pattern: str, good) -> Column:
        """The words of text with # for what the spans of one kind cover: no span has a #, and white space stays, so words keep their places."""
        hide = lambda m: F.regexp_replace(m["value"], r"\S", "#")
        cover = lambda m: F.concat(m["left"], F.when(good(m), hide(m)).otherwise(m["value"]) if good else hide(m))
        whole = lambda found: F.array_join(F.concat(F.transform(found, cover), F.array(F.get(found, F.size(found) - 1)["right"])), "")
        return F.when(maybe, words_of(let(matches(text, pattern), whole)))

    differs = lambda raw, masks, i: F.exists(masks, lambda m: F.coalesce(F.get(m, i) != F.get(raw, i), F.lit(False)))
    at = lambda raw, masks: F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: differs(raw, masks, i))
    return let(words_of(text), lambda raw: let(F.array(*[covered(*x) for x in finds(text).values()]), lambda masks: at(raw, masks)))


def keys_beside(text: Column, some: Column) -> Column:
    """Keys of the pairs of words next to and around the words with the indexes `some`; a pair that stands between two of them comes once."""
    apart = lambda at: F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i - 2, i + 1))))
    pairs = lambda w, at: F.transform(F.filter(apart(at), lambda i: (i >= 0) & (i < F.size(w) - 1)), lambda i: next_to(F.get(w, i), F.get(w, i + 1)))
    both = lambda w, at: F.transform(F.filter(at, lambda i: (i > 0) & (i < F.size(w) - 1)), lambda i: around(F.get(w, i - 1), F.get(w, i + 1)))
    return let(words_of(plain(text)), lambda w: let(some, lambda at: F.concat(pairs(w, at), both(w, at))))


def slot(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(FILTER_BITS)).cast("int")


def slots(some: DataFrame, of: str) -> Column:
    """A filter of one size for any number of hashes: true at the slots of those in the column `of`."""
    table = some.agg(F.array_sort(F.collect_set(slot(F.col(of)))).alias("at"))
    return table.select(F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), "at"), F.concat("at", F.array(F.lit(FILTER_BITS))), lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True))))).alias("t")).scalar()


def counted(given: DataFrame, sought: DataFrame) -> DataFrame:
    """key, c: how often the pairs of words sought (and few others) stand in all texts."""

    def keys(w: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(w) - 2)
        # the last word but one has none around: its hash is no pair's
        return F.concat(F.transform(each, lambda i: next_to(F.get(w, i), F.get(w, i + 1))), F.transform(each, lambda i: around(F.get(w, i), F.get(w, i + 2))))

    every = given.select(F.explode(let(words_of(plain(F.col("text"))), lambda w: F.when(F.size(w) > 1, keys(w)))).alias("key"))
    return every.filter(F.get(slots(sought, "key"), slot(F.col("key")))).groupBy("key").agg(F.count("*").alias("c"))


def near(left: Column, right: Column) -> Column:
    """Patterns of a place by the stretches of text on both sides; where no white space divides a stretch from the place it has no words."""
    tail = F.reverse(F.regexp_extract(F.reverse(left), r"^\s+\S+(?:\s+\S+){0,2}", 0))
    head = F.regexp_extract(right, r"^\s+\S+(?:\s+\S+)?", 0)
    words = lambda x: F.regexp_extract_all(plain(x), F.lit(WORD), F.lit(0))
    return let(F.reverse(words(tail)), lambda b: let(words(head), lambda a: patterns([F.get(b, F.lit(k)) for k in range(3)], [F.get(a, F.lit(k)) for k in range(2)])))


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base (array of kind, start, end of the expressions), spans (with those discovered), by kind as listed, then start."""
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    mark = F.xxhash64("text").alias("mark")
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), near(b["left"], b["right"]).alias("patterns")))
    rows = given.select("doc_id", "text", base_spans(F.col("text")).alias("base")).withColumn("at", F.when(F.size("base") > 0, seed_words(F.col("text"))))
    others = F.size(words_of(F.col("text"))) - F.coalesce(F.size("at"), F.lit(0))
    rows = stored(rows.select("doc_id", mark, base.alias("base"), F.when(F.size("base") > 0, keys_beside(F.col("text"), F.col("at"))).alias("beside"), others.alias("others")), "pii")
    short = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))

    found = rows.select(F.explode("base").alias("b")).select(F.explode("b.patterns").alias("p"), F.xxhash64(F.lower("b.value")).alias("instance"), F.col("b.kind").alias("own")).select(F.col("p.id").alias("pattern"), "p.key", "instance", "own").distinct()
    supported = found.groupBy("pattern", F.col("own").alias("kind")).agg(F.count_distinct("instance").alias("n"), F.first("key").alias("key")).filter(F.col("n") >= LEAST_SEEDS)
    supported = stored(supported, "pii-candidates")
    # a pair that is as common at other words stands at seeds by chance
    common = counted(given, supported)
    beside = rows.select(F.explode("beside").alias("key")).groupBy("key").agg(F.count("*").alias("own"))
    seeds = rows.select(F.explode("base").alias("b")).agg(F.count_distinct("b.kind", F.lower("b.value")).cast("double").alias("seeds"))
    sizes = seeds.join(F.broadcast(rows.agg(F.sum("others").cast("double").alias("others"))))
    supported = supported.join(common, "key", "left").join(beside, "key", "left").join(F.broadcast(sizes))
    elsewhere = F.coalesce("c", F.lit(0)) - F.coalesce("own", F.lit(0))
    supported = supported.filter(elsewhere * LIFT * F.col("seeds") <= F.col("n") * F.col("others")).select("pattern", "kind", "key")
    supported = stored(supported, "pii-patterns")
    plain_ = rows.select("doc_id", "mark", short.alias("base"))
    more = discovered(given, plain_, found, supported)
    out = plain_.alias("r").join(more.alias("m"), F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.mark") == F.col("m.mark")), "left")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select("r.doc_id", "base", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def discovered(given: DataFrame, rows: DataFrame, found: DataFrame, supported: DataFrame) -> DataFrame:
    """doc_id, mark, more: the spans of instances that supported patterns discover."""
    known = lambda key: F.get("table", slot(key))

    def places(w: Column) -> Column:
        """Indexes of words that may stand in a supported pattern."""
        word = lambda k: F.get(w, k)
        every = F.sequence(F.lit(0), F.size(w) - 1)
        pairs = F.transform(every, lambda i: known(next_to(word(i), word(i + 1))))  # each pair stands before one word and after another
        return let(pairs, lambda p: F.filter(every, lambda i: F.get(p, i - 2) | F.get(p, i + 1) | known(around(word(i - 1), word(i + 1)))))

    def hits_of(w: Column, some: Column) -> Column:
        word = lambda k: F.get(w, k)
        made = lambda words: F.transform(some, lambda i: F.struct(F.get(words, i)["start"].alias("start"), F.get(words, i)["value"].alias("value"), patterns([word(i - k) for k in (1, 2, 3)], [word(i + k) for k in (1, 2)]).alias("patterns")))
        return F.when(F.size(some) > 0, let(matches(F.col("text"), WORD), made))  # starts are summed where they are asked for

    words = words_of(plain(F.col("text")))
    hits = F.when(F.col("text").rlike(r"\S"), let(words, lambda w: let(places(w), lambda some: hits_of(w, some))))
    text = given.select("doc_id", F.xxhash64("text").alias("mark"), "text", slots(supported, "key").alias("table"))
    hits = text.select("doc_id", "mark", F.explode(hits).alias("h")).select("doc_id", "mark", "h.start", "h.value", F.explode("h.patterns.id").alias("pattern"))
    cut = F.regexp_replace("value", EDGE, "")
    start = F.col("start") + F.length("value") - F.length(F.regexp_replace("value", r"^[^\p{L}\p{N}+]+", ""))
    hits = hits.join(supported.select("pattern").distinct(), "pattern").select("doc_id", "mark", "pattern", start.alias("start"), (start + F.length(cut)).alias("end"), F.xxhash64(F.lower(cut)).alias("instance"), F.length(cut).alias("n")).filter("n > 0")
    apart = hits.alias("h").join(rows.filter(F.size("base") > 0).alias("r"), F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.mark") == F.col("r.mark")), "left")
    apart = apart.filter(F.col("base").isNull() | ~F.exists("base", lambda b: (F.col("start") < b["end"]) & (b["start"] < F.col("end"))))
    met = stored(apart.select("h.doc_id", "h.mark", "pattern", "start", "end", "instance"), "pii-met")

    edges = supported.join(found, "pattern").select("pattern", "kind", "instance", F.when(F.col("own") == F.col("kind"), 1.0).otherwise(0.0).alias("score"), F.lit(1.0).alias("weight"), F.lit(True).alias("seed"))
    often = met.groupBy("pattern", "instance").agg((0.25 * F.sqrt(F.count("*"))).alias("weight"))
    edges = edges.unionByName(supported.join(often, "pattern").select("pattern", "kind", "instance", F.lit(0.0).alias("score"), "weight", F.lit(False).alias("seed")))
    score = stored(edges, "pii-edges")
    for _ in range(ROUNDS):
        trusts = score.groupBy("pattern", "kind").agg((F.sum(F.when(F.col("score") >= LEAST_SCORE, F.col("score") * F.col("weight")).otherwise(0.0)) / (F.sum("weight") + 1)).alias("trust"))
        better = score.filter(~F.col("seed")).join(trusts, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("new"))
        score = stored(score.join(better, ["instance", "kind"], "left").select("pattern", "kind", "instance", "seed", "weight", F.when(F.col("seed"), F.col("score")).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")), "pii-round")
    best = score.filter(~F.col("seed") & (F.col("score") >= LEAST_SCORE)).groupBy("pattern", "instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return met.join(best, ["pattern", "instance"]).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
