"""Scalar functions on text, hashes and arrays, as Column builders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..vocabulary import FILLERS, SYNONYMS, WEIGHTS


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, runs of white space to one space, ends stripped. Spark has no built-in for the first two."""
    import unicodedata

    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def text_features(texts: Column) -> Column:
    """Struct of hash and joined, the token text: the built-in forms below, made in the pass that normalises.

    Arrays that several built-in expressions share would be computed once for each use.
    """
    return _features()(texts)


def _features():
    import hashlib
    import re
    import unicodedata

    word = re.compile(r"[^\W_]+")

    @F.pandas_udf("hash string, joined string")
    def features(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            norm = " ".join(unicodedata.normalize("NFKC", x or "").casefold().split())
            toks = [SYNONYMS.get(w, w) for w in word.findall(norm) if w not in FILLERS]
            joined = "".join(f" {w} " for w in toks)
            if " instruction  previous " in joined:
                joined = re.sub(" instruction (( previous )+)", r"\1 instruction ", joined)
                toks = joined.split()
            out.append((hashlib.sha256(norm.encode()).hexdigest(), " ".join(toks)))
        return pd.DataFrame(out, columns=["hash", "joined"])

    return features


def token_sets(joined: str) -> tuple[dict, dict, dict]:
    """Distinct tokens, bigrams and trigrams of a token text, in order."""
    toks = joined.split()
    grams = (joined[i : i + 3] for i in range(max(1, len(joined) - 2))) if joined else ()
    return dict.fromkeys(toks), dict.fromkeys(f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False)), dict.fromkeys(grams)


def token_arrays(joined: Column) -> Column:
    """Struct of the arrays tokens, bigrams, trigrams (distinct) of a token text."""

    @F.pandas_udf("tokens array<string>, bigrams array<string>, trigrams array<string>")
    def arrays(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tuple(map(list, token_sets(x))) for x in texts], columns=["tokens", "bigrams", "trigrams"])

    return arrays(joined)


def token_counts(joined: Column) -> Column:
    """Struct of the numbers n_tokens, n_bigrams, n_trigrams of distinct ones: sets are held for one text at a time."""

    @F.pandas_udf("n_tokens long, n_bigrams long, n_trigrams long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tuple(map(len, token_sets(x))) for x in texts], columns=["n_tokens", "n_bigrams", "n_trigrams"])

    return counts(joined)


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def canonical_tokens(x: Column) -> Column:
    """Tokens with synonyms merged and fillers dropped, and `instruction` moved behind a run of `previous` that follows it."""
    same = F.create_map(*[F.lit(v) for kv in SYNONYMS.items() for v in kv])
    words = F.transform(F.filter(tokens(x), lambda t: ~t.isin(*FILLERS)), lambda t: F.coalesce(F.try_element_at(same, t), t))
    spaced = F.array_join(F.transform(words, lambda t: F.concat(F.lit(" "), t, F.lit(" "))), "")
    moved = F.regexp_replace(spaced, " instruction (( previous )+)", "$1 instruction ")
    return F.filter(F.split(moved, " +"), lambda t: t != "")


def bigrams(toks: Column) -> Column:
    n = F.size(toks)
    return F.when(n > 1, F.array_distinct(F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))), F.slice(toks, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three code points; a shorter text is its own only run; an empty one has none."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    both, either = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(either == 0, 1.0).otherwise(both / (either - both))


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 for equal normalised hashes or equal token texts, else the weighted sum of three Jaccard indexes."""
    return F.when((a["hash"] == b["hash"]) | (a["joined"] == b["joined"]), 1.0).otherwise(weighted(a, b))


def weighted(a: dict[str, Column], b: dict[str, Column]) -> Column:
    parts = [F.lit(w) * jaccard(a[k], b[k]) for w, k in zip(WEIGHTS, ("tokens", "bigrams", "trigrams"), strict=True)]
    return parts[0] + parts[1] + parts[2]


def slug(x: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def stable_draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of SHA-256 of the canonical JSON of seed and cluster id."""
    body = F.concat(F.lit(f'{{"seed":{seed},"semantic_cluster_id":"'), key, F.lit('"}'))
    return F.conv(F.substring(F.sha2(body, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rank_key(seed: int | str, salt: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key), 256)


def hash_choice(x: Column, n: int) -> Column:
    """First eight bytes of SHA-256, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n)).cast("int")


def nth_occurrence(text: Column, part: str, n: int) -> Column:
    """0-based start of the n-th (from 0) occurrence of part, which may overlap; -1 if there is none."""
    find = lambda at: F.when(at >= 0, F.call_function("locate", F.lit(part), text, at + 1) - 1).otherwise(-1)
    out = find(F.lit(0))
    for _ in range(n):
        out = F.when(out >= 0, F.call_function("locate", F.lit(part), text, out + 2) - 1).otherwise(-1)
    return out


def valid_spans(spans: Column, text: Column) -> Column:
    return F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text))) & (F.size(F.array_distinct(spans)) == F.size(spans))


def masked(text: Column, spans: Column) -> Column:
    """text with spans replaced by as many spaces."""
    return F.aggregate(spans, text, lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]), F.substr(t, s["end"] + 1)))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v.cast("double") - top.cast("double")))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(x: Column) -> Column:
    """0-based; the first of ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def js_divergence(p: Column, q: Column, epsilon: float = 1e-8) -> Column:
    keep = lambda v: F.greatest(v, F.lit(epsilon))

    def term(a: Column, b: Column) -> Column:
        a, b = keep(a), keep(b)
        m = (a + b) / 2
        return (a * F.log(a / m) + b * F.log(b / m)) / 2

    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, b: a + b)


def head_tail(x: Column, limit: int, ratio: float) -> Column:
    """An array cut to limit elements: floor(limit * ratio), but one at least, from its head, the rest from its tail."""
    head = max(1, int(limit * ratio))
    cut = F.concat(F.slice(x, 1, head), F.slice(x, F.greatest(F.size(x) - (limit - head) + 1, F.lit(1)), limit - head) if limit > head else F.slice(x, 1, 0))
    return F.when(F.size(x) > limit, cut).otherwise(x)


def first_present(*fields: Column, fallback: Column | None = None) -> Column:
    """The first field that isn't null or empty, else the fallback."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], *([] if fallback is None else [fallback]))


def canonical_id(prefix: str, name: Column, parts: dict[str, Column]) -> Column:
    """prefix, slug of the name, and 24 hexadecimal digits of SHA-256 of the parts' canonical JSON (keys in order, nulls kept)."""
    body = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    return F.concat_ws("_", F.lit(prefix), slug(name), F.substring(F.sha2(body, 256), 1, 24))


def cluster_id(representative: Column) -> Column:
    return F.concat(F.lit("semantic_"), F.substring(F.sha2(representative, 256), 1, 24))


def contained(spans: Column, within: Column) -> Column:
    """The spans that lie inside one of `within`."""
    return F.filter(spans, lambda s: F.exists(within, lambda w: (w["start"] <= s["start"]) & (s["end"] <= w["end"])))


def quoted(text: Column, start: Column, end: Column, opening: str, closing: str) -> Column:
    """Whether the last character before a span and the first after it, spaces aside, are a pair of quotes or brackets."""
    left = F.right(F.rtrim(F.substr(text, F.lit(1), F.greatest(start, F.lit(0)))), F.lit(1))
    right = F.left(F.ltrim(F.substr(text, end + 1)), F.lit(1))
    at = lambda marks, c: F.call_function("locate", c, F.lit(marks))
    return (left != "") & (right != "") & (at(opening, left) > 0) & (at(opening, left) == at(closing, right))


def leaks(text: Column, words: list[str]) -> Column:
    """Whether a text says one of the labels or field names, in any case."""
    return text.rlike(r"(?i)\b(" + "|".join(words) + r")\b")


def cell(x: Column) -> Column:
    """A cell of a markdown table."""
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def percent(n: Column, total: Column) -> Column:
    return F.format_string("%.2f%%", F.when(total == 0, 0.0).otherwise(100.0 * n / total))


def sections(parts: dict[str, Column], missing: str = "[MISSING]") -> Column:
    """Tagged blocks, one after another."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"<{k}>\n"), F.coalesce(v, F.lit(missing)), F.lit(f"\n</{k}>")) for k, v in parts.items()])
