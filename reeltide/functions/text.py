"""Text column functions: comments, transcripts and on-screen text."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .numbers import col, total


def words(text: Column | str) -> Column:
    """Lower-cased whitespace tokens."""
    return raw_words(F.lower(col(text)))


def raw_words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), "")


def count_words_in(tokens: Column, lexicon: Iterable[str]) -> Column:
    lexicon = list(lexicon)
    return F.size(F.filter(tokens, lambda w: w.isin(lexicon)))


def phrase_hits(lowered: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur as substrings."""
    return total([F.when(F.contains(lowered, F.lit(p)), 1).otherwise(0) for p in phrases])


def occurrences(text: Column, piece: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


# ---- timestamps and numbers quoted in a comment -------------------------------------------

def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _weighted_sum(parts: list[Column], factors: tuple[float, ...]) -> Column:
    amount = F.transform(parts[0], lambda x: x.cast("double") * factors[0])
    if len(parts) == 1:
        return amount
    rest = _weighted_sum(parts[1:], factors[1:])
    return F.zip_with(amount, rest, lambda a, b: a + b)


def extract_timestamps(text: Column | str) -> Column:
    """struct(raw array<string>, seconds array<double>), patterns applied one after another."""
    t = col(text)
    raws, secs = [], []
    for pattern, factors in L.TIMESTAMP_PATTERNS:
        raws.append(_all(t, pattern, 0))
        parts = [_all(t, pattern, i + 1) for i in range(len(factors))]
        secs.append(_weighted_sum(parts, factors))
    return F.struct(F.concat(*raws).alias("raw"), F.concat(*secs).alias("seconds"))


def extract_numbers(text: Column | str) -> Column:
    return _all(col(text), L.NUMBER_PATTERN, 0)


# ---- comment scores ----------------------------------------------------------------------

def quick_spam(text: Column | str, likes: Column | str) -> Column:
    t, low, n = col(text), F.lower(col(text)), F.coalesce(col(likes), F.lit(0))
    base = (
        F.when(phrase_hits(low, L.QUICK_SPAM_PHRASES) > 0, 0.4).otherwise(0.0)
        + F.when(occurrences(low, "http") >= 2, 0.3).otherwise(0.0)
        + F.when(F.length(t) < 5, 0.2).otherwise(0.0)
    )
    damp = F.when(n >= 100, 0.15).when(n >= 10, 0.5).otherwise(1.0)
    return F.least(base * damp, F.lit(1.0))


def spam_score(text: Column | str) -> Column:
    t = col(text)
    hits = total([F.when(t.rlike(p), 0.25).otherwise(0.0) for p in L.SPAM_PATTERNS])
    return F.least(hits + F.when(F.size(raw_words(t)) <= 2, 0.1).otherwise(0.0), F.lit(1.0))


def toxicity_score(text: Column | str) -> Column:
    t = col(text)
    n = F.length(t)
    caps = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    marks = occurrences(t, "!") + occurrences(t, "?")
    return (
        F.when((n > 10) & (caps / F.greatest(n, F.lit(1)) > 0.6), 0.3).otherwise(0.0)
        + F.when(marks > 5, 0.2).otherwise(0.0)
        + F.when((F.size(raw_words(t)) <= 3) & (marks > 0), 0.1).otherwise(0.0)
    )


def comment_status(spam: Column | str, toxicity: Column | str, spam_at: float = 0.75, toxic_at: float = 0.80) -> Column:
    return F.when(col(spam) >= spam_at, "spam").when(col(toxicity) >= toxic_at, "toxic").otherwise("processed")


def sentiment_signed(label: Column | str, score: Column | str) -> Column:
    low = F.lower(col(label))
    return (
        F.when(F.contains(low, F.lit("positive")), F.struct(col(score).alias("score"), F.lit("positive").alias("label")))
        .when(F.contains(low, F.lit("negative")), F.struct((-col(score)).alias("score"), F.lit("negative").alias("label")))
        .otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("neutral").alias("label")))
    )


def entity_type(label: Column | str) -> Column:
    out = F.lit("concept")
    for kind, labels in L.ENTITY_TYPES.items():
        out = F.when(col(label).isin(labels), kind).otherwise(out)
    return out


# ---- transcripts -------------------------------------------------------------------------

def clean_filler(text: Column | str) -> Column:
    kept = F.filter(raw_words(col(text)), lambda w: ~F.lower(w).isin(L.ASR_FILLERS))
    return F.array_join(kept, " ")


def top_token_count(tokens: Column) -> Column:
    """Count of the most frequent token, by run lengths over the sorted tokens."""
    folded = F.aggregate(
        F.array_sort(tokens),
        F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, w: F.struct(
            w.alias("w"),
            F.when(acc["w"] == w, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.greatest(acc["best"], F.when(acc["w"] == w, acc["run"] + 1).otherwise(F.lit(1))).alias("best"),
        ),
    )
    return folded["best"]


def _same(b: Column, i: Column, j: Column, n: Column) -> Column:
    """Whether n code points from i on are those from j on, in a text of four bytes a code point."""
    return F.substring(b, (4 * i + 1).cast("int"), (4 * n).cast("int")) == F.substring(b, (4 * j + 1).cast("int"), (4 * n).cast("int"))


def _alike(b: Column, a: Column, p: Column, most: Column, forward: bool) -> Column:
    """How many code points agree at distance p from a on (or before a), at most so many: by falling powers of two."""
    def grow(done: Column, e: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), e)
        at = a + done if forward else a - done - step
        return F.when((done + step <= most) & _same(b, at, at + p, step), done + step).otherwise(done)
    return F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), F.lit(0), grow)


def has_loop(text: Column | str, least: int = 10, times: int = 4) -> Column:
    """Whether some stretch of at least ``least`` characters without a line end stands ``times`` times in a row (4 or more).

    A loop of period p holds three multiples of p in a row, at which the same characters begin, so for every p only the multiples of p
    are looked at: n log n looks for n characters, whatever they repeat. Where three agree, the stretch of period p around is measured.
    """
    def loops(b: Column) -> Column:
        n = (F.octet_length(b) / 4).cast("int")

        def of_period(p: Column) -> Column:
            multiples = F.sequence(F.lit(0), F.floor((n - least) / p).cast("int") - 2)
            return F.exists(multiples, lambda j: _same(b, j * p, (j + 1) * p, F.lit(least)) & _same(b, (j + 1) * p, (j + 2) * p, F.lit(least)) & (
                _alike(b, j * p, p, F.least((times - 1) * p, n - (j + 1) * p), True) + _alike(b, j * p, p, F.least(p, j * p), False) >= (times - 1) * p))

        return F.when(n >= least * times, F.exists(F.sequence(F.lit(least), F.greatest(F.lit(least), F.floor(n / times).cast("int"))), of_period)).otherwise(False)

    lines = F.filter(F.split(col(text), "[\n\r\u0085\u2028\u2029]"), lambda x: F.length(x) >= least * times)
    return F.exists(F.transform(lines, lambda x: F.encode(x, "UTF-32")), loops)


def is_hallucination(text: Column | str, start: Column | str, end: Column | str) -> Column:
    t = F.trim(col(text))
    loops = has_loop(t)
    for p in L.LOOP_PATTERNS[1:]:
        loops = loops | t.rlike(p)
    tokens = words(t)
    n = F.size(tokens)
    # a token over 60 % leaves room for few others; the cheap distinct count rules most texts out
    dominated = F.when((n > 5) & (F.size(F.array_distinct(tokens)) <= n * 0.4 + 1), top_token_count(tokens) / n > 0.6).otherwise(False)
    return (t == "") | loops | dominated | (col(end) < col(start))


# ---- keys --------------------------------------------------------------------------------

def comment_key(platform, cid, author, text, ts) -> Column:
    p = col(platform)
    basis = F.concat_ws(
        ":", p, F.coalesce(col(author), F.lit("")), F.substring(F.coalesce(col(text), F.lit("")), 1, 100),
        F.coalesce(col(ts).cast("string"), F.lit("")),
    )
    hashed = F.concat(p, F.lit(":h"), F.substring(F.sha2(basis, 256), 1, 16))
    return F.when(F.coalesce(col(cid), F.lit("")) != "", F.concat_ws(":", p, col(cid))).otherwise(hashed)


def parse_posted(ts: Column | str) -> Column:
    """Epoch seconds or ISO text to timestamp, null when neither."""
    s = F.trim(col(ts).cast("string"))
    epoch = F.when(s.rlike(r"^-?\d+(\.\d+)?([eE]\d+)?$"), F.timestamp_micros((F.expr("double(0)") + s.try_cast("double") * 1e6).cast("long")))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp"))
    return F.coalesce(epoch, iso)


def uploaded_at(yyyymmdd: Column | str) -> Column:
    return F.try_to_timestamp(col(yyyymmdd), F.lit("yyyyMMdd"))


def vector_hash(vec: Column | str) -> Column:
    return F.substring(F.sha2(F.array_join(F.transform(col(vec), lambda x: x.cast("string")), ","), 256), 1, 16)


def node_id(*candidates: Column | str) -> Column:
    """First non-empty of the id fields in the given order."""
    return F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in candidates])


def node_label(fallback: Column | str, *candidates: Column | str) -> Column:
    return F.coalesce(*[F.substring(F.nullif(col(c).cast("string"), F.lit("")), 1, 50) for c in candidates], col(fallback))
