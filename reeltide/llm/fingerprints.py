"""Document fingerprints: a homomorphic multiset hash. Wide vectors hashed from paragraphs are added modulo 2 ** 32.

A vector has LANES random lanes, whose sums tell equal multisets of paragraphs, and SIGNS lanes that hold, for each bit of a 64-bit hash,
the sum of +1 and -1 over the word shingles of the paragraph; the sums of those can be compared for likeness. Both come from the paragraph
alone, so a fingerprint can be added to and subtracted from paragraph by paragraph, in any order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, whole, words

#: Lanes of 32 bits that decide equality: 256 bits.
LANES = 8
MASK = 0xFFFFFFFF
SIGNS = 64
SHINGLE = 3
#: Rows of a range of ids; beyond so many ranges they grow (their sort spills), as the bounds stand in the plan.
ROWS_A_BUCKET = 2_000
MAX_BUCKETS = 1 << 17
#: Two bits of a hash, each the lowest of a 31-bit counter.
_LOW = 1 | 1 << 31
#: The hash bit of every sign lane.
HASH_BITS = [b for i in range(31) for b in (i, i + 31)] + [62, 63]


def paragraphs(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))


def paragraph_vector(p: Column, lanes: int = LANES) -> Column:
    """The vector of one paragraph: lane hashes chained from two 64-bit hashes of it."""
    return let(F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b")), lambda h: F.array(*[F.xxhash64(F.lit(i), h["a"], h["b"]).bitwiseAND(MASK) for i in range(lanes)]))


def add(a: Column, b: Column) -> Column:
    """The hash of two multisets together: insertion of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(MASK))


def subtract(a: Column, b: Column) -> Column:
    """The hash after deletion of the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(MASK))


def multiset_hash(text: Column, lanes: int = LANES) -> Column:
    """Sum of the paragraph vectors modulo 2 ** 32; the order of paragraphs does not count."""
    vectors = F.transform(paragraphs(text), lambda p: paragraph_vector(p, lanes))
    return F.aggregate(vectors, F.array(*[F.lit(0).cast("long")] * lanes), add)


def to_hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def from_hex(fingerprint: Column) -> Column:
    """The lanes of a fingerprint string."""
    at = F.sequence(F.lit(1), F.length(fingerprint), F.lit(8))
    return F.transform(at, lambda i: F.conv(F.substring(fingerprint, i, F.lit(8)), 16, 10).cast("long"))


def shingle_hashes(text: Column) -> Column:
    """One hash for each run of SHINGLE words of a paragraph (one for all words of a shorter one), for all paragraphs."""
    return F.flatten(F.transform(paragraphs(text), _runs))


def _runs(paragraph: Column) -> Column:
    def runs(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))
    return let(words(paragraph), runs)


def _sketch_sums(h: Column) -> list[Column]:
    """Counts of set bits over all shingles, two counters to a sum. Adding sums adds multisets."""
    pairs = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(_LOW)).alias(f"_s{i}") for i in range(31)]
    return [*pairs, F.sum(F.shiftrightunsigned(h, 62).bitwiseAND(1)).alias("_s62"), F.sum(F.shiftrightunsigned(h, 63)).alias("_s63"), F.count(h).alias("_n")]


def _sums() -> Column:
    """Sums of +1 and -1 over the shingles, one for each hash bit, modulo 2 ** 32."""
    counts = [x for i in range(31) for x in (F.col(f"_s{i}").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(f"_s{i}", 31))] + [F.col("_s62"), F.col("_s63")]
    return F.array(*[F.coalesce(2 * c - F.col("_n"), F.lit(0)).cast("long").bitwiseAND(MASK) for c in counts])


def fingerprint_vector(text: Column) -> Column:
    """All lanes of a text as one column: multiset_hash and the sums of signs. add and subtract work on it."""
    signs = let(shingle_hashes(text), lambda hs: F.transform(F.array(*[F.lit(b) for b in HASH_BITS]), lambda b: F.aggregate(
        hs, F.lit(0).cast("long"), lambda s, h: s + F.when(F.call_function("shiftrightunsigned", h, b).bitwiseAND(1) == 1, 1).otherwise(-1)).bitwiseAND(MASK)))
    return F.concat(multiset_hash(text), signs)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints (lanes): 1 for equal multisets of shingles, near 0 for disjoint ones: one minus the estimated share that differs.

    The squared norm of a sum of random sign vectors estimates the size of its multiset, and the difference of two sums
    is the sum of the symmetric difference. With 64 signs the standard error is about a sixth. Two texts without words: 1.
    """
    own = lambda v: F.transform(F.slice(v, LANES + 1, SIGNS), lambda x: F.when(x > MASK // 2, x - (MASK + 1)).otherwise(x).cast("double"))
    squares = lambda x, y, f: F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)
    parts = let(F.struct(own(a).alias("x"), own(b).alias("y")), lambda v: F.struct(
        squares(v["x"], v["y"], lambda x, y: (x - y) * (x - y)).alias("gap"), squares(v["x"], v["y"], lambda x, y: x * x + y * y).alias("norm")))
    return let(parts, lambda v: F.when(v["gap"] == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - v["gap"] / v["norm"]))))


def _buckets(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Lower ends of id ranges of about equal rows, and the largest id in each. At most MAX_BUCKETS of them."""
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"))
    n, least = ids.agg(F.count(F.lit(1)), F.min("i")).first()
    if not n:
        return [], []
    parts = min(MAX_BUCKETS, n // ROWS_A_BUCKET + 1)
    cuts = ids.agg(F.percentile_approx("i", _listed([k / parts for k in range(1, parts)], "double"), 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({least, *(cuts or [])})
    top = {r["b"]: r["m"] for r in ids.withColumn("b", _bucket_of(F.col("i"), bounds)).groupBy("b").agg(F.max("i").alias("m")).collect()}
    used = sorted(top)
    return [bounds[k] for k in used], [top[k] for k in used]


def _listed(values: list, kind: str = "long") -> Column:
    """A literal array; the optimizer folds it, so many values make no large expression."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _bucket_of(i: Column, bounds: list[int]) -> Column:
    """Index of the last bound that is not above i, by halving."""
    steps = [1 << k for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    return let(_listed(bounds), lambda bs: F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(bs, at + s) <= i, F.lit(False)), at + s).otherwise(at)))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row (doc_id, _t) in a bucket of neighbouring ids; the first row of the next bucket comes along as a guest.

    _b bucket, _k place by descending id in it, _guest, _next the text of the next document (of the first after the last).
    Texts are shuffled once. A null id counts as the smallest; rows of one id follow each other by text.
    """
    bounds, tops = _buckets(docs)
    if not bounds:
        bounds, tops = [0], [0]
    i = F.coalesce("doc_id", F.lit(-(1 << 63)))
    home = F.col("_home")
    seat = lambda bucket, guest: F.struct(bucket.cast("int").alias("_b"), F.lit(guest).alias("_guest"))
    top = i == _listed(tops)[home]
    seats = F.when(top, F.array(seat(home, False), seat((home + 1) % len(bounds), True))).otherwise(F.array(seat(home, False)))
    dealt = docs.withColumn("_home", _bucket_of(i, bounds)).withColumn("_seat", F.explode(seats)).select("doc_id", "_t", "_seat.*")
    w = Window.partitionBy("_b").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_t")
    return dealt.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("_t").over(w))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text (second half replaced by the beginning of the next document).

    fingerprint: all lanes in hex, 8 digits each, first those for equality. near_edited and near_next are the likeness of the fingerprint to
    the edited text's and to the next document's; :func:`from_hex` and :func:`likeness` give the same from the strings. Null text: empty;
    without words all lanes are zero. One row per input row; ids may repeat.
    """
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t")))
    n, half = F.length("_t"), F.expr("length(_t) div 2")
    edited = F.concat(F.expr("substring(_t, 1, length(_t) - length(_t) div 2)"), F.expr("substring(coalesce(_next, ''), 1, length(_t) div 2)"))
    rows = rows.select("_b", "_k", "_guest", "doc_id", F.struct(n.cast("long").alias("n"), F.lit(False).alias("e"), F.col("_t").alias("t")).alias("own"), F.struct(half.cast("long").alias("n"), F.lit(True).alias("e"), edited.alias("t")).alias("ed"))
    both = rows.select("_b", "_k", "_guest", "doc_id", F.explode(F.when(F.col("_guest"), F.array("own")).otherwise(F.array("own", "ed"))).alias("v"))
    both = both.select("_b", "_k", "_guest", "doc_id", F.col("v.e").alias("_e"), F.col("v.n").alias("_chars"), multiset_hash(F.col("v.t")).alias("_f"),
                       F.when(F.col("v.e"), F.sha2(F.col("v.t"), 256)).alias("_sha"), shingle_hashes(F.col("v.t")).alias("_h"))
    # hash and lanes are grouping keys so that the sums stay in a hash aggregate; the keys hold _b, so nothing is shuffled again
    keys = ["_b", "_k", "_e", "_guest", "doc_id", "_chars", "_f", "_sha"]
    sums = both.select(*keys, F.explode_outer("_h").alias("_h")).groupBy(*keys).agg(*_sketch_sums(F.col("_h")))
    sums = sums.select("_b", "_k", "_e", "_guest", "doc_id", "_chars", "_sha", F.concat("_f", _sums()).alias("_v"))
    # an edited text stands right behind its own text, the next document's text behind that
    w = Window.partitionBy("_b").orderBy("_k", "_e")
    out = sums.withColumns({"_ev": F.lead("_v").over(w), "_es": F.lead("_sha").over(w), "_nv": F.lead("_v", 2).over(w)}).filter(~F.col("_e") & ~F.col("_guest"))
    return out.select("doc_id", F.col("_chars").alias("n_chars"), F.col("_es").alias("edited_sha256"), to_hex(F.col("_v")).alias("fingerprint"), to_hex(F.col("_ev")).alias("edited_fingerprint"),
                      likeness(F.col("_v"), F.col("_ev")).alias("near_edited"), likeness(F.col("_v"), F.col("_nv")).alias("near_next"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
