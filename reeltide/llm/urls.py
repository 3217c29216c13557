"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged, table

#: Words of 64 bits in a block, bits set for a key, bits of the filter for a key.
BLOCK_WORDS = 8
KEY_BITS = 6
BITS_A_KEY = 16
#: The filter never has more blocks than this (8 MB of bits); a fuller filter only lets more keys through to the join.
MAX_BLOCKS = 1 << 17
#: A list up to so many entries is broadcast to the exact join.
BROADCAST_ROWS = 20_000
#: Parameters of links that name no page of their own.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)="

#: (host, path, verdict): a rule fits its host with all subdomains where the path starts with the rule's.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_host(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host and path without scheme, www., m., default port, trailing slash or .html; sorted parameters without tracking; no fragment. Null without ://."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"\.html$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def host_suffixes(host: Column) -> Column:
    """The host and all domains that it is a subdomain of."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The key's block, and the bits it sets in each word of the block."""
    h, bit = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    spots = [F.shiftrightunsigned(bit, 9 * i).bitwiseAND(64 * BLOCK_WORDS - 1) for i in range(KEY_BITS)]
    words = []
    for w in range(BLOCK_WORDS):
        mask = F.lit(0).cast("long")
        for s in spots:
            mask = mask.bitwiseOR(F.when(F.shiftright(s, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), s.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        words.append(mask)
    return F.pmod(h, F.lit(blocks)), words


def bloom_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Blocks (block, w0 ... w7) of the filter of column key, and how many there are. Built by bit_or, a row a block."""
    blocks = min(MAX_BLOCKS, max(1, 1 << (max(1, count) * BITS_A_KEY // (64 * BLOCK_WORDS)).bit_length()))
    block, words = _places(F.col("key"), blocks)
    marked = keys.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)]), blocks


def _may_hold(probes: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Rows whose key may be listed, and rows without a key. The filter's size is bounded, so it is broadcast."""
    block, words = _places(F.col("key"), n)
    masks = [w.alias(f"m{i}") for i, w in enumerate(words)]
    found = probes.select("*", block.alias("block"), *masks).join(F.broadcast(blocks), "block", "left")
    hit = F.lit(True)
    for i in range(BLOCK_WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return found.filter(F.col("key").isNull() | F.coalesce(hit, F.lit(False))).select(*probes.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rules: host, path, verdict; of the rules that fit, the longest host and path wins, then the longer host, then allow
    before block. listed: url, canonical URLs to block where no rule fits; other URLs are allowed. Both kinds are keys of
    one filter. Null URLs have empty host and path, no rule, and are allowed. Repeated rows and ids stay apart; empty
    tables of rules or URLs are fine.
    """
    entries = rules.select(_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "verdict")
    entries = entries.union(listed.select(F.concat(F.lit("\r"), "url").alias("key"), F.lit(None).cast("string"), F.lit(0), F.lit("block"))).filter(F.col("key").isNotNull())
    entries = staged(entries.groupBy("key").agg(F.min(F.struct("verdict", "rule", "host_size")).alias("e")).select("key", "e.*"), "url-list")
    count = entries.count()
    sizes = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect()]
    blocks, n = bloom_filter(entries, count)
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), canonical(url).alias("_c"), F.monotonically_increasing_id().alias("_row"))
    starts = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda k: k <= F.length("path"))
    keys = F.flatten(F.transform(host_suffixes(F.col("host")), lambda h: F.transform(starts, lambda k: _key(h, F.substring(F.col("path"), F.lit(1), k)))))
    every = F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("_c").isNull(), F.array().cast("array<string>")).otherwise(F.concat(keys, F.array(F.concat(F.lit("\r"), "_c")))))
    probes = rows.select("_row", "page_id", "host", "path", F.explode(every).alias("key"))
    hits = _may_hold(probes, blocks, n).join(bounded_broadcast(entries, count, BROADCAST_ROWS), "key", "left")
    # the row without a key keeps every page; a listed URL (no rule) ranks below any rule
    rank = F.when(F.col("verdict").isNotNull(), F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("size"), F.col("host_size"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("soft"), "rule", "verdict"))
    best = hits.groupBy("_row", "page_id", "host", "path").agg(F.max(rank).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def advertising(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list for the query: canonical URLs of pages on hosts with a label of two words joined by a hyphen (advertisers here)."""
    url = F.col(url_col)
    return pages.filter(url_host(url).rlike(r"(^|\.)[a-z]+-[a-z]+\.")).select(canonical(url).alias("url")).distinct()


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules, advertising(pages))


_HOST = r"translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, u, {_HOST} AS host, regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT q.*, r.rhost || r.rpath AS rule, r.verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS n
 FROM q LEFT JOIN rules r ON (q.host = r.rhost OR ends_with(q.host, '.' || r.rhost)) AND starts_with(q.path, r.rpath))
SELECT page_id, host, path, rule,
 coalesce(verdict, CASE WHEN regexp_matches(host, '(^|\.)[a-z]+-[a-z]+\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM fit WHERE n = 1
"""
