"""URL filters: path rules, then a blocked Bloom filter in front of an exact hash join.

Everything here is DataFrame functions.  The Bloom filter is a table with one
row per 256-bit block (four 64-bit words); a listed URL sets two bits in each
word of its block.  A probe is an equi-join on the block number, so the filter
is broadcast when its checked size allows and shuffled otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest first: (verdict, host, path prefix).
RULES = (
    ("allow", "www.example.com", "/en/"),
    ("block", "example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
    ("allow", "com", "/"),
)
BITS_PER_KEY = 16
BROADCAST_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and the query without tracking parameters; scheme and fragment go."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)"))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def _fits(h: Column, p: Column, rule_host: str, rule_path: str) -> Column:
    return ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)


def rule_columns(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; both null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = reduce(lambda c, r: c.when(_fits(h, p, r[1], r[2]), F.lit(r[1] + r[2])), ordered, F.when(F.lit(False), F.lit("")))
    verdict = reduce(lambda c, r: c.when(_fits(h, p, r[1], r[2]), F.lit(r[0])), ordered, F.when(F.lit(False), F.lit("")))
    return name, verdict


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the block's four words, from 48 bits of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda i: F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), bit(i))
    return [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter's set blocks ``(block, w0..w3)`` and the number of blocks it has."""
    blocks = max(1, -(-n_keys * BITS_PER_KEY // 256))
    words = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)]), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Judge every row of ``pages``: its rule's verdict, else block if its canonical URL is listed, else allow.

    Only rows without a rule are looked up: in the broadcast filter, or, if
    that is too large, by a shuffle of just those rows.

    ``pages`` needs ``page_id`` and ``url``; ``listed`` needs ``url``.  Other
    columns are not read.  A null url has an empty host and path and is
    allowed unless the empty canonical URL is listed (null and empty listed
    URLs are ignored); repeated rows stay repeated; empty tables give empty or
    all-rule results.  A repeated URL, even in a third of all rows, only meets
    unique listed keys, so AQE can split the page side of the exact join.
    """
    known = listed.select(canonical(F.col("url")).alias("canon")).where("canon != ''").distinct()
    n_keys = known.count()
    h, p = host(F.col("url")), path(F.col("url"))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", h.alias("host"), p.alias("path"), canonical(F.col("url")).alias("canon"))
    judged = judged.select("page_id", "host", "path", "canon", rule.alias("rule"), by_rule.alias("by_rule"))
    blocks, n_blocks = bloom_blocks(known, "canon", n_keys)
    undecided = F.col("by_rule").isNull()
    block = F.when(undecided, _block(F.col("canon"), n_blocks))
    if n_blocks * 40 <= BROADCAST_BYTES:
        probe = judged.withColumn("block", block).join(F.broadcast(blocks), "block", "left")
    else:
        asked = judged.where(undecided).withColumn("block", block).join(blocks, "block", "left")
        probe = asked.unionByName(judged.where(~undecided), allowMissingColumns=True)
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canon")))])
    probe = probe.withColumn("possible", F.coalesce(hit & undecided, F.lit(False)))
    columns = ["page_id", "host", "path", "rule", "by_rule"]
    clear = probe.where(~F.col("possible")).select(*columns, F.lit(False).alias("listed"))
    exact = probe.where("possible").select(*columns, "canon").join(known.withColumn("found", F.lit(True)), "canon", "left")
    exact = exact.select(*columns, F.coalesce("found", F.lit(False)).alias("listed"))
    out = clear.unionByName(exact)
    verdict = F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
