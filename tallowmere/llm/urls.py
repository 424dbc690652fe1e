"""URL filters: domain and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Every URL gives a host and a path. The longest rule that fits its host (or a domain above it) and its path
decides. Where none does, the URL's canonical form is looked up in the list: a blocked Bloom filter (one
block of four 64-bit words a key, one bit a word, built with `bit_or`) passes all listed forms and a few
others, and only what it passes goes to the exact hash join that removes the false positives. So a shuffle
moves possible hits alone. The filter's size follows the list; it is broadcast while its blocks number at
most `BROADCAST_BLOCKS`, and joined by a shuffle of block numbers beyond.

All on DataFrame functions. Null URLs and such without `://` have an empty host and path, fit no rule, have
no canonical form and are allowed. Repeated URLs are judged each on their own; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys meant for a block of four words: with 256 bits and 4 bits a key, under 0.1 % false positives.
KEYS_A_BLOCK, BROADCAST_BLOCKS = 12, 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without `www.` or `m.` and port, path without its `.html` ending and last slashes; null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(?:www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, host, path) rules, a bounded list: the longest that fits as a struct<rule, verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _hashed(key: Column, blocks: int) -> dict[str, Column]:
    """Block number and the four words of a key's bits."""
    h = F.xxhash64(key)
    bit = lambda n: F.expr("1L").cast("long") if n is None else F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit("bits")), 6 * n).bitwiseAND(F.lit(63)).cast("int"))
    return {"block": F.pmod(h, F.lit(blocks)), **{f"b{n}": bit(n) for n in range(4)}}


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column `key`: a row for each block that holds bits."""
    return listed.select(*[c.alias(n) for n, c in _hashed(F.col("key"), blocks).items()]).groupBy("block").agg(*[F.bit_or(f"b{n}").alias(f"w{n}") for n in range(4)])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of every row. `listed`: canonical URLs in its column `key`."""
    listed = listed.where(F.col("key").isNotNull()).select("key").distinct()
    blocks = max(1, listed.count() // KEYS_A_BLOCK)
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select(id_col, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rows = rows.withColumn("_rule", rule_column(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_key", F.when(F.col("_rule").isNull(), canonical(F.col("host"), F.col("path"))))
    rows = rows.withColumns(_hashed(F.col("_key"), blocks)).withColumn("block", F.when(F.col("_key").isNotNull(), F.col("block")))
    filter_ = bloom(listed, blocks)
    rows = rows.join(F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_, "block", "left")
    possible = F.lit(True)
    for n in range(4):
        possible &= F.col(f"w{n}").bitwiseAND(F.col(f"b{n}")) != 0
    rows = rows.select(id_col, "host", "path", "_rule", F.when(F.coalesce(possible, F.lit(False)), F.col("_key")).alias("_key"))
    hits = rows.where(F.col("_key").isNotNull()).join(listed.withColumnRenamed("key", "_key").withColumn("_hit", F.lit(True)), "_key", "left")
    both = hits.select(id_col, "host", "path", "_rule", "_hit").unionByName(rows.where(F.col("_key").isNull()).select(id_col, "host", "path", "_rule", F.lit(False).alias("_hit")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def tracked(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list to filter by where none is given: canonical forms of the URLs that occur with a feed's tracking mark."""
    url = F.col(url_col).cast("string")
    return pages.where(url.rlike(r"[?&]utm_source=")).select(canonical(host_of(url), path_of(url)).alias("key"))
