"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join.

The list holds two kinds of keys: canonical URLs, and rules (host, path prefix).  A url probes the filter with its canonical
form and with every (host suffix, path prefix) that a rule could have; a probe reads one block of eight words of 64 bits, in
each of which the key sets one bit.  Probes that pass, and they alone, are hash-joined with the list, which removes the
filter's false positives.  The filter is a table of blocks: up to BROADCAST_BLOCKS blocks (64 bytes each) go out whole, a larger one
is joined on the block number, so no machine needs to hold it.  Up to BROADCAST_RULES rules go out whole to be joined with
the probes that are rules, as a rule for a whole domain is hit by very many urls; the urls are joined apart from them.

Parts of a url: the host is what lies between the first "://" and "/", "?", "#" or the end, A-Z lower-cased; the path goes on
up to "?", "#" or the end.  A rule fits its host and all subdomains if the path starts with the rule's; the longest rule text
(host and path) wins, then the smallest text; block wins between two rules of one text.  Without a rule, a listed url is
blocked and any other allowed.

Edge cases: a null url or one without "://" has an empty host and path and is allowed; an empty list allows all; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only

BITS_A_KEY = 12
#: Filters of up to so many blocks (4 MiB) are broadcast; larger ones are joined block by block.
BROADCAST_BLOCKS = 1 << 16
BROADCAST_RULES = 1 << 15
WORDS, WORD_BITS = 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Query parameters that don't change what a url shows.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a last slash, and the query without tracking parameters; scheme and fragment go."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _words(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of a filter of keys.key, of which absent ones are empty, and how many there are in all."""
    blocks = max(1, keys.count() * BITS_A_KEY // (WORDS * WORD_BITS))
    at = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    parts = keys.select(at, *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("key")))])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible(probes: DataFrame, filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The probes whose key the filter may hold: all that are listed, and few others."""
    table = F.broadcast(filter_blocks) if blocks <= BROADCAST_BLOCKS else filter_blocks
    masks = [w.alias(f"m{i}") for i, w in enumerate(_words(F.col("key")))]
    joined = probes.select("*", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *masks).join(table, "block")
    for i in range(WORDS):
        joined = joined.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return joined.select(*probes.columns)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) as a table; the action is allow or block."""
    return spark.createDataFrame([(a, h.translate(str.maketrans(UPPER, LOWER)), p) for a, h, p in rules], "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_column: str = "page_id", url_column: str = "url", listed_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and whether the url is listed, for every row of pages.

    rules: action, host, path.  listed: urls, made canonical here; any size.
    """
    urls = only(pages, id_column, url_column).toDF(id_column, "url")
    rule_keys = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.max("action").alias("action"))  # block > allow
    rule_keys = rule_keys.select(F.concat(F.lit("R"), "host", F.lit("\x00"), "path").alias("key"), F.concat("host", "path").alias("rule"), "action")
    url_keys = only(listed, listed_column).toDF("u").where(F.col("u").isNotNull()).select(F.concat(F.lit("U"), canonical(F.col("u"))).alias("key")).distinct()
    filter_blocks, blocks = bloom_blocks(rule_keys.select("key").union(url_keys))
    lengths = sorted(r[0] for r in rules.where(F.col("path").isNotNull()).select(F.length("path")).distinct().collect())

    distinct = urls.where(F.col("url").contains("://")).select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # No suffix with more labels than a rule's host can be one's: a host's probes are as many as a rule has labels.
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    rule_probes = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("R"), s, F.lit("\x00"), p))))
    probes = distinct.select("url", F.explode(F.array_union(rule_probes, F.array(F.concat(F.lit("U"), canonical(F.col("url")))))).alias("key"))
    hits = possible(probes, filter_blocks, blocks)
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    of_rules = hits.where(F.col("key").startswith("R")).join(F.broadcast(rule_keys) if few else rule_keys, "key").select("url", "rule", "action")
    of_urls = hits.where(F.col("key").startswith("U")).join(url_keys, "key").select("url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    best = of_rules.unionByName(of_urls).groupBy("url").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("n"), "rule", F.when(F.col("action") == "block", 0).otherwise(1).alias("a"), "action"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    # As a column made anew, the key is dealt out for the join on both sides, so that a url in very many rows can be split.
    joined = urls.join(best.withColumn("hit", F.concat("url", F.lit(""))).drop("url"), F.col("url") == F.col("hit"), "left")
    listed_too = F.coalesce("listed", F.lit(False))
    return joined.select(
        id_column,
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.when(listed_too, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        listed_too.alias("listed"),
    )
