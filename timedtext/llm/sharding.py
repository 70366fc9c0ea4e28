"""Sharding by rendezvous hashing: a record's key and the shards' weights decide, and nothing else.

Each shard bids for each key, and the lowest bid wins.  A bid is an exponential variable with the shard's weight as its rate,
made from a hash of key and shard: so a shard wins in proportion to its weight, and adding a shard changes no other bid.  With
one more shard a record moves only if the new shard outbids all others, and then into it; the expected share that moves is the
new weight over all weights.  Integers stay under 2**62, so that any SQL engine gets the same shards.

Placing needs no shuffle.  Slots, the places within a shard, go by the order of a digest of all columns.  Rows alike
in all columns are counted before they are shuffled; digests fall into ranges of about `range_rows` rows, whose sums are added
up per shard, so no task sorts more than a range, whatever the shard's size and however often a key comes.

Edge cases: a null id is the key "" (its rows share a shard, and their texts spread them over its ranges); null texts have no
bytes and checksum 0, like empty ones; equal ids lie in one shard; rows alike in all columns get a slot each; an empty table
gives no rows; a weight of 0 takes no row, and a negative one or none above 0 is an error; columns of the input called size,
text_crc32, law, shard, slot or grown_shard give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes that a record takes beside its text.
OVERHEAD = 16
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Two words of 31 bits are mixed by steps of (xor or add, factor, prime): every product stays under 2**62, no step names its
#: input twice, so that 40 bids are 40 small expressions, and changing primes keeps the steps from being one linear map.
M31 = (1 << 31) - 1
PRIMES = (2147483647, 2147483629)
FACTORS = (1597334677, 1812433253, 747796405)
SPREAD, TWIST = 0x9E3779B1, 0x2545F491


def salt(shard: int) -> int:
    return (shard + 1) * SPREAD & M31


def key_words(key: Column) -> tuple[Column, Column]:
    """Two 31-bit words of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long").bitwiseAND(F.lit(M31)) for at in (1, 9))


def _bid(a: Column, b: Column, shard: int, weight: float) -> Column:
    h = a.bitwiseXOR(F.lit(salt(shard))) * F.lit(FACTORS[0]) % F.lit(PRIMES[0])
    h = h.bitwiseXOR(b) * F.lit(FACTORS[1]) % F.lit(PRIMES[1])
    h = h.bitwiseXOR(F.lit(TWIST)) * F.lit(FACTORS[2]) % F.lit(PRIMES[0])
    return -F.ln((h.cast("double") + F.lit(0.5)) / F.lit(float(PRIMES[0]))) / F.lit(float(weight))


def placed(docs: DataFrame, weights: Sequence[float], extra: float | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with size, text_crc32, law and shard; `grown_shard` is the shard if one of weight `extra` were added, else null.

    A projection: no shuffle, no Python.
    """
    if any(w < 0 for w in [*weights, extra or 0]) or not any(w > 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary")
    a, b = key_words(F.col(f"`{id_column}`"))
    bids = {s: F.struct(_bid(F.col("__a"), F.col("__b"), s, w).alias("bid"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0}
    least = F.least(*bids.values()) if len(bids) > 1 else next(iter(bids.values()))
    grown = F.lit(None).cast("int")
    if extra is not None:
        newcomer = _bid(F.col("__a"), F.col("__b"), len(weights), extra) if extra else F.lit(float("inf"))
        grown = F.when(newcomer < F.col("__won.bid"), F.lit(len(weights))).otherwise(F.col("__won.shard"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    sized = docs.select(*kept, (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), a.alias("__a"), b.alias("__b"))
    out = sized.withColumn("__won", least)
    return out.select(*kept, "size", "text_crc32", "law", F.col("__won.shard").alias("shard"), grown.alias("grown_shard"))


def with_slots(records: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """records of placed() with `slot`, gapless from 0 in each shard.  Its columns must be comparable (no maps)."""
    names = [F.col(f"`{c}`") for c in records.columns]
    order = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in names]).cast("binary"))
    alike = checkpointed(records.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__order", order))
    rows, shards = alike.agg(F.sum("__n"), F.countDistinct("shard")).first()
    digits = 0
    while (rows or 0) > range_rows * shards * 16**digits:
        digits += 1
    alike = alike.withColumn("__range", F.substring("__order", 1, digits))
    by_range = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = alike.groupBy("shard", "__range").agg(F.sum("__n").alias("n")).select("shard", "__range", F.coalesce(F.sum("n").over(by_range), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__range").orderBy("__order", *names).rowsBetween(Window.unboundedPreceding, -1)
    out = alike.withColumn("__inner", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(before, ["shard", "__range"])
    start = F.col("__before") + F.col("__inner")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return out.select(*names, (start + F.col("__copy")).alias("slot"))


def write_shards(records: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes records with slots as Parquet, a folder a shard and a file for each rows_per_file slots, in their order."""
    part = F.floor(F.col("slot") / rows_per_file)
    shuffled = records.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "slot")
    shuffled.write.partitionBy("shard", "part").parquet(path)
