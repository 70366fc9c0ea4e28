"""Removal of the repeated context of rolling captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, word_key

TOLERANCE = 0.1


def _keys(text: Column, exact: bool) -> Column:
    """The word keys of a text.  The exact case fold runs once over the whole text, before the split."""
    folded = casefold(text, exact) if exact else text
    return F.transform(F.split(folded, " "), lambda w: word_key(w))


def overlap_length(left: list, right: list) -> int:
    """The greatest n for which left's last n entries are right's first n, in time linear in the shorter of them.

    border[i] is how many of right's first entries also end the stretch of its first i; after a mismatch the match goes on from
    there, so no entry is compared anew from the start."""
    most = min(len(left), len(right))
    if not most or right[0] not in left[-most:]:
        return 0
    border = [0] * (most + 1)
    k = 0
    for i in range(1, most):
        while k and right[i] != right[k]:
            k = border[k]
        k += right[i] == right[k]
        border[i + 1] = k
    n = 0
    for entry in left[-most:]:
        while n and (n == most or entry != right[n]):
            n = border[n]
        n += entry == right[n]
    return n


def overlap(left: Column, right: Column) -> Column:
    """the greatest n for which left's last n entries are right's first n; 0 if there is none or one is null."""

    @F.pandas_udf("int")
    def lengths(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([0 if a is None or b is None else overlap_length(list(a), list(b)) for a, b in zip(lefts, rights)], dtype="int32")

    return lengths(left, right)


def deduplicate_rolling(cues: DataFrame, tolerance: float = TOLERANCE, exact: bool = False) -> DataFrame:
    """Each cue without the words that it repeats of the one before.

    Only the longest overlap with the original cue before counts, and only if it has two words or is the whole cue.  A cue
    that is a repeat as a whole goes, and the last cue that stays lasts until its end.
    """
    order = Window.partitionBy("video_id").orderBy("start", "end", "ordinal")
    # Only texts are shuffled and sorted; the keys of both are made where they lie.
    near = cues.withColumn("_before", F.when(F.col("start") <= F.lag("end").over(order) + tolerance, F.lag("text").over(order)))
    found = near.withColumn("_n", overlap(_keys(F.col("_before"), exact), _keys(F.col("text"), exact)))
    words = F.size(F.split("text", " "))
    cut = F.when((F.col("_n") >= 2) | (F.col("_n") == words), F.col("_n")).otherwise(F.lit(0))
    island = found.drop("_before").withColumn("_cut", cut).withColumn("_stays", F.col("_cut") < words).withColumn("_island", F.sum(F.col("_stays").cast("int")).over(order))
    last = F.max("end").over(Window.partitionBy("video_id", "_island"))
    out = island.withColumn("_last", last).where("_stays")
    text = F.array_join(F.slice(F.split("text", " "), F.col("_cut") + 1, F.greatest(words, F.lit(1))), " ")
    return out.select("video_id", "ordinal", "start", F.col("_last").alias("end"), text.alias("text"))
