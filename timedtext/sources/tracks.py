"""What is known of a source before its files are read, in tables; fetched.py fills them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def choose_tracks(tracks: DataFrame, language: str = "en") -> DataFrame:
    """One track for each video: manual before automatic, the language itself before its variants, then the shortest code.

    tracks: video_id, code, automatic, n_tracks.  Videos without a fitting track get a NULL code.
    """
    wanted = language.casefold().replace("_", "-")
    code = F.replace(F.lower("code"), F.lit("_"), F.lit("-"))
    exact, near = code == wanted, F.split(code, "-")[0] == wanted.split("-")[0]
    fits = (F.col("n_tracks") > 0) & (exact | near)
    order = F.struct("automatic", (~exact).alias("variant"), F.length("code").alias("n"), "code")
    best = F.min(F.when(fits, order))
    return tracks.groupBy("video_id").agg(best.alias("b")).select("video_id", F.col("b.code").alias("code"), F.coalesce("b.automatic", F.lit(False)).alias("automatic"))


def choose_files(candidates: DataFrame, suffixes: list[str]) -> DataFrame:
    """For each video the first existing file with an allowed suffix: by priority, then the newest.

    candidates: video_id, priority, path, modified, existing.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    order = Window.partitionBy("video_id").orderBy("priority", F.col("modified").desc(), "path")
    return candidates.where(F.col("existing") & suffix.isin(suffixes)).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def error_text(message):
    """What is kept of a tool's message."""
    return F.left(F.trim(message), F.lit(500))


def resolve(sources: DataFrame, cue_ends: DataFrame, default_title: str = "Untitled video") -> DataFrame:
    """Title and duration of each video from what was given, fetched and probed, extended to the last cue.

    sources: video_id, given_title, fetched_title, given_duration, fetched_duration, probed_duration; cue_ends: video_id,
    last_end.  A fetched duration of 0 counts as unknown but not as missing: then the duration is extended, not inferred.
    """
    joined = sources.join(cue_ends, "video_id", "left")
    known = F.coalesce("given_duration", "fetched_duration", "probed_duration")
    duration = F.coalesce(F.when(F.col("given_duration").isNotNull(), F.col("given_duration")), F.expr("nullif(fetched_duration, 0)"), F.col("probed_duration"), F.when(known.isNotNull(), F.lit(0.0)))
    how = F.when(known.isNull(), "inferred").when(F.col("last_end") > duration, "extended").otherwise("known")
    return joined.select("video_id", F.coalesce("given_title", "fetched_title", F.lit(default_title)).alias("title"), F.greatest(F.coalesce(duration, F.lit(0.0)), F.coalesce("last_end", F.lit(0.0))).alias("duration"), how.alias("duration_from"))
