"""S21 and the relations that the queries derive from general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, count_words
from ..schema import CUES, FRAMES

#: A short course: eight steps of an agent, each shown for STEP seconds.
LESSONS = ("Set a goal.", "Gather what is known.", "Choose a plan.", "Take one step.", "Check the result.", "Keep what works.", "Change what does not.", "Stop when the goal is met.")
STEP = 12.0


def demo_cues(spark: SparkSession, video_id: str = "demo", repeat: int = 10) -> DataFrame:
    rows = [(video_id, i, i * STEP, i * STEP + STEP - 0.5, " ".join([line] * repeat)) for i, line in enumerate(LESSONS)]
    return spark.createDataFrame(rows, CUES)


def demo_frames(spark: SparkSession, video_id: str = "demo") -> DataFrame:
    return spark.createDataFrame([(video_id, i, i * STEP, f"slide-{i:02}.png") for i in range(len(LESSONS))], FRAMES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues that follow each other, half a second a word."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("ordinal"), collapse(F.col("text")).alias("text"))
    words = F.greatest(F.lit(1), count_words(F.col("text")))
    before = F.coalesce(F.sum(words).over(Window.partitionBy("video_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.select("video_id", "ordinal", (before * 0.5).alias("start"), ((before + words) * 0.5).alias("end"), "text")


def rolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as rolling captions: eight words, of which four are the last cue's."""
    return rolling(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text"))


def rolling(texts: DataFrame) -> DataFrame:
    words = F.filter(F.split(collapse(F.col("text")), " "), lambda w: w != "")
    docs = texts.select("video_id", words.alias("words")).where(F.size("words") > 0)
    at = F.posexplode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 4).cast("int")))
    return docs.select("video_id", "words", at.alias("ordinal", "i")).select(
        "video_id", "ordinal", F.col("i").cast("double").alias("start"), (F.col("i") + 1.5).cast("double").alias("end"), F.array_join(F.slice("words", F.col("i") * 4 + 1, F.lit(8)), " ").alias("text")
    )


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as samples of one feature: seconds since the first."""
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ordinal"), (F.unix_timestamp("ts") - F.unix_timestamp(first)).cast("double").alias("ts"), "value")


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame at each cue's middle, in which every third is left out."""
    cues = conversation_cues(spark, sf_dir).where(F.col("ordinal") % 3 != 1)
    return cues.select("video_id", "ordinal", ((F.col("start") + F.col("end")) / 2).alias("ts"), F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("path"))
