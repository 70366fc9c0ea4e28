"""Registered queries that run as streams over the given tables, and the SQL of the same rows at rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import SQL, query
from .shared import new_folder
from .sources.fixtures import table
from .streaming import online


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: those of its folder, or the one file, which a stream finds by its folder and name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as samples, whose time is what the watermark goes by: in whole seconds, so that the last one passes, too."""
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.unix_timestamp(F.min("ts")).alias("first"))
    events = stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("ordinal"), F.timestamp_seconds(F.unix_timestamp("ts")).alias("at"), "value")
    return events.join(first, "video_id").select("video_id", "ordinal", (F.unix_timestamp("at") - F.col("first")).cast("double").alias("ts"), "value", "at")


def to_end(spark: SparkSession, made: Callable[[], DataFrame], name: str) -> DataFrame:
    """Runs a stream over all that is there, and gives back what it wrote to the shared folder."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folder = spark.conf.get(key, None), new_folder(spark, name)
    spark.conf.set(key, online.STATE_STORE)
    try:
        stream = made()
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(SQL["w07_change_points"])
def tb_online_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-b: W07 on the events as a stream, put in order as the watermark passes; equals w07 at rest."""
    return to_end(spark, lambda: online.online_changes(event_stream(spark, sf_dir), 20.0, "0 seconds"), "changes")


@query(SQL["s14_interval_sample"])
def tb_online_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-b: S14 on the events as a stream; equals s14 at rest."""
    return to_end(spark, lambda: online.online_interval(event_stream(spark, sf_dir), 86_400.0, "0 seconds"), "samples")


GAP, LATE = 6 * 3600, 24 * 3600


@query(f"""WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, event_id % 7 AS words FROM events),
b AS (SELECT *, coalesce(t - lag(t) OVER w > {GAP}, true) AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM b)
SELECT user_id AS video_id, min(t) AS first, max(t) + {GAP} AS last, count(*) AS cues, CAST(sum(words) AS BIGINT) AS words FROM n GROUP BY user_id, session HAVING max(t) + {GAP} <= (SELECT max(t) FROM e) - {LATE}""")
def ta_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-a: the sessions of each user that a stream has closed when it has read all events: those that ended a day before."""
    at = F.timestamp_seconds(F.unix_timestamp("ts")).alias("at")
    made = to_end(spark, lambda: online.speech_sessions(stream_of(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), at, (F.col("event_id") % 7).alias("words")), f"{GAP} seconds", f"{LATE} seconds"), "sessions")
    return made.select("video_id", F.unix_timestamp("start").alias("first"), F.unix_timestamp("end").alias("last"), "cues", "words")
