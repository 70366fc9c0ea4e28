"""Registered queries of fetching and probing, over sources and files that Spark makes from the given tables."""

from __future__ import annotations

from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import query
from .shared import new_folder
from .sources import fetched
from .sources.fixtures import table


class Told:
    """A connector whose URLs tell what a source has and which attempts fail: nothing is read or written."""

    def metadata(self, url: str) -> dict:
        said = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if said.get("fails") == "metadata":
            raise OSError("  gone  ")
        tracks = {name: {code: [url] for code in said.get(key, "").split(",") if code} for name, key in (("subtitles", "made"), ("automatic_captions", "automatic"))}
        return {"entries": []} if said.get("fails") == "single" else tracks | {"id": url, "title": said["title"], "duration": said.get("duration")}

    def captions(self, url: str, code: str, automatic: bool, folder: str) -> str | None:
        if "fails=captions" in url:
            raise ValueError("x" * 600)
        return None if "fails=saving" in url else f"{code}.vtt"

    def video(self, url: str, folder: str) -> str | None:
        if "fails=video" in url:
            raise OSError("no room")
        return None if "fails=saving" in url else "video.mp4"

    def duration(self, path: str) -> float:
        return 60.5


MADE = "CASE d.doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en-GB,en_US,de' WHEN 2 THEN 'de' ELSE '' END"
AUTO = "CASE d.doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'en-orig' ELSE '' END"
FAILS = "CASE d.doc_id % 7 WHEN 1 THEN 'metadata' WHEN 2 THEN 'single' WHEN 3 THEN 'captions' WHEN 4 THEN 'saving' WHEN 5 THEN 'video' ELSE '' END"
SECONDS = "CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '-3' ELSE CAST(d.doc_id AS VARCHAR) END"


@query(f"""WITH d AS (SELECT doc_id, {MADE} AS made, {AUTO} AS auto, {FAILS} AS fails, {SECONDS} AS seconds FROM documents d),
t AS (SELECT *, CASE made WHEN 'en' THEN 'en' WHEN 'en-GB,en_US,de' THEN 'en-GB' WHEN 'de' THEN nullif(auto, '') ELSE nullif(auto, '') END AS code, made NOT LIKE 'en%' AND auto <> '' AS machine FROM d),
w AS (SELECT *, fails IN ('metadata', 'single') AS bad FROM t)
SELECT 'talk://' || doc_id AS source, CASE WHEN NOT bad THEN 'T' || doc_id END AS title, CASE WHEN NOT bad THEN CASE WHEN doc_id % 4 = 3 THEN CAST(doc_id AS DOUBLE) ELSE 0.0 END END AS duration,
  CASE WHEN NOT bad AND fails NOT IN ('video', 'saving') THEN CAST(60.5 AS DOUBLE) END AS probed_duration, CASE WHEN NOT bad AND fails NOT IN ('captions', 'saving') THEN code || '.vtt' END AS transcript_path, coalesce(NOT bad AND machine, false) AS automatic,
  array_to_string([x FOR x IN [CASE WHEN NOT bad AND doc_id % 4 <> 3 THEN 'the source tells no duration; the video or the captions will' END, CASE WHEN NOT bad AND code IS NULL THEN 'the source has no captions in en' END,
    CASE WHEN NOT bad AND machine THEN 'the captions were made by a machine and may hold its errors' END, CASE WHEN code IS NOT NULL AND fails = 'captions' THEN 'captions could not be fetched: ' || repeat('x', 500) END,
    CASE WHEN code IS NOT NULL AND fails = 'saving' THEN 'captions were listed, but none were saved' END, CASE WHEN fails = 'saving' THEN 'no usable video was saved' END, CASE WHEN fails = 'video' THEN 'video could not be fetched: no room' END,
    CASE fails WHEN 'metadata' THEN 'metadata could not be fetched: gone' WHEN 'single' THEN 'the address must name one video, not a list' END] IF x IS NOT NULL], ' | ') AS told FROM w""")
def s09_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each document, fetched by three attempts, with its warnings."""
    value = lambda name, sql: F.concat(F.lit(f"&{name}="), F.expr(sql.replace("VARCHAR", "STRING")))
    url = F.concat(F.lit("talk://"), F.col("doc_id").cast("string"), F.lit("?title=T"), F.col("doc_id").cast("string"), *[value(*x) for x in (("made", MADE), ("automatic", AUTO), ("fails", FAILS), ("duration", SECONDS))])
    made = fetched.fetch(table(spark, sf_dir, "documents").alias("d").select(url.alias("url")), Told(), new_folder(spark, "sources"))
    told = fetched.source_warnings(made).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("position", "message"))).alias("w"))
    joined = made.drop("warnings", "error", "source_url", "video_path").join(told, "url", "left")
    return joined.select(F.substring_index("url", "?", 1).alias("source"), "title", "duration", "probed_duration", "transcript_path", "automatic", F.coalesce(F.array_join(F.transform("w", lambda x: x.message), " | "), F.lit("")).alias("told"))


@query("""SELECT event_id, CASE WHEN event_id % 6 < 4 THEN (event_id % 1000 + 1) * CAST(user_id + 1 AS DOUBLE) / (user_id % 90 + 10) END AS duration,
  CASE event_id % 6 WHEN 4 THEN 'there is no whole moov box' WHEN 5 THEN 'the movie header has no duration' END AS error FROM events""")
def s08_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duration of an MP4 file made of each event: headers of both widths, before or after the media."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).alias("kind"), (F.col("user_id") % 90 + 10).alias("scale"), ((F.col("event_id") % 1000 + 1) * (F.col("user_id") + 1)).alias("length"))
    number = lambda c, octets: F.lpad(F.hex(c), 2 * octets, "0")
    box = lambda name, body: F.concat(number((F.length(body) / 2 + 8).cast("long"), 4), F.hex(F.lit(name)), body)
    wide = F.col("kind") % 2 == 1
    length = F.when(F.col("kind") == 5, F.lit(0).cast("long")).otherwise(F.col("length"))
    narrow_header = F.concat(F.repeat(F.lit("0"), 24), number(F.col("scale"), 4), number(length, 4), F.repeat(F.lit("0"), 160))
    wide_header = F.concat(F.lit("01"), F.repeat(F.lit("0"), 38), number(F.col("scale"), 4), number(length, 8), F.repeat(F.lit("0"), 160))
    movie = box("moov", F.concat(box("free", F.lit("00")), box("mvhd", F.when(wide, wide_header).otherwise(narrow_header))))
    body = F.repeat(F.lit("AB"), (F.col("event_id") % 50).cast("int"))
    media = F.when(F.col("kind") < 2, box("mdat", body)).otherwise(F.concat(F.lit("00000001"), F.hex(F.lit("mdat")), number((F.length(body) / 2 + 16).cast("long"), 8), body))
    file = F.concat(box("ftyp", F.hex(F.lit("isom"))), F.when(F.col("kind") == 2, F.concat(movie, media)).when(F.col("kind") == 4, F.concat(media, F.substring(movie, 1, 60))).otherwise(F.concat(media, movie)))
    found = e.select("event_id", fetched.probed(F.unhex(file)).alias("p"))
    return found.select("event_id", "p.duration", "p.error")
