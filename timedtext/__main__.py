"""Python -m timedtext build | demo | doctor."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .options import FORMATS, Options
from .sources.fetched import Sources, plugged, shorter

#: Flags of build beside its positional one: name, how it is read, and what it is.
FLAGS: tuple[tuple[str, dict, str], ...] = (
    ("source", {}, "a URL that the connector fetches; its files come beside those of the folder"),
    ("connector", {}, "module:factory of a connector"),
    ("frames", {}, "a Parquet table of video_id, ordinal, ts, path"),
    ("images", {}, "a folder of extracted images, in a folder of its own for each video"),
    ("logs", {}, "a folder of the extraction's logs, VIDEO.log each"),
    ("decoder", {}, "module:function from an image's bytes and a shape to an array, for others than PNG"),
    ("title", {}, "the title of all books"),
    ("pages", {"type": int}, "most pages of a book, cover and overview included"),
    ("reading-minutes", {"type": float}, "the reading time that a book is made for"),
    ("duration", {"type": float}, "seconds that each video lasts at least"),
    ("language", {}, "which captions the connector is asked for"),
    ("provider", {}, "extractive, or module:factory of a provider of summaries"),
    ("model", {}, "what the provider's factory is called with"),
    ("text-only", {"action": "store_true", "default": None}, "a provider gets no pictures"),
    ("workers", {"type": int}, "how many requests a provider gets at once, 1 to 8"),
    ("transcript-only", {"action": "store_true", "default": None}, "no video is fetched and no frame is used"),
    ("frame-interval", {"type": float}, "seconds between the images that were extracted"),
    ("threshold", {"type": float}, "the change from which an image is a new frame"),
    ("crop", {"type": lambda t: tuple(map(float, t.split(",")))}, "x,y,w,h of the images' part that was extracted, as shares"),
    ("formats", {"type": lambda t: tuple(dict.fromkeys(t.split(",")))}, f"some of {','.join(FORMATS)}"),
    ("checkpoints", {}, "a folder that keeps summaries and chosen frames between runs"),
    ("out", {}, "where the books go"),
)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="timedtext", description="Paginated reading books from timestamped captions.")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="books from all caption files under a folder")
    build.add_argument("transcripts", nargs="?")
    for name, how, what in FLAGS:
        build.add_argument(f"--{name}", help=what, **how)
    demo = commands.add_parser("demo", help="a book from a made-up source")
    demo.add_argument("--out", default="output/demo")
    commands.add_parser("doctor", help="says what is installed")
    return out


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def chosen_frames(spark: SparkSession, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """The frames of all videos, and path and content of their images."""
    from .schema import FRAMES
    from .sources import frames
    from .sources.checkpoints import Checkpoints

    if options.transcript_only or not (options.images or options.frames):
        return spark.createDataFrame([], FRAMES), None
    if options.frames:
        return spark.read.parquet(options.frames), None
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    images = frames.read_images(spark, options.images).withColumn("video_id", folder)
    logs = spark.read.text(options.logs, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("video_id"), "value")
    decode = plugged(options.decoder) if options.decoder else None
    if not options.checkpoints:
        return frames.select_frames(images, logs, decode, options.threshold), images.select("path", "content")
    kept = Checkpoints(spark, f"{options.checkpoints}/frames", frames.MANIFEST)
    return frames.cached_frames(images, logs, decode, kept, options.frame_interval, options.threshold, options.crop), images.select("path", "content")


def told(stage: str, counts: dict[str, int]) -> None:
    """A line on the error stream for each thing that is done."""
    print(f"{stage}: " + ", ".join(f"{n} {name}" for name, n in counts.items()), file=sys.stderr)


def build(spark: SparkSession, options: Options) -> dict[str, str]:
    """Reads what the options name, resolves titles and durations (P19), makes the books and writes them."""
    from .operators.summaries import RESULT_CHECKPOINT
    from .plans import book
    from .plans.planner import durations_of
    from .sinks.export import export
    from .sources import captions, tracks
    from .sources.checkpoints import Checkpoints

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{options.out}/work/{name}")
        return spark.read.parquet(f"{options.out}/work/{name}")

    fetched, folders = {}, [options.transcripts] if options.transcripts else []
    if options.source:
        spark.dataSource.register(Sources)
        asked = {"urls": json.dumps([options.source]), "connector": options.connector, "folder": f"{options.out}/sources", "language": options.language, "video": str(not options.transcript_only).lower()}
        fetched = keep(spark.read.format(Sources.name()).options(**asked).load(), "fetched").first().asDict()
        for warning in fetched["warnings"]:
            print(f"note: {warning}", file=sys.stderr)
        if fetched["error"] or not fetched["transcript_path"]:
            raise ValueError(fetched["error"] or f"{options.source} gave no captions")
        folders.append(fetched["transcript_path"])
    files = spark.read.text(folders, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    cues = keep(captions.load_transcripts(files, stem(F.col("path"))), "cues")
    frames, images = chosen_frames(spark, options)
    frames = keep(frames, "frames")
    ends = durations_of(cues).withColumnRenamed("duration", "last_end")
    own = F.col("video_id") == stem(F.lit(fetched.get("transcript_path") or ""))
    of = lambda value, kind: F.lit(value).cast(kind)
    sources = ends.select(
        "video_id", F.coalesce(of(options.title, "string"), F.when(~own, F.col("video_id"))).alias("given_title"), F.when(own, of(fetched.get("title"), "string")).alias("fetched_title"),
        of(options.duration, "double").alias("given_duration"), F.when(own, of(fetched.get("duration"), "double")).alias("fetched_duration"), F.when(own, of(fetched.get("probed_duration"), "double")).alias("probed_duration"),
    )
    cut = sources.where(shorter(F.col("given_duration"), F.col("probed_duration")))
    book.refuse(cut.select("video_id", F.lit("the given duration is shorter than the video").alias("error")), "duration")
    known = keep(tracks.resolve(sources, ends), "sources")
    link = F.when(own, F.coalesce(of(fetched.get("source_url") or options.source, "string"), F.col("video_id"))).otherwise(F.col("video_id"))
    provider = None if options.provider == "extractive" else plugged(options.provider)(options.model)
    kept = Checkpoints(spark, f"{options.checkpoints}/summaries", RESULT_CHECKPOINT) if options.checkpoints else None
    pages, videos = book.build(cues, frames, known.select("video_id", "title", link.alias("source_url")), options.pages, options.reading_minutes, known.select("video_id", "duration"), provider, kept, options.workers, keep=keep, report=told, images=None if options.text_only else images)
    videos = book.with_source_warnings(videos, known, sampled=bool(options.images))
    return export(pages, videos, options.out, options.formats, images=images, report=told)


def demo(spark: SparkSession, out: str) -> dict[str, str]:
    from .plans import book
    from .sinks.export import export
    from .sources import fixtures

    titles = spark.createDataFrame([("demo", "A short course", "")], "video_id string, title string, source_url string")
    pages, videos = book.build(fixtures.demo_cues(spark), fixtures.demo_frames(spark), titles, 10, 5.0)
    return export(pages, videos, out)


def run(arguments: list[str] | None = None) -> int:
    args = vars(parser().parse_args(arguments))
    command = args.pop("command")
    if command == "doctor":
        import importlib.util as u

        print("\n".join(f"{name}: {'yes' if u.find_spec(name) else 'no'}" for name in ("pyspark", "pandas", "pyarrow", "PIL", "pptx", "reportlab")))
        return 0
    options = None if command == "demo" else dataclasses.replace(Options(), **{k: v for k, v in args.items() if v is not None}).check()
    spark = SparkSession.builder.appName("timedtext").getOrCreate()
    for name, path in (demo(spark, args["out"]) if options is None else build(spark, options)).items():
        print(f"{name}: {path}")
    return 0


def main() -> int:
    try:
        return run()
    except KeyboardInterrupt:
        return 130
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
