"""Frames from a folder of extracted images and a log with their times.

Extraction itself is a media tool's work (ffmpeg); its command is built here, its output is read here.  PNG images are decoded by
pixels.py; for other kinds a caller supplies a function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pixels
from .checkpoints import Checkpoints, key_of

INTERVAL, THRESHOLD = 12.0, 0.12
SHOWN_TIME = r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"


def option_errors(interval: float = INTERVAL, threshold: float = THRESHOLD, crop: tuple[float, float, float, float] | None = None, slack: float = 1e-9) -> list[str]:
    """All that is wrong with the options of a frame source.  A crop's far edges may pass the image's by slack, as sums round."""
    found = {
        "the threshold must be a share, from 0 to 1": 0 <= threshold <= 1,
        "the interval must be a positive, finite number of seconds": 0 < interval < math.inf,
    }
    if crop is not None:
        left, top, width, height = crop
        edges = (left, top, left + width, top + height)
        found["the crop must cover a part of the image"] = width > 0 and height > 0 and all(0 <= e <= 1 + slack for e in edges)
    return [message for message, holds in found.items() if not holds]


def check_options(*options, **named) -> None:
    wrong = option_errors(*options, **named)
    if wrong:
        raise ValueError("; ".join(wrong))


def sampling_filter(interval: float = INTERVAL, crop: tuple[float, float, float, float] | None = None) -> str:
    """S14, S15 as the media tool's filter: the first frame, then each one interval after the last that was taken.

    The filters' names and arguments are fixed values: the tool's own syntax.
    """
    check_options(interval, THRESHOLD, crop)
    parts = [f"select='isnan(prev_selected_t)+gte(t-prev_selected_t\\,{interval:.10g})'"]
    if crop:
        x, y, w, h = crop
        parts.append(f"crop=iw*{w:.10g}:ih*{h:.10g}:iw*{x:.10g}:ih*{y:.10g}")
    return ",".join([*parts, "showinfo"])


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, length and content of the image files under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def shown_times(logs: DataFrame) -> DataFrame:
    """Logs (video_id, value) to video_id, ordinal and ts, in the order of the log."""
    found = F.regexp_extract_all("value", F.lit(SHOWN_TIME), F.lit(1))
    return logs.select("video_id", F.posexplode(found).alias("ordinal", "ts")).withColumn("ts", F.col("ts").cast("double"))


def zip_times(images: DataFrame, times: DataFrame) -> DataFrame:
    """The n-th image by path belongs to the n-th time; raises if a video has more of one than of the other."""
    at = F.row_number().over(Window.partitionBy("video_id").orderBy("path")) - 1
    joined = images.withColumn("ordinal", at).join(times.withColumnRenamed("ts", "shown"), ["video_id", "ordinal"], "full")
    odd = F.col("path").isNull() | F.col("shown").isNull()
    ts = F.when(odd, F.raise_error(F.concat(F.lit("images and times differ in number: "), "video_id"))).otherwise(F.col("shown"))
    return joined.select("video_id", "ordinal", ts.alias("ts"), "path")


def image_differences(before, after):
    """image_difference() of each pair of images in two stacks of one shape."""
    import numpy as np

    a, b = (np.asarray(x, float) for x in (before, after))
    edges = [np.abs(np.diff(x.mean(axis=-1) if x.ndim == 4 else x, axis=2)) for x in (a, b)]
    mean = lambda x: x.reshape(len(x), -1).mean(axis=1)
    outline = mean(np.abs(edges[0] - edges[1])) / np.maximum(8.0, np.maximum(mean(edges[0]), mean(edges[1])))
    return np.maximum(mean(np.abs(a - b)) / 255, np.minimum(1.0, outline))


def image_difference(before, after) -> float:
    """F20 on arrays of one shape, channels last, 0 to 255: the larger of the mean change and the relative change of edges."""
    return float(image_differences([before], [after])[0])


def fits_layout(size: Column, means: Column, shape: tuple[int, int], bounds: list[tuple[float, float]]) -> Column:
    """Does an image have a layout: its size (width, height as an array) and the mean of each region within bounds?"""
    fits = (size[0] == shape[0]) & (size[1] == shape[1])
    for i, (least, most) in enumerate(bounds):
        fits = fits & means[i].between(least, most)
    return F.coalesce(fits, F.lit(False))


#: The raster on which images are compared.
RASTER = (144, 256, 3)
CHOSEN = "ordinal int, ts double, path string"


def select_frames(images: DataFrame, logs: DataFrame, decode: Callable[[bytes, tuple[int, int, int]], object] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Images (video_id, path, content) and logs (video_id, value) to the frames that show something new: video_id, ordinal, ts,
    path.  decode(content, shape) gives an image as an array, by default from PNG; of a video's images three are held at once."""
    check_options(threshold=threshold)
    decode = decode or pixels.decode
    timed = zip_times(images.select("video_id", "path"), shown_times(logs)).join(images.select("video_id", "path", "content"), ["video_id", "path"])
    kind = images.schema["video_id"].dataType.simpleString()

    def choose(group):
        group, kept, before, anchor = group.sort_values(["ts", "ordinal"], kind="stable"), [], None, None
        for content in group["content"]:
            now = decode(content, RASTER)
            kept.append(anchor is None or image_difference(before, now) > threshold or image_difference(anchor, now) > threshold)
            before, anchor = now, now if kept[-1] else anchor
        return group[kept][["video_id", "ordinal", "ts", "path"]]

    return timed.groupBy("video_id").applyInPandas(choose, f"video_id {kind}, {CHOSEN}")


def cached_frames(images: DataFrame, logs: DataFrame, decode: Callable | None, manifests: Checkpoints, interval: float = INTERVAL, threshold: float = THRESHOLD, crop=None) -> DataFrame:
    """As select_frames, but for videos whose manifest is kept: same files and options, not empty, and all its files are
    still there.  images also have length and modified; manifests: a table of results (MANIFEST)."""
    own = images.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("path", "length", "modified"))).alias("files"))
    keyed = own.select("video_id", "files", key_of(F.col("files"), F.lit(repr((interval, threshold, crop))).alias("options"), length=20).alias("key"))
    paths = F.transform("files", lambda f: f.path)
    usable = (F.size("frames") > 0) & (F.size(F.array_except(F.transform("frames", lambda f: f.path), paths)) == 0)
    lacking = keyed.join(manifests.found(keyed).where(usable).select("key"), "key", "left_anti").select("video_id", "key")
    fresh = select_frames(images.join(lacking.select("video_id"), "video_id", "left_semi"), logs.join(lacking.select("video_id"), "video_id", "left_semi"), decode, threshold)
    frames = F.array_sort(F.collect_list(F.struct("ordinal", "ts", "path"))).alias("frames")
    manifests.add(fresh.join(lacking, "video_id").groupBy("key").agg(frames))
    return manifests.found(keyed).where(usable).select("video_id", F.inline("frames"))


MANIFEST = "frames array<struct<ordinal:int,ts:double,path:string>>"
