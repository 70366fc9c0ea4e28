"""Sources that are fetched and probed on the executors, as a table or as a Spark data source.

A source is fetched in three attempts that do not depend on each other: what is known of it, its captions, its video.  Without
the first there is a row with an error; what the others lack becomes a warning.  Nothing here needs a network: a Connector
does, and Folder is one for folders.  Durations are read from the boxes of MP4 and MOV files.
"""

from __future__ import annotations

import hashlib
import importlib
import io
import json
import math
import os
import shutil
from collections.abc import Iterator
from typing import BinaryIO, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FETCHED = "url string, title string, source_url string, duration double, probed_duration double, transcript_path string, automatic boolean, video_path string, warnings array<string>, error string"
CAPTIONS, VIDEOS = (".vtt", ".srt", ".json"), (".mp4", ".mov", ".m4v", ".webm", ".mkv")


class Connector(Protocol):
    """What a fetcher does; all of it may raise.

    metadata: id, title, source_url, duration, and subtitles and automatic_captions, each a list of tracks by language code;
    or `entries`, if the URL names several videos.  captions and video: the path of what was saved in the folder, or None.
    """

    def metadata(self, url: str) -> dict: ...

    def captions(self, url: str, code: str, automatic: bool, folder: str) -> str | None: ...

    def video(self, url: str, folder: str) -> str | None: ...


class Folder:
    """A connector for folders: info.json, captions/CODE.vtt or .srt, automatic/CODE.vtt or .srt, and video.mp4 or the like."""

    def _root(self, url: str) -> str:
        return url.removeprefix("file://")

    def _files(self, url: str, kind: str) -> dict[str, str]:
        at = os.path.join(self._root(url), kind)
        return {os.path.splitext(n)[0]: os.path.join(at, n) for n in sorted(os.listdir(at)) if n.endswith(CAPTIONS)} if os.path.isdir(at) else {}

    def metadata(self, url: str) -> dict:
        with open(os.path.join(self._root(url), "info.json")) as f:
            info = json.load(f)
        tracks = {name: {code: [path] for code, path in self._files(url, kind).items()} for name, kind in (("subtitles", "captions"), ("automatic_captions", "automatic"))}
        return info if "entries" in info else tracks | info

    def _copied(self, path: str, folder: str) -> str:
        os.makedirs(folder, exist_ok=True)
        return shutil.copy(path, folder)

    def captions(self, url: str, code: str, automatic: bool, folder: str) -> str | None:
        path = self._files(url, "automatic" if automatic else "captions").get(code)
        return path and self._copied(path, folder)

    def video(self, url: str, folder: str) -> str | None:
        found = [n for n in sorted(os.listdir(self._root(url))) if n.startswith("video.") and n.endswith(VIDEOS)]
        return self._copied(os.path.join(self._root(url), found[0]), folder) if found else None


def best_track(info: dict, language: str) -> tuple[str | None, bool]:
    """S10 for one source: by made or automatic, the language itself or a variant, then the shortest code."""
    plain = lambda code: code.casefold().replace("_", "-")
    wanted = plain(language)
    near = [
        (automatic, plain(code) != wanted, len(code), code)
        for automatic, name in ((False, "subtitles"), (True, "automatic_captions"))
        for code, tracks in (info.get(name) or {}).items()
        if tracks and (plain(code) == wanted or plain(code).split("-")[0] == wanted.split("-")[0])
    ]
    return (min(near)[3], min(near)[0]) if near else (None, False)


def box_duration(file: BinaryIO) -> float:
    """Seconds of an MP4 or MOV file, from the movie header among its boxes; the media itself is passed over.

    A box is its length (32 bits, or 1 and 64 bits after the name, or 0 for the rest of the file), a name, and content."""
    end = file.seek(0, io.SEEK_END)

    def inside(at: int, upto: int, wanted: bytes) -> tuple[int, int]:
        while at + 8 <= upto:
            file.seek(at)
            length, name, start = int.from_bytes(file.read(4)), file.read(4), at + 8
            if length == 1:
                length, start = int.from_bytes(file.read(8)), at + 16
            stop = upto if length == 0 else at + length
            if stop < start or stop > upto:
                break
            if name == wanted:
                return start, stop
            at = stop
        raise ValueError(f"there is no whole {wanted.decode()} box")

    start, stop = inside(*inside(0, end, b"moov"), b"mvhd")
    file.seek(start)
    header = file.read(min(stop - start, 32))
    wide = header[:1] == b"\x01"
    if len(header) < (32 if wide else 20):
        raise ValueError("the movie header is cut off")
    scale, length = (header[20:24], header[24:32]) if wide else (header[12:16], header[16:20])
    if not any(scale) or not any(length) or set(length) == {255}:
        raise ValueError("the movie header has no duration")
    return int.from_bytes(length) / int.from_bytes(scale)


def probe(path: str) -> float:
    with open(path.removeprefix("file://"), "rb") as f:
        return box_duration(f)


def probed(content: Column) -> Column:
    """S08 as a column function: the duration of a file's content, or why there is none."""

    def one(body):
        try:
            return (None, None) if body is None else (box_duration(io.BytesIO(body)), None)
        except ValueError as e:
            return None, str(e)

    @F.pandas_udf("struct<duration: double, error: string>")
    def each(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in bodies], columns=["duration", "error"]).astype({"duration": "float64", "error": object})

    return each(content)


def said(what: str, e: Exception) -> str:
    """The part that failed and the first 500 characters of what it said."""
    return f"{what} could not be fetched: {str(e).strip()[:500]}"


def attempts(connector: Connector, url: str, folder: str, language: str = "en", video: bool = True) -> dict:
    """A row of FETCHED.  Files go to a folder of the source's own, so that no other source's files are taken for them."""
    row = dict.fromkeys(f.split()[0] for f in FETCHED.split(", ")) | {"url": url, "warnings": [], "automatic": False}
    try:
        info = connector.metadata(url)
    except Exception as e:  # whatever a fetcher raises is the source's error, not the job's
        return row | {"error": said("metadata", e)}
    if not isinstance(info, dict) or "entries" in info:
        return row | {"error": "the address must name one video, not a list"}
    warnings = row["warnings"]
    try:
        seconds = float(info.get("duration") or 0)
    except (TypeError, ValueError):
        seconds = 0.0
    if not 0 < seconds < math.inf:
        seconds = 0.0
        warnings.append("the source tells no duration; the video or the captions will")
    own = os.path.join(folder.removeprefix("file://"), hashlib.sha256(str(info.get("id") or info.get("source_url") or url).encode()).hexdigest()[:16])
    row |= {"title": info.get("title"), "source_url": info.get("source_url") or url, "duration": seconds}
    code, row["automatic"] = best_track(info, language)
    if code is None:
        warnings.append(f"the source has no captions in {language}")
    else:
        if row["automatic"]:
            warnings.append("the captions were made by a machine and may hold its errors")
        try:
            row["transcript_path"] = connector.captions(url, code, row["automatic"], own)
            if row["transcript_path"] is None:
                warnings.append("captions were listed, but none were saved")
        except Exception as e:
            warnings.append(said("captions", e))
    if video:
        try:
            row["video_path"] = connector.video(url, own)
            if row["video_path"] is None:
                warnings.append("no usable video was saved")
        except Exception as e:
            warnings.append(said("video", e))
    if row["video_path"]:
        try:
            row["probed_duration"] = (getattr(connector, "duration", None) or probe)(row["video_path"])
        except Exception as e:
            warnings.append(f"the video's duration is unknown: {str(e).strip()[:500]}")
    return row


def plugged(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fetch(sources: DataFrame, connector: Connector, folder: str, language: str = "en", video: bool = True, workers: int | None = None) -> DataFrame:
    """S09 for a table of sources (url): a row of FETCHED each.  workers: how many fetch at once."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FETCHED.split(", ")]
        for batch in batches:
            yield pd.DataFrame([attempts(connector, url, folder, language, video) for url in batch["url"]], columns=names)

    urls = sources.select("url")
    return (urls.repartition(workers) if workers else urls).mapInPandas(task, FETCHED)


def source_warnings(fetched: DataFrame) -> DataFrame:
    """Warnings and errors as rows: url, position, level and message."""
    every = F.concat(F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("level"), w.alias("message"))), F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("error").alias("level"), F.col("error").alias("message")))).otherwise(F.array()))
    return fetched.select("url", F.posexplode(every).alias("position", "w")).select("url", "position", "w.level", "w.message")


def shorter(given: Column, probed_duration: Column, slack: float = 0.1) -> Column:
    """Whether a given duration would cut off the end of the video."""
    return given < probed_duration - slack


class _OneSource(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.urls = json.loads(options.get("urls", "[]"))
        if not self.urls or not options.get("connector") or not options.get("folder"):
            raise ValueError("urls (a JSON list), connector (module:factory) and folder must be given")

    def partitions(self) -> list[InputPartition]:
        return [_OneSource(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        row = attempts(plugged(o["connector"])(), partition.value, o["folder"], o.get("language", "en"), o.get("video", "true") == "true")
        yield tuple(row[f.split()[0]] for f in FETCHED.split(", "))


class Sources(DataSource):
    """spark.dataSource.register(Sources), then spark.read.format("timedtext_sources") with options urls, connector, folder,
    language and video: a partition, so a task with its own retries, for each source of a list that a caller gives."""

    @classmethod
    def name(cls) -> str:
        return "timedtext_sources"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
