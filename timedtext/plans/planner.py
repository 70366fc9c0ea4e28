"""Cuts of a timeline into pages of about equal reading, video by video.

The relational parts around it (groups, prefix sums, page numbers, texts, frames) are DataFrame operators.  The choice of a
cut depends on the cut before, so it runs as an Arrow function over the numbers of videos in order; it never sees a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.timeline import MIN_SOURCE_WORDS, TIME_WEIGHT, WORD_WEIGHT, extents, page_frames, page_of_cue, start_groups, stamped_text

#: How far a cut may lie from its ideal place (in pages), what a slide change close by is worth, and how close.
REACH, BONUS, CLOSE = 0.7, 0.24, 5.0
CUTS = "video_id {}, number int, start double, end double, first_start double"


class Timeline:
    """A video's groups in order: start, latest end and words of each, with the sums before them."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, changes: np.ndarray, duration: float):
        self.starts, self.changes, self.duration = starts, np.sort(changes), duration
        self.words = np.concatenate([[0], np.cumsum(words)])
        self.nonempty = np.concatenate([[0], np.cumsum(words > 0)])
        self.quiet_from = np.minimum(np.concatenate([[0.0], np.maximum.accumulate(ends)])[:-1], starts)
        middles = (self.quiet_from + starts) / 2
        middles[0] = 0.0
        self.middles = np.append(middles, duration)
        self.masses = self.mass(np.arange(len(starts) + 1), self.middles)

    def mass(self, index, time):
        return WORD_WEIGHT * self.words[index] / self.words[-1] + TIME_WEIGHT * time / self.duration

    def distance(self, times: np.ndarray) -> np.ndarray:
        """How far each time is from the nearest slide change."""
        if not len(self.changes):
            return np.full(len(times), np.inf)
        at = np.searchsorted(self.changes, times)
        left, right = self.changes[np.maximum(at - 1, 0)], self.changes[np.minimum(at, len(self.changes) - 1)]
        return np.minimum(np.abs(times - left), np.abs(times - right))

    def options(self, indexes: np.ndarray, ideal: float) -> tuple[np.ndarray, np.ndarray]:
        """Where each group may be cut off from the one before: in the middle of the silence, at its own start, and (J04) at
        the slide changes in the silence that lie next to the time which would make the parts even."""
        at, times = [indexes, indexes], [self.middles[indexes], self.starts[indexes]]
        silent = indexes[self.quiet_from[indexes] < self.starts[indexes]]
        if len(self.changes) and len(silent):
            even = (ideal - WORD_WEIGHT * self.words[silent] / self.words[-1]) * self.duration / TIME_WEIGHT
            lo = np.searchsorted(self.changes, self.quiet_from[silent], "left")
            hi = np.searchsorted(self.changes, self.starts[silent], "right")
            middle = np.clip(np.searchsorted(self.changes, even, "left"), lo, hi)
            for near in (middle - 1, middle):
                inside = (near >= lo) & (near < hi)
                at.append(silent[inside])
                times.append(self.changes[near[inside]])
        return np.concatenate(at), np.concatenate(times)

    def pages(self, target: int) -> int:
        """A05."""
        return min(target, max(1, int(self.words[-1]) // MIN_SOURCE_WORDS), int(self.nonempty[-1]))

    def best(self, indexes: np.ndarray, ideal: float, pages: int, after: float) -> tuple[int, float] | None:
        """The option among these groups whose mass is nearest to the ideal, a slide change close by counting in its favour."""
        at, times = self.options(indexes, ideal)
        open_ = np.flatnonzero((times > after) & (times < self.duration))
        if not len(open_):
            return None
        at, times = at[open_], times[open_]
        cost = ((self.mass(at, times) - ideal) * pages) ** 2 - BONUS * np.clip(1.0 - self.distance(times) / CLOSE, 0.0, None)
        first = np.lexsort((times, at, cost))[0]
        return int(at[first]), float(times[first])

    def cuts(self, target: int) -> tuple[list[int], list[float]]:
        """The first group and the start time of each page.

        Where a cut may lie is known for all pages beforehand, but for one thing: how far the cut before it has come.
        """
        pages = self.pages(target)
        ideals = np.arange(1, pages) / pages
        # The last group that leaves one with words for each page to come, and the groups within reach of the ideal.
        latest = np.minimum(np.searchsorted(self.nonempty, self.nonempty[-1] - pages + np.arange(1, pages), "right"), len(self.starts)) - 1
        nearest = np.searchsorted(self.masses, ideals)
        reach = np.stack([np.searchsorted(self.masses, ideals - REACH / pages), np.searchsorted(self.masses, ideals + REACH / pages, "right") - 1])
        index, start = [0], [0.0]
        for ideal, last, near, (lo, hi) in zip(ideals.tolist(), latest.tolist(), nearest.tolist(), reach.T.tolist()):
            earliest = int(np.searchsorted(self.nonempty, self.nonempty[index[-1]], "right"))  # one group with words is behind it
            window = range(max(earliest, lo), min(last, hi) + 1)
            if not window:  # the groups next to the ideal, as far as they may be had
                centre = min(max(near, earliest), max(last, earliest))
                window = range(max(earliest, centre - 1), min(last, centre + 1) + 1)
            cut = self.best(np.array(window, np.int64), ideal, pages, start[-1]) or (earliest, float(self.starts[earliest]))
            index.append(cut[0])
            start.append(cut[1])
        return index, start


def plan_cuts(cues: DataFrame, frames: DataFrame, durations: DataFrame, target: int) -> DataFrame:
    """The pages' numbers (from 3), times, and the start of the first group of each.  Videos without words have none."""
    groups = start_groups(cues).select("video_id", F.lit(0).alias("kind"), F.col("start").alias("t"), "end", "words")
    changes = frames.select("video_id", F.lit(1).alias("kind"), F.col("ts").alias("t"), F.lit(None).cast("double").alias("end"), F.lit(0).alias("words"))
    rows = groups.unionByName(changes).join(durations.select("video_id", "duration"), "video_id")

    def planned(table: pa.Table) -> pa.RecordBatch:
        """The cuts of whole videos, each of whose groups and then changes follow each other by time."""
        ids = table.column("video_id").combine_chunks()
        kind, t, ends, words, lengths = (table.column(c).to_numpy() for c in ("kind", "t", "end", "words", "duration"))
        new = np.flatnonzero(np.r_[True, np.asarray(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False), bool)])
        groups = np.r_[0, np.cumsum(kind == 0)]
        at, numbers, starts, untils, firsts = [], [], [], [], []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(ids)]):
            m = a + int(groups[b] - groups[a])
            if not words[a:m].sum():
                continue
            line = Timeline(t[a:m], ends[a:m], words[a:m], t[m:b], float(lengths[a]))
            index, start = line.cuts(target)
            at += [a] * len(index)
            numbers += range(3, 3 + len(index))
            starts += start
            untils += [*start[1:], line.duration]
            firsts += line.starts[index].tolist()
        columns = [ids.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), *[pa.array(x, pa.float64()) for x in (starts, untils, firsts)]]
        return pa.RecordBatch.from_arrays(columns, ["video_id", "number", "start", "end", "first_start"])

    def plan(batches):
        """Videos come one after the other; of the last in a batch more may come."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            if held and ids[len(ids) - 1] == held[0].column(0)[0]:
                held.append(batch)
                continue
            last = int(pc.index(ids, ids[len(ids) - 1]).as_py())
            done = [*held, batch.slice(0, last)]
            if sum(b.num_rows for b in done):
                yield planned(pa.Table.from_batches(done))
            held = [batch.slice(last)]
        if held:
            yield planned(pa.Table.from_batches(held))

    # Many short videos go through Python together: a group of its own takes far longer than its cuts.
    ordered = rows.select("video_id", "kind", "t", "end", "words", "duration").repartition("video_id").sortWithinPartitions("video_id", "kind", "t")
    return ordered.mapInArrow(plan, CUTS.format(dict(cues.dtypes)["video_id"]))


def input_errors(cues: DataFrame, frames: DataFrame, durations: DataFrame) -> DataFrame:
    """What keeps a video from being planned: video_id and error, one row each; none if all is well."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    lengths = durations.select("video_id", "duration")
    bad = lengths.where(~(finite("duration") & (F.col("duration") > 0))).select("video_id", F.lit("duration must be finite and positive").alias("error"))
    fits = finite("start") & finite("end") & (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("duration")) & F.col("text").isNotNull()
    cue = cues.join(lengths, "video_id").where(~fits).select("video_id", F.lit("cues must have text and 0 <= start < end <= duration").alias("error"))
    shown = finite("ts") & (F.col("ts") >= 0) & (F.col("ts") <= F.col("duration"))
    frame = frames.join(lengths, "video_id").where(~shown).select("video_id", F.lit("frames must lie within the duration").alias("error"))
    return bad.unionByName(cue).unionByName(frame).distinct()


def check_target(target: object) -> None:
    if isinstance(target, bool) or not isinstance(target, int) or target < 1:
        raise ValueError("the page target must be a positive whole number")


def plan_pages(cues: DataFrame, frames: DataFrame, durations: DataFrame, target: int) -> DataFrame:
    """Content pages: a partition of 0..duration, each cue whole and once, each page with its longest frame."""
    check_target(target)
    cuts = plan_cuts(cues, frames, durations, target)
    marks = cuts.select("video_id", F.col("first_start").alias("start"), "number")
    texts = stamped_text(page_of_cue(cues, marks), "video_id", "number")
    pages = page_frames(cuts.drop("first_start"), frames, durations).join(texts, ["video_id", "number"])
    nothing = F.lit("")
    return pages.select(
        "video_id", "number", F.concat(F.lit("Section "), F.col("number") - 2).alias("title"), "start", "end", nothing.alias("summary"), F.array().cast("array<string>").alias("bullets"), nothing.alias("takeaway"),
        "frame_path", "source_text", F.lit("content").alias("kind"), nothing.alias("chapter"), nothing.alias("uncertainty"),
    )


def durations_of(cues: DataFrame) -> DataFrame:
    return extents(cues).select("video_id", "duration")


def coverage_errors(pages: DataFrame, durations: DataFrame) -> DataFrame:
    """Pages that break the partition: a gap, a wrong number, or a wrong beginning or end."""
    order = Window.partitionBy("video_id").orderBy("number")
    before, number = F.lag("end").over(order), F.row_number().over(order) + 2
    last = F.lead("start").over(order).isNull()
    checked = pages.withColumn("_from", F.coalesce(before, F.lit(0.0))).withColumn("_n", number).withColumn("_last", last).join(durations.select("video_id", "duration"), "video_id")
    return checked.where((F.col("start") != F.col("_from")) | (F.col("number") != F.col("_n")) | (F.col("start") >= F.col("end")) | (F.col("_last") & (F.col("end") != F.col("duration")))).select("video_id", "number", "start", "end")
