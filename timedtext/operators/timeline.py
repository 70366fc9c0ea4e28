"""Grouping, prefix sums, as-of and overlap joins on a timeline: A01-A06, W01-W04, W10-W12, J01-J04, J09, O01-O03."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, count_words, stamp

MIN_SOURCE_WORDS, WORD_WEIGHT, TIME_WEIGHT = 40, 0.85, 0.15


def weight(text: Column) -> Column:
    """The words of a cue, 1 at least; 0 if it is blank."""
    return F.when(text.rlike(f"[^{SPACE}]"), F.greatest(F.lit(1), count_words(text))).otherwise(F.lit(0))


def start_groups(cues: DataFrame) -> DataFrame:
    """Cues that start together are one group; overlaps are not merged.  `g` numbers a video's groups from 0."""
    groups = cues.groupBy("video_id", "start").agg(F.sum(weight(F.col("text"))).cast("int").alias("words"), F.max("end").alias("end"), F.count("*").cast("int").alias("cues"))
    return groups.withColumn("g", F.row_number().over(Window.partitionBy("video_id").orderBy("start")) - 1)


def prefix_sums(groups: DataFrame) -> DataFrame:
    """Words and groups with words before each group, and the latest end before it."""
    before = Window.partitionBy("video_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, x: F.coalesce(c.over(before), F.lit(x))
    return groups.withColumns({"words_before": zero(F.sum("words"), 0), "nonempty_before": zero(F.sum((F.col("words") > 0).cast("int")), 0), "end_before": zero(F.max("end"), 0.0)})


def extents(cues: DataFrame) -> DataFrame:
    """The last end of each video's cues, its words and its groups with words."""
    groups = cues.groupBy("video_id", "start").agg(F.sum(weight(F.col("text"))).alias("words"), F.max("end").alias("end"))
    return groups.groupBy("video_id").agg(F.max("end").alias("duration"), F.sum("words").alias("total_words"), F.sum((F.col("words") > 0).cast("int")).alias("nonempty"))


def page_counts(cues: DataFrame, target: int) -> DataFrame:
    """As many pages as asked for, but no more than one for forty words or for each group with words."""
    supported = F.greatest(F.lit(1), F.floor(F.col("total_words") / MIN_SOURCE_WORDS))
    return extents(cues).where("total_words > 0").withColumn("page_count", F.least(F.lit(target), supported, F.col("nonempty")).cast("int"))


def gaps(prefixes: DataFrame) -> DataFrame:
    """The silence before each group, and its middle; the first group's cut is at 0."""
    lower = F.least("end_before", "start")
    return prefixes.withColumn("gap_from", lower).withColumn("base_time", F.when(F.col("g") == 0, F.lit(0.0)).otherwise((lower + F.col("start")) / 2))


def masses(with_gaps: DataFrame, totals: DataFrame) -> DataFrame:
    """The share of the book before each cut: by words and, a little, by time."""
    joined = with_gaps.join(totals.select("video_id", "duration", "total_words"), "video_id")
    return joined.withColumn("mass", F.lit(WORD_WEIGHT) * F.col("words_before") / F.col("total_words") + F.lit(TIME_WEIGHT) * F.col("base_time") / F.col("duration"))


def frame_spans(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """A frame stands until the next, the last one until the end."""
    order = Window.partitionBy("video_id").orderBy("ts", "ordinal")
    return frames.withColumn("_next", F.lead("ts").over(order)).join(durations.select("video_id", "duration"), "video_id").withColumn("until", F.coalesce("_next", "duration")).drop("_next", "duration")


def page_frames(pages: DataFrame, frames: DataFrame, durations: DataFrame) -> DataFrame:
    """Each page with the path of the frame that stands longest in it; the earliest of equals, NULL without any.

    A sweep over each video's pages and frames by time, as both follow each other without overlap: what meets a page is the
    frame that stands as it begins, and those that come before it ends.  So candidates number at most pages and frames
    together, and none is compared with another page.
    """
    of_frame = F.struct("ts", "until", (-F.col("ordinal")).alias("o"), "path")
    nothing = lambda column, frame: F.lit(None).cast(frame.select(column).schema[0].dataType)
    spans = frame_spans(frames, durations)
    stretch = F.struct("start", "end").alias("page")
    shown = spans.select("video_id", F.col("ts").alias("t"), F.lit(0).alias("kind"), F.col("ordinal").alias("n"), of_frame.alias("frame"), nothing(stretch, pages).alias("page"))
    turned = pages.select("video_id", F.col("start").alias("t"), F.lit(1).alias("kind"), F.lit(0).cast(shown.schema["n"].dataType).alias("n"), nothing(of_frame, spans).alias("frame"), stretch)
    swept = Window.partitionBy("video_id").orderBy("t", "kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    # Pages that begin as a frame comes follow it in the order, so that the frame stands as they begin.
    both = shown.unionByName(turned).withColumns({"_frame": F.last("frame", ignorenulls=True).over(swept), "_page": F.last("page", ignorenulls=True).over(swept)})
    meets = (F.col("_frame.ts") < F.col("_page.end")) & (F.col("_frame.until") > F.col("_page.start"))
    shared = F.least("_page.end", "_frame.until") - F.greatest("_page.start", "_frame.ts")
    best = F.max_by("_frame.path", F.struct(shared.alias("s"), (-F.col("_frame.ts")).alias("t"), F.col("_frame.o").alias("o")))
    chosen = both.where(meets).groupBy("video_id", F.col("_page.start").alias("start")).agg(best.alias("frame_path"))
    return pages.drop("frame_path").join(chosen, ["video_id", "start"], "left").select(*[c for c in pages.columns if c != "frame_path"], "frame_path")


def nearest_change(times: DataFrame, changes: DataFrame) -> DataFrame:
    """Times (video_id, id, t) with the distance to the nearest change (video_id, ts); infinite without one."""
    both = times.select("video_id", "id", F.col("t"), F.lit(None).cast("double").alias("c")).unionByName(changes.select("video_id", F.lit(None).cast(times.schema["id"].dataType).alias("id"), F.col("ts").alias("t"), F.col("ts").alias("c")))
    order = Window.partitionBy("video_id").orderBy("t", F.col("c").isNull())
    before = F.last("c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("c", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("t") - before, after - F.col("t"))
    return both.withColumn("distance", F.coalesce(near, F.lit(float("inf")))).where("c IS NULL").select("video_id", "id", "t", "distance")


def stamped_text(cues: DataFrame, *keys: str) -> DataFrame:
    """The lines of each group in order, each with its time."""
    line = F.concat(F.lit("["), stamp(F.col("start")), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("start", "end", "ordinal", line.alias("line"))))
    return cues.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("source_text"))


def page_of_cue(cues: DataFrame, cuts: DataFrame) -> DataFrame:
    """The page of each cue by its group: the running count of cuts.  cuts: video_id, start (of the page's first group), number."""
    marks = cuts.select("video_id", "start", F.col("number").alias("_number"))
    joined = cues.join(marks, ["video_id", "start"], "left")
    return joined.withColumn("number", F.max("_number").over(Window.partitionBy("video_id").orderBy("start"))).drop("_number")


def cut_candidates(gap: DataFrame, changes: DataFrame) -> DataFrame:
    """For each silence (video_id, g, gap_from, start, desired) the changes within it next to the desired time on either side.

    Each silence asks twice where it lies among the changes by time: for the last one before the desired time or its own end,
    and for the first one from there or from its own beginning; a sweep answers both, and what lies outside is none."""
    late, early = F.col("desired") > F.col("start"), F.col("desired") < F.col("gap_from")
    silence = gap.where("gap_from < start")
    ask = lambda side, t, rank: silence.select("video_id", "g", "gap_from", "start", t.alias("t"), rank.alias("rank"), F.lit(side).alias("side"), F.lit(None).cast("double").alias("ts"))
    below = ask("below", F.least("desired", "start"), F.when(late, 2).otherwise(0))
    above = ask("above", F.when(early, F.col("gap_from")).otherwise(F.col("desired")), F.lit(0))
    known = {f.name: f.dataType for f in below.schema}
    there = changes.select("video_id", *[F.lit(None).cast(known[c]).alias(c) for c in ("g", "gap_from", "start")], F.col("ts").alias("t"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("side"), "ts")
    order = Window.partitionBy("video_id").orderBy("t", "rank")
    last, first = F.last("ts", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("ts", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    answered = below.unionByName(above).unionByName(there).withColumn("_near", F.when(F.col("side") == "below", last).otherwise(first)).where("side IS NOT NULL")
    inside = F.when(F.col("_near").between(F.col("gap_from"), F.col("start")), F.col("_near"))
    pairs = answered.groupBy("video_id", "g").agg(*[F.max(F.when(F.col("side") == side, inside)).alias(side) for side in ("below", "above")])
    return gap.select("video_id", "g").join(pairs, ["video_id", "g"], "left")


def unpictured(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Frames that no page shows."""
    shown = pages.where("frame_path IS NOT NULL").select("video_id", F.col("frame_path").alias("path")).distinct()
    return frames.join(shown, ["video_id", "path"], "left_anti")


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows of each video in runs of size, numbered from 0."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))
