"""Books from cues and frames, for all videos at once: A07-A11, U01, P19."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, word_count
from ..operators import summaries
from ..operators.summaries import Provider, extractive, visible_text
from ..operators.timeline import unpictured
from ..progress import Report
from ..shared import written
from ..sources.checkpoints import Checkpoints
from .planner import durations_of, input_errors, plan_pages

PAGE_COLUMNS = ("number", "title", "start", "end", "summary", "bullets", "takeaway", "frame_path", "source_text", "kind", "chapter", "uncertainty")
WORDS_A_MINUTE, SECONDS_A_FRAME, MOST_WORDS, LEAST_WORDS = 180, 6, 65, 18
EXTRACTIVE_WARNING = "No page was summarized: what pages say are passages of the captions."
ESTIMATE_WARNING = "How long reading takes is estimated from words and pictures alone; formulas and crowded pictures take longer."
UNSEEN_WARNING = "No pictures of the video were at hand, so pages show words only."
LESS_WARNING = "There is enough said for {} of the {} pages asked for; no page was stretched."
UNPICTURED_WARNING = "{} pictures that differ from the one before have no page of their own."
#: The two pages in front: what they say beside figures.
COVER_TEXT = "{} pages for {} of video, to be read in about {} minutes."
COVER_POINTS, COVER_TAKEAWAY = ("A picture and a short text on each page.", "All that was said is kept, with its times."), "Leaf through, read what matters, and play it where you want more."
ROUTE_TITLE, ROUTE_TEXT, ROUTE_CHAPTER = "How to use this book", "Pages stand in the order of the video; the times on each one open it there.", summaries.OVERVIEW_CHAPTER
ROUTE_POINTS, ROUTE_TAKEAWAY = ("Look at the picture first, then at the text.", "What stays unclear can be looked up by its time."), "All texts here are quoted from the captions."


def word_budget(n_pages: Column, minutes: Column, has_frames: Column) -> Column:
    """A10: words a content page may show; cut to a whole number, at most MOST_WORDS.  Every page is charged for a frame if
    there is any."""
    visual = F.when(has_frames, F.lit(SECONDS_A_FRAME)).otherwise(F.lit(0))
    return F.least(F.lit(MOST_WORDS), ((minutes * WORDS_A_MINUTE - WORDS_A_MINUTE - n_pages * visual * 3) / n_pages).cast("int"))


def with_budgets(content: DataFrame, frames: DataFrame, minutes: float) -> DataFrame:
    """Content pages with n_pages, has_frames and max_words of their video, in one pass over the pages."""
    shown = frames.select("video_id").distinct().withColumn("has_frames", F.lit(True))
    counted = content.withColumn("n_pages", F.count("*").over(Window.partitionBy("video_id"))).join(shown, "video_id", "left").withColumn("has_frames", F.coalesce("has_frames", F.lit(False)))
    return counted.withColumn("max_words", word_budget(F.col("n_pages"), F.lit(minutes), F.col("has_frames")))


def filled(sentence: str, *values: Column) -> Column:
    """A sentence with values in place of its {}."""
    parts = sentence.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:]) for x in (v, F.lit(p))])


def _front(title: Column, duration: Column, n_pages: Column, minutes: float) -> Column:
    """Cover and overview of a video, as an array of pages."""
    text = lambda parts: F.array(*[F.lit(t) for t in parts])
    cover = filled(COVER_TEXT, (n_pages + 2).cast("string"), clock(duration), F.lit(f"{float(minutes):g}"))
    page = lambda number, title, summary, bullets, takeaway, kind, chapter: F.struct(
        F.lit(number).alias("number"), title.alias("title"), F.lit(0.0).alias("start"), duration.alias("end"), summary.alias("summary"), bullets.alias("bullets"), F.lit(takeaway).alias("takeaway"),
        F.lit(None).cast("string").alias("frame_path"), F.lit("").alias("source_text"), F.lit(kind).alias("kind"), F.lit(chapter).alias("chapter"), F.lit("").alias("uncertainty"),
    )
    return F.array(
        page(1, title, cover, text(COVER_POINTS), COVER_TAKEAWAY, "cover", ""),
        page(2, F.lit(ROUTE_TITLE), F.lit(ROUTE_TEXT), text(ROUTE_POINTS), ROUTE_TAKEAWAY, "overview", ROUTE_CHAPTER),
    )


def assemble(content: DataFrame, videos: DataFrame, minutes: float, overview: DataFrame | None = None) -> DataFrame:
    """Cover, overview and content pages, numbered from 1.  content also has n_pages; videos: video_id, title, duration.

    The front pages come out of each video's first content page, so that content is read once.  overview: a page for each
    video in place of the one that says how to read excerpts.
    """
    told = content.join(videos.select("video_id", F.col("title").alias("_title"), F.col("duration").alias("_duration")), "video_id")
    front = _front(F.col("_title"), F.col("_duration"), F.col("n_pages"), minutes)
    own = F.struct(*[F.col(c) for c in PAGE_COLUMNS])
    first = F.min("number").over(Window.partitionBy("video_id"))
    pages = F.when(F.col("number") == F.col("_first"), F.concat(front, F.array(own))).otherwise(F.array(own))
    book = told.withColumn("_first", first).select("video_id", F.inline(pages))
    return book if overview is None else book.where("kind <> 'overview'").unionByName(overview.select("video_id", *PAGE_COLUMNS))


def totals(pages: DataFrame, cues: DataFrame, frames: DataFrame, minutes: float) -> DataFrame:
    """One row of figures for each video; the reading estimate is not rounded."""
    by_page = pages.groupBy("video_id").agg(
        F.count_if(F.col("kind") == "content").alias("n_pages"),
        F.sum(word_count(visible_text())).alias("visible_prose_words"),
        F.count_distinct(F.when(F.col("frame_path") != "", F.col("frame_path"))).alias("pictured_visual_states"),
        F.count_if((F.col("kind") == "content") & F.col("frame_path").isNull()).alias("transcript_only_pages"),
    )
    by_cue = cues.groupBy("video_id").agg(F.count("*").alias("caption_cues"), F.sum(word_count(F.col("text"))).alias("source_words"))
    by_frame = frames.groupBy("video_id").agg(F.count("*").alias("captured_visual_states"))
    missing = unpictured(frames, pages).groupBy("video_id").agg(F.count("*").alias("unpictured"))
    joined = by_page.join(by_cue, "video_id").join(by_frame, "video_id", "left").join(missing, "video_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("captured_visual_states", "unpictured")}
    joined = joined.withColumns(zero).withColumn("has_frames", F.col("captured_visual_states") > 0)
    joined = joined.withColumn("max_words", word_budget(F.col("n_pages"), F.lit(minutes), F.col("has_frames")))
    seconds = F.when(F.col("has_frames"), F.lit(SECONDS_A_FRAME)).otherwise(F.lit(0))
    return joined.withColumn("estimated_reading_minutes", F.col("visible_prose_words") / WORDS_A_MINUTE + F.col("n_pages") * seconds / 60)


def warnings(figures: DataFrame, requested_pages: int, extractive_mode: bool = True) -> DataFrame:
    """The ordered, distinct warnings of each video."""
    shown = (F.col("n_pages") + 2).cast("string")
    found = F.array(
        F.when(F.col("captured_visual_states") == 0, F.lit(UNSEEN_WARNING)),
        F.when(F.col("n_pages") + 2 < requested_pages, filled(LESS_WARNING, shown, F.lit(str(requested_pages)))),
        F.lit(EXTRACTIVE_WARNING if extractive_mode else None),
        F.when(F.col("unpictured") > 0, filled(UNPICTURED_WARNING, F.col("unpictured").cast("string"))),
        F.lit(ESTIMATE_WARNING),
    )
    return figures.select("video_id", F.array_distinct(F.filter(found, lambda w: w.isNotNull())).alias("warnings"))


#: What a reader of a book is told about where its times come from, by how its duration was found.
DURATION_WARNINGS = {"inferred": "No duration was known: the last caption's end stands for it.", "extended": "Captions go on after the known duration, which was extended to their end."}
SAMPLED_WARNING = "Visual changes were looked for in images taken at intervals; shorter ones can be missing."


def with_source_warnings(videos: DataFrame, sources: DataFrame, sampled: bool = False) -> DataFrame:
    """Videos whose warnings also tell how the duration was found and, if sampled, how changes were.

    sources: video_id and duration_from."""
    how = F.coalesce(*[F.when(F.col("duration_from") == k, F.lit(w)) for k, w in DURATION_WARNINGS.items()])
    more = F.array(how, F.when(F.lit(sampled) & (F.col("captured_visual_states") > 0), F.lit(SAMPLED_WARNING)))
    joined = videos.join(sources.select("video_id", "duration_from"), "video_id", "left")
    return joined.withColumn("warnings", F.array_distinct(F.concat(F.filter(more, lambda w: w.isNotNull()), "warnings"))).drop("duration_from")


def assumed(provider: Provider | None, pages: int, minutes: float) -> dict[str, Column]:
    """What a book was asked to be, and by what its reading time was reckoned, for its JSON."""
    made_by = (provider.name, provider.version) if provider else ("extractive", None)
    said = {"provider": F.lit(made_by[0]), "model": F.lit(made_by[1]).cast("string"), "requested_pages": F.lit(pages)}
    return said | {"reading_minutes": F.lit(float(minutes)), "words_a_minute": F.lit(WORDS_A_MINUTE), "seconds_a_picture": F.lit(SECONDS_A_FRAME)}


class Unusable(ValueError):
    """What keeps a book from being made."""


def refuse(found: DataFrame, what: str) -> None:
    """Raises for the first of rows that should not be: video_id and error."""
    wrong = found.take(1)
    if wrong:
        raise Unusable(f"{what} of {wrong[0]['video_id']}: {wrong[0]['error']}")


def summarized(content: DataFrame, provider: Provider, checkpoints: Checkpoints | None = None, workers: int | None = None, report: Report | None = None, images: DataFrame | None = None) -> DataFrame:
    """Content pages (with max_words) with a provider's summaries, all of which keep the rules."""
    made = summaries.summarize(content, provider, None, checkpoints=checkpoints, workers=workers, report=report, images=images)
    checked = summaries.validate(content, made, F.col("max_words"))
    refuse(checked.where("problem IS NOT NULL").select("video_id", F.concat_ws(": ", F.col("number").cast("string"), "problem").alias("error")), "page")
    return summaries.apply_summaries(checked)


def build(cues: DataFrame, frames: DataFrame, titles: DataFrame, pages: int = 200, minutes: float = 60.0, durations: DataFrame | None = None, provider: Provider | None = None, checkpoints: Checkpoints | None = None, workers: int | None = None, check: bool = True, keep: Callable[[DataFrame, str], DataFrame] | None = None, report: Report | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Books: all pages, and a row for each video with its figures and warnings.

    titles: video_id, title, source_url.  Without a provider, pages show excerpts of their own text (X05).  What forbids a plan
    (P02), a budget that leaves fewer than LEAST_WORDS a page, and a summary that breaks a rule raise; check=False leaves out
    the first of these.  keep(table, name) writes a table that is read more than once and gives back what it
    wrote, by default in the shared folder.  report: hears how many batches a provider has answered.
    images: path and content of the frames, for a provider that looks at them.
    """
    durations = durations_of(cues) if durations is None else durations
    keep = keep or written(cues.sparkSession)
    if check:
        refuse(input_errors(cues, frames, durations), "input")
    told = with_budgets(plan_pages(cues, frames, durations, pages - 2), frames, minutes)
    enough = F.when(F.col("max_words") < LEAST_WORDS, F.raise_error(F.concat(F.lit("the reading target is too short for the pages of "), F.col("video_id").cast("string")))).otherwise(F.col("max_words"))
    told, videos = keep(told.withColumn("max_words", enough), "content"), titles.join(durations.select("video_id", "duration"), "video_id")
    if provider is None:
        book = assemble(extractive(told, F.col("max_words")), videos, minutes)
    else:
        content = keep(summarized(told, provider, checkpoints, workers, report, images), "summaries")
        book = assemble(content, videos, minutes, summaries.overview(content, durations, provider, checkpoints, report))
    book = keep(book, "pages")
    figures = totals(book, cues, frames, minutes)
    notes = warnings(figures, pages, provider is None)
    return book, videos.select("video_id", "title", "source_url", "duration").join(figures, "video_id").join(notes, "video_id").withColumns(assumed(provider, pages, minutes))
