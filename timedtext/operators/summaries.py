"""Summaries of pages, their validation, and providers.

A provider is any object with summarize(records, max_words, feedback) -> list of dicts; it runs on the executors, batch by
batch.  No provider that needs a network is part of this package.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, stamp, with_excerpt, word_count
from ..progress import Report
from ..shared import new_folder
from ..sources.checkpoints import Checkpoints, key_of
from .sampling import pack_next_fit
from .timeline import batches

MAX_SECTION, MAX_CHUNK, MAX_LEVELS, OVERVIEW_WORDS, ATTEMPTS = 60_000, 50_000, 10, 85, 3
EVIDENCE_WORDS, BULLETS = 20, 2
OVERVIEW_CHAPTER = "About this book"
FIELDS = ["page_id", "title", "summary", "bullets", "takeaway", "chapter", "uncertainty", "evidence"]


def visible_text(prefix: str = "") -> Column:
    """P10: what a reader sees of a page, joined by spaces; empty parts count as parts."""
    part = lambda c: F.coalesce(F.col(prefix + c), F.lit(""))
    return F.array_join(F.concat(F.array(part("title"), part("summary")), F.coalesce(F.col(prefix + "bullets"), F.array().cast("array<string>")), F.array(part("takeaway"), part("uncertainty"))), " ")


def page_problem(max_words: int | Column) -> Column:
    """The first rule that a joined row (page and s, its summary) breaks, or NULL."""
    source = normalized(F.col("source_text"))
    bad_quote = F.exists("s.evidence", lambda q: (normalized(q) == "") | (word_count(q) > EVIDENCE_WORDS) | ~F.contains(source, normalized(q)))
    return (
        F.when(F.col("s").isNull(), "the summary is missing")
        .when((F.trim("s.title") == "") | (F.trim("s.summary") == ""), "the title or the summary is empty")
        .when((F.size("s.bullets") > BULLETS) | (word_count(visible_text("s.")) > max_words), "the summary exceeds the reading budget")
        .when(~F.size("s.evidence").between(1, 3), "there must be one to three quotes")
        .when(bad_quote, "a quote is not in the transcript")
    )


def validate(pages: DataFrame, summaries: DataFrame, max_words: int | Column) -> DataFrame:
    """Every page with its summary `s` and `problem`; summaries of other pages come with a problem of their own."""
    s = summaries.select(F.col("video_id").alias("_v"), F.col("page_id").alias("_p"), F.struct(*FIELDS).alias("s"))
    joined = pages.join(s, (F.col("video_id") == F.col("_v")) & (F.col("number") == F.col("_p")), "full")
    problem = F.when(F.col("number").isNull(), "there is no such page").otherwise(page_problem(max_words))
    return joined.withColumn("problem", problem).withColumns({"video_id": F.coalesce("video_id", "_v"), "number": F.coalesce("number", "_p")}).drop("_v", "_p")


def apply_summaries(validated: DataFrame) -> DataFrame:
    """Pages with the texts of their summaries, trimmed; blank bullets go."""
    put = {c: F.trim(F.col(f"s.{c}")) for c in ("title", "summary", "takeaway", "chapter", "uncertainty")}
    put["bullets"] = F.filter(F.transform("s.bullets", lambda b: F.trim(b)), lambda b: b != "")
    return validated.withColumns(put).drop("s", "problem")


def extractive(pages: DataFrame, max_words: int | Column) -> DataFrame:
    """pages with labelled excerpts of their own text."""
    title, note = F.concat(F.lit("Transcript excerpt "), (F.col("number") - 2).cast("string")), "Excerpt; no AI summary."
    made = with_excerpt(pages, "summary", F.col("source_text"), max_words, title, note)
    return made.withColumns({"title": title, "uncertainty": F.lit(note), "chapter": F.lit("Transcript excerpts"), "bullets": F.array().cast("array<string>"), "takeaway": F.lit("")})


class Provider(Protocol):
    """Name and version are part of the key under which results are kept.

    A record has page_id, start, end, source_text and image: the bytes of the page's picture, or None."""

    name: str
    version: str

    def summarize(self, records: list[dict], max_words: int, feedback: str | None) -> list[dict] | None: ...


def check_batch(records: list[dict], result: list[dict], max_words: int) -> str | None:
    """P08 on the executors, as Python: the first problem of a batch."""
    if [r["page_id"] for r in result] != [r["page_id"] for r in records]:
        return "page ids were changed or left out"
    words = lambda t: len(re.findall(r"[㐀-鿿]|[^\W_]+(?:['’][^\W_]+)*", t))
    plain = lambda t: " ".join(re.sub(r"\[[0-9]+:[0-9]{2}:[0-9]{2}\]", "", t).split()).casefold()
    for record, s in zip(records, result):
        seen = " ".join([s["title"], s["summary"], *s["bullets"], s["takeaway"], s["uncertainty"]])
        source = plain(record["source_text"])
        if not s["title"].strip() or not s["summary"].strip():
            return f"page {s['page_id']}: the title or the summary is empty"
        if len(s["bullets"]) > BULLETS or words(seen) > max_words:
            return f"page {s['page_id']}: the summary exceeds the reading budget of {max_words} words"
        if not 1 <= len(s["evidence"]) <= 3:
            return f"page {s['page_id']}: there must be one to three quotes"
        if any(not plain(q) or words(q) > EVIDENCE_WORDS or plain(q) not in source for q in s["evidence"]):
            return f"page {s['page_id']}: a quote is not in the transcript"
    return None


def asked(provider: Provider, records: list[dict], max_words: int, feedback: str | None) -> tuple[str | None, str | None]:
    """One answer of the provider as JSON, and what is wrong with it."""
    if any(len(r["source_text"]) > MAX_SECTION for r in records):
        raise ValueError(f"a section exceeds {MAX_SECTION} characters")
    result = provider.summarize(records, max_words, feedback)
    if result is None:
        return None, NO_ANSWER
    try:
        return json.dumps(result), check_batch(records, result, max_words)
    except (AttributeError, KeyError, TypeError) as e:
        return json.dumps(result, default=str), f"the answer lacks what was asked for: {e!r}"


def with_pictures(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with the bytes of their pictures as `image`, where there are any."""
    return pages.join(images.select(F.col("path").alias("frame_path"), F.col("content").alias("image")).dropDuplicates(["frame_path"]), "frame_path", "left")


def with_images(records: str, pictures) -> list[dict]:
    """The records of a batch, each with its picture's bytes or None."""
    found = {p["number"]: bytes(p["image"]) for p in pictures} if pictures is not None else {}
    return [{k: v for k, v in r.items() if k != "image_sha256"} | {"image": found.get(r["page_id"])} for r in json.loads(records)]


#: A provider's answers: the run that asked, the attempt, the answer and the rule that it breaks.
RESULT_CHECKPOINT = "run string, attempt int, result string, problem string"
NO_ANSWER = "the provider gave no answer"


def summarize(pages: DataFrame, provider: Provider, max_words: int | None, batch_size: int = 4, checkpoints: Checkpoints | None = None, workers: int | None = None, report: Report | None = None, images: DataFrame | None = None) -> DataFrame:
    """Summaries of all pages, in batches of each video.

    Every answer is written and committed before anything is made of it, also those that break a rule: to checkpoints, or to
    the shared folder where none are given.  So a batch is asked once for each attempt, whatever reads the summaries.  Up to
    ATTEMPTS rounds ask for the batches that have no valid answer yet, telling what was wrong; no answer at all is final.
    Batches whose key has a valid answer from before are not asked for (S18); invalid ones of other runs count for nothing.

    max_words: the budget of a page, or None where pages have it as a column.  workers: how many ask at once, by default as many
    as there are cores.  report: hears after each round how many batches there are, were kept, are done and were asked again.
    images: path and content of the pages' pictures (frame_path); a batch's key goes by their digests, and their bytes go only
    to where it is asked.
    """
    pictured = images is not None and "frame_path" in pages.columns
    pages = with_pictures(pages, images) if pictured else pages
    spark, run, batch_size = pages.sparkSession, uuid.uuid4().hex, min(8, max(1, batch_size))
    grouped = batches(pages, batch_size, "number")
    seen_as = [F.sha2("image", 256).alias("image_sha256")] if pictured else []
    record = F.struct(F.col("number").alias("page_id"), "start", "end", "source_text", *seen_as)
    pictures = F.collect_list(F.when(F.col("image").isNotNull(), F.struct("number", "image"))) if pictured else F.lit(None).cast("array<struct<number:int,image:binary>>")
    records = F.transform(F.array_sort(F.collect_list(F.struct("number", record.alias("r")))), lambda x: x.r)
    budget = F.lit(max_words) if max_words is not None else F.min("max_words")
    work = grouped.groupBy("video_id", "batch").agg(F.to_json(records).alias("records"), budget.cast("int").alias("words"), pictures.alias("pictures"))
    work = work.withColumn("key", key_of(F.lit(provider.name).alias("n"), F.lit(provider.version).alias("v"), F.col("words").alias("w"), F.col("records")))
    kept = checkpoints or Checkpoints(spark, new_folder(spark, "answers"), RESULT_CHECKPOINT)
    valid = F.col("problem").isNull() & F.try_parse_json(F.col("result")).isNotNull()
    distinct = work.select("key", "records", "words", "pictures").dropDuplicates(["key"])

    def answers(todo: DataFrame, attempt: int) -> DataFrame:
        def ask(frames):
            for frame in frames:
                given = [asked(provider, with_images(r, p), int(w), f) for r, w, p, f in zip(frame["records"], frame["words"], frame["pictures"], frame["feedback"])]
                yield frame[["key"]].assign(run=run, attempt=attempt, result=[g[0] for g in given], problem=[g[1] for g in given])

        return (todo.repartition(workers) if workers else todo).mapInPandas(ask, "key string, " + RESULT_CHECKPOINT)

    todo = kept.missing(distinct, valid).withColumn("feedback", F.lit(None).cast("string"))
    total, told = distinct.count() if report else 0, {}
    for attempt in range(1, ATTEMPTS + 1):
        seen = kept.add(answers(todo, attempt), valid=F.count_if(F.col("problem").isNull()), silent=F.count_if(F.col("result").isNull()))
        if report:
            told = {"batches": total, "kept": told.get("kept", total - seen.get("rows", 0)), "done": told.get("done", total - seen.get("rows", 0)) + seen.get("valid", 0), "retried": told.get("retried", 0) + (seen.get("rows", 0) if attempt > 1 else 0)}
            report("summaries", told)
        if not seen or seen["valid"] == seen["rows"]:
            break
        wrong = kept.rows().where((F.col("run") == run) & (F.col("attempt") == attempt) & F.col("problem").isNotNull()).select("key", F.col("problem").alias("feedback"))
        if seen["silent"] or attempt == ATTEMPTS:
            last = wrong.orderBy(F.col("feedback") != NO_ANSWER, "key").first()
            raise RuntimeError(last.feedback if seen["silent"] else f"no valid summary after {ATTEMPTS} attempts: {last.feedback}")
        todo = distinct.join(wrong, "key")
    item = "array<struct<page_id:int,title:string,summary:string,bullets:array<string>,takeaway:string,chapter:string,uncertainty:string,evidence:array<string>>>"
    return kept.found(work.drop("pictures"), valid).select("video_id", F.inline(F.from_json("result", item)))


def overview_source(pages: DataFrame) -> DataFrame:
    """A12, one level: the visible texts of each video's pages, packed into chunks of MAX_CHUNK characters.

    video_id, chunk, chunks and source_text.  Where chunks is 1 the text is ready for the overview; else the chunks are
    summarized as pages and the step is taken again.
    """
    line = F.concat(F.lit("["), stamp(F.col("start")), F.lit("] "), visible_text())
    records = pages.select("video_id", F.col("number").alias("ordinal"), line.alias("line"))
    long = F.when(F.length("line") > MAX_CHUNK, F.raise_error(F.lit("a page's summary is too long to reduce"))).otherwise(F.length("line"))
    packed = pack_next_fit(records.select("video_id", "ordinal", long.alias("length")), MAX_CHUNK)
    joined = packed.join(records, ["video_id", "ordinal"])
    lines = F.array_sort(F.collect_list(F.struct("ordinal", "line")))
    chunks = joined.groupBy("video_id", "chunk").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("source_text"))
    return chunks.join(chunks.groupBy("video_id").agg(F.count("*").alias("chunks")), "video_id")


def overview(pages: DataFrame, durations: DataFrame, provider: Provider, checkpoints: Checkpoints | None = None, report: Report | None = None) -> DataFrame:
    """One overview page (number 2) for each video, by as many levels of reduction as its text needs."""
    current, done = pages, []
    for level in range(MAX_LEVELS + 1):
        sources = overview_source(current).join(durations.select("video_id", "duration"), "video_id")
        as_pages = lambda number, rows: rows.select("video_id", number.cast("int").alias("number"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), "source_text")
        last = as_pages(F.lit(2), sources.where("chunks = 1"))
        done.append(summarize(last, provider, OVERVIEW_WORDS, 1, checkpoints, None, report).join(last, "video_id"))
        more = as_pages(F.lit(1_000_000 + level * 10_000) + F.col("chunk"), sources.where("chunks > 1"))
        if more.isEmpty():
            break
        if level == MAX_LEVELS:
            raise RuntimeError("the overview did not get short enough")
        current = summarize(more, provider, OVERVIEW_WORDS, 4, checkpoints, None, report).withColumnRenamed("page_id", "number").join(durations.select("video_id", F.lit(0.0).alias("start"), F.col("duration").alias("end")), "video_id")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    trimmed = [F.trim(c).alias(c) for c in ("title", "summary", "takeaway", "uncertainty")]
    return out.select("video_id", "number", "start", "end", "source_text", *trimmed, F.filter(F.transform("bullets", lambda b: F.trim(b)), lambda b: b != "").alias("bullets"), F.lit(OVERVIEW_CHAPTER).alias("chapter"), F.lit("overview").alias("kind"), F.lit(None).cast("string").alias("frame_path"))
