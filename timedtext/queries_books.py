"""Registered queries of caption files, checks, figures and sinks, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import layout, links, text
from .operators import summaries, timeline
from .plans import book, planner
from .queries import CUES, FRAMES, LINKED, P_LABEL, P_NOTES, PAGE_ROWS, TURNS, _demo_pages, _demo_videos, _s_clean, query, s_clock, s_collapse, s_escape, s_fold, s_key, s_stamp, s_words2
from .sinks import export, pdf
from .sources import captions, frames as images, tracks
from .sources.fixtures import conversation_cues, conversation_frames, rolling, table

# Caption files made of conversations --------------------------------------------------------------------------------


def _moment(t: Column, mark: str) -> Column:
    return F.concat(text.stamp(t), F.lit(mark), F.lpad((t * 1000 % 1000).cast("int").cast("string"), 3, "0"))


def _written(cues: DataFrame, kind: str, head: str = "") -> DataFrame:
    """One caption file of each video: video_id and value."""
    mark = "," if kind == "srt" else "."
    block = F.concat(F.col("ordinal").cast("string"), F.lit("\n"), _moment(F.col("start"), mark), F.lit(" --> "), _moment(F.col("end"), mark), F.lit("\n"), "text", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", block.alias("b"), "start", "end", "text", (F.col("end") - F.col("start")).alias("duration"))))
    listed = cues.groupBy("video_id").agg(ordered.alias("x"))
    item = {"json": ("start", "end", "text"), "segments": ("start", "duration", "text")}.get(kind)
    if item:
        items = F.transform("x", lambda c: F.struct(*[c[n].alias(n) for n in item]))
        return listed.select("video_id", F.to_json(items if kind == "json" else F.struct(items.alias("segments"))).alias("value"))
    return listed.select("video_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda c: c.b), "\n")).alias("value"))


def _named(files: DataFrame, suffix: str) -> DataFrame:
    return files.select(F.concat(F.lit("c"), F.col("video_id").cast("string"), F.lit(suffix)).alias("path"), "value")


@query(f"""WITH {CUES} SELECT 'c' || video_id || (['.srt', '.VTT', '.json', '.JSON'])[video_id % 4 + 1] AS video_id, ordinal, "start", "end", {_s_clean('text')} AS text FROM cues""")
def s01_load_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of files; the second kind begins with a mark."""
    cues = conversation_cues(spark, sf_dir)
    of = lambda k: cues.where(F.col("video_id") % 4 == k)
    files = _named(_written(of(0), "srt"), ".srt").union(_named(_written(of(1), "vtt", "﻿WEBVTT\n\nNOTE made\nof turns\n\n"), ".VTT"))
    files = files.union(_named(_written(of(2), "json"), ".json")).union(_named(_written(of(3), "segments"), ".JSON"))
    return captions.load_transcripts(files).select("video_id", "ordinal", "start", "end", "text")


@query("SELECT 'c' || conv_id || CASE conv_id % 6 WHEN 1 THEN '.txt' WHEN 2 THEN '.srt' WHEN 3 THEN '.vtt' ELSE '.json' END AS path, conv_id % 6 <> 0 AS failed, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS cues FROM (SELECT DISTINCT conv_id FROM conversations)")
def s07_rejected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of six kinds of files all but the first are wrong, and each gives one row with an error."""
    kind = F.col("conv_id") % 6
    suffix = F.when(kind == 1, ".txt").when(kind == 2, ".srt").when(kind == 3, ".vtt").otherwise(".json")
    value = (
        F.when(kind == 1, "no captions")
        .when(kind == 2, "1\n00:75:00,000 --> 00:76:00,000\nlate\n")
        .when(kind == 3, "WEBVTT\n\n00:02.000 --> 00:01.000\n\n")
        .when(kind == 4, '[{"start": 0, "end": 1, "text": "<b></b>"}]')
        .when(kind == 5, '[{"start": true, "end": 1, "text": "x"}]')
        .otherwise('[{"start": 0, "duration": 1, "text": "x"}]')
    )
    files = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), suffix).alias("path"), value.alias("value"))
    return captions.parse_captions(files).groupBy("path").agg((F.count("error") > 0).alias("failed"), F.count("start").cast("int").alias("cues"))


@query(f"""WITH {TURNS}, docs AS (SELECT video_id * 1000 + ordinal AS video_id, [w FOR w IN string_split({_s_clean('text')}, ' ') IF w <> ''] AS words FROM turns),
starts AS (SELECT video_id, words, unnest(range(0, CAST((len(words) - 1) // 4 + 1 AS BIGINT))) AS i FROM docs WHERE len(words) > 0),
cues AS (SELECT video_id, CAST(i AS INTEGER) AS ordinal, CAST(i AS DOUBLE) AS "start", CAST(i + 1.5 AS DOUBLE) AS "end", words[i * 4 + 1 : i * 4 + 8] AS w FROM starts),
keyed AS (SELECT *, [{s_key('x')} FOR x IN w] AS k FROM cues),
near AS (SELECT *, CASE WHEN "start" <= lag("end") OVER o + 0.1 THEN lag(k) OVER o END AS p FROM keyed WINDOW o AS (PARTITION BY video_id ORDER BY ordinal)),
found AS (SELECT *, CASE WHEN video_id % 2 = 1 THEN 0 ELSE coalesce([n FOR n IN range(CAST(least(len(p), len(k)) AS BIGINT), 0, -1) IF p[len(p) - n + 1 : len(p)] = k[1 : n]][1], 0) END AS n FROM near),
cut AS (SELECT *, CASE WHEN n >= 2 OR n = len(k) THEN n ELSE 0 END AS c FROM found),
island AS (SELECT *, c < len(k) AS stays, sum(CAST(c < len(k) AS INTEGER)) OVER (PARTITION BY video_id ORDER BY ordinal) AS island FROM cut),
last AS (SELECT *, max("end") OVER (PARTITION BY video_id, island) AS last_end FROM island)
SELECT 'c' || video_id || '.vtt' AS video_id, ordinal, "start", last_end AS "end", array_to_string(w[c + 1 : len(w)], ' ') AS text FROM last WHERE stays""")
def w06_rolling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W05 as files take it, and W06: every other file has a time within its first cue, and only those are deduplicated."""
    turns = conversation_cues(spark, sf_dir).select((F.col("video_id") * 1000 + F.col("ordinal")).alias("video_id"), text.clean_text(F.col("text")).alias("text"))
    tagged = F.when((F.col("video_id") % 2 == 0) & (F.col("ordinal") == 0), F.concat(F.lit("<00:00.500>"), "text")).otherwise(F.col("text"))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cues = rolling(turns).withColumn("text", escaped).withColumn("text", tagged)
    return captions.load_transcripts(_named(_written(cues, "vtt", "WEBVTT\n\n"), ".vtt")).select("video_id", "ordinal", "start", "end", "text")


# Sources ------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT source AS video_id, doc_id % 3 AS priority, 'p' || doc_id || (['.mp4', '.PART', '.WebM'])[doc_id % 3 + 1] AS path, n_chars AS modified, doc_id % 5 <> 0 AS existing FROM documents WHERE source IS NOT NULL)
SELECT video_id, priority, path, modified, existing FROM c WHERE existing AND NOT path LIKE '%.PART' QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY priority, modified DESC, path) = 1""")
def s11_downloaded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(F.lit(".mp4"), F.lit(".PART"), F.lit(".WebM")), (F.col("doc_id") % 3 + 1).cast("int"))
    made = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("video_id"), (F.col("doc_id") % 3).alias("priority"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), suffix).alias("path"), F.col("n_chars").alias("modified"), (F.col("doc_id") % 5 != 0).alias("existing"))
    return tracks.choose_files(made, [".mp4", ".webm"])


@query("SELECT doc_id, trim(text)[1:500] AS message FROM documents")
def s12_error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tracks.error_text(F.col("text")).alias("message"))


SHOWN = f"""{CUES}, {FRAMES}, shown AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, ts FROM frames)"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("[showinfo] n: 1 pts_time:"), F.col("ts").cast("string"), F.lit(" fmt:rgb24"))
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l"))))
    return conversation_frames(spark, sf_dir).groupBy("video_id").agg(F.array_join(F.transform(lines, lambda x: x.l), "\n").alias("value"))


@query(f"WITH {SHOWN} SELECT video_id, ordinal, ts FROM shown")
def s16_shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.shown_times(_logs(spark, sf_dir))


@query(f"""WITH {SHOWN}, i AS (SELECT video_id, 'frame-' || lpad(CAST(ordinal AS VARCHAR), 6, '0') AS path, CAST(row_number() OVER (PARTITION BY video_id ORDER BY ordinal) - 1 AS INTEGER) AS ordinal FROM frames)
SELECT video_id, ordinal, ts, path FROM i JOIN shown USING (video_id, ordinal)""")
def j06_zip_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = conversation_frames(spark, sf_dir).select("video_id", F.concat(F.lit("frame-"), F.lpad(F.col("ordinal").cast("string"), 6, "0")).alias("path"))
    return images.zip_times(paths, images.shown_times(_logs(spark, sf_dir)))


@query(f"""WITH {CUES}, ends AS (SELECT video_id, max("end") AS last_end FROM cues GROUP BY video_id),
s AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN 'given' END AS gt, CASE WHEN video_id % 3 = 0 THEN 'fetched' END AS ft, CASE WHEN video_id % 5 = 0 THEN 7.5 END AS gd, CASE WHEN video_id % 3 = 1 THEN 0.0 WHEN video_id % 3 = 2 THEN 1000000.0 END AS fd, CASE WHEN video_id % 7 = 0 THEN 30.0 END AS pd FROM ends)
SELECT video_id, coalesce(gt, ft, 'Untitled video') AS title, greatest(coalesce(gd, nullif(fd, 0), pd, 0), last_end) AS duration,
  CASE WHEN gd IS NULL AND fd IS NULL AND pd IS NULL THEN 'inferred' WHEN last_end > coalesce(gd, nullif(fd, 0), pd, 0) THEN 'extended' ELSE 'known' END AS duration_from FROM s""")
def p19_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = planner.durations_of(conversation_cues(spark, sf_dir)).withColumnRenamed("duration", "last_end")
    v = F.col("video_id")
    made = ends.select("video_id", F.when(v % 2 == 0, "given").alias("given_title"), F.when(v % 3 == 0, "fetched").alias("fetched_title"), F.when(v % 5 == 0, 7.5).alias("given_duration"), F.when(v % 3 == 1, 0.0).when(v % 3 == 2, 1_000_000.0).alias("fetched_duration"), F.when(v % 7 == 0, 30.0).alias("probed_duration"))
    return tracks.resolve(made, ends)


# Checks -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {TURNS} SELECT video_id, unnest(CASE video_id % 4 WHEN 1 THEN CASE WHEN count(*) FILTER (ordinal = 1) > 0 THEN ['cues must have text and 0 <= start < end <= duration'] ELSE [] END
  WHEN 2 THEN ['frames must lie within the duration'] WHEN 3 THEN ['duration must be finite and positive'] ELSE [] END) AS error FROM turns GROUP BY video_id""")
def p02_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, shown = conversation_cues(spark, sf_dir), conversation_frames(spark, sf_dir)
    kind = F.col("video_id") % 4
    lengths = planner.durations_of(cues).withColumn("duration", F.when(kind == 3, F.lit(None)).otherwise(F.col("duration")))
    cues = cues.withColumn("end", F.when((kind == 1) & (F.col("ordinal") == 1), F.col("start")).otherwise(F.col("end")))
    return planner.input_errors(cues, shown.withColumn("ts", F.when(kind == 2, F.lit(1e9)).otherwise(F.col("ts"))), lengths)


@query(f"""WITH {CUES} SELECT video_id, ordinal + 1 AS number, 'page times must be finite, with 0 <= start <= end' AS error FROM cues WHERE ordinal % 5 IN (1, 2)""")
def p06_export_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("number") % 5
    end = F.when(kind == 2, F.col("start") - 1).when(kind == 3, F.lit(float("nan"))).when(kind == 4, F.col("start")).otherwise(F.col("end"))
    return export.export_errors(_demo_pages(spark, sf_dir).withColumn("end", end))


def _pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which every other one shows a frame."""
    path = F.when(F.col("number") % 2 == 0, F.concat(F.lit("f"), (F.col("number") - 1).cast("string")))
    return _demo_pages(spark, sf_dir).withColumn("frame_path", path)


@query(f"""WITH {PAGE_ROWS}, p AS (SELECT video_id, number, kind, CASE WHEN number % 2 = 0 THEN 'f' || (number - 1) END AS path FROM pages_),
w AS (SELECT video_id, list('Image is missing: ' || path ORDER BY number) FILTER (path IS NOT NULL AND number % 4 <> 0) AS lost, count(*) FILTER (kind = 'content' AND (path IS NULL OR number % 4 <> 0)) AS n FROM p GROUP BY video_id)
SELECT video_id, array_to_string(list_concat(coalesce(lost, []), CASE WHEN n > 0 THEN [n || ' content pages have no source visual.'] ELSE [] END), ' | ') AS warnings FROM w""")
def p07_image_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the frames that pages show, those of every fourth page are there."""
    pages = _pictured(spark, sf_dir)
    there = pages.where("number % 4 = 0").select(F.col("frame_path").alias("path"))
    return export.image_warnings(pages, there).select("video_id", F.array_join("warnings", " | ").alias("warnings"))


QUOTE = f"array_to_string(string_split({s_fold(s_collapse('text'))}, ' ')[1:3], ' ')"


@query(f"""WITH {TURNS} SELECT video_id, ordinal AS number, CASE ordinal % 7 WHEN 0 THEN NULL WHEN 1 THEN 'the title or the summary is empty' WHEN 2 THEN 'the summary exceeds the reading budget' WHEN 3 THEN 'there must be one to three quotes'
  WHEN 4 THEN 'a quote is not in the transcript' WHEN 5 THEN 'a quote is not in the transcript' ELSE 'the summary is missing' END AS problem FROM turns""")
def p08_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each turn, which by the turn's number keeps all rules or breaks one."""
    turns = conversation_cues(spark, sf_dir)
    pages = turns.select("video_id", F.col("ordinal").alias("number"), F.col("text").alias("source_text"))
    kind = F.col("ordinal") % 7
    quote = F.upper(F.array_join(F.slice(F.split("text", " "), 1, 3), "  "))
    evidence = F.when(kind == 3, F.array().cast("array<string>")).when(kind == 4, F.array(quote, F.lit("never said by anyone"))).when(kind == 5, F.array(F.lit(" [0:00:01] "))).otherwise(F.array(quote, F.concat(F.lit("[0:00:05] "), quote)))
    bullets = F.when(kind == 2, F.array(F.lit("a"), F.lit("b"), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b")))
    made = turns.where(kind != 6).select("video_id", F.col("ordinal").alias("page_id"), F.when(kind == 1, "  ").otherwise("Title").alias("title"), F.lit("A summary.").alias("summary"), bullets.alias("bullets"), *[F.lit("").alias(c) for c in ("takeaway", "chapter", "uncertainty")], evidence.alias("evidence"))
    return summaries.validate(pages, made, 20).select("video_id", "number", "problem")


@query(f"""WITH {TURNS} SELECT video_id, ordinal AS number, 'T ' || ordinal AS title, trim(text[1:20]) AS summary, 'b|c' AS bullets, '' AS takeaway, 'ch' AS chapter, 'note' AS uncertainty FROM turns""")
def p09_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_cues(spark, sf_dir)
    pages = turns.select("video_id", F.col("ordinal").alias("number"), F.col("text").alias("source_text"))
    made = turns.select("video_id", F.col("ordinal").alias("page_id"), F.concat(F.lit("  T "), F.col("ordinal").cast("string")).alias("title"), F.left("text", F.lit(20)).alias("summary"), F.array(F.lit(" b "), F.lit("  "), F.lit("c")).alias("bullets"), F.lit("  ").alias("takeaway"), F.lit("ch ").alias("chapter"), F.lit(" note").alias("uncertainty"), F.array("text").alias("evidence"))
    put = summaries.apply_summaries(summaries.validate(pages, made, 99))
    return put.select("video_id", "number", "title", F.col("summary"), F.array_join("bullets", "|").alias("bullets"), "takeaway", "chapter", "uncertainty")


VISIBLE = "title || ' ' || summary || ' ' || replace(replace(ideas, '• ', ''), chr(10), ' ') || '  ' || note"


@query(f"WITH {PAGE_ROWS} SELECT video_id, number, {VISIBLE} AS shown FROM pages_")
def p10_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demo_pages(spark, sf_dir).select("video_id", "number", summaries.visible_text().alias("shown"))


@query(f"""WITH {PAGE_ROWS} SELECT video_id, number, CASE WHEN number % 3 = 0 THEN '{export.CUT_NOTE}' WHEN note <> '' THEN '{export.DOUBT_NOTE}' ELSE '{export.PLAIN_NOTE}' END AS footnote FROM pages_""")
def p13_footnote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demo_pages(spark, sf_dir).select("video_id", "number", export.footnote(F.col("number") % 3 == 0).alias("footnote"))


@query(f"""WITH {TURNS}, h AS (SELECT video_id, ordinal AS number FROM turns WHERE contains(lower(text), 'the'))
SELECT video_id, number, coalesce(lag(number) OVER w, -1) AS previous, coalesce(lead(number) OVER w, -1) AS next FROM h WINDOW w AS (PARTITION BY video_id ORDER BY number)""")
def p16_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_cues(spark, sf_dir).select("video_id", F.col("ordinal").alias("number"), "text")
    return export.neighbours(export.search_pages(pages, F.col("text"), "the")).select("video_id", "number", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


@query(f"""WITH {CUES}, m AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN ordinal // 3 + 3 END AS mark FROM cues)
SELECT video_id, ordinal, CAST(max(mark) OVER (PARTITION BY video_id ORDER BY "start") AS INTEGER) AS number FROM m""")
def j02_page_of_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = conversation_cues(spark, sf_dir)
    cuts = cues.where("ordinal % 3 = 0").select("video_id", "start", F.expr("cast(ordinal div 3 + 3 as int)").alias("number"))
    return timeline.page_of_cue(cues, cuts).select("video_id", "ordinal", "number")


# Figures and books --------------------------------------------------------------------------------------------------

FIGURES = f"""{PAGE_ROWS}, {FRAMES}, p AS (SELECT *, CASE WHEN number % 2 = 0 THEN 'f' || (number - 1) END AS path FROM pages_),
a AS (SELECT video_id, count(*) FILTER (kind = 'content') AS n_pages, CAST(sum({s_words2(VISIBLE)}) AS BIGINT) AS visible_prose_words, count(DISTINCT path) AS pictured_visual_states, count(*) FILTER (kind = 'content' AND path IS NULL) AS transcript_only_pages FROM p GROUP BY video_id),
b AS (SELECT video_id, count(*) AS caption_cues, CAST(sum({s_words2('text')}) AS BIGINT) AS source_words FROM cues GROUP BY video_id),
c AS (SELECT f.video_id, count(*) AS captured_visual_states, count(*) FILTER (p.path IS NULL) AS unpictured FROM frames f LEFT JOIN (SELECT DISTINCT video_id, path FROM p) p ON p.video_id = f.video_id AND p.path = f.path GROUP BY f.video_id),
figures AS (SELECT a.*, caption_cues, source_words, captured_visual_states, unpictured, visible_prose_words / 180 + n_pages * 6 / 60 AS estimated_reading_minutes FROM a JOIN b USING (video_id) JOIN c USING (video_id))"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.totals(_pictured(spark, sf_dir), conversation_cues(spark, sf_dir), conversation_frames(spark, sf_dir), 60.0)


@query(f"WITH {FIGURES} SELECT video_id, n_pages, visible_prose_words, pictured_visual_states, transcript_only_pages, caption_cues, source_words, captured_visual_states, unpictured, round(estimated_reading_minutes, 6) AS minutes FROM figures")
def a09_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07-A09, A11, J09."""
    return _figures(spark, sf_dir).select("video_id", "n_pages", "visible_prose_words", "pictured_visual_states", "transcript_only_pages", "caption_cues", "source_words", "captured_visual_states", "unpictured", F.round("estimated_reading_minutes", 6).alias("minutes"))


@query(f"""WITH {FIGURES} SELECT video_id, array_to_string([x FOR x IN [CASE WHEN n_pages + 2 < 12 THEN format('{book.LESS_WARNING}', n_pages + 2, 12) END, '{book.EXTRACTIVE_WARNING}',
  CASE WHEN unpictured > 0 THEN format('{book.UNPICTURED_WARNING}', unpictured) END, '{book.ESTIMATE_WARNING}'] IF x IS NOT NULL], ' | ') AS warnings FROM figures""")
def p14_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.warnings(_figures(spark, sf_dir), 12).select("video_id", F.array_join("warnings", " | ").alias("warnings"))


@query(f"""WITH {PAGE_ROWS}, v AS (SELECT video_id, count(*) AS n, max("end") AS duration FROM pages_ GROUP BY video_id)
SELECT video_id, number + 100 AS number, title, kind, summary, "start", "end" FROM pages_
UNION ALL SELECT video_id, 1, 'Talk <' || video_id || '>', 'cover', format('{book.COVER_TEXT}', n + 2, {s_clock('duration')}, '60'), 0.0, duration FROM v
UNION ALL SELECT video_id, 2, '{book.ROUTE_TITLE}', 'overview', '{book.ROUTE_TEXT}', 0.0, duration FROM v""")
def u01_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _demo_pages(spark, sf_dir).withColumn("n_pages", F.count("*").over(Window.partitionBy("video_id"))).withColumn("number", F.col("number") + 100)
    return book.assemble(content, _demo_videos(spark, sf_dir), 60.0).select("video_id", "number", "title", "kind", "summary", "start", "end")


PAGE_JSON = """{'number': number, 'title': title, 'start': "start", 'end': "end", 'summary': summary, 'bullets': [text_[1:10], 'a & b'], 'takeaway': '', 'frame_path': CAST(NULL AS VARCHAR), 'source_text': source_text, 'kind': kind, 'chapter': '', 'uncertainty': note}"""


@query(f"""WITH {PAGE_ROWS}, p AS (SELECT *, source_text AS text_ FROM pages_)
SELECT video_id, CAST(to_json({{'title': 'Talk <' || video_id || '>', 'source_url': 'https://talks.example.org/' || video_id, 'duration': max("end"), 'reading_minutes': CAST(60 AS DOUBLE), 'warnings': ['Check < this.'], 'pages': list({PAGE_JSON} ORDER BY number)}}) AS VARCHAR) AS value FROM p GROUP BY video_id""")
def k02_manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.json_books(_demo_pages(spark, sf_dir), _demo_videos(spark, sf_dir))


def _s_part(label: str, body: str) -> str:
    return f"CASE WHEN {body} = '' THEN '' ELSE '<section><h3>' || {label} || '</h3><p>' || replace({s_escape(body)}, chr(10), '<br>') || '</p></section>' END"


SPAN = f"""{s_clock('"start"')} || ' – ' || {s_clock('"end"')}"""
ARTICLES = f"""{PAGE_ROWS}, v AS (SELECT video_id, count(*) AS n, max("end") AS duration, {s_escape("'Talk <' || video_id || '>'")} AS title_ FROM pages_ GROUP BY video_id),
articles AS (SELECT video_id, number, '<article class="page" id="page-' || number || '"><p class="chapter">' || title_ || '</p><h2>' || {s_escape('title')} || '</h2>'
  || CASE kind WHEN 'cover' THEN '<div class="cover"><h2>' || title_ || '</h2><p>' || {s_clock('duration')} || ' of video · ' || n || ' pages<br>Reading target: 60 minutes</p></div>'
     WHEN 'overview' THEN '<ol class="overview"><li>' || {s_escape('source_text[1:10]')} || '</li><li>a &amp; b</li></ol>' ELSE '<div class="missing"><strong>No picture here</strong></div>' END
  || '<aside>' || {_s_part(P_LABEL, 'summary')} || CASE WHEN kind = 'overview' THEN '' ELSE {_s_part("'KEY IDEAS'", 'ideas')} END || {_s_part("'SOURCE NOTE'", 'note')}
  || '</aside><footer><a rel="noopener noreferrer" href="https://talks.example.org/' || video_id || '?t=' || CAST(trunc("start") AS BIGINT) || '">' || {SPAN} || '</a><span>' || lpad(CAST(number AS VARCHAR), 3, '0') || ' / ' || lpad(CAST(n AS VARCHAR), 3, '0')
  || '</span></footer><details><summary>Full source transcript · ' || {SPAN} || '</summary><pre>' || {s_escape('source_text')} || '</pre></details></article>' AS article FROM pages_ JOIN v USING (video_id))"""


@query(f"WITH {ARTICLES} SELECT video_id, number, article FROM articles")
def k03_html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.articles(_demo_pages(spark, sf_dir), _demo_videos(spark, sf_dir))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""WITH {ARTICLES}, b AS (SELECT video_id, string_agg(article, chr(10) ORDER BY number) AS body FROM articles GROUP BY video_id)
SELECT video_id, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || title_ || '</title><style>' || {_literal(export.STYLE)} || '</style></head><body><header><strong>' || title_
  || '</strong><input id="search" type="search" aria-label="Search"><span id="count"></span></header><main><details class="warnings"><summary>Please note (1)</summary><ul><li>Check &lt; this.</li></ul></details>'
  || body || '<p id="none" hidden>Nothing was found.</p></main><script>' || {_literal(export.SCRIPT)} || '</script></body></html>' AS value FROM b JOIN v USING (video_id)""")
def k03_html_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.html_books(_demo_pages(spark, sf_dir), _demo_videos(spark, sf_dir))


@query(f"""WITH RECURSIVE {PAGE_ROWS}, l AS (SELECT video_id, number, '[' || {s_stamp('"start"')} || '] ' || {VISIBLE} AS line, row_number() OVER (PARTITION BY video_id ORDER BY number) AS i FROM pages_),
walk AS (SELECT video_id, i, number, line, length(line) + 1 AS used, 0 AS chunk FROM l WHERE i = 1
  UNION ALL SELECT l.video_id, l.i, l.number, l.line, CASE WHEN used + length(l.line) + 1 > {summaries.MAX_CHUNK} THEN length(l.line) + 1 ELSE used + length(l.line) + 1 END, CASE WHEN used + length(l.line) + 1 > {summaries.MAX_CHUNK} THEN chunk + 1 ELSE chunk END
  FROM walk w JOIN l ON l.video_id = w.video_id AND l.i = w.i + 1)
SELECT video_id, CAST(chunk AS INTEGER) AS chunk, string_agg(line, chr(10) ORDER BY number) AS source_text, CAST(count(*) OVER (PARTITION BY video_id) AS BIGINT) AS chunks FROM walk GROUP BY video_id, chunk""")
def a12_overview_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.overview_source(_demo_pages(spark, sf_dir))


# Functions ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {s_collapse('text')} AS clean FROM documents")
def f04_clean_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F04 by the reader of all entities: it undoes the escaping of any text."""
    written = F.concat(F.lit("<p class='a'>"), text.escape_html(F.col("text")), F.lit("</p>&NewLine;&#9;"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(written, exact=True).alias("clean"))


@query(f"SELECT doc_id, sha256({s_fold('text')}) AS folded FROM documents")
def f09_casefold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_key(text.casefold(F.col("text"), exact=True)).alias("folded"))


@query("SELECT page_id, 'https://www.youtube.com/watch?v=id-' || page_id || '&t=' || page_id AS link FROM pages")
def f14_video_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the forms of one video's address all become one."""
    kind, name = F.col("page_id") % 5, F.concat(F.lit("id-"), F.col("page_id").cast("string"))
    forms = [("https://m.youtube.com/watch?list=PL1&v=", "&index=2"), ("http://youtu.be/", "?si=abc"), ("https://www.youtube.com/shorts/", "?feature=x#top"), ("https://WWW.YouTube.com/embed/", "/"), ("https://youtube.com/live/", "?t=99")]
    url = F.coalesce(*[F.when(kind == i, F.concat(F.lit(a), name, F.lit(b))) for i, (a, b) in enumerate(forms)])
    return table(spark, sf_dir, "pages").select("page_id", links.source_link(url, F.col("page_id") + 0.75).alias("link"))


@query("SELECT doc_id, printf('%g', CAST(doc_id AS DOUBLE) / 7 * pow(CAST(10 AS DOUBLE), CAST(doc_id % 15 - 7 AS DOUBLE))) AS short, printf('%g', CAST(doc_id * 250000 AS DOUBLE)) AS whole FROM documents")
def f18_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id").cast("double")
    value = d / 7 * F.pow(F.lit(10.0), (F.col("doc_id") % 15 - 7).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", text.general(value).alias("short"), text.general(d * 250000).alias("whole"))


@query("SELECT page_id, '''' || replace(url || '''s', '''', '''\\''''') || '''' AS quoted FROM pages")
def f22_quote_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.quote_path(F.concat("url", F.lit("'s"))).alias("quoted"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^\x{20}-\x{7e}]'))), '') AS lacking, regexp_replace(text, '[^\x{20}-\x{7e}]', '?', 'g') AS shown FROM documents")
def u05_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that a font of ASCII alone lacks, and the text without them."""
    ascii_ = r"\x{20}-\x{7e}"
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(export.unsupported(F.col("text"), ascii_)), "").alias("lacking"), export.substitute(F.col("text"), ascii_).alias("shown"))


def _s_advance(c: str) -> str:
    """The advance of a character by the table of layout.py, whose rule for accents is DuckDB's."""
    cases = " ".join(f"WHEN contains({_literal(chars)}, strip_accents({c})) THEN {w}" for w, chars in layout.ADVANCES.items())
    return f"CASE {cases} ELSE {layout.OTHER} END"


@query(f"""WITH RECURSIVE {TURNS}, chars AS (SELECT DISTINCT unnest(regexp_extract_all(text, '.')) AS c FROM turns), font AS (SELECT map_from_entries(list((c, {_s_advance('c')}))) AS f FROM chars),
w AS (SELECT video_id, ordinal, string_split(text, ' ') AS words FROM turns),
a AS (SELECT video_id, ordinal, list_transform(words, lambda x: CAST(list_sum(list_transform(regexp_extract_all(x, '.'), lambda c: f[c])) AS BIGINT)) AS widths FROM w, font),
sizes AS (SELECT 12 + i / 2 AS size, 276 / (12 + i / 2) * 1000 AS room FROM range(9) AS r(i)),
walk AS (SELECT video_id, ordinal, widths, size, room, 1 AS i, widths[1] AS used, 1 AS lines FROM a, sizes
  UNION ALL SELECT video_id, ordinal, widths, size, room, i + 1, CASE WHEN used + 278 + widths[i + 1] <= room + 1e-6 THEN used + 278 + widths[i + 1] ELSE widths[i + 1] END, CASE WHEN used + 278 + widths[i + 1] <= room + 1e-6 THEN lines ELSE lines + 1 END FROM walk WHERE i < len(widths)),
ends AS (SELECT video_id, ordinal, size, max(lines) AS lines FROM walk GROUP BY ALL)
SELECT video_id, ordinal, CAST(max(lines) FILTER (size = 16) AS INTEGER) AS lines_16, CAST(max(lines) FILTER (size = 12) AS INTEGER) AS lines_12, CAST(coalesce(max(size) FILTER (lines * size * {layout.LINE} <= 120), 12) AS DOUBLE) AS size FROM ends GROUP BY ALL""")
def f21_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each turn's lines in a column of 276 points, and its largest size in a box 120 points high."""
    cues = conversation_cues(spark, sf_dir)
    column = export.TEXT_BOX[2]
    fit = layout.fitted(F.array("text"), column, 120.0, export.TEXT_SIZES)
    return cues.select("video_id", "ordinal", layout.line_count(F.col("text"), column, 16).alias("lines_16"), layout.line_count(F.col("text"), column, 12).alias("lines_12"), fit.size.alias("size"))


@query(f"""WITH {PAGE_ROWS} SELECT video_id, CAST(count(*) AS INTEGER) AS n_pages, true AS whole FROM pages_ GROUP BY video_id""")
def k05_pdf_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book as a PDF; whole: header, end and page tree agree."""
    videos = _demo_videos(spark, sf_dir)
    made = pdf.pdf_books(export.slides(_demo_pages(spark, sf_dir), videos), videos)
    body = F.decode("content", "ISO-8859-1")
    whole = F.startswith(body, F.lit("%PDF-1.4")) & F.endswith(body, F.lit("%%EOF\n")) & F.contains(body, F.concat(F.lit("/Count "), F.col("n_pages").cast("string"), F.lit(" >>")))
    return made.select("video_id", "n_pages", whole.alias("whole"))


@query(f"""WITH {LINKED}, b AS (SELECT *, {P_NOTES} AS notes, unnest(list_concat([{{'box': 'title', 'label': '', 'body': title, 'size': 27.0}}],
  [x FOR x IN [{{'box': 'section', 'label': {P_LABEL}, 'body': summary, 'size': 16.0}}, {{'box': 'section', 'label': 'KEY IDEAS', 'body': CASE WHEN kind = 'overview' THEN '' ELSE ideas END, 'size': 16.0}}, {{'box': 'section', 'label': 'SOURCE NOTE', 'body': note, 'size': 16.0}}] IF x.body <> ''],
  [{{'box': 'footnote', 'label': '', 'body': CASE WHEN note <> '' THEN '{export.DOUBT_NOTE}' ELSE '{export.PLAIN_NOTE}' END, 'size': 9.0}}])) AS x FROM t)
SELECT video_id, number, CAST(row_number() OVER (PARTITION BY video_id, number ORDER BY CASE x.box WHEN 'title' THEN 0 WHEN 'section' THEN 1 ELSE 2 END, strpos('{export.IDEAS}{export.NOTE}', x.label) + CASE WHEN x.label IN ('{export.IDEAS}', '{export.NOTE}') THEN 1 ELSE 0 END) - 1 AS INTEGER) AS position,
  x.box AS box, x.label AS label, x.body AS body, CAST(x.size AS DOUBLE) AS size, CAST(NULL AS VARCHAR) AS frame_path, link, notes, false AS shortened FROM b""")
def k04_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of all pages; these texts fit at the largest sizes, others are held against a model in tests."""
    return export.slides(_demo_pages(spark, sf_dir), _demo_videos(spark, sf_dir))
