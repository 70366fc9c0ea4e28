"""Registered queries of page plans and whole books, and recursive SQL that walks from cut to cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import summaries, timeline
from .operators.summaries import OVERVIEW_CHAPTER
from .plans import book, planner
from .queries import FRAMES, PAGE_ROWS, PREFIX, TURNS, _demo_pages, _demo_videos, query, s_stamp
from .sources.fixtures import conversation_cues, conversation_frames, table

TARGET = 198
W, T, REACH, BONUS = (f"CAST({x} AS DOUBLE)" for x in (planner.WORD_WEIGHT, planner.TIME_WEIGHT, planner.REACH, planner.BONUS))
#: What can be known of each cut beforehand, and the walk that knows the cut before: (video_id, k, g, t), k from 0.
WALK = f"""{PREFIX}, {FRAMES},
gaps AS (SELECT *, least(end_before, "start") AS gap_from, CASE WHEN g = 0 THEN 0.0 ELSE (least(end_before, "start") + "start") / 2 END AS middle FROM prefixes),
asked AS (SELECT *, least({TARGET}, greatest(1, total_words // {planner.MIN_SOURCE_WORDS}), nonempty) AS pages FROM totals WHERE total_words > 0),
m AS (SELECT g.*, duration, total_words, nonempty, pages, {W} * words_before / total_words + {T} * middle / duration AS mass FROM gaps g JOIN asked USING (video_id)),
ideals AS (SELECT video_id, pages, unnest(range(1, pages)) AS k FROM asked),
nearest AS (SELECT i.video_id, i.k, count(*) FILTER (m.mass < CAST(i.k AS DOUBLE) / i.pages) AS near FROM ideals i JOIN m USING (video_id) GROUP BY ALL),
wanted AS (SELECT m.*, k, near, CAST(k AS DOUBLE) / m.pages AS ideal FROM m JOIN nearest USING (video_id) WHERE nonempty_before <= nonempty - m.pages + k),
even AS (SELECT *, (ideal - {W} * words_before / total_words) * duration / {T} AS balanced FROM wanted),
within AS (SELECT e.video_id, e.k, e.g, max(f.ts) FILTER (f.ts < balanced) AS below, min(f.ts) FILTER (f.ts >= balanced) AS above FROM even e JOIN frames f ON f.video_id = e.video_id AND f.ts BETWEEN gap_from AND "start" AND gap_from < "start" GROUP BY ALL),
places AS (SELECT *, middle AS t, false AS own FROM even UNION ALL SELECT *, "start", true FROM even
  UNION ALL SELECT e.*, below, false FROM even e JOIN within USING (video_id, k, g) WHERE below IS NOT NULL UNION ALL SELECT e.*, above, false FROM even e JOIN within USING (video_id, k, g) WHERE above IS NOT NULL),
apart AS (SELECT p.video_id, p.t, min(abs(f.ts - p.t)) AS d FROM (SELECT DISTINCT video_id, t FROM places) p LEFT JOIN frames f USING (video_id) GROUP BY ALL),
options AS (SELECT p.*, mass BETWEEN ideal - {REACH} / pages AND ideal + {REACH} / pages AS close,
  pow(({W} * words_before / total_words + {T} * p.t / duration - ideal) * pages, 2) - {BONUS} * greatest(0, 1 - coalesce(d / {planner.CLOSE}, 1)) AS cost FROM places p LEFT JOIN apart USING (video_id, t)),
walk AS (
  SELECT video_id, CAST(0 AS BIGINT) AS k, CAST(0 AS INTEGER) AS g, CAST(0 AS DOUBLE) AS t, CAST(0 AS BIGINT) AS behind FROM asked
  UNION ALL
  SELECT video_id, k, g, CASE WHEN usable THEN t ELSE "start" END, nonempty_before FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY usable DESC, CASE WHEN usable THEN cost ELSE 0 END, g, CASE WHEN usable OR own THEN 0 ELSE 1 END, t) AS r FROM (
      SELECT *, t > before AND t < duration AND CASE WHEN any_close THEN close ELSE g BETWEEN least(greatest(near, first), last) - 1 AND least(greatest(near, first), last) + 1 END AS usable FROM (
        SELECT o.*, w.t AS before, bool_or(close) OVER v AS any_close, min(o.g) OVER v AS first, max(o.g) OVER v AS last
        FROM walk w JOIN options o ON o.video_id = w.video_id AND o.k = w.k + 1 AND o.nonempty_before > w.behind WINDOW v AS (PARTITION BY o.video_id))))
  WHERE r = 1),
cuts AS (SELECT w.video_id, CAST(w.k + 3 AS INTEGER) AS number, w.t AS "start", coalesce(lead(w.t) OVER (PARTITION BY w.video_id ORDER BY w.k), a.duration) AS "end", g."start" AS first_start
  FROM walk w JOIN asked a USING (video_id) JOIN gaps g ON g.video_id = w.video_id AND g.g = w.g)"""
PAGES = f"""{WALK},
turned AS (SELECT c.*, max(u.number) OVER (PARTITION BY c.video_id ORDER BY c."start") AS number FROM cues c LEFT JOIN cuts u ON u.video_id = c.video_id AND u.first_start = c."start"),
texts AS (SELECT video_id, number, string_agg('[' || {s_stamp('"start"')} || '] ' || text, chr(10) ORDER BY "start", "end", ordinal) AS source_text FROM turned GROUP BY ALL),
spans AS (SELECT f.*, coalesce(lead(ts) OVER (PARTITION BY f.video_id ORDER BY ts, ordinal), duration) AS until FROM frames f JOIN totals USING (video_id)),
met AS (SELECT u.video_id, u.number, s.path, row_number() OVER (PARTITION BY u.video_id, u.number ORDER BY least(u."end", s.until) - greatest(u."start", s.ts) DESC, s.ts, s.ordinal) AS i
  FROM cuts u JOIN spans s ON s.video_id = u.video_id AND s.ts < u."end" AND s.until > u."start"),
planned AS (SELECT u.video_id, u.number, u."start", u."end", m.path AS frame_path, t.source_text FROM cuts u JOIN texts t USING (video_id, number) LEFT JOIN met m ON m.video_id = u.video_id AND m.number = u.number AND m.i = 1)"""


@query(f'WITH RECURSIVE {WALK} SELECT video_id, number, "start", "end", first_start FROM cuts')
def w09_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = conversation_cues(spark, sf_dir)
    return planner.plan_cuts(cues, conversation_frames(spark, sf_dir), planner.durations_of(cues), TARGET)


def _with_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' cues, each of which ends early, so that there are silences to cut in."""
    return conversation_cues(spark, sf_dir).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 0.75)


@query(f"WITH RECURSIVE {WALK} SELECT video_id, number, \"start\", \"end\", first_start FROM cuts".replace("cues AS (", "spoken AS (", 1).replace("groups AS (", 'cues AS (SELECT * REPLACE ("start" + ("end" - "start") * CAST(0.75 AS DOUBLE) AS "end") FROM spoken), groups AS (', 1))
def w09_cuts_in_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With silences between cues, in whose middle, at whose end, or at a change within, cuts may lie."""
    cues = _with_silences(spark, sf_dir)
    shown = cues.where("ordinal % 3 <> 1").select("video_id", "ordinal", ((F.col("start") + F.col("end")) / 2).alias("ts"), F.concat(F.lit("f"), F.col("ordinal").cast("string")).alias("path"))
    return planner.plan_cuts(cues, shown, planner.durations_of(cues), TARGET)


@query(f"""WITH RECURSIVE {PAGES} SELECT video_id, number, 'Section ' || (number - 2) AS title, "start", "end", frame_path, source_text, 'content' AS kind FROM planned""")
def w11_plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = conversation_cues(spark, sf_dir)
    pages = planner.plan_pages(cues, conversation_frames(spark, sf_dir), planner.durations_of(cues), TARGET)
    return pages.select("video_id", "number", "title", "start", "end", "frame_path", "source_text", "kind")


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cues = conversation_cues(spark, sf_dir)
    return book.build(cues, conversation_frames(spark, sf_dir), _demo_videos(spark, sf_dir).select("video_id", "title", "source_url"))


@query(f"""WITH RECURSIVE {PAGES}, n AS (SELECT video_id, count(*) AS n FROM planned GROUP BY video_id)
SELECT video_id, number, 'Transcript excerpt ' || (number - 2) AS title, "start", "end", frame_path, sha256(source_text) AS source, 'content' AS kind, 'Transcript excerpts' AS chapter, 'Excerpt; no AI summary.' AS note, '' AS points FROM planned
UNION ALL SELECT video_id, 1, 'Talk <' || video_id || '>', 0.0, duration, NULL, sha256(''), 'cover', '', '', '{" | ".join(book.COVER_POINTS)}' FROM totals JOIN n USING (video_id)
UNION ALL SELECT video_id, 2, '{book.ROUTE_TITLE}', 0.0, duration, NULL, sha256(''), 'overview', '{OVERVIEW_CHAPTER}', '', '{" | ".join(book.ROUTE_POINTS)}' FROM totals JOIN n USING (video_id)""")
def x06_build_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books of excerpts; f12_excerpt holds the excerpts themselves."""
    pages, _ = _books(spark, sf_dir)
    return pages.select("video_id", "number", "title", "start", "end", "frame_path", F.sha2(F.col("source_text").cast("binary"), 256).alias("source"), "kind", "chapter", F.col("uncertainty").alias("note"), F.array_join("bullets", " | ").alias("points"))


@query(f"""WITH RECURSIVE {PAGES}, c AS (SELECT video_id, count(*) AS caption_cues FROM cues GROUP BY video_id), f AS (SELECT f.video_id, count(*) AS captured, count(*) FILTER (p.path IS NULL) AS lost FROM frames f LEFT JOIN (SELECT DISTINCT video_id, frame_path AS path FROM planned) p USING (video_id, path) GROUP BY f.video_id),
p AS (SELECT video_id, count(*) AS n_pages, count(DISTINCT frame_path) AS pictured, count(*) FILTER (frame_path IS NULL) AS words_only FROM planned GROUP BY video_id)
SELECT video_id, 'Talk <' || video_id || '>' AS title, duration, n_pages, pictured, words_only, caption_cues, captured, lost, CAST(least(65, trunc((60.0 * 180 - 180 - n_pages * 6 * 3) / n_pages)) AS INTEGER) AS max_words,
  array_to_string([x FOR x IN [CASE WHEN n_pages + 2 < 200 THEN format('{book.LESS_WARNING}', n_pages + 2, 200) END, '{book.EXTRACTIVE_WARNING}', CASE WHEN lost > 0 THEN format('{book.UNPICTURED_WARNING}', lost) END, '{book.ESTIMATE_WARNING}'] IF x IS NOT NULL], ' | ') AS warnings
FROM p JOIN totals USING (video_id) JOIN c USING (video_id) JOIN f USING (video_id)""")
def x06_book_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's figures and warnings."""
    _, videos = _books(spark, sf_dir)
    return videos.select(
        "video_id", "title", "duration", "n_pages", F.col("pictured_visual_states").alias("pictured"), F.col("transcript_only_pages").alias("words_only"), "caption_cues",
        F.col("captured_visual_states").alias("captured"), F.col("unpictured").alias("lost"), "max_words", F.array_join("warnings", " | ").alias("warnings"),
    )


BUDGET = "SELECT conv_id AS video_id, count(*) AS n_pages, CAST(max(turn) + 1 AS BIGINT) AS turns, conv_id % 2 = 0 AS has_frames FROM conversations GROUP BY conv_id"


@query(f"SELECT video_id, minutes, CAST(least(65, trunc((minutes * 180.0 - 180 - n_pages * (CASE WHEN has_frames THEN 6 ELSE 0 END) * 3) / n_pages)) AS INTEGER) AS max_words FROM ({BUDGET}), (VALUES (2), (3), (30)) m(minutes)")
def a10_word_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the words a page may show, if each turn of a conversation were a page, for three reading times."""
    pages = conversation_cues(spark, sf_dir).select("video_id", F.col("ordinal").alias("number"))
    frames = conversation_cues(spark, sf_dir).where("video_id % 2 = 0").select("video_id")
    made = [book.with_budgets(pages, frames, float(m)).select("video_id", F.lit(m).alias("minutes"), "max_words").distinct() for m in (2, 3, 30)]
    return made[0].unionByName(made[1]).unionByName(made[2])


LESSON = "SELECT d.doc_id, least(8, 1 + d.doc_id % 8) AS steps FROM documents d"


@query(f"""WITH l AS ({LESSON}) SELECT doc_id AS video_id, CAST(i AS INTEGER) AS ordinal, i * 12.0 AS "start", i * 12.0 + 11.5 AS "end" FROM l, range(8) AS r(i) WHERE i < steps""".replace("12.0", "CAST(12 AS DOUBLE)"))
def s21_demo_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The made-up course, as many of whose steps as a document's number says: the times of its cues."""
    from .sources import fixtures

    course = fixtures.demo_cues(spark).select(F.col("ordinal"), "start", "end")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.least(F.lit(8), 1 + F.col("doc_id") % 8).alias("steps"))
    return docs.join(F.broadcast(course), F.col("ordinal") < F.col("steps")).select("video_id", "ordinal", "start", "end")


@query(f"""WITH RECURSIVE {PAGES} SELECT f.video_id, f.path, f.ordinal, f.ts FROM frames f LEFT JOIN (SELECT DISTINCT video_id, frame_path FROM planned) p ON p.video_id = f.video_id AND p.frame_path = f.path WHERE p.video_id IS NULL""")
def j09_unpictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that no page of the plan shows."""
    cues, frames = conversation_cues(spark, sf_dir), conversation_frames(spark, sf_dir)
    pages = planner.plan_pages(cues, frames, planner.durations_of(cues), TARGET)
    return timeline.unpictured(frames, pages).select("video_id", "path", "ordinal", "ts")


@query(f"""WITH {TURNS}, t AS (SELECT *, (video_id + ordinal) % 8 AS fault FROM turns)
SELECT video_id, CAST(ordinal AS INTEGER) AS number, CASE fault WHEN 0 THEN 'the summary is missing' WHEN 1 THEN 'the title or the summary is empty' WHEN 2 THEN 'the summary exceeds the reading budget' WHEN 3 THEN 'there must be one to three quotes'
  WHEN 4 THEN 'a quote is not in the transcript' WHEN 5 THEN 'a quote is not in the transcript' WHEN 6 THEN 'the summary exceeds the reading budget' ELSE '' END AS problem FROM t
UNION ALL SELECT video_id, CAST(ordinal + 1000 AS INTEGER), 'there is no such page' FROM t WHERE fault = 7""")
def j05_summary_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with a fault of each kind, and some of pages that are not there; sound ones have none."""
    turns = conversation_cues(spark, sf_dir).withColumn("fault", (F.col("video_id") + F.col("ordinal")) % 8)
    is_ = lambda n: F.col("fault") == n
    start = F.trim(F.left("text", F.lit(12)))
    bullets = F.when(is_(2), F.array(*[F.lit(x) for x in "abc"])).otherwise(F.array().cast("array<string>"))
    quotes = F.when(is_(3), F.array().cast("array<string>")).when(is_(4), F.array(F.concat(start, F.lit(" zq zq")))).when(is_(5), F.array(start, F.lit("[00:00:01] "))).otherwise(F.array(start))
    made = turns.where("fault <> 0").select(
        "video_id", F.col("ordinal").alias("page_id"), F.when(is_(1), " ").otherwise("t").alias("title"), F.when(is_(6), F.repeat(F.lit("word "), 65)).otherwise(F.lit("s")).alias("summary"), bullets.alias("bullets"),
        *[F.lit("").alias(c) for c in ("takeaway", "chapter", "uncertainty")], quotes.alias("evidence"), "fault",
    )
    made = made.unionByName(made.where(is_(7)).withColumn("page_id", F.col("page_id") + 1000)).drop("fault")
    checked = summaries.validate(turns.select("video_id", F.col("ordinal").alias("number"), F.col("text").alias("source_text")), made, 65)
    return checked.select("video_id", "number", F.coalesce("problem", F.lit("")).alias("problem"))


class Quoting:
    """A provider that quotes: its first answer for a batch that begins at an even page breaks a rule, and it tells how often it was asked."""

    name, version = "quoting", "1"

    def summarize(self, records: list[dict], max_words: int, feedback: str | None) -> list[dict]:
        wrong = feedback is None and records[0]["page_id"] % 2 == 0
        quote = lambda r: "never said at all" if wrong else " ".join(r["source_text"].split(" ")[:3])
        told = "first" if feedback is None else "after: " + feedback.partition(": ")[2]
        return [{"page_id": r["page_id"], "title": f"Page {r['page_id']}", "summary": told, "bullets": [], "takeaway": "", "chapter": "", "uncertainty": "", "evidence": [quote(r)]} for r in records]


@query(f"""WITH {PAGE_ROWS}, b AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY number) - 1) // 3 AS batch FROM pages_), f AS (SELECT *, min(number) OVER (PARTITION BY video_id, batch) AS first FROM b)
SELECT video_id, CAST(number AS INTEGER) AS page_id, 'Page ' || number AS title, CASE WHEN first % 2 = 0 THEN 'after: a quote is not in the transcript' ELSE 'first' END AS summary, array_to_string(string_split(source_text, ' ')[1:3], ' ') AS quote FROM f""")
def x03_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages summarized in batches of three, of which those with a wrong quote are asked again and told so."""
    made = summaries.summarize(_demo_pages(spark, sf_dir), Quoting(), 65, batch_size=3)
    return made.select("video_id", "page_id", "title", "summary", F.array_join("evidence", " | ").alias("quote"))
