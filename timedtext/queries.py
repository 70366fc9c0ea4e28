"""Registered queries of the timed-text operators, and the SQL they are compared with.

models in tests/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import links, text
from .operators import dedup, sampling, timeline
from .plans import planner
from .sinks import export
from .sources import tracks
from .sources.fixtures import conversation_cues, conversation_frames, event_samples, rolling_cues, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL building blocks: the same patterns as the Column functions.
def s_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{text.SPACE}]+', ' ', 'g'))"


def s_words(x: str) -> str:
    """RE2 has no class intersection, so CJK characters are set apart first."""
    return f"CAST(len(regexp_extract_all(regexp_replace({x}, '([{text.CJK}])', ' \\1 ', 'g'), '[{text.CJK}]|[{text.LETTER}]+(?:[''’][{text.LETTER}]+)*')) AS INTEGER)"


def s_words2(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[{text.CJK_SUMMARY}]|[{text.LETTER}]+(?:[''’][{text.LETTER}]+)*')) AS INTEGER)"


def s_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def s_key(x: str) -> str:
    return s_fold(f"regexp_replace({x}, '^[^{text.LETTER}_]+|[^{text.LETTER}_]+$', '', 'g')")


def s_stamp(x: str) -> str:
    t = f"CAST(greatest(trunc({x}), 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60)"


def s_clock(x: str) -> str:
    t = f"CAST(greatest(trunc({x}), 0) AS BIGINT)"
    return f"CASE WHEN {t} >= 3600 THEN printf('%d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60) ELSE printf('%d:%02d', {t} // 60, {t} % 60) END"


def s_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


TURNS = f"turns AS (SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS ordinal, {s_collapse('text')} AS text FROM conversations)"
CUES = f"""{TURNS},
sized AS (SELECT *, greatest(1, {s_words('text')}) AS w FROM turns),
cues AS (SELECT video_id, ordinal, text, CAST(0.5 * (sum(w) OVER p - w) AS DOUBLE) AS "start", CAST(0.5 * sum(w) OVER p AS DOUBLE) AS "end"
  FROM sized WINDOW p AS (PARTITION BY video_id ORDER BY ordinal))"""
GROUPS = f"""{CUES},
groups AS (SELECT video_id, "start", CAST(sum(CASE WHEN trim(text) <> '' THEN greatest(1, {s_words('text')}) ELSE 0 END) AS INTEGER) AS words, max("end") AS "end", CAST(count(*) AS INTEGER) AS cues,
  CAST(row_number() OVER (PARTITION BY video_id ORDER BY "start") - 1 AS INTEGER) AS g FROM cues GROUP BY video_id, "start")"""
PREFIX = f"""{GROUPS},
prefixes AS (SELECT *, CAST(coalesce(sum(words) OVER b, 0) AS BIGINT) AS words_before, CAST(coalesce(sum(CAST(words > 0 AS INTEGER)) OVER b, 0) AS BIGINT) AS nonempty_before, coalesce(max("end") OVER b, 0.0) AS end_before
  FROM groups WINDOW b AS (PARTITION BY video_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT video_id, max("end") AS duration, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(CAST(words > 0 AS INTEGER)) AS BIGINT) AS nonempty FROM groups GROUP BY video_id)"""
FRAMES = """frames AS (SELECT video_id, ordinal, ("start" + "end") / 2 AS ts, 'f' || ordinal AS path FROM cues WHERE ordinal % 3 <> 1)"""
SAMPLES = """samples AS (SELECT user_id AS video_id, event_id AS ordinal, CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts) OVER (PARTITION BY user_id))) AS BIGINT) AS DOUBLE) AS ts, value FROM events)"""


@query(f"SELECT conv_id, turn, {s_words('text')} AS n FROM conversations")
def f01_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.count_words(F.col("text")).alias("n"))


@query(f"SELECT doc_id, {s_words2('text')} AS n FROM documents")
def f02_word_count_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@query(f"WITH {CUES} SELECT video_id, ordinal, CAST(trunc(\"start\" * 100) AS DOUBLE) AS seconds FROM cues")
def f03_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_cues(spark, sf_dir).select("video_id", "ordinal", text.seconds(text.stamp(F.col("start") * 100)).alias("seconds"))


def _s_clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in text.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return s_collapse(x)


@query(f"SELECT page_id, {_s_clean('html')} AS clean FROM pages")
def f04_clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


@query(f"WITH {TURNS} SELECT video_id, ordinal, CAST(i - 1 AS INTEGER) AS at, {s_key('w')} AS key FROM (SELECT video_id, ordinal, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM turns)")
def f05_word_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = conversation_cues(spark, sf_dir).select("video_id", "ordinal", F.posexplode(F.split("text", " ")).alias("at", "w"))
    return words.select("video_id", "ordinal", "at", text.word_key(F.col("w")).alias("key"))


@query(f"WITH {CUES} SELECT video_id, ordinal, {s_stamp(chr(34) + 'start' + chr(34) + ' * 100')} AS stamp, {s_clock(chr(34) + 'start' + chr(34) + ' * 100')} AS clock FROM cues")
def f06_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("start") * 100
    return conversation_cues(spark, sf_dir).select("video_id", "ordinal", text.stamp(t).alias("stamp"), text.clock(t).alias("clock"))


@query(f"SELECT doc_id, {s_collapse('text')} AS text FROM documents")
def f08_collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("text"))


@query(f"SELECT doc_id, sha256({s_fold('text')}) AS folded FROM documents")
def f09_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_key(text.casefold(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, {s_fold(s_collapse(f'regexp_replace(text, {chr(39)}{text.STAMP}{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})'))} AS text FROM documents")
def f10_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalized(F.col("text")).alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {s_collapse('text')} AS text, 30 - {s_words2("'Transcript excerpt ' || doc_id || ' Excerpt; no AI summary.'")} AS room FROM documents),
w AS (SELECT doc_id, text, room, unnest(string_split(text, ' ')[1:greatest(room, 1)]) AS word, generate_subscripts(string_split(text, ' ')[1:greatest(room, 1)], 1) AS i FROM t),
c AS (SELECT *, sum({s_words2('word')}) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM w),
k AS (SELECT doc_id, any_value(text) AS text, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (total <= room), '') AS body FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN text = '' OR body = text THEN text ELSE body || '…' END AS excerpt FROM k""")
def f12_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Transcript excerpt "), F.col("doc_id").cast("string"))
    return text.with_excerpt(table(spark, sf_dir, "documents").select("doc_id", "text"), "excerpt", F.col("text"), 30, title).select("doc_id", "excerpt")


@query(r"""WITH c AS (SELECT doc_id, text, text[1:139] AS cut FROM documents),
b AS (SELECT *, 139 - strpos(reverse(cut), ' ') AS s FROM c)
SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE rtrim(CASE WHEN strpos(cut, ' ') > 0 AND s > length(cut) * 0.6 THEN cut[1:s] ELSE cut END, ' .' || chr(10)) || '…' END AS short FROM b""")
def f13_shorten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text"), 140).alias("short"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN regexp_extract(url, '^[^?#]*') || '?'
  || CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN regexp_extract(url, '\?([^#]*)', 1) || '&' ELSE '' END || 't=' || page_id END AS link FROM pages""")
def f14_source_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.source_link(F.col("url"), F.col("page_id").cast("double")).alias("link"))


@query(f"SELECT page_id, {s_escape('html')} AS escaped FROM pages")
def f15_escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("SELECT doc_id, sha256(text)[1:16] AS key, 'data:text/plain;base64,' || to_base64(encode(lang)) AS url FROM documents")
def f16_content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text"), 16).alias("key"), text.data_url(F.col("lang").cast("binary"), F.lit("text/plain")).alias("url"))


REWRITES = [(r"\bthe\b", "a"), (r"\ba\b", "one"), (r"\bone\b of", "some of")]


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\bthe\\b', 'a', 'g'), '\\ba\\b', 'one', 'g'), '\\bone\\b of', 'some of', 'g') AS text FROM documents WHERE lang = 'en'")
def f19_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select("doc_id", text.rewrite(F.col("text"), REWRITES).alias("text"))


@query(f'WITH {GROUPS} SELECT video_id, g, "start", "end", words, cues FROM groups')
def a02_start_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.start_groups(conversation_cues(spark, sf_dir)).select("video_id", "g", "start", "end", "words", "cues")


@query(f"WITH {PREFIX} SELECT video_id, duration, total_words, nonempty, CAST(least(198, greatest(1, total_words // 40), nonempty) AS INTEGER) AS page_count FROM totals WHERE total_words > 0")
def a05_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.page_counts(conversation_cues(spark, sf_dir), 198)


@query(f"""WITH {CUES} SELECT video_id, string_agg('[' || {s_stamp(chr(34) + 'start' + chr(34))} || '] ' || text, chr(10) ORDER BY "start", "end", ordinal) AS source_text FROM cues GROUP BY video_id""")
def a06_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.stamped_text(conversation_cues(spark, sf_dir), "video_id")


@query(f"WITH {CUES}, {FRAMES} SELECT c.video_id, caption_cues, source_words, coalesce(captured, 0) AS captured FROM (SELECT video_id, count(*) AS caption_cues, CAST(sum({s_words2('text')}) AS BIGINT) AS source_words FROM cues GROUP BY video_id) c LEFT JOIN (SELECT video_id, count(*) AS captured FROM frames GROUP BY video_id) f USING (video_id)")
def a08_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, frames = conversation_cues(spark, sf_dir), conversation_frames(spark, sf_dir)
    counted = cues.groupBy("video_id").agg(F.count("*").alias("caption_cues"), F.sum(text.word_count(F.col("text"))).alias("source_words"))
    return counted.join(frames.groupBy("video_id").agg(F.count("*").alias("captured")), "video_id", "left").withColumn("captured", F.coalesce("captured", F.lit(0)))


@query(f"WITH {PREFIX} SELECT video_id, g, words_before, nonempty_before, end_before FROM prefixes")
def w01_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.prefix_sums(timeline.start_groups(conversation_cues(spark, sf_dir))).select("video_id", "g", "words_before", "nonempty_before", "end_before")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.gaps(timeline.prefix_sums(timeline.start_groups(conversation_cues(spark, sf_dir))))


@query(f'WITH {PREFIX} SELECT video_id, g, least(end_before, "start") AS gap_from, "start", CASE WHEN g = 0 THEN 0.0 ELSE (least(end_before, "start") + "start") / 2 END AS base_time FROM prefixes')
def w03_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("video_id", "g", "gap_from", "start", "base_time")


@query(f"""WITH {PREFIX}, gaps AS (SELECT *, CASE WHEN g = 0 THEN 0.0 ELSE (least(end_before, "start") + "start") / 2 END AS base_time FROM prefixes)
SELECT video_id, g, round(CAST(0.85 AS DOUBLE) * words_before / total_words + CAST(0.15 AS DOUBLE) * base_time / duration, 9) AS mass FROM gaps JOIN totals USING (video_id)""")
def w04_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_mass = timeline.masses(_gaps(spark, sf_dir), timeline.extents(conversation_cues(spark, sf_dir)))
    return with_mass.select("video_id", "g", F.round("mass", 9).alias("mass"))


@query(f"""WITH docs AS (SELECT doc_id AS video_id, [w FOR w IN string_split({s_collapse('text')}, ' ') IF w <> ''] AS words FROM documents),
starts AS (SELECT video_id, words, unnest(range(0, CAST((len(words) - 1) // 4 + 1 AS BIGINT))) AS i FROM docs WHERE len(words) > 0),
cues AS (SELECT video_id, CAST(i AS INTEGER) AS ordinal, CAST(i AS DOUBLE) AS "start", CAST(i + 1.5 AS DOUBLE) AS "end", words[i * 4 + 1 : i * 4 + 8] AS w FROM starts),
keyed AS (SELECT *, [{s_key('x')} FOR x IN w] AS k FROM cues),
near AS (SELECT *, CASE WHEN "start" <= lag("end") OVER o + 0.1 THEN lag(k) OVER o END AS p FROM keyed WINDOW o AS (PARTITION BY video_id ORDER BY "start", "end", ordinal)),
found AS (SELECT *, coalesce([n FOR n IN range(CAST(least(len(p), len(k)) AS BIGINT), 0, -1) IF p[len(p) - n + 1 : len(p)] = k[1 : n]][1], 0) AS n FROM near),
cut AS (SELECT *, CASE WHEN n >= 2 OR n = len(k) THEN n ELSE 0 END AS c FROM found),
island AS (SELECT *, c < len(k) AS stays, sum(CAST(c < len(k) AS INTEGER)) OVER (PARTITION BY video_id ORDER BY "start", "end", ordinal) AS island FROM cut),
last AS (SELECT *, max("end") OVER (PARTITION BY video_id, island) AS last_end FROM island)
SELECT video_id, ordinal, "start", last_end AS "end", array_to_string(w[c + 1 : len(w)], ' ') AS text FROM last WHERE stays""")
def w05_rolling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate_rolling(rolling_cues(spark, sf_dir))


@query(f"""WITH RECURSIVE {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, ordinal) AS i, lag(value) OVER (PARTITION BY video_id ORDER BY ts, ordinal) AS before FROM samples),
walk AS (SELECT video_id, i, ordinal, ts, value AS anchor, true AS keep FROM n WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, n.ordinal, n.ts, CASE WHEN abs(n.value - n.before) > 20 OR abs(n.value - w.anchor) > 20 THEN n.value ELSE w.anchor END, abs(n.value - n.before) > 20 OR abs(n.value - w.anchor) > 20
  FROM walk w JOIN n ON n.video_id = w.video_id AND n.i = w.i + 1)
SELECT video_id, ordinal, ts FROM walk WHERE keep""")
def w07_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.select_changes(event_samples(spark, sf_dir), 20.0)


@query(f"""WITH RECURSIVE {TURNS}, n AS (SELECT video_id, ordinal, length(text) AS length, row_number() OVER (PARTITION BY video_id ORDER BY ordinal) AS i FROM turns),
walk AS (SELECT video_id, i, ordinal, length, length + 1 AS used, 0 AS chunk FROM n WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, n.ordinal, n.length, CASE WHEN w.used + n.length + 1 > 900 THEN n.length + 1 ELSE w.used + n.length + 1 END, CASE WHEN w.used + n.length + 1 > 900 THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN n ON n.video_id = w.video_id AND n.i = w.i + 1)
SELECT video_id, ordinal, CAST(length AS INTEGER) AS length, CAST(chunk AS INTEGER) AS chunk FROM walk""")
def w08_next_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_cues(spark, sf_dir).select("video_id", "ordinal", F.length("text").alias("length"))
    return sampling.pack_next_fit(turns, 900)


@query(f"""WITH {CUES}, {FRAMES}, ends AS (SELECT video_id, max("end") AS duration FROM cues GROUP BY video_id)
SELECT f.video_id, ordinal, ts, path, coalesce(lead(ts) OVER (PARTITION BY f.video_id ORDER BY ts, ordinal), duration) AS until FROM frames f JOIN ends USING (video_id)""")
def w10_frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = conversation_cues(spark, sf_dir)
    return timeline.frame_spans(conversation_frames(spark, sf_dir), planner.durations_of(cues)).select("video_id", "ordinal", "ts", "path", "until")


@query(f"WITH {TURNS} SELECT video_id, ordinal, CAST((row_number() OVER (PARTITION BY video_id ORDER BY ordinal) - 1) // 4 AS INTEGER) AS batch FROM turns")
def w12_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.batches(conversation_cues(spark, sf_dir).select("video_id", "ordinal"), 4, "ordinal")


@query(f"""WITH RECURSIVE {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, ordinal) AS i FROM samples),
walk AS (SELECT video_id, i, ordinal, ts, ts AS last, true AS keep FROM n WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, n.ordinal, n.ts, CASE WHEN n.ts - w.last >= 86400 THEN n.ts ELSE w.last END, n.ts - w.last >= 86400 FROM walk w JOIN n ON n.video_id = w.video_id AND n.i = w.i + 1)
SELECT video_id, ordinal, ts FROM walk WHERE keep""")
def s14_interval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_interval(event_samples(spark, sf_dir), 86_400.0)


@query("""WITH t AS (SELECT source AS video_id, lang AS code, doc_id % 2 = 1 AS automatic, count(*) AS n_tracks FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY automatic, length(code), code) AS i FROM t WHERE lower(code) = 'fr')
SELECT v.video_id, r.code, coalesce(r.automatic, false) AS automatic FROM (SELECT DISTINCT video_id FROM t) v LEFT JOIN r ON v.video_id = r.video_id AND r.i = 1""")
def s10_choose_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("video_id"), F.col("lang").alias("code"), (F.col("doc_id") % 2 == 1).alias("automatic")).agg(F.count("*").alias("n_tracks"))
    return tracks.choose_tracks(made, "fr")


@query(f"""WITH {CUES}, {FRAMES}, ends AS (SELECT video_id, max("end") AS duration FROM cues GROUP BY video_id),
spans AS (SELECT f.*, coalesce(lead(ts) OVER (PARTITION BY f.video_id ORDER BY ts, ordinal), duration) AS until FROM frames f JOIN ends USING (video_id)),
met AS (SELECT c.video_id, c.ordinal, s.path, row_number() OVER (PARTITION BY c.video_id, c.ordinal ORDER BY least(c."end", s.until) - greatest(c."start", s.ts) DESC, s.ts, s.ordinal) AS i
  FROM cues c JOIN spans s ON s.video_id = c.video_id AND s.ts < c."end" AND s.until > c."start")
SELECT c.video_id, c.ordinal AS number, c."start", c."end", m.path AS frame_path FROM cues c LEFT JOIN met m ON m.video_id = c.video_id AND m.ordinal = c.ordinal AND m.i = 1""")
def j01_page_frame_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = conversation_cues(spark, sf_dir)
    pages = cues.select("video_id", F.col("ordinal").alias("number"), "start", "end")
    return timeline.page_frames(pages, conversation_frames(spark, sf_dir), planner.durations_of(cues))


@query(f"""WITH {CUES}, {FRAMES} SELECT c.video_id, c.ordinal AS id, c."start" AS t, coalesce(min(abs(f.ts - c."start")), CAST('inf' AS DOUBLE)) AS distance
FROM cues c LEFT JOIN frames f ON f.video_id = c.video_id GROUP BY ALL""")
def j03_nearest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = conversation_cues(spark, sf_dir).select("video_id", F.col("ordinal").alias("id"), F.col("start").alias("t"))
    return timeline.nearest_change(times, conversation_frames(spark, sf_dir))


@query(f"""WITH {PREFIX}, {FRAMES}, gaps AS (SELECT *, least(end_before, "start") - 5 AS lo, "start" - 1 AS desired FROM prefixes)
SELECT g.video_id, g.g, max(f.ts) FILTER (f.ts < desired) AS below, min(f.ts) FILTER (f.ts >= desired) AS above
FROM gaps g LEFT JOIN frames f ON f.video_id = g.video_id AND f.ts >= lo AND f.ts <= g."start" AND lo < g."start" GROUP BY g.video_id, g.g""")
def j04_cut_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _gaps(spark, sf_dir).select("video_id", "g", (F.col("gap_from") - 5).alias("gap_from"), "start", (F.col("start") - 1).alias("desired"))
    return timeline.cut_candidates(wide, conversation_frames(spark, sf_dir))


@query("SELECT d.doc_id, sha256(text) AS key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id % 3 = 0)")
def j07_missing_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"))
    return keyed.join(keyed.where("doc_id % 3 = 0").select("key").distinct(), "key", "left_anti").select("doc_id", "key")


def _demo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: a cover, an overview and content with bullets, some with a note."""
    c = conversation_cues(spark, sf_dir)
    kind = F.when(F.col("ordinal") == 0, "cover").when(F.col("ordinal") == 1, "overview").otherwise("content")
    return c.select("video_id", (F.col("ordinal") + 1).alias("number"), F.concat(F.lit("Turn "), F.col("ordinal").cast("string")).alias("title"), "start", "end", F.left("text", F.lit(80)).alias("summary"), F.array(F.left("text", F.lit(10)), F.lit("a & b")).alias("bullets"), F.lit("").alias("takeaway"), F.lit(None).cast("string").alias("frame_path"), F.col("text").alias("source_text"), kind.alias("kind"), F.lit("").alias("chapter"), F.when(F.col("ordinal") % 2 == 0, "Excerpt; no AI summary.").otherwise("").alias("uncertainty"))


def _demo_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.durations_of(conversation_cues(spark, sf_dir)).select("video_id", F.concat(F.lit("Talk <"), F.col("video_id").cast("string"), F.lit(">")).alias("title"), F.concat(F.lit("https://talks.example.org/"), F.col("video_id").cast("string")).alias("source_url"), "duration", F.lit(60.0).alias("reading_minutes"), F.array(F.lit("Check < this.")).alias("warnings"))


PAGE_ROWS = f"""{CUES}, pages_ AS (SELECT video_id, ordinal + 1 AS number, 'Turn ' || ordinal AS title, "start", "end", text[1:80] AS summary, '• ' || text[1:10] || chr(10) || '• a & b' AS ideas, text AS source_text,
  CASE ordinal WHEN 0 THEN 'cover' WHEN 1 THEN 'overview' ELSE 'content' END AS kind, CASE WHEN ordinal % 2 = 0 THEN 'Excerpt; no AI summary.' ELSE '' END AS note FROM cues)"""
P_LABEL = "CASE WHEN kind = 'cover' THEN 'READING TARGET' WHEN kind = 'overview' THEN 'AT A GLANCE' WHEN note <> '' THEN 'TRANSCRIPT EXCERPT' ELSE 'PRESENTER SUMMARY' END"


@query(f"""WITH {PAGE_ROWS}, parts AS (SELECT video_id, number, unnest([{{'label': {P_LABEL}, 'body': summary}}, {{'label': 'KEY IDEAS', 'body': CASE WHEN kind = 'overview' THEN '' ELSE ideas END}}, {{'label': 'SOURCE NOTE', 'body': note}}]) AS s FROM pages_)
SELECT video_id, number, s.label, s.body FROM parts WHERE s.body <> ''""")
def p11_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demo_pages(spark, sf_dir).select("video_id", "number", F.inline(export.sections(False)))


@query(f"""WITH {TURNS}, hit AS (SELECT *, contains(lower(text), 'the') AS h FROM turns),
c AS (SELECT *, count(*) FILTER (h) OVER (PARTITION BY video_id) AS n, count(*) OVER (PARTITION BY video_id) AS total FROM hit)
SELECT video_id, ordinal, text, n, total FROM c WHERE h""")
def p15_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_cues(spark, sf_dir).select("video_id", "ordinal", "text")
    return export.search_pages(turns, F.col("text"), "  The ")


LINKED = f"""{PAGE_ROWS}, t AS (SELECT *, 'https://talks.example.org/' || video_id || '?t=' || CAST(trunc("start") AS BIGINT) AS link, {s_clock(chr(34) + 'start' + chr(34))} || ' – ' || {s_clock(chr(34) + 'end' + chr(34))} AS span FROM pages_)"""
P_NOTES = f"""title || chr(10) || 'Source interval: ' || span || chr(10) || 'Source: ' || link || chr(10)
  || chr(10) || {P_LABEL} || chr(10) || summary || chr(10) || chr(10) || 'KEY IDEAS' || chr(10) || ideas || chr(10) || CASE WHEN note <> '' THEN chr(10) || 'SOURCE NOTE' || chr(10) || note || chr(10) ELSE '' END
  || chr(10) || 'FULL SOURCE TRANSCRIPT' || chr(10) || source_text"""


@query(f"WITH {LINKED} SELECT video_id, number, {P_NOTES} AS notes FROM t")
def p12_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _demo_pages(spark, sf_dir).join(_demo_videos(spark, sf_dir).select("video_id", "source_url"), "video_id")
    return joined.select("video_id", "number", export.notes().alias("notes"))


from . import queries_books, queries_images, queries_plans, queries_sources, queries_streams  # noqa: E402, F401 - register more
