"""Books as JSON, searchable HTML, and tables of slides and boxes.

A slide table has one row for each box of a slide; pdf.py draws it, and other binary writers may map over it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import source_link
from ..functions.layout import fitted
from ..functions.text import clock, data_url, escape_html, general
from ..progress import Report, counted
from ..shared import written

#: What exported pages call their parts.
COVER, OVERVIEW, SUMMARY, EXCERPT = "READING TARGET", "AT A GLANCE", "PRESENTER SUMMARY", "TRANSCRIPT EXCERPT"
IDEAS, TAKEAWAY, NOTE = "KEY IDEAS", "TAKEAWAY", "SOURCE NOTE"
FULL_SOURCE, SOURCE_REFERENCE, NO_SOURCE = "FULL SOURCE TRANSCRIPT", "SOURCE REFERENCE", "No source transcript was provided for this page."
FORMATS = ("slides", "layout", "html", "json")


def sections(overview_too: bool = True) -> Column:
    """The labelled parts of a page in order, blank ones left out.  Without overview_too an overview has no key ideas."""
    label = F.when(F.col("kind") == "cover", COVER).when(F.col("kind") == "overview", OVERVIEW).when((F.col("kind") == "content") & F.contains(F.lower(F.coalesce("uncertainty", F.lit(""))), F.lit("no ai summary")), EXCERPT).otherwise(SUMMARY)
    ideas = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("• "), b)), "\n")
    if not overview_too:
        ideas = F.when(F.col("kind") == "overview", F.lit("")).otherwise(ideas)
    parts = [(label, F.col("summary")), (F.lit(IDEAS), ideas), (F.lit(TAKEAWAY), F.col("takeaway")), (F.lit(NOTE), F.col("uncertainty"))]
    return F.filter(F.array(*[F.struct(a.alias("label"), F.coalesce(b, F.lit("")).alias("body")) for a, b in parts]), lambda s: s.body != "")


def interval() -> Column:
    return F.concat(clock(F.col("start")), F.lit(" – "), clock(F.col("end")))


def notes(embed_transcript: bool = True) -> Column:
    """All text of a page (with source_url beside it)."""
    link = F.coalesce(source_link(F.col("source_url"), F.col("start")), F.col("source_url"), F.lit(""))
    head = F.array(F.col("title"), F.concat(F.lit("Source interval: "), interval()), F.concat(F.lit("Source: "), link))
    body = F.flatten(F.transform(sections(), lambda s: F.array(F.lit(""), s.label, s.body)))
    source = F.when(F.coalesce("source_text", F.lit("")) == "", F.lit(NO_SOURCE)).otherwise(F.col("source_text"))
    return F.array_join(F.concat(head, body, F.array(F.lit(""), F.lit(FULL_SOURCE if embed_transcript else SOURCE_REFERENCE), source)), "\n")


#: What a page's foot says: text is missing here, the summary is doubtful, or neither.
CUT_NOTE, DOUBT_NOTE, PLAIN_NOTE = "Shortened to fit; the whole text is in the HTML book.", "See the source note above before you rely on this page.", "The times above lead back to the recording."


def footnote(shortened: Column) -> Column:
    """P13."""
    doubtful = F.coalesce("uncertainty", F.lit("")) != ""
    return F.when(shortened, CUT_NOTE).when(doubtful, DOUBT_NOTE).otherwise(PLAIN_NOTE)


def export_errors(pages: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """What forbids an export, one row each.  A page may end where it starts."""
    unknown = sorted(set(formats) - set(FORMATS))
    if unknown:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) >= 0)
    return pages.where(~(finite("start") & finite("end") & (F.col("end") >= F.col("start")))).select("video_id", "number", F.lit("page times must be finite, with 0 <= start <= end").alias("error"))


def image_warnings(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The missing images by name, then the number of content pages without one.  files: path."""
    there = files.select(F.col("path").alias("_f")).distinct()
    joined = pages.join(there, F.col("frame_path") == F.col("_f"), "left")
    gone = F.concat(F.lit("Image is missing: "), F.col("frame_path"))
    lost = F.array_sort(F.collect_list(F.when((F.coalesce("frame_path", F.lit("")) != "") & F.col("_f").isNull(), F.struct("number", gone.alias("w")))))
    without = F.count_if((F.col("kind") == "content") & F.col("_f").isNull())
    tail = F.when(F.col("without") > 0, F.array(F.concat(F.col("without").cast("string"), F.lit(" content pages have no source visual.")))).otherwise(F.array().cast("array<string>"))
    return joined.groupBy("video_id").agg(lost.alias("lost"), without.alias("without")).select("video_id", F.array_distinct(F.concat(F.transform("lost", lambda x: x.w), tail)).alias("warnings"))


def page_struct() -> Column:
    return F.struct("number", "title", "start", "end", "summary", "bullets", "takeaway", "frame_path", "source_text", "kind", "chapter", "uncertainty")


def book_rows(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """One row for each book with its pages in order."""
    by_video = pages.groupBy("video_id").agg(F.array_sort(F.collect_list(page_struct())).alias("pages"))
    return videos.join(by_video, "video_id")


def json_books(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and the whole book as JSON; empty fields stay."""
    rows = book_rows(pages, videos)
    return rows.select("video_id", F.to_json(F.struct(*[c for c in rows.columns if c != "video_id"]), {"ignoreNullFields": "false"}).alias("value"))


def articles(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """One escaped HTML article for each page.  videos: video_id, title, source_url, duration, reading_minutes.

    Content pages with `image_url` (a data or other URL) show it.
    """
    if "image_url" not in pages.columns:
        pages = pages.withColumn("image_url", F.lit(None).cast("string"))
    count = pages.groupBy("video_id").agg(F.count("*").alias("_pages"))
    book = videos.select("video_id", F.col("title").alias("_title"), "source_url", F.col("duration").alias("_duration"), F.col("reading_minutes").alias("_minutes")).join(count, "video_id")
    e, lit = escape_html, F.lit
    image = F.concat(lit('<img loading="lazy" alt="Source visual for '), interval(), lit('" src="'), F.col("image_url"), lit('">'))
    cover = F.concat(lit('<div class="cover"><h2>'), e(F.col("_title")), lit("</h2><p>"), clock(F.col("_duration")), lit(" of video · "), F.col("_pages").cast("string"), lit(" pages<br>Reading target: "), general(F.col("_minutes")), lit(" minutes</p></div>"))
    route = F.concat(lit('<ol class="overview">'), F.array_join(F.transform("bullets", lambda b: F.concat(lit("<li>"), e(b), lit("</li>"))), ""), lit("</ol>"))
    visual = F.when(F.col("image_url").isNotNull(), image).when(F.col("kind") == "cover", cover).when(F.col("kind") == "overview", route).otherwise(lit('<div class="missing"><strong>No picture here</strong></div>'))
    body = F.array_join(F.transform(sections(False), lambda s: F.concat(lit("<section><h3>"), e(s.label), lit("</h3><p>"), F.replace(e(s.body), lit("\n"), lit("<br>")), lit("</p></section>"))), "")
    link = source_link(F.col("source_url"), F.col("start"))
    play = F.when(link.isNotNull(), F.concat(lit('<a rel="noopener noreferrer" href="'), e(link), lit('">'), interval(), lit("</a>"))).otherwise(F.concat(lit("<span>"), interval(), lit(" · "), e(F.coalesce(F.when(F.col("source_url") != "", F.col("source_url")), lit("Source unavailable"))), lit("</span>")))
    source = F.when(F.coalesce("source_text", lit("")) == "", lit(NO_SOURCE)).otherwise(F.col("source_text"))
    chapter = F.when(F.coalesce("chapter", lit("")) != "", F.col("chapter")).otherwise(F.col("_title"))
    three = lambda c: F.when(F.col(c) > 999, F.col(c).cast("string")).otherwise(F.lpad(F.col(c).cast("string"), 3, "0"))
    html = F.concat(
        lit('<article class="page" id="page-'), F.col("number").cast("string"), lit('"><p class="chapter">'), e(chapter), lit("</p><h2>"), e(F.col("title")), lit("</h2>"), visual, lit("<aside>"), body, lit("</aside><footer>"), play, lit("<span>"), three("number"), lit(" / "), three("_pages"),
        lit("</span></footer><details><summary>Full source transcript · "), interval(), lit("</summary><pre>"), e(source), lit("</pre></details></article>"),
    )
    return pages.join(book, "video_id").select("video_id", "number", html.alias("article"))


STYLE = "body{font:16px/1.5 sans-serif;margin:0 auto;max-width:70rem;padding:1rem}.page{border-top:4px solid #257;margin:2rem 0}img{max-width:100%}pre{white-space:pre-wrap}[hidden]{display:none}"
SCRIPT = """
const box = document.getElementById("search"), pages = [...document.querySelectorAll(".page")], shown = () => pages.filter(p => !p.hidden);
function search() {
  const wanted = box.value.trim().toLowerCase();
  for (const p of pages) p.hidden = wanted !== "" && !p.textContent.toLowerCase().includes(wanted);
  document.getElementById("count").textContent = `${shown().length} / ${pages.length} pages`;
  document.getElementById("none").hidden = shown().length > 0;
}
function step(by) {
  const list = shown(), here = list.findLastIndex(p => p.getBoundingClientRect().top <= 8);
  list[Math.max(0, Math.min(list.length - 1, here + by))]?.scrollIntoView();
}
box.addEventListener("input", search);
document.addEventListener("keydown", e => { if (e.target !== box && e.key === "ArrowRight") step(1); if (e.target !== box && e.key === "ArrowLeft") step(-1); });
search();
"""


def html_books(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and one searchable HTML document.  videos also have `warnings`."""
    parts = F.array_sort(F.collect_list(F.struct("number", "article")))
    body = articles(pages, videos).groupBy("video_id").agg(F.array_join(F.transform(parts, lambda p: p.article), "\n").alias("body"))
    joined = body.join(videos.select("video_id", "title", "warnings"), "video_id")
    warned = F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("<li>"), escape_html(w), F.lit("</li>"))), "")
    note = F.when(F.size("warnings") > 0, F.concat(F.lit('<details class="warnings"><summary>Please note ('), F.size("warnings").cast("string"), F.lit(")</summary><ul>"), warned, F.lit("</ul></details>"))).otherwise(F.lit(""))
    title = escape_html(F.col("title"))
    document = F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), title, F.lit(f"</title><style>{STYLE}</style></head><body><header><strong>"), title, F.lit('</strong><input id="search" type="search" aria-label="Search"><span id="count"></span></header><main>'),
        note, F.col("body"), F.lit(f'<p id="none" hidden>Nothing was found.</p></main><script>{SCRIPT}</script></body></html>'),
    )
    return joined.select("video_id", document.alias("value"))


def search_pages(pages: DataFrame, text: Column, query: str) -> DataFrame:
    """The pages whose text holds the query, blanks at its ends and case apart; all for a blank one, with n and total."""
    wanted = F.lower(F.trim(F.lit(query)))
    found = pages.withColumn("hit", (wanted == "") | F.contains(F.lower(text), wanted))
    whole = Window.partitionBy("video_id")
    return found.withColumn("n", F.count_if("hit").over(whole)).withColumn("total", F.count("*").over(whole)).where("hit").drop("hit")


def neighbours(pages: DataFrame) -> DataFrame:
    """The page before and after each of the visible pages."""
    order = Window.partitionBy("video_id").orderBy("number")
    return pages.withColumn("previous", F.lag("number").over(order)).withColumn("next", F.lead("number").over(order))


#: Boxes of a page of 960 by 540 points: left, top, width, height; and the sizes that their text may have.
PAGE_SIZE = (960.0, 540.0)
TITLE_BOX, TEXT_BOX, FOOT_BOX = (37.0, 24.0, 885.0, 55.0), (646.0, 96.0, 276.0, 358.0), (646.0, 470.0, 276.0, 30.0)
TITLE_SIZES, TEXT_SIZES, FOOT_SIZE = [float(s) for s in range(19, 28)], [12 + i / 2 for i in range(9)], 9.0
LABEL_SIZE, AROUND = 9.0, 39.0


def slides(pages: DataFrame, videos: DataFrame, embed_transcript: bool = True) -> DataFrame:
    """One row for each box of a page: title, each section, footnote; with the page's link and notes.

    A title takes the largest size that fits its box, a page's sections the largest that fits them together; what is too long
    at the smallest is cut line by line, the sections in proportion, so that no box overflows.
    """
    told = pages.join(videos.select("video_id", "source_url"), "video_id").withColumns({"_sections": sections(False), "notes": notes(embed_transcript), "link": source_link(F.col("source_url"), F.col("start"))})
    bodies = F.transform("_sections", lambda s: s.body)
    told = told.withColumns({"_title": fitted(F.array("title"), *TITLE_BOX[2:], TITLE_SIZES), "_text": fitted(bodies, *TEXT_BOX[2:], TEXT_SIZES, AROUND)})
    shortened = F.col("_title.shortened") | F.col("_text.shortened")
    boxes = F.concat(
        F.array(F.struct(F.lit("title").alias("box"), F.lit("").alias("label"), F.col("_title.texts")[0].alias("body"), F.col("_title.size").alias("size"))),
        F.zip_with("_sections", "_text.texts", lambda s, t: F.struct(F.lit("section").alias("box"), s.label.alias("label"), t.alias("body"), F.col("_text.size").alias("size"))),
        F.array(F.struct(F.lit("footnote").alias("box"), F.lit("").alias("label"), footnote(shortened).alias("body"), F.lit(FOOT_SIZE).alias("size"))),
    )
    return told.withColumn("shortened", shortened).select("video_id", "number", "frame_path", "link", "notes", "shortened", F.posexplode(boxes).alias("position", "b")).select("video_id", "number", "position", "b.box", "b.label", "b.body", "b.size", "frame_path", "link", "notes", "shortened")


def unsupported(text: Column, supported: str) -> Column:
    """The characters of a text outside a class of supported ones."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"([^{supported}])"), F.lit(1)))


def substitute(text: Column, supported: str) -> Column:
    """The text with ? for each character that a font lacks."""
    return F.regexp_replace(text, f"[^{supported}]", "?")


def with_images(pages: DataFrame, videos: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with the images that are there as data URLs, and videos with the warnings about those that are not.

    images: path, content.  What an image is, is told by its first bytes; others than these are left out.
    """
    head = F.hex(F.substring("content", 1, 4))
    mime = F.when(head == "89504E47", "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head == "47494638", "image/gif").when(head == "52494646", "image/webp")
    urls = images.select(F.col("path").alias("frame_path"), data_url(F.col("content"), mime).alias("image_url")).where("image_url IS NOT NULL").dropDuplicates(["frame_path"])
    told = image_warnings(pages, urls.select(F.col("frame_path").alias("path"))).withColumnRenamed("warnings", "_more")
    both = F.array_distinct(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>"))))
    return pages.join(urls, "frame_path", "left"), videos.join(told, "video_id", "left").withColumn("warnings", both).drop("_more")


def document_name(video_id: Column, suffix: str) -> Column:
    """A file's name for a video: what file systems allow of its id, with a digest of the id if that is not all."""
    plain = F.regexp_replace(F.regexp_replace(video_id.cast("string"), "[^A-Za-z0-9._-]", "_"), "^[._]", "-")
    return F.concat(F.when(plain == video_id.cast("string"), plain).otherwise(F.concat(F.right(plain, F.lit(80)), F.lit("-"), F.left(F.sha2(video_id.cast("string").cast("binary"), 256), F.lit(12)))), F.lit(suffix))


def _write_pdfs(boxes: DataFrame, videos: DataFrame, done: dict[str, str], out: str, report: Report | None) -> DataFrame:
    """Draws the boxes as PDF files; videos with a warning of the characters that the font lacks."""
    from .documents import write_documents
    from .pdf import pdf_books

    made = written(boxes.sparkSession)(pdf_books(boxes, videos), "pdf")
    done["pdf"] = f"{out}/pdf"
    write_documents(made.select(document_name(F.col("video_id"), ".pdf").alias("name"), "content"), done["pdf"])
    if report:
        report("pdf", made.agg(F.count("*").alias("rows"), F.sum("n_pages").alias("pages")).first().asDict())
    lost = F.when(F.size("lacking") > 0, F.array(F.concat(F.lit("In the PDF a ? stands for: "), F.array_join("lacking", " ")))).otherwise(F.array().cast("array<string>"))
    return videos.join(made.select("video_id", lost.alias("_lost")), "video_id", "left").withColumn("warnings", F.concat("warnings", F.coalesce("_lost", F.array().cast("array<string>")))).drop("_lost")


def export(pages: DataFrame, videos: DataFrame, out: str, formats: tuple[str, ...] = FORMATS, writer: Callable | None = None, images: DataFrame | None = None, report: Report | None = None) -> dict[str, str]:
    """Checks first, then writes each format in a fixed order, JSON last.  writer(slides, path): an optional binary sink;
    images: path and content of the pages' images; report: hears how many rows each format has."""
    wrong = export_errors(pages, formats).take(1)
    if wrong:
        raise ValueError(f"page {wrong[0]['number']} of {wrong[0]['video_id']}: {wrong[0]['error']}")
    if pages.isEmpty():
        raise ValueError("a book needs a page")
    shown = pages
    if images is not None:
        shown, videos = with_images(pages, videos, images)
    done, spark = {}, pages.sparkSession

    def write(name: str, table: DataFrame) -> None:
        table, seen = counted(table)
        table.write.mode("overwrite").parquet(done[name])
        if report:
            report(name, dict(seen.get))

    for name in FORMATS:
        if name in formats or name == "json":
            done[name] = f"{out}/{name}"
            if name in ("slides", "layout"):
                table = slides(pages, videos)
                write(name, table)
                if name == "layout":
                    videos = _write_pdfs(spark.read.parquet(done[name]), videos, done, out, report)
                if writer:
                    writer(table, f"{done[name]}-files")
            else:
                write(name, html_books(shown, videos) if name == "html" else json_books(pages, videos))
    return done
