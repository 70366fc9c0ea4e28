"""Text in boxes, PDF files and documents that are written whole or not at all."""

import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from timedtext.functions import layout
from timedtext.sinks import documents, export, pdf


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgilmnorstuwÄé漢W") for _ in range(rng.randrange(1, 12))) for _ in range(n))


def model_lines(text, width, size):
    """Word by word, and character by character in words that are wider than the box."""
    measure = lambda t: layout.advances(t).sum() * size / 1000
    out = []
    for paragraph in text.split("\n"):
        current = ""
        for word in paragraph.split():
            if current and measure(f"{current} {word}") <= width + 1e-6:
                current = f"{current} {word}"
                continue
            if current:
                out.append(current)
            current = ""
            for char in word:
                if current and measure(current + char) > width + 1e-6:
                    out.append(current)
                    current = char
                else:
                    current += char
        out.append(current)
    return out


def test_lines_equal_a_word_by_word_model():
    rng = random.Random(3)
    for _ in range(200):
        text = "\n".join(prose(rng, rng.randrange(0, 30)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "  \n", " " + "x" * 90])
        width, size = rng.uniform(30, 300), rng.uniform(8, 27)
        assert layout.lines(text, width, size) == model_lines(text, width, size), (text, width, size)


def test_advances():
    assert layout.advances("iWé漢́ß").tolist() == [222, 944, 556, 1000, 0, 556]
    assert sum(map(len, layout.ADVANCES.values())) == 95 and layout.advances("").tolist() == []


def test_no_box_overflows_and_nothing_fits_larger():
    rng = random.Random(8)
    for _ in range(150):
        texts = [prose(rng, rng.choice([0, 3, 20, 120, 500])) for _ in range(rng.randrange(1, 5))]
        size, kept = layout.fitted_texts(texts, 276.0, 358.0, export.TEXT_SIZES, export.AROUND)
        assert layout.height(kept, 276.0, size, export.AROUND) <= 358.0 + 1e-6
        assert all(layout.advances(line).sum() * size / 1000 <= 276.0 + 1e-6 for t in kept for line in layout.lines(t, 276.0, size))
        if kept == texts:
            assert size == max(s for s in export.TEXT_SIZES if layout.height(texts, 276.0, s, export.AROUND) <= 358.0)
        else:
            assert size == 12 and layout.height(texts, 276.0, 12, export.AROUND) > 358.0 and any(t.endswith("…") for t in kept)


def _book(spark):
    from timedtext.schema import PAGES

    rng = random.Random(1)
    rows = [("v", n, "Ein Titel (ä) \\ 漢 " * (1 + n % 3 * 9), 60.0 * n, 60.0 * n + 60, prose(rng, 30 * n), ["a", "b"], "t", None, "said", "content", "c", "Excerpt; no AI summary." if n % 2 else "") for n in range(3, 9)]
    videos = spark.createDataFrame([("v", "A & B", "https://example.org/v(1)", 600.0, 60.0, ["w"])], "video_id string, title string, source_url string, duration double, reading_minutes double, warnings array<string>")
    return spark.createDataFrame(rows, PAGES), videos


def test_slides_and_pdf(spark):
    pages, videos = _book(spark)
    boxes = export.slides(pages, videos)
    rows = boxes.orderBy("number", "position").collect()
    assert [r.box for r in rows if r.number == 4] == ["title", "section", "section", "section", "footnote"]
    assert any(r.shortened for r in rows) and all((r.body == export.CUT_NOTE) == r.shortened for r in rows if r.box == "footnote")
    made = pdf.pdf_books(boxes, videos).first()
    body = made.content
    assert made.n_pages == 6 and "漢" in made.lacking and "ä" not in made.lacking
    table = int(re.search(rb"startxref\n(\d+)", body)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", body[table:])]
    assert body[table : table + 4] == b"xref" and all(body[p:].startswith(b"%d 0 obj" % n) for n, p in enumerate(places, 1))
    streams = [zlib.decompress(s) for s in re.findall(rb"stream\n(.*?)\nendstream", body, re.S)]
    assert len(streams) == 6 and body.count(b"/Subtype /Link") == 6
    for n, stream in enumerate(streams, 3):
        drawn = [re.sub(r"\\(.)", r"\1", m) for m in re.findall(r"\((.*)\) Tj", stream.decode("cp1252"))]
        wanted = [line for r in rows if r.number == n for line in ([r.label] if r.box == "section" else []) + layout.lines(r.body, {"title": 885.0}.get(r.box, 276.0), r.size)]
        assert drawn == [pdf.encoded(t)[0].decode("cp1252") for t in wanted]
        assert all(0 <= float(y) <= 540 for y in re.findall(r"Tf [0-9.]+ ([0-9.-]+) Td", stream.decode("cp1252")))


def listing(path):
    """What a reader sees: a failed job's last task may still be in its own folder."""
    return sorted(p.name for p in path.iterdir() if p.is_file()) if path.exists() else []


def test_documents_are_written_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(20).select(F.concat(F.lit("d"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("text "), "id").cast("binary").alias("content")).repartition(4)
    documents.write_documents(rows, f"file://{out}")
    assert listing(out) == sorted(["_SUCCESS", *(f"d{i}.txt" for i in range(20))]) and (out / "d7.txt").read_text() == "text 7"
    broken = rows.withColumn("content", F.when(F.col("name") == "d11.txt", F.raise_error(F.lit("lost"))).otherwise(F.lit(b"new")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            documents.write_documents(broken, f"file://{out}", mode)
        assert len(listing(out)) == 21 and (out / "d7.txt").read_text() == "text 7"
    with pytest.raises(Exception, match="there already"):
        documents.write_documents(rows.limit(1), f"file://{out}", "append")
    with pytest.raises(Exception, match="two documents"):
        documents.write_documents(rows.unionByName(rows.limit(1)), f"file://{out}")
    with pytest.raises(Exception, match="no name"):
        documents.write_documents(rows.withColumn("name", F.lit("../x")).limit(1), f"file://{out}")
    assert len(listing(out)) == 21
    documents.write_documents(rows.limit(2).withColumn("name", F.concat(F.lit("n"), "name")), f"file://{out}", "append")
    assert len(listing(out)) == 23
    documents.write_documents(rows.where("name = 'd3.txt'"), f"file://{out}", "overwrite")
    assert listing(out) == ["_SUCCESS", "d3.txt"] and (out / "_SUCCESS").read_text() == "1"
    documents.write_documents(rows.limit(0), str(tmp_path / "empty"))
    assert listing(tmp_path / "empty") == ["_SUCCESS"]


def test_task_that_fails_once_is_written_once(spark, tmp_path):
    """A task's first try leaves nothing behind: its second writes to a folder of its own."""
    marker = tmp_path / "tried"

    def flaky(batches):
        for batch in batches:
            yield batch.iloc[:1]
            if 5 in set(batch["id"]) and not marker.exists():
                marker.touch()
                raise RuntimeError("first try")
            yield batch.iloc[1:]

    frame = spark.range(12).repartition(3).mapInPandas(flaky, "id long").select(F.col("id").cast("string").alias("name"), F.lit(b"x").alias("content"))
    writer = documents._Writer(f"file://{tmp_path}/out", True)
    first = [r for r in spark.range(3).select(F.col("id").cast("string"), F.lit(b"y")).collect()]

    def broken():
        yield first[0]
        raise RuntimeError("first try")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    message = writer.write(iter(first))
    assert listing(tmp_path / "out") == []
    writer.commit([None, message])
    assert listing(tmp_path / "out") == ["0", "1", "2", "_SUCCESS"] and [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == []
    stale = tmp_path / "out/_job-of-a-lost-executor"
    stale.mkdir()
    os.utime(stale, (0, 0))
    try:
        documents.write_documents(frame, f"file://{tmp_path}/out")
    except Exception:  # local masters do not try a task again
        assert listing(tmp_path / "out") == ["0", "1", "2", "_SUCCESS"]
        documents.write_documents(frame, f"file://{tmp_path}/out")
    assert len(listing(tmp_path / "out")) == 13 and not stale.exists()


def test_export_draws_pdfs(spark, tmp_path):
    import json

    pages, videos = _book(spark)
    heard = []
    done = export.export(pages.withColumn("video_id", F.lit("a/b")), videos.withColumn("video_id", F.lit("a/b")), f"file://{tmp_path}/out", ("layout",), report=lambda *x: heard.append(x))
    assert list(done) == ["layout", "pdf", "json"] and ("pdf", {"rows": 1, "pages": 6}) in heard
    (name,) = [n for n in listing(tmp_path / "out/pdf") if n != "_SUCCESS"]
    assert re.fullmatch(r"a_b-[0-9a-f]{12}\.pdf", name) and (tmp_path / "out/pdf" / name).read_bytes().startswith(b"%PDF")
    warnings = json.loads(spark.read.parquet(done["json"]).first().value)["warnings"]
    assert warnings[0] == "w" and warnings[1].startswith("In the PDF a ? stands for: ") and "漢" in warnings[1]
