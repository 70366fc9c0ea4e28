"""Books as PDF files, drawn from the slide table's boxes with the standard font, one task a book.

Characters outside the font's encoding are drawn as ? and named in a warning.  A book is as large as its pages' texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import LINE, lines
from .export import FOOT_BOX, LABEL_SIZE, PAGE_SIZE, TEXT_BOX, TITLE_BOX

#: The encoding of the standard font's characters.
ENCODING = "cp1252"
DRAWN = "video_id {kind}, content binary, n_pages int, lacking array<string>"


def encoded(text: str) -> tuple[bytes, set[str]]:
    """A text in the font's encoding, and the characters that it lacks."""
    lacking = {c for c in text if not c.encode(ENCODING, "ignore") or ord(c) < 32}
    return "".join("?" if c in lacking else c for c in text).encode(ENCODING), lacking


def _string(raw: bytes) -> bytes:
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def drawn(texts: list[tuple[float, float, float, str]]) -> tuple[bytes, set[str]]:
    """The drawing of lines: left, top (both from the upper left corner), size and text."""
    out, lacking = [], set()
    for left, top, size, text in texts:
        raw, lost = encoded(text)
        lacking |= lost
        out.append(b"BT /F1 %.2f Tf %.2f %.2f Td %s Tj ET" % (size, left, PAGE_SIZE[1] - top - size, _string(raw)))
    return b"\n".join(out), lacking


def document(title: str, pages: list[tuple[bytes, str | None]]) -> bytes:
    """A PDF of pages: each a drawing and a link, or none, over its foot."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Title %s >>" % _string(encoded(title)[0])]
    kids = []
    for drawing, link in pages:
        packed = zlib.compress(drawing)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
        note = b""
        if link:
            left, top, width, height = FOOT_BOX
            box = b"[%.2f %.2f %.2f %.2f]" % (left, PAGE_SIZE[1] - top - height, left + width, PAGE_SIZE[1] - top)
            note = b" /Annots [<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect %s /A << /S /URI /URI %s >> >>]" % (box, _string(link.encode("ascii", "replace")))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R%s >>" % (*PAGE_SIZE, len(objects), note))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table)
    return bytes(out)


def placed(boxes: list[dict]) -> list[tuple[float, float, float, str]]:
    """The lines of a page's boxes: the title above, sections below each other at the right, the footnote under them."""
    out, top = [], TEXT_BOX[1]
    for box in boxes:
        left, at, width = {"title": TITLE_BOX, "footnote": FOOT_BOX}.get(box["box"], TEXT_BOX)[:3]
        if box["box"] == "section":
            out.append((left, top, LABEL_SIZE, box["label"]))
            at = top = top + LABEL_SIZE * LINE + 3
        for line in lines(box["body"], width, box["size"]):
            out.append((left, at, box["size"], line))
            at += box["size"] * LINE
        if box["box"] == "section":
            top = at + 12
    return out


def pdf_books(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """boxes: what export.slides gives; videos: video_id, title.  video_id, content, n_pages, and the characters drawn as ?."""
    page = F.struct("number", "position", "box", "label", "body", "size", "link")
    books = boxes.groupBy("video_id").agg(F.array_sort(F.collect_list(page)).alias("boxes")).join(videos.select("video_id", "title"), "video_id")
    kind = boxes.schema["video_id"].dataType.simpleString()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for video, listed, title in zip(frame["video_id"], frame["boxes"], frame["title"]):
                pages: dict[int, list[dict]] = {}
                for b in listed:
                    b = b if isinstance(b, dict) else b.asDict()
                    pages.setdefault(b["number"], []).append(b)
                made = [(drawn(placed(p)), p[0]["link"]) for p in pages.values()]
                lacking = sorted(set().union(*(lost for (_, lost), _ in made)))
                rows.append((video, document(title or "", [(drawing, link) for (drawing, _), link in made]), len(made), lacking))
            yield pd.DataFrame(rows, columns=["video_id", "content", "n_pages", "lacking"])

    return books.mapInPandas(draw, DRAWN.format(kind=kind))
