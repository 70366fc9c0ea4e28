"""text in boxes, measured by a font's advances: line breaking, the largest size that fits, and cuts that fit.

Widths come from a table, so they are the same on every host.  A text's advances are summed once; a line's end is then found
by one binary search in the sums, and the size by one among the sizes, as larger ones never need fewer lines.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The advances of Helvetica in thousandths of its size, as its published metrics give them.
ADVANCES = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~", 611: "FTZ", 667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
#: What other characters take: accented letters what their base does, wide scripts a whole size, combining marks nothing.
OTHER, WIDE = 556, 1000
WIDE_RANGES = ((0x1100, 0x115F), (0x2E80, 0xA4CF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0x20000, 0x3FFFD))
LINE = 1.18


def _table() -> np.ndarray:
    ascii_ = {c: w for w, chars in ADVANCES.items() for c in chars}
    table = np.full(0x110000, OTHER, np.int16)
    for low, high in WIDE_RANGES:
        table[low : high + 1] = WIDE
    for code in range(0x3000):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if unicodedata.combining(char):
            table[code] = 0
        elif base in ascii_:
            table[code] = ascii_[base]
    return table


_TABLE: list[np.ndarray] = []


def advances(text: str) -> np.ndarray:
    """The advance of each character, in thousandths of the font's size."""
    if not _TABLE:
        _TABLE.append(_table())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)


def lines(text: str, width: float, size: float) -> list[str]:
    """The lines of a text in a box, greedily: blanks are one space, a word that is wider than the box is cut between characters."""
    out = []
    for paragraph in text.split("\n"):
        words = " ".join(paragraph.split())
        upto = np.concatenate([[0], np.cumsum(advances(words))])
        at, room = 0, width / size * 1000
        while at < len(words):
            end = int(np.searchsorted(upto, upto[at] + room + 1e-6, "right")) - 1
            if end < len(words) and words[end] != " ":
                space = words.rfind(" ", at, end)
                end = space if space > at else max(end, at + 1)
            out.append(words[at:end])
            at = end + (words[end : end + 1] == " ")
        if not words:
            out.append("")
    return out


def height(texts: list[str], width: float, size: float, around: float = 0.0) -> float:
    """Points that texts take below each other, each with some space around it."""
    return sum(around + len(lines(t, width, size)) * size * LINE for t in texts)


def largest_size(texts: list[str], width: float, room: float, sizes: list[float], around: float = 0.0) -> float:
    """The largest of the sizes at which the texts fit, or the smallest."""
    ordered = sorted(sizes)
    low, high = 0, len(ordered) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if height(texts, width, ordered[middle], around) <= room:
            low = middle
        else:
            high = middle - 1
    return ordered[low]


def cut(text: str, width: float, size: float, most: int) -> str:
    """The text, or as much of it as fits in so many lines with an ellipsis, cut at a word if the last line has two."""
    found = lines(text, width, size)
    if len(found) <= most:
        return text
    last = found[max(most, 1) - 1]
    while last and advances(last + "…").sum() * size / 1000 > width:
        last = last.rpartition(" ")[0] if " " in last else last[:-1]
    return "\n".join([*found[: max(most, 1) - 1], last.rstrip(" .") + "…"])


def fitted_texts(texts: list[str], width: float, room: float, sizes: list[float], around: float = 0.0) -> tuple[float, list[str]]:
    """The size, and the texts cut so that they fit at it: what is too much is taken from the texts in proportion to their lines,
    but a line of each stays as long as one fits."""
    size = largest_size(texts, width, room, sizes, around)
    need = [len(lines(t, width, size)) for t in texts]
    have = max(int((room - around * len(texts)) / (size * LINE) + 1e-9), 0)
    if sum(need) <= have:
        return size, texts
    share = [max(1, n * have // sum(need)) for n in need]
    while sum(share) > max(have, len(share)):
        share[share.index(max(share))] -= 1
    return size, [cut(t, width, size, n) for t, n in zip(texts, share)]


def line_count(text: Column, width: float, size: float) -> Column:
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(lines(t or "", width, size)))

    return count(text)


def fitted(texts: Column, width: float, room: float, sizes: list[float], around: float = 0.0) -> Column:
    """An array of texts as struct<size, texts, shortened> for one box."""

    @F.pandas_udf("struct<size: double, texts: array<string>, shortened: boolean>")
    def fit(arrays: pd.Series) -> pd.DataFrame:
        rows = []
        for given in arrays:
            given = [t or "" for t in given] if given is not None else []
            size, kept = fitted_texts(given, width, room, sizes, around)
            rows.append((float(size), list(kept), kept != given))
        return pd.DataFrame(rows, columns=["size", "texts", "shortened"])

    return fit(texts)
