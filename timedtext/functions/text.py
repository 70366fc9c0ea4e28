"""Text functions: words, timestamps, white space, markup, excerpts.

"""

from __future__ import annotations

import functools
import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The character ranges that the word counters treat as one unit each, and what counts as white space.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}"
CJK_SUMMARY = r"\x{3400}-\x{9fff}"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LETTER = r"\p{L}\p{N}"
APOSTROPHE = "['’]"
STAMP = r"\[[0-9]+:[0-9]{2}:[0-9]{2}\]"
#: Entities that the native cleaner knows, in order; the ampersand comes last so that nothing is unescaped twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def count_words(text: Column) -> Column:
    """F01, the planner's counter: a CJK character is a word, other letters and digits are by runs without such characters."""
    word = f"[{LETTER}&&[^{CJK}]]+"
    return F.regexp_count(text, F.lit(f"[{CJK}]|{word}(?:{APOSTROPHE}{word})*"))


def word_count(text: Column) -> Column:
    """F02, the summaries' counter: runs of letters and digits may begin outside the CJK range and go on into it."""
    return F.regexp_count(text, F.lit(f"[{CJK_SUMMARY}]|[{LETTER}]+(?:{APOSTROPHE}[{LETTER}]+)*"))


def seconds(value: Column) -> Column:
    """mm:ss or h:mm:ss, with a comma or a point; NULL if minutes or seconds reach 60 or a part is no number."""
    parts = F.split(F.replace(value, F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    hours = F.when(n == 3, F.get(parts, F.lit(0))).otherwise(F.lit("0")).try_cast("bigint")
    minutes, rest = F.get(parts, n - 2).try_cast("int"), F.get(parts, n - 1).try_cast("double")
    return F.when(n.isin(2, 3) & (minutes < 60) & (rest < 60), hours * 3600 + minutes * 60 + rest)


def collapse(text: Column) -> Column:
    """runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@functools.cache
def _folds() -> tuple[str, str, list[tuple[str, str]], str]:
    """Unicode's full case folding, which looks at no neighbours: the characters that become one other, those others, the
    characters that become several, with these, and a pattern of few ranges that hold the latter."""
    found = [(c, c.casefold()) for c in map(chr, range(0x110000)) if c.casefold() != c]
    one = [(c, f) for c, f in found if len(f) == 1]
    several = [(c, f) for c, f in found if len(f) > 1 and c != "ß"]
    places = [ord(c) for c, _ in several]
    firsts = [b for a, b in zip([-100, *places], places) if b - a > 64]
    lasts = [a for a, b in zip(places, [*places[1:], 1 << 30]) if b - a > 64]
    ranges = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(firsts, lasts))
    return "".join(c for c, _ in one), "".join(f for _, f in one), several, f"[{ranges}]"


def unescape(text: Column, exact: bool = False) -> Column:
    """Entities to characters: the listed ones natively, or all of HTML by an Arrow function."""
    if exact:
        return _unescape(text)
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def clean_text(text: Column, exact: bool = False) -> Column:
    """tags go, then entities are read, then white space is collapsed, in this order."""
    return collapse(unescape(F.regexp_replace(text, "<[^>]*>", ""), exact))


def casefold(text: Column, exact: bool = False) -> Column:
    """lower case with sharp s spelt out; exactly by Unicode's table, natively as well.

    Texts in ASCII need no table, and few hold any but sharp s of the hundred characters that become several."""
    if not exact:
        return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    before, after, several, there = _folds()
    plain = F.replace(text, F.lit("ß"), F.lit("ss"))
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f).alias("f")) for c, f in several])
    spelt = F.aggregate(pairs, plain, lambda t, p: F.replace(t, p.c, p.f))
    folded = F.translate(F.when(text.rlike(there), spelt).otherwise(plain), before, after)
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(F.lower(text))


def word_key(word: Column, exact: bool = False) -> Column:
    """without marks at either end, case-folded."""
    return casefold(F.regexp_replace(word, rf"^[^{LETTER}_]+|[^{LETTER}_]+$", ""), exact)


def stamp(time: Column) -> Column:
    """HH:MM:SS, cut to whole seconds, never negative."""
    whole = F.greatest(time.cast("bigint"), F.lit(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(whole / 3600)
    return F.concat(F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), F.lit(":"), two(F.floor(whole % 3600 / 60)), F.lit(":"), two(whole % 60))


def clock(time: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    whole = F.greatest(time.cast("bigint"), F.lit(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes = F.floor(whole / 3600), F.floor(whole % 3600 / 60)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(whole % 60))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(whole % 60)))


def normalized(text: Column, exact: bool = False) -> Column:
    """without [h:mm:ss] marks, collapsed, case-folded; so a quote may run across cues."""
    return casefold(collapse(F.regexp_replace(text, STAMP, "")), exact)


def with_excerpt(rows: DataFrame, name: str, source: Column, max_words: int | Column, title: Column, note: str = "Excerpt; no AI summary.") -> DataFrame:
    """rows with the first words of the source that fit beside the title and the note, with an ellipsis if it is cut.

    Each part is a column of its own, so that the text is cleaned and each word counted once.
    """
    room = (F.lit(max_words) if isinstance(max_words, int) else max_words) - word_count(F.concat(title, F.lit(" "), F.lit(note)))
    staged = rows.withColumns({"_text": collapse(F.regexp_replace(source, STAMP, "")), "_room": room})
    staged = staged.withColumn("_words", F.slice(F.split("_text", " "), F.lit(1), F.greatest("_room", F.lit(1))))
    staged = staged.withColumn("_counts", F.transform("_words", word_count))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("seen"), F.lit(0).alias("total"))
    step = lambda a, n: F.struct(F.when(a.total + n <= F.col("_room"), a.seen + 1).otherwise(a.kept).alias("kept"), (a.seen + 1).alias("seen"), (a.total + n).alias("total"))
    staged = staged.withColumn("_kept", F.aggregate("_counts", start, step, lambda a: a.kept))
    first = F.get("_words", F.lit(0))
    letters = F.filter(F.sequence(F.lit(0), F.length(first)), lambda n: word_count(first.substr(F.lit(1), n)) <= F.col("_room"))
    part = first.substr(F.lit(1), F.coalesce(F.array_max(letters), F.lit(0)))
    staged = staged.withColumn("_body", F.when(F.col("_kept") > 0, F.array_join(F.slice("_words", F.lit(1), F.greatest("_kept", F.lit(1))), " ")).otherwise(part))
    whole = (F.col("_text") == "") | (F.col("_body") == F.col("_text"))
    return staged.withColumn(name, F.when(whole, F.col("_text")).otherwise(F.concat("_body", F.lit("…")))).drop("_text", "_room", "_words", "_counts", "_kept", "_body")


def shorten(text: Column, limit: int | Column) -> Column:
    """at most limit characters; cut at a space if one lies beyond 60 % of them; with an ellipsis."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = text.substr(F.lit(1), F.greatest(limit - 1, F.lit(1)))
    space = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_space = (F.locate(" ", F.reverse(cut)) > 0) & (space > F.length(cut) * 0.6)
    body = F.when(at_space, cut.substr(F.lit(1), space)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(body, F.lit(" .\n")), F.lit("…")))


def escape_html(text: Column) -> Column:
    """F15."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def content_key(value: Column, length: int = 64) -> Column:
    """F16: hex SHA-256, cut to length."""
    return F.left(F.sha2(value.cast("binary"), 256), F.lit(length))


def data_url(content: Column, mime: Column) -> Column:
    """F17."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def general(number: Column, digits: int = 6) -> Column:
    """a number with so many significant digits and no zeros after them; with an exponent from 10 ** digits on, and below
    0.0001.  It is rounded as it is held, ties to even, for which it takes an Arrow function: Java's formats round the shortest
    decimal that reads as the number, ties up."""

    @F.pandas_udf(StringType())
    def shown(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: f"{x:.{digits}g}")

    number = number.cast("double")
    return F.when(number.isNotNull(), shown(number))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """regex rules, applied one after the other."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def quote_path(path: Column) -> Column:
    """a path in single quotes for a concat manifest."""
    return F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))
