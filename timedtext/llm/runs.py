"""Periodic runs of words by Kolpakov and Kucherov: stretches that repeat with one period and cannot be made longer.

A text's words are numbered from 0.  A run is a stretch with smallest period q (words q apart are alike), at least LEAST words
and TIMES periods long, that no neighbour extends.  They are found in four steps, each over a stretch of one text:

1. A suffix automaton gives the Lempel-Ziv factors: each the longest string that also starts earlier, or one new word.
2. Main's algorithm finds, at the border of two factors, all runs that cross or touch it, from common extensions of each period
   to both sides.  A run that starts q or more words before the left factor would have made that factor longer; so a run that
   ends in factor k starts within 2 |k-1| + |k| words of its border, and the work is linear in the text but for the extensions
   counted with those lengths.
3. What then is missing lies strictly inside a factor, and is copied from the factor's earlier occurrence, left to right, so
   that copies may be copied.
4. Only runs of the asked length are kept, at every step: a copy is as long as its original.

Before that, stretches that cannot hold such a run are passed over.  In a run of period q, with TIMES periods, every string of
k <= q words that starts in its last TIMES - 1 periods began q words before, too.  So for each power of two, Q, a run with
Q <= q < 2Q leaves at least (TIMES - 1) Q - k + 1 starts in a row whose string of k = min(Q, GRAM) words last began less than 2Q
words before.  Stretches around such rows, with one word more on each side, hold every run whole.  Strings are compared by
64-bit hashes here, which can only add stretches; the steps above compare words.  reach=False takes whole texts instead.

Rows are judged one by one, so nothing is shuffled; a worker holds one text's words and the automaton of one stretch, about
500 bytes a word.  Edge cases: null and blank texts have no words and no runs; null ids are kept as they are; repeated rows are
judged each; empty tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, only, prefix_hashes, range_hash, text_blocks, word_spans

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 6, 4
#: Strings of up to so many words tell where a text may repeat.
GRAM = 8
SCHEMA = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def z_values(s: list) -> list[int]:
    """z[i]: how many elements from i on equal those from 0 on; z[0] is the length."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def automaton(words: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton: transitions, and for each state where its strings first end."""
    step, link, longest, first = [{}], [-1], [0], [-1]
    last = 0
    for at, c in enumerate(words):
        now = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step, first


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of an earlier occurrence or -1); occurrences may overlap."""
    step, first = automaton(words)
    out, at, n = [], 0, len(words)
    while at < n:
        state, length, source = 0, 0, -1
        while at + length < n:
            state = step[state][words[at + length]]
            begin = first[state] - length
            if begin >= at:
                break
            source = begin
            length += 1
        out.append((at, max(length, 1), source))
        at += max(length, 1)
    return out


def _at_border(words: list[int], border: int, left: int, right: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, a period) that cross or touch the border, between words[left:border] and words[border:right]."""
    t, v = words[left:border], words[border:right]
    n, n_t, n_v = len(words), len(t), len(v)
    t_back, v_back = t[::-1], v[::-1]
    after_v = z_values(v)
    before_t = z_values(t_back)
    before_v = z_values(t_back + [-1] + v_back + t_back)[n_t + 1 :]  # text is read backwards from the end of v
    after_t = z_values(v + [-1] + t + v)[n_v + 1 :]
    for q in range(1, max(n_t, n_v) + 1):
        found = []
        if q <= n_v:
            before, after = before_v[n_v - q], after_v[q] if q < n_v else 0
            if before + after >= q:
                found.append((border - before, border + q + after))
        if q <= n_t:
            before, after = before_t[q] if q < n_t else 0, min(after_t[n_t - q], n_v)
            if before + after >= q:
                found.append((border - q - before, border + after))
        for start, end in found:
            if end - start < least or end - start < times * q:
                continue
            if (start == 0 or words[start - 1] != words[start - 1 + q]) and (end == n or words[end] != words[end - q]):
                yield start, end, q


def runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of at least `least` words and `times` (2 or more) periods, in order."""
    parts = factors(words)
    found: dict[tuple[int, int], int] = {}
    borders = [*parts, (len(words), 0, -1)]
    for (at, length, _), (next_at, next_length, _) in zip(borders, borders[1:]):
        reach = max(0, next_at - 2 * length - next_length - 1)
        for start, end, q in _at_border(words, next_at, reach, next_at + next_length, least, times):
            if q < found.get((start, end), q + 1):
                found[start, end] = q
    by_start: dict[int, list[tuple[int, int]]] = {}
    for (start, end), q in found.items():
        by_start.setdefault(start, []).append((end, q))
    if by_start:
        for at, length, source in parts:
            if source < 0 or length < least + 2:
                continue
            for start in range(source + 1, source + length - 1):
                for end, q in by_start.get(start, ()):
                    if end < source + length:
                        moved = start - source + at, end - source + at
                        if moved not in found:
                            found[moved] = q
                            by_start.setdefault(moved[0], []).append((moved[1], q))
    return sorted((start, end, q) for (start, end), q in found.items())


def _last_seen(keys: np.ndarray) -> np.ndarray:
    """How far back each key stood last; a number beyond all lengths if never."""
    order = np.argsort(keys, kind="stable")
    gaps = np.full(len(keys), np.iinfo(np.int64).max // 4)
    same = keys[order[1:]] == keys[order[:-1]]
    gaps[order[1:][same]] = (order[1:] - order[:-1])[same]
    return gaps


def _rows_of_true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
    return edges[::2], edges[1::2]


def stretches(hashes: np.ndarray, first: np.ndarray, times: int = TIMES) -> np.ndarray:
    """Stretches [start, end) of the words that hold every run whole, with a neighbour on each side.

    hashes: of all words of several texts; first: where each text starts, and the number of words at last.
    """
    n = len(hashes)
    found, text = [], np.repeat(np.arange(len(first) - 1), np.diff(first))
    prefix = prefix_hashes(hashes, BASES[0])
    longest = int(np.diff(first).max(initial=0))
    size, seen = 1, {}
    while times * size <= longest:
        k = min(size, GRAM)
        if k not in seen:
            starts = np.arange(n - k + 1)
            whole = text[starts] == text[starts + k - 1]
            keys = range_hash(prefix, starts, starts + k, BASES[0]) ^ (text[starts].astype(np.uint64) * np.uint64(BASES[1]))
            seen = {k: (_last_seen(keys), whole)}
        gaps, whole = seen[k]
        start, end = _rows_of_true((gaps < 2 * size) & whole)
        enough = end - start >= (times - 1) * size - k + 1
        start, end = start[enough], end[enough]
        low, high = first[text[start]], first[text[start] + 1]
        found.append(np.stack([np.maximum(start - 2 * size, low), np.minimum(end + k, high)], 1))
        size *= 2
    if not found:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate(found)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    if not len(spans):
        return spans
    # Stretches that share a word become one; those of different texts share none.
    upto = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] >= upto[:-1]])
    return np.stack([spans[fresh, 0], np.append(upto[np.flatnonzero(fresh)[1:] - 1], upto[-1])], 1)


def _judged(ids: list, texts: pa.Array, reach: bool, least: int, times: int) -> Iterator[tuple]:
    for low, high, data, offsets in text_blocks(texts):
        raw, starts = data.tobytes(), offsets.tolist()
        rows = [raw[starts[i] : starts[i + 1]].split() for i in range(high - low)]
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        if reach:
            flat = np.frombuffer(b" ".join(w for r in rows for w in r), np.uint8)
            begin, end, _ = word_spans(flat, np.array([0, len(flat)]))
            spans = stretches(range_hash(prefix_hashes(flat, BASES[0]), begin, end, BASES[0]), first, times)
        else:
            spans = np.stack([first[:-1], first[1:]], 1)
        place = np.searchsorted(first, spans[:, 0], "right") - 1
        by_row: dict[int, list] = {}
        for row, (begin, end) in zip(place.tolist(), spans.tolist()):
            base = int(first[row])
            numbers: dict[bytes, int] = {}
            words = [numbers.setdefault(w, len(numbers)) for w in rows[row][begin - base : end - base]]
            shift = begin - base
            by_row.setdefault(row, []).extend((s + shift, e + shift, q) for s, e, q in runs(words, least, times))
        for row, words in enumerate(rows):
            found = sorted(by_row.get(row, []))
            kept = words
            if found:
                gone = bytearray(len(words))
                for s, e, q in found:
                    gone[s + q : e] = b"\x01" * (e - s - q)
                kept = [w for w, g in zip(words, gone) if not g]
            yield ids[low + row], len(words), [{"start": s, "length": e - s, "period": q} for s, e, q in found], b" ".join(kept).decode()


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: bool = True, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """id, n_words, runs in order, and the text without what runs repeat: their words after the first period."""
    if least < 1 or times < 2:
        raise ValueError("runs have at least one word and two periods")

    def judge(batches):
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])
        for batch in batches:
            out, size = [], 0
            for row in _judged(batch.column(0).to_pylist(), batch.column(1), reach, least, times):
                out.append(row)
                size += len(row[3])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    texts = only(docs, id_column, text_column)
    texts = texts.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("binary"))
    return texts.mapInArrow(judge, SCHEMA)
