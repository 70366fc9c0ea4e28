"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

The channel writes a word's letters as look-alike digits and signs, repeats letters, puts separators between them, or spaces
them out.  A written word that shows traces of this becomes a lattice: each run of equal characters offers the letters it may
stand for, once or twice, or nothing, at a cost; Viterbi finds the cheapest path under a letter trigram model, which is
counted over the whole corpus.  Runs of three or more single letters are one written word whose gaps may be word ends.

The score is a logistic model over restored words and their first four to seven bytes, each at one, two and four
occurrences or more, so that a long clean text that holds a word by chance is told from one that dwells on it.  It is fitted to
a bounded sample of labelled rows (sample of each class, those with the least hash of their id) and keeps at most `features` of
them, those that speak for toxicity most surely by a likelihood ratio; these are the bounds in this module.  The ratio is
against the classes' share, not a number of rows, so that the words of a rare language count as soon as they are sure.  The
intercept is set back to the classes' true shares.  Labels, ids, language and source are never inputs.

Edge cases: null and blank texts get the intercept's score; texts are taken whole, whatever their length; without labelled
rows of both classes the score is the share of toxic rows among the labelled (0 if there are none); an id labelled twice
counts as toxic if one label says so; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, checkpointed, lean, only, prefix_hashes, range_hash, text_blocks, word_spans

#: Labelled rows of each class that the classifier is fitted to, and the features it keeps: both bound the driver's memory.
SAMPLE = 4000
FEATURES = 2000
#: Least log likelihood ratio of a feature that is kept; in cross-validation on training rows anything from 3 to 15 does as well.
LEAST_GAIN = 5
PREFIXES = (4, 5, 6, 7)
#: Occurrences in a text from which a feature counts again.
LEVELS = (1, 2, 4)
#: Written words of up to so many characters are decoded once a task; longer ones are not kept.
REMEMBERED = 64
THRESHOLD = 0.3
#: Letters that a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
LOOK_COST, VOWEL_COST, DROP_SIGN, DROP_STAR, DROP_LOOK, SHRINK, TWICE, UNDOUBLE, GAP = -1.0, -2.0, -0.4, -1.5, -10.0, -0.3, -0.6, -6.0, -0.2
EDGE, OTHER, SYMBOLS = 26, 27, 28

_CLASS = np.full(256, EDGE, np.int64)
_CLASS[128:] = OTHER
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = _i
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = _CLASS != EDGE
_SIGN = ~_LETTER
_SIGN[[0x20, 9, 10, 11, 12, 13]] = False
_TRAIL = np.zeros(256, bool)
_TRAIL[[*range(48, 58), ord("@"), ord("$")]] = True
#: Signs that stand for a letter at a word's end too, once or twice.
_END = np.zeros(256, bool)
_END[[ord(c) for c in "@$+*(<|#"]] = True


def letter_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Letter trigram counts over all texts; what isn't a letter is a word's edge."""

    def task(batches):
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, _ in text_blocks(batch.column(0)):
                c = np.concatenate([[EDGE, EDGE], _CLASS[data], [EDGE]])
                counts += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    rows = only(docs, text_column).mapInArrow(task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 28^3 at most
    out = np.zeros(SYMBOLS**3)
    for at, n in rows:
        out[at] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(third letter | first, second), each order smoothed by the next shorter one."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        p = (c + 5 * p) / (c.sum(axis=-1, keepdims=True) + 5)
    return np.log(p)


def _options(sign: str, run: int, spaced: bool) -> list[tuple[str, float]]:
    """What a run of one character may stand for, and at what cost."""
    found = {}
    if sign.isalpha():
        found[sign] = 0.0
        for x in LOOKS.get(sign, ""):
            found[x] = LOOK_COST * 2
    else:
        for x in LOOKS.get(sign, ""):
            found[x] = VOWEL_COST if sign == "*" else LOOK_COST
    out = []
    for x, cost in found.items():
        if run == 1:
            out.append((x, cost))
        elif run == 2:
            out += [(x * 2, cost), (x, cost + UNDOUBLE)]
        else:
            out += [(x, cost + SHRINK), (x * 2, cost + TWICE)]
    if not sign.isalpha():
        out.append(("", DROP_STAR if sign == "*" else DROP_LOOK if sign in LOOKS else DROP_SIGN))
    if spaced:
        out += [(x + " ", cost + GAP) for x, cost in out if x]
    return out


def _code(letter: str) -> int:
    return EDGE if letter == " " else ord(letter) - 97 if "a" <= letter <= "z" else OTHER


def restore(word: str, model: np.ndarray, spaced: bool = False) -> str:
    """The Viterbi path through the lattice of one written word: its likeliest letters."""
    word, runs = word.lower(), []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1][1] += 1
        else:
            runs.append([c, 1])
    states = {(EDGE, EDGE): (0.0, None)}  # the last two letters -> the best cost and a path, linked backwards
    for sign, run in runs:
        after = {}
        for (a, b), (cost, path) in states.items():
            for letters, extra in _options(sign, run, spaced):
                x, y, total = a, b, cost + extra
                for letter in letters:
                    z = _code(letter)
                    total += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, (letters, path))
        states = after
    _, path = max(((cost + model[a, b, EDGE], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)).strip()


def _hashes(text: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    prefix = prefix_hashes(np.frombuffer(text, np.uint8), BASES[0])
    a = np.array(spans, np.int64).reshape(-1, 2)
    return range_hash(prefix, a[:, 0], a[:, 1], BASES[0])


def _word_features(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = w.encode()
        out += _hashes(b, [(0, len(b))]).tolist() + [h ^ n for n in PREFIXES if len(b) >= n for h in _hashes(b, [(0, n)]).tolist()]
    return np.array(out, np.uint64)


def _spaced_features(run: str, restored: str) -> np.ndarray:
    """A spaced run's words, and every part of 4 to 12 letters, as its own spacing is unsure."""
    b = restored.replace(" ", "").encode()
    parts = [(i, i + n) for n in range(4, 13) for i in range(len(b) - n + 1)]
    out = [_word_features(restored.split())]
    if parts:
        h = _hashes(b, parts)
        out += [h, *(h[np.array([y - x == n for x, y in parts])] ^ np.uint64(n) for n in PREFIXES)]
    return np.concatenate(out)


class Restorer:
    """Finds the written words that need decoding, decodes each distinct one once, and gives features of restored texts."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        table = np.asarray(model)

        def features(word: str, spaced: bool) -> np.ndarray:
            restored = restore(word, table, spaced)
            return _spaced_features(word, restored) if spaced else _word_features(restored.split())

        kept = lru_cache(1 << 14)(features)
        self.features = lambda word, spaced: (kept if len(word) <= REMEMBERED else features)(word, spaced)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature of every word of a block, with those of restored words."""
        data = _LOWER[data]
        letter = _LETTER[data]
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        full = offsets[:-1] < offsets[1:]
        first[offsets[:-1][full]] = letter[offsets[:-1][full]]
        last[offsets[1:][full] - 1] = letter[offsets[1:][full] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        rows = np.searchsorted(offsets, starts, "right") - 1
        prefix = prefix_hashes(data, BASES[0])
        out_rows, out = [rows], [range_hash(prefix, starts, ends, BASES[0])]
        for n in PREFIXES:
            long = ends - starts >= n
            out_rows.append(rows[long])
            out.append(range_hash(prefix, starts[long], starts[long] + n, BASES[0]) ^ np.uint64(n))
        # Traces of the channel: a sign before a letter, a digit or such after one, a sign or two at a word's end, a letter
        # three times, three letters in a row twice each, single letters in a row.
        trace = np.zeros(len(data), bool)
        if len(data) > 2:
            trace[:-1] = _SIGN[data[:-1]] & letter[1:]
            trail = letter[:-1] & _TRAIL[data[1:]]
            trail[:-1] &= data[1:-1] != data[2:]
            trace[:-1] |= trail
            trace[:-1] |= letter[:-1] & _END[data[1:]]
            same = data[:-1] == data[1:]
            trace[:-2] |= letter[:-2] & same[:-1] & same[1:]
            if len(same) > 4:
                trace[: len(same) - 4] |= letter[: len(same) - 4] & same[:-4] & same[2:-2] & same[4:]
        w_starts, w_ends, w_rows = word_spans(data, offsets)
        at = np.unique(np.searchsorted(w_starts, np.flatnonzero(trace), "right") - 1) if len(w_starts) else np.zeros(0, np.int64)
        raw = data.tobytes()
        for k in at.tolist():
            if k < 0 or not letter[w_starts[k] : w_ends[k]].any():
                continue
            f = self.features(raw[w_starts[k] : w_ends[k]].decode("utf-8", "replace"), False)
            out_rows.append(np.full(len(f), w_rows[k]))
            out.append(f)
        single = (w_ends - w_starts == 1) & (letter[w_starts] | _TRAIL[data[w_starts]] | (data[w_starts] == 33)) if len(w_starts) else np.zeros(0, bool)
        if single.any():
            edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                cuts = [a, *(np.flatnonzero(np.diff(w_rows[a:b])) + a + 1).tolist(), b]
                for x, y in zip(cuts, cuts[1:]):
                    if y - x >= 3:
                        f = self.features(data[w_starts[x:y]].tobytes().decode("ascii", "replace"), True)
                        out_rows.append(np.full(len(f), w_rows[x]))
                        out.append(f)
        return np.concatenate(out_rows), np.concatenate(out)


def _fit(rows: np.ndarray, columns: np.ndarray, width: int, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A ridge logistic model: weights of the columns, intercept."""
    w, b = np.zeros(width), math.log((labels == 1).sum() / (labels == 0).sum())
    size = np.bincount(rows, minlength=len(labels)) + 1.0  # of each row: bounds the curvature, so that steps never overshoot
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[columns], len(labels)), -30, 30)))
        err, curve = p - labels, p * (1 - p) * size
        w -= (np.bincount(columns, err[rows], width) + w) / (np.bincount(columns, curve[rows], width) + 1)
        b -= err.sum() / max(curve.sum(), 1e-9)
    return w, b


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, least_gain: float = LEAST_GAIN):
    """The letter model, and the classifier fitted to labelled rows for which usable (a condition on `id`) holds.

    The classifier: features, their weights at each of LEVELS, intercept.
    """
    spark = docs.sparkSession
    model = letter_model(letter_counts(docs, text_column))
    known = only(labels, id_column, label_column).toDF("id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & usable).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    nothing = np.zeros(0, np.uint64), np.zeros((0, len(LEVELS)))
    if not (sizes.get(0) and sizes.get(1)):
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return model, (*nothing, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    least = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample) for c in (1, 0)]
    texts = only(docs, id_column, text_column).toDF("id", "text").join(F.broadcast(least[0].union(least[1])), "id").select("id", "text", "toxic")
    held = spark.sparkContext.broadcast(model)

    def task(batches):
        restorer = Restorer(held.value)
        for batch in batches:
            found, times = [], []
            for a, b, data, offsets in text_blocks(batch.column(1)):
                rows, words = restorer.block(data, offsets)
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(b - a + 1))
                for x, y in zip(cuts, cuts[1:]):
                    names, n = np.unique(words[order[x:y]], return_counts=True)
                    found.append(names.view(np.int64))
                    times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))], ["id", "toxic", "f", "n"])

    sampled = checkpointed(texts.mapInArrow(task, f"id {texts.schema['id'].dataType.simpleString()}, toxic int, f array<long>, n array<int>"))
    # A repeated row is one more row of the sample; all its copies are numbered alike.
    y_rows = sampled.groupBy("id").agg(F.max("toxic").alias("toxic")).collect()
    number, y = {r[0]: i for i, r in enumerate(y_rows)}, np.array([r[1] for r in y_rows], np.int64)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not (n1 and n0):
        return model, (*nothing, math.log(sizes[1] / sizes[0]))
    pairs = sampled.select("id", "toxic", F.inline(F.arrays_zip("f", "n"))).select("id", "toxic", "f", F.explode(F.filter(F.array(*map(F.lit, LEVELS)), lambda level: level <= F.col("n"))).alias("level"))
    single = pairs.distinct()
    counts = single.groupBy("f", "level").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    share, both = n1 / (n1 + n0), F.col("t") + F.col("c")
    gain = F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - share)))).otherwise(0.0)
    best = counts.where(F.col("t") > both * share).withColumn("gain", gain).where(F.col("gain") > least_gain).orderBy(F.col("gain").desc(), "f", "level").limit(features)
    chosen = best.select("f", "level").collect()
    names = np.unique(np.array([r[0] for r in chosen], np.int64).view(np.uint64))
    wanted = spark.createDataFrame([(int(f), int(level)) for f, level in chosen], "f long, level int")
    held_pairs = single.join(F.broadcast(wanted), ["f", "level"]).select("id", "f", "level").toArrow()
    ids = held_pairs.column("id").combine_chunks().dictionary_encode()
    rows = np.array([number[i] for i in ids.dictionary.to_pylist()], np.int64)[ids.indices.to_numpy()]
    f, level = held_pairs.column("f").to_numpy().view(np.uint64), held_pairs.column("level").to_numpy()
    column = np.searchsorted(names, f) * len(LEVELS) + np.searchsorted(LEVELS, level)
    weights, bias = _fit(rows, column, len(names) * len(LEVELS), y)
    bias += math.log(sizes[1] / sizes[0]) - math.log(n1 / n0)
    return model, (names, weights.reshape(-1, len(LEVELS)), bias)


def _scorer(held):
    """Scores of a text column, on a worker."""
    model, (names, weights, bias) = held.value
    restorer = Restorer(model)
    maybe = np.zeros(1 << 16, bool)
    maybe[(names >> np.uint64(48)).astype(np.int64)] = True
    total_weight = np.cumsum(weights, axis=1)  # of a feature that has reached a level

    def scores(text: pa.Array) -> np.ndarray:
        total = np.full(len(text), bias)
        for a, b, data, offsets in text_blocks(text):
            if not len(names):
                break
            r, f = restorer.block(data, offsets)
            hit = maybe[(f >> np.uint64(48)).astype(np.int64)]
            r, f = r[hit], f[hit]
            at = np.minimum(np.searchsorted(names, f), len(names) - 1)
            hit = names[at] == f
            pair, n = np.unique(r[hit] * len(names) + at[hit], return_counts=True)
            total[a:b] += np.bincount(pair // len(names), total_weight[pair % len(names), np.searchsorted(LEVELS, n, "right") - 1], b - a)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    return scores


def score(docs: DataFrame, trained, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(trained)
    rows = only(docs, id_column, text_column).toDF("id", "text")

    def task(batches):
        scores = _scorer(held)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["id", "score"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, trained, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay."""
    held, at = docs.sparkSession.sparkContext.broadcast(trained), docs.columns.index(text_column)

    def task(batches):
        scores = _scorer(held)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < threshold))

    return lean(docs).mapInArrow(task, docs.schema)
