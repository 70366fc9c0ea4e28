"""Benchmark decontamination: rare word pairs as seeds, then Smith-Waterman alignment.

Every two words in a row of an item are a seed, found in a document where they stand side by side or with one word between.
A first pass counts the items' seeds over all documents.  A second joins passages to items by the rare ones alone, and aligns
each item with the words around its hits: match +2, mismatch -1, gap -1, on lower-cased words.  An alignment's score over the
item's own (2 a word) is its share; from THRESHOLD on the document is contaminated.

From a threshold of one half on no alignment is missed, however the copy is edited and however common the item's text is.  Of
an item's L words an alignment may lose 2 L (1 - threshold) points of 2 L.  Two words of the item in a row that are no seed in
it cost 2 points where two words or more are put between them or where one of them lies beyond an end of the alignment, and
m + 1 such pairs cost 3 m where m words are left out or changed: so two thirds of the points at most are pairs lost, and the
other pairs of L - 1 must be hit, as many as needed() states.  Of n pairs with so many hits, any n - needed + 1 have one among
them: the rarest so many are enough to find the document by, and pairs of common words find none.  Only where a document holds
a rare pair of an item are the other pairs counted, and with too few of them it is not aligned.  Of items of three words the
outer two are a seed as well, and one is enough.

Items are taken in waves of at most WAVE_WORDS words, the bound on what is broadcast and collected; documents are read where
they lie, twice a wave, and never shuffled.

Edge cases: null and blank texts hold nothing; items of fewer than SHORTEST words take no part; null ids are
kept as they are; repeated items and repeated documents each give their own rows; with equal scores the first passage counts;
an empty table on either side gives no matches; texts are searched whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, lean, mix, only, prefix_hashes, range_hash, text_blocks, word_spans

SHORTEST = 3
MATCH, MISMATCH, SKIP = 2, -1, 1
THRESHOLD = 0.5
WAVE_WORDS = 1_000_000
#: Seeds of items that the rows looked at together may hit; one row alone hits two for each word of a wave at most.
HITS = 1_000_000


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a block."""
    starts, ends, rows = word_spans(data, offsets)
    return range_hash(prefix_hashes(data, BASES[0]), starts, ends, BASES[0]), rows


def pairs(first: np.ndarray, second: np.ndarray, between: int) -> np.ndarray:
    """Hashes of word pairs with so many words between them."""
    h = mix(first * np.uint64(BASES[1]) + second)
    return mix(h + np.uint64(BASES[0])) if between else h


def needed(length: int, threshold: float) -> int:
    """In how many places an item's seeds lie at least in an alignment that reaches the threshold."""
    return 1 if length == SHORTEST else max(1, length - 1 - int(4 * length * (1 - threshold) / 3 + 1e-9))


def _items(items: DataFrame, id_column: str, text_column: str):
    """Waves of (id, word hashes)."""
    wave, size = [], 0
    rows = only(items, id_column, text_column).toDF("id", "text").where(F.col("text").isNotNull())
    for r in rows.toLocalIterator():
        data = np.frombuffer(pc.utf8_lower(pa.scalar(r["text"])).as_py().encode(), np.uint8)
        words = word_hashes(data, np.array([0, len(data)]))[0] if len(data) else np.zeros(0, np.uint64)
        if len(words) < SHORTEST:
            continue
        if wave and size + len(words) > WAVE_WORDS:
            yield wave
            wave, size = [], 0
        wave.append((r["id"], words))
        size += len(words)
    if wave:
        yield wave


class Wanted:
    """A sorted set of seeds that words are searched for; most are told apart by their first 16 bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.maybe = hashes, np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def found(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where seeds start among words, ascending, and which they are."""
        starts, places = [], []
        for step in (1, 2) if len(self.hashes) else ():
            h = pairs(words[:-step], words[step:], step - 1)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)] & (rows[:-step] == rows[step:]))
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[place] == h[at]
            starts.append(at[hit])
            places.append(place[hit])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, place = np.concatenate(starts), np.concatenate(places)
        order = np.argsort(at, kind="stable")
        return at[order], place[order]


def _blocks(text: pa.Array):
    """The words of each block and their rows, after the block's first row."""
    for a, _, data, offsets in text_blocks(pc.utf8_lower(text)):
        yield a, *word_hashes(data, offsets)


class Seeds(NamedTuple):
    """hashes: all seeds, sorted and distinct.  A slot is a place of an item: item[slot], position[slot] and, as the two words may
    have one between them, seed[slot], two of the hashes.  need: how many slots of each item must be hit."""

    hashes: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    position: np.ndarray
    need: np.ndarray


def _seeds(wave: list, threshold: float) -> Seeds:
    hashes, items, positions = [], [], []
    for k, (_, words) in enumerate(wave):
        left, right = np.arange(len(words) - 1), np.arange(1, len(words))
        if len(words) == SHORTEST:
            left, right = np.append(left, 0), np.append(right, 2)
        hashes.append(np.stack([pairs(words[left], words[right], between) for between in (0, 1)], axis=1))
        items.append(np.full(len(left), k))
        positions.append(left)
    distinct, seed = np.unique(np.concatenate(hashes), return_inverse=True)
    need = np.array([needed(len(words), threshold) for _, words in wave])
    return Seeds(distinct, seed.reshape(-1, 2), np.concatenate(items), np.concatenate(positions), need)


def rare_slots(seeds: Seeds, counts: np.ndarray) -> np.ndarray:
    """The slots by which documents are joined: of an item with n slots, `need` of which must be hit, any n - need + 1 have a hit
    among them, so those whose seeds the corpus holds least often are enough."""
    often = counts[seeds.seed].sum(axis=1)
    order = np.lexsort((often, seeds.item))
    slots = np.bincount(seeds.item, minlength=len(seeds.need))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(slots) - slots, slots)
    return np.sort(order[rank < (slots - seeds.need + 1)[seeds.item[order]]])


class Rare(NamedTuple):
    """The rare slots' seeds, sorted and distinct, and the items of seed s: item[first[s]:first[s + 1]]."""

    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray


def _rare(seeds: Seeds, slots: np.ndarray) -> Rare:
    seed, item = seeds.seed[slots].ravel(), np.repeat(seeds.item[slots], 2)
    both = np.unique(np.stack([seed, item], axis=1), axis=0)
    names, first = np.unique(both[:, 0], return_index=True)
    return Rare(seeds.hashes[names], np.append(first, len(both)), both[:, 1])


def _candidates(rare: Rare, items: int, row: np.ndarray, place: np.ndarray):
    """For hits (row, rare seed), by row: yields (row, items) that share a rare seed."""
    seen = np.unique(row * len(rare.hashes) + place)
    row, place = np.divmod(seen, max(1, len(rare.hashes)))
    n = rare.first[place + 1] - rare.first[place]
    size = np.cumsum(n)
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)) if len(row) else np.zeros(0, np.int64)
    a = 0
    while a < len(row):
        fit = ends[(ends > a) & (size[ends - 1] <= (size[a - 1] if a else 0) + HITS)]
        b = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, a, "right")])
        own = n[a:b]
        by = np.repeat(np.arange(a, b), own)
        item = rare.item[np.arange(len(by)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(rare.first[place[a:b]], own)]
        r, k = np.divmod(np.unique(row[by] * items + item), items)
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        yield from zip(r[np.append(0, cuts)].tolist(), np.split(k, cuts)) if len(r) else ()
        a = b


def counted_seeds(docs: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """How often each seed stands in all documents (text): tasks send sums, of which Spark makes one row a seed."""
    held = docs.sparkSession.sparkContext.broadcast(hashes)

    def count(batches):
        wanted, total = Wanted(held.value), np.zeros(len(held.value), np.int64)
        for batch in batches:
            for _, words, rows in _blocks(batch.column(0)):
                total += np.bincount(wanted.found(words, rows)[1], minlength=len(total))
        met = np.flatnonzero(total)
        for at in range(0, len(met), 100_000):
            part = met[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part])], ["seed", "n"])

    out = np.zeros(len(hashes), np.int64)
    for seed, n in docs.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n")).toLocalIterator():
        out[seed] = n
    held.unpersist()
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment: score, and the first and last word (exclusive) of the passage in it."""
    width = len(passage)
    ramp = np.arange(width + 1) * SKIP
    row, start = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        diagonal, down = row[:-1] + step, row[1:] - SKIP
        cell = np.zeros(width + 1, np.int64)
        cell[1:] = np.maximum(np.maximum(diagonal, down), 0)
        origin = np.arange(width + 1)
        origin[1:] = np.where(cell[1:] == 0, origin[1:], np.where(diagonal >= down, start[:-1], start[1:]))
        lifted = cell + ramp
        reach = np.maximum.accumulate(lifted)
        # Where a gap in the item is best, the alignment comes from the last column that reached this height.
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(width + 1), 0))
        row, start = reach - ramp, origin[source]
        top = int(row.max())
        if top > best[0]:
            end = int(row.argmax())
            best = (top, int(start[end]), end)
    return best


def _hits_of(seeds: Seeds, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hits by seeds, those of an item's slots: numbers of hits and slots."""
    lo, hi = np.searchsorted(seeds.item, [k, k + 1])
    own = seeds.seed[lo:hi].ravel()
    order = np.argsort(own, kind="stable")
    first, last = np.searchsorted(own[order], place), np.searchsorted(own[order], place, "right")
    n = last - first
    by = np.repeat(np.arange(len(place)), n)
    return by, lo + order[np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)] // 2


def _matches(wave, seeds, rare, threshold):
    """For a text column: yields (row, item, share, first word, last word) of the contaminated pairs."""
    seeds, rare = Seeds(*seeds), Rare(*rare)
    any_rare, every = Wanted(rare.hashes), Wanted(seeds.hashes)

    def search(text: pa.Array):
        for a, words, rows in _blocks(text):
            at, place = any_rare.found(words, rows)
            for row, items in _candidates(rare, len(wave), rows[at], place):
                first, last = np.searchsorted(rows, [row, row + 1])
                own, hit = every.found(words[first:last], rows[first:last])
                for k in items.tolist():
                    by, slot = _hits_of(seeds, k, hit)
                    if len(np.unique(slot)) < seeds.need[k]:
                        continue
                    item = wave[k][1]
                    origins = np.sort(own[by] - seeds.position[slot])
                    # An alignment that reaches one half has no more words put in than the item has.
                    reach, best = len(item), None
                    for group in np.split(origins, np.flatnonzero(np.diff(origins) > reach) + 1):
                        lo, hi = max(0, group[0] - reach), min(last - first, group[-1] + len(item) + reach)
                        score, x, y = align(item, words[first + lo : first + hi])
                        if best is None or score > best[0]:
                            best = (score, int(lo + x), int(lo + y))
                    if best[0] >= threshold * MATCH * len(item):
                        yield a + row, k, best[0] / (MATCH * len(item)), best[1], best[2]

    return search


def _searches(docs: DataFrame, items: DataFrame, threshold: float, text_column: str, item_id: str, item_text: str):
    """For each wave of items: what finds their copies."""
    texts = only(docs, text_column)
    for wave in _items(items, item_id, item_text):
        seeds = _seeds(wave, threshold)
        rare = _rare(seeds, rare_slots(seeds, counted_seeds(texts, seeds.hashes)))
        # As plain values: those are unpickled on a worker before this package is known there.
        yield docs.sparkSession.sparkContext.broadcast((wave, tuple(seeds), tuple(rare), threshold))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The contaminated pairs: id, item, share (of the item's own score), first_word and last_word (exclusive) of the passage."""
    rows = only(docs, id_column, text_column).toDF("id", "text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, item {items.schema[item_id].dataType.simpleString()}, share double, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for held in _searches(docs, items, threshold, text_column, item_id, item_text):

        def find(batches, held=held):
            wave = held.value[0]
            search = _matches(*held.value)
            for batch in batches:
                found = list(search(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                names = [wave[f[1]][0] for f in found]
                rest = [pa.array([f[i] for f in found], t) for i, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names) if names else pa.array([], pa.int64()), *rest], ["id", "item", "share", "first_word", "last_word"])

        out = out.union(rows.mapInArrow(find, schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without its contaminated rows; all columns stay."""
    for held in _searches(docs, items, threshold, text_column, item_id, item_text):
        at = docs.columns.index(text_column)

        def keep(batches, held=held, at=at):
            search = _matches(*held.value)
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[f[0] for f in search(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = lean(docs).mapInArrow(keep, docs.schema)
    return docs
