"""LM scoring: an interpolated modified Kneser-Ney model, counted in Spark and read by workers as memory-mapped arrays.

The order is 2, a word after a word.  Counting has three passes, each of which adds up what a task has made distinct before
it sends it on:

1. Words: a sorted array of word hashes with their counts, cut into shards by hash.  A word's id is its place in it.
2. Word pairs: a sorted array of keys (context id, word id) with their counts, cut into shards by context; the pairs of a
   frequent context, one with more than a quarter of a shard's tokens, are dealt to all shards by word.  Each shard also
   writes how many words follow its contexts once, twice, or more.
3. Continuations: in how many contexts each word stands.

Counts of a pair that don't fit a byte are in a second sorted array.  The arrays are files in the shared folder; a file gets
its name when it is whole, so a task that is run again, or twice, does no harm.  Workers map the files of the shards that a
block of text hits; lookups go through binary search, with the words of a block made distinct first.  All arrays grow with the
corpus and none is held in memory; there is a shard for each SHARD_BYTES of text, which bounds what a task adds up.  A word's
id takes 32 bits, so a corpus may have as many distinct words.

log10 p(text) sums over its words and one end token, each after the word before it, the first after a start token, with
  p(w | b) = (c(b w) - D(c(b w))) / c(b) + g(b) p(w),   p(w) = (n(w) - D'(n(w))) / n + g' / (V + 1)
where n(w) counts the contexts of w, n all distinct pairs and V the distinct training tokens; D and D' are the three
discounts from counts of counts (0.5, 1 and 1.5 where a small corpus gives none), and g the mass they free.  Words that
training lacks have n(w) = 0, contexts that it lacks give p(w).

Edge cases: null and blank texts are the end token alone; with no training text p(w) is 1 / (V + 1) and V is 0; repeated rows
are counted and scored each; texts are taken whole, whatever their length; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, checkpointed, mix, only, pack, prefix_hashes, range_hash, shared_path, text_blocks, unpack, word_spans
from .exchange import fan, put, take, unzipped, widths, zipped

#: Distinct entries that a task gathers before it sends them on; bounds its memory.
GATHER = 1 << 20
#: Text bytes for each shard.
SHARD_BYTES = 16 << 20
#: Files of one kind that a task keeps mapped.
MAPPED = 4096
MESSAGE = "kind int, shard int, body binary"
FALLBACK = (0.5, 1.0, 1.5)


@dataclass
class Model:
    folder: str
    shards: int
    vocabulary: list[int] = field(default_factory=list)  # words in each shard
    tokens: int = 0
    texts: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # frequent contexts in order, and for each how
    after_hot: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))  # many words follow once, twice, more
    present: dict[str, bytes] = field(default_factory=dict)  # for each kind of file a bit a shard: whether it was written
    pairs: int = 0
    discounts: tuple[float, float, float] = FALLBACK
    word_discounts: tuple[float, float, float] = FALLBACK
    word_mass: float = 1.0

    @property
    def words(self) -> int:
        return sum(self.vocabulary)

    @property
    def distinct(self) -> int:
        return self.words + (self.texts > 0)

    @property
    def end(self) -> int:
        """The end token's id; as a context, the start token's."""
        return self.words

    def wrote(self, shards: list[int], *names: str) -> None:
        bits = np.zeros(self.shards, bool)
        bits[shards] = True
        self.present |= dict.fromkeys(names, np.packbits(bits).tobytes())

    def has(self, name: str, shard: int) -> bool:
        bits = self.present.get(name, b"")
        return shard >> 3 < len(bits) and bool(bits[shard >> 3] >> (7 - (shard & 7)) & 1)

    def span(self, shard: int) -> tuple[int, int]:
        """The ids, start and end tokens included, whose arrays a shard holds."""
        n = self.words + 1
        return n * shard // self.shards, n * (shard + 1) // self.shards


def _write(folder: str, name: str, values: np.ndarray) -> None:
    path = f"{folder}/{name}"
    temporary = f"{path}.{uuid.uuid4().hex}"
    values.tofile(temporary)
    os.replace(temporary, path)


def _map(folder: str, name: str, dtype) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


class _Maps:
    """The files of one kind by shard, mapped when they are first asked for.

    A shard for which none was written has an empty array; one that was written but is not there is an error, as scores without
    it would be wrong."""

    def __init__(self, model: Model, name: str, dtype):
        self.model, self.name, self.dtype, self.open = model, name, dtype, OrderedDict()

    def __getitem__(self, shard: int) -> np.ndarray:
        if shard not in self.open:
            if len(self.open) >= MAPPED:
                self.open.popitem(last=False)
            there = self.model.has(self.name, shard)
            if there and not os.path.exists(f"{self.model.folder}/{self.name}-{shard}"):
                raise FileNotFoundError(f"the model's file {self.name}-{shard} is not in {self.model.folder}: it was lost, or this executor does not see the shared folder")
            self.open[shard] = _map(self.model.folder, f"{self.name}-{shard}", self.dtype) if there else np.zeros(0, self.dtype)
        return self.open[shard]


def _runs(shards: np.ndarray):
    """(shard, first, last) of the runs of equal numbers in a sorted array."""
    cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(shards) else np.zeros(0, np.int64)
    return zip(shards[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(shards)])


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offsets)
    return range_hash(prefix_hashes(_lower(data), BASES[0]), starts, ends, BASES[0]), rows


def _range_shard(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class _Gather:
    """Counts of keys, sent to ranges of shards whenever GATHER distinct ones have come together."""

    def __init__(self, range_of):
        self.range_of, self.keys, self.counts, self.size = range_of, [], [], 0

    def add(self, keys: np.ndarray):
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count.astype(np.int64))
        self.size += len(key)
        if self.size > 2 * GATHER:
            key, count = _added(self.keys, self.counts)
            self.keys, self.counts, self.size = [key], [count], len(key)
            if self.size > GATHER:
                yield from self.send()

    def send(self):
        if self.keys:
            key, count = _added(self.keys, self.counts)
            self.keys, self.counts, self.size = [], [], 0
            yield _messages(0, _split(key, count, self.range_of(key)))


def _split(key: np.ndarray, count: np.ndarray, ranges: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(ranges, kind="stable")
    return [(r, put(pack(key[order[a:b]]), zipped(count[order[a:b]]))) for r, a, b in _runs(ranges[order])]


def _messages(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["kind", "shard", "body"])


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [take(b) for b in table.column("body").to_pylist()]
    return _added([unpack(a) for a, _ in parts], [unzipped(b, np.int64) for _, b in parts])


def _dealt(messages: DataFrame, shards: int, total: int, shard_of: Callable[[], Callable]) -> DataFrame:
    """Messages to ranges of shards as messages to shards.  With more than FAN shards relays add up what some senders have for a
    range, as many as there are ranges, and send it on to narrower ones; so a relay gathers what one sender does.

    shard_of() gives, on a worker, the function from keys to shards.
    """
    for level, width in enumerate(widths(shards)[1:], 1):
        nodes = max(1, total // GATHER // fan(shards) ** level)
        messages = messages.groupBy("kind", "shard", F.pmod(F.xxhash64("body"), F.lit(nodes)).alias("node")).applyInArrow(_relay(width, shard_of), MESSAGE)
    return messages


def _relay(width: int, shard_of: Callable[[], Callable]):
    def relaying(table):
        key, count = _sums(table)
        return pa.Table.from_batches([_messages(table.column("kind")[0].as_py(), _split(key, count, shard_of()(key) // width))])

    return relaying


def _of_counts(n: list[int]) -> tuple[float, float, float]:
    """Discounts from n1..n4, the numbers of entries that occur so often."""
    if min(n) == 0:
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    found = (k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(found))


class Lookup:
    """The model's arrays on a worker."""

    def __init__(self, model: Model):
        self.m = m = model
        self.offsets = np.r_[0, np.cumsum(m.vocabulary)].astype(np.int64)
        self.starts = np.array([m.span(s)[0] for s in range(m.shards)], np.int64)
        self.hot = m.hot.astype(np.uint64)
        self.hashes, self.counts = _Maps(m, "word", np.uint64), _Maps(m, "count", np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each word hash."""
        names, at = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(names), -1), np.zeros(len(names), np.int64)
        for s, a, b in _runs(_range_shard(names, self.m.shards)):
            have = self.hashes[s]
            if len(have):
                place = np.minimum(np.searchsorted(have, names[a:b]), len(have) - 1)
                hit = have[place] == names[a:b]
                ids[a:b][hit] = self.offsets[s] + place[hit]
                counts[a:b][hit] = self.counts[s][place[hit]]
        return ids[at], counts[at]

    def token_counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known ids (not the end token's)."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.offsets, ids, "right") - 1
        for s in np.unique(shard).tolist():
            own = shard == s
            out[own] = self.counts[s][ids[own] - self.offsets[s]]
        return out

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        shard = np.searchsorted(self.starts, context.astype(np.int64), "right") - 1
        hot = np.isin(context, self.hot) if len(self.hot) else np.zeros(len(keys), bool)
        shard[hot] = _range_shard(mix(keys[hot]), self.m.shards)
        return shard


def _sequences(lookup: Lookup, data: np.ndarray, offsets: np.ndarray):
    """The tokens of a block, end tokens included: row, id, count, and the id of the token before (start: the end's id)."""
    hashes, rows = _block_words(data, offsets)
    ids, counts = lookup.ids(hashes)
    n, m = len(offsets) - 1, lookup.m
    ends = np.searchsorted(rows, np.arange(1, n + 1))
    rows = np.insert(rows, ends, np.arange(n))
    ids = np.insert(ids, ends, m.end)
    counts = np.insert(counts, ends, m.texts)
    before = np.r_[m.end, ids[:-1]] if len(ids) else ids
    return rows, ids, counts, before


def _sent(spark, model: Model):
    """The model for the workers, as plain values: those are unpickled before this package is known there."""
    return spark.sparkContext.broadcast(dict(vars(model)))


def train(docs: DataFrame, usable: Column | None = None, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Counts a model over the rows for which usable (a condition on `id`) holds, all by default."""
    spark = docs.sparkSession
    rows = only(docs, id_column, text_column).toDF("id", "text")
    rows = (rows if usable is None else rows.where(usable)).select("text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    width = widths(shards)[0]
    folder = shared_path(spark, "ngram")
    model = Model(folder, shards, [0] * shards)

    def words(batches):
        gather, texts = _Gather(lambda k: _range_shard(k, shards) // width), 0
        for batch in batches:
            texts += len(batch)
            for _, _, data, offsets in text_blocks(batch.column(0)):
                yield from gather.add(_block_words(data, offsets)[0])
        yield from gather.send()
        yield _messages(1, [(-1, np.array([texts], np.int64).tobytes())])

    def keep_words(table):
        if table.column("kind")[0].as_py() == 1:
            texts = sum(int(np.frombuffer(b, np.int64)[0]) for b in table.column("body").to_pylist())
            return pa.table({"shard": pa.array([-1], pa.int32()), "n": pa.array([texts]), "tokens": pa.array([0])})
        shard = table.column("shard")[0].as_py()
        key, count = _sums(table)
        _write(folder, f"word-{shard}", key)
        _write(folder, f"count-{shard}", count)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)]), "tokens": pa.array([int(count.sum())])})

    counted_words = rows.mapInArrow(words, MESSAGE)
    if width > 1:
        counted_words = _dealt(counted_words.where("kind = 0"), shards, total, lambda: lambda k: _range_shard(k, shards)).union(counted_words.where("kind = 1"))
    for shard, n, tokens in counted_words.groupBy("kind", "shard").applyInArrow(keep_words, "shard int, n long, tokens long").collect():
        if shard < 0:
            model.texts = n
        else:
            model.vocabulary[shard] = n
            model.tokens += tokens
    model.tokens += model.texts  # end tokens
    model.wrote(np.flatnonzero(model.vocabulary).tolist(), "word", "count")
    if model.words >= 2**32:
        raise ValueError("there are more distinct words than ids")

    # Frequent contexts, at most four a shard: their pairs are dealt to all shards.
    least = max(1, model.tokens // (4 * shards))
    held = _sent(spark, model)

    def frequent(batches):
        lookup = Lookup(Model(**held.value))
        for batch in batches:
            for s in np.asarray(batch.column(0)).tolist():
                at = np.flatnonzero(lookup.counts[s] >= least)
                yield pa.RecordBatch.from_arrays([pa.array(at + lookup.offsets[s])], ["id"])

    found = [r[0] for r in spark.range(0, shards, 1, min(shards, 10_000)).mapInArrow(frequent, "id long").collect()]
    model.hot = np.unique(np.array([*found, *([model.end] if model.texts >= least else [])], np.int64))
    model.after_hot = np.zeros((len(model.hot), 3), np.int64)
    held = _sent(spark, model)

    def pair_shard():
        return Lookup(Model(**held.value)).pair_shard

    def own_shard():
        """From ids to the shards that hold their spans."""
        starts = Lookup(Model(**held.value)).starts
        return lambda ids: np.searchsorted(starts, ids.astype(np.int64), "right") - 1

    def pairs(batches):
        lookup = Lookup(Model(**held.value))
        gather = _Gather(lambda k: lookup.pair_shard(k) // width)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                _, ids, _, before = _sequences(lookup, data, offsets)
                yield from gather.add(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
        yield from gather.send()

    def keep_pairs(table):
        m, shard = Model(**held.value), table.column("shard")[0].as_py()
        key, count = _sums(table)
        _write(folder, f"pair-{shard}", key)
        _write(folder, f"times-{shard}", np.minimum(count, 255).astype(np.uint8))
        large = count >= 255
        _write(folder, f"large-{shard}", key[large])
        _write(folder, f"large-times-{shard}", count[large])
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        hot, of = np.isin(context, m.hot), np.minimum(count, 3) - 1
        lo, hi = m.span(shard)
        out = [(2, shard, np.array([len(key), *(int((count == k).sum()) for k in (1, 2, 3, 4))], np.int64).tobytes())]
        after = np.stack([np.bincount(context[~hot & (of == k)] - lo, minlength=hi - lo) for k in range(3)], axis=1) if hi > lo else np.zeros((0, 3))
        _write(folder, f"after-{shard}", after.astype(np.uint32))
        follow = np.bincount(np.searchsorted(m.hot, context[hot]) * 3 + of[hot], minlength=3 * len(m.hot)).reshape(-1, 3)
        met = np.flatnonzero(follow.any(axis=1))
        out.append((3, shard, np.column_stack([m.hot[met], follow[met]]).astype(np.int64).tobytes()))
        names, n = np.unique(word, return_counts=True)
        out += [(0, r, body) for r, body in _split(names.astype(np.uint64), n.astype(np.int64), own_shard()(names) // width)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["kind", "shard", "body"])

    counted = checkpointed(_dealt(rows.mapInArrow(pairs, MESSAGE), shards, total, pair_shard).groupBy("shard").applyInArrow(keep_pairs, MESSAGE))
    times, shards_written = np.zeros(5, np.int64), []
    for shard, body in counted.where("kind = 2").select("shard", "body").collect():
        times += np.frombuffer(body, np.int64)
        shards_written.append(shard)
    model.wrote(shards_written, "pair", "times", "large", "large-times", "after")
    model.pairs, model.discounts = int(times[0]), _of_counts(times[1:].tolist())

    def unpacked(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["context", "n1", "n2", "n3"])

    # Every shard may hold words after every frequent context; they are added up by context before the driver hears of them.
    followed = counted.where("kind = 3").select("body").mapInArrow(unpacked, "context long, n1 long, n2 long, n3 long")
    for context, *n in followed.groupBy("context").agg(*[F.sum(f"n{k}") for k in (1, 2, 3)]).collect():
        model.after_hot[np.searchsorted(model.hot, context)] = n

    def keep_continuations(table):
        shard = table.column("shard")[0].as_py()
        lo, hi = Model(**held.value).span(shard)
        key, count = _sums(table)
        out = np.zeros(hi - lo, np.uint32)
        out[key.astype(np.int64) - lo] = count
        _write(folder, f"contexts-{shard}", out)
        return pa.table({"shard": pa.array([shard], pa.int32())} | {f"n{k}": pa.array([int((count == k).sum())]) for k in (1, 2, 3, 4)} | {"more": pa.array([int((count >= 3).sum())])})

    ns, shards_written = np.zeros(5, np.int64), []
    for r in _dealt(counted.where("kind = 0"), shards, total, own_shard).groupBy("shard").applyInArrow(keep_continuations, "shard int, n1 long, n2 long, n3 long, n4 long, more long").collect():
        ns += np.array(r[1:])
        shards_written.append(r[0])
    model.wrote(shards_written, "contexts")
    model.word_discounts = _of_counts(ns[:4].tolist())
    if model.pairs:
        model.word_mass = float(np.dot(model.word_discounts, [ns[0], ns[1], ns[4]]) / model.pairs)
    return model


class Scorer(Lookup):
    """Probabilities from the mapped arrays."""

    def __init__(self, model: Model):
        super().__init__(model)
        m = model
        self.pairs, self.times = _Maps(m, "pair", np.uint64), _Maps(m, "times", np.uint8)
        self.large, self.large_times = _Maps(m, "large", np.uint64), _Maps(m, "large-times", np.int64)
        self.after, self.contexts = _Maps(m, "after", np.uint32), _Maps(m, "contexts", np.uint32)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(keys), np.int64), self.pair_shard(keys)
        order = np.argsort(shard, kind="stable")
        for s, a, b in _runs(shard[order]):
            have, own = self.pairs[s], order[a:b]
            if len(have):
                place = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                count = np.where(have[place] == keys[own], self.times[s][place], 0).astype(np.int64)
                big = count == 255
                count[big] = self.large_times[s][np.searchsorted(self.large[s], keys[own[big]])]
                out[own] = count
        return out

    def _gather(self, parts: _Maps, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of so many numbers for sorted ids."""
        out = np.zeros((len(ids), width), np.int64)
        for s, a, b in _runs(np.searchsorted(self.starts, ids, "right") - 1):
            if len(parts[s]):
                out[a:b] = parts[s].reshape(-1, width)[ids[a:b] - self.starts[s]]
        return out

    def word_probability(self, ids: np.ndarray) -> np.ndarray:
        """p(w); ids sorted, unknown ones (-1) first."""
        n = self._gather(self.contexts, np.maximum(ids, 0), 1)[:, 0] * (ids >= 0)
        base = self.m.word_mass / (self.m.distinct + 1)
        return np.maximum(n - np.array([0, *self.m.word_discounts])[np.minimum(n, 3)], 0) / max(1, self.m.pairs) + base

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each row of a block: tokens, known tokens, the base score and the model's log10 probability."""
        m, n = self.m, len(offsets) - 1
        rows, ids, counts, before = _sequences(self, data, offsets)
        base = np.log10((counts + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        names, at = np.unique(ids, return_inverse=True)
        p = self.word_probability(names)[at]
        known = before >= 0
        if m.texts == 0:
            known[:] = False
        contexts, to = np.unique(before[known], return_inverse=True)
        after = self._gather(self.after, contexts, 3)
        hot = np.isin(contexts, m.hot)
        after[hot] = m.after_hot[np.searchsorted(m.hot, contexts[hot])]
        total = np.full(len(contexts), m.texts, np.int64)
        total[contexts < m.end] = self.token_counts(contexts[contexts < m.end])
        free = (after @ np.array(m.discounts)) / total
        c = np.zeros(np.count_nonzero(known), np.int64)
        seen = ids[known] >= 0
        keys, back = np.unique(before[known][seen].astype(np.uint64) << np.uint64(32) | ids[known][seen].astype(np.uint64), return_inverse=True)
        c[seen] = self.pair_counts(keys)[back]
        p[known] = np.maximum(c - np.array([0, *m.discounts])[np.minimum(c, 3)], 0) / total[to] + free[to] * p[known]
        return np.bincount(rows, minlength=n), np.bincount(rows, counts > 0, n).astype(np.int64), np.bincount(rows, base, n), np.bincount(rows, np.log10(p), n)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score (additive unigrams), score (log10 probability) and perplexity of every row."""
    held = _sent(docs.sparkSession, model)
    rows = only(docs, id_column, text_column).toDF("id", "text")

    def task(batches):
        scorer = Scorer(Model(**held.value))
        for batch in batches:
            parts = [scorer.block(data, offsets) for _, _, data, offsets in text_blocks(batch.column(1))]
            columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            n, known, base, total = columns
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(total), pa.array(10 ** (-total / np.maximum(n, 1)))], ["id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")
