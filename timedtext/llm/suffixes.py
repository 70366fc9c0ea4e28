"""Exact substring deduplication by a difference-cover sample and buckets of sorted suffixes.

A byte goes if a string of `length` bytes that covers it also starts somewhere else, in the same document or in another.  Only
suffixes' first `length` bytes matter, and only whether two are equal; so suffixes are ordered by a 96-bit hash of these
instead of by their letters, which sorts equal ones together as well and deals them evenly.  An order by letters would have
to move the sampled strings themselves: 8 positions of 57, each with its 344 bytes, are 48 times the input.

The difference cover D modulo v holds, for any two positions i and j, a shift d < v with i + d and j + d both in the sample
(positions that are in D modulo v, counted from the start of the document).  A core is the string of `shared` - v + 1 bytes at
a sampled position.  So of two equal strings of `shared` bytes or more, a core starts at sample positions in both.  Rounds
over chunks of texts:

1. Sampled suffixes are sorted by a hash of their cores, cut to 10 bits more than their number needs; false hits are one in a
   thousand and fall out below.  Where a string of `length` bytes is repeated, any v positions in a row hold the start of a
   repeated core, as far as cores fit in; a start for which they don't takes part no further.
2. Cover-sample ranks: the cores that passed are ranked by core and span, the span being the length + v - 1 bytes in which all
   strings lie that start less than v before the sample.  Where two spans agree, all the strings in them are repeated and
   their suffixes need not be sorted: this resolves long ties, the inside of every copy.  Of a core with any span that is
   alone, one sample for each of its spans goes on, so that what is alone meets each text it could equal.
3. Suffix buckets: the suffixes around the samples that go on are dealt to buckets by hash, and one bucket at a time is
   sorted in a task.

Round 2 also tells which cores are shared: their bytes are counted as n_shared.  It is 0 in a document of which no string of
`shared` - v + 1 bytes stands elsewhere, and `shared` - v + 1 at least where one of `shared` bytes does.

Buckets and chunks have bounded sizes; a chunk makes its keys distinct before it sends them, so that no text, however
frequent, is more than one entry a chunk.  A chunk's texts are gone through in blocks of BLOCK_BYTES, or of one longer text.

Edge cases: null texts are empty; texts of fewer than length bytes lose nothing; exact copies lose all bytes but those no
window covers, which is none; rows that share an id are rows of their own; an empty table gives no rows; other columns are
ignored; texts are taken whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BASES, partitions, prefix_hashes, range_hash, text_blocks
from .exchange import Entries, Keys, Kind, Merged, Replies, chunked, rounds

LENGTH, SHARED, MODULUS = 400, 256, 57
CHUNK_BYTES = 2 << 20
#: False hits of the first round: one in 2 ** SPARE_BITS.
SPARE_BITS = 10
#: Text bytes for each shard; bounds what one task sorts, some 100 bytes a sample.
SHARD_BYTES = 8 << 20


def difference_cover(v: int) -> tuple[int, ...]:
    """A least set of residues, 0 among them, whose differences give every residue modulo v."""
    size = 1
    while size * (size - 1) + 1 < v:
        size += 1
    while True:
        found = _extend((0, 1) if v > 1 else (0,), v, size, size * (size - 1) + 1 == v)
        if found:
            return found
        size += 1


def _extend(chosen: tuple[int, ...], v: int, size: int, perfect: bool):
    differences = [(a - b) % v for a in chosen for b in chosen if a != b]
    if perfect and len(set(differences)) < len(differences):
        return None
    if len(chosen) == size:
        return chosen if len({0, *differences}) == v else None
    for x in range(chosen[-1] + 1, v):
        found = _extend((*chosen, x), v, size, perfect)
        if found:
            return found
    return None


class Block:
    """Some documents of a chunk: their bytes and the sampled positions that have a whole core.

    What is kept is two prefix sums a byte at most, each from when it is first asked for; all else lives for one call.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, core: int, cover: np.ndarray):
        self.data, self.offsets = data, offsets
        within = np.arange(len(data), dtype=self.dense) - self.start()
        in_cover = np.resize(cover, int(np.diff(offsets).max()))
        self.sample = np.flatnonzero(in_cover[within] & (self.left() >= core))
        self.prefixes: dict[int, np.ndarray] = {}

    @property
    def dense(self) -> type:
        """The type of a position where every byte has one."""
        return np.int32 if len(self.data) < 1 << 30 else np.int64

    def start(self) -> np.ndarray:
        """Where the document of each byte begins."""
        return np.repeat(self.offsets[:-1].astype(self.dense), np.diff(self.offsets))

    def left(self) -> np.ndarray:
        """The bytes left in the document from each on."""
        return np.repeat(self.offsets[1:].astype(self.dense), np.diff(self.offsets)) - np.arange(len(self.data), dtype=self.dense)

    def first(self, at: np.ndarray) -> np.ndarray:
        """Where the documents of some positions begin."""
        return self.offsets[np.searchsorted(self.offsets, at, "right") - 1]

    def hashes(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        base = BASES[which]
        if which not in self.prefixes:
            self.prefixes[which] = prefix_hashes(self.data, base)
        return range_hash(self.prefixes[which], at, at + length, base)

    def covered(self, *runs: tuple[np.ndarray, int]) -> np.ndarray:
        """Whether each byte lies in one of the runs, given as starts and a length."""
        edges = np.zeros(len(self.data) + 1, np.int32)
        for at, size in runs:
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
        return np.cumsum(edges[:-1], dtype=np.int32) > 0

    def by_row(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each document are marked."""
        counts = np.zeros(len(marked) + 1, self.dense)
        np.cumsum(marked, out=counts[1:])
        return (counts[self.offsets[1:]] - counts[self.offsets[:-1]]).astype(np.int64)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def parted(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """What joined put together, or bits of it, by block again."""
    return np.split(values, np.cumsum([len(x) for x in like])[:-1], axis=-1) if like else []


#: In place of a span's hash: the document cuts it off; no string that starts in it can be repeated.
CUT_OFF, NOTHING = 0, 1


class Cores(Kind):
    """Of a core and its span: is the span repeated, does its sample go on, and does the core stand elsewhere?"""

    bits, low = 3, np.uint64

    def decide(self, m: Merged) -> np.ndarray:
        core, span = m.entries.high, m.entries.low
        by_core = np.cumsum(np.r_[True, core[1:] != core[:-1]]) - 1
        open_ = span != NOTHING
        repeated = (m.count > 1) & (span > NOTHING)
        alone = np.bincount(by_core, open_ & ~repeated)[by_core] > 0
        met = np.bincount(by_core, m.count * open_)[by_core] > 1
        return np.stack([repeated, open_ & alone & met, np.bincount(by_core, m.count)[by_core] > 1], axis=1)

    def spread(self, answers: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = answers.copy()
        out[:, 1] &= first | ~answers[:, 0]  # one sample stands for a repeated span
        return out


def drop_repeats(docs: DataFrame, length: int = LENGTH, modulus: int = MODULUS, shared: int | None = None, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_shared, spans (the maximal removed runs, end exclusive) and kept (bytes) of every row.

    shared: SHARED by default, or less where length demands it.
    """
    shared = min(SHARED, length - modulus) if shared is None else shared
    if not modulus <= shared <= length - modulus:
        raise ValueError("shared must not be shorter than the cover's modulus, and shorter than length by the modulus at least")
    base, total = chunked(docs, chunk_bytes, id_column, text_column)
    shards = max(-(-total // SHARD_BYTES), min(partitions(docs.sparkSession), -(-total // chunk_bytes)), 1)
    bits = min(64, max(16, int(np.ceil(np.log2(max(2, total)))) + SPARE_BITS - 2))  # a sample is a seventh of the bytes
    v, short, long = modulus, shared - modulus + 1, length + modulus - 1
    cover = np.zeros(v, bool)
    cover[list(difference_cover(v))] = True

    def blocks(table) -> list[Block]:
        return [Block(data, offsets, short, cover) for _, _, data, offsets in text_blocks(table.column("text"))]

    def sample_keys(chunk: list[Block]) -> Keys:
        return Keys(joined([b.hashes(b.sample, short, 0) for b in chunk]) >> np.uint64(64 - bits) << np.uint64(64 - bits))

    def cores(b: Block, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Samples that the first round let pass, the starts that can be repeated, and the samples' cores and spans."""
        passed, n = b.sample[hits], len(b.data)
        before = np.zeros(n + v + 1, b.dense)
        before[passed + 1] = 1
        np.cumsum(before, out=before)
        lacking = np.zeros(n + 1, b.dense)
        np.cumsum(before[v : n + v] == before[:n], out=lacking[1:])  # positions after which v hold no repeated core
        ends = np.minimum(np.arange(length - short - v + 2, n + length - short - v + 2, dtype=b.dense), n)
        can = (b.left() >= length) & (lacking[ends] == lacking[:n])
        starts = np.zeros(n + 1, b.dense)
        np.cumsum(can, out=starts[1:])
        first = b.first(passed)
        useful = starts[passed + 1] > starts[np.maximum(passed - v + 1, first)]
        whole = useful & (passed - v + 1 >= first) & (b.offsets[np.searchsorted(b.offsets, passed, "right")] - passed >= length)
        spans = np.where(useful, np.uint64(CUT_OFF), np.uint64(NOTHING))
        spans[whole] = np.maximum(b.hashes(passed[whole] - v + 1, long, 1), np.uint64(NOTHING + 1))
        return passed, can, b.hashes(passed, short, 0), spans

    def core_keys(chunk: list[Block], replies: Replies) -> tuple[list[np.ndarray], list[np.ndarray], Keys]:
        """By block the samples that passed and the starts that can be repeated; the samples' cores and spans."""
        hits = parted(replies.bits(0, sample_keys(chunk)), [b.sample for b in chunk])
        passed, can, high, low = zip(*map(cores, chunk, hits)) if chunk else ((),) * 4
        return list(passed), list(can), Keys(joined(list(high)), joined(list(low)))

    def near(b: Block, at: np.ndarray, can: np.ndarray) -> np.ndarray:
        """The suffixes around samples, of those that can be repeated."""
        edges = np.zeros(len(b.data) + 1, np.int32)
        np.add.at(edges, np.maximum(at - v + 1, b.first(at)), 1)
        np.add.at(edges, at + 1, -1)
        return np.flatnonzero((np.cumsum(edges[:-1], dtype=np.int32) > 0) & can)

    def bucket_keys(chunk: list[Block], replies: Replies) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], Keys]:
        """By block shared cores, the first suffixes of the resolved spans, and the suffixes to be sorted; these suffixes' keys."""
        passed, can, keys = core_keys(chunk, replies)
        told = parted(replies.bits(1, keys), passed)
        some = [near(b, p[t[1]], c) for b, p, t, c in zip(chunk, passed, told, can)]
        keys = Keys(*(joined([b.hashes(at, length, which) for b, at in zip(chunk, some)]).astype(kind) for which, kind in enumerate((np.uint64, np.uint32))))
        return [p[t[2]] for p, t in zip(passed, told)], [p[t[0]] - v + 1 for p, t in zip(passed, told)], some, keys

    def ask_samples(table, _) -> Entries:
        return sample_keys(blocks(table)).entries

    def ask_cores(table, replies) -> Entries:
        return core_keys(blocks(table), replies)[2].entries

    def ask_buckets(table, replies) -> Entries:
        return bucket_keys(blocks(table), replies)[3].entries

    def cut(b: Block, common: np.ndarray, resolved: np.ndarray, repeated: np.ndarray) -> dict[str, pa.Array]:
        """A block's columns of the result but the id."""
        gone = b.covered((resolved, long), (repeated, length))
        first, last = gone.copy(), gone.copy()
        first[1:] &= ~gone[:-1]
        last[:-1] &= ~gone[1:]
        full = b.offsets[:-1] < b.offsets[1:]
        first[b.offsets[:-1][full]] = gone[b.offsets[:-1][full]]
        last[b.offsets[1:][full] - 1] = gone[b.offsets[1:][full] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        cuts = np.searchsorted(starts, b.offsets).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(starts - b.first(starts)), pa.array(ends - b.first(starts))], ["start", "end"]))
        kept, removed = b.data[~gone], b.by_row(gone)
        kept_offsets = np.r_[0, np.cumsum(np.diff(b.offsets) - removed)]
        kept = pa.Array.from_buffers(pa.large_binary(), len(removed), [None, pa.py_buffer(kept_offsets.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
        n_shared = b.by_row(b.covered((common, short)))
        return {"n_bytes": pa.array(np.diff(b.offsets)), "n_removed": pa.array(removed), "n_shared": pa.array(n_shared), "spans": spans, "kept": kept}

    def finish(table, replies):
        chunk = blocks(table)
        common, resolved, some, keys = bucket_keys(chunk, replies)
        repeated = [at[hit] for at, hit in zip(some, parted(replies.bits(2, keys), some))]
        found, at = [], 0
        for parts in zip(chunk, common, resolved, repeated):
            columns = cut(*parts)
            found.append(pa.table({"id": table.column("id").slice(at, len(columns["kept"])), **columns}))
            at += len(columns["kept"])
        return pa.concat_tables(found)

    schema = f"id {base.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_shared long, spans array<struct<start:long,end:long>>, kept binary"
    samples = Kind(shards, 64 - bits)
    samples.low = None
    return rounds(base, [(ask_samples, samples), (ask_cores, Cores(shards)), (ask_buckets, Kind(shards))], finish, schema)
