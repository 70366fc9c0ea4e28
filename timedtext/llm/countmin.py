"""Substring deduplication over word windows, with a count-min prefilter.

A window is `width` words in a row of one document; a word goes if a window that covers it also starts earlier (smaller id,
or the same document further left).  Rounds over chunks of texts:

1. Each chunk sketches its windows' counts, DEPTH rows of cells; a row's cells are dealt to shards, which add up the chunks'
   sketches.  A window whose cell counts are all above 1 is estimated repeated: merged counts are never too low, so none that
   repeats is lost.
2. The windows estimated repeated, and no others, are grouped exactly by a 96-bit hash of their words, and each group's first
   document is found.
3. The chunk drops every window but its group's first, in the first's chunk, and all of them elsewhere.

The cells grow with the text (CELLS for each six bytes, a row), so the share of false estimates is the same at every size;
shards of SHARD_CELLS cells are added up one at a time, which bounds a task's memory.

Edge cases: null and blank texts have no words; ids that are no whole numbers are ordered as texts, by their UTF-8 bytes; null
ids come after all others; rows that share an id are told apart by their
text and count as one after the other, in an order fixed by a hash; of rows alike in both one is the first; texts are taken
whole, whatever their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import BASES, partitions, prefix_hashes, range_hash, text_blocks, word_spans
from .exchange import Entries, Keys, Kind, Merged, Replies, chunked, put, put_bits, rounds, take, take_bits, unzipped, zipped

WIDTH, DEPTH, CELLS = 20, 2, 8
CHUNK_BYTES = 4 << 20
SHARD_CELLS = 1 << 24
LAST = np.iinfo(np.int64).max


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows by id, nulls last, then text."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end")).combine_chunks()


class Windows:
    """The windows of a chunk in order: two hashes of each, and its first word's place among the chunk's words."""

    def __init__(self, text: pa.ChunkedArray, width: int):
        hashes, rows = [[], []], []
        for a, _, data, offsets in text_blocks(text):
            starts, ends, r = word_spans(data, offsets)
            for out, base in zip(hashes, BASES):
                out.append(range_hash(prefix_hashes(data, base), starts, ends, base))
            rows.append(r + a)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        n = len(self.rows)
        self.at = np.flatnonzero(self.rows[: n - width + 1] == self.rows[width - 1 :]) if n >= width else np.zeros(0, np.int64)
        self.hashes = []
        for words, base in zip(hashes, BASES):
            words = np.concatenate(words) if words else np.zeros(0, np.uint64)
            self.hashes.append(range_hash(prefix_hashes(words, base), self.at, self.at + width, base))


class Sketch(Kind):
    """Of a cell of a sketch's row: is it counted more than once?  The rows' cells are numbered through and dealt to shards."""

    low = None

    def __init__(self, shards: int):
        super().__init__(DEPTH * shards)
        self.a_row = shards

    def shard_of(self, high: np.ndarray) -> np.ndarray:
        return (high // np.uint64(SHARD_CELLS)).astype(np.int64)

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        shard = (hashes >> np.uint64(32)) * np.uint64(self.a_row) >> np.uint64(32)
        inner = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(SHARD_CELLS) >> np.uint64(32)
        return (shard + np.uint64(row * self.a_row)) * np.uint64(SHARD_CELLS) + inner

    def answer(self, target: int, bodies: list[bytes]) -> list[bytes]:
        """Adds up the senders' counts of one shard, and tells each which of its cells count above 1."""
        counts, parts = np.zeros(SHARD_CELLS, np.uint8), []
        for body in bodies:
            e = self.decode(body)
            cells = (e.high - np.uint64(target * SHARD_CELLS)).astype(np.int64)
            counts[cells] = np.minimum(counts[cells] + 1 + e.more, 2)
            parts.append(cells)
        return [put_bits(counts[cells] > 1) for cells in parts]


class First(Kind):
    """Of a window that is in a document: is it in an earlier one too?  The values are ids."""

    def encode(self, e: Entries) -> bytes:
        names, at = np.unique(e.value, return_inverse=True)
        return put(super().encode(e), zipped(at.astype(np.uint32)), _ids_to_bytes(names))

    def decode(self, body: bytes) -> Entries:
        entries, at, names = take(body)
        return super().decode(entries)._replace(value=_ids_from_bytes(names)[unzipped(at, np.uint32)])

    def decide(self, m: Merged) -> np.ndarray:
        return np.zeros((len(m.count), 1), bool)

    def spread(self, answers: np.ndarray, first: np.ndarray) -> np.ndarray:
        return answers | ~first[:, None]


def _ids_to_bytes(ids: np.ndarray) -> bytes:
    if ids.dtype != object:
        return put(ids.tobytes())
    return put(b"", np.array([len(x) for x in ids], "<u4").tobytes(), b"".join(ids))


def _ids_from_bytes(body: bytes) -> np.ndarray:
    parts = take(body)
    if len(parts) == 1:
        return np.frombuffer(parts[0], np.int64)
    ends = np.cumsum(np.frombuffer(parts[1], "<u4")).tolist()
    out = np.empty(len(ends), object)
    out[:] = [parts[2][a:b] for a, b in zip([0, *ends], ends)]
    return out


def _orderable(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, or as bytes that sort as they do; nulls come last."""
    if pa.types.is_integer(ids.type):
        return np.asarray(pc.fill_null(ids.cast(pa.int64()), LAST))
    out = np.empty(len(ids), object)
    out[:] = [b"\xff" if x is None else str(x).encode() for x in ids.to_pylist()]  # no text in UTF-8 begins with FF
    return out


def drop_repeats(docs: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    base, total = chunked(docs, chunk_bytes, id_column, text_column)
    cells = max(SHARD_CELLS, total // 6 * CELLS)
    shards = max(-(-cells // SHARD_CELLS), min(partitions(docs.sparkSession), -(-total // chunk_bytes)))
    sketch = Sketch(shards)

    def sketched(windows: Windows) -> Keys:
        return Keys(np.concatenate([sketch.cells(windows.hashes[row], row) for row in range(DEPTH)]))

    def repeated(windows: Windows, replies: Replies) -> tuple[np.ndarray, Keys]:
        """The windows whose cells all count above 1, and their keys."""
        some = np.flatnonzero(replies.bits(0, sketched(windows)).reshape(DEPTH, -1).all(axis=0))
        return some, Keys(windows.hashes[0][some], windows.hashes[1][some].astype(np.uint32))

    def ask_counts(table, _) -> Entries:
        return sketched(Windows(ordered(table).column("text"), width)).entries

    def ask_first(table, replies) -> Entries:
        table = ordered(table)
        windows = Windows(table.column("text"), width)
        some, keys = repeated(windows, replies)
        first = windows.rows[windows.at[some[keys.order[keys.first]]]]  # each window's first document in this chunk
        return keys.entries._replace(value=_orderable(table.column("id").combine_chunks())[first])

    def finish(table, replies):
        table = ordered(table)
        windows = Windows(table.column("text"), width)
        some, keys = repeated(windows, replies)
        removed = np.ones(len(some), bool)
        removed[keys.order[keys.first]] = False
        removed |= replies.bits(1, keys)
        cover = np.zeros(len(windows.rows) + 1, np.int64)
        at = windows.at[some[removed]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        cuts = np.searchsorted(windows.rows, np.arange(table.num_rows + 1))
        counts = np.r_[0, np.cumsum(gone)]
        kept = []
        for text, a, b in zip(table.column("text"), cuts[:-1].tolist(), cuts[1:].tolist()):
            words = text.as_py().encode().split()
            if counts[b] > counts[a]:
                words = [w for w, g in zip(words, gone[a:b].tolist()) if not g]
            kept.append(b" ".join(words).decode())
        return pa.table({"id": table.column("id"), "n_words": pa.array(np.diff(cuts), pa.int64()), "n_removed": pa.array(counts[cuts[1:]] - counts[cuts[:-1]], pa.int64()), "kept": pa.array(kept, pa.string())})

    schema = f"id {base.schema['id'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return rounds(base, [(ask_counts, sketch), (ask_first, First(shards))], finish, schema)
