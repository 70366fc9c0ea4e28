"""Questions of text chunks to shards of a key space, in rounds.

Documents are dealt to chunks of a bounded size, once.  In each round a chunk sends its distinct keys to the shards of the key
space and gets bits back, so a text that stands in a third of all rows is one entry a chunk and no shard gets more than its
part of the key space.  The chunk comes to the same keys again when it reads the answer.  Messages are sorted key differences,
so most of a key's bits are never moved.

A chunk sends at most FAN messages a round, each for a range of neighbouring shards.  With more than FAN shards, relays stand
between: a relay takes the messages of some senders for one range, makes their keys distinct, and sends messages on to narrower
ranges, until a range is one shard; answers go back the same way.  There are log(shards) / log(FAN) levels, and at each of them
a range is cut into equally many, fan(shards), which is FAN at most; so messages grow with the input and not with its square.  A
relay takes as many senders as there are ranges, so it holds about one chunk's keys, whatever the number of shards.

The shuffle of the texts serves all rounds of one job.  What a lost executor held is made again from the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, pack, partitions, unpack

#: Messages that a chunk or a relay sends in a round at most.
FAN = 256
MESSAGE, REPLY = "target long, sender long, body binary", "chunk long, round int, target long, body binary"
_MESSAGE = pa.schema([("target", pa.int64()), ("sender", pa.int64()), ("body", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("round", pa.int32()), ("target", pa.int64()), ("body", pa.binary())])


def chunked(docs: DataFrame, chunk_bytes: int, id_column: str, text_column: str) -> tuple[DataFrame, int]:
    """chunk, id and text (null: empty) of every row, and the bytes of text in all."""
    rows = only(docs, id_column, text_column).toDF("id", "text").select("id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    return rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"), "id", "text"), total


def put(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def take(body: bytes) -> list[bytes]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    sizes = np.frombuffer(body, "<u4", n, 4).tolist()
    at, out = 4 + 4 * n, []
    for size in sizes:
        out.append(body[at : at + size])
        at += size
    return out


def put_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def take_bits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def zipped(values: np.ndarray) -> bytes:
    """An array of any order, by byte planes."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unzipped(body: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


class Entries(NamedTuple):
    """Distinct keys, sorted: a high part, a low part (or None), whether a key was there more than once, and a value (or None)."""

    high: np.ndarray
    low: np.ndarray | None
    more: np.ndarray
    value: np.ndarray | None = None

    def part(self, a: int, b: int) -> Entries:
        return Entries(*(x if x is None else x[a:b] for x in self))


class Keys:
    """The distinct keys among occurrences, sorted."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        self.order = np.argsort(high, kind="stable") if low is None else np.lexsort((low, high))  # occurrences stay in their order
        h, l = high[self.order], None if low is None else low[self.order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if l is not None:
            new[1:] |= l[1:] != l[:-1]
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.count = np.diff(np.r_[self.first, len(h)])
        self.entries = Entries(h[self.first], None if l is None else l[self.first], self.count > 1)

    def spread(self, found: np.ndarray) -> np.ndarray:
        """Rows for the keys to rows for the occurrences."""
        out = np.empty((len(self.order), *found.shape[1:]), found.dtype)
        out[self.order] = found[self.group]
        return out


class Merged:
    """Entries of several senders as one list; the first of a key is that with the least value, then of the first sender."""

    def __init__(self, parts: list[Entries]):
        self.sizes = [len(p.high) for p in parts]
        high = np.concatenate([p.high for p in parts])
        low = None if parts[0].low is None else np.concatenate([p.low for p in parts])
        value = None if parts[0].value is None else np.concatenate([p.value for p in parts])
        more = np.concatenate([p.more for p in parts])
        rank = value if value is None or value.dtype != object else np.unique(value, return_inverse=True)[1]
        self.order = np.lexsort([x for x in (rank, low) if x is not None] + [high])
        h, l = high[self.order], None if low is None else low[self.order]
        self.new = np.ones(len(h), bool)
        self.new[1:] = h[1:] != h[:-1]
        if l is not None:
            self.new[1:] |= l[1:] != l[:-1]
        self.group = np.cumsum(self.new) - 1
        first = np.flatnonzero(self.new)
        self.count = np.bincount(self.group, 1 + more[self.order], len(first)).astype(np.int64)
        self.entries = Entries(h[first], None if l is None else l[first], self.count > 1, None if value is None else value[self.order][first])

    def back(self, kind: Kind, answers: np.ndarray) -> list[bytes]:
        """The answers for the merged keys, as one message for each sender."""
        bits = kind.spread(answers[self.group], self.new)
        out = np.empty_like(bits)
        out[self.order] = bits
        return [put_bits(x.reshape(-1)) for x in np.split(out, np.cumsum(self.sizes)[:-1])]


class Kind:
    """A kind of question: is a key there more than once in all?  Keys are hashes; shards are ranges of them."""

    bits = 1  # of an answer
    low: type | None = np.uint32

    def __init__(self, shards: int, unused: int = 0):
        self.shards, self.unused = shards, unused  # low bits of the high part that are always 0

    def shard_of(self, high: np.ndarray) -> np.ndarray:
        return ((high >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def encode(self, e: Entries) -> bytes:
        return put(pack(e.high >> np.uint64(self.unused)), zipped(e.low) if self.low else b"", put_bits(e.more))

    def decode(self, body: bytes) -> Entries:
        high, low, more = take(body)[:3]
        high = unpack(high) << np.uint64(self.unused)
        return Entries(high, unzipped(low, self.low) if self.low else None, take_bits(more, len(high)))

    def decide(self, m: Merged) -> np.ndarray:
        """A row of bits for each merged key."""
        return m.count[:, None] > 1

    def spread(self, answers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What an entry is told of its key's answer; first: is it its key's first?"""
        return answers

    def answer(self, target: int, bodies: list[bytes]) -> list[bytes]:
        m = Merged([self.decode(b) for b in bodies])
        return m.back(self, self.decide(m))


def fan(shards: int) -> int:
    """Messages that a sender sends, and senders that a relay takes: the least that reach all shards in as few levels as FAN does."""
    levels, out = 1, 1
    while FAN**levels < shards:
        levels += 1
    while out**levels < shards:
        out += 1
    return out


def widths(shards: int) -> list[int]:
    """How many shards a message's range holds, level by level; the last is 1."""
    out, each = [1], fan(shards)
    while out[0] * each < shards:
        out.insert(0, out[0] * each)
    return out


def _parts(kind: Kind, entries: Entries, width: int):
    """(range, first entry, last entry) of the ranges of so many shards that entries lie in."""
    ranges = kind.shard_of(entries.high) // width
    cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(ranges) else np.zeros(0, np.int64)
    return zip(ranges[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranges)])


def _messages(kind: Kind, entries: Entries, width: int, sender: int) -> pa.Table:
    rows = [(r, kind.encode(entries.part(a, b))) for r, a, b in _parts(kind, entries, width)]
    return pa.Table.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([sender] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], schema=_MESSAGE)


def _answers(kind: Kind, entries: Entries, width: int, found: dict[int, bytes]) -> np.ndarray:
    out = np.zeros((len(entries.high), kind.bits), bool)
    for r, a, b in _parts(kind, entries, width):
        out[a:b] = take_bits(found[r], (b - a) * kind.bits).reshape(-1, kind.bits)
    return out


class Replies:
    """What a chunk has been told so far."""

    def __init__(self, kinds: list[Kind], found: dict[int, dict[int, bytes]]):
        self.kinds, self.found = kinds, found

    def bits(self, number: int, keys: Keys) -> np.ndarray:
        """The answers of a round for each occurrence: with one bit a key a row, else a row for each bit."""
        kind = self.kinds[number]
        out = keys.spread(_answers(kind, keys.entries, widths(kind.shards)[0], self.found.get(number, {})))
        return out[:, 0] if kind.bits == 1 else out.T


def _sorted(table: pa.Table) -> tuple[list[int], list[bytes]]:
    senders, bodies = table.column("sender").to_pylist(), table.column("body").to_pylist()
    order = sorted(range(len(senders)), key=senders.__getitem__)
    return [senders[i] for i in order], [bodies[i] for i in order]


def relayed(messages: DataFrame, kind: Kind) -> list[DataFrame]:
    """The messages of each level: those of the chunks, then what the relays send on."""
    each = fan(kind.shards)

    def relay(width):
        def relaying(table):
            senders, bodies = _sorted(table)
            return _messages(kind, Merged([kind.decode(b) for b in bodies]).entries, width, senders[0] // each)

        return relaying

    out = [messages]
    for width in widths(kind.shards)[1:]:
        out.append(_nodes(out[-1], each).applyInArrow(relay(width), MESSAGE))
    return out


def _nodes(messages: DataFrame, senders: int):
    return messages.withColumn("node", F.expr(f"sender div {senders}")).groupBy("target", "node")


def _answered(levels: list[DataFrame], kind: Kind, number: int) -> DataFrame:
    """chunk, round, target and body of the answers to the messages of all chunks."""
    each = fan(kind.shards)

    def replies(table, bodies):
        senders, _ = _sorted(table)
        n = len(senders)
        return pa.Table.from_arrays([pa.array(senders, pa.int64()), pa.array([number] * n, pa.int32()), pa.array([table.column("target")[0].as_py()] * n, pa.int64()), pa.array(bodies, pa.binary())], schema=_REPLY)

    def answer(table):
        return replies(table, kind.answer(table.column("target")[0].as_py(), _sorted(table)[1]))

    def back(width):
        def going_back(asked, told):
            m = Merged([kind.decode(b) for b in _sorted(asked)[1]])
            found = dict(zip(told.column("target").to_pylist(), told.column("body").to_pylist()))
            return replies(asked, m.back(kind, _answers(kind, m.entries, width, found)))

        return going_back

    out = levels[-1].groupBy("target").applyInArrow(answer, REPLY)
    for level, width in zip(levels[-2::-1], widths(kind.shards)[:0:-1]):
        told = out.withColumns({"up": F.expr(f"target div {each}"), "node": F.col("chunk")}).groupBy("up", "node")
        out = _nodes(level, each).cogroup(told).applyInArrow(back(width), REPLY)
    return out


def rounds(base: DataFrame, steps: list[tuple[Callable, Kind]], last: Callable, schema: str) -> DataFrame:
    """steps: for each round ask(table, replies) -> Entries, and the kind of its question.

    last(table, replies) -> pa.Table of schema.  table: a chunk's rows; replies: Replies of the rounds before.
    """
    n, kinds = partitions(base.sparkSession), [kind for _, kind in steps]
    chunks, told = base.groupBy("chunk"), None

    def read(table: pa.Table | None) -> Replies:
        found: dict[int, dict[int, bytes]] = defaultdict(dict)
        if table is not None:
            for r, t, b in zip(*(table.column(c).to_pylist() for c in ("round", "target", "body"))):
                found[r][t] = b
        return Replies(kinds, found)

    def asker(ask, kind):
        width = widths(kind.shards)[0]

        def asking(table, found):
            if not table.num_rows:
                return pa.Table.from_batches([], _MESSAGE)
            return _messages(kind, ask(table, read(found)), width, table.column("chunk")[0].as_py())

        def first(table):
            return asking(table, None)

        return first if told is None else asking

    for number, (ask, kind) in enumerate(steps):
        asking = asker(ask, kind)
        messages = (chunks if told is None else chunks.cogroup(told.groupBy("chunk"))).applyInArrow(asking, MESSAGE)
        answers = _answered(relayed(messages, kind), kind, number).repartition(n, "chunk")
        told = answers if told is None else told.unionByName(answers)

    def finish(table, found):
        return last(table, read(found))

    return chunks.cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)
