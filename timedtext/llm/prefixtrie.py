"""A trie of conversations' common beginnings, merged by families first.

Conversations of one family (ids that agree but for their remainder by `family`) are cogrouped with their base, the one whose
remainder is 0.  A family's task rebuilds them (the first h turns of the base, then the conversation's own after its first h;
h is crc32 of the id modulo `shared`) and builds their small trie.  Only its nodes are shuffled again, to be merged with alike
nodes of other families: a node is known by its depth and a 128-bit hash of its turns, a sum of turn hashes times powers.

What a subtree adds up (leaves, saved tokens) is gathered without walking the whole trie.  Each node belongs to its smallest
member; what it adds goes back to that member's family, is summed up the family's trie, and family sums are added by node.

A family's task gets the first `head` turns of a conversation.  Deeper turns lie in blocks of a range partitioned order; their
hashes and sums are made from the sums of blocks before or after, so no task holds a long conversation.  Nodes with a big share
of all children, at most 100,000, are broadcast to find children's parents; the rest are joined.  Lists of members that end at
a node are digested as a stream, in chunks that Spark sorted.

Edge cases: turns of one number stand in the order of a hash of role and text, those without a number first; null roles and
texts are empty ones; repeated rows are turns of their own; rows without a conv_id belong to no conversation; a conversation
left without turns is a member of the root and ends there; an absent base gives no turns; an empty table gives no rows; other
columns are ignored, whatever their names.  Remainders of negative ids are negative, as in SQL.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, checkpointed, only, partitions, powers
from .mixing import n_tokens

#: Turns of one conversation that a family's task takes at most.
HEAD = 2000
#: Rows of a block of deep turns, about; ids of a chunk of members.
BLOCK, CHUNK = 100_000, 8192
#: Rows that may be broadcast: long conversations by id, and parents with many children.
BROADCAST_ROWS = 100_000
KEY = ("depth", "ka", "kb")
#: A family's node: its least member there, node and parent by hash, the parent's least member, members, words of its last
#: turn, members that end there, and members whose deeper turns lie in blocks.
NODE = "base long, conv long, depth long, ka long, kb long, pa long, pb long, up long, n long, words long, ends array<long>, open array<long>"


def _shared_turns(conv: int, shared: int) -> int:
    return zlib.crc32(str(conv).encode()) % shared


def _signed(values: np.ndarray) -> list[int]:
    return values.astype(np.uint64).view(np.int64).tolist()


def _keys(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all beginnings, the empty one first."""
    return tuple(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x.view(np.uint64) * powers(base, len(x) + 1)[0][: len(x)], dtype=np.uint64)]) for x, base in ((a, BASES[0]), (b, BASES[1])))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _family(shared: int):
    def build(key, base_rows, other_rows):
        base = key[0].as_py()
        rows = pa.concat_tables([base_rows, other_rows])
        turn = rows["turn"].to_pandas()
        column = lambda name: rows[name].to_numpy()
        order = np.lexsort((column("b"), column("a"), turn.fillna(0).to_numpy(np.int64), turn.notna().to_numpy(), column("conv")))
        conv, a, b, words, long = (column(n)[order] for n in ("conv", "a", "b", "words", "long"))
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]])).tolist()
        own = {int(conv[s]): np.arange(s, e) for s, e in zip(starts, [*starts[1:], len(conv)])}
        of_base = own.get(base, np.zeros(0, np.int64))
        nodes: list[list] = []
        known: dict[tuple[int, int, int], int] = {}
        for c in sorted(own):
            h = _shared_turns(c, shared)
            path = np.concatenate([of_base[:h], own[c][h:]])
            up = None
            for depth, (ka, kb) in enumerate(zip(*map(_signed, _keys(a[path], b[path])))):
                at = known.setdefault((depth, ka, kb), len(nodes))
                if at == len(nodes):
                    parent = nodes[up] if up is not None else [None] * 5
                    nodes.append([base, c, depth, ka, kb, parent[3], parent[4], parent[1], 0, int(words[path[depth - 1]]) if depth else 0, [], []])
                nodes[at][8] += 1
                up = at
            nodes[up][11 if long[own[c][0]] else 10].append(c)
        return _table(nodes, NODE)

    return build


def _base_of(conv: Column, family: int) -> Column:
    return conv - conv % family


def _ordered(rows: DataFrame) -> DataFrame:
    """Long conversations' rows with block and place in the conversation; a block lies in one conversation and is bounded."""
    count = rows.count()
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    n = max(partitions(rows.sparkSession), -(-count // BLOCK))
    # The row's number tells alike rows apart, so that ranges can be cut between them.
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = checkpointed(salted.repartitionByRange(n, *by, F.col("salt")).sortWithinPartitions(*by).drop("salt")).withColumn("block", F.spark_partition_id())
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("conv", "block").count().select("conv", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("conv", "block").orderBy(*by)) - 1 + F.col("offset")
    return dealt.join(offsets, ["conv", "block"]).withColumn("place", place.cast("long")).drop("offset")


def _block_sum(head: int):
    def total(key, rows):
        place = rows["place"].to_numpy()
        first = int(place.min())
        sums = []
        for name, base in (("a", BASES[0]), ("b", BASES[1])):
            at = powers(base, len(place) + 1)[0][place - first]
            sums.append(int((rows[name].to_numpy().view(np.uint64) * at).sum(dtype=np.uint64)) * pow(base, first - head, 1 << 64) % (1 << 64))
        return _table([(key[0].as_py(), key[1].as_py(), *_signed(np.array(sums, np.uint64)))], "conv long, block long, sa long, sb long")

    return total


def _before_blocks(key, blocks):
    """For each block of a conversation the hash of all turns before it."""
    blocks = blocks.sort_values("block")
    out = {"conv": blocks["conv"], "block": blocks["block"], "depth0": blocks["depth0"]}
    for name, start, base in (("sa", "ka", BASES[0]), ("sb", "kb", BASES[1])):
        sums = blocks[name].to_numpy().view(np.uint64)
        before = np.cumsum(sums, dtype=np.uint64) - sums
        shift = np.uint64(pow(base, int(blocks["depth0"].iloc[0]), 1 << 64))
        out[start] = (blocks[start].to_numpy().view(np.uint64) + before * shift).view(np.int64)
    return pd.DataFrame(out)


def _block_nodes(head: int, family: int):
    def build(key, rows, before):
        order = np.argsort(rows["place"].to_numpy())
        conv, start = key[0].as_py(), before.to_pylist()[0]
        place = rows["place"].to_numpy()[order]
        depth = start["depth0"] + place - head + 1
        keys = []
        for name, k, base in (("a", "ka", BASES[0]), ("b", "kb", BASES[1])):
            at = powers(base, len(place) + 1)[0][place - place[0]] * np.uint64(pow(base, int(depth[0]) - 1, 1 << 64))
            steps = np.cumsum(rows[name].to_numpy()[order].view(np.uint64) * at, dtype=np.uint64)
            keys.append(_signed(np.concatenate([np.array([start[k]], np.int64).view(np.uint64), np.array([start[k]], np.int64).view(np.uint64) + steps])))
        n = len(place)
        ends = [[conv] if last else [] for last in (place == rows["total"].to_numpy()[order] - 1).tolist()]
        base = conv - int(np.fmod(conv, family))
        ones = [1] * n
        columns = [[base] * n, [conv] * n, depth.tolist(), keys[0][1:], keys[1][1:], keys[0][:-1], keys[1][:-1], [conv] * n, ones, rows["words"].to_numpy()[order].tolist(), ends, [[]] * n, [key[1].as_py()] * n]
        return _table(list(zip(*columns)), NODE + ", block long")

    return build


def _sums_up(key, nodes, added):
    """The sums of a family's subtrees; added has what nodes add by least member and depth, or (depth null) what a member's blocks add."""
    rows = nodes.select(["conv", "depth", "ka", "kb", "up", "open"]).to_pylist()
    at = {(r["conv"], r["depth"]): i for i, r in enumerate(rows)}
    goes_on = {c: i for i, r in enumerate(rows) for c in r["open"]}
    saved, leaves = [0] * len(rows), [0] * len(rows)
    for r in added.to_pylist():
        i = goes_on.get(r["conv"]) if r["depth"] is None else at.get((r["conv"], r["depth"]))
        if i is not None:
            saved[i] += r["saved"]
            leaves[i] += r["leaves"]
    for i in sorted(range(len(rows)), key=lambda i: -rows[i]["depth"]):
        if rows[i]["depth"]:
            up = at[rows[i]["up"], rows[i]["depth"] - 1]
            saved[up] += saved[i]
            leaves[up] += leaves[i]
    return _table([(r["depth"], r["ka"], r["kb"], s, n) for r, s, n in zip(rows, saved, leaves) if s or n], SUMS)


SUMS = "depth long, ka long, kb long, saved long, leaves long"


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns that a cogroup can tell from those of a frame with the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def prefix_trie(conversations: DataFrame, family: int = 20, shared: int = 4, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends).  nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.  ends: conv_id, depth
    of a node, and member, a conversation that ends there.  A node is known by its smallest member and its depth."""
    if head < shared:
        raise ValueError("a family's task needs all turns that may be shared")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), text("role"), text("text")).alias("a"),
        F.xxhash64(F.lit(2), text("role"), text("text")).alias("b"),
        n_tokens(text("text")).alias("words"),
    )
    long = checkpointed(rows.groupBy("conv").agg(F.count("*").alias("total")).where(F.col("total") > head))
    any_long = not long.isEmpty()
    first_turns = rows.withColumn("long", F.lit(False))
    if any_long:
        ids = _bounded(long)
        ordered = _ordered(rows.join(ids, "conv"))
        heads = ordered.where(F.col("place") < head).select(*rows.columns, F.lit(True).alias("long"))
        first_turns = rows.join(ids, "conv", "left_anti").withColumn("long", F.lit(False)).unionByName(heads)
    first_turns = first_turns.withColumn("base", _base_of(F.col("conv"), family))
    bases, others = first_turns.where("conv = base"), _renewed(first_turns.where("conv <> base"))
    small = checkpointed(bases.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(_family(shared), NODE))
    every, tail = small, None
    if any_long:
        goes_on = small.select(F.explode("open").alias("conv"), F.col("depth").alias("depth0"), "ka", "kb")
        deep = ordered.where(F.col("place") >= head)
        sums = deep.groupBy("conv", "block").applyInArrow(_block_sum(head), "conv long, block long, sa long, sb long")
        before = sums.join(goes_on, "conv").groupBy("conv").applyInPandas(_before_blocks, "conv long, block long, depth0 long, ka long, kb long")
        tail = checkpointed(deep.groupBy("conv", "block").cogroup(_renewed(before).groupBy("conv", "block")).applyInArrow(_block_nodes(head, family), NODE + ", block long"))
        every = small.unionByName(tail.drop("block"))

    merged = every.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    merged = checkpointed(merged)
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("kids"))
    nodes = checkpointed(merged.join(children, list(KEY), "left").withColumn("kids", F.coalesce("kids", F.lit(0))))

    # At most BROADCAST_ROWS nodes can have more than so many children each.
    many = max(1000, -(-nodes.count() // BROADCAST_ROWS))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent"), "kids")
    on = ["depth", "pa", "pb"]
    with_many = nodes.join(F.broadcast(parent.where(F.col("kids") > many).drop("kids")), on, "left")
    with_few = with_many.where("parent IS NULL").drop("parent").join(parent.where((F.col("kids") > 0) & (F.col("kids") <= many)).drop("kids"), on, "left")
    linked = with_many.where("parent IS NOT NULL").unionByName(with_few)

    added = nodes.select("conv", "depth", ((F.col("n") - 1) * F.col("words")).alias("saved"), (F.col("kids") == 0).cast("long").alias("leaves")).where("saved > 0 OR leaves > 0")
    to_family = added.where(F.col("depth") <= head)
    up = None
    if any_long:
        path = Window.partitionBy("conv", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        own = tail.join(added, ["conv", "depth"], "left").fillna(0, ["saved", "leaves"])
        blocks = own.groupBy("conv", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        after = blocks.select("conv", "block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("s", "l")])
        up = own.withColumns({c: F.sum(c).over(path) for c in ("saved", "leaves")}).join(after, ["conv", "block"])
        up = up.select(*KEY, (F.col("saved") + F.col("s_after")).alias("saved"), (F.col("leaves") + F.col("l_after")).alias("leaves"))
        totals = blocks.groupBy("conv").agg(F.sum("s").alias("saved"), F.sum("l").alias("leaves")).select("conv", F.lit(None).cast("long").alias("depth"), "saved", "leaves")
        to_family = to_family.unionByName(totals)
    to_family = to_family.withColumn("base", _base_of(F.col("conv"), family))
    sums = small.groupBy("base").cogroup(_renewed(to_family).groupBy("base")).applyInArrow(_sums_up, SUMS)
    sums = (sums.unionByName(up) if up else sums).groupBy(*KEY).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    out = linked.join(sums, list(KEY), "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.coalesce("leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
    )
    ending = every.select(*KEY, F.explode("ends").alias("member"))
    ends = ending.join(nodes.select(*KEY, F.col("conv").alias("conv_id")), list(KEY)).select("conv_id", "depth", "member")
    return out, ends


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"conv_id": [now[0]], "depth": [now[1]], "digest": [state.hexdigest()]})

    for batch in batches:
        for conv, depth, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (conv, depth) == now:
                state.update(b",")
            else:
                if now is not None:
                    yield done()
                now, state = (conv, depth), hashlib.sha256()
            state.update(part.encode())
    if now is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and digest: SHA-256 of the members that end at the node, ascending, with commas between them.

    Members are distinct, so a chunk of CHUNK following ids is bounded; a node's chunks are read one after the other."""
    chunks = ends.groupBy("conv_id", "depth", F.expr(f"member div {CHUNK}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("part"))
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(_digest, "conv_id long, depth long, digest string")
