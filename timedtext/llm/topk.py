"""Exact top-k inner-product search by a three-phase uniform threshold.

Each vector is cut into `segments` runs of dimensions; a segment of a block of rows holds one local score list for each
query.

1. Each task gathers the k best of every local list of its first block of rows, and their totals.  The k-th best total over
   all tasks is a cutoff t that the true k-th best cannot fall under, as it is reached by rows of the table.
2. t / segments is broadcast: a row whose total is t or more must reach it in one segment at least, so the entries that reach
   it suffice.  All rows are scanned for them, once.
3. Totals of these entries, and of no others, are added up exactly; those under t go, and the best k of a task are sent on.
   So beside the k that are wanted a query gets few rows from all tasks together, and copies cannot flood a reducer.

Queries go out in waves of at most WAVE_BYTES, which bounds what is broadcast; a wave meets all rows, block by block.  A wave
of the default size does some 16 million multiplications for each row that it reads, so that reading the rows again in the
next wave weighs next to nothing.

Edge cases: null ids and vectors that are null, or hold a null or non-finite component, take no part.  Ids must be whole
numbers; others raise.  Missing trailing components count as zero; an empty vector scores 0.  Rows that share the query's id
count as the query's own; of rows that share an id divisible by the modulus, the one with the least vector asks.  Equal scores
go to the smaller id; a row that is repeated fills as many ranks as it has copies.  An empty table gives no rows.  Other
columns are ignored.  Scores outside 64 bits are ranked exactly and returned as the nearest long.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

#: Entries of one score block, and bytes of a wave of queries (2 for each component, as they are whole and mostly small): these
#: bound a task's memory.
BLOCK_ENTRIES = 1 << 20
WAVE_BYTES = 32 << 20
#: Beyond the exact scores of any two float vectors: with it added, they are numbers of one length, which sort as strings.
SHIFT = 10**95
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * component) of the rows that take part, padded to the longest."""
    ids, vectors = batch.column(0), batch.column(1)
    lists = vectors.to_pylist() if vectors.null_count or ids.null_count else None
    if lists is None:
        flat = vectors.flatten()
        lengths = np.asarray(vectors.value_lengths())
        if not flat.null_count and len(lengths) and (lengths == lengths[0]).all():
            values = np.asarray(flat, dtype=np.float64).reshape(len(lengths), lengths[0])
            fine = np.isfinite(values).all(axis=1)
            return np.asarray(ids)[fine], np.floor(values[fine] * scale)
        lists = vectors.to_pylist()
    rows = [(i, v) for i, v in zip(ids.to_pylist(), lists) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in rows), default=0)
    values = np.zeros((len(rows), width))
    for k, (_, v) in enumerate(rows):
        values[k, : len(v)] = v
    return np.array([i for i, _ in rows], np.int64), np.floor(values * scale)


def _padded(values: np.ndarray, width: int) -> np.ndarray:
    return values if values.shape[1] == width else np.pad(values, ((0, 0), (0, width - values.shape[1])))


def _partial(queries: np.ndarray, rows: np.ndarray, segments: int) -> list[np.ndarray]:
    """The local score lists of one block: an exact partial inner product for each segment, query and row."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _padded(queries, width), _padded(rows, width)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, width)
    if bound >= 2**53:  # floats would round: Python integers
        whole = lambda x: np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
        queries, rows = whole(queries), whole(rows)
    elif bound < 2**24:
        queries, rows = queries.astype(np.float32), rows.astype(np.float32)
    else:
        queries = queries.astype(np.float64)
    cuts = np.linspace(0, width, segments + 1).astype(int)
    return [queries[:, a:b] @ rows[:, a:b].T if b > a else np.zeros((len(queries), len(rows)), queries.dtype) for a, b in zip(cuts, cuts[1:])]


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each query; the smaller id first among equals."""
    order = np.lexsort((ids, -score, query))
    query = query[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return order[rank < k]


def _long(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in score], np.int64)
    return score.astype(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int16) if most < 2**15 else values


def _scan(shared, k: int, segments: int, scale: float, cut: bool):
    """A task over blocks of rows.  Without a cutoff: totals of the first block's list heads.  With one: all entries it needs."""

    def task(batches):
        query_ids, queries, cutoff = shared.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        step = max(1, BLOCK_ENTRIES // max(1, len(query_ids)))
        done = False
        for batch in batches:
            if done:
                continue
            ids, vectors = quantised(batch, scale)
            for at in range(0, len(ids), step):
                own, lists = ids[at : at + step], _partial(queries, vectors[at : at + step], segments)
                self = query_ids[:, None] == own[None, :]
                reached = np.zeros(self.shape, bool)
                for partial in lists:
                    if cut:
                        reached |= (partial * segments >= cutoff[:, None]).astype(bool)
                        continue
                    heads = min(k + 1, len(own))  # one more: the query's own row may be among them
                    if partial.dtype == object:
                        partial = partial.astype(float)
                    np.put_along_axis(reached, np.argpartition(-partial, heads - 1, axis=1)[:, :heads], True, axis=1)
                q, r = np.nonzero(reached & ~self)
                total = sum(partial[q, r] if partial.dtype == object else partial[q, r].astype(np.float64) for partial in lists)
                if cut:
                    enough = (total >= cutoff[q]).astype(bool)
                    q, r, total = q[enough], r[enough], total[enough]
                merged = tuple(np.concatenate(x) for x in zip(kept, (q, own[r], total)))
                best = _best(*merged, k)
                kept = tuple(x[best] for x in merged)
                done = not cut and len(own) > k
                if done:
                    break
        q, ids, score = kept
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids, pa.int64()), pa.array(_long(score)), pa.array([str(int(s) + SHIFT) for s in score] if score.dtype == object else [None] * len(q), pa.string())], ["query_id", "vec_id", "score", "exact"])

    return task


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, query_modulus: int = 50, scale: float = 256.0, segments: int = 4, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """The k best rows for every row whose id is divisible by query_modulus: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    if vectors.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_column} must be a whole number")
    rows = only(vectors, id_column, vector_column).toDF("id", "vector").withColumn("id", F.col("id").cast("long"))
    asked = rows.where(F.col("id") % query_modulus == 0)
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    waves = max(1, math.ceil(1.2 * 2 * n * max(1, width or 0) / wave_bytes))
    found = []
    for w in range(waves):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).toArrow().combine_chunks()
        batches = [quantised(b, scale) for b in part.to_batches()]
        width = max((v.shape[1] for _, v in batches), default=0)
        query_ids = np.concatenate([i for i, _ in batches]) if batches else np.zeros(0, np.int64)
        queries = np.concatenate([_padded(v, width) for _, v in batches]) if batches else np.zeros((0, 0))
        if len(np.unique(query_ids)) < len(query_ids):
            order = np.lexsort((*queries.T[::-1], query_ids))
            query_ids, queries = query_ids[order], queries[order]
        query_ids, one = np.unique(query_ids, return_index=True)
        queries = _small(queries[one])
        if not len(query_ids):
            continue
        schema = "query_id long, vec_id long, score long, exact string"
        order = [F.col("score").desc(), F.col("exact").desc(), "vec_id"]
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        gathered = rows.mapInArrow(_scan(spark.sparkContext.broadcast((query_ids, queries, None)), k, segments, scale, False), schema)
        heads = {r[0]: int(r[2]) - SHIFT if r[2] is not None else r[1] for r in gathered.withColumn("rank", ranked).where(F.col("rank") == k).select("query_id", "score", "exact").collect()}
        big = any(abs(h) >= 2**53 for h in heads.values())
        cutoff = np.array([heads.get(int(q), -(2**200) if big else -np.inf) for q in query_ids], object if big else np.float64)
        full = rows.mapInArrow(_scan(spark.sparkContext.broadcast((query_ids, queries, cutoff)), k, segments, scale, True), schema)
        found.append(full.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], RESULT)
