"""Shared parts: reading, shared folder, and vectorised text primitives on Arrow buffers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised primitives take at once; bounds the working memory of a Python worker.
BLOCK_BYTES = 1 << 18
#: Rows of an Arrow batch between the JVM and Python; whole texts in batches of the default size would be tens of megabytes.
BATCH_ROWS = 1000
#: Words are maximal runs of bytes outside this set: space and 09-0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset and all runs on one machine (tests), a new local folder, which goes when Python ends.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    existing = sc._jsc.sc().getCheckpointDir()
    if not existing.isEmpty():
        return existing.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="timedtext-checkpoint-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that lost executors cost no more than the stage at hand."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and broadcasts of plans that nothing holds any more.

    It does so when the driver collects garbage, which a driver with room in its heap puts off."""
    gc.collect()
    spark._jvm.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new directory in the shared folder as a path that workers can map; needs a mounted file system.

    What is in it may be read as long as the driver runs, and goes with it."""
    folder = shared_folder(spark)
    local = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in local:
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {folder}")
    path = os.path.join(local, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(df: DataFrame) -> DataFrame:
    """df, of which Python will get at most BATCH_ROWS rows at once, unless the session says how many itself.

    Only the session can bound what the JVM hands over; a setting that is there is left as it is, and none is undone.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "0") == "0":  # unset
        conf.set(key, BATCH_ROWS)
    return df


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; every other column, whatever its name, is ignored."""
    return lean(df).select(*[F.col(f"`{n}`") for n in names])


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (first row, last row, bytes, row offsets into bytes) of about limit bytes each; null texts are empty.

    A row is never split: a longer one makes a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) and not pa.types.is_large_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses rows."""
    inside = ~WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1024)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, inverse))
        _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def prefix_hashes(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which range_hash makes a polynomial hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end] that depend on the values and the length alone."""
    h = (prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def pack(values: np.ndarray) -> bytes:
    """A sorted uint64 array as zstd over the byte planes of its differences."""
    import zstandard

    gaps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unpack(body: bytes) -> np.ndarray:
    import zstandard

    used = body[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(used, -1)
    gaps = np.zeros((raw.shape[1], 8), np.uint8)
    gaps[:, :used] = raw.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)
