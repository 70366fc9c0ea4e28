"""Streams that come late and out of order, are stopped in between, and report their progress."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from timedtext.operators import sampling
from timedtext.streaming import online

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SAMPLES = "video_id long, ordinal int, ts double, value double, at timestamp"


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, online.STATE_STORE)
    yield spark
    spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def put(spark, rows, folder):
    spark.createDataFrame(rows, SAMPLES.replace("at timestamp", "second double")).withColumn("at", F.timestamp_seconds(F.col("second") + 1000)).drop("second").coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(v, i, float(i), float(rng.choice([0, 0, 1, 30, 31, 60])), i + v / 10 + 0.0004) for v in range(5) for i in range(60)]


@pytest.mark.parametrize("kind", ["changes", "interval"])
def test_shuffled_late_stream_that_is_restarted(store, rows, tmp_path, kind):
    """Batches of samples from a window of ten seconds, in any order; a new query goes on from the checkpoint after each two."""
    spark, rng = store, random.Random(1)
    dealt = sorted(rows, key=lambda r: r[4] + rng.uniform(0, 10))
    folder, made = f"file://{tmp_path}/in", lambda s: online.online_changes(s, 20.0, "10 seconds") if kind == "changes" else online.online_interval(s, 7.0, "10 seconds")
    read = lambda: spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder)
    size = len(dealt) // 4 + 1
    for k in range(4):
        put(spark, dealt[k * size : (k + 1) * size], folder)
        if k % 2:
            drain(made(read()), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    put(spark, [(99, 0, 0.0, 0.0, 10_000.0)], folder)  # lets the watermark pass all
    drain(made(read()), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    whole = spark.createDataFrame([r[:4] for r in rows], "video_id long, ordinal int, ts double, value double")
    wanted = sampling.select_changes(whole, 20.0) if kind == "changes" else sampling.sample_interval(whole, 7.0)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, wanted.collect()))


def test_stream_that_is_killed_in_a_batch(store, rows, tmp_path):
    """The sink fails in the middle of a batch; what it wrote is not given out twice."""
    spark = store
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for k in range(3):
        put(spark, [r for i, r in enumerate(rows) if i % 3 == k], folder)
    put(spark, [(99, 0, 0.0, 0.0, 10_000.0)], folder)
    failing = threading.Event()
    failing.set()

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number >= 2 and failing.is_set():
            raise RuntimeError("killed")

    def once():
        stream = online.online_changes(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder), 20.0, "2 minutes")
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        once()
    failing.clear()
    once()
    wanted = sampling.select_changes(spark.createDataFrame([r[:4] for r in rows], "video_id long, ordinal int, ts double, value double"), 20.0)
    got = spark.read.parquet(out).select("video_id", "ordinal", "ts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_samples_that_come_too_late_are_counted(store, tmp_path):
    spark, folder = store, f"file://{tmp_path}/in"
    put(spark, [(1, i, float(i), 30.0 * i, float(i)) for i in range(0, 40, 2)], folder)
    stream = online.online_changes(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder), 20.0, "5 seconds")
    drain(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    put(spark, [(1, 3, 3.0, 0.0, 3.0), (1, 35, 35.0, 1050.0, 35.0), (1, None, None, None, None), (2, 0, 0.0, 0.0, 100.0)], folder)
    q = drain(online.online_changes(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder), 20.0, "5 seconds"), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 1
    got = [r.ordinal for r in spark.read.parquet(f"{tmp_path}/out").where("video_id = 1").orderBy("ts").collect()]
    assert got == [*range(0, 35, 2), 35, 36, 38]


def test_state_store_is_asked_for(spark, tmp_path):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.unset(PROVIDER)
    put(spark, [(1, 0, 0.0, 0.0, 0.0)], f"file://{tmp_path}/in")
    with pytest.raises(ValueError, match="providerClass"):
        online.online_changes(spark.readStream.schema(SAMPLES).parquet(f"file://{tmp_path}/in"), 20.0, "1 second")
    if before:
        spark.conf.set(PROVIDER, before)
