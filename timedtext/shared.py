"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; on one machine that names neither, a new local folder."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known or not set_already.isEmpty():
        return known or set_already.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="timedtext-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the driver ends: what is read from it later must be copied."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table of some name to a new folder, for what is read more than once, and reads it again."""
    folder = new_folder(spark, "tables")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


#: Whole files that Python gets at once.
FILES = 500


def few(files: DataFrame) -> DataFrame:
    """files, of which Python will get at most FILES rows at once, unless the session says how many itself.

    Only the session can bound what the JVM hands over; a setting that is there is left as it is, and none is undone."""
    conf, key = files.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "0") == "0":  # unset
        conf.set(key, FILES)
    return files
