"""Content-addressed results that outlive a run.

A result is kept under the SHA-256 of all that it depends on.  What is missing is an anti-join, what is there a semi-join.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..progress import counted


def key_of(*parts: Column, length: int = 64) -> Column:
    """F16: the key of a struct of columns, in JSON."""
    return F.left(F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256), F.lit(length))


class Checkpoints:
    """A table of results by `key`, in versions that any number of runs may add at once.

    An addition writes its rows to a folder of its own and then commits it under the next number, by a file that is put only
    where there is none; a run that finds the number taken tries the next.  Readers take the versions whose commits are there
    when they begin, and so whole ones; of results with one key the first committed stays.  What was written but never
    committed is never read.  A commit is a file of a few bytes, whose list the driver reads: it grows with additions, not rows.

    Putting a file is exclusive by a hard link on a local or mounted file system, and elsewhere by a rename that does not
    replace, which HDFS has and object stores may lack.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(f"key string, {schema}")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[str]:
        """The folders that are committed, in the order of their numbers."""
        fs, commits = self._at("commits")
        if not fs.exists(commits):
            return []
        found = self.spark.read.text(f"{self.path}/commits", wholetext=True).select("_metadata.file_name", "value").collect()
        return [r.value for r in sorted(found, key=lambda r: int(r.file_name))]

    def rows(self) -> DataFrame:
        """All committed results with their `version`, also those of one key."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema).withColumn("version", F.lit(0))
        paths = [f"{self.path}/rows/{v}" for v in versions]
        stored = self.spark.read.schema(self.schema).parquet(*paths).withColumn("_from", F.regexp_extract("_metadata.file_path", r"/rows/([^/]+)/", 1))
        numbers = F.create_map(*[x for n, v in enumerate(versions, 1) for x in (F.lit(v), F.lit(n))])
        return stored.withColumn("version", numbers[F.col("_from")]).drop("_from")

    def read(self, valid: Column | None = None) -> DataFrame:
        """One result a key: of those that are valid the first committed."""
        rows = self.rows() if valid is None else self.rows().where(valid)
        first = F.min_by(F.struct(*self.schema.fieldNames()), "version").alias("r")
        return rows.groupBy("key").agg(first).select("r.*")

    def missing(self, work: DataFrame, valid: Column | None = None) -> DataFrame:
        """The work whose key has no result, or none that is valid."""
        done = self.rows() if valid is None else self.rows().where(valid)
        return work.join(done.select("key"), "key", "left_anti")

    def found(self, work: DataFrame, valid: Column | None = None) -> DataFrame:
        """The work with its results."""
        return work.join(self.read(valid), "key")

    def add(self, results: DataFrame, **counts: Column) -> dict[str, int]:
        """Writes and commits results, which have a key once; returns what was counted of them, and nothing if there were none."""
        name = uuid.uuid4().hex
        rows, seen = counted(results.select(*self.schema.fieldNames()), **counts)
        rows.write.parquet(f"{self.path}/rows/{name}")
        fs, folder = self._at(f"rows/{name}")
        if not seen.get["rows"]:
            fs.delete(folder, True)
            return {}
        number = len(self.versions()) + 1
        while not self._put(f"commits/{number}", name):
            number += 1
        return dict(seen.get)

    def _put(self, name: str, content: str) -> bool:
        """Makes a file with that content unless there is one of that name."""
        fs, target = self._at(name)
        _, pending = self._at(f"pending/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(pending)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if fs.getScheme() != "file":
                return not fs.exists(target) and fs.rename(pending, target)
            local = lambda p: self.spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            self.spark._jvm.java.nio.file.Files.createLink(local(target), local(pending))
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            fs.delete(pending, False)


def read_saved(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Saved JSON documents of one schema from several places as one table; a missing place raises."""
    out = None
    for path in paths:
        part = spark.read.schema(schema).json(path, multiLine=True)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no place given")
    return out
