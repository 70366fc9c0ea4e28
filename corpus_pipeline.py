"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Toxic documents go; of near copies one stays; documents that hold benchmark items go; secrets are replaced by a mark; and a
mixture by domain, language and source is taken of the rest.  All stages but the last return the columns of documents.

Edge cases: null and blank texts are alike, so one of them stays, and the mixture takes none; rows alike in id and text are one
document; rows without an id are kept unless another stage drops them; empty tables give no rows; other columns are carried
along, but for tokens, epoch, take_tokens and domain, which the mixture sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timedtext.llm import decontaminate, queries, secrets, simhash, toxicity
from timedtext.llm.common import release, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return toxicity.without_toxic(docs, queries.trained_toxicity(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return secrets.redacted(docs, secrets.SecretLedger(spark).scan(docs), length_column="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return queries.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]
#: SimHash groups, alignments and the toxicity model are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents.  What a stage writes lies in the shared folder until the next one has been written; the
    result, which is read when it is needed, stays there."""
    import uuid

    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
