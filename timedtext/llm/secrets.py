"""Secret scans by an incremental blob ledger.

Every text version is content-addressed by SHA-256.  The ledger holds, for each blob, the rule versions that have scanned it
and what they found; a run scans only pairs of blob and rule version that the ledger lacks, each blob once however many paths
hold it, and joins the findings back to all paths.  The ledger may be kept as a table between runs; raising a rule's version
rescans with that rule alone.

Spans are code points, the end exclusive.  A base kind's spans are its leftmost non-overlapping matches, of which those that
are too short are then dropped; the added kinds come after the base ones and never displace them.

Edge cases: a null text is the empty text; a null path is a path of its own; repeated rows give repeated results; an empty
table gives no rows; texts are scanned whole, whatever their length; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, shared_folder

LEDGER = "blob string, scanned array<string>, findings array<struct<kind:string, rule:string, start:int, end:int>>"


@dataclass(frozen=True)
class Rule:
    """group: the group whose length counts, 0 for the match; hints: a text without any of them, lower-cased, has no match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 6, 2, ("passw", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    # The maximal runs of 24 and more are the matches of [0-9a-f]+ that are long enough.
    Rule("hex", "[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key-----",)),
)
RULES = BASE + ADDED


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, str, int, int]]:
    """(kind, rule, start, end) of all findings of the rules in one text."""
    found, lower = [], text.lower()
    for rule in rules:
        if not rule.hints or any(h in lower for h in rule.hints):
            found += [(rule.kind, rule.name, *m.span()) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    return found


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_of(text_column: str) -> Column:
    return F.sha2(F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary"), 256)


def new_entries(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that the ledger lacks."""
    versions = only(docs, id_column, text_column).toDF("path", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", blob_of("text"))
    seen = ledger.select("blob", F.explode("scanned").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    first = versions.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    todo = first.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    texts = versions.join(todo, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b"))).select("blob", "text", "todo")
    by_name = {r.name: r for r in rules}

    def scan(batches):
        last = None
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            fresh = [a != b for a, b in zip(blobs, [last, *blobs])]  # rows alike in path and text lie side by side after the join
            batch, last = batch.filter(pa.array(fresh, pa.bool_())), blobs[-1] if blobs else last
            out = []
            for text, names in zip(batch.column(1), batch.column(2).to_pylist()):
                out.append([dict(zip(("kind", "rule", "start", "end"), f)) for f in scan_text(text.as_py(), tuple(by_name[n] for n in names))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, kind)], ["blob", "scanned", "findings"])

    # Where rows alike in path and text did not meet, one entry stays.
    return texts.mapInArrow(scan, LEDGER).dropDuplicates(["blob"])


def findings_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """path and the findings (kind, start, end) of the given rule versions, ordered by start and kind, for every row of docs."""
    order = {r.kind: i for i, r in enumerate(rules)}
    names = [r.name for r in rules]
    rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    one = ledger.select("blob", F.filter("findings", lambda f: f.rule.isin(names)).alias("findings")).where(F.size("findings") > 0)
    ordered = F.array_sort(F.transform("findings", lambda f: F.struct(f.start.alias("start"), rank[f.kind].alias("rank"), f.end.alias("end"), f.kind.alias("kind"))))
    # As a column made anew, the key is dealt out for the join on both sides, so that a blob with very many paths can be split.
    one = one.select(F.concat("blob", F.lit("")).alias("b"), ordered.alias("findings"))
    if ledger.schema["scanned"].dataType.typeName() != "array":
        raise TypeError("not a ledger")
    paths = only(docs, id_column, text_column).toDF("path", "text").select("path", blob_of("text").alias("blob"))
    return paths.join(one, F.col("blob") == F.col("b"), "left").select("path", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("findings"))


class SecretLedger:
    """A ledger kept as Parquet under path, or in the shared folder for as long as the run where no path is given."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        return empty_ledger(self.spark)

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Scans what the ledger has not seen of docs."""
        new_entries(docs, self.read(), rules, id_column, text_column).write.mode("append").parquet(self.path)

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """The findings by path; of docs that the ledger has seen."""
        # Entries of one blob from several runs are told apart by their rules.
        entries = self.read().groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"), F.flatten(F.collect_list("findings")).alias("findings"))
        return findings_by_path(docs, entries, rules, id_column, text_column)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Brings the ledger up to date with docs and returns their findings by path."""
        self.update(docs, rules, id_column, text_column)
        return self.findings(docs, rules, id_column, text_column)


def joined(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the findings, comma-joined."""
    kept = F.filter(findings, lambda f: f.kind.isin(list(kinds))) if kinds else findings
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f.end.cast("string"))), ",")


def redacted(docs: DataFrame, findings: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "[SECRET]", length_column: str | None = None) -> DataFrame:
    """docs with every found span replaced by mark; overlapping spans become one.  Rows without findings are unchanged; in the
    others length_column, if given, gets the new length.

    findings: path and findings, one row for each id or more (repeated ids with different texts are told apart by blob).
    """
    spans = findings.where(F.size("findings") > 0).select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), F.transform("findings", lambda f: F.struct(f.start.alias("start"), f.end.alias("end"))).alias("__spans")).dropDuplicates(["__path", "__blob"])
    keyed = docs.withColumn("__own", blob_of(text_column))
    text = F.col(f"`{text_column}`")
    merged = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s.start < acc.at, F.struct(acc.text.alias("text"), F.greatest(acc.at, s.end).alias("at"))).otherwise(F.struct(F.concat(acc.text, text.substr(acc.at + 1, s.start - acc.at), F.lit(mark)).alias("text"), s.end.alias("at"))),
        lambda acc: F.concat(acc.text, text.substr(acc.at + 1, F.greatest(F.length(text) - acc.at, F.lit(0)))),
    )
    out = keyed.join(spans, F.col(f"`{id_column}`").eqNullSafe(F.col("__path")) & (F.col("__own") == F.col("__blob")), "left").withColumn(text_column, F.when(F.col("__spans").isNull(), text).otherwise(merged))
    if length_column:
        length = F.length(F.col(f"`{text_column}`")).cast(docs.schema[length_column].dataType)
        out = out.withColumn(length_column, F.when(F.col("__spans").isNull(), F.col(f"`{length_column}`")).otherwise(length))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
