"""Sharding against a sequential model, with nulls, repeats, hot keys, growth and clashing columns."""

import collections
import hashlib
import math
import zlib

import pytest

from timedtext.llm import queries, sharding

DOCS = "doc_id long, text string, shard string, SLOT int, lang string"


def model_shard(key, weights):
    digest = hashlib.md5(b"" if key is None else str(key).encode()).hexdigest()
    a, b = int(digest[:8], 16) % 2**31, int(digest[8:16], 16) % 2**31
    bids = []
    for s, w in enumerate(weights):
        h = (a ^ ((s + 1) * 0x9E3779B1 % 2**31)) * 1597334677 % 2147483647
        h = (h ^ b) * 1812433253 % 2147483629
        h = (h ^ 0x2545F491) * 747796405 % 2147483647
        if w:
            bids.append((-math.log((h + 0.5) / 2147483647) / w, s))
    return min(bids)[1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i % 17} é" * (i % 5), "x", 7, None) for i in range(600)]
    rows += [(None, None, "x", 7, "en"), (None, "", "x", 7, "en"), (None, "y", "x", 7, "en"), (-5, "  z", "x", 7, None), (9000, "w " * 50_000, "x", 7, None)]
    rows += [(77, "alike", "x", 7, None)] * 300  # one key, one text
    rows += [(78, f"t{i}", "x", 7, None) for i in range(300)]  # one key, many texts
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_placement_equals_model_and_grows_into_the_new_shard(docs):
    weights = [1.0, 0.0, 3.0, 0.5, 1.0]
    got = sharding.placed(docs, weights, extra=2.0).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == model_shard(r.doc_id, weights) and r.grown_shard == model_shard(r.doc_id, [*weights, 2.0])
        assert r.grown_shard in (r.shard, 5)


def test_shares_follow_the_weights(spark):
    ids = spark.range(40_000).selectExpr("id AS doc_id", "'' AS text")
    got = collections.Counter(r.shard for r in sharding.placed(ids, [1, 2, 0, 5]).select("shard").collect())
    for s, share in {0: 1 / 8, 1: 2 / 8, 3: 5 / 8}.items():
        assert abs(got[s] / 40_000 - share) < 0.01
    moved = sharding.placed(ids, [1.0] * 40, extra=1.0).where("shard <> grown_shard")
    assert abs(moved.count() / 40_000 - 1 / 41) < 0.004 and moved.select("grown_shard").distinct().collect()[0][0] == 40


@pytest.mark.parametrize("range_rows", [1, 20, 50_000])
def test_slots_are_gapless_whatever_the_ranges(docs, range_rows):
    placed = sharding.placed(docs, [1.0] * 6)
    got = sharding.with_slots(placed, range_rows).collect()
    assert len(got) == 1205
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.shard, r.slot)
    again = sharding.with_slots(placed.repartition(3), 7).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_no_range_holds_a_hot_key(docs):
    """Rows alike are one row before they are shuffled, and other rows of a key lie in ranges by their digest."""
    from pyspark.sql import functions as F

    got = sharding.with_slots(sharding.placed(docs.where("doc_id in (77, 78)"), [1.0]).select("doc_id", "size", "text_crc32", "shard"), 10)
    order = F.substring(F.md5(F.concat_ws(":", "doc_id", "size", "text_crc32", "shard").cast("binary")), 1, 2)
    rows = got.drop("slot").distinct().groupBy(order).count().agg(F.max("count")).first()[0]
    assert got.count() == 602 and rows < 20


def test_empty_bad_weights_and_files(spark, docs, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.with_slots(sharding.placed(empty, [1.0])).count() == 0
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.placed(empty, bad)
    records = sharding.with_slots(sharding.placed(docs, [1.0] * 3))
    sharding.write_shards(records, str(tmp_path / "out"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1205 and back.where("part <> slot div 100").count() == 0
    for path in {r[0] for r in back.selectExpr("_metadata.file_path").collect()}:
        slots = [r.slot for r in spark.read.parquet(path).collect()]
        assert slots == sorted(slots) and len(slots) <= 100


def test_query_equals_sql(spark, sf, same):
    same(queries.QUERIES["op13_rendezvous_shards"](spark, sf), queries.SQL["op13_rendezvous_shards"])
