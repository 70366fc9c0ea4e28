"""The trie of conversations' beginnings against a sequential model, with long conversations, ties, nulls and absent bases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import xxhash

from timedtext.llm import prefixtrie, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, base long, depth int, n long, words string"


def chained(seed, *texts):
    """What Spark's xxhash64 of an int and strings is."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for t in texts:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h - 2**64 if h >= 2**63 else h


def model(rows, family=20, shared=4):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, chained(1, role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % shared
        path = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], tuple(ends[p])) for p, m in members.items())


def found(conversations, **settings):
    nodes, ends = prefixtrie.prefix_trie(conversations, **settings)
    at = collections.defaultdict(list)
    for r in ends.collect():
        at[r.conv_id, r.depth].append(r.member)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return sorted((*(r[n] for n in names), tuple(sorted(at[r.conv_id, r.depth]))) for r in nodes.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    starts = [[("user", f"hello {i} é"), ("bot", "hi there"), (None, None), ("user", " a  b\tc ")] for i in range(3)]
    out = []
    for c in [*range(0, 130), 1000, 1001, 1039, 2005, 10**12 + 7, 10**12 + 20]:
        if c in (40, 41):
            continue
        turns = list(rng.choice(starts))[: rng.randrange(0, 5)] + [("user", f"w{rng.randrange(3)} x") for _ in range(rng.randrange(0, 5))]
        out += [(c, k, *t) for k, t in enumerate(turns or [("user", "only")])]
    for c in (60, 61, 75, 300):  # long ones, that share much
        out += [(c, k, "user", f"t {k if c != 75 or k < 40 else -k}") for k in range(60)]
    out += [(80, None, "a", "first")] * 3 + [(80, 1, "tie", f"t{i}") for i in range(4)] + [(None, 0, "u", "nobody's")] + [(99, 5, "u", "again")] * 25
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, 2, "clash") for r in rows], TURNS).repartition(3)


@pytest.mark.parametrize("head", [2000, 30, 4])
def test_trie_equals_model(spark, rows, head, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 25)
    assert found(frame(spark, rows), head=head) == model(rows)


def test_other_families_and_parents_with_many_children(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, k, "u", "same start" if k < 2 else f"x{rng.randrange(10**6)}") for c in range(1500) for k in range(3)]
    assert found(frame(spark, rows), family=7, shared=3) == model(rows, 7, 3)
    nodes, _ = prefixtrie.prefix_trie(frame(spark, rows))
    assert max(r.n_children for r in nodes.collect()) > 1000  # through the broadcast


def test_digests_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 10)
    members = [-25, -3, 0, 4, 9, 10, 95, 100, 1000, 12345678901]
    ends = spark.createDataFrame([(1, 2, m) for m in reversed(members)] + [(3, 2, 5)], "conv_id long, depth long, member long").repartition(4)
    got = {(r.conv_id, r.depth): r.digest for r in prefixtrie.end_digests(ends).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, members)).encode()).hexdigest(), (3, 2): hashlib.sha256(b"5").hexdigest()}


def test_empty_tables_and_bad_settings(spark):
    nodes, ends = prefixtrie.prefix_trie(frame(spark, []))
    assert nodes.count() == ends.count() == prefixtrie.end_digests(ends).count() == 0
    with pytest.raises(ValueError):
        prefixtrie.prefix_trie(frame(spark, []), head=3)


def test_query_equals_sql_and_model(spark, sf, duck):
    got = queries.QUERIES["op12_prefix_trie"](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(map(str, got.select(*columns).collect()))
    wanted = duck.sql(queries.SQL["op12_prefix_trie"]).select(*columns).fetchall()
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in wanted) and rows
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    digests = sorted((x[0], x[1], x[6], hashlib.sha256(",".join(map(str, x[7])).encode()).hexdigest()) for x in model([tuple(r) for r in turns]))
    assert sorted((r.conv_id, r.depth, r.saved_tokens, r.ends_sha256) for r in got.collect()) == digests
