"""Periodic runs against brute force over all stretches and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from timedtext.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model_runs(words, least=6, times=4):
    """Every maximal stretch of every period; the smallest period of each stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, times * q):
                found.setdefault((start, end), q)
            start = max(start + 1, end - q + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def repetitive(rng, n, letters):
    out = []
    while len(out) < n:
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        out += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
        if rng.random() < 0.3 and out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(40)]
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 5, 50])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(120):
        words = repetitive(rng, rng.randrange(0, 150), letters)
        assert runs.runs(words) == model_runs(words)
        assert runs.runs(words, 2, 2) == model_runs(words, 2, 2)


def test_factors_are_longest_earlier_strings():
    rng = random.Random(5)
    for _ in range(60):
        words = repetitive(rng, rng.randrange(1, 70), 3)
        at = 0
        for start, length, source in runs.factors(words):
            assert start == at
            longest = max((next((k for k in range(len(words) - at) if words[s + k] != words[at + k]), len(words) - at) for s in range(at)), default=0)
            assert length == max(longest, 1)
            if longest:
                assert source < at and words[source : source + length] == words[at : at + length]
            at += length
        assert at == len(words)


def test_stretches_hold_every_run_with_its_neighbours():
    rng = random.Random(9)
    for _ in range(60):
        texts = [repetitive(rng, rng.randrange(0, 300), rng.choice([2, 30, 400])) for _ in range(4)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        spans = runs.stretches(np.array([w * 0x9E3779B97F4A7C15 % 2**64 for t in texts for w in t], np.uint64), first).tolist()
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        for t, base in zip(texts, first):
            for s, e, _ in model_runs(t):
                assert any(a <= base + max(s - 1, 0) and base + min(e + 1, len(t)) <= b for a, b in spans)


def test_prose_is_passed_over_and_long_periods_are_found():
    rng = random.Random(2)
    unit = [rng.randrange(300) for _ in range(700)]
    words = [rng.randrange(300) for _ in range(5000)] + unit * 4 + unit[:9] + [rng.randrange(300) for _ in range(5000)]
    hashes = np.array(words, np.uint64) * np.uint64(0xD1342543DE82EF95)
    spans = runs.stretches(hashes, np.array([0, len(words)]))
    assert len(spans) == 1 and spans[0][1] - spans[0][0] < 6000
    found = [r for r in runs.runs(words[spans[0][0] : spans[0][1]])]
    assert len(found) == 1 and found[0][2] == 700 and found[0][1] - found[0][0] >= 2809


DOCS = "doc_id long, text string, id string, runs int, collapsed string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "a b " * 4, "x y z " * 3, "é ü " * 5 + "end", " nb sp ace\x1c\x85ok " * 9]
    texts += [" ".join(f"w{w}" for w in repetitive(rng, rng.randrange(1, 200), rng.choice([2, 4, 300]))) for _ in range(60)]
    texts += ["same " * 30_000, " ".join(str(rng.randrange(5000)) for _ in range(20_000))]
    rows = [(None if i == 20 else i - 5, t, "clash", 1, "c", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[8]], DOCS).repartition(3)


@pytest.mark.parametrize("reach", [True, False])
def test_operator_equals_brute_force(docs, reach):
    keep = docs.where("text IS NULL OR length(text) < 50000")
    got = runs.find_runs(keep, reach=reach).collect()
    wanted = []
    for r in keep.collect():
        words = WORD.findall(r.text or "")
        found = model_runs(words)
        gone = {i for s, e, q in found for i in range(s + q, e)}
        wanted.append((r.doc_id, len(words), [(s, e - s, q) for s, e, q in found], " ".join(w for i, w in enumerate(words) if i not in gone)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(wanted, key=key)


def test_long_texts_empty_tables_and_bad_settings(spark, docs):
    long = {r.n_words: r for r in runs.find_runs(docs.where("length(text) > 50000")).collect()}
    assert [tuple(x) for x in long[30_000].runs] == [(0, 30_000, 1)] and long[30_000].collapsed == "same"
    assert long[20_000].runs == [] and len(long[20_000].collapsed.split()) == 20_000
    assert runs.find_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, times=1)


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for r in rows:
        words = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = model_runs(words)
        planted += bool(found)
        gone = {i for s, e, q in found for i in range(s + q, e)}
        best = max(found, key=lambda x: (x[1] - x[0], -x[0]), default=None)
        x = got[r.doc_id]
        assert x.n_runs == len(found)
        wanted = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (x.start, x.length, x.period, x.exponent_milli) == wanted
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted >= 10


def test_tails_of_null_ids_and_blank_texts(spark):
    """The query's periodic tails: a null id counts as the empty text, whose checksum is 0; texts without words stay as they are."""
    chosen = next(i for i in range(1, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    other = next(i for i in range(1, 1000) if zlib.crc32(str(i).encode()) % 10)
    rows = [(None, "a b c d e f g h"), (chosen, None), (chosen, " \t"), (chosen, "one"), (other, "x  y"), (chosen, "a b c d e f g h i j k l m n o p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in queries.with_periodic_tails(frame.coalesce(1)).collect()]
    words = "a b c d e f g h i j k l m n o p".split()
    g = zlib.crc32(str(chosen).encode()) // 10
    a = g % 16
    p = 1 + (16 - a) // (3 + g % 8)
    assert got == ["a b c a b c a b", None, " \t", "one", "x  y", " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(16))]
