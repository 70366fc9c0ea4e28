"""A provider's answers are kept before they are judged; tables of results that several runs add to; counts of what was done."""

import threading

import pytest
from pyspark.sql import functions as F

from timedtext.operators import summaries
from timedtext.plans import book
from timedtext.progress import StreamReport, counted
from timedtext.schema import CUES, FRAMES
from timedtext.sources.checkpoints import Checkpoints


class Counting:
    """Writes a line for each call; the first answer of every second batch breaks a rule."""

    name, version = "counting", "1"

    def __init__(self, log, wrong=lambda page: page % 8 == 3):
        self.log, self.wrong = log, wrong

    def summarize(self, records, max_words, feedback):
        first = records[0]["page_id"]
        with open(self.log, "a") as f:
            f.write(f"{first} {feedback or ''}\n")
        quote = lambda r: "never said" if feedback is None and self.wrong(first) else " ".join(r["source_text"].split()[1:4])
        return [{"page_id": r["page_id"], "title": f"Page {r['page_id']}", "summary": "In short.", "bullets": [], "takeaway": "", "chapter": "", "uncertainty": "", "evidence": [quote(r)]} for r in records]


class Mute(Counting):
    def summarize(self, records, max_words, feedback):
        super().summarize(records, max_words, feedback)
        return None


@pytest.fixture(scope="module")
def content(spark):
    rows = [("v", n, 0.0, 9.0, f"[00:00:00] w{n} some words that were said", 40) for n in range(3, 15)]
    return spark.createDataFrame(rows, "video_id string, number int, start double, end double, source_text string, max_words int")


@pytest.mark.parametrize("lasting", [False, True])
def test_a_batch_is_asked_once_for_each_attempt(spark, tmp_path, content, lasting):
    """Twelve pages are three batches, of which two are asked again; validating, writing and reading ask nothing more."""
    kept = Checkpoints(spark, f"file://{tmp_path}/kept", summaries.RESULT_CHECKPOINT) if lasting else None
    heard, provider = [], Counting(str(tmp_path / "log"))
    made = book.summarized(content, provider, kept, None, lambda stage, counts: heard.append((stage, dict(counts))))
    made.write.parquet(str(tmp_path / "out"))
    assert made.count() == spark.read.parquet(str(tmp_path / "out")).where("title = concat('Page ', number)").count() == 12
    calls = (tmp_path / "log").read_text().splitlines()
    assert len(calls) == 5 and sum("a quote is not" in c for c in calls) == 2
    assert heard == [("summaries", {"batches": 3, "kept": 0, "done": 1, "retried": 0}), ("summaries", {"batches": 3, "kept": 0, "done": 3, "retried": 2})]
    if lasting:
        rows = kept.rows()
        assert rows.count() == 5 and rows.where("problem IS NULL").count() == heard[-1][1]["done"] and rows.where("attempt > 1").count() == heard[-1][1]["retried"]
        heard.clear()
        assert summaries.summarize(content, provider, None, checkpoints=kept, report=lambda *x: heard.append(x)).count() == 12
        assert len((tmp_path / "log").read_text().splitlines()) == 5 and heard[0][1] == {"batches": 3, "kept": 3, "done": 3, "retried": 0}


def test_whole_build_asks_once(spark, tmp_path):
    rows = [("v", i, float(i), i + 0.9, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(120)]
    titles = spark.createDataFrame([("v", "T", "")], "video_id string, title string, source_url string")
    pages, videos = book.build(spark.createDataFrame(rows, CUES), spark.createDataFrame([], FRAMES), titles, 8, 20.0, provider=Counting(str(tmp_path / "log"), lambda page: False))
    assert pages.count() == 8 and videos.count() == 1 and pages.where("kind = 'overview'").first().title == "Page 2"
    assert sorted(c.split()[0] for c in (tmp_path / "log").read_text().splitlines()) == ["2", "3", "7"]


def test_invalid_answers_are_kept_but_count_for_nothing_in_another_run(spark, tmp_path, content):
    kept = Checkpoints(spark, f"file://{tmp_path}/kept", summaries.RESULT_CHECKPOINT)
    stubborn = Counting(str(tmp_path / "log"), lambda page: False)
    stubborn.summarize = lambda records, words, feedback: [{"page_id": 0}]
    with pytest.raises(RuntimeError, match="after 3 attempts: page ids"):
        summaries.summarize(content, stubborn, None, checkpoints=kept)
    assert kept.rows().groupBy("attempt").count().orderBy("attempt").collect() == [(1, 3), (2, 3), (3, 3)]
    with pytest.raises(RuntimeError, match="no answer"):
        summaries.summarize(content, Mute(str(tmp_path / "log")), None, checkpoints=kept)
    assert kept.rows().where("result IS NULL").count() == 3  # one attempt
    assert summaries.summarize(content, Counting(str(tmp_path / "log")), None, checkpoints=kept).count() == 12
    lacking = Counting(str(tmp_path / "log"))
    lacking.version, lacking.summarize = "2", lambda records, words, feedback: [{"page_id": r["page_id"], "title": None} for r in records]
    with pytest.raises(RuntimeError, match="lacks what was asked for"):
        summaries.summarize(content, lacking, None, checkpoints=kept)


def test_runs_that_add_the_same_keys_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    sessions = [spark.newSession() for _ in range(4)]

    def add(n):
        kept = Checkpoints(sessions[n], path, "run int, part int")
        for part in range(3):
            kept.add(sessions[n].range(50).selectExpr("cast(id AS string) AS key", f"{n} AS run", f"{part} AS part").repartition(3))

    threads = [threading.Thread(target=add, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    kept, seen = Checkpoints(spark, path, "run int, part int"), []
    while any(t.is_alive() for t in threads):
        seen.append(kept.rows().groupBy("version").count().collect())
    [t.join() for t in threads]
    assert all(r["count"] == 50 for rows in seen for r in rows)  # whole versions only
    assert len(kept.versions()) == len(set(kept.versions())) == 12 and kept.rows().count() == 600
    once = kept.read()
    assert once.count() == 50 and once.select("run", "part").distinct().count() == 1  # the version that was first
    (tmp_path / "table/rows/unfinished").mkdir()
    spark.range(3).selectExpr("cast(id AS string) AS key", "9 AS run", "9 AS part").write.parquet(f"{path}/rows/lost")
    assert kept.rows().count() == 600 and kept.missing(spark.range(60).selectExpr("cast(id AS string) AS key")).count() == 10
    assert kept.add(spark.range(0).selectExpr("cast(id AS string) AS key", "1 AS run", "1 AS part")) == {} and len(kept.versions()) == 12


def test_counts_of_a_stream_equal_its_table(spark, tmp_path):
    from timedtext.streaming import online

    heard, listener = [], None
    for n in (3, 5):
        spark.range(n).selectExpr("id", "current_timestamp() AS at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = StreamReport(lambda name, counts: heard.append((name, counts)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("put", F.count_if(F.col("id") % 2 == 0).alias("even"))
        q = online.write_once(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").queryName("numbers").trigger(availableNow=True).start()
        q.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        for _ in range(100):
            if any(c.get("ended") for _, c in heard):
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(listener)
    table = spark.read.parquet(f"{tmp_path}/out")
    told = [c for name, c in heard if name == "numbers"]
    assert sum(c["rows"] for c in told) == table.count() == sum(listener.total.values()) == 8
    assert sum(c["even"] for c in told) == table.where("id % 2 = 0").count() and heard[-1][1] == {"ended": 1, "failed": 0}


def test_counted_rows(spark, tmp_path):
    rows, seen = counted(spark.range(10), odd=F.count_if(F.col("id") % 2 == 1))
    rows.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"rows": 10, "odd": 5}


def test_a_provider_sees_pictures_once_and_its_key_goes_by_them(spark, tmp_path):
    class Looking(Counting):
        def summarize(self, records, max_words, feedback):
            made = super().summarize(records, max_words, feedback)
            return [m | {"title": f"{(r['image'] or b'none').decode()} {sorted(r)[0]}"} for m, r in zip(made, records)]

    rows = [("v", n, 0.0, 9.0, "[00:00:00] some words that were said", f"p{n % 2}.png" if n < 9 else None) for n in range(3, 11)]
    pages = spark.createDataFrame(rows, "video_id string, number int, start double, end double, source_text string, frame_path string")
    images = lambda even: spark.createDataFrame([("p0.png", even), ("p1.png", b"odd"), ("p1.png", b"odd"), ("other.png", b"x")], "path string, content binary")
    kept, log = Checkpoints(spark, f"file://{tmp_path}/kept", summaries.RESULT_CHECKPOINT), tmp_path / "log"
    ask = lambda images_: {r.page_id: r.title for r in summaries.summarize(pages, Looking(str(log), lambda page: False), 40, checkpoints=kept, images=images_).collect()}
    wanted = {n: f"{'none' if n >= 9 else 'odd' if n % 2 else 'even'} end" for n in range(3, 11)}
    assert ask(images(b"even")) == wanted == ask(images(b"even")) and len(log.read_text().splitlines()) == 2
    assert ask(images(b"EVEN"))[4] == "EVEN end" and len(log.read_text().splitlines()) == 4
    assert set(ask(None).values()) == {"none end"}
