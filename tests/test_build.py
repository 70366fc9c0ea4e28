"""A build from its flags to its files, with everything that a caller plugs in."""

import json

import pytest
from pyspark.sql import functions as F

from timedtext import __main__ as program
from timedtext.options import Options
from timedtext.plans import book, planner
from timedtext.schema import CUES, FRAMES
from timedtext.sources import frames
from timedtext.sources.checkpoints import Checkpoints

PNG = bytes.fromhex("89504e470d0a1a0a")


def talk(folder, name, n=120, words=12):
    folder.mkdir(parents=True, exist_ok=True)
    items = [{"start": i, "end": i + 0.9, "text": " ".join(f"w{i}x{k}" for k in range(words))} for i in range(n)]
    (folder / name).write_text(json.dumps(items))


def books(spark, out):
    return {r.video_id: json.loads(r.value) for r in spark.read.parquet(f"{out}/json").collect()}


def test_excerpts_with_images(spark, tmp_path):
    talk(tmp_path / "talks", "harbour.json")
    for i, grey in enumerate([0, 3, 200, 203]):
        (tmp_path / "images/harbour").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"images/harbour/{i}.png").write_bytes(PNG + bytes([grey]))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/harbour.log").write_text("".join(f"n:{i} pts_time:{i * 30}.5\n" for i in range(4)))
    where = lambda x: f"file://{tmp_path}/{x}"
    flags = ["build", where("talks"), "--images", where("images"), "--logs", where("logs"), "--decoder", "plugins:grey", "--pages", "8", "--reading-minutes", "20", "--checkpoints", where("kept"), "--out", where("out"), "--duration", "150"]
    for _ in range(2):  # the second time from the kept manifest
        assert program.run(flags) == 0
        made = books(spark, where("out"))["harbour"]
        assert [p["kind"] for p in made["pages"]] == ["cover", "overview"] + ["content"] * 6 and made["duration"] == 150.0
        assert len({p["frame_path"] for p in made["pages"][2:]}) == 2  # greys 0 and 200
        html = spark.read.parquet(where("out/html")).first().value
        assert book.SAMPLED_WARNING in made["warnings"] and not set(book.DURATION_WARNINGS.values()) & set(made["warnings"])
        assert html.count("data:image/png;base64,") == 6 and made["captured_visual_states"] == 2
    assert Checkpoints(spark, where("kept/frames"), frames.MANIFEST).rows().count() == 1


def test_summaries_of_a_fetched_source(spark, tmp_path, capsys):
    (tmp_path / "site").mkdir()
    (tmp_path / "site/de.srt").write_text("\n".join(f"{i}\n00:{i // 60:02}:{i % 60:02},000 --> 00:{i // 60:02}:{i % 60:02},900\n" + " ".join(f"w{i}x{k}" for k in range(12)) + "\n" for i in range(60)))
    flags = ["build", "--source", str(tmp_path / "site"), "--connector", "plugins:Shelf", "--language", "de", "--provider", "plugins:Teller", "--model", "M", "--pages", "6", "--workers", "2", "--transcript-only", "--formats", "html", "--checkpoints", f"file://{tmp_path}/kept", "--out", f"file://{tmp_path}/out"]
    assert program.run(flags) == 0
    said = capsys.readouterr().err
    assert "note:" not in said and "summaries: 1 batches, 0 kept, 0 done" in said and "1 done, 1 retried" in said and "html: 1 rows" in said
    made = books(spark, f"file://{tmp_path}/out")["de"]
    assert (made["title"], made["source_url"], made["duration"]) == ("Fetched", "https://example.org/v", 500.0)
    assert [p["title"] for p in made["pages"]] == ["Fetched", "M 2", "M 3", "M 4", "M 5", "M 6"]
    assert (made["provider"], made["model"], made["requested_pages"], made["words_a_minute"], made["seconds_a_picture"]) == ("teller", "1", 6, 180, 6)
    assert made["pages"][2]["bullets"] == [] and book.EXTRACTIVE_WARNING not in made["warnings"]


def test_build_reads_png_images_itself(spark, tmp_path):
    import numpy as np

    from timedtext.queries_images import png

    talk(tmp_path / "talks", "shore.json")
    (tmp_path / "images/shore").mkdir(parents=True)
    rng = np.random.default_rng(1)
    scenes = [rng.integers(0, 256, (90, 160, 3)), rng.integers(0, 256, (90, 160, 3))]
    for i, scene in enumerate([0, 0, 1, 1]):
        (tmp_path / f"images/shore/{i}.png").write_bytes(png(scenes[scene] // 8 * 8 + i % 2, [i, 4, 3]))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/shore.log").write_text("".join(f"n:{i} pts_time:{i * 30}.5\n" for i in range(4)))
    where = lambda x: f"file://{tmp_path}/{x}"
    assert program.run(["build", where("talks"), "--images", where("images"), "--logs", where("logs"), "--pages", "8", "--reading-minutes", "20", "--formats", "json", "--out", where("out")]) == 0
    made = books(spark, where("out"))["shore"]
    assert made["captured_visual_states"] == 2 and {p["frame_path"].rsplit("/", 1)[1] for p in made["pages"][2:]} == {"0.png", "2.png"}


def mp4(seconds):
    """The boxes of a film that has a header and no more."""
    box = lambda name, body: (len(body) + 8).to_bytes(4) + name + body
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(9)) + box(b"moov", box(b"mvhd", bytes(12) + (1000).to_bytes(4) + int(seconds * 1000).to_bytes(4) + bytes(80)))


def test_folder_that_is_fetched_and_probed(spark, tmp_path, capsys):
    source = tmp_path / "site"
    (source / "automatic").mkdir(parents=True)
    source.joinpath("info.json").write_text(json.dumps({"id": "x", "title": "From a folder"}))
    source.joinpath("automatic/en-GB.vtt").write_text("WEBVTT\n\n" + "\n".join(f"00:{i // 60:02}:{i % 60:02}.000 --> 00:{i // 60:02}:{i % 60:02}.900\n" + " ".join(f"w{i}x{k}" for k in range(12)) + "\n" for i in range(60)))
    source.joinpath("video.mp4").write_bytes(mp4(75.25))
    flags = ["build", "--source", str(source), "--connector", "timedtext.sources.fetched:Folder", "--pages", "6", "--out", f"file://{tmp_path}/out"]
    assert program.run(flags) == 0
    said = capsys.readouterr().err
    assert "tells no duration" in said and "made by a machine" in said
    made = next(iter(books(spark, f"file://{tmp_path}/out").values()))
    assert (made["title"], made["duration"]) == ("From a folder", 75.25) and not set(book.DURATION_WARNINGS.values()) & set(made["warnings"])
    with pytest.raises(book.Unusable, match="shorter than the video"):
        program.run([*flags, "--duration", "70"])
    source.joinpath("automatic/en-GB.vtt").unlink()
    with pytest.raises(ValueError, match="gave no captions"):
        program.run(flags)


def test_sources_as_a_data_source(spark, tmp_path):
    from timedtext.sources import fetched

    for name, info in (("a", {"title": "A", "duration": 9}), ("b", {"entries": [1]}), ("c", {"title": "C", "duration": "nan"})):
        (tmp_path / name / "captions").mkdir(parents=True)
        (tmp_path / name / "info.json").write_text(json.dumps(info))
    (tmp_path / "a/captions/en.srt").write_text("1")
    (tmp_path / "c/captions/fr.srt").write_text("1")
    (tmp_path / "c/video.mov").write_bytes(mp4(3)[:40])
    spark.dataSource.register(fetched.Sources)
    urls = [f"file://{tmp_path}/{n}" for n in "abcd"]
    options = {"urls": json.dumps(urls), "connector": "timedtext.sources.fetched:Folder", "folder": f"{tmp_path}/got"}
    frame = spark.read.format("timedtext_sources").options(**options).load()
    assert frame.rdd.getNumPartitions() == 4 and frame.schema.simpleString() == spark.createDataFrame([], fetched.FETCHED).schema.simpleString()
    got = {r.url[-1]: r for r in frame.collect()}
    assert (got["a"].title, got["a"].duration, got["a"].warnings) == ("A", 9.0, ["no usable video was saved"]) and got["a"].transcript_path.endswith("en.srt")
    assert "not a list" in got["b"].error and "metadata could not be fetched" in got["d"].error
    assert [w[:30] for w in got["c"].warnings] == ["the source tells no duration; ", "the source has no captions in ", "the video's duration is unknow"] and got["c"].probed_duration is None
    told = fetched.source_warnings(frame).where("level = 'error'").collect()
    assert sorted(r.url[-1] for r in told) == ["b", "d"]
    again = fetched.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), fetched.Folder(), f"{tmp_path}/again", workers=2)
    assert sorted((r.url, r.warnings, r.error) for r in again.collect()) == sorted((r.url, r.warnings, r.error) for r in got.values())
    with pytest.raises(Exception, match="must be given"):
        spark.read.format("timedtext_sources").option("urls", "[]").load().collect()


def test_input_that_forbids_a_plan(spark):
    cues = spark.createDataFrame([("a", 0, 0.0, 9.0, "some words"), ("b", 0, 3.0, 2.0, "turned round")], CUES)
    titles = cues.select("video_id", F.lit("t").alias("title"), F.lit("").alias("source_url"))
    nothing = spark.createDataFrame([], FRAMES)
    with pytest.raises(book.Unusable, match="input of b: cues must have"):
        book.build(cues, nothing, titles)
    late = spark.createDataFrame([("a", 0, 9.5, "x.png")], FRAMES)
    with pytest.raises(book.Unusable, match="input of a: frames must lie"):
        book.build(cues.where("video_id = 'a'"), late, titles, durations=planner.durations_of(cues))


def test_manifest_of_lost_files_is_made_again(spark, tmp_path):
    images = spark.createDataFrame([("v", f"{i}.png", 1, 7, bytes([g])) for i, g in enumerate([0, 90])], "video_id string, path string, length long, modified long, content binary")
    logs = spark.createDataFrame([("v", "pts_time:0 pts_time:12")], "video_id string, value string")
    import plugins

    kept = Checkpoints(spark, f"file://{tmp_path}/m", frames.MANIFEST)
    first = frames.cached_frames(images, logs, plugins.grey, kept).collect()
    again = frames.cached_frames(images, logs, None, kept).collect()  # nothing is decoded
    assert sorted(r.path for r in first) == sorted(r.path for r in again) == ["0.png", "1.png"]
    other = frames.cached_frames(images, logs, plugins.grey, kept, threshold=0.9)
    assert [r.path for r in other.collect()] == ["0.png"]
    assert kept.read().count() == 2


@pytest.mark.parametrize("change", [{"source": "https://x.example", "transcripts": None}, {"images": "i"}, {"logs": "l"}, {"images": "i", "logs": "l", "decoder": "b"}, {"images": "i", "logs": "l", "decoder": "a:b", "frames": "f"}, {"provider": "nobody"}, {"crop": (0.5, 0.5, 0.5 + 1e-12, 0.5)}])
def test_options_that_contradict(change):
    with pytest.raises(ValueError):
        Options(**{"transcripts": "x", **change}).check()
