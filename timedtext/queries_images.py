"""Registered queries over PNG images that Spark makes of the events, and SQL over the pixels that they were made of."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import TURNS, query
from .sources import frames, pixels
from .sources.fixtures import conversation_cues, table

WIDTH, HEIGHT = 12, 8
#: Of pixels in SQL: event e, row y, column x, sample c; even events are grey.
PIXEL = "(e * 31 + y * y * 7 + x * 13 * (c + 1) + (x * y) % 11 * 17) % 256"
PIXELS = f"px AS (SELECT e, y, x, c, CAST({PIXEL} AS DOUBLE) AS v FROM (SELECT event_id AS e FROM events), range({HEIGHT}) AS r(y), range({WIDTH}) AS s(x), range(3) AS t(c) WHERE c < CASE WHEN e % 2 = 0 THEN 1 ELSE 3 END)"


def pixels_of(event: int) -> np.ndarray:
    return _pixels(np.array([event]))[0]


def _pixels(events: np.ndarray) -> np.ndarray:
    """The images of events that are all even or all odd."""
    e, y, x, c = events[:, None, None, None], *np.ogrid[:HEIGHT, :WIDTH, : 1 if events[0] % 2 == 0 else 3]
    return ((e * 31 + y * y * 7 + x * 13 * (c + 1) + (x * y) % 11 * 17) % 256).astype(np.uint8)


def _filtered(images: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The rows of images of one shape, each with its filter's number before it.  kinds: image by row."""
    n, height, width, samples = images.shape
    rows = images.reshape(n, height, -1).astype(np.int16)
    up, left, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    up[:, 1:] = rows[:, :-1]
    left[:, :, samples:], corner[:, :, samples:] = rows[:, :, :-samples], up[:, :, :-samples]
    near = np.stack([left, up, corner])
    nearest = np.take_along_axis(near, np.argmin(np.abs(near - (left + up - corner)), axis=0)[None], 0)[0]
    guess = np.choose(kinds[:, :, None], [0, left, up, (left + up) // 2, nearest])
    return np.concatenate([kinds[:, :, None].astype(np.uint8), (rows - guess).astype(np.uint8)], axis=2)


def _packed(shape: tuple[int, int, int], body: bytes) -> bytes:
    height, width, samples = shape
    chunk = lambda name, data: len(data).to_bytes(4) + name + data + zlib.crc32(name + data).to_bytes(4)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[samples]
    return pixels.SIGNATURE + chunk(b"IHDR", width.to_bytes(4) + height.to_bytes(4) + bytes([8, colour, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def png(image: np.ndarray, kinds: list[int]) -> bytes:
    """A PNG image whose rows have filters of these kinds, one after the other."""
    return _packed(image.shape, _filtered(image[None], np.resize(kinds, len(image))[None])[0].tobytes())


def _drawn(event: Column) -> Column:
    @F.pandas_udf("binary")
    def draw(events: pd.Series) -> pd.Series:
        e, out = events.to_numpy(), np.empty(len(events), object)
        for odd in (0, 1):
            own = np.flatnonzero(e % 2 == odd)
            for at in np.array_split(own, len(own) // 1000 + 1) if len(own) else ():
                images = _pixels(e[at])
                out[at] = [_packed(images.shape[1:], body.tobytes()) for body in _filtered(images, (e[at, None] + np.arange(HEIGHT) % 5) % 5)]
        return pd.Series(out)

    return draw(event)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' ids, dealt to as many tasks as there are cores, or one for each 20,000: an image takes far longer than its id."""
    ids = table(spark, sf_dir, "events").select("event_id")
    return ids.repartition(max(spark.sparkContext.defaultParallelism, ids.count() // 20_000))


BOXES = [(0, 0, WIDTH, HEIGHT), (3, 2, 9, 6), (10, 7, 40, 40)]


@query(f"""WITH {PIXELS} SELECT e AS event_id, {WIDTH} AS width, {HEIGHT} AS height, round(avg(v), 6) AS whole, round(avg(v) FILTER (x BETWEEN 3 AND 8 AND y BETWEEN 2 AND 5), 6) AS middle, round(avg(v) FILTER (x >= 10 AND y >= 7), 6) AS corner,
  avg(v) BETWEEN 100 AND 150 AND avg(v) FILTER (x BETWEEN 3 AND 8 AND y BETWEEN 2 AND 5) BETWEEN 90 AND 160 AS fits FROM px GROUP BY e""")
def a13_region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, the means of three regions, and whether they are a layout's."""
    m = _events(spark, sf_dir).select("event_id", pixels.measured(_drawn(F.col("event_id")), BOXES).alias("m")).select("event_id", "m.*")
    means = [F.round(F.col("means")[i], 6).alias(n) for i, n in enumerate(("whole", "middle", "corner"))]
    return m.select("event_id", F.col("size")[0].alias("width"), F.col("size")[1].alias("height"), *means, frames.fits_layout(F.col("size"), F.col("means"), (WIDTH, HEIGHT), [(100, 150), (90, 160)]).alias("fits"))


@query(f"""WITH {PIXELS} SELECT e AS event_id, {", ".join(f"round(avg(v) FILTER (y BETWEEN {2 + 2 * r} AND {3 + 2 * r} AND x BETWEEN {3 + 2 * k} AND {4 + 2 * k}), 6) AS cell_{r}{k}" for r in range(2) for k in range(3))} FROM px GROUP BY e""")
def s15_cropped_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each image on a raster of two by three."""

    @F.pandas_udf("array<double>")
    def cells(contents: pd.Series) -> pd.Series:
        return pd.Series(pixels.decode_many(contents.tolist(), (2, 3, 3), (0.25, 0.25, 0.5, 0.5)).mean(axis=3).reshape(len(contents), -1).tolist())

    made = _events(spark, sf_dir).select("event_id", cells(_drawn(F.col("event_id"))).alias("m"))
    return made.select("event_id", *[F.round(F.col("m")[3 * r + k], 6).alias(f"cell_{r}{k}") for r in range(2) for k in range(3)])


@query(f"""WITH ev AS (SELECT event_id AS e FROM events), both_ AS (SELECT e AS event_id, e + k AS e, k FROM ev, range(2) AS r(k)),
p AS (SELECT event_id, k, y, x, t, CAST({PIXEL} AS DOUBLE) AS v FROM (SELECT *, CASE WHEN e % 2 = 0 THEN 0 ELSE t END AS c FROM both_, range({HEIGHT}) AS r(y), range({WIDTH}) AS s(x), range(3) AS q(t))),
change AS (SELECT event_id, avg(abs(a.v - b.v)) / 255 AS d FROM p a JOIN p b USING (event_id, y, x, t) WHERE a.k = 0 AND b.k = 1 GROUP BY event_id),
grey AS (SELECT event_id, k, y, x, avg(v) AS g FROM p GROUP BY ALL),
edge AS (SELECT event_id, k, y, x, abs(lead(g) OVER (PARTITION BY event_id, k, y ORDER BY x) - g) AS g FROM grey),
outline AS (SELECT event_id, avg(abs(a.g - b.g)) / greatest(8, avg(a.g), avg(b.g)) AS d FROM edge a JOIN edge b USING (event_id, y, x) WHERE a.k = 0 AND b.k = 1 AND a.g IS NOT NULL GROUP BY event_id)
SELECT event_id, round(greatest(c.d, least(1, o.d)), 6) AS difference FROM change c JOIN outline o USING (event_id)""")
def f20_image_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much each event's image differs from the next one's."""
    pair = pixels.difference(_drawn(F.col("event_id")), _drawn(F.col("event_id") + 1), (HEIGHT, WIDTH, 3))
    return _events(spark, sf_dir).select("event_id", F.round(pair, 6).alias("difference"))


GREY = "(video_id * 37 + ordinal * 53 + length(text)) % 256"


@query(f"""WITH RECURSIVE {TURNS}, n AS (SELECT video_id, ordinal, CAST({GREY} AS DOUBLE) / 255 AS v, row_number() OVER p AS i, lag(CAST({GREY} AS DOUBLE) / 255) OVER p AS before FROM turns WINDOW p AS (PARTITION BY video_id ORDER BY ordinal)),
walk AS (SELECT video_id, i, ordinal, v AS anchor, true AS keep FROM n WHERE i = 1
  UNION ALL SELECT n.video_id, n.i, n.ordinal, CASE WHEN abs(n.v - n.before) > {frames.THRESHOLD} OR abs(n.v - w.anchor) > {frames.THRESHOLD} THEN n.v ELSE w.anchor END, abs(n.v - n.before) > {frames.THRESHOLD} OR abs(n.v - w.anchor) > {frames.THRESHOLD}
  FROM walk w JOIN n ON n.video_id = w.video_id AND n.i = w.i + 1)
SELECT video_id, CAST(ordinal AS INTEGER) AS ordinal, ordinal * CAST(2.5 AS DOUBLE) AS ts, printf('%04d.png', ordinal) AS path FROM walk WHERE keep""")
def s13_select_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one grey for each turn and the extraction's log of its times, to the frames that show something new."""

    @F.pandas_udf("binary")
    def plain(greys: pd.Series) -> pd.Series:
        return greys.map(lambda g: png(np.full((HEIGHT, WIDTH, 3), g, np.uint8), [g % 5]))

    turns = conversation_cues(spark, sf_dir)
    path = F.concat(F.lpad(F.col("ordinal").cast("string"), 4, "0"), F.lit(".png"))
    images = turns.select("video_id", path.alias("path"), plain(F.expr(GREY)).alias("content"))
    line = F.concat(F.lit("[info] n:"), F.col("ordinal").cast("string"), F.lit(" pts_time: "), (F.col("ordinal") * 2.5).cast("string"), F.lit(" fmt:rgb24"))
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    logs = turns.groupBy("video_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("value"))
    return frames.select_frames(images, logs)
