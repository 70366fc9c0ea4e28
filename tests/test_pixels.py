"""PNG images against their pixels, resampling against exact areas, and means of boxes against slices."""

import zlib

import numpy as np
import pytest

from timedtext.queries_images import png
from timedtext.sources import pixels
from timedtext.sources.frames import image_difference, image_differences


def chunk(name, data):
    return len(data).to_bytes(4) + name + data + zlib.crc32(name + data).to_bytes(4)


def packed(width, height, depth, colour, body, *more, interlaced=0):
    head = width.to_bytes(4) + height.to_bytes(4) + bytes([depth, colour, 0, 0, interlaced])
    return pixels.SIGNATURE + chunk(b"IHDR", head) + b"".join(more) + chunk(b"IDAT", zlib.compress(body)[:5]) + chunk(b"IDAT", zlib.compress(body)[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
def test_every_filter(samples, kinds):
    rng = np.random.default_rng(samples)
    for height, width in ((1, 1), (5, 7), (16, 3)):
        image = rng.integers(0, 256, (height, width, samples)).astype(np.uint8)
        assert np.array_equal(pixels.read_png(png(image, kinds)), image)


def test_depths_and_palettes():
    two = packed(3, 2, 2, 0, b"\x00\b\x00\xe4".replace(b"\b", b"\x1b"))
    assert pixels.read_png(two)[:, :, 0].tolist() == [[0, 85, 170], [255, 170, 85]]
    one = packed(9, 1, 1, 0, b"\x00\xa5\x80")
    assert pixels.read_png(one)[0, :, 0].tolist() == [255, 0, 255, 0, 0, 255, 0, 255, 255]
    deep = packed(2, 1, 16, 2, b"\x00" + bytes(range(12)))
    assert pixels.read_png(deep)[0].tolist() == [[0, 2, 4], [6, 8, 10]]
    colours = chunk(b"PLTE", bytes([1, 2, 3, 9, 8, 7]))
    assert pixels.read_png(packed(3, 1, 4, 3, b"\x00\x01\x10", colours))[0].tolist() == [[1, 2, 3], [9, 8, 7], [9, 8, 7]]
    with pytest.raises(pixels.ImageError, match="palette"):
        pixels.read_png(packed(3, 1, 4, 3, b"\x00\x02\x10", colours))


def test_images_that_cannot_be_read():
    whole = png(np.zeros((4, 4, 3), np.uint8), [0])
    for content, said in ((b"", "no PNG"), (b"GIF89a", "no PNG"), (whole[:-5], "cut off"), (whole[:40] + bytes([whole[40] ^ 1]) + whole[41:], "damaged"), (packed(2, 2, 8, 0, b"\x00"), "too few rows"), (packed(1, 1, 8, 0, b"\x07\x00"), "unknown kind"), (packed(1, 1, 8, 0, b"\x00\x00", interlaced=1), "interlaced"), (packed(1 << 20, 1 << 20, 8, 0, b""), "not read")):
        with pytest.raises(pixels.ImageError, match=said):
            pixels.read_png(content)


def test_resampling_equals_exact_areas():
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 10, 3)).astype(float)
    for height, width in ((3, 5), (4, 7), (9, 13), (1, 1), (6, 10)):
        fine = np.kron(image, np.ones((height, width, 1)))  # each pixel as height by width ones, so that areas are whole
        wanted = fine.reshape(height, 6, width, 10, 3).mean(axis=(1, 3))
        assert np.allclose(pixels.resampled(image, height, width), wanted)


def test_crops_and_box_means():
    image = np.arange(20 * 30 * 3).reshape(20, 30, 3) % 251
    assert pixels.cropped(image, None).shape == (20, 30, 3) and pixels.cropped(image, (0.5, 0.25, 0.5, 0.75)).shape == (15, 15, 3)
    assert np.array_equal(pixels.cropped(image, (0.1, 0.1, 0.2, 0.3)), image[2:8, 3:9]) and pixels.cropped(image, (0.99, 0.99, 0.001, 0.001)).shape == (1, 1, 3)
    boxes = [(0, 0, 30, 20), (3, 4, 5, 9), (25, 15, 99, 99), (40, 0, 50, 5), (5, 5, 5, 9), (-4, -4, 2, 2)]
    got = pixels.box_means(pixels.area_table(image), boxes)
    for mean, (l, t, r, b) in zip(got, boxes):
        part = image[max(t, 0) : max(b, 0), max(l, 0) : max(r, 0)]
        assert np.isnan(mean) if part.size == 0 else mean == pytest.approx(part.mean())


def test_columns_of_images(spark):
    rows = [(1, png(np.full((4, 6, 1), 9, np.uint8), [2])), (2, b"x"), (3, None)]
    frame = spark.createDataFrame(rows, "id int, content binary")
    got = {r.id: r.m for r in frame.select("id", pixels.measured(frame.content, [(0, 0, 6, 4)]).alias("m")).collect()}
    assert got[1].size == [6, 4] and got[1].means == [9.0] and "no PNG" in got[2].error and got[3].error is None and got[3].means is None
    assert [r.d for r in frame.where("id <> 2").select(pixels.difference(frame.content, frame.content, (8, 8, 3)).alias("d")).collect()] == [0.0, None]


def test_many_images_are_read_as_each_is(monkeypatch):
    """Images of several shapes and kinds, nulls and broken ones among them, together and in blocks."""
    rng = np.random.default_rng(9)
    made = [png(rng.integers(0, 256, (h, w, s)).astype(np.uint8), rng.integers(0, 5, 4).tolist()) for h, w, s in ((4, 6, 1), (4, 6, 3), (5, 7, 4), (3, 3, 2)) for _ in range(40)]
    made += [packed(9, 1, 1, 0, b"\x00\xa5\x80"), packed(2, 1, 16, 2, b"\x04" + bytes(range(12)))] * 20
    broken = [None, b"x", packed(1, 1, 8, 0, b"\x07\x00")]
    order = rng.permutation(len(made) + len(broken))
    for together in (pixels.TOGETHER, 500):
        monkeypatch.setattr(pixels, "TOGETHER", together)
        got = list(pixels.read_many([(made + broken)[i] for i in order]))
        for i, image in zip(order.tolist(), got):
            if i < len(made):
                assert np.array_equal(image, pixels.read_png(made[i]))
        assert [str(got[order.tolist().index(len(made) + k)])[:12] for k in range(3)] == ["None", "the file is ", "the image ha"]
        for crop in (None, (0.25, 0.25, 0.5, 0.5)):
            assert np.array_equal(pixels.decode_many(made, (3, 5, 3), crop), np.stack([pixels.decode(c, (3, 5, 3), crop) for c in made]))
    a, b = pixels.decode_many(made[:9], (8, 8, 3)), pixels.decode_many(made[9:18], (8, 8, 3))
    assert np.allclose(image_differences(a, b), [image_difference(x, y) for x, y in zip(a, b)])


def test_alike_images_with_a_broken_one(monkeypatch):
    """Of many images of one shape one has a row of an unknown kind: it alone is an error."""
    good = png(np.arange(12, dtype=np.uint8).reshape(3, 4, 1), [4])
    bad = packed(4, 3, 8, 0, b"\x00" * 10 + b"\x09" + b"\x00" * 4)
    got = list(pixels.read_many([good] * 30 + [bad] + [good] * 30))
    assert [isinstance(x, pixels.ImageError) for x in got] == [False] * 30 + [True] + [False] * 30
