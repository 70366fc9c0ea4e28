"""PNG images as arrays, cut, resampled and measured, in numpy on the executors."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type: grey, colours, palette, grey and alpha, colours and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: No image of more pixels is unpacked.
MOST_PIXELS = 1 << 26


class ImageError(ValueError):
    """What is no image that can be read."""


def _chunks(content: bytes) -> dict[bytes, list[bytes]]:
    if content[:8] != SIGNATURE:
        raise ImageError("the file is no PNG image")
    found, at = {}, 8
    while at + 12 <= len(content):
        length = int.from_bytes(content[at : at + 4])
        name, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + length]
        if zlib.crc32(name + body) != int.from_bytes(content[at + 8 + length : at + 12 + length]):
            raise ImageError("a part of the image is damaged")
        found.setdefault(name, []).append(body)
        at += 12 + length
        if name == b"IEND":
            return found
    raise ImageError("the image is cut off")


def _unfiltered(raw: np.ndarray, apart: int) -> np.ndarray:
    """Rows of a filter's number and bytes, as plain bytes.  A byte's neighbours are `apart` bytes before it, and above it.

    Differences to the left are running sums, those to above one addition a row; the two filters that mix both go byte by byte.
    """
    kinds, rows = raw[:, 0], raw[:, 1:]
    out = np.zeros((len(rows) + 1, rows.shape[1]), np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows), 1):
        above = out[y - 1]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            padded = np.zeros(-(-len(row) // apart) * apart, np.uint8)
            padded[: len(row)] = row
            out[y] = np.cumsum(padded.reshape(-1, apart), axis=0, dtype=np.uint8).ravel()[: len(row)]
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            line, up, made = row.tolist(), above.tolist(), []
            for x, value in enumerate(line):
                left = made[x - apart] if x >= apart else 0
                if kind == 3:
                    guess = (left + up[x]) >> 1
                else:
                    corner = up[x - apart] if x >= apart else 0
                    to_left, to_up, to_corner = abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)
                    guess = left if to_left <= to_up and to_left <= to_corner else up[x] if to_up <= to_corner else corner
                made.append((value + guess) & 255)
            out[y] = made
        else:
            raise ImageError(f"the image has a row of an unknown kind, {kind}")
    return out[1:]


def _unfiltered_alike(raw: np.ndarray, apart: int) -> np.ndarray:
    """_unfiltered() of many images of one shape at once, image by row by byte: all go from pixel to pixel together."""
    n, height, length = raw.shape[0], raw.shape[1], raw.shape[2] - 1
    padded = -(-length // apart) * apart
    rows = np.zeros((n, height, padded), np.uint8)
    rows[:, :, :length] = raw[:, :, 1:]
    out = np.zeros((n, height + 1, padded), np.uint8)
    for y in range(height):
        kinds = raw[:, y, 0]
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            row, above = rows[own, y], out[own, y]
            if kind == 0:
                made = row
            elif kind == 1:
                made = np.cumsum(row.reshape(len(own), -1, apart), axis=1, dtype=np.uint8).reshape(len(own), -1)
            elif kind == 2:
                made = row + above
            elif kind in (3, 4):
                made, up = np.zeros(row.shape, np.uint8), above.astype(np.int16)
                left = corner = np.zeros((len(own), apart), np.int16)
                for x in range(0, padded, apart):
                    here = up[:, x : x + apart]
                    if kind == 3:
                        guess = (left + here) >> 1
                    else:
                        to_left, to_up, to_corner = np.abs(here - corner), np.abs(left - corner), np.abs(left + here - 2 * corner)
                        guess = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, here, corner))
                    made[:, x : x + apart] = row[:, x : x + apart] + guess.astype(np.uint8)
                    left, corner = made[:, x : x + apart].astype(np.int16), here
            else:
                raise ImageError(f"the image has a row of an unknown kind, {kind}")
            out[own, y + 1] = made
    return out[:, 1:, :length]


class Packed(NamedTuple):
    """A PNG image whose rows are unpacked but filtered, and its palette."""

    width: int
    height: int
    depth: int
    kind: int
    raw: bytes
    palette: bytes

    @property
    def apart(self) -> int:
        return max(1, SAMPLES[self.kind] * self.depth // 8)

    def rows(self) -> np.ndarray:
        return np.frombuffer(self.raw, np.uint8).reshape(self.height, -1)


def _unpacked(content: bytes) -> Packed:
    parts = _chunks(content)
    head = (parts.get(b"IHDR") or [b""])[0]
    if len(head) != 13:
        raise ImageError("the image has no header")
    width, height = int.from_bytes(head[:4]), int.from_bytes(head[4:8])
    depth, kind, interlaced = head[8], head[9], head[12]
    if kind not in SAMPLES or depth not in (1, 2, 4, 8, 16) or interlaced or not 0 < width * height <= MOST_PIXELS:
        raise ImageError(f"images of {width} by {height}, depth {depth}, colour type {kind}{', interlaced' * interlaced} are not read")
    length = (width * SAMPLES[kind] * depth + 7) // 8
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(parts.get(b"IDAT", [])), height * (length + 1))
    except zlib.error as e:
        raise ImageError(f"the image cannot be unpacked: {e}") from None
    if len(raw) != height * (length + 1):
        raise ImageError("the image has too few rows")
    return Packed(width, height, depth, kind, raw, (parts.get(b"PLTE") or [b""])[0])


def _image(p: Packed, rows: np.ndarray) -> np.ndarray:
    samples = SAMPLES[p.kind]
    if p.depth == 16:
        rows = rows[:, ::2]
    elif p.depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(p.height, -1, p.depth)
        rows = bits @ (1 << np.arange(p.depth - 1, -1, -1)).astype(np.uint8)
        rows = rows[:, : p.width * samples] * (1 if p.kind == 3 else 255 // ((1 << p.depth) - 1))
    image = rows.reshape(p.height, p.width, samples).astype(np.uint8)
    if p.kind == 3:
        palette = np.frombuffer(p.palette, np.uint8).reshape(-1, 3)
        if not len(palette) or image.max() >= len(palette):
            raise ImageError("the image's palette lacks a colour")
        image = palette[image[:, :, 0]]
    return image


def read_png(content: bytes) -> np.ndarray:
    """The image as height by width by samples of one byte; palettes become colours.  Interlaced images are an error."""
    p = _unpacked(content)
    return _image(p, _unfiltered(p.rows(), p.apart))


#: Small images are unfiltered together, so many at least and of so many bytes at most at once.
ALIKE, TOGETHER = 16, 1 << 22


def read_many(contents: Sequence[bytes | None]) -> Iterator[np.ndarray | ImageError | None]:
    """read_png() of each in turn, or the error that it raises; None for None.  Neighbours of one shape are read together."""

    def settled(held: list) -> Iterator:
        alike = defaultdict(list)
        for at, p in enumerate(held):
            if isinstance(p, Packed):
                alike[p[:4]].append(at)
        for own in alike.values():
            if len(own) >= ALIKE:
                try:
                    for at, rows in zip(own, _unfiltered_alike(np.stack([held[i].rows() for i in own]), held[own[0]].apart)):
                        held[at] = attempt(_image, held[at], rows)
                except ImageError:  # of one of them: each by itself tells which
                    pass
        for p in held:
            yield attempt(lambda p: _image(p, _unfiltered(p.rows(), p.apart)), p) if isinstance(p, Packed) else p

    def attempt(f, *given):
        try:
            return f(*given)
        except ImageError as e:
            return e

    held, size = [], 0
    for content in contents:
        held.append(None if content is None else attempt(_unpacked, content))
        size += len(held[-1].raw) if isinstance(held[-1], Packed) else 0
        if size >= TOGETHER:
            yield from settled(held)
            held, size = [], 0
    yield from settled(held)


def colours(image: np.ndarray) -> np.ndarray:
    """Three samples a pixel: greys as colours, without alpha."""
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def cropped(image: np.ndarray, crop: tuple[float, float, float, float] | None) -> np.ndarray:
    """The part at left, top of width, height, all as shares of the image; a pixel at least."""
    if crop is None:
        return image
    height, width = image.shape[:2]
    left, top = min(int(crop[0] * width), width - 1), min(int(crop[1] * height), height - 1)
    return image[top : top + max(1, int(crop[3] * height + 1e-9)), left : left + max(1, int(crop[2] * width + 1e-9))]


def resampled(image: np.ndarray, height: int, width: int, first: int = 0) -> np.ndarray:
    """The image on another raster: each new pixel is the mean of the area that it covers, parts of pixels in proportion.

    Along an axis, an area's sum is the difference of running sums at its two ends, which lie between pixels.
    first: the axis of the rows, 1 for a stack of images."""
    out = np.asarray(image, float)
    for axis, size in ((first, height), (first + 1, width)):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(np.take(out, [0], axis)), np.cumsum(out, axis=axis)], axis=axis)
        ends = np.arange(size + 1) * n / size
        whole = np.minimum(ends.astype(int), n)
        part = (ends - whole).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        at = np.take(sums, whole, axis) + part * np.take(out, np.minimum(whole, n - 1), axis)
        out = np.diff(at, axis=axis) * size / n
    return out


def decode(content: bytes, shape: tuple[int, int, int], crop: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """A PNG image's part on a raster of that shape, in colours from 0 to 255."""
    return resampled(colours(cropped(read_png(content), crop)), shape[0], shape[1])


def decode_many(contents: Sequence[bytes], shape: tuple[int, int, int], crop: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """decode() of each, as one array.  Images of one shape are resampled together, TOGETHER bytes of them at most."""
    out, alike = np.zeros((len(contents), *shape)), defaultdict(list)

    def settle(held):
        out[[at for at, _ in held]] = resampled(np.stack([image for _, image in held]), shape[0], shape[1], 1)
        held.clear()

    for at, image in enumerate(read_many(contents)):
        if isinstance(image, ImageError):
            raise image
        image = cropped(colours(image), crop)
        held = alike[image.shape]
        held.append((at, image))
        if len(held) * image.size >= TOGETHER:
            settle(held)
    for held in alike.values():
        if held:
            settle(held)
    return out


def area_table(image: np.ndarray) -> np.ndarray:
    """Sums over all rectangles at the upper left corner, so that any rectangle's sum takes four of them."""
    grey = image.mean(axis=2) if image.ndim == 3 else image
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    table[1:, 1:] = np.cumsum(np.cumsum(grey, axis=0, dtype=float), axis=1)
    return table


def box_means(table: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[float]:
    """The mean of each box (left, top, right, bottom), cut to the image; not a number if nothing of it is there."""
    height, width = table.shape[0] - 1, table.shape[1] - 1
    b = np.array(boxes, int).reshape(-1, 4)
    left, right = np.clip(b[:, 0], 0, width), np.clip(b[:, 2], 0, width)
    top, bottom = np.clip(b[:, 1], 0, height), np.clip(b[:, 3], 0, height)
    area = np.maximum(right - left, 0) * np.maximum(bottom - top, 0)
    total = table[bottom, right] - table[top, right] - table[bottom, left] + table[top, left]
    return np.where(area > 0, total / np.maximum(area, 1), np.nan).tolist()


def measured(content: Column, boxes: list[tuple[int, int, int, int]], read: Callable[[bytes], np.ndarray] = read_png) -> Column:
    """An image's size (width, height) and the mean of each box, in one reading; error says why there is none."""

    def one(image):
        if image is None:
            return None, None, None
        if isinstance(image, ImageError):
            return None, None, str(image)
        return [image.shape[1], image.shape[0]], box_means(area_table(image), boxes), None

    def attempt(body):
        try:
            return None if body is None else np.asarray(read(body))
        except ImageError as e:
            return e

    own = read is read_png

    @F.pandas_udf("struct<size: array<int>, means: array<double>, error: string>")
    def each(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(image) for image in (read_many(bodies) if own else map(attempt, bodies))], columns=["size", "means", "error"])

    return each(content)


#: Samples of the images that are compared at once.
COMPARED = 1 << 20


def difference(before: Column, after: Column, shape: tuple[int, int, int], crop=None) -> Column:
    """F20 of two columns of PNG images on a raster; as many pairs at once as their rasters allow."""
    from .frames import image_differences

    at_once = max(1, COMPARED // int(np.prod(shape)))

    @F.pandas_udf("double")
    def each(first: pd.Series, second: pd.Series) -> pd.Series:
        both = np.flatnonzero((first.notna() & second.notna()).to_numpy())
        out = pd.Series(np.full(len(first), np.nan), dtype="float64")
        for a in range(0, len(both), at_once):
            own = both[a : a + at_once]
            out.iloc[own] = image_differences(decode_many(first.iloc[own].tolist(), shape, crop), decode_many(second.iloc[own].tolist(), shape, crop))
        return out

    return each(before, after)
