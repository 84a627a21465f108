"""Page images with the boxes of their chunks. PNG is read and written with zlib and arrays, so no imaging library is needed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # of the kinds of pixels: grey, color, grey and opacity, color and opacity
FILL, EDGE, PAD, BADGE = 28 / 255, 3, 4, 11  # opacity of a box, its line, its margin, and the radius of its number, in pixels
AT_ONCE = 16  # images that a task holds with what is drawn on them
# fixed values: the digits in rows of three pixels
_DIGITS = {
    "0": (7, 5, 5, 5, 7), "1": (2, 6, 2, 2, 7), "2": (7, 1, 7, 4, 7), "3": (7, 1, 7, 1, 7), "4": (5, 5, 7, 1, 1),
    "5": (7, 4, 7, 1, 7), "6": (7, 4, 7, 5, 7), "7": (7, 1, 1, 1, 1), "8": (7, 5, 7, 5, 7), "9": (7, 5, 7, 1, 7),
}


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG with 8 bits a sample and without interlacing; opacity is laid over white."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only PNGs of 8 bits without palette or interlacing can be read")
    width, height, step = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height + 1, width + 1, step), np.int64)  # a row above and a column to the left of the image
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].reshape(width, step).astype(np.int64)
        above, new = out[y, 1:], out[y + 1, 1:]
        if kind == 0:
            new[:] = line
        elif kind == 1:
            new[:] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            new[:] = line + above & 255
        else:  # what these take from the left is known only pixel by pixel
            for x in range(width):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                new[x] = line[x] + guess & 255
    pixels = out[1:, 1:].astype(float)
    if step in (2, 4):
        share = pixels[..., -1:] / 255
        pixels = pixels[..., :-1] * share + 255 * (1 - share)
    return np.rint(np.broadcast_to(pixels, (height, width, 3))).astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """A color PNG of (height, width, 3)."""
    height, width = pixels.shape[:2]
    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def _badge(pixels: np.ndarray, x: float, y: float, number: int, color: np.ndarray) -> None:
    height, width = pixels.shape[:2]
    yy, xx = np.mgrid[0:height, 0:width]
    pixels[(xx - x) ** 2 + (yy - y) ** 2 <= BADGE**2] = color
    text = str(number)
    left, top = round(x - (8 * len(text) - 2) / 2), round(y - 5)
    for k, digit in enumerate(text):
        for r, bits in enumerate(_DIGITS[digit]):
            for c in range(3):
                if bits >> (2 - c) & 1:
                    pixels[max(0, top + 2 * r) : max(0, top + 2 * r + 2), max(0, left + 8 * k + 2 * c) : max(0, left + 8 * k + 2 * c + 2)] = 255


def boxed(pixels: np.ndarray, boxes: list[tuple], zoom: float) -> np.ndarray:
    """The page with its boxes (x0, y0, x1, y1, number, color as rrggbb with #): each filled and outlined in its color, the first of a
    number with the number."""
    out, seen = pixels.astype(float), set()
    height, width = pixels.shape[:2]
    for x0, y0, x1, y1, number, color in boxes:
        rgb = np.array([int(color[i : i + 2], 16) for i in (1, 3, 5)], float)
        left, top = (max(0, round(v * zoom) - PAD) for v in (x0, y0))
        right, bottom = min(width, round(x1 * zoom) + PAD), min(height, round(y1 * zoom) + PAD)
        if left >= right or top >= bottom:
            continue
        part = out[top:bottom, left:right]
        part[:] = part * (1 - FILL) + rgb * FILL
        for edge in (part[:EDGE], part[-EDGE:], part[:, :EDGE], part[:, -EDGE:]):
            edge[:] = rgb
        if number not in seen:
            seen.add(number)
            _badge(out, left + BADGE, top - 2, number, rgb)
    return np.rint(out).astype(np.uint8)


def boxed_pages(pages: DataFrame, boxes: DataFrame, zoom: float = 2.0, key: str = "doc_id") -> DataFrame:
    """key, page_num, png: the images of ``pages`` (key, page_num, png) that hold boxes, drawn on. boxes: key, page_num, number,
    color, x0, y0, x1, y1 in the page's units. Null or unreadable images are left out."""
    from pyspark.sql import functions as F

    box = F.struct("number", "y0", "x0", "x1", "y1", "color")
    held = boxes.groupBy(key, "page_num").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):  # a few images at a time, however many a batch holds
                part, kept, drawn = b.slice(at, AT_ONCE), [], []
                for i in range(part.num_rows):
                    try:
                        boxes = [(x["x0"], x["y0"], x["x1"], x["y1"], int(x["number"]), x["color"]) for x in part.column("boxes")[i].as_py()]
                        drawn.append(write_png(boxed(read_png(part.column("png")[i].as_py()), boxes, zoom)))
                    except (ValueError, TypeError, struct.error, zlib.error):
                        continue
                    kept.append(i)
                of = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key).take(of), part.column("page_num").take(of), pa.array(drawn, pa.binary())], [key, "page_num", "png"])

    return pages.select(key, "page_num", "png").join(held, [key, "page_num"]).select(key, F.col("page_num").cast("int").alias("page_num"), "png", "boxes").mapInArrow(run, f"`{key}` {kind}, page_num int, png binary")
