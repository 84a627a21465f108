import numpy as np
import pyarrow as pa

from quire.operators import layout as L
from quire.sinks import images


def java_png(spark, pixels, kind):
    """A PNG by another encoder. kind: 1 color, 2 color and opacity, 10 grey."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], kind)
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "png", out)
    return bytes(out.toByteArray())


def test_png_of_another_encoder(spark):
    y, x = np.mgrid[0:20, 0:31]
    pixels = np.stack([x * 8, y * 12, (x * y) % 256], axis=-1).astype(np.uint8)
    for kind in (1, 2):
        assert (images.read_png(java_png(spark, pixels, kind)) == pixels).all()
    grey = np.repeat(((x + y) * 4).astype(np.uint8)[..., None], 3, axis=-1)
    assert (images.read_png(images.write_png(grey)) == grey).all()
    jvm = spark._jvm
    seen = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(images.write_png(pixels)))
    assert all(seen.getRGB(a, b) & 0xFFFFFF == int(pixels[b, a, 0]) << 16 | int(pixels[b, a, 1]) << 8 | int(pixels[b, a, 2]) for a, b in ((0, 0), (30, 19), (7, 11)))


def test_all_line_filters():
    """The five ways in which a line may be stored, by the rules they are defined by."""
    import struct
    import zlib

    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (10, 7, 3)).astype(np.int64)
    lines = b""
    for y in range(10):
        kind, line = y % 5, []
        for x in range(7):
            for c in range(3):
                a = pixels[y, x - 1, c] if x else 0
                b = pixels[y - 1, x, c] if y else 0
                d = pixels[y - 1, x - 1, c] if x and y else 0
                guess = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
                line.append(int(pixels[y, x, c] - (0, a, b, (a + b) // 2, guess)[kind]) % 256)
        lines += bytes([kind, *line])
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + b"0000"
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines))
    assert (images.read_png(data) == pixels).all()


def test_boxed_pages(spark):
    white = images.write_png(np.full((120, 160, 3), 255, np.uint8))
    pages = spark.createDataFrame([("a", 1, white), ("a", 2, white), ("b", 1, b"broken"), ("b", 2, None)], "doc_id string, page_num int, png binary")
    rows = [("a", 1, 12, "#ff0000", 20.0, 20.0, 60.0, 40.0), ("a", 1, 12, "#ff0000", 20.0, 45.0, 60.0, 55.0), ("b", 1, 1, "#00ff00", 0.0, 0.0, 9.0, 9.0), ("b", 2, 1, "#00ff00", 0.0, 0.0, 9.0, 9.0), ("a", 1, 3, "#0000ff", 500.0, 500.0, 600.0, 600.0)]
    boxes = spark.createDataFrame(rows, "doc_id string, page_num int, number int, color string, x0 double, y0 double, x1 double, y1 double")
    got = images.boxed_pages(pages, boxes).collect()
    assert [(r.doc_id, r.page_num) for r in got] == [("a", 1)]
    p = images.read_png(bytes(got[0].png))
    assert tuple(p[70, 38]) == (255, 0, 0) and tuple(p[65, 100]) == (255, 227, 227) and tuple(p[5, 5]) == (255, 255, 255)
    assert (p[25:45, 36:60] == 255).all(-1).any()  # the number's digits


def test_figure_boxes_reach_up(spark):
    words = [(float(10 * i), 300.0, 10.0 * i + 8, 310.0, f"w{i}") for i in range(8)]
    pages = spark.createDataFrame([("a", 1, words)], "doc_id string, page_num int, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    chunks = spark.createDataFrame([("a", 0, 1, None, " ".join(w[4] for w in words), None, "figure")], "doc_id string, seq int, page_start int, page_end int, chunk_text string, table_markdown string, content_type string")
    blocks = spark.createDataFrame([("a", 1, 0.0, 100.0, 80.0, "eight words of prose stand over the figure"), ("a", 1, 0.0, 100.0, 200.0, "a label")], "doc_id string, page_num int, x0 double, x1 double, y1 double, text string")
    got = L.find_matching_pages(chunks, pages, blocks=blocks).first()
    assert got.page_num == 1 and [tuple(b) for b in got.boxes] == [(0.0, 84.0, 78.0, 310.0)]
    assert [tuple(b) for b in L.find_matching_pages(chunks, pages, blocks=blocks.limit(0)).first().boxes] == [(0.0, 40.0, 78.0, 310.0)]


def test_few_images_are_held_at_once(spark, monkeypatch):
    """However many rows a batch has, what is drawn on is handed on after a few images."""
    white = images.write_png(np.full((12, 16, 3), 255, np.uint8))
    frames = {n: spark.createDataFrame([], t) for n, t in (("pages", "doc_id long, page_num int, png binary"), ("boxes", "doc_id long, page_num int, number int, color string, x0 double, y0 double, x1 double, y1 double"))}
    got = []
    monkeypatch.setattr(type(frames["pages"]), "mapInArrow", lambda self, f, schema: got.append(f))
    images.boxed_pages(**frames)
    box = [{"number": 1, "x0": 1.0, "y0": 1.0, "x1": 5.0, "y1": 5.0, "color": "#ff0000"}]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "page_num": 1, "png": b"broken" if i % 7 == 0 else white, "boxes": box} for i in range(100)])
    out = [b.column("doc_id").to_pylist() for b in got[0]([batch])]
    assert sum(out, []) == [i for i in range(100) if i % 7] and max(map(len, out)) <= images.AT_ONCE
