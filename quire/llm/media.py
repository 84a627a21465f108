"""Media columns: AVI files of motion JPEG.

``encode_avi`` stores bytes losslessly: a byte is one 8x8 block of a grey baseline JPEG whose pixels all have that
value (the unit is the block's DC coefficient, quantised by 8), FRAME bytes make a frame of 16x12 blocks, and the
frames stand in a RIFF container with an ``idx1`` index. Any baseline decoder shows the same grey values. The Huffman
tables are chosen so that every block takes 16 bits and no byte is 0xFF, so frames have one size and both ways
are array operations. ``read_avi`` parses the RIFF chunks and the index, ``decode_frame`` decodes an intra frame (any
baseline JPEG: grey or colour with subsampling, restarts, the usual Huffman tables where a frame brings none), and ``shots`` cuts where
the difference between consecutive histograms of the brightness exceeds a threshold that adapts to its surroundings.

Null texts count as empty; an empty text is stored as FRAME blanks. Lone surrogates cannot occur in Spark strings.
Every input row gives one output row, rows with equal texts the same values. Null doc_ids are kept. Columns other than ``doc_id`` and
``text`` are ignored. A text's media take about three times its bytes of memory, one text at a time. An empty table gives an
empty one. A media file that can't be read gives one row with an error (``clip_rows``), and fails nothing else.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table

FRAME = 192  # payload bytes of a frame
COLUMNS, ROWS = 16, 12  # its blocks
FPS = 25
BINS = 16
WINDOW = 12  # frames on either side that set a cut's threshold
SPREAD = 3.0  # standard deviations over the mean difference
LEAST = 0.25  # no cut below this difference

# zigzag order of an 8x8 block, by rule: along the anti-diagonals, in turns upwards and downwards
_ZIGZAG = np.array([y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)])
_LENGTHS = [15 - c for c in range(9)]  # of the code of category c: with its c bits and the end-of-block bit 16 in all


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), of a DHT table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header() -> bytes:
    dc_counts = [sum(x == n for x in _LENGTHS) for n in range(1, 17)]
    dc = bytes([0x00, *dc_counts, *sorted(range(9), key=lambda c: _LENGTHS[c])])
    ac = bytes([0x10, 1, *[0] * 15, 0])
    return (
        b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([8] * 64)) + _segment(0xC0, struct.pack(">BHHB", 8, ROWS * 8, COLUMNS * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def _words() -> np.ndarray:
    """The 16 bits of each difference from -255 to 255."""
    counts = [sum(x == n for x in _LENGTHS) for n in range(1, 17)]
    codes = _codes(counts, sorted(range(9), key=lambda c: _LENGTHS[c]))
    out = []
    for d in range(-255, 256):
        c = abs(d).bit_length()
        out.append((codes[c][0] << c | (d if d > 0 else d + (1 << c) - 1)) << 1)
    return np.array(out, ">u2")


_HEADER, _WORDS = _frame_header(), _words()
_SIZE = len(_HEADER) + 2 * FRAME + 2
_SIZE += _SIZE % 2  # chunks are padded to even sizes; a JPEG may end in fill bytes


def encode_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of FRAME bytes."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    level = np.frombuffer(payload, np.uint8).reshape(n, FRAME).astype(np.int16) - 128
    level[:, 1:] -= level[:, :-1].copy()
    chunk = np.zeros((n, 8 + _SIZE), np.uint8)
    chunk[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _SIZE), np.uint8)
    at = 8 + len(_HEADER)
    chunk[:, 8:at] = np.frombuffer(_HEADER, np.uint8)
    chunk[:, at : at + 2 * FRAME] = _WORDS[level + 255].view(np.uint8)
    chunk[:, at + 2 * FRAME : at + 2 * FRAME + 2] = (0xFF, 0xD9)
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["offset"], index["size"] = b"00dc", 0x10, 4 + np.arange(n) * (8 + _SIZE), _SIZE
    width, height = COLUMNS * 8, ROWS * 8
    avih = struct.pack("<14I", 1_000_000 // FPS, _SIZE * FPS, 0, 0x10, n, 0, 1, _SIZE, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FPS, 0, n, _SIZE, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)

    def riff(name: bytes, *parts: bytes) -> bytes:
        return name + struct.pack("<I", sum(map(len, parts))) + b"".join(parts)

    strl = riff(b"LIST", b"strl", riff(b"strh", strh), riff(b"strf", strf))
    return riff(b"RIFF", b"AVI ", riff(b"LIST", b"hdrl", riff(b"avih", avih), strl), riff(b"LIST", b"movi", chunk.tobytes()), riff(b"idx1", index.tobytes()))


def read_avi(media: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Frames a second, and the offsets and sizes of the video frames by the file's index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, fps, movi, index = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), float(FPS), None, None
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"hdrl" and media[at + 12 : at + 16] == b"avih":
            fps = 1e6 / max(1, struct.unpack_from("<I", media, at + 20)[0])
        elif kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, [("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], size // 16, at + 8)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    index = index[index["id"] == b"00dc"]
    offsets = index["offset"].astype(np.int64)
    if len(index) and media[movi + offsets[0] : movi + offsets[0] + 4] == b"00dc":  # else offsets count from the file's start
        offsets = offsets + movi
    return fps, offsets + 8, index["size"].astype(np.int64)


# fixed values: the usual Huffman tables, as counts of codes by length and the symbols that come first; a table's other
# symbols (runs of 0 to 15 before sizes of 1 to 10) follow in their order
_USUAL = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    0x10: ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a"),
    0x11: ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def usual_symbols(table: int) -> list[int]:
    first = list(bytes.fromhex(_USUAL[table][1]))
    return first if table < 0x10 else first + sorted({r << 4 | n for r in range(16) for n in range(1, 11)} - set(first))


def _tables(header: bytes) -> dict:
    """What the marker segments up to the scan say. parts: (across, down, quantisation, DC table, AC table) of each component."""
    out: dict = {"dht": {k: _codes(counts, usual_symbols(k)) for k, (counts, _) in _USUAL.items()}, "dqt": {}, "every": 0}
    frame: dict = {}
    at = 2
    while at + 4 <= len(header):
        if header[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + size]
        if marker == 0xFF:  # a fill byte
            at += 1
            continue
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                out["dqt"][body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC0:
            out["height"], out["width"], parts = struct.unpack_from(">HHB", body, 1)
            frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(parts)}
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                out["dht"][body[0]] = _codes(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            out["every"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            seen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not frame or seen.keys() != frame.keys():
                raise ValueError("the scan does not hold the components of the frame")
            out["parts"] = [(*frame[c], out["dht"][seen[c] >> 4], out["dht"][0x10 | seen[c] & 15]) for c in seen]
            out["q"], out["dc"], out["ac"] = out["parts"][0][2:]
            return out
        elif marker in (0xC1, 0xC2, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        at += 2 + size
    raise ValueError("no scan")


def _fixed(t: dict) -> np.ndarray | None:
    """16 bits -> DC difference for tables under which every flat block takes 16 bits, 1 << 14 for other bits."""
    if 0 not in t["ac"]:
        return None
    end, n_end = t["ac"][0]
    out = np.full(1 << 16, 1 << 14, np.int16)
    for c, (code, n) in t["dc"].items():
        if n + c + n_end == 16:
            extra = np.arange(1 << c)
            out[((code << c | extra) << n_end) | end] = np.where(extra >> max(0, c - 1), extra, extra - (1 << c) + 1) if c else 0
    return out


@lru_cache(maxsize=16)
def _lookup(codes: tuple) -> list[tuple[int, int] | None]:
    """16 bits -> (symbol, length) of the code that they begin with."""
    out: list[tuple[int, int] | None] = [None] * (1 << 16)
    for s, (code, k) in codes:
        out[code << (16 - k) : (code + 1) << (16 - k)] = [(s, k)] * (1 << (16 - k))
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\x00" * 8, 0
        self.end = 8 * (len(self.data) - 8)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: list[tuple[int, int] | None]) -> int:
        found = table[self.peek()]
        if found is None or self.at > self.end:
            raise ValueError("bad Huffman code")
        self.at += found[1]
        return found[0]

    def number(self, k: int) -> int:
        if not k:
            return 0
        x = self.peek() >> (16 - k)
        self.at += k
        return x if x >> (k - 1) else x - (1 << k) + 1


_BASIS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


def decode_frame(jpeg: bytes) -> list[np.ndarray]:
    """The planes (height, width; uint8) of a baseline JPEG's components, each in its own resolution."""
    scan = _scan_start(jpeg)
    t = _tables(jpeg[:scan])
    end = jpeg.rfind(b"\xff\xd9")
    pieces = re.split(rb"\xff[\xd0-\xd7]", jpeg[scan : end if end > 0 else len(jpeg)])
    single = len(t["parts"]) == 1
    parts = [(1, 1, *p[2:]) for p in t["parts"]] if single else t["parts"]
    across, down = max(p[0] for p in parts), max(p[1] for p in parts)
    wide, high = -(-t["width"] // (8 * across)), -(-t["height"] // (8 * down))
    out = [np.zeros((high * p[1], wide * p[0], 64), np.int64) for p in parts]
    tables = [tuple(_lookup(tuple(sorted(x.items()))) for x in p[3:]) for p in parts]
    every, bits, last = t["every"] or wide * high, None, []
    for unit in range(wide * high):
        if unit % every == 0:
            if unit // every >= len(pieces):
                raise ValueError("a restart is missing")
            bits, last = _Bits(pieces[unit // every]), [0] * len(parts)
        y, x = divmod(unit, wide)
        for i, p in enumerate(parts):
            dc, ac = tables[i]
            for v in range(p[1]):
                for h in range(p[0]):
                    block = out[i][y * p[1] + v, x * p[0] + h]
                    last[i] += bits.number(bits.symbol(dc))
                    block[0], k = last[i], 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s != 0xF0:
                            if k > 63:
                                raise ValueError("too many coefficients")
                            block[k] = bits.number(s & 15)
                        k += 1
    planes = []
    for p, blocks in zip(parts, out, strict=True):
        coefficients = np.zeros(blocks.shape)
        coefficients[..., _ZIGZAG] = blocks * t["dqt"][p[2]]
        pixels = _BASIS @ coefficients.reshape(*blocks.shape[:2], 8, 8) @ _BASIS.T
        plane = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], -1)
        planes.append(plane[: -(-t["height"] * p[1] // down), : -(-t["width"] * p[0] // across)])
    return planes


def decode_frames(media: bytes, offsets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray] | np.ndarray:
    """Per frame the samples of the brightness: (frames, blocks) if all blocks are flat, else a plane for each frame.

    Flat frames with one header and 16-bit blocks are decoded together.
    """
    whole = np.frombuffer(media, np.uint8)
    if len(sizes) and (sizes == sizes[0]).all() and offsets.max() + sizes[0] <= len(whole):
        frames = whole[offsets[:, None] + np.arange(sizes[0])] if (np.diff(offsets) != sizes[0] + 8).any() else np.lib.stride_tricks.as_strided(whole[offsets[0] :], (len(offsets), sizes[0]), (int(sizes[0]) + 8, 1), writeable=False)
        first = frames[0].tobytes()
        scan = _scan_start(first)
        t = _tables(first[:scan])
        n = -(-t["width"] // 8) * -(-t["height"] // 8)
        fixed = _fixed(t) if len(t["parts"]) == 1 and not t["every"] else None
        body = frames[:, scan : scan + 2 * n]
        if fixed is not None and body.shape[1] == 2 * n and (frames[:, :scan] == frames[0, :scan]).all() and not (body == 0xFF).any():
            steps = fixed[np.ascontiguousarray(body).view(">u2")]
            if (steps != 1 << 14).all():
                level = np.cumsum(steps, axis=1, dtype=np.int32) * int(t["dqt"][t["q"]][0])
                return np.clip(level // 8 + 128, 0, 255).astype(np.uint8)
    return [decode_frame(media[o : o + size])[0] for o, size in zip(offsets.tolist(), sizes.tolist(), strict=True)]


def _scan_start(jpeg: bytes) -> int:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at + 1] == 0xFF:
            at += 1
            continue
        size = 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
        if jpeg[at + 1] == 0xDA:
            return at + size
        at += size
    raise ValueError("no scan")


def histograms(frames: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """The shares of the BINS brightnesses in each frame."""
    if isinstance(frames, list):
        return np.array([np.bincount(f.ravel() >> 4, minlength=BINS) / max(1, f.size) for f in frames]).reshape(-1, BINS)
    n = len(frames)
    return np.bincount((np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / frames[0].size


def shots(frames: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """First frames of the shots.

    The difference of two histograms is the share of samples that change bins. A cut is a difference of LEAST at least,
    a local maximum, and over the mean of its WINDOW neighbours on either side by SPREAD standard deviations.
    """
    n = len(frames)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    d = np.abs(np.diff(histograms(frames), axis=0)).sum(1) / 2
    if d.max() < LEAST:
        return np.zeros(1, np.int64)
    total, square = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    low, high = np.maximum(np.arange(n - 1) - WINDOW, 0), np.minimum(np.arange(n - 1) + WINDOW + 1, n - 1)
    many = high - low - 1
    mean = (total[high] - total[low] - d) / np.maximum(many, 1)
    spread = np.sqrt(np.maximum((square[high] - square[low] - d * d) / np.maximum(many, 1) - mean * mean, 0))
    peak = (d >= np.r_[0, d[:-1]]) & (d > np.r_[d[1:], 0])
    return np.r_[0, np.flatnonzero(peak & (d >= LEAST) & (d > mean + SPREAD * spread)) + 1]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, media (the AVI file as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([encode_avi(payload_of(t)[1]) for t in part.column("text").to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, media binary")


CLIPS = "doc_id long, clip int, start_s double, end_s double, frames long, mean_level double, error string"


def clips_of(media: bytes) -> list[tuple]:
    """clip, start_s, end_s, frames, mean_level of each shot of a file."""
    fps, offsets, sizes = read_avi(media)
    frames = decode_frames(media, offsets, sizes)
    cuts = shots(frames).tolist()
    return [(k, a / fps, z / fps, z - a, float(np.mean([f.mean() for f in frames[a:z]]))) for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(frames)], strict=False))]


def clip_rows(media: DataFrame) -> DataFrame:
    """CLIPS: a row for each shot of each media file; none for null media and files without frames; for a file that
    can't be read one row with the error and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "clip", "start_s", "end_s", "frames", "mean_level", "error"], [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
        for b in batches:
            rows = []
            for doc, m in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                try:
                    rows += [(doc, *c, None) for c in (clips_of(m.as_py()) if m.is_valid else [])]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((doc, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(run, CLIPS)


def digest(text: str | None) -> tuple:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of one text, the payload
    and the feature from the stored bytes."""
    n, payload = payload_of(text)
    media = encode_avi(payload)
    _, offsets, sizes = read_avi(media)
    frames = decode_frames(media, offsets, sizes)
    back = frames.tobytes()
    cuts = shots(frames)
    feature = f"frames={len(frames)};shots={len(cuts)};starts={','.join(map(str, cuts.tolist()))};mean={frames.mean():.3f};sd={frames.std():.3f}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(digest(t.as_py()) for t in b.column("text")), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
