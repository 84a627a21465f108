"""Substring dedup: sliding sentence spans.

A sentence ends after a word that ends in a stop mark, and at a line end. From every sentence a span runs over RUN
consecutive sentences, however short; a text that holds no such run is one span as a whole. So that a passage that begins or ends inside a sentence, or has
no stops at all, holds spans as well, long sentences are also cut into clauses: where WINDOW words in a row have no
sentence end, a clause ends after the word of the least hash among them (the last of equal ones), for each window of so
many words. A cut depends on fewer than WINDOW words to either side of its word. From every clause a second kind of span
runs over at least RUN clauses until it holds WORDS words. Letters of scripts without blanks (Chinese, Japanese,
Thai, ...) count as a word each.

Spans are hashed (words in lower case), and all equal spans of the corpus meet in one aggregation. Of equal spans the
first stays, in the order of doc_id and, inside a document, of place, and every word that another one covers goes. So
equal texts of any length go but for the first, and a passage of over 50 words holds whole spans wherever it stands, if its lines
break at the same words: cuts that lie WINDOW - 1 words or more inside it are the same in all copies, the first of them
follows its word 2 * WINDOW - 1 or an earlier one, and the span from there ends within WORDS + WINDOW - 1 (or RUN * WINDOW) words.

Null texts stay null, texts without repeats stay as they are, and a text that goes entirely becomes empty (the row
stays). Rows with one doc_id count as one document: what repeats only between them stays. Rows without doc_id are
documents each, before all others (among each other in the order in which they are read). Other columns are kept, but for one that
has the name of the result ``removed_words``. An empty table gives an empty one. Hot spans are summed before the
shuffle, and their occurrences meet the repeated spans in a join that Spark splits where it is skewed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, quoted, table, without, written

RUN = 3
WORDS = 20  # of a run of clauses at least
WINDOW = 10
PIECE = 1 << 20  # bytes of a text that are read at once
# fixed values: Thai, Lao, Myanmar, Khmer, kana, Han
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_WIDE = re.compile(r"[^\S\x00-\x7f]")  # white space that is not ASCII
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so its powers can be divided by modulo 2 ** 64
_BACK = pow(_MULTIPLIER, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLE = 1 << 14  # powers that are kept; those of longer texts are made anew


def _of(base: int):
    kept = _powers(base, _TABLE)
    return lambda n: kept[:n] if n <= _TABLE else _powers(base, n)


_ahead, _back = _of(_MULTIPLIER), _of(_BACK)
_PLACES = _powers(0x100000001B3, 4096)  # of a byte in its word; longer words use them again
# fixed values: the stop marks that end a sentence, as the last three bytes of a word (one byte, or all three)
_STOP_BYTES, _STOP_MARKS = b".!?", ("。", "！", "？")


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in parts of about PIECE bytes that end at line ends or blanks, or else where a word ends."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = max(data.rfind(b"\n", at, end), data.rfind(b" ", at, end))
            if cut < 0:
                found = re.compile(rb"[\x09-\x0d\x1c-\x20]").search(data, end)
                cut = found.start() if found else len(data)
            end = cut + 1
        yield data[at:end]
        at = end


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and the number of words before the end of each sentence. A line end stands in front of a piece's
    next word, so it is a line's wherever pieces are cut."""
    low = text.lower()
    if not low.isascii():
        low = _WIDE.sub(" ", low)
        if _HAS_UNSPACED.search(low):
            low = _HAS_UNSPACED.sub(r" \g<0> ", low)
    keys, ends, words = [], [], 0
    for piece in _pieces(low.encode("utf-8", "surrogatepass")):
        data = np.frombuffer(piece, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[data], prepend=True, append=True))
        starts, stops = edges[::2], edges[1::2]
        lines = np.searchsorted(starts, np.flatnonzero(data == 10))
        ends.append(lines + words)
        if not len(starts):
            continue
        letters = np.add(data, 1, dtype=np.uint64)
        letters[_BLANK[data]] = 0
        first = np.zeros(len(data), np.int64)
        first[starts] = starts
        place = np.arange(len(data)) - np.maximum.accumulate(first)
        letters *= _PLACES[place & 4095]
        h = np.add.reduceat(letters, starts)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        keys.append(h ^ h >> np.uint64(32))
        last = np.isin(data[stops - 1], np.frombuffer(_STOP_BYTES, np.uint8))
        for mark in _STOP_MARKS if b"\xe3\x80\x82" in piece or b"\xef\xbc" in piece else ():
            m = np.frombuffer(mark.encode(), np.uint8)
            last |= (stops - starts >= 3) & (data[stops - 1] == m[2]) & (data[stops - 2] == m[1]) & (data[stops - 3] == m[0])
        ends.append(np.flatnonzero(last) + 1 + words)
        words += len(starts)
    all_ends = np.unique(np.concatenate([*ends, [words]]))
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)), all_ends[all_ends > 0].astype(np.int64)


def clauses(keys: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """``ends`` and the cuts inside long sentences."""
    if len(keys) < window:
        return ends
    last = np.zeros(len(keys) + 1, np.int64)
    last[ends] = 1  # of the words that end a sentence
    ended = np.cumsum(last)
    free = np.flatnonzero(ended[window:] == ended[:-window])
    if not len(free):
        return ends
    # the least hash of each window, the last of equal ones
    back = np.lib.stride_tricks.sliding_window_view(keys, window)[free][:, ::-1]
    return np.union1d(ends, free + window - np.argmin(back, axis=1))


def spans(keys: np.ndarray, ends: np.ndarray, run: int = RUN, least: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, word after the last) of every span, in the order of their first words."""
    found = []
    for bounds, words in ((ends, 0), (clauses(keys, ends), least)):
        starts = np.concatenate([[0], bounds[:-1]]).astype(np.int64) if len(bounds) else np.zeros(0, np.int64)
        at = np.maximum(np.arange(len(starts)) + run - 1, np.searchsorted(bounds, starts + words))
        whole = at < len(bounds)
        found.append(starts[whole] << 32 | bounds[at[whole]])
    if len(ends) and not sum(map(len, found)):
        found.append(ends[-1:])
    both = np.unique(np.concatenate(found))
    first, last = both >> 32, both & 0xFFFFFFFF
    # modulo 2 ** 64; long texts in parts would need no less memory than this
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * _ahead(len(keys)), dtype=np.uint64)])
    hashes = (sums[last] - sums[first]) * _back(len(keys) + 1)[first]
    hashes ^= (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return hashes.view(np.int64), first, last


def without_repeats(text: str, foreign: np.ndarray, run: int = RUN, least: int = WORDS) -> tuple[str, int]:
    """The text without the words of the spans in ``foreign`` and of those that stood before in this text; and how
    many words went. A span that overlaps its first place goes from that place's end on."""
    keys, ends = sentences(text)
    hashes, first, last = spans(keys, ends, run, least)
    _, place, which = np.unique(hashes, return_index=True, return_inverse=True)
    earlier, mine = place[which], ~np.isin(hashes, foreign)
    gone = np.zeros(len(keys) + 1, np.int64)
    for i in np.flatnonzero(~mine | (earlier < np.arange(len(hashes)))).tolist():
        a = min(last[i], max(first[i], last[earlier[i]])) if mine[i] else first[i]
        gone[a] += 1
        gone[last[i]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if not gone.any():
        return text, 0
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[z][0] if z < len(places) else len(text)
    return "".join([*out, text[at:]]), int(gone.sum())


def dedup_spans(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """The rows and columns of ``docs`` with repeated spans cut from ``text``, and ``removed_words``."""
    docs = without(docs, "removed_words")
    owner, mine, cut_ = fresh(docs, "owner_", "mine_", "foreign_")
    # rows without doc_id get a number of their own, which must not change while it is used
    nameless = written(docs.where("doc_id is null").withColumn(owner, F.monotonically_increasing_id() + F.lit(-(1 << 63))))
    docs_ = docs.where("doc_id is not null").withColumn(owner, F.col("doc_id").cast("long")).unionByName(nameless)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                hashes, owners, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for doc, text in zip(b.column("d").slice(at, 128).to_pylist(), b.column("text").slice(at, 128).to_pylist(), strict=True):
                    h, n = np.unique(spans(*sentences(text or ""), run, words)[0], return_counts=True)
                    hashes.append(h)
                    owners.append(np.full(len(h), doc, np.int64))
                    again.append(n > 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, owners, again)], ["h", "d", "again"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            new, counts = [], []
            for text, foreign in zip(b.column("text"), b.column(cut_), strict=True):
                t, n = (text.as_py(), 0) if not foreign.is_valid or not text.as_py() else without_repeats(text.as_py(), foreign.values.to_numpy(zero_copy_only=False), run, words)
                new.append(t)
                counts.append(n)
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)][:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*b.schema.names[:-1], "removed_words"])

    found = written(docs_.select(F.col(owner).alias("d"), "text").mapInArrow(find, "h long, d long, again boolean"))
    repeated = found.groupBy("h").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last").select("h", "first")
    later = found.select("h", "d").join(repeated, "h").where("d <> first").select("d", "h")
    inside = found.where("again").select("d", F.lit(None).cast("long").alias("h")).distinct()
    foreign = later.unionByName(inside).groupBy(F.col("d").alias(mine)).agg(F.collect_set("h").alias(cut_))
    joined = docs_.join(foreign, F.col(owner) == F.col(mine), "left").select(*(quoted(c) for c in docs.columns), cut_)
    return joined.mapInArrow(cut, ", ".join(f"{quoted(c)} {t}" for c, t in docs.dtypes) + ", removed_words int")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, removed_words, kept_chars and the text that is left, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))
    return dedup_spans(docs).select("doc_id", "n_chars", "removed_words", F.char_length("text").cast("long").alias("kept_chars"), "text")
