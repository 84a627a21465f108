"""Alignment of two tokenizers over a corpus by a dictionary of groups.

Where tokens of both end at one byte, the text is cut; what lies between two cuts is a group of A ids and B ids. A group's
tokens tell its bytes, so they tell its links too: the pairs of tokens whose bytes overlap. Texts consist of few different
groups. So groups are interned: workers give out every document as numbers of different groups with how often each occurs,
and each group's key once a task. Links are expanded once for each different group. A pair of ids is held by as many
documents as hold its groups, taken together, less what is counted twice where a document holds several of its groups,
which the document itself tells. What a group then adds to a document joins the documents back by the group's number.

A text is tokenized by its stretches: it is cut before a blank, or a line end, that stands alone between two characters
that are none. No token of either tokenizer reaches over such a place (``split_safely`` tests their vocabularies),
so ids are those of the whole text, and a worker tokenizes each different stretch once.

Null and empty texts, and those whose tokens do not join to a blank and the text, have no tokens: zeros and ''. Rows are
documents, each, also with one ``doc_id`` or without; equal rows get equal results. Very long texts are read whole. An empty
table gives an empty one. Columns beside ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import skewed_join, table, written

CACHED = 400_000  # stretches, and groups, that a worker remembers, about
TOGETHER = 8192  # stretches that are tokenized as one text
ROWS = 256  # documents that are read together
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_BLANK, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")
_BAD = -1

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<struct<gid: long, n: long>>, more array<struct<a: int, b: int, more: long>>, new array<string>"


class _Bytes:
    """The bytes of ids, for arrays of them."""

    def __init__(self, known: list[bytes]):
        self.size = np.array([len(x) for x in known])
        self.starts, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(known), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.flat[np.repeat(self.starts[ids] - before, size) + np.arange(size.sum())]


class Pair:
    """Two tokenizers: ids of stretches, and bytes of ids."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives every task its core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        byte_of = _bytes_of_letters()
        self.bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in byte_of for c in t)}
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_BLANK, " ").encode() for p in self.pieces]

        self.table_a, self.table_b = _Bytes([self.bytes_a.get(i, b"") for i in range(max(self.bytes_a) + 1)]), _Bytes(self.bytes_b)

    def split_safely(self) -> bool:
        """No piece holds a blank after another character, or a line end beside others: so no piece reaches over a cut.
        (A's pattern starts a token at each cut.)"""
        return not any(re.search(f"[^{_BLANK}]{_BLANK}|\n", p) for p in self.pieces)

    def ids(self, stretches: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Each starts with a blank, which B adds by itself, or with a line end, before which B adds a blank that goes."""
        of_a = self.a.encode_batch_fast(stretches, add_special_tokens=False)
        of_b = self.b.encode([s[s[0] == " " :] for s in stretches], num_threads=1)
        return ((x.ids, y if s[0] == " " else y[1:]) for s, x, y in zip(stretches, of_a, of_b, strict=True))


def _bytes_of_letters() -> dict[str, int]:
    """The bytes that the letters of byte-level vocabularies stand for: printing ones themselves, the others by number."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def cut_groups(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[str]:
    """Keys of the groups: `a1,a2|b1`. Both have the same number of bytes."""
    out, i, j, at, to = [], 0, 0, 0, 0  # at, to: bytes of the tokens before i, before j
    while i < len(a):
        x, y, at, to = i + 1, j + 1, at + size_a[i], to + size_b[j]
        while at != to:
            if at < to:
                at, x = at + size_a[x], x + 1
            else:
                to, y = to + size_b[y], y + 1
        out.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
        i, j = x, y
    return out


def links(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs of tokens of a group whose bytes overlap: one more each time that one of the two ends."""
    i = j = at = to = 0
    while i < len(a) and j < len(b):
        yield a[i], b[j]
        left, right = at + size_a[i], to + size_b[j]
        if left <= right:
            i, at = i + 1, left
        if right <= left:
            j, to = j + 1, right


class Groups:
    """What a worker knows: stretches by number, with their groups; groups by number, with their pairs of ids."""

    def __init__(self, a: str, b: str):
        self.pair = Pair(a, b)
        if not self.pair.split_safely():
            raise ValueError("a piece reaches over the places at which texts are cut")
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}  # of stretches that start with a single blank, by what follows it
        self.whole: dict[str, int] = {}  # of all others
        self.odd: set[str] = set()  # what stands between blanks and is no stretch
        self.text: list[str] = []
        self.n_a, self.n_b, self.n_groups = array("q"), array("q"), array("q")
        self.flat, self.ends = array("q"), array("q", [0])
        self.group: dict[str, int] = {}
        self.packed: dict[tuple[int, int], int] = {}
        self.keys: list[str] = []
        self.gids, self.pairs, self.pair_ends = array("q"), array("q"), array("q", [0])

    def full(self) -> bool:
        return max(len(self.text), len(self.keys), len(self.odd)) > CACHED

    def _group(self, key: str) -> int:
        g = self.group.get(key)
        if g is None:
            g = self.group[key] = len(self.keys)
            self.keys.append(key)
            self.gids.append(xxhash.xxh64_intdigest(key, 42) - (1 << 64) * (xxhash.xxh64_intdigest(key, 42) >> 63))
            self.pairs.extend(sorted({x << 32 | y for x, y in self.links_of(key)}))
            self.pair_ends.append(len(self.pairs))
        return g

    def links_of(self, key: str) -> Iterator[tuple[int, int]]:
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        return links(a, b, [len(self.pair.bytes_a[x]) for x in a], [len(self.pair.bytes_b[x]) for x in b])

    def _add(self, code: dict[str, int], name: str, groups: list[int], n_a: int, n_b: int) -> None:
        code[name] = len(self.text)
        self.text.append(";".join([self.keys[g] for g in groups]))
        for held, n in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, len(groups))):
            held.append(n)
        self.flat.extend(groups)
        self.ends.append(len(self.flat))

    def _one(self, code: dict[str, int], name: str, stretch: str) -> None:
        """A stretch by itself."""
        a, b = next(self.pair.ids([stretch]))
        whole = stretch.encode("utf-8", "surrogatepass")
        of_a, of_b = [self.pair.bytes_a.get(x, b"") for x in a], [self.pair.bytes_b[x] for x in b]
        if b"".join(of_a) != whole or b"".join(of_b) != whole:
            code[name] = _BAD
        else:
            self._add(code, name, [self._group(k) for k in cut_groups(a, b, list(map(len, of_a)), list(map(len, of_b)))], len(a), len(b))

    def _many(self, names: list[str]) -> None:
        """Stretches of plain names, tokenized as one text, since all of them begin where texts are cut."""
        text = " " + " ".join(names)
        whole = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        a, b = (np.array(x, np.int64) for x in next(self.pair.ids([text])))
        if not (np.array_equal(self.pair.table_a.joined(a), whole) and np.array_equal(self.pair.table_b.joined(b), whole)):
            for n in names:
                self._one(self.code, n, " " + n)
            return
        to_a, to_b = np.cumsum(self.pair.table_a.size[a]), np.cumsum(self.pair.table_b.size[b])
        cuts = np.intersect1d(to_a, to_b, assume_unique=True)
        groups = self._numbers(a, b, np.searchsorted(to_a, cuts, "right"), np.searchsorted(to_b, cuts, "right"))
        ends = np.cumsum([len(n.encode("utf-8", "surrogatepass")) + 1 for n in names])
        n_a, n_b, n = (np.diff(np.searchsorted(to, ends, "right"), prepend=0).tolist() for to in (to_a, to_b, cuts))
        at = 0
        for k, name in enumerate(names):
            self._add(self.code, name, groups[at : at + n[k]], n_a[k], n_b[k])
            at += n[k]

    def _numbers(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[int]:
        """The groups of tokens that end before these places. Up to four ids of each side fit into a number, exactly."""
        from_a, from_b = np.append(0, to_a[:-1]), np.append(0, to_b[:-1])
        packed = []
        for ids, first, last in ((a, from_a, to_a), (b, from_b, to_b)):
            place = np.arange(len(ids)) - np.repeat(first, last - first)
            packed.append(np.add.reduceat(np.where(place < 4, (ids + 1).astype(np.uint64) << (16 * np.minimum(place, 3)).astype(np.uint64), 0), first))
        x, y = packed
        mixed = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) ^ y
        _, some, which = np.unique(mixed, return_index=True, return_inverse=True)
        large = (to_a - from_a > 4) | (to_b - from_b > 4)
        odd = large | (x != x[some][which]) | (y != y[some][which])

        def number(k: int) -> int:
            key = (int(x[k]), int(y[k]))
            if not large[k] and key in self.packed:
                return self.packed[key]
            side = lambda ids, first, last: ",".join(map(str, ids[first[k] : last[k]].tolist()))
            g = self._group(f"{side(a, from_a, to_a)}|{side(b, from_b, to_b)}")
            if not large[k]:
                self.packed[key] = g
            return g

        found = np.array([-1 if odd[k] else number(k) for k in some.tolist()])[which]
        for k in np.flatnonzero(odd | (found < 0)).tolist():
            found[k] = number(k)
        return found.tolist()

    def _codes(self, texts: list[str | None]) -> list[list[int]]:
        """The stretches of each text. Where blanks stand alone they part them; else a slower way cuts."""
        split = [t.split(" ") if t and _BLANK not in t else [] for t in texts]
        code = self.code
        new = {n for n in set().union(*split) if n not in code}
        self.odd |= {n for n in new if not _plain(n)}
        slow = {k: _CUT.split(" " + texts[k]) for k, names in enumerate(split) if self.odd and not self.odd.isdisjoint(names)}
        new |= {s[1:] for parts in slow.values() for s in parts if s[0] == " " and _plain(s[1:])}
        plain = [n for n in new if n not in self.odd and n not in self.code]
        for at in range(0, len(plain), TOGETHER):
            self._many(plain[at : at + TOGETHER])
        for s in {s for parts in slow.values() for s in parts if not (s[0] == " " and _plain(s[1:]))} - self.whole.keys():
            self._one(self.whole, s, s)
        return [[code[s[1:]] if s[0] == " " and _plain(s[1:]) else self.whole[s] for s in slow[k]] if k in slow else list(map(code.__getitem__, names)) for k, names in enumerate(split)]

    def batch(self, ids: list[int | None], texts: list[str | None], told: set[str]) -> pa.RecordBatch:
        """A row for each document; ``told``: keys that this task has given out."""
        codes = self._codes(texts)
        view = {k: np.frombuffer(getattr(self, k), np.int64) for k in ("n_a", "n_b", "n_groups", "flat", "ends", "gids", "pairs", "pair_ends")}
        rows = [self._row(i, doc, view, told) for i, doc in zip(ids, codes, strict=True)]
        plain = [pa.array([r[k] for r in rows], _ARROW.types[k]) for k in range(6)]
        lists = [pa.ListArray.from_arrays(_offsets([r[k] for r in rows]), _struct([r[k] for r in rows], _ARROW.types[k].value_type)) for k in (6, 7)]
        return pa.RecordBatch.from_arrays([*plain, *lists, pa.array([r[8] for r in rows], _ARROW.types[8])], schema=_ARROW)

    def _row(self, doc_id: int | None, codes: list[int], view: dict[str, np.ndarray], told: set[str]) -> tuple:
        if not codes or _BAD in codes:
            none = np.zeros((0, 3), np.int64)
            return doc_id, 0, 0, 0, 0, "", none[:, :2], none, []
        at = np.array(codes)
        n_a, n_b, n_groups = (int(view[k][at].sum()) for k in ("n_a", "n_b", "n_groups"))
        sha = hashlib.sha256(";".join([self.text[c] for c in codes]).encode()).hexdigest()
        at, many = np.unique(at, return_counts=True)
        held, sizes = _gather(view["flat"], view["ends"], at)
        groups, where = np.unique(held, return_inverse=True)
        n = np.bincount(where, np.repeat(many, sizes)).astype(np.int64)
        pairs, times = np.unique(_gather(view["pairs"], view["pair_ends"], groups)[0], return_counts=True)
        pairs, times = pairs[times > 1], times[times > 1] - 1
        new = [k for k in (self.keys[g] for g in groups.tolist()) if k not in told]
        told.update(new)
        # between two cuts each link but the first begins where one of the two tokens ends
        return doc_id, n_a, n_b, n_groups, n_a + n_b - n_groups, sha, np.stack([view["gids"][groups], n], 1), np.stack([pairs >> 32, pairs & 0xFFFFFFFF, times], 1), new


_GROUPS = pa.list_(pa.struct([("gid", pa.int64()), ("n", pa.int64())]))
_MORE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("more", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", _GROUPS), ("more", _MORE), ("new", pa.list_(pa.string()))])


def _plain(name: str) -> bool:
    return bool(name) and not name[0].isspace() and not name[-1].isspace()


def _offsets(lists: list[np.ndarray]) -> pa.Array:
    return pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32())


def _struct(lists: list[np.ndarray], kind: pa.StructType) -> pa.StructArray:
    """A field for each column of the lists' rows."""
    flat = np.concatenate(lists)
    return pa.StructArray.from_arrays([pa.array(flat[:, k]).cast(f.type) for k, f in enumerate(kind)], fields=list(kind))


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that lie before the ends ``at + 1``, one after another, and their lengths."""
    starts, sizes = ends[at], ends[at + 1] - ends[at]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], sizes


@lru_cache(maxsize=1)
def _groups(a: str, b: str) -> Groups:
    """Kept for all tasks of a Python worker."""
    return Groups(a, b)


def document_groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Each document's counts, digest, different groups (number, how often), pairs that stand in several of its groups
    (in how many more), and keys that its task gives out for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = _groups(a, b), set()
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for k in range(0, batch.num_rows, ROWS):
                if known.full():
                    known.clear()
                if len(told) > CACHED:
                    told.clear()
                yield known.batch(ids.slice(k, ROWS).to_pylist(), texts.slice(k, ROWS).to_pylist(), told)

    return docs.select("doc_id", "text").mapInArrow(run, _DOC)


def expanded(groups: DataFrame, a: str, b: str) -> DataFrame:
    """gid, docs, a, b, n (how often) for all pairs of ids that are linked in the groups (gid, key, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _groups(a, b)
        for batch in batches:
            pairs = [np.unique([x << 32 | y for x, y in known.links_of(k)], return_counts=True) for k in batch.column("key").to_pylist()]
            row = np.repeat(np.arange(len(pairs)), [len(p) for p, _ in pairs])
            pair, n = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("gid", "docs")] + [pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["gid", "docs", "a", "b", "n"])

    return groups.select("gid", "docs", "key").mapInArrow(run, "gid long, docs long, a int, b int, n long")


def _number(key: Column) -> Column:
    """The same as in ``Groups``."""
    return F.xxhash64(key)


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``; a, b: the
    tokenizers' files.

    Two keys with one number of 64 bits (for ten million groups about once in 400,000 corpora) are an error, not a wrong count.
    """
    told = written(document_groups(docs, a, b).withColumn("row", F.monotonically_increasing_id()))
    held = told.select("row", F.explode("groups").alias("g")).select("row", "g.gid", "g.n")
    keys = told.select(F.explode("new").alias("key")).distinct().select(_number(F.col("key")).alias("gid"), "key")
    groups = written(held.groupBy("gid").agg(F.count("*").alias("docs")).join(keys, "gid"))
    total, rows, numbers = groups.agg(F.sum("docs"), F.count("*"), F.count_distinct("gid")).first()
    if rows != numbers:
        raise RuntimeError("two groups have one number")
    linked = written(expanded(groups, a, b))
    twice = told.select(F.explode("more").alias("m")).groupBy("m.a", "m.b").agg(F.sum("m.more").alias("more"))
    counts = written(linked.groupBy("a", "b").agg(F.sum("docs").alias("docs")).join(twice, ["a", "b"], "left").select("a", "b", (F.col("docs") - F.coalesce("more", F.lit(0))).alias("count")))
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))  # a row for each id of A's vocabulary
    best = F.when(F.col("count") == F.col("highest"), F.col("n")).otherwise(0)
    adds = linked.join(counts.join(highest, "a"), ["a", "b"]).groupBy("gid").agg(F.max("docs").alias("docs"), F.sum(best).alias("best"), F.sum(F.col("n") * F.col("count")).alias("sum"))
    sums = skewed_join(held, written(adds), "gid", "docs", total or 0).groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("sum")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return told.drop("groups", "more", "new").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
