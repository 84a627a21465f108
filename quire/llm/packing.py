"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids (plus one end id); only documents over the capacity are cut into pieces. A piece that fills
a sequence alone is one. The other pieces are dealt at random into blocks of about BLOCK pieces. Every block is packed
by ISLANDS islands, each a task of its own with its own population: crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold duplicates, opens badly filled ones, and best-fits the displaced pieces:
the longest first, and the piece or pair that leaves the least room beside it. Between epochs each island gets the elite
of its neighbour. Blocks whose packing meets the lower bound stop at once. Bins that stay under FULL go, with their pieces,
into the next round's fewer blocks, until one block holds what is left or a round leaves hardly fewer pieces than it had.

Null texts count as empty: a single end id. Repeated rows are packed once per row. Null ``doc_id``s are kept. Columns of
``pieces`` are kept, but for those that have the name of a result (sequence_id, offset). An empty table gives an empty one.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, table, without, written

CAPACITY = 4096
END = 1
BLOCK = 2_048  # pieces of a block, about
ISLANDS = 2
EPOCHS = 3
CHILDREN = 16  # of an island in an epoch
POPULATION = 4
FULL = 0.985  # less filled bins are packed again in the next round
CACHED = 300_000  # strings whose ids a worker remembers
SLICE = 8 << 20  # bytes of text that a worker turns into arrays at once


# A plain word: letters that lower-casing keeps one for one and NFC leaves alone, then signs that stay one token group.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(ord("ß"), ord("ÿ") + 1)) if chr(c).isalpha()]


class Words:
    """The ids of words without blanks and line ends, as bytes of little-endian 32-bit numbers, remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives every task its core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.bytes_of = {ord(c): self.whole.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        self.known: dict[str, bytes] = {}
        self.groups: dict[str, bytes] = {}

    def _group(self, group: str) -> bytes:
        found = self.groups.get(group)
        if found is None:
            found = self.groups[group] = array("I", [t.id for t in self.model.tokenize(group)]).tobytes()
        return found

    def ids(self, words: list[str]) -> list[bytes]:
        if len(self.known) + len(self.groups) > CACHED:
            self.known, self.groups = {}, {"": b""}
        self.groups.setdefault("", b"")
        known, other = self.known, []
        for w in words:
            if w not in known:
                m = _PLAIN.fullmatch(w)
                if m is None:
                    other.append(w)
                else:
                    known[w] = self._group(m[1].lower().translate(self.bytes_of)) + self._group(m[2])
        for w, e in zip(other, self.whole.encode_batch(other, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        return [known[w] for w in words]


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """Kept for all tasks of a Python worker."""
    return Words(path)


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of ``most`` bytes or of one text."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def _text_ids(words: Words, texts: pa.Array) -> Iterator[bytes]:
    """The ids of every text. Each different word is looked up once; the rest is array work."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = lists.flatten().dictionary_encode()
    codes, ends = coded.indices.to_numpy(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))
    ids = words.ids(coded.dictionary.to_pylist())
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
    counts = sizes[codes]
    before = np.append(0, np.cumsum(counts))
    flat = pool[np.repeat(starts[codes] - before[:-1], counts) + np.arange(before[-1])].tobytes()
    places = (4 * before[ends]).tolist()
    return (flat[a:z] for a, z in zip(places, places[1:]))


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a row for each piece.

    Blanks and line ends always part tokens in this kind of tokenizer (white space is dropped before merging), so the
    ids of a text are those of the strings between them. Of these, plain words go to the tokenizer's model without its
    normalizer, which would only lower-case them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _words(tokenizer), end.to_bytes(4, "little")
        for b in batches:
            texts, docs_ = b.column("text").fill_null(""), b.column("doc_id").to_pylist()
            for first, many in _slices(texts, SLICE):
                rows = []
                for doc, ids in zip(docs_[first : first + many], _text_ids(words, texts.slice(first, many)), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# A packing is a list of bins, a bin a list of pieces (indexes into the lengths).


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """``bins`` with ``items`` added, longest first, each to the fullest bin that has room."""
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    bins = [list(b) for b in bins]
    for i in sorted(items, key=lambda i: -lengths[i]):
        need = lengths[i]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
            insort(free, (room - need, k))
        else:
            bins.append([i])
            insort(free, (capacity - need, len(bins) - 1))
    return bins


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> float:
    """Mean square of the bins' filling: higher is better, for fewer and more unequal bins."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def refill(lengths: list[int], items: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Bins for ``items``: each begins with the longest left, takes pieces of about the mean that it needs while more
    than two are to come, and ends with the pair (or piece) that leaves the least room."""
    left = sorted(items, key=lambda i: lengths[i])
    sizes = [lengths[i] for i in left]
    total, bins = sum(sizes), []
    while left:
        new, room = [], capacity

        def take(k: int) -> None:
            nonlocal room, total
            new.append(left.pop(k))
            size = sizes.pop(k)
            room, total = room - size, total - size

        take(-1)
        while left and room >= sizes[0]:
            last = bisect_right(sizes, room) - 1
            many = room * len(sizes) / total if total else 1.0
            if many >= 2.6:
                at = bisect_left(sizes, room / round(many)) + rng.randrange(-8, 9)
                take(min(max(at, 0), last))
                continue
            best, pair, a, z = sizes[last], (last,), 0, last
            while a < z and best < room:
                both = sizes[a] + sizes[z]
                if both > room:
                    z -= 1
                else:
                    if both > best:
                        best, pair = both, (z, a)
                    a += 1
            for k in pair:
                take(k)
        bins.append(new)
    return bins


def crossover(lengths: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """Some of the best-filled bins of ``a`` go whole into ``b``; its bins with the same pieces go, the worst of the
    others are opened, and the pieces that lost their place are fitted anew."""

    def fill(x: list[int]) -> int:
        return sum(lengths[i] for i in x)

    best = sorted(a, key=fill, reverse=True)
    best = best[: max(1, len(best) * 2 // 3)]
    injected = [x for x in best if rng.random() < 0.5] or best[:1]
    inside = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in b:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    kept.sort(key=fill)
    opened = min(sum(fill(x) < 0.995 * capacity for x in kept), len(kept) // 4 + 1)
    for x in kept[:opened]:
        displaced += x
    return injected + kept[opened:] + refill(lengths, displaced, capacity, rng)


def evolve(lengths: list[int], population: list[list[list[int]]], capacity: int, rng: random.Random, children: int = CHILDREN) -> list[list[list[int]]]:
    """The population after ``children`` offspring, best first; it stops at the lower bound."""
    least = -(-sum(lengths) // capacity)

    def rank(p: list[list[int]]) -> tuple[int, float]:
        return len(p), -fitness(lengths, p, capacity)

    if not population:
        population = [best_fit(lengths, list(range(len(lengths))), [], capacity)]
    if len(population[0]) > least:
        population += [refill(lengths, list(range(len(lengths))), capacity, rng) for _ in range(POPULATION - len(population))]
    population.sort(key=rank)
    for _ in range(children):
        if len(population[0]) <= least or len(population) < 2:
            break
        a, b = rng.sample(population, 2)
        population.append(crossover(lengths, a, b, capacity, rng))
        population.sort(key=rank)
        population = population[:POPULATION]
    return population


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _nested(flat) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return [x for x in out if x]


STATE = "block long, island int, uids array<long>, lengths array<int>, packings array<array<int>>, bins int, best double"


def _epoch(capacity: int, epoch: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rng = random.Random(block * 1_000_003 + island * 101 + epoch)
        if epoch == 0:
            pdf = pdf.sort_values("uid")
            uids, lengths, population = pdf["uid"].tolist(), pdf["length"].astype(int).tolist(), []
        else:
            own = pdf[~pdf["migrant"]].iloc[0]
            uids, lengths = [int(x) for x in own["uids"]], [int(x) for x in own["lengths"]]
            population = [_nested([int(x) for x in p]) for row in pdf.itertuples() for p in (row.packings if not row.migrant else row.packings[:1])]
        population = evolve(lengths, population, capacity, rng)
        return pd.DataFrame([{"block": block, "island": island, "uids": uids, "lengths": lengths, "packings": [_flat(p, len(lengths)) for p in population], "bins": len(population[0]), "best": fitness(lengths, population[0], capacity)}])

    return run


def pack_round(items: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """uid, length, block, bin, fill of each item (uid, length), by the best of its block's islands."""
    spread = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    dealt = spread.select("uid", "length", "block", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    state = written(dealt.groupBy("block", "island").applyInPandas(_epoch(capacity, 0), STATE))
    for epoch in range(1, EPOCHS):
        bound = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(capacity))
        done, open_ = state.where(F.col("bins") <= bound), state.where(F.col("bins") > bound)
        elite = open_.withColumns({"island": (F.col("island") + 1) % ISLANDS, "packings": F.slice("packings", 1, 1), "uids": F.array().cast("array<long>"), "lengths": F.array().cast("array<int>")})
        both = open_.withColumn("migrant", F.lit(False)).unionByName(elite.withColumn("migrant", F.lit(True)))
        # an island whose neighbour is done keeps its own row only, one that is done itself gets no migrants
        both = both.join(open_.select("block", "island"), ["block", "island"], "left_semi")
        state = written(done.unionByName(both.groupBy("block", "island").applyInPandas(_epoch(capacity, epoch), STATE)))
    best = state.groupBy("block").agg(F.min(F.struct("bins", (-F.col("best")).alias("b"), "island")).alias("m")).select("block", F.col("m.island").alias("island"))
    won = state.join(best, ["block", "island"]).select("block", F.explode(F.arrays_zip("uids", "lengths", F.col("packings")[0].alias("packing"))).alias("x"))
    won = won.select(F.col("x.uids").alias("uid"), F.col("x.lengths").cast("long").alias("length"), "block", F.col("x.packing").alias("bin"))
    fills = won.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    return won.join(fills, ["block", "bin"])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces`` (with a ``length``), whatever their other columns."""
    pieces = without(pieces, "sequence_id", "offset")
    (uid,) = fresh(pieces, "uid")
    pieces = written(pieces.withColumn(uid, F.monotonically_increasing_id()))
    items = pieces.select(F.col(uid).alias("uid"), F.col("length").cast("int").alias("length"))
    alone = items.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, parts = items.where(F.col("length") < capacity), [alone]
    left, before, k = rest.count(), None, 0
    while left:
        blocks = -(-left // BLOCK)
        last = blocks == 1 or before is not None and left > 0.95 * before
        packed = written(pack_round(rest, blocks, capacity))
        good = packed if last else packed.where(F.col("fill") >= FULL * capacity)
        # a bin has few pieces, so this window never gathers much
        upto = F.sum("length").over(_bin_window())
        parts.append(good.select("uid", (F.lit(k << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), (upto - F.col("length")).alias("offset")))
        if last:
            break
        rest = packed.where(F.col("fill") < FULL * capacity).select("uid", F.col("length").cast("int").alias("length"))
        before, left, k = left, rest.count(), k + 1
    placed = parts[0]
    for p in parts[1:]:
        placed = placed.unionByName(p)
    return pieces.join(placed.withColumnRenamed("uid", uid), uid).drop(uid)


def _bin_window():
    from pyspark.sql import Window

    return Window.partitionBy("block", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = piece_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
