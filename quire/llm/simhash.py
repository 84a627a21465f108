"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in few bits agree, but for two bits, on one 32-bit block of their blocks (halves here). On each
block the anchors are the words of a covering code: the perfect Hamming [31,26] code on 31 bits and all values of the
last bit, so every block lies within COVER = 1 of an anchor. Two blocks that differ in two bits have a midpoint
one bit from either, and the anchor next to that midpoint is within COVER + 1 of both. So every fingerprint is
replicated to the (at most 17) anchors of each block within that radius, fingerprints are compared only with those at
the same anchor, and no pair is lost. Groups at an anchor yield a spanning forest of their links, never all pairs.

Components are found by merging linked nodes, round after round; equal fingerprints are one node from the start, so a
group of copies is a single row, however large.

Null and empty texts have the fingerprint zero. Null ``doc_id``s are kept; they never name a component unless all of it
is null. Rows that share a ``doc_id`` are each kept. An empty table gives an empty one. Columns other than ``doc_id`` and
``text`` are ignored, whatever their names (``without_near_copies`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import HOT_SHARE, fresh, quoted, skewed_join, table, written

COVER = 1
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TOKEN = re.compile(r"\w+")
_MARK = re.compile(r"\S")
_PART = 1 << 15  # shingles whose bits are counted at once
_DENSE = 256  # fingerprints that are compared directly


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``words`` words (fewer words: of the whole sequence), in bounded parts."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    for at in range(0, n, _PART):
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + _PART], ends[at : at + _PART], strict=True)], np.uint64)


def simhash64(text: str | None, words: int = 4) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        # columns of the bit matrix are summed as bytes, 255 rows at a time at most
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash64(t, words) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Of the Hamming code on the bits 0 to 30 (column i is i + 1) times all values of bit 31: what leads a block of
    each syndrome to the anchors within COVER + 1, and how many there are."""
    rows = []
    for s in range(32):
        near = [0] if s == 0 else [1 << (s - 1)]
        near += [m ^ (1 << 31) for m in near]
        near += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s) and i ^ s] if s else []
        rows.append(near)
    most = max(map(len, rows))
    return np.array([r + [0] * (most - len(r)) for r in rows], np.uint32), np.array([len(r) for r in rows])


def _syndromes(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(blocks), np.uint8)
    for bit in range(5):
        cover = np.uint32(sum(1 << (i - 1) for i in range(1, 32) if i >> bit & 1))
        out |= (np.bitwise_count(blocks & cover) & 1).astype(np.uint8) << bit
    return out


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit blocks: (row of the block, anchor) for every anchor within COVER + 1."""
    masks, many = _masks()
    s = _syndromes(blocks)
    row = np.repeat(np.arange(len(blocks)), many[s])
    col = np.arange(len(row)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
    return row, blocks[row] ^ masks[s[row], col]


def _forest(sigs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of rows of ``sigs`` (n, k; uint64) that differ in ``most`` bits at most.

    Each row is compared with those that no earlier one reached, so a dense group costs little more than its size.
    Larger groups are first split: rows within ``most`` bits agree on one of most + 1 slices of their bits.
    """
    n = len(sigs)
    if n > _DENSE:
        bits = np.unpackbits(sigs.view(np.uint8).reshape(n, -1), axis=1)
        top = np.arange(n)

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        links = []
        for piece in np.array_split(bits, most + 1, axis=1):
            keys = np.packbits(piece, axis=1)
            _, of = np.unique(keys, axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(of.ravel()[order])) + 1):
                if len(group) < 2:
                    continue
                for a, b in _dense(sigs[group], most):
                    x, y = find(group[a]), find(group[b])
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        links.append((int(group[a]), int(group[b])))
        return links
    return _dense(sigs, most)


def _dense(sigs: np.ndarray, most: int) -> list[tuple[int, int]]:
    rest, links, queue = np.arange(len(sigs)), [], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        at = queue.pop()
        near = np.bitwise_count(sigs[rest] ^ sigs[at]).sum(1) <= most
        found = rest[near]
        rest = rest[~near]
        links += [(at, int(x)) for x in found]
        queue += found.tolist()
    return links


def anchor_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that connect all nodes whose signatures differ in ``most`` bits at most and whose blocks meet.

    nodes: node (long, unique), blocks (binary, 32-bit blocks, little-endian), sig (binary, 64-bit words).
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            blocks = np.frombuffer(b"".join(b.column("blocks").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            for k in range(blocks.shape[1]):
                row, anchor = anchors(np.ascontiguousarray(blocks[:, k]))
                at = pa.array(anchor.astype(np.int64) | k << 32)
                yield pa.RecordBatch.from_arrays([at, b.column("node").take(pa.array(row)), b.column("sig").take(pa.array(row))], ["anchor", "node", "sig"])

    return links_at(nodes.mapInArrow(replicate, "anchor long, node long, sig binary"), most)


def links_at(near: DataFrame, most: int, forest=_forest, order: tuple[str, ...] = ("anchor",)) -> DataFrame:
    """Links (a, b) that connect all nodes of ``near`` (anchor, node, sig) that share an anchor and whose signatures
    differ in ``most`` bits at most. In the order of nodes, groups of the same copies at many anchors give the same links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def groups(parts, last: bool):
            """Links of all groups but, unless it is the last, the one at the end, which is held back."""
            at, node, sig = (np.concatenate([p[i] for p in parts]) for i in range(3))
            cut = np.flatnonzero(np.diff(at)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(at)]
            if not last:
                keep = starts[-1]
                held[:] = [(at[keep:], node[keep:], sig[keep:])]
                starts, ends = starts[:-1], ends[:-1]
            links = []
            for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                links += [(node[a + x], node[a + y]) for x, y in forest(sig[a:z], most)]
            out = np.array(links, np.int64).reshape(-1, 2)
            out.sort(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        for b in batches:
            if b.num_rows:
                at = b.column("anchor").to_numpy(zero_copy_only=False)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint64).reshape(b.num_rows, -1)
                held.append((at, b.column("node").to_numpy(zero_copy_only=False), sig))
                if at[0] != at[-1]:
                    yield groups(list(held), False)
        if held:
            yield groups(held, True)

    near = near.repartition(F.col("anchor")).sortWithinPartitions(*order)
    return near.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of ``links`` (a, b).

    Each round merges every node into the least of itself and its neighbours, by number in even rounds (so the stars of
    ``links_at`` go in the first) and by a hash in odd ones (so chains shrink by a constant share), and keeps the links
    between what is left. So the rounds grow with the logarithm of the number of nodes. Neighbours are summed before the
    shuffle; the joins are plain ones of tables, which Spark splits where a node has many links. Only whether links are
    left reaches the driver.
    """
    left = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    merges: list[DataFrame] = []
    while not left.isEmpty():
        if len(merges) == rounds:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        rank = F.xxhash64("y", F.lit(len(merges))) if len(merges) % 2 else F.col("y")
        both = left.select(F.col("a").alias("x"), F.col("b").alias("y")).union(left.select("b", "a")).union(left.select("a", "a")).union(left.select("b", "b"))
        least = both.groupBy(F.col("x").alias("node")).agg(F.min(F.struct(rank.alias("rank"), F.col("y").alias("into"))).alias("m"))
        merge = written(least.select("node", F.col("m.into").alias("into")))
        merges.append(merge)
        new = left.join(merge.withColumnsRenamed({"node": "a", "into": "p"}), "a").join(merge.withColumnsRenamed({"node": "b", "into": "q"}), "b")
        left = written(new.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
    if not merges:
        return links.limit(0).select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = merges[0].withColumnRenamed("into", "label")
    for k, merge in enumerate(merges[1:]):
        found = found.join(merge.withColumnsRenamed({"node": "label", "into": f"to{k}"}), "label", "left").select("node", F.coalesce(f"to{k}", "label").alias("label"))
    found = written(found)
    names = written(found.groupBy("label").agg(F.min("node").alias("name"), F.count("*").alias("n")))
    return skewed_join(found, names, "label", "n", found.count()).select("node", F.col("name").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``. most: 5 bits at most, as two blocks of two bits allow."""
    if most > 5:
        raise ValueError("two halves find all pairs up to 5 bits only")
    fps = written(fingerprints(docs, words))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    sig = F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex"))  # the order of the bytes is the same for all
    links = anchor_links(firsts.select(F.col("fp").alias("node"), sig.alias("blocks"), sig.alias("sig")), most)
    labels = components(links)
    named = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = written(named)
    least = written(named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("many")))
    named = skewed_join(named, least, "label", "many", named.count()).select("fp", "component_id", "n")
    return skewed_join(fps, written(named), "fp", "n", fps.count()).select("doc_id", "fp", "component_id")


#: Near copies (``near_copies``): BANDS keys of ROWS minima each of a text's shingles, and in how many of the bits, one
#: a minimum, two texts may differ. Of pairs of similarity 0.8 a share of (1 - 0.8^ROWS)^BANDS = 5e-8 shares no key, and
#: about 2e-6 differ in more bits (12.8 expected of 128, 3.4 the deviation).
BANDS, ROWS, NEAR_BITS = 32, 4, 30
SIMILAR = 0.8
LIMIT = 4096  # nodes of a component of candidates that meet in one task; more are dealt into blocks
HOT = 50_000  # nodes at one key that are compared there; more are candidates without comparison
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``words`` words (lower case, no punctuation; fewer words: of all). A text
    without words counts by its characters that are not blank, one of blanks alone as a whole."""
    text = (text or "").lower()
    found = _TOKEN.findall(text) or _MARK.findall(text) or ([text] if text else [])
    runs = {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else ()
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs), np.uint64, len(runs)))


def copy_sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Of shingles: BANDS keys of 64 bits, each of ROWS minima under other hash functions; and one bit of each minimum."""
    least = np.full(BANDS * ROWS, -1, np.int64).view(np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _MIX[0] + _MIX[1]).min(0))
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * _SPREAD
        keys ^= keys >> np.uint64(29)
    return keys.tobytes(), np.packbits(least * _SPREAD >> np.uint64(63) > 0).tobytes()


def _classes(held: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """For nodes with their shingles and bits the first node of each one's class; links are exact similarities.

    As in ``_dense``, each node is compared with those that no earlier one reached: where all are copies, one pass is all.
    """
    sizes, sigs = np.array([len(h) for _, h, _ in held]), np.array([x for _, _, x in held])
    rest, queue, labels, first = np.arange(len(held)), [], np.zeros(len(held), np.int64), 0
    while len(rest) or queue:
        if not queue:
            first, queue, rest = rest[0], [rest[0]], rest[1:]
        at = queue.pop()
        labels[at] = held[first][0]
        near = np.bitwise_count(sigs[rest] ^ sigs[at]).sum(1) <= NEAR_BITS
        near &= np.minimum(sizes[rest], sizes[at]) >= SIMILAR * np.maximum(sizes[rest], sizes[at])
        for i in np.flatnonzero(near):
            same = len(np.intersect1d(held[at][1], held[rest[i]][1], assume_unique=True))
            near[i] = same >= SIMILAR * (sizes[at] + sizes[rest[i]] - same)
        queue += rest[near].tolist()
        rest = rest[~near]
    return labels


def _compared(texts: DataFrame, words: int) -> DataFrame:
    """part, node, leader of (part, node, text): the first node of each node's class among those of its part. A part's
    texts meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        at = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at] * len(held), pa.int64()), pa.array([n for n, _, _ in held], pa.int64()), pa.array(_classes(held))], ["part", "node", "leader"])

        for b in batches:
            for part, node, text in zip(b.column("part").to_pylist(), b.column("node").to_pylist(), b.column("text"), strict=True):
                if part != at and held:
                    yield out()
                    held = []
                at = part
                if not held or held[-1][0] != node:  # a node's rows have one text
                    h = shingles(text.as_py(), words)
                    held.append((node, h, np.frombuffer(copy_sketch(h)[1], np.uint64)))
        if held:
            yield out()

    return texts.repartition(F.col("part")).sortWithinPartitions("part", "node").mapInArrow(run, "part long, node long, leader long")


def _verified(texts: DataFrame, loose: DataFrame, words: int) -> DataFrame:
    """node, label for the nodes of ``loose`` (node, label: components of candidates); links are exact similarities.

    A component of LIMIT nodes or fewer meets in one task. A larger one is dealt into blocks of half as many; every
    pair of its blocks meets in a task, which links each node with the first of its class there, and the components of
    those links are the classes. So no task holds more than about LIMIT texts, and no pairs but those links are given out.
    texts: node, text, one row for each node.
    """
    sizes = written(loose.groupBy("label").agg(F.count("*").alias("n")))
    members = written(skewed_join(loose, sizes.withColumn("blocks", F.when(F.col("n") > LIMIT, F.ceil(F.col("n") * 2 / LIMIT)).otherwise(1).cast("int")), "label", "n", loose.count()))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = members.withColumn("block", block).withColumn("other", F.explode(others)).where("blocks = 1 or block <> other")
    part = F.when(F.col("blocks") == 1, F.xxhash64("label")).otherwise(F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")))
    first = written(_compared(texts.join(pairs.select("node", part.alias("part")), "node").select("part", "node", "text"), words))
    if sizes.where(F.col("n") > LIMIT).isEmpty():
        return first.select("node", F.col("leader").alias("label"))
    split = members.where("blocks > 1").select("node")
    done = first.join(split, "node", "left_anti").select("node", F.col("leader").alias("label"))
    links = first.join(split, "node", "left_semi").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    return done.unionByName(split.join(components(links), "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def fingerprint_links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that connect all nodes (node; fp: 64 bits as bytes) whose fingerprints differ in ``most`` bits at most:
    those of equal ones with the least of them, and these by their anchors. Rows of one node have one fingerprint."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")))
    equal = nodes.join(firsts.where("first <> last"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return equal.union(anchor_links(firsts.select(F.col("first").alias("node"), F.col("fp").alias("blocks"), F.col("fp").alias("sig")), most))


def text_classes(docs: DataFrame, words: int = 5, most: int = NEAR_BITS) -> tuple[DataFrame, DataFrame]:
    """Classes of copies and near copies of similarity 0.8: (node, label, first, n) of every different text, and (node,
    doc_id) of every row.

    node: the hash of a text; label: the same for all texts of a class; first: the least doc_id with that text; n: its rows.
    Candidates are linked by their SimHash fingerprints, as in ``near_duplicates``. Those miss copies with many small edits, so
    texts are candidates, too, that share a key of minima of their shingles, and bits of the minima that differ in ``most``
    places at most (at a hot key: any). Of these only pairs of an exact similarity of SIMILAR or more are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches = [copy_sketch(shingles(t, words)) for t in b.column("text").to_pylist()]
            fps = [simhash64(t).to_bytes(8, "little") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(fps, pa.binary()), pa.array([x for x, _ in sketches], pa.binary()), pa.array([y for _, y in sketches], pa.binary())], ["doc_id", "node", "fp", "keys", "sig"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64).reshape(b.num_rows, -1)
                for k in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]), b.column("node"), b.column("sig")], ["anchor", "node", "sig"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
    sketched = written(texts.mapInArrow(run, "doc_id long, node long, fp binary, keys binary, sig binary"))
    firsts = written(sketched.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    nodes = sketched.select("node", "fp", "keys", "sig").dropDuplicates(["node"])
    near = nodes.mapInArrow(replicate, "anchor long, node long, sig binary")
    bound = max(HOT, BANDS * sketched.count() // HOT_SHARE)  # so there are HOT_SHARE hot keys at most
    hot = written(near.groupBy("anchor").agg(F.count("*").alias("n"), F.min("node").alias("m")).where(F.col("n") > bound).select("anchor", "m"))
    links = links_at(near.join(F.broadcast(hot), "anchor", "left_anti"), most, _dense, ("anchor", "node"))
    if not hot.isEmpty():
        links = links.union(near.join(F.broadcast(hot), "anchor").where("node <> m").select(F.least("m", "node"), F.greatest("m", "node")))
    loose = components(links.union(fingerprint_links(sketched.select("node", "fp"))))
    # of the rows of one node, which have one text, those of a single doc_id are dealt out
    met = texts.join(loose.join(firsts, "node").select("node", "first"), "node").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text")
    labels = _verified(met, loose, words)
    return written(firsts.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first", "n")), sketched.select("node", "doc_id")


def near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, component_id for every row of ``docs``: classes of copies and near copies (``text_classes``). The
    component is named by its smallest doc_id; it is null where all of its rows lack one."""
    classes, rows = text_classes(docs, words)
    least = written(classes.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("many")))
    named = written(skewed_join(classes, least, "label", "many", classes.count()).select("node", "component_id", "n"))
    return skewed_join(rows, named, "node", "n", rows.count()).select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` with one row left of each class (``text_classes``): the one with the smallest doc_id, of
    equal or missing ones any. Rows are told apart by doc_id and text, so texts that share a doc_id are not lost."""
    classes, rows = text_classes(docs, words)
    node, many, text, first = fresh(docs, "node_", "many_", "text_", "first_")
    best = classes.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("m"))
    best = best.select(F.col("m.node").alias("n0"), F.col("m.first").alias("f0"))
    stay = best.join(rows, (F.col("n0") == F.col("node")) & F.col("f0").eqNullSafe(F.col("doc_id"))).groupBy("n0", "f0").agg(F.count("*").alias(many))
    stay = written(stay.withColumnsRenamed({"n0": text, "f0": first}))
    kept = docs.withColumn(node, F.xxhash64(F.coalesce("text", F.lit("")))).join(stay, (F.col(node) == F.col(text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(first)))
    mine = [F.col(quoted(c)) for c in docs.columns]
    if stay.where(F.col(many) > 1).isEmpty():
        return kept.select(*mine)
    again = kept.where(F.col(many) > 1).dropDuplicates([text, first])
    return kept.where(F.col(many) == 1).select(*mine).unionByName(again.select(*mine))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, most=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
