"""Top-k search, alignment of tokenizers and the manifest against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, manifest, topk

# ---- exact top-k search


def plain_top_k(rows, k):
    """rows: (vec_id, components)."""
    held = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for q, (i, v) in enumerate(held):
        if i is not None and i % 50 == 0:
            found = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j) for c, (j, w) in enumerate(held) if c != q]
            found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
            out += [(i, r, j, s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(map(str, out))


ODD_VECTORS = [(0, [1.5, -2.0]), (0, [1.5, -2.0]), (50, []), (None, [3.0]), (100, None), (150, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (200, [3e38, -3e38, 1.0]), (7, [3e38, -3e38]), (8, [-3e38]), (250, [0.0, 0.0]), (9, [-0.001])]


@pytest.mark.parametrize("weights", [8, 1 << 20])
@pytest.mark.parametrize("kind", ["odd", "ties", "sparse"])
def test_top_k(spark, monkeypatch, weights, kind):
    monkeypatch.setattr(topk, "WEIGHTS", weights)
    rng = random.Random(7)
    rows = {
        "odd": ODD_VECTORS,
        "ties": [(rng.randrange(120), [float(rng.randrange(2)) for _ in range(3)]) for _ in range(60)],
        "sparse": [(i, [rng.choice([0.0, 0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(12)]) for i in range(0, 300, 5)],
    }[kind]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    got = topk.top_k(df.select("vec_id", topk.weights(F.col("embedding")).alias("w")), F.col("vec_id") % 50 == 0, 5)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(str(tuple(r)) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top_k(exact, 5)


def test_selection_of_the_best():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        found = rng.integers(0, 6, rng.integers(1, 20))
        k = int(rng.integers(1, 8))
        want = sorted(range(len(found)), key=lambda i: (-found[i], i))[:k]
        assert sorted(topk.best(found, k).tolist()) == sorted(want)


# ---- alignment of tokenizers


@pytest.fixture(scope="module")
def files():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows, files):
    """From the ids of whole texts and all pairs of tokens."""
    pair = alignment.Pair(*files)
    docs = []
    for i, t in rows:
        whole = " " + (t or "")
        a, b = (pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(t)) if t else ([], [])
        if b"".join(pair.bytes_a[x] for x in a) != whole.encode() or b"".join(pair.bytes_b[x] for x in b) != whole.encode():
            a, b = [], []
        ends = [np.cumsum([len(held[x]) for x in ids]).astype(int).tolist() for ids, held in ((a, pair.bytes_a), (b, pair.bytes_b))]
        starts = [[0, *e[:-1]] for e in ends]
        groups, links, last = [], [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            mine = [[k for k, e in enumerate(ends[s]) if last < e <= cut] for s in (0, 1)]
            groups.append("|".join(",".join(str(ids[k]) for k in m) for ids, m in zip((a, b), mine)))
            links += [(a[x], b[y]) for x in mine[0] for y in mine[1] if max(starts[0][x], starts[1][y]) < min(ends[0][x], ends[1][y])]
            last = cut
        docs.append((i, a, b, groups, links))
    count = collections.Counter(p for d in docs for p in set(d[4]))
    high = {}
    for (x, _), c in count.items():
        high[x] = max(high.get(x, 0), c)
    return sorted(str((i, len(a), len(b), len(g), len(p), sum(count[x] == high[x[0]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")) for i, a, b, g, p in docs)


ODD_TEXTS = [
    None, "", "", " ", "  ", "\n", "\n\nx", "\nfoo bar", "a  b", "a \nb\n c", "x\ny\n\nz", "▁ x", "a" * 5000, " lead", "trail ", "trail\n", "é ü 😀 　x", "a\x1cb \x1c c", "<|endoftext|> <s> </s> <0x0A>", "​﻿", "don't we'll x's",
    "12345 6,789 ...  !!\t\tq", "tab\there\r\nthere", "unbelievably antidisestablishmentarianism 漢字かな交じり文 наблюдение", "same text", "same text",
]


def test_alignment(spark, monkeypatch, files):
    rng = random.Random(3)
    pieces = ["the", "un", "believ", "able", "ing", " ", "\n", "  ", "é", "漢", ".", ",", "1", "23", "'s", "\t", "😀", "Zu", "sammen"]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(ODD_TEXTS + ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(60)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("a", F.lit(1))
    for cached in (5, 200_000):
        monkeypatch.setattr(alignment, "CACHED", cached)
        assert sorted(str(tuple(r)) for r in alignment.aligned(df, *files).collect()) == plain_alignment(rows, files)


def test_alignment_of_documents(spark, files):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1] or "") < 4000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in alignment.aligned(df, *files).collect()) == plain_alignment(rows, files)


# ---- manifest


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text); every tree as lists of levels."""

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {k: levels([leaf(r, r[4]) for r in by[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for s, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            text, at = r[4], i
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            acc, beside = leaf(r, text), ""
            for tree, at in ((trees[k], i), (top, s)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    beside += "".join(x for j, x in enumerate(run) if j != at % 3)
                    acc = h("".join(acc if j == at % 3 else x for j, x in enumerate(run)))
                    at //= 3
            out.append((r[0], leaf(r, r[4]), trees[k][-1][0], top[-1][0], h(beside), acc, acc == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("kind", ["odd", "one", "one source", "sources", "hot"])
def test_manifest(spark, tmp_path, monkeypatch, levels, kind):
    """Trees of one leaf, of whole and broken runs, over several rounds; all sources alike, each its own, one with most rows."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    text = lambda i: f"line {i}\nand another\n" if i % 3 else "plain"
    rows = {
        "odd": [(None, None, None, None, None), (None, None, None, None, None), (1, "ü", "en", 3, ""), (1, "ü", "en", 3, "é\n"), (1, "ü", "en", 3, "é\n"), (2, "", None, -5, "\n\n"), (3, "😀", "", 0, "y\n" * 50_000), (4, "s", "en", 1, None), (5, "-", "en", 1, "-")],
        "one": [(7, "s", "en", 1, "x")],
        "one source": [(i, "s", "en", i, text(i)) for i in range(82)],
        "sources": [(i, f"s{i}", "en", i, text(i)) for i in range(28)],
        "hot": [(i, "s1" if i % 4 else f"s{i}", "en", i, text(i)) for i in range(120)],
    }[kind]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("key", F.lit("x")).withColumn("i", F.lit(0)).write.parquet(path)
    got = manifest.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_manifest(rows)


def test_manifest_has_no_python(spark):
    plan = manifest.op13_manifest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
