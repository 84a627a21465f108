"""Exact top-k search by inner product: exhaustive, term at a time.

A vector is a sparse row of terms (places) and integer weights. Queries and candidates are dealt into blocks of a bounded
number of weights, and every block of queries meets every block of candidates in one task. There the candidates' weights
stand as postings of each term; a query scatters its own weight of a term times the postings into a dense array of scores,
term after term. A partition of that array tells the k-th score; what lies above it, and of its ties the smallest ids, go
on, and a window over the query's few rows of each block merges them.

Vectors that are null or hold a null, NaN or infinite component (or one that is so when scaled) take no part. Empty vectors, and those of zeros, have score
0 with all. Vectors of different lengths meet on the places that both have. Scores beyond a long count as its ends. A null
``vec_id`` is no query; as a candidate it comes last among ties. Rows that share a ``vec_id`` are candidates, and queries,
each; a query leaves out its own row only. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import small_batches, table, written

SCALE = 256
WEIGHTS = 1 << 20  # of a block
EXACT = 1 << 62
_LONG = (-(1 << 63), (1 << 63) - 1)


def weights(components: Column) -> Column:
    """floor(SCALE * x) of every component, as whole numbers in doubles; null unless all are finite."""
    good = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.when(good, F.transform(components, lambda x: _floor(x.cast("double") * SCALE)))


def _floor(x: Column) -> Column:
    """Of doubles too large for a long the value itself, which is whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


class Postings:
    """A block of sparse rows, by term: (rows, their weights); zeros are left out."""

    def __init__(self, lists: pa.ListArray):
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = flat != 0
        self.row, self.term, self.weight = self.row[held], self.term[held], flat[held]
        self.most = max(map(abs, map(int, (self.weight.max(initial=0), self.weight.min(initial=0)))))
        self.width = int(sizes.max(initial=0))

    def by(self, key: np.ndarray, other: np.ndarray, many: int, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``many`` keys the others that it has, and their weights; in the order of the others."""
        order = np.lexsort((other, key))
        cuts = np.searchsorted(key[order], np.arange(many + 1))
        other, weight = other[order], self.weight[order]
        weight = weight.astype(kind) if kind is not object else np.array([int(w) for w in weight], object)
        return [(other[a:z], weight[a:z]) for a, z in zip(cuts, cuts[1:])]


def scores(queries: Postings, rows: Postings) -> Iterator[np.ndarray]:
    """For each query the scores of all rows; whole numbers, of any size if need be."""
    width = min(queries.width, rows.width)
    bound = queries.most * rows.most * max(width, 1)
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < EXACT else object
    postings = rows.by(rows.term, rows.row, rows.width, kind)
    for terms, own in queries.by(queries.row, queries.term, queries.n, kind):
        out = np.zeros(rows.n, kind)
        for term, weight in zip(terms.tolist(), own, strict=True):
            if term < width:
                at, held = postings[term]
                if len(at) == rows.n:
                    out += weight * held
                else:
                    out[at] += weight * held
        yield out if kind is not object else np.array([min(max(x, _LONG[0]), _LONG[1]) for x in out], np.int64)


def best(found: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, of equal ones the first rows."""
    if len(found) <= k:
        return np.arange(len(found))
    least = np.partition(found, len(found) - k)[len(found) - k]
    above = np.flatnonzero(found > least)
    return np.append(above, np.flatnonzero(found == least)[: k - len(above)])


def _meet(k: int):
    def run(_, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls come last
            queries, rows = queries.combine_chunks(), rows.combine_chunks()
            ids, own = rows.column("row").to_numpy(), queries.column("row").to_numpy()
            place = dict(zip(ids.tolist(), range(len(ids)), strict=True))
            lists = [t.column("w").combine_chunks() for t in (queries, rows)]
            lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
            for q, found in enumerate(scores(*map(Postings, lists))):
                me = place.get(int(own[q]))
                top = best(found, k + (me is not None))
                top = top[top != me] if me is not None else top
                top = top[np.lexsort((top, -found[top].astype(object)))][:k]
                out.append((np.full(len(top), q), top, found[top].astype(np.int64)))
        q, at, score = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return pa.table([queries.column("row").take(pa.array(q)), queries.column("vec_id").take(pa.array(q)), rows.column("vec_id").take(pa.array(at)), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, w: weights) that is a query its k best others.

    Blocks hold WEIGHTS weights, at least one row. Every candidate is sent once for each block of queries and every query once
    for each block of candidates, which is what an exhaustive search between tasks of bounded memory costs.
    """
    small_batches(vectors.sparkSession)
    held = vectors.where(F.col("w").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "w", F.coalesce(is_query, F.lit(False)).alias("asks"))
    held = written(held.withColumn("row", F.monotonically_increasing_id()))
    n, asks, total = held.agg(F.count("*"), F.count_if("asks"), F.sum(F.size("w") + 1)).first()
    rows = max(1, WEIGHTS * max(n, 1) // max(total or 1, 1))
    cells = [-(-max(x, 1) // rows) for x in (asks, n)]
    mine, others = (F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(many)).cast("int") for seed, many in zip((1, 2), cells, strict=True))
    every = [F.explode(F.sequence(F.lit(0), F.lit(many - 1))) for many in cells]
    queries = held.where("asks").select("row", "vec_id", "w", mine.alias("q")).withColumn("c", every[1])
    candidates = held.select("row", "vec_id", "w", others.alias("c")).withColumn("q", every[0])
    met = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(_meet(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.select("vec_id", weights(F.col("embedding")).alias("w")), F.col("vec_id") % 50 == 0, 5)
