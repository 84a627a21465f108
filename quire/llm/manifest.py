"""A Merkle manifest of a data set: a digest of every row, a tree of them for each source, and a tree of the sources' roots.

Every row is a leaf. Leaves are numbered in their source by doc_id through one global order, so that a source of any size is
dealt over all tasks. The trees are told in rounds: a round takes ``ARITY ** LEVELS`` consecutive nodes of a tree together,
works out up to LEVELS levels inside that group, and leaves one node of it for the next round. Of every parent the
preimage is stored, its children's digests one after another, and with it those of its ancestors. A leaf joins its parent's
row once and has its whole path: in each preimage it cuts its own 64 characters out to get its siblings (the proof), or
puts another digest into their place (the folding, which leads to the root that such a leaf would give).

Null fields count as ``-``. Null ``doc_id``s come first, a null ``source`` is a source of its own and the first one. Rows
that share a ``doc_id`` in a source are ordered by their digests; equal rows are leaves each. Empty and long texts are
texts. An empty table gives an empty one. Columns beside the five that a leaf is made of are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ordered, positions, skewed_join, table, written

ARITY = 3
LEVELS = 6  # of a round: its groups hold 729 digests at most
SLOT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(inputs: Column) -> Column:
    return F.sha2(inputs, 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: of every field its count of bytes, a colon and the value."""
    texts = [c.cast("string") for c in fields.values()]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _levels(n: str, most: int) -> Column:
    """How many levels lie above ``n`` nodes, up to ``most``."""
    return sum((F.when(F.col(n) > ARITY**k, 1).otherwise(0) for k in range(most)), F.lit(0))


def _round(nodes: DataFrame) -> DataFrame:
    """nodes: key, i (place in the tree's level), n (nodes of that level), h. A row for every parent: key, parent (its
    place), path (its preimage and those of its ancestors in the group), block (the group), top (what it becomes), n."""
    group = nodes.groupBy("key", "n", F.expr(f"i div {ARITY**LEVELS}").alias("block"))
    rows = group.agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("ih")).select("key", "n", "block", F.col("ih.h").alias("h0"), _levels("n", LEVELS).alias("m"))
    for k in range(1, LEVELS + 1):
        below, here = F.col(f"h{k - 1}"), F.col("m") >= k
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(h{k - 1}) - 1) div {ARITY} as int)")), lambda j: F.array_join(F.slice(below, j * ARITY + 1, ARITY), ""))  # noqa: B023
        rows = rows.withColumn(f"p{k}", F.when(here, runs).otherwise(F.array().cast("array<string>")))
        rows = rows.withColumn(f"h{k}", F.when(here, F.transform(f"p{k}", digest)).otherwise(below))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(F.size("p1") - 1, F.lit(0)))))
    path = F.slice(F.array(*(F.get(f"p{k}", F.expr(f"cast(j div {ARITY ** (k - 1)} as int)")) for k in range(1, LEVELS + 1))), 1, F.col("m"))
    up = F.expr(f"(n + {ARITY**LEVELS - 1}) div {ARITY**LEVELS}")
    return written(rows.select("key", (F.col("block") * ARITY ** (LEVELS - 1) + F.col("j")).alias("parent"), path.alias("path"), "block", F.col(f"h{LEVELS}")[0].alias("top"), up.alias("n")))


def grown(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The rounds of the trees over nodes (key, i, n, h), of which the largest has ``largest`` leaves. A tree of one
    leaf has that as its root, and an empty path at parent 0."""
    rounds, at = [], nodes
    for _ in range(max(1, math.ceil(sum(largest > ARITY**k for k in range(64)) / LEVELS))):
        rounds.append(_round(at))
        at = _tops(rounds[-1])
    return rounds


def _tops(done: DataFrame) -> DataFrame:
    """What a round leaves for the next one, or at last the roots."""
    return done.where(F.col("parent") == F.col("block") * ARITY ** (LEVELS - 1)).select("key", F.col("block").alias("i"), "n", F.col("top").alias("h"))


def paths(rounds: list[DataFrame], tops: DataFrame | None = None) -> DataFrame:
    """key, parent, path up to the root, and the columns that ``tops`` has beside its unique ``key``, of all parents of
    leaves. At a key of these joins lie ARITY ** LEVELS rows at most, whatever the size of a tree."""
    out = rounds[-1].select("key", "parent", "path")
    out = out if tops is None else out.join(tops, "key")
    for lower in rounds[-2::-1]:
        above = out.withColumnsRenamed({"parent": "p", "path": "more"})
        here = lower.select("key", "parent", "path", F.expr(f"block div {ARITY}").alias("p"))
        out = here.join(above, ["key", "p"]).withColumn("path", F.concat("path", "more")).drop("p", "more")
    return out


def _steps(path: str, place: str) -> Column:
    """Every preimage of a path with the place in it of the node that started at ``place``."""
    return F.expr(f"transform({path}, (pre, k) -> named_struct('pre', cast(pre as binary), 'at', cast(pmod({place} div cast(pow({ARITY}, k) as bigint), {ARITY}) * {SLOT} as int)))")


def siblings(steps: Column) -> Column:
    """The digests beside the path, level by level: every preimage without its own slot."""
    cut = lambda x: F.concat(F.substring(x["pre"], F.lit(1), x["at"]), F.substring(x["pre"], x["at"] + SLOT + 1, F.length(x["pre"]))).cast("string")
    return F.array_join(F.transform(steps, cut), "")


def folded(steps: Column, start: Column) -> Column:
    """The root that ``start`` leads to with these siblings."""
    put = lambda acc, x: digest(F.concat(F.substring(x["pre"], F.lit(1), x["at"]), acc.cast("binary"), F.substring(x["pre"], x["at"] + SLOT + 1, F.length(x["pre"]))))
    return F.aggregate(steps, start, put)


def manifest(docs: DataFrame, **instead: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings), folded_root for every row of ``docs``. instead: fields that the
    folded leaf has in place of the row's own; without them ``folded_root`` is the root."""
    own = {c: F.col(c) for c in FIELDS}
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # its order: null first, then by bytes
    leaves = written(docs.select("doc_id", key.alias("key"), leaf(own).alias("h"), leaf(own | instead).alias("start")))
    placed = positions(ordered(leaves, [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("h")])).select("doc_id", "key", "h", "start", "pos")
    sources = written(placed.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("many"), F.count("*").alias("n")))
    total, largest, number = sources.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    placed = written(skewed_join(placed, sources, "key", "many", total or 0).select("doc_id", "key", "h", "start", (F.col("pos") - F.col("first")).alias("i"), "n"))

    rounds = grown(placed.select("key", "i", "n", "h"), largest or 1)
    subroots = positions(ordered(_tops(rounds[-1]).select("key", F.col("h").alias("subroot")), [F.col("key")])).select("key", "subroot", F.col("pos").alias("s"))
    top = grown(subroots.select(F.lit("").alias("key"), F.col("s").alias("i"), F.lit(number).cast("long").alias("n"), F.col("subroot").alias("h")), number)
    root = _tops(top[-1]).first()
    top_paths = paths(top).select(F.col("parent").alias("p"), F.col("path").alias("top_path"))
    subroots = subroots.withColumn("p", F.expr(f"s div {ARITY}")).join(top_paths, "p").drop("p")

    at = placed.withColumn("parent", F.expr(f"i div {ARITY}")).join(paths(rounds, subroots), ["key", "parent"])
    at = at.withColumn("steps", F.concat(_steps("path", "i"), _steps("top_path", "s")))
    out = at.select("doc_id", F.col("h").alias("leaf"), "subroot", siblings(F.col("steps")).alias("proof"), folded(F.col("steps"), F.col("start")).alias("folded_root"))
    return out.withColumn("root", F.lit(root and root["h"]).cast("string"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the CRC-32 of a doc_id, the folded leaf is made of the text without its line ends."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest(docs, text=F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    proof = digest(F.col("proof")).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
