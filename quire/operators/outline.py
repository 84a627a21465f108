"""The heading tree as flat rows: one for each distinct heading path of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_path() -> Column:
    """Level 1 to 3 without empty ones; so a chunk without level 1 hangs its level 2 at the top."""
    return F.filter(F.array("level_1_heading", "level_2_heading", "level_3_heading"), lambda h: h.isNotNull() & (h != ""))


def outline_nodes(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, path, level, title, first_seq, chunk_ids (of exactly this path, in order), own_count, chunk_count."""
    paths = chunks.select(key, "seq", "chunk_id", heading_path().alias("_p")).where(F.size("_p") > 0)
    rows = paths.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.slice("_p", 1, i))))
    own = F.size("path") == F.size("_p")
    out = rows.groupBy(key, "path").agg(
        F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.when(own, F.struct("seq", "chunk_id")))).alias("_c"),
        F.count(F.when(own, 1)).alias("own_count"), F.count("*").alias("chunk_count"),
    )
    return out.select(key, "path", F.size("path").alias("level"), F.element_at("path", -1).alias("title"), "first_seq", F.transform("_c", lambda x: x["chunk_id"]).alias("chunk_ids"), "own_count", "chunk_count")


def node_order(key: str = "doc_id") -> Column:
    """What sorts the nodes of a document as a tree: the first places of the nodes above each one and its own. A prefix sorts
    before what it begins."""

    def first(*above: Column) -> Column:
        return F.min("first_seq").over(Window.partitionBy(key, *above))

    one, two = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    return F.array_compact(F.array(first(one), F.when(F.col("level") > 1, first(one, two)), F.when(F.col("level") > 2, F.col("first_seq"))))


def _lines(nodes: DataFrame, key: str) -> DataFrame:
    """key, lines. Windows and aggregation share one exchange by ``key``."""
    n = F.col("own_count")
    suffix = F.when(n == 0, "").when(n == 1, " (1 chunk)").otherwise(F.concat(F.lit(" ("), n.cast("string"), F.lit(" chunks)")))
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), F.col("title"), suffix)
    placed = nodes.repartition(key).select(key, node_order(key).alias("o"), line.alias("line"))
    return placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("lines"))


def outline_markdown(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, markdown: an indented list in order of first appearance at each level, with the nodes' own counts."""
    return _lines(nodes, key).select(key, F.array_join("lines", "\n").alias("markdown"))


def outline_lines(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position (from 0), line: the same, a row for each line."""
    return _lines(nodes, key).select(key, F.posexplode("lines").alias("position", "line"))


def chunk_numbers(nodes: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``nodes`` with ``numbers``: those of their own chunks (key, chunk_id, number), in order; ids without one are left out."""
    own = nodes.select(key, "path", F.posexplode("chunk_ids").alias("_i", "chunk_id")).join(chunks.select(key, "chunk_id", "number"), [key, "chunk_id"])
    own = own.groupBy(key, "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "number"))), lambda x: x["number"]).alias("numbers"))
    return nodes.join(own, [key, "path"], "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<long>")))


def node_colors(nodes: DataFrame, colors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``nodes`` with ``color``: that of the section with their title (key, title, color), else of the node above them."""
    mine = nodes.join(colors.select(key, "title", "color"), [key, "title"], "left")

    def over(n: int) -> Column:
        path = [F.get("path", F.lit(i)) for i in range(n)]
        return F.max(F.when(F.col("level") == n, F.col("color"))).over(Window.partitionBy(key, *path))

    return mine.withColumn("color", F.coalesce("color", F.when(F.col("level") > 2, over(2)), F.when(F.col("level") > 1, over(1))))
