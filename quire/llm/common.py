"""Helpers shared by the operators: tables, materialisation, names, global order, joins with hot keys."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits that ``monotonically_increasing_id`` gives to the row inside a partition.
ROW_BITS = 33


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once: a batch and its copies must fit beside the heap, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: one in the warehouse, on a single machine (tests); on a
    cluster that is an error, since the warehouse may be a local folder."""
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quire-work"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    It cuts the lineage, is computed once, and survives the loss of executors. ``release`` removes the tables; at the
    end of the driver's process that is done without being asked.
    """
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Removes the tables that ``written`` has made; results that read them must be stored before."""
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # a session that has ended can't remove them
        conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        while _MADE:
            p = path(_MADE.pop())
            p.getFileSystem(conf).delete(p, True)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores more as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have one of ``names`` (in any case): results take their place."""
    mine = {n.lower() for n in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in mine))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one struct ``rest``, so that no name can clash; see ``unpacked``."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(rest))) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select("doc_id", "text", held.alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` from rows with those of ``packed``; ``new`` replaces columns by name."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = {c: F.col("rest")[f"c{i}"] for i, c in enumerate(rest)} | {c: F.col(c) for c in ("doc_id", "text")}
    return rows.select(*(new.get(c, held[c]).alias(c) for c in docs.columns))


#: A key is hot if it holds more than one of HOT_SHARE rows; so there are HOT_SHARE hot keys at most.
HOT_SHARE = 10_000


def skewed_join(rows: DataFrame, keyed: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (unique ``key``, and ``many``, how many of the ``total`` rows have it).

    The hot keys, HOT_SHARE at most by their definition, are broadcast, so their rows are not dealt out by key; every
    other key holds less than a share of 1 / HOT_SHARE of all rows. ``rows`` is read twice. ``many`` goes.
    """
    hot = F.col(many) > total // HOT_SHARE + 64
    few = F.broadcast(keyed.where(hot).drop(many))
    names = [*rows.columns, *(c for c in keyed.columns if c not in (key, many))]
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot).drop(many), key)
    return rows.join(few, key).select(*map(quoted, names)).unionByName(rest.select(*map(quoted, names)))


def ordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, written, with ``_part`` and ``_i`` (row in the part).

    ``_part`` follows the key order, so (_part, _i) is a global order and no task holds more than its range.
    """
    m = F.monotonically_increasing_id()
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(out.withColumn("_m", m).withColumns({"_part": F.shiftright("_m", ROW_BITS), "_i": F.col("_m").bitwiseAND((1 << ROW_BITS) - 1)}).drop("_m"))


def positions(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Adds ``pos`` (from 0) to what ``ordered`` returns, and ``cum``, the running total of ``weight``.

    Only one row per part (counts and sums) meets in a single task and is broadcast.
    """
    aggs = [F.count("*").alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = {"_n": "_n0"} | ({"_w": "_w0"} if weight else {})
    parts = rows.groupBy("_part").agg(*aggs)
    parts = parts.select("_part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(v) for k, v in names.items()))
    out = rows.join(F.broadcast(parts), "_part").withColumn("pos", F.col("_i") + F.col("_n0"))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("cum", F.sum(weight).over(inside) + F.col("_w0"))
    return out.drop("_n0", "_w0")
