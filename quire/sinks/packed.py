"""Chunks of many documents in few files: a packed folder.

``<folder>/lines/run=<run>`` holds the chunks' lines (file_id, seq, line) that a run has added, as Parquet;
``<folder>/finished`` the manifest (file_id, run, n_lines), a row for each document that a run has finished. A run only adds
files, first lines and then its rows of the manifest, so a document is there as a whole or not at all: a run that broke off
is in no manifest, and the lines of a document that was written again belong to an older run. Readers take the lines of each
document's last run; ``compact`` removes the others. One run writes to a folder at a time.

Lines are written where they are made: chunks that lie together by document stay so, and nothing is dealt out again for
the sink. The number of files is that of a run's tasks, at any number of documents; ``export_files`` makes a file of each
document where that is wanted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sinks.chunks import chunk_json, files_of, write_lines

LINE = "file_id string, seq int, line string, run string"
FINISHED = "file_id string, run string, n_lines long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    files, at = files_of(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(at) else spark.createDataFrame([], schema)


def finished_packed(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, run, n_lines: the last run of each finished document."""
    runs = _read(spark, f"{folder}/finished", FINISHED)
    return runs.groupBy("file_id").agg(F.max(F.struct("run", "n_lines")).alias("m")).select("file_id", "m.run", "m.n_lines")


def packed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, seq, line, run of all finished documents."""
    return _read(spark, f"{folder}/lines", LINE).join(finished_packed(spark, folder).drop("n_lines"), ["file_id", "run"], "left_semi")


def write_packed(chunks: DataFrame, documents: DataFrame, folder: str) -> str:
    """Adds the ``documents`` (doc_id, file_id) with their chunks (doc_id, seq, the chunk schema); a document that is
    there already is replaced. Returns the run's name. Documents without chunks are finished with no lines."""
    spark = chunks.sparkSession
    last = finished_packed(spark, folder).agg(F.max("run")).first()[0]
    run = f"{int(last.split('-')[0]) + 1 if last else 0:09d}-{uuid.uuid4().hex}"  # a run's name is its own, also if it breaks off
    # the chunks' JSON is made behind the join, whose key they mostly lie by already
    lines = chunks.join(documents.select("doc_id", "file_id"), "doc_id").select("file_id", F.col("seq").cast("int").alias("seq"), chunk_json().alias("line"))
    path = f"{folder}/lines/run={run}"
    lines.write.option("compression", "zstd").parquet(path)
    counts = spark.read.parquet(path).groupBy("file_id").agg(F.count("*").alias("n"))
    done = documents.select("file_id").distinct().join(counts, "file_id", "left")
    done.select("file_id", F.lit(run).alias("run"), F.coalesce("n", F.lit(0)).cast("long").alias("n_lines")).coalesce(8).write.mode("append").parquet(f"{folder}/finished")
    return run


def compact(spark: SparkSession, folder: str) -> None:
    """Rewrites the runs that hold lines of documents written again, and removes those without a finished line; others stay."""
    good = packed_lines(spark, folder)
    counts = _read(spark, f"{folder}/lines", LINE).groupBy("run").agg(F.count("*").alias("all")).join(good.groupBy("run").agg(F.count("*").alias("good")), "run", "left")
    stale = [(r["run"], r["good"]) for r in counts.where("good is null or all > good").collect()]  # a row for each run
    some = [run for run, n in stale if n]
    if some:
        good.where(F.col("run").isin(some)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("run").parquet(f"{folder}/lines")
    for run in (run for run, n in stale if not n):
        files, path = files_of(spark, f"{folder}/lines/run={run}")
        files.delete(path, True)


def export_lines(spark: SparkSession, folder: str, out: str, compression: str = "gzip") -> None:
    """JSON-lines files of many documents each, side by side and their lines in order."""
    rows = packed_lines(spark, folder).repartition("file_id").sortWithinPartitions("file_id", "seq")
    rows.select("line").write.option("compression", compression).text(out)


def export_files(spark: SparkSession, folder: str, out: str) -> None:
    """``<file_id>.jsonl`` of each finished document."""
    lines = finished_packed(spark, folder).select("file_id").join(packed_lines(spark, folder).select("file_id", "seq", "line"), "file_id", "left")
    write_lines(lines, out)
