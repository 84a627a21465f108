"""Sinks: chunk files, skipping of finished documents, reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema
from quire.functions import text as T
from quire.operators import layout as L
from quire.operators import outline as O


def skip_existing(documents: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    return documents if overwrite else documents.join(done.select(key).distinct(), key, "left_anti")


def files_of(spark: SparkSession, folder: str):
    """The folder's file system and path, of whatever store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, path of the chunk files of a folder, listed by Spark; their contents are not read."""
    files, path = files_of(spark, folder)
    if not files.exists(path):
        return spark.createDataFrame([], "document_id string, path string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    return found.select(T.stem(F.col("path")).alias("document_id"), "path")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """document_id, seq, line: compact JSON in the declared order with explicit nulls."""
    return chunks.select("document_id", "seq", chunk_json().alias("line"))


def chunk_json() -> Column:
    return F.to_json(F.struct(*schema.CHUNK_FIELDS), {"ignoreNullFields": "false"})


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and place that Hadoop's default file system gives it, which listings use as well."""
    files, path = files_of(spark, folder)
    found = files.makeQualified(path).toString()
    return f"file://{found[5:]}" if found.startswith("file:/") and not found.startswith("file://") else found


def _direct(spark: SparkSession, folder: str) -> bool:
    """Whether workers can open the folder's store by themselves, and all see the same one: a local disk only if they are
    the driver's own."""
    if folder.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
        return False
    try:
        pafs.FileSystem.from_uri(folder)
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


def _written_by_workers(rows: DataFrame, folder: str, work: str) -> None:
    """A file for each ``file_id`` of rows that are sorted by it, first under another name, then in its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        aside = pafs.FileSystem.from_uri(work)[1]
        store.create_dir(aside, recursive=True)
        now, out, done = None, None, 0
        temporary = f"{aside}/{uuid.uuid4().hex}"  # a task's own, however often it is tried

        def close() -> None:
            out.close()
            store.move(temporary, f"{top}/{now}.jsonl")

        for b in batches:
            for name, line in zip(b.column("file_id").to_pylist(), b.column("value"), strict=True):
                if name != now:
                    if out is not None:
                        close()
                    now, out, done = name, store.open_output_stream(temporary), done + 1
                out.write(line.as_py().encode() + b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    rows.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _written_by_spark(rows: DataFrame, folder: str, work: str) -> None:
    """The same by Spark's writer, for stores that only Spark opens; the driver renames file by file."""
    spark = rows.sparkSession
    rows.write.option("lineSep", "\n").partitionBy("file_id").text(work)
    files, top = files_of(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for entry in files.listStatus(path(work)):
        if entry.isDirectory():
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(entry.getPath().getName()).partition("=")[2]
            target = path(top, f"{name}.jsonl")
            files.delete(target, False)
            part = next(f.getPath() for f in files.listStatus(entry.getPath()) if f.getPath().getName().startswith("part-"))
            files.rename(part, target)


def write_jsonl(chunks: DataFrame, documents: DataFrame, folder: str) -> None:
    """``<file_id>.jsonl`` for each of ``documents`` (key ``doc_id``, ``file_id``), its chunks (``doc_id``) in order; a document
    without chunks gets a file with a blank line, which readers skip (Spark does not list files without a byte).

    A document's lines are sorted and written by one task, beside the results, and get their place by a rename, so a file
    is there as a whole or not at all, and a task that is tried again writes the same. Where workers can't open the store, or
    would each write to a disk of their own, Spark writes and the driver renames. A file for each document suits thousands of them;
    ``quire.sinks.packed`` keeps any number in few files.
    """
    lines = chunks.select("doc_id", "seq", chunk_json().alias("line"))
    write_lines(documents.select("doc_id", "file_id").join(lines, "doc_id", "left"), folder)


def write_lines(named: DataFrame, folder: str) -> None:
    """``<file_id>.jsonl`` of each file_id, its lines (seq, line) in order; null lines are left out."""
    spark = named.sparkSession
    folder = _qualified(spark, folder)
    rows = named.repartition("file_id").sortWithinPartitions("file_id", "seq").select("file_id", F.coalesce("line", F.lit("")).alias("value"))
    work = f"{folder.rstrip('/')}/_work-{uuid.uuid4().hex}"
    files, top = files_of(spark, folder)
    files.mkdirs(top)
    (_written_by_workers if _direct(spark, folder) else _written_by_spark)(rows, folder, work)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(work), True)


def write_files(rows: DataFrame, folder: str, shared: bool = False) -> None:
    """A file of each row (name, content: bytes) in a folder; a task that is tried again writes the same. Workers write them
    side by side where they can open the store. shared: a ``file:`` folder is one for all workers, too. Else the driver writes
    file by file."""
    spark = rows.sparkSession
    folder = _qualified(spark, folder)
    files, top = files_of(spark, folder)
    files.mkdirs(top)
    if not (_direct(spark, folder) or (shared and folder.startswith("file:"))):
        for name, content in rows.select("name", "content").toLocalIterator():
            stream = files.create(spark._jvm.org.apache.hadoop.fs.Path(top, name), True)
            stream.write(bytearray(content))
            stream.close()
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pafs.FileSystem.from_uri(folder)
        done = 0
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(content.as_py())
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    # small tables are few tasks otherwise: what counts is the number of files, not their bytes
    rows.select("name", "content").repartition(4 * spark.sparkContext.defaultParallelism, "name").mapInArrow(run, "files long").agg(F.sum("files")).collect()


def section_colors(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title, color of each document's sections, in their order of appearance."""
    order = L.section_order(chunks, key, T.section_key(F.col("level_1_heading"), F.col("level_2_heading")), "seq")
    return order.select(key, "title", T.section_color(F.col("rank")).alias("color"))


def page_note(page_start: Column, pages: Column) -> Column:
    """Where a chunk stands, if not (only) on its declared page. pages: the matched ones, sorted."""
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    spans = F.concat(F.lit("on pages "), listed, F.lit(", labelled "), page_start.cast("string"))
    return F.when(F.size(pages) > 1, spans).when((F.size(pages) == 1) & (F.get(pages, F.lit(0)) != page_start), F.concat(F.lit("on page "), listed, F.lit(", labelled "), page_start.cast("string")))


def card_html(number: Column, color: Column, note: Column) -> Column:
    """A chunk as a card: number, kind, id, headings, note, text or table, keywords."""
    body = F.when(F.coalesce(F.col("table_markdown"), F.lit("")) != "", T.table_md_to_html(F.col("table_markdown"))).otherwise(F.concat(F.lit("<p>"), T.html_escape(F.coalesce("chunk_text", F.lit(""))), F.lit("</p>")))
    words = F.array_join("keywords", ", ")
    parts = [
        F.lit('<div class="card" id="chunk-'), number.cast("string"), F.lit('" style="--accent: '), color, F.lit('"><b>'), number.cast("string"), F.lit("</b> <i>"), T.html_escape(F.coalesce(T.falsy(F.col("content_type")), F.lit("mixed"))),
        F.lit("</i> <code>"), T.html_escape(F.col("chunk_id")), F.lit("</code><h4>"), T.heading_breadcrumb(F.col("level_1_heading"), F.col("level_2_heading"), F.col("level_3_heading")), F.lit("</h4>"),
        F.coalesce(F.concat(F.lit('<div class="note">'), note, F.lit("</div>")), F.lit("")), body, F.when(F.coalesce(words, F.lit("")) != "", F.concat(F.lit('<div class="keywords">'), T.html_escape(words), F.lit("</div>"))).otherwise(F.lit("")), F.lit("</div>"),
    ]
    return F.concat(*parts)


def outline_html(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, outline: the heading tree as a list with links to the chunks' numbers, titles in their sections' colors (a
    title without one has that of the node above it). chunks: with number."""
    nodes = O.node_colors(O.chunk_numbers(O.outline_nodes(chunks, key), chunks, key), section_colors(chunks, key), key)
    links = F.array_join(F.transform("numbers", lambda n: F.concat(F.lit('<a href="#chunk-'), n.cast("string"), F.lit('">'), n.cast("string"), F.lit("</a>"))), "")
    style = F.coalesce(F.concat(F.lit(' style="color:'), F.col("color"), F.lit('"')), F.lit(""))
    item = F.concat(F.lit('<li class="l'), F.col("level").cast("string"), F.lit('"><span'), style, F.lit(">"), T.html_escape(F.col("title")), F.lit("</span>"), links, F.lit("</li>"))
    placed = nodes.withColumn("_o", O.node_order(key)).withColumn("_i", item)
    items = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i"))), lambda x: x["_i"])
    return placed.groupBy(key).agg(F.concat(F.lit("<ul>"), F.array_join(items, ""), F.lit("</ul>")).alias("outline"))


def report_html(chunks: DataFrame, key: str = "doc_id", matches: DataFrame | None = None) -> DataFrame:
    """key, html: a report for each document: its outline, and its chunks as cards, page after page, those in a row with
    one heading (levels 2 and 3) in a group of their section's color. matches: key, seq, page_num of matched pages."""
    numbered = chunks.withColumn("number", F.col("seq").cast("long") + 1)
    colors = section_colors(numbered, key)
    numbered = numbered.withColumn("title", T.section_key(F.col("level_1_heading"), F.col("level_2_heading"))).join(colors, [key, "title"])
    if matches is None:
        numbered = numbered.withColumn("_pages", F.array().cast("array<int>"))
    else:
        pages = matches.groupBy(key, "seq").agg(F.array_sort(F.collect_set("page_num")).alias("_pages"))
        numbered = numbered.join(pages, [key, "seq"], "left").withColumn("_pages", F.coalesce("_pages", F.array().cast("array<int>")))
    heading = T.heading_group_key(F.col("level_2_heading"), F.col("level_3_heading"))
    runs = L.consecutive_groups(numbered.withColumn("_k", F.struct(F.col(key), F.col("page_start"))), "_k", heading, "seq")
    card = card_html(F.col("number"), F.col("color"), page_note(F.col("page_start"), F.col("_pages")))
    cards = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), card.alias("c")))), lambda x: x["c"]), "\n")
    label = F.coalesce(T.falsy(T.heading_breadcrumb(F.col("level_2_heading"), F.col("level_3_heading"))), F.lit("No heading"))
    first = F.min(F.struct("seq", label.alias("label"), "color"))
    groups = runs.groupBy(key, "page_start", "run").agg(cards.alias("cards"), first.alias("f"))
    group = F.concat(F.lit('<div class="group" style="--group-color: '), F.col("f.color"), F.lit('"><h3>'), F.col("f.label"), F.lit("</h3>"), F.col("cards"), F.lit("</div>"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("page_start", "run", group.alias("g")))), lambda x: x["g"])
    body = groups.groupBy(key).agg(F.array_join(shown, "\n").alias("_body"))
    whole = body.join(outline_html(numbered, key), key, "left")
    return whole.select(key, F.concat(F.lit("<!doctype html><body>"), F.coalesce("outline", F.lit("")), F.col("_body"), F.lit("</body>")).alias("html"))
