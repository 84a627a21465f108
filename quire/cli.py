"""Command line: ``parse <pdf or folder>`` and ``outline <chunk file or folder>``."""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import outline as O
from quire.operators import pages as P
from quire.plans import process as R
from quire.sinks import chunks as S
from quire.sources import documents as D


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    parse = commands.add_parser("parse", help="PDF files to chunk files")
    parse.add_argument("path")
    parse.add_argument("--output-dir", default="data/processed")
    parse.add_argument("--model")
    parse.add_argument("--outline-model", help="for the outline; default: the model")
    parse.add_argument("--batch-size", type=int, default=2)
    parse.add_argument("--zoom", type=float, default=2.0)
    parse.add_argument("--overwrite", action="store_true")
    outline = commands.add_parser("outline", help="the heading tree of a chunk file")
    outline.add_argument("path")
    return out


def process_documents(spark: SparkSession, path: str, output_dir: str, backend: R.Backend, model: str | None = None, outline_model: str | None = None, batch_size: int = 2, zoom: float = 2.0, overwrite: bool = False, source_urls: dict[str, str] | None = None, resolver=T.id_resolver, reader: D.PdfReader = D.mupdf_reader, chunk_template: str = T.CHUNK_TEMPLATE, outline_template: str = T.OUTLINE_TEMPLATE) -> list[str]:
    """The chunk files (``<document_id>.jsonl``) of the documents of a folder of PDFs (or of one file) that are there in the end.

    Responses are written before use, next to the output, so that no request is made twice; that folder is the run's own
    and goes in the end. A document that fails leaves no file, and the others alone.
    """
    model = R.model_name(model)
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    files = D.scan_pdf_dir(spark, path).withColumn("doc_id", F.col("path"))
    todo = S.skip_existing(files, S.finished(spark, output_dir), "document_id", overwrite)
    work = f"{output_dir.rstrip('/')}/_run-{uuid.uuid4().hex}"

    def kept(df, name):
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    pages = kept(D.pdf_pages(todo, reader, zoom).withColumn("doc_id", F.col("path")), "pages")
    urls = spark.createDataFrame(list((source_urls or {}).items()), "document_id string, source_url string")
    docs = pages.groupBy("doc_id", "document_id", "source").agg(F.max("n_pages").alias("n_pages")).join(urls, "document_id", "left").withColumn("source_url", F.coalesce("source_url", F.lit("")))
    docs = kept(docs, "documents")
    images = F.transform(F.array_sort(F.collect_list(F.struct("page_num", "png"))), lambda x: T.image_url(x["png"]))
    whole = pages.groupBy("doc_id", "document_id", "source").agg(images.alias("images")).join(P.page_text(pages, "doc_id").withColumnRenamed("page_text", "text"), "doc_id")
    outlines = kept(R.live_outlines(whole, backend, outline_model or model, template=outline_template), "outlines")
    batched = P.page_batches(pages, F.col("n_pages"), batch_size)
    keys = ["doc_id", "batch_no"]
    batches = batched.groupBy(*keys, "document_id", "source", "page_start", "page_end").agg(images.alias("images")).join(P.page_text(batched, *keys), keys)
    batches = batches.join(outlines.where("error is null").select("doc_id", F.col("outline").alias("known_outline")), "doc_id")
    responses = kept(R.live_responses(batches, backend, model, template=chunk_template), "responses")
    bad = outlines.where("error is not null").select("doc_id").union(responses.where("error is not null").select("doc_id")).distinct()
    blocks = P.page_blocks(batched.select("doc_id", "batch_no", "page_num", F.explode("blocks").alias("b")).select("doc_id", "batch_no", "page_num", "b.block_no", "b.text"))
    sound = docs.join(bad, "doc_id", "left_anti")
    good = responses.join(bad, "doc_id", "left_anti").drop("error")
    chunks, status = R.process(blocks.join(bad, "doc_id", "left_anti"), good, sound, resolver, batch_size)
    done = sound.join(status.where("status = 'ok'"), "doc_id", "left_semi")
    done = done.groupBy(F.col("document_id").alias("file_id")).agg(F.min("doc_id").alias("doc_id"))  # of files with one name after slugging the first counts
    S.write_jsonl(kept(chunks, "chunks"), kept(done, "done"), output_dir)
    files_, top = S.files_of(spark, work)
    files_.delete(top, True)
    mine = D.scan_pdf_dir(spark, path).select("document_id")
    return sorted(f"{output_dir.rstrip('/')}/{r[0]}.jsonl" for r in S.finished(spark, output_dir).join(mine, "document_id", "left_semi").select("document_id").toLocalIterator())


def process_pdf(spark: SparkSession, path: str, output_dir: str, backend: R.Backend, **options) -> str:
    """The chunk file of one PDF; options as for ``process_documents``. RuntimeError if the document fails."""
    found = process_documents(spark, path, output_dir, backend, **options)
    if not found:
        raise RuntimeError(f"{path} has given no chunk file: a response or chunk was not valid, or the file is empty")
    return found[0]


def outline_lines(spark: SparkSession, path: str) -> DataFrame:
    """document_id, position, line: the heading trees of a folder of chunk files, line by line."""
    return O.outline_lines(O.outline_nodes(D.scan_chunks(spark, path), "document_id"), "document_id")


def print_outlines(spark: SparkSession, path: str) -> None:
    """The outlines in the order of the documents' ids: sorted over ranges, and read range by range, so that the driver
    holds one of them at a time."""
    for row in outline_lines(spark, path).orderBy("document_id", "position").toLocalIterator():
        print(row["line"])


def main(args: list[str] | None = None) -> None:
    R.load_env()
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if a.command == "outline":
        print_outlines(spark, a.path)
        return
    if not os.path.exists(a.path):
        raise SystemExit(f"{a.path} is neither a file nor a folder")

    def client():
        from openai import OpenAI

        return OpenAI()

    for p in process_documents(spark, a.path, a.output_dir, R.Responses(client), a.model, a.outline_model, a.batch_size, a.zoom, a.overwrite):
        print(p)


if __name__ == "__main__":
    main()
