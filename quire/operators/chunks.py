"""From responses to numbered chunks: ingest, validate, normalise, recover, number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import schema
from quire.functions import text as T

RAW = ["chunk_text", "page_start", "page_end", "level_1_heading", "level_2_heading", "level_3_heading", "content_type", "continuation_status", "table_markdown", "keywords", "entities", "source_notes"]


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _nothing(v: Column, path: str) -> Column:
    """Whether a member is missing, null, or empty in the sense of Python (``""``, 0, false, [], {})."""
    kind, text = _kind(v, path), F.try_variant_get(v, path, "string")
    zero = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & text.rlike(r"^-?0*(\.0*)?$")
    empty = kind.startswith("ARRAY") & (F.size(F.try_variant_get(v, path, "array<variant>")) == 0)
    return kind.isNull() | kind.isin("VOID", "OBJECT<>") | ((kind == "STRING") & (text == "")) | zero | ((kind == "BOOLEAN") & (text == "false")) | empty


def _wrong_type(v: Column, name: str) -> Column:
    """Whether a member can't become the field ``name`` of a chunk."""
    path = f"$.{name}"
    kind = _kind(v, path)
    if name in ("keywords", "entities"):
        words = F.try_variant_get(v, path, "array<variant>")
        return ~_nothing(v, path) & ~(kind.startswith("ARRAY") & F.forall(words, lambda x: F.schema_of_variant(x) == "STRING"))
    if name in ("page_start", "page_end"):
        number = F.try_variant_get(v, path, "string").rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")
        return ~_nothing(v, path) & ~((kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)") & number) | (kind == "BOOLEAN"))
    allowed = {"content_type": schema.CONTENT_TYPES, "continuation_status": schema.CONTINUATION}.get(name)
    good = kind == "STRING"
    if allowed:
        good = good & F.try_variant_get(v, path, "string").isin(allowed)
    return ~(kind.isNull() | (kind == "VOID") | good)


def type_error(v: Column, fields: list[str] | None = None) -> Column:
    """The first field of a raw chunk (a variant) whose value a chunk can't have, or null."""
    fields = fields or RAW
    out = F.when(_wrong_type(v, fields[0]), F.lit(fields[0]))
    for name in fields[1:]:
        out = out.when(_wrong_type(v, name), F.lit(name))
    return out


def ingest(responses: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of raw chunks with ``ord`` from responses (with an ``output_text``), and ``error``: for a response that does not
    parse, is no object or whose ``chunks`` is no list of objects (one row without ``ord``), and for a chunk with a value of
    a wrong type (the field's name).

    A response without chunks gives no row. Each response is parsed once, by Spark; texts that Spark refuses though Python may
    take them (duplicate keys, NaN) are parsed by Python, which gets no others. strict: parse all in Python, for its errors.
    """
    keys = [c for c in responses.columns if c != "output_text"]
    if strict:
        rows = responses.withColumn("_j", T.strict_json(F.col("output_text")))
        rows = T.once(rows.select(*keys, F.col("_j.json").alias("_t"), F.col("_j.error").alias("_e")), "_v", F.try_parse_json("_t"))
    else:
        rows = T.once(responses, "_t", T.unfenced(F.col("output_text")))
        rows = T.once(rows, "_w", T.json_value(F.col("_t")))
        rows = T.once(rows, "_n", F.when(F.col("_w").isNotNull(), F.col("_w")).otherwise(T.json_value(T.braces(F.col("_t")))))
        rows = rows.select(*keys, "_n", T.strict_json(T.refused(F.col("output_text"), F.col("_n"))).alias("_j"))
        rows = T.once(rows, "_v", F.coalesce("_n", F.try_parse_json("_j.json"))).withColumn("_e", F.lit(None).cast("string"))
    v, found = F.col("_v"), F.try_variant_get("_v", "$.chunks", "array<variant>")
    listed = _kind(v, "$.chunks").startswith("ARRAY")
    error = (
        F.when(F.col("_e").isNotNull(), F.col("_e")).when(v.isNull(), F.lit("no JSON object in the response"))
        .when(~F.schema_of_variant(v).startswith("OBJECT"), F.lit("the response is no JSON object"))
        .when(~_nothing(v, "$.chunks") & (~listed | F.exists(found, lambda x: ~F.schema_of_variant(x).startswith("OBJECT"))), F.lit("chunks is no list of objects"))
    )
    rows = T.once(rows.select(*keys, "_v", "_e"), "_bad", error)
    rows = rows.select(*keys, F.col("_bad"), F.posexplode_outer(F.when(F.col("_bad").isNull() & listed, found)).alias("ord", "_c"))
    rows = rows.where("_bad is not null or ord is not null")
    c = F.col("_c")
    values = {name: F.try_variant_get(c, f"$.{name}", "array<string>" if name in ("keywords", "entities") else "string") for name in RAW}
    return rows.select(*keys, "ord", *(x.alias(k) for k, x in values.items()), F.coalesce("_bad", F.when(c.isNotNull(), type_error(c))).alias("error"))


def batch_summaries(responses: DataFrame) -> DataFrame:
    keys = [c for c in responses.columns if c != "output_text"]
    rows = T.once(responses, "_n", T.json_object_text(F.col("output_text")))
    text = F.coalesce("_n", T.strict_json(T.refused(F.col("output_text"), F.col("_n")))["json"])
    return rows.select(*keys, F.get_json_object(text, "$.batch_summary").alias("batch_summary"))


def invalid(content_type: str = "content_type", status: str = "continuation_status", page_start: str = "page_start", page_end: str = "page_end") -> Column:
    """The first reason why a raw chunk is not valid, or null. Null enumerations and page numbers are valid."""

    def whole(name: str) -> Column:
        c = F.col(name).cast("string")
        return c.isNull() | (c == "") | c.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$") | c.isin("true", "false")

    return (
        F.when(F.col(content_type).isNotNull() & ~F.col(content_type).isin(schema.CONTENT_TYPES), F.lit("content_type"))
        .when(F.col(status).isNotNull() & ~F.col(status).isin(schema.CONTINUATION), F.lit("continuation_status"))
        .when(~whole(page_start), F.lit("page_start"))
        .when(~whole(page_end), F.lit("page_end"))
    )


def _page(name: str, default: Column) -> Column:
    c = F.col(name).cast("string")
    number = F.when(c == "true", F.lit(1)).otherwise(c.try_cast("double").cast("int"))
    return F.coalesce(F.nullif(number, F.lit(0)), default)


def normalize(raw: DataFrame, start: Column, end: Column, recovered: Column | None = None) -> DataFrame:
    """Falsy page numbers become the batch's, null lists empty ones."""
    empty = F.array().cast("array<string>")
    out = raw.withColumns({"page_start": _page("page_start", start), "page_end": _page("page_end", end), "keywords": F.coalesce("keywords", empty), "entities": F.coalesce("entities", empty)})
    return out.withColumn("is_recovered", F.lit(False) if recovered is None else recovered)


def batch_words(chunks: DataFrame, *by: str) -> DataFrame:
    """The distinct words of each batch's texts and tables: once a batch, not once a block. Texts are dealt out before
    they are read, so that it does not matter how the table is stored."""
    body = F.concat_ws(" ", F.coalesce("chunk_text", F.lit("")), F.coalesce("table_markdown", F.lit("")))
    dealt = chunks.select(*by, body.alias("_b")).repartition(*by)
    return dealt.groupBy(*by).agg(T.significant_words(F.array_join(F.collect_list("_b"), "\n")).alias("covered"))


def find_missed_blocks(blocks: DataFrame, chunks: DataFrame, key: str = "doc_id", least: int = T.MIN_WORDS, most: float = T.MIN_COVERAGE) -> DataFrame:
    """Blocks of ``least`` distinct words or more of which the batch's chunks cover less than ``most``.

    One exchange of each side on (key, batch_no), of texts that are long enough to hold so many words; the words are read
    behind it, and the join reuses its partitioning.
    """
    long = F.char_length("text") >= T.WORD_LENGTH * least + least - 1  # words of WORD_LENGTH letters, parted by one
    words = T.once(blocks.where(long).repartition(key, "batch_no"), "_w", T.significant_words(F.col("text"))).where(F.size("_w") >= least)
    covered = batch_words(chunks, key, "batch_no")
    out = words.join(covered, [key, "batch_no"], "left")
    ratio = T.words_coverage(F.col("_w"), F.coalesce("covered", F.array().cast("array<string>")))
    return out.withColumns({"n_words": F.size("_w"), "coverage": ratio}).where(F.col("coverage") < F.lit(most)).drop("_w", "covered")


def recovered_chunks(missed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Missed blocks as chunks; their headings come from ``inherit_headings``."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    return missed.select(
        key, "batch_no", F.col("block_no").alias("ord"), F.col("text").alias("chunk_text"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"),
        none.alias("level_1_heading"), none.alias("level_2_heading"), none.alias("level_3_heading"), F.lit("paragraph").alias("content_type"),
        F.lit("partial").alias("continuation_status"), none.alias("table_markdown"), empty.alias("keywords"), empty.alias("entities"),
        F.lit(T.RECOVERED_NOTE).alias("source_notes"), F.lit(True).alias("is_recovered"),
    )


def inherit_headings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Recovered rows get level 1 and 2 of the last chunk of the model at or before them, with its nulls."""
    order = Window.partitionBy(key).orderBy("batch_no", "is_recovered", "ord").rowsBetween(Window.unboundedPreceding, 0)
    pair = F.struct(F.col("level_1_heading").alias("l1"), F.col("level_2_heading").alias("l2"))
    last = F.last(F.when(~F.col("is_recovered"), pair), ignorenulls=True).over(order)
    out = chunks.withColumn("_h", last)
    return out.withColumns({f"level_{i}_heading": F.when(F.col("is_recovered"), F.col(f"_h.l{i}")).otherwise(F.col(f"level_{i}_heading")) for i in (1, 2)}).drop("_h")


def dense_seq(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``seq`` from 0 without gaps in each document: by batch, chunks of the model first, then recovered ones."""
    return chunks.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("batch_no", "is_recovered", "ord")) - 1)


def union_recovered(chunks: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """All chunks, with the missed blocks of ``blocks`` as recovered ones, headings inherited and numbered."""
    both = chunks.unionByName(recovered_chunks(find_missed_blocks(blocks, chunks, key), key), allowMissingColumns=True)
    return dense_seq(inherit_headings(both, key), key)


def finish(chunks: DataFrame, document_id: Column, source: Column, source_url: Column, resolver: Callable[[Column, Column], Column] = T.id_resolver, keep: tuple[str, ...] = ()) -> DataFrame:
    """The chunk schema (and ``seq``, and the columns in ``keep``) from numbered chunks. A chunk's document_id is the
    resolver's; it sees the source in NFKC, stripped."""
    out = chunks.withColumns({"source": source, "source_url": F.coalesce(source_url, F.lit("")), "_given": document_id})
    seen = F.col("source") if resolver is T.id_resolver else T.strip(T.nfkc(F.col("source")))  # the default ignores it
    out = out.withColumn("document_id", resolver(seen, F.col("_given")))
    out = out.withColumn("chunk_id", T.chunk_id(F.col("document_id"), F.col("seq")))
    out = out.withColumn("embedding_text", T.embedding_text(*(F.col(c) for c in ("source", "level_1_heading", "level_2_heading", "level_3_heading", "keywords", "entities", "chunk_text"))))
    out = out.withColumn("metadata", F.struct(*schema.METADATA_FIELDS))
    return out.select(*keep, "seq", *(F.col(c).cast(t) if c != "metadata" else c for c, t in schema.CHUNK_FIELDS.items()))


def document_status(raw: DataFrame, key: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """status, error, n_chunks of each document: one bad chunk or response fails the whole document. With ``documents``
    also those without any chunk are told."""
    bad = F.coalesce(F.col("error"), invalid()) if "error" in raw.columns else invalid()
    out = raw.groupBy(key).agg(F.min(bad).alias("error"), F.count("*").alias("n_chunks"))
    if documents is not None:
        out = documents.select(key).distinct().join(out, key, "left")
    return out.select(key, F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", F.when(F.col("error").isNull(), F.coalesce("n_chunks", F.lit(0))).otherwise(0).alias("n_chunks"))


def only_sound(chunks: DataFrame, status: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.join(status.where("status = 'failed'"), key, "left_anti")


def carry_context(batches: DataFrame, key: str = "doc_id") -> DataFrame:
    """previous_batch_summary (last nonempty one before) and, where there is a ``last_chunk``, previous_last_chunk."""
    before = Window.partitionBy(key).orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    out = batches.withColumn("previous_batch_summary", F.coalesce(F.last(T.falsy(F.col("batch_summary")), ignorenulls=True).over(before), F.lit("")))
    if "last_chunk" in batches.columns:
        out = out.withColumn("previous_last_chunk", F.coalesce(F.last("last_chunk", ignorenulls=True).over(before), F.lit("")))
    return out
