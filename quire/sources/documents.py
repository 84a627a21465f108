"""Sources: text and HTML tables, chunk files, PDF folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import schema
from quire.functions.text import in_brackets, once, only_value, strip

LINES_PER_PAGE, PAGES_PER_BATCH = 5, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no, page_num, batch_no, text: a line is a block, LINES_PER_PAGE lines a page."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    page = (F.floor(F.col("block_no") / LINES_PER_PAGE) + 1).cast("int")
    out = lines.withColumn("text", strip(F.col("text"))).where("text <> ''").withColumn("page_num", page)
    return out.withColumn("batch_no", F.floor((F.col("page_num") - 1) / PAGES_PER_BATCH).cast("int")).select("doc_id", "block_no", "page_num", "batch_no", "text")


# what ends a paragraph that has no end tag
_ENDS = "address|article|aside|blockquote|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|pre|section|table|ul"
HIDDEN_RE = r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->"
PARAGRAPH_RE = r"(?is)<p(?:\s[^>]*)?>"
TO_END_RE = rf"(?is)^(.*?)(?:</(?:p|article|body|div|main|section)\b|<(?:{_ENDS})\b|\z)"
TAG_RE = r"(?s)<[^>]*>"


_MASK = "\0"  # stands for a < that begins nothing; markup can't hold it


def _masked(markup: Column, last: str, start: str) -> Column:
    """``markup`` with _MASK for the ``<`` of what looks like ``start`` behind the last match of ``last``, without which it
    begins nothing. So every start that is left has an end, and a pattern over both reads no text twice."""
    head = F.regexp_extract(markup, f"(?is)^.*{last}", 0)
    return F.concat(head, F.regexp_replace(F.substring(markup, F.length(head) + 1, F.length(markup)), f"(?i)<(?={start})", _MASK))


def _unmasked(markup: Column) -> Column:
    return F.translate(markup, _MASK, "<")


def plain(markup: Column) -> Column:
    """Markup without its tags, the usual entities resolved."""
    x = _unmasked(F.regexp_replace(_masked(markup, ">", ""), TAG_RE, ""))
    # fixed values: the entities that ``html_escape`` writes, the ampersand last
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return strip(x)


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, text: the paragraphs of web pages, with the text of the tags inside them. One ends at its end
    tag, at the next paragraph or block, or where what holds it ends."""
    ended = _masked(_masked(F.col("html"), "-->", "!--"), r"</(?:script|style)\s*>", r"(?:script|style)\b")
    visible = _masked(_unmasked(F.regexp_replace(ended, HIDDEN_RE, "")), ">", r"p\s")
    parts = pages.select("page_id", F.posexplode(F.split(visible, PARAGRAPH_RE)).alias("block_no", "part")).where("block_no > 0")
    parts = parts.withColumn("part", _unmasked(F.col("part")))
    out = parts.select("page_id", (F.col("block_no") - 1).alias("block_no"), plain(F.regexp_extract("part", TO_END_RE, 1)).alias("text"))
    return out.where("text <> ''")


def html_headings(pages: DataFrame) -> DataFrame:
    """page_id, level_1 (the first h1), level_2 (the first b), with the text of the tags inside them."""

    def first(tag: str) -> Column:
        ended = _masked(F.col("html"), rf"</{tag}\s*>", rf"{tag}[\s>]")
        return plain(_unmasked(F.regexp_extract(ended, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)))

    return pages.select("page_id", first("h1").alias("level_1"), first("b").alias("level_2"))


def chunk_error(v: Column) -> Column:
    """The first member of a chunk line (a variant) that the chunk schema does not allow, or null."""
    kind = F.schema_of_variant(v)
    out = F.when(v.isNull() | ~kind.startswith("OBJECT"), F.lit("line"))
    for where, fields in (("$", schema.CHUNK_FIELDS), ("$.metadata", schema.METADATA_FIELDS)):
        for name, t in fields.items():
            path = f"{where}.{name}"
            found, text = F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.try_variant_get(v, path, "string")
            missing = found.isNull()
            if name == "metadata":
                out = out.when(missing | ~found.startswith("OBJECT"), F.lit(path))
            elif t == "array<string>":
                out = out.when(~missing & ~(found.startswith("ARRAY") & F.forall(F.try_variant_get(v, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")), F.lit(path))
            elif t == "int":
                whole = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING)") & text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")
                out = out.when(missing | ~(whole | (found == "BOOLEAN")), F.lit(path))
            elif name in ("chunk_id", "document_id", "source"):
                out = out.when(missing | (found != "STRING"), F.lit(path))
            elif name in ("source_url", "embedding_text"):
                out = out.when(~missing & (found != "STRING"), F.lit(path))
            else:
                allowed = {"content_type": schema.CONTENT_TYPES, "continuation_status": schema.CONTINUATION}.get(name)
                good = found == "STRING"
                out = out.when(~missing & (found != "VOID") & ~(good & text.isin(allowed) if allowed else good), F.lit(path))
    return out


def _usual() -> str:
    """What ``schema_of_variant`` tells of a line that has all fields with values of their usual types."""

    def shape(fields: dict[str, str]) -> str:
        kinds = {"int": "BIGINT", "array<string>": "ARRAY<(?:STRING|VOID)>"}
        never_null = ("chunk_id", "document_id", "source", "source_url", "embedding_text")
        of = lambda name, t: shape(schema.METADATA_FIELDS) if name == "metadata" else kinds.get(t) or ("STRING" if name in never_null else "(?:STRING|VOID)")
        return "OBJECT<" + ", ".join(f"{name}: {of(name, t)}" for name, t in sorted(fields.items())) + ">"

    return rf"^{shape(schema.CHUNK_FIELDS)}\z"


def surely_valid(v: Column) -> Column:
    """Whether a chunk line is as lines mostly are, so that ``chunk_error`` has nothing to find: all fields with their usual
    types, told by one look at the shape of the whole line; then only lists and enumerations are left to check."""
    string = lambda path: F.try_variant_get(v, path, "string")
    enums = [(f"{where}.{name}", allowed) for where in ("$", "$.metadata") for name, allowed in (("content_type", schema.CONTENT_TYPES), ("continuation_status", schema.CONTINUATION))]
    out = F.schema_of_variant(v).rlike(_usual())
    for path, allowed in enums:
        out = out & F.coalesce(string(path).isin(allowed), F.lit(True))
    for name in ("keywords", "entities"):  # a null among strings does not show in the shape
        out = out & F.forall(F.try_variant_get(v, f"$.{name}", "array<string>"), lambda x: x.isNotNull())
    return F.coalesce(out, F.lit(False))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, line, value: the lines of text files that are not blank; in each file (block, line) is their order.

    Spark splits large files; block is where a line's split begins, and inside a split numbers go up with the lines.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where(strip(F.col("value")) != "").withColumn("line", F.monotonically_increasing_id())


def parse_chunks(lines: DataFrame, strict: bool = True) -> DataFrame:
    """The chunks of lines (``value``) with the other columns. strict: a bad line or invalid chunk raises; else what does
    not fit is null."""
    kept = [c for c in lines.columns if c != "value"]
    if strict:
        lines = once(lines, "_both", in_brackets(strip(F.col("value"))))
        lines = once(lines, "_v", only_value(F.col("_both"))).drop("_both")
        lines = once(lines, "_e", F.when(~surely_valid(F.col("_v")), chunk_error(F.col("_v"))))
        lines = lines.select(*kept, F.when(F.col("_e").isNotNull(), F.raise_error(F.concat(F.lit("invalid chunk: "), "_e", F.lit(" in "), F.substring("value", 1, 200)))).otherwise(F.col("value")).alias("value"))
    parsed = lines.select(*kept, F.from_json("value", schema.CHUNK, {"mode": "PERMISSIVE"}).alias("_c")).select(*kept, "_c.*")
    if strict:  # defaults of the schema
        empty = F.array().cast("array<string>")
        parsed = parsed.withColumns({"keywords": F.coalesce("keywords", empty), "entities": F.coalesce("entities", empty), "source_url": F.coalesce("source_url", F.lit("")), "embedding_text": F.coalesce("embedding_text", F.lit(""))})
    return parsed


def scan_chunks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chunks of a JSON-lines file or folder, blank lines skipped, with ``seq``: their places (from 0) among those of their
    document in their file, in the order of lines, whatever the ids are. strict: see ``parse_chunks``."""
    order = Window.partitionBy("file", "document_id").orderBy("block", "line")
    found = parse_chunks(file_lines(spark, path), strict)
    return found.withColumn("seq", (F.row_number().over(order) - 1).cast("int")).drop("file", "block", "line")


def scan_pdf_dir(spark: SparkSession, path: str) -> DataFrame:
    """path, document_id, source, content of the ``*.pdf`` files right in a folder (folders inside are not looked at),
    without an order: sort the paths, not the contents. A folder that does not exist raises; one without such files is empty."""
    from quire.functions.text import safe_stem, stem

    reader = spark.read.format("binaryFile")
    files = reader.load(path) if path.endswith(".pdf") else reader.option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", safe_stem(F.col("path")).alias("document_id"), stem(F.col("path")).alias("source"), "content")


#: (bytes) -> list of pages: {"text": str, "blocks": [(x0, y0, x1, y1, text, block_no, block_type)], "words": [...], "png": bytes}
PdfReader = Callable[[bytes, float], list[dict]]


def mupdf_reader(content: bytes, zoom: float) -> list[dict]:
    """The default reader; it needs the optional PyMuPDF library (not installed here, so untested against it)."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return [{"text": p.get_text(), "blocks": p.get_text("blocks"), "words": p.get_text("words"), "png": p.get_pixmap(matrix=fitz.Matrix(zoom, zoom), alpha=False).tobytes("png")} for p in doc]


PAGE = "path string, document_id string, source string, page_num int, n_pages int, text string, blocks array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block_no:int>>, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string,block_no:int,line_no:int,word_no:int>>, png binary"


def pdf_pages(files: DataFrame, reader: PdfReader = mupdf_reader, zoom: float = 2.0) -> DataFrame:
    """One row for each page (PAGE): each file is opened once for text, blocks, words and image."""

    box = ("x0", "y0", "x1", "y1", "text", "block_no")
    place = (*box, "line_no", "word_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {c: pa.float64() for c in box[:4]} | {"text": pa.string()} | {c: pa.int32() for c in ("block_no", "line_no", "word_no")}
        listed = lambda names: pa.list_(pa.struct([(c, kinds[c]) for c in names]))
        page = pa.schema([*((c, pa.string()) for c in ("path", "document_id", "source")), ("page_num", pa.int32()), ("n_pages", pa.int32()), ("text", pa.string()), ("blocks", listed(box)), ("words", listed(place)), ("png", pa.binary())])
        for b in batches:
            for i in range(b.num_rows):
                at = {c: b.column(c)[i].as_py() for c in ("path", "document_id", "source")}
                pages = reader(b.column("content")[i].as_py(), zoom)
                rows = [
                    {
                        **at, "page_num": k, "n_pages": len(pages), "text": p["text"],
                        "blocks": [dict(zip(box, x[:6], strict=True)) for x in p["blocks"]], "words": [dict(zip(place, x[:8], strict=True)) for x in p["words"]], "png": p["png"],
                    }
                    for k, p in enumerate(pages, 1)
                ]
                yield pa.RecordBatch.from_pylist(rows, page)

    return files.mapInArrow(run, PAGE)
