"""Scalar functions as Column expressions; Python (Arrow) only where Spark has no equivalent."""

from __future__ import annotations

import json
import math
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# fixed values: the 29 code points that Python's str.strip() removes
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
# fixed values: what Python's str.splitlines() takes for a line's end
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MIN_WORDS, MIN_COVERAGE = 15, 0.3
WORD_LENGTH = 4  # letters that a word needs to count
# fixed values: what stands in for a missing text, and the note of a recovered chunk
NO_PAGE_TEXT = "(no text layer for this page range)"
NO_OUTLINE = "(none established -- infer headings from this page layout)"
NO_DOCUMENT_TEXT = "(no text layer for this document)"
RECOVERED_NOTE = "Auto-recovered: present in the source but omitted from the VLM's own chunking output for this batch."


def once(df: DataFrame, name: str, x: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, wherever and however often it is used: the optimizer moves no
    expression through an explode."""
    return df.select("*", F.explode(F.array(x)).alias(name))


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def falsy(x: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(x, F.lit(""))


def significant_words(text: Column) -> Column:
    """Distinct runs of four or more of a-z, 0-9 and Hangul syllables, A-Z in lower case. Null for null."""
    # ``lower`` is much faster than ``translate``; of other signs it makes a-z only of the Kelvin sign and the dotted I
    lower = F.when(text.contains("\u212a") | text.contains("\u0130"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(f"[a-z0-9가-힣]{{{WORD_LENGTH},}}+"), F.lit(0)))


def significant_word_count(text: Column) -> Column:
    return F.size(significant_words(text))


def words_coverage(source: Column, covered: Column) -> Column:
    """Share of the words ``source`` in ``covered`` (both distinct); 1 if there are none."""
    return F.when(F.size(source) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(source, covered)) / F.size(source))


def coverage_ratio(text: Column, texts: Column) -> Column:
    """texts: array of strings."""
    return words_coverage(significant_words(text), significant_words(F.array_join(texts, " ")))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def slug_of_normalized(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"[^\p{L}\p{N}_.-]+", "_"), F.lit("_"))


def slugify(x: Column) -> Column:
    """NFKC, other characters than letters, digits, ``_.-`` to ``_``, and no ``_`` at the ends; may be empty."""
    return slug_of_normalized(nfkc(x))


def slugify_plain(x: Column) -> Column:
    """``slugify`` for text that NFKC leaves alone (see ``normalized_already``), without Python."""
    return slug_of_normalized(x)


# fixed values: ASCII, Latin letters, Greek and Cyrillic letters, kana, Han, Hangul syllables: NFKC keeps any string of these
_STABLE = r"\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u03B1-\u03C9\u0400-\u0481\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"


def normalized_already(x: Column) -> Column:
    """Whether a text consists of letters and signs that NFKC surely leaves alone; null for null."""
    return x.rlike(f"^[{_STABLE}]*\\z")


def slugified(rows: DataFrame, x: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the ``slugify`` of column ``x``; only texts that NFKC may change go to Python, and none if
    there are none (which reads ``x`` once more)."""
    plain = F.coalesce(normalized_already(F.col(x)), F.lit(True))
    other = rows.where(~plain)
    out = rows.where(plain).withColumn(name, slugify_plain(F.col(x)))
    return out if other.isEmpty() else out.unionByName(other.withColumn(name, slugify(F.col(x))))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def safe_stem(path: Column) -> Column:
    return slugify(stem(path))


def id_resolver(source: Column, document_id: Column) -> Column:
    """The default resolver: the document id in lower case with ``_`` for all but a-z and 0-9, or ``document``."""
    return F.coalesce(falsy(F.btrim(F.regexp_replace(F.lower(document_id), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("document"))


def chunk_id(resolved: Column, seq: Column) -> Column:
    return F.concat(resolved, F.lit("_"), seq.cast("string"))


def embedding_text(source: Column, level_1: Column, level_2: Column, level_3: Column, keywords: Column, entities: Column, text: Column) -> Column:
    """Six header lines, a blank one, and the text; stripped as a whole."""
    blank = F.lit("")
    lines = [("source", source), ("title", level_1), ("section", level_2), ("topic", level_3), ("keywords", F.array_join(keywords, ", ")), ("entities", F.array_join(entities, ", "))]
    parts = [p for k, v in lines for p in (F.lit(f"{k}: "), F.coalesce(v, blank), F.lit("\n"))]
    return strip(F.concat(*parts, F.lit("\ncontent:\n"), F.coalesce(text, blank)))


def unfenced(text: Column) -> Column:
    """A response without white space around it and without a fence, if it has one."""
    t = strip(text)
    bare = strip(F.regexp_replace(strip(F.regexp_replace(t, r"^```(json)?", "")), r"```$", ""))
    return F.when(t.startswith("```"), bare).otherwise(t)


def in_brackets(t: Column) -> Column:
    """A text as a JSON value in an array, or null; in brackets, as what follows a value would not be seen else."""
    return F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))


def only_value(both: Column) -> Column:
    """The value of an array that holds one, else null."""
    return F.when(F.try_variant_get(both, "$[1]", "variant").isNull(), F.try_variant_get(both, "$[0]", "variant"))


def json_value(t: Column) -> Column:
    """A whole text as a JSON value, or null."""
    return only_value(in_brackets(t))


def braces(t: Column) -> Column:
    """From the first { to the last }, or an empty string."""
    return F.regexp_extract(t, r"(?s)\{.*\}", 0)


def json_object_text(text: Column) -> Column:
    """The JSON of a response: without a fence if it has one; if that does not parse, from the first { to the last };
    null where neither parses by Spark, which refuses duplicate keys and NaN (see ``refused``)."""
    t = unfenced(text)
    return F.when(json_value(t).isNotNull(), t).when(json_value(braces(t)).isNotNull(), braces(t))


def refused(text: Column, native: Column) -> Column:
    """The text, if Spark's parser has refused it (``native`` is null) and Python's may still take it; else null."""
    return F.when(native.isNull() & text.rlike(r"[{\[]|NaN|Infinity"), text)


def extract_json(text: str) -> object:
    """The strict rule in Python, for single responses: raises ValueError without an object and JSONDecodeError for a
    broken one."""
    t = text.strip()
    if t.startswith("```"):
        t = t.removeprefix("```").removeprefix("json").strip().removesuffix("```").strip()
    try:
        return json.loads(t)
    except json.JSONDecodeError:
        first, last = t.find("{"), t.rfind("}")
        if first < 0 or last < first:
            raise ValueError(f"no JSON object in the response: {t[:1000]}") from None
        return json.loads(t[first : last + 1])


def finite(x: object, holder: type = dict) -> object:
    """A parsed value without NaN and infinities, which JSON can't tell: each becomes something that no field may be, an object in
    an object, a list in a list."""
    if isinstance(x, dict):
        return {k: finite(v, dict) for k, v in x.items()}
    if isinstance(x, list):
        return [finite(v, list) for v in x]
    return ({"number": None} if holder is dict else [None]) if isinstance(x, float) and not math.isfinite(x) else x


@F.pandas_udf(StructType().add("json", StringType()).add("error", StringType()))
def strict_json(x: pd.Series) -> pd.DataFrame:
    """The parsed response as canonical JSON, or the error, by ``extract_json``."""
    rows = []
    for t in x:
        try:
            value = None if t is None else extract_json(t)
            rows.append((None if t is None else json.dumps(value if isinstance(value, float) else finite(value), ensure_ascii=False), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["json", "error"])


@F.pandas_udf(StringType())
def last_item_json(x: pd.Series) -> pd.Series:
    """The last element of the array ``chunks`` of a response's JSON, with ``, `` and ``: ``, keys in their order."""

    def last(t: str | None) -> str | None:
        chunks = (json.loads(t) or {}).get("chunks") if t else None
        return json.dumps(chunks[-1], ensure_ascii=False) if chunks else None

    return x.map(last)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacements of ``{{key}}``, one after the other: a later key also fills in earlier values."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


CHUNK_TEMPLATE = """Split the pages into retrieval chunks and answer with one JSON object: {"document_id", "source", "page_range", "batch_summary", "chunks": [...]}.
Each chunk has: chunk_text, page_start, page_end, level_1_heading, level_2_heading, level_3_heading, content_type (paragraph, table, boxed_section, footnote, figure, mixed), continuation_status (new, continues, partial), table_markdown, keywords, entities, source_notes.
Copy text word for word, leave no paragraph out, and use the headings of the outline.

Document: {{document_id}} ({{source}}), pages {{page_start}} to {{page_end}}
Summary of the pages before: {{previous_batch_summary}}
Last chunk before: {{previous_last_chunk}}
Outline:
{{known_outline}}
Text of the pages:
{{extracted_page_text}}
"""
OUTLINE_TEMPLATE = """List the headings of the document, in their exact words, as one JSON object: {"level_1", "sections": [{"level_2", "first_page", "subsections": [{"level_3", "first_page"}]}]}.

Document: {{document_id}} ({{source}})
Text:
{{extracted_text}}
"""


def build_prompt(document_id: Column, source: Column, page_start: Column, page_end: Column, summary: Column, last_chunk: Column, page_text: Column, outline: Column, template: str = CHUNK_TEMPLATE) -> Column:
    blank = F.lit("")
    return fill(F.lit(template), {
        "document_id": document_id, "source": source, "page_start": page_start.cast("string"), "page_end": page_end.cast("string"),
        "previous_batch_summary": F.coalesce(summary, blank), "previous_last_chunk": F.coalesce(last_chunk, blank),
        "extracted_page_text": F.coalesce(falsy(page_text), F.lit(NO_PAGE_TEXT)), "known_outline": F.coalesce(falsy(outline), F.lit(NO_OUTLINE)),
    })


def build_outline_prompt(document_id: Column, source: Column, text: Column, template: str = OUTLINE_TEMPLATE) -> Column:
    return fill(F.lit(template), {"document_id": document_id, "source": source, "extracted_text": F.coalesce(falsy(text), F.lit(NO_DOCUMENT_TEXT))})


OUTLINE_TYPE = "struct<level_1:string,sections:array<struct<level_2:string,first_page:int,subsections:array<struct<level_3:string,first_page:int>>>>>"


def render_known_outline(outline: Column) -> Column:
    """The outline (OUTLINE_TYPE) as an indented list. A section without title goes with its subsections."""

    def titled(a: Column, name: str) -> Column:
        return F.filter(F.coalesce(a, F.array()), lambda x: F.coalesce(x[name], F.lit("")) != "")

    def section(s: Column) -> Column:
        return F.concat(F.array(F.concat(F.lit("  - "), s["level_2"])), F.transform(F.filter(s["subsections"], lambda x: F.coalesce(x["level_3"], F.lit("")) != ""), lambda x: F.concat(F.lit("    - "), x["level_3"])))

    top = F.when(F.coalesce(outline["level_1"], F.lit("")) != "", F.array(F.concat(F.lit("- "), outline["level_1"]))).otherwise(F.array().cast("array<string>"))
    body = F.flatten(F.transform(F.filter(outline["sections"], lambda s: F.coalesce(s["level_2"], F.lit("")) != ""), lambda s: F.when(s["subsections"].isNull(), F.array(F.concat(F.lit("  - "), s["level_2"]))).otherwise(section(s))))
    return F.array_join(F.concat(top, F.coalesce(body, F.array().cast("array<string>"))), "\n")


def request_content(prompt: Column, image_urls: Column) -> Column:
    """One text part and an image part for each URL."""
    none = F.lit(None).cast("string")
    text = F.struct(F.lit("input_text").alias("type"), prompt.alias("text"), none.alias("image_url"))
    return F.concat(F.array(text), F.transform(image_urls, lambda u: F.struct(F.lit("input_image").alias("type"), none.alias("text"), u.alias("image_url"))))


def image_url(png: Column) -> Column:
    """A data address; Spark may break base64 into lines, which an address must not hold."""
    return F.concat(F.lit("data:image/png;base64,"), F.replace(F.base64(png), F.lit("\r\n"), F.lit("")))


def norm_token(x: Column, between: str = "") -> Column:
    """Letters, digits and ``_`` in lower case; for a text of many tokens also what stands between them."""
    return F.lower(F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_{between}]+", ""))


def split_tokens(text: Column) -> Column:
    """The normalised lines of a text, empty ones included; it is read as one text."""
    return F.split(norm_token(F.coalesce(text, F.lit("")), "\n"), "\n")


def chunk_tokens(text: Column, table_markdown: Column) -> Column:
    """Normalised words of the table if there is one, else of the text."""
    body = F.coalesce(falsy(table_markdown), text, F.lit(""))
    return F.array_remove(F.split(norm_token(body, WHITE), f"[{WHITE}]+"), "")  # white space stays, so it is read as one text


def batch_for_page(page: Column, size: int) -> Column:
    return F.floor((page - 1) / size).cast("int") + 1


def section_key(level_1: Column, level_2: Column) -> Column:
    return F.coalesce(falsy(level_2), falsy(level_1), F.lit("Untitled"))


def heading_group_key(level_2: Column, level_3: Column) -> Column:
    return F.struct(level_2.alias("level_2"), level_3.alias("level_3"))


def html_escape(x: Column) -> Column:
    # fixed values: the five entities
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def heading_breadcrumb(*levels: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.array(*levels), lambda h: h.isNotNull() & (h != "")), html_escape), " &rsaquo; ")


def table_md_to_html(md: Column) -> Column:
    """Fewer than two rows: preformatted. Else the first row is the header and the second is left out; pipes at a
    row's edges go, however many."""
    rows = F.filter(F.transform(F.split(md, LINE_END), strip), lambda r: r != "")

    def cells(row: Column, tag: str) -> Column:
        found = F.transform(F.split(F.btrim(row, F.lit("|")), r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), html_escape(strip(c)), F.lit(f"</{tag}>")))
        return F.concat(F.lit("<tr>"), F.array_join(found, ""), F.lit("</tr>"))

    body = F.transform(F.slice(rows, F.lit(3), F.greatest(F.size(rows) - 2, F.lit(0))), lambda r: cells(r, "td"))
    made = F.concat(F.lit('<table class="chunk-table"><thead>'), cells(F.get(rows, F.lit(0)), "th"), F.lit("</thead><tbody>"), F.array_join(body, ""), F.lit("</tbody></table>"))
    return F.when(F.size(rows) < 2, F.concat(F.lit("<pre>"), html_escape(md), F.lit("</pre>"))).otherwise(made)


TURN = 0.6180339887498949  # fixed value: of the hue circle from one section to the next


def section_color(rank: Column) -> Column:
    """#rrggbb of the section that appears ``rank``-th (from 0): hue steps of TURN at lightness .45, saturation .6."""
    hue = (rank * F.lit(TURN)) % 1.0
    high, low = 0.45 * 1.6, 2 * 0.45 - 0.45 * 1.6

    def channel(shift: float) -> Column:
        h = F.pmod(hue + shift, F.lit(1.0))
        v = F.when(h < 1 / 6, low + (high - low) * h * 6).when(h < 0.5, F.lit(high)).when(h < 2 / 3, low + (high - low) * (2 / 3 - h) * 6).otherwise(F.lit(low))
        return F.lower(F.lpad(F.hex(F.bround(v * 255, 0).cast("long")), 2, "0"))

    return F.concat(F.lit("#"), channel(1 / 3), channel(0.0), channel(-1 / 3))


def hex_to_rgb(color: Column) -> Column:
    return F.array(*(F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)))
