"""Pages, blocks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip


def page_batches(pages: DataFrame, total: Column, size: int = 2) -> DataFrame:
    """batch_no (from 0), page_start, page_end for each row's ``page_num``; the last batch may be short."""
    if size == 0:
        raise ValueError("a batch needs at least one page")
    if size < 0:
        return pages.limit(0).withColumns({k: F.lit(0) for k in ("batch_no", "page_start", "page_end")})
    no = F.floor((F.col("page_num") - 1) / size).cast("int")
    out = pages.withColumn("batch_no", no).withColumn("page_start", F.col("batch_no") * size + 1)
    return out.withColumn("page_end", F.least(F.col("page_start") + size - 1, total))


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    return pages.where(F.col("page_num").between(first, last))


def count_pages(pages: DataFrame, key: str) -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("n_pages"))


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Stripped, nonblank blocks."""
    return blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")


def page_text(pages: DataFrame, *by: str) -> DataFrame:
    """The nonblank pages of each group, labelled, in order of page_num; an empty string if there are none."""
    text = strip(F.col("text"))
    part = F.when(text != "", F.struct(F.col("page_num"), F.concat(F.lit("--- page "), F.col("page_num").cast("string"), F.lit(" ---\n"), text).alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    return pages.groupBy(*by).agg(joined.alias("page_text"))


PLACE = ("block_no", "line_no", "word_no", "x0", "y0", "x1", "y1", "text")


def page_words(words: DataFrame, *by: str) -> DataFrame:
    """Words of each page in reading order: an array sorted by block, line and word number. ``words`` has a row for each
    word; pages that hold theirs as an array need no exchange (``reading_order``)."""
    return words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*PLACE))).alias("words"))


def reading_order(words: Column) -> Column:
    """The same for a page's array of words, as ``quire.sources.documents.pdf_pages`` gives them: sorted where they lie."""
    return F.sort_array(F.transform(words, lambda w: F.struct(*(w[c].alias(c) for c in PLACE))))
