"""Document fingerprints: a Merkle tree over sections, paragraphs and passages [native].

A paragraph is a line with its line end, a section a run of paragraphs with the blank lines after it (blank lines at the
start of a text are one of their own), and passages are runs of up to ``PASSAGE`` words inside a paragraph; every piece keeps
its white space, so the pieces of a text join to the text again. A passage's digest is the SHA-256 of its bytes, a node's
that of its children's digests, and equal roots mean equal texts. The fingerprint is ``root:`` and the first eight hex
digits of every passage's digest, and the likeness of two fingerprints is the Dice coefficient of their sets of passages.

Differing branches locate edits: ``located_edits`` goes down from roots that differ to sections and to paragraphs that the other
text lacks (as often), so a branch that was inserted does not mark those after it. ``edit_range`` gives the paragraphs
between the first and the last that differ. The digests of a text are computed once; an edited text takes those of the
paragraphs before the edit from it.

Null texts count as empty. Rows that share a ``doc_id`` stand in the order of their text's hash; rows without one come last, in the
same order; every input row gives one output row. An empty table gives an empty one, and of a single document the next is itself. Columns other than
``doc_id`` and ``text`` are ignored. A text without white space is one passage, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import ordered, positions, table

PASSAGE = 4
_PARAGRAPH_RE = r"[^\n]*+\n|[^\n]++"
_PASSAGE_RE = rf"\s*+(?:\S++\s*+){{1,{PASSAGE}}}|\s++"


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def passages(text: Column) -> Column:
    """The passages of a text, in order."""
    return F.flatten(F.transform(_all(text, _PARAGRAPH_RE), lambda p: _all(p, _PASSAGE_RE)))


def passage_digests(text: Column) -> Column:
    """For each paragraph the digests of its passages."""
    return F.transform(_all(text, _PARAGRAPH_RE), lambda p: F.transform(_all(p, _PASSAGE_RE), lambda x: F.sha2(x, 256)))


def paragraphs(digests: Column) -> Column:
    """From ``passage_digests`` for each paragraph its digest (d), the first eight digits of its passages' (l), and whether
    it is a blank line (e)."""
    blank = _digest(F.array(F.sha2(F.lit("\n"), 256)))
    nodes = F.transform(digests, lambda h: F.struct(_digest(h).alias("d"), F.transform(h, lambda x: F.substring(x, 1, 8)).alias("l")))
    return F.transform(nodes, lambda x: F.struct(x["d"].alias("d"), x["l"].alias("l"), (x["d"] == blank).alias("e")))


def section_digests(nodes: Column) -> Column:
    """From ``paragraphs`` the digests of the sections: one begins at a paragraph after a blank line."""
    marked = F.transform(nodes, lambda x, i: F.concat(F.when((i > 0) & ~x["e"] & F.get(nodes, i - 1)["e"], F.lit("|")).otherwise(F.lit("")), x["d"]))
    return F.when(F.size(nodes) > 0, F.transform(F.split(F.array_join(marked, ""), r"\|"), lambda s: F.sha2(s, 256))).otherwise(F.array().cast("array<string>"))


def root(nodes: Column) -> Column:
    return _digest(section_digests(nodes))


def leaves(nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, lambda x: x["l"]))


def fingerprint(root_: Column, leaves_: Column) -> Column:
    return F.concat(root_, F.lit(":"), F.array_join(leaves_, ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of passages; 1 for two empty ones."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _same_start(a: Column, b: Column) -> Column:
    """How many paragraphs two texts have in common from their start on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x["d"] == y["d"], F.lit(False)))
    return F.aggregate(pairs, start, lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")))["n"]


def edit_range(a: Column, b: Column) -> list[Column]:
    """Where two texts differ, of their ``paragraphs``: the first one that does, and the ends of the range in both (all
    from 0, ends not included). Equal texts give three times their size."""
    first = _same_start(a, b)
    after = F.least(_same_start(F.reverse(a), F.reverse(b)), F.least(F.size(a), F.size(b)) - first)
    return [first, F.size(a) - after, F.size(b) - after]


def branch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, root, section, section_digest, paragraph, digest: a row for each paragraph of each text that has any."""
    nodes = docs.select("doc_id", paragraphs(passage_digests(F.coalesce("text", F.lit("")))).alias("n"))
    nodes = nodes.select("doc_id", "n", root(F.col("n")).alias("root"), section_digests(F.col("n")).alias("s"))
    begins = F.transform("n", lambda x, i: ((i > 0) & ~x["e"] & F.get("n", i - 1)["e"]).cast("int"))
    rows = nodes.withColumn("k", begins).select("doc_id", "root", "s", F.posexplode(F.arrays_zip("n", "k")).alias("paragraph", "x"))
    w = Window.partitionBy("doc_id", "root").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum("x.k").over(w).cast("int"))
    return rows.select("doc_id", "root", "section", F.get("s", F.col("section")).alias("section_digest"), "paragraph", F.col("x.n.d").alias("digest"))


def located_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, side (old or new), section, paragraph, digest: the paragraphs of each document that the other version lacks.

    A descent from the roots: documents with equal roots go first, then the sections, then the paragraphs that both have.
    Equal branches of one text are counted. doc_id must be unique in either table, and not null.
    """
    a, b = branch_rows(old), branch_rows(new)
    roots = a.select("doc_id", "root").distinct().join(b.select("doc_id", F.col("root").alias("other")).distinct(), "doc_id", "full")
    open_ = roots.where(~F.col("root").eqNullSafe(F.col("other"))).select("doc_id")
    both = a.join(open_, "doc_id", "left_semi").withColumn("side", F.lit("old")).unionByName(b.join(open_, "doc_id", "left_semi").withColumn("side", F.lit("new")))

    def lacking(rows: DataFrame, digest: str, place: str) -> DataFrame:
        """The branches (one row each) that the other side lacks, the n-th of equal ones by itself."""
        nth = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "side", digest).orderBy(place)))
        sides = F.count("*").over(Window.partitionBy("doc_id", digest, "nth"))
        return nth.withColumn("sides", sides).where("sides = 1").drop("nth", "sides")

    sections = lacking(both.select("doc_id", "side", "section", "section_digest").distinct(), "section_digest", "section")
    inside = both.join(sections.select("doc_id", "side", "section"), ["doc_id", "side", "section"], "left_semi")
    return lacking(inside, "digest", "paragraph").select("doc_id", "side", "section", "paragraph", "digest")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, and of the next document (descending doc_id, from the last to the first): its first
    n_chars div 3 code points as ``head`` and its passages as ``next_leaves``.

    Whole texts are dealt out once; the two joins share that exchange, and only heads and digests travel again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # plain keys, so one exchange serves window and joins
    place = F.row_number().over(Window.partitionBy("_d").orderBy("_h"))
    base = [owner.alias("_d"), F.xxhash64(text).alias("_h")]
    # both joins below need the same columns of this, or Spark would deal the texts out twice
    keyed = docs.select(*base, text.alias("text")).withColumn("_k", place).drop("_h")
    ids = docs.select(*base, F.char_length(text).cast("long").alias("n_chars")).withColumn("_k", place).select("_d", "_k", "n_chars")
    ids = positions(ordered(ids, [F.col("_d").desc(), F.col("_k").desc()]))
    n = max(1, ids.count())
    this = ids.select("_d", "_k", "n_chars", ((F.col("pos") + 1) % n).alias("_next"))
    other = ids.select(F.col("_d").alias("_nd"), F.col("_k").alias("_nk"), F.col("pos").alias("_next"))
    asks = this.join(other, "_next").select(F.col("_d").alias("_ad"), F.col("_k").alias("_ak"), F.floor(F.col("n_chars") / 3).cast("int").alias("_third"), "_nd", "_nk")
    heads = asks.join(keyed, (F.col("_nd") == F.col("_d")) & ((F.col("_nk") - F.col("_k")) == 0))
    # digests travel as four bytes each
    heads = heads.select("_ad", "_ak", F.substring("text", F.lit(1), F.col("_third")).alias("head"), F.unhex(F.array_join(F.transform(F.flatten(passage_digests(F.col("text"))), lambda x: F.substring(x, 1, 8)), "")).alias("_packed"))
    full = keyed.join(heads, (F.col("_ad") == F.col("_d")) & ((F.col("_ak") - F.col("_k")) == 0))
    unpacked = F.regexp_extract_all(F.lower(F.hex("_packed")), F.lit("[0-9a-f]{8}"), F.lit(0))
    doc_id = F.nullif(F.col("_d"), F.lit(-(1 << 63)))
    return full.select(doc_id.alias("doc_id"), "text", F.char_length("text").cast("long").alias("n_chars"), "head", unpacked.alias("next_leaves"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: the range of paragraphs in which the edited text differs (``edit_range``)."""
    docs = with_next(table(spark, sf_dir, "documents"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    docs = docs.withColumn("kept", kept)
    # whole paragraphs before the edit keep their nodes; the rest begins after the last line end before it
    whole = F.char_length("kept") - F.char_length(F.replace("kept", F.lit("\n"), F.lit("")))
    docs = docs.withColumns({"h": passage_digests(F.col("text")), "rest": passage_digests(F.concat(F.substring_index("kept", "\n", -1), "head")), "whole": whole})
    docs = docs.withColumn("a", paragraphs(F.col("h"))).withColumn("b", F.concat(F.slice("a", F.lit(1), F.col("whole")), paragraphs(F.col("rest"))))
    docs = docs.withColumns({"la": leaves(F.col("a")), "lb": leaves(F.col("b")), "ra": root(F.col("a")), "rb": root(F.col("b"))})
    first, until, edited_until = edit_range(F.col("a"), F.col("b"))
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.concat("kept", "head"), 256).alias("edited_sha256"), fingerprint(F.col("ra"), F.col("la")).alias("fingerprint"), fingerprint(F.col("rb"), F.col("lb")).alias("edited_fingerprint"),
        likeness(F.col("la"), F.col("lb")).alias("near_edited"), likeness(F.col("la"), F.col("next_leaves")).alias("near_next"),
        first.alias("edit_from"), until.alias("edit_until"), edited_until.alias("edited_until"),
    )
