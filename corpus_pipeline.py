"""A corpus pipeline of the operators in ``quire.llm``: raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, packing, simhash, substrings, toxicity
from quire.llm.common import packed, table, unpacked, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; null and empty texts have no matches and stay. The model
    is learned from this stage's documents; without toxic labels nothing goes."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score_texts(packed(docs), model).where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near copies the document with the smallest doc_id stays; null texts count as empty
    ones, which are copies of each other. Rows are told apart by doc_id and text."""
    return simhash.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentence spans go from the texts; n_chars follows. Documents without text left go; null and empty texts
    that nothing was cut from stay. Rows with one doc_id count as one document."""
    out = substrings.dedup_spans(packed(docs))
    out = out.where(~((F.col("removed_words") > 0) & (F.trim(F.col("text"), F.lit(" \n\t\r")) == "")))
    n = F.when(F.col("removed_words") > 0, F.char_length("text"))
    at = next((i for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text")) if c == "n_chars"), None)
    return unpacked(out, docs, **({} if at is None else {"n_chars": F.coalesce(n, F.col("rest")[f"c{at}"]).cast(docs.schema["n_chars"].dataType)}))


#: Shares of tokens that the mix aims at. Rates over one count as one, so it is the low domain that gives way.
TARGETS = {"high": 0.95, "low": 0.05}


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with its rate as probability (rates over one count as one), by a hash of its doc_id: rows
    with one doc_id and equal rates share their fate. Without labels all rates are equal, and all documents stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", mixing.quality_domain().alias("domain"))
    out = mixing.mix(packed(docs), labels, TARGETS, headroom=1.05)
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    return unpacked(out.where(u < F.col("rate")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; null texts count as empty ones (a single end id)."""
    import public_tokenizers

    pieces = packing.piece_rows(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_domains", mix_domains),
    ("best_fit_packing", pack_sequences),
]
#: Learned scores, fingerprints and a genetic search can't be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
