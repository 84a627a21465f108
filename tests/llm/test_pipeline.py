import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.common import written


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    passage = prose(70, 999)
    texts = [prose(120, i) + (" idiot moron" if i % 5 == 0 else "") for i in range(200)]
    texts += [texts[1], texts[2].replace(texts[2].split()[50], "changed", 1), prose(90, 500) + " " + passage, prose(90, 501) + " " + passage, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, str(tmp_path)))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        kept.append({r.doc_id for r in out.select("doc_id").distinct().collect()})
        if name == "substring_dedup":
            left = {r.doc_id: r.text for r in out.where(F.col("doc_id").isin(202, 203)).collect()}
            assert left[202] == texts[202] and passage not in left[203] and len(left[203]) < len(texts[203])
        docs = out
    assert kept[0] == set(range(206)) - set(range(0, 200, 5))
    assert kept[1] == kept[0] - {200, 201, 205}
    assert kept[2] == kept[1] and kept[4] == kept[3] <= kept[2]


def odd_rows(spark):
    """Documents with nulls in every column, repeated rows and ids, and names that clash with those inside the operators."""
    rows = [(i, prose(60, i), "en", "s", 1) for i in range(40)] + [(3, prose(60, 3), "en", "s", 1), (3, prose(60, 900), None, None, None), (None, prose(60, 901), "de", "t", 5), (None, None, None, None, None)]
    rows += [(50, "", "en", "s", 0), (51, " \n\t ", "en", "s", 4), (52, "!!! ???", "en", "s", 7), (53, "word " * 40_000, "en", "s", 200_000), (None, prose(60, 901), "de", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["score", "tokens", "p", "rate", "copies", "removed_words", "_owner", "foreign_", "owner_", "words_", "node", "label", "uid", "rest", "Length", "a.b", "first_"]
    return docs.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names)), names


def test_stages_with_odd_rows(spark, tmp_path):
    docs, names = odd_rows(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    want = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, written(docs), str(tmp_path)))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        got = out.collect()
        assert all(r[n] == f"{n} {'-' if r.doc_id is None else r.doc_id}" for r in got for n in names), name
        ids = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got)
        if name == "toxicity":
            assert len(got) == docs.count()
        if name == "simhash_near_dedup":  # rows, not ids: both texts of doc 3 stay, one of its equal rows goes
            assert [i for i, _ in ids].count(3) == 2 and len(got) == 40 + 2 + 4 and want is None
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    packed = written(last(spark, written(docs), str(tmp_path)))
    assert packed.select("doc_id").count() >= docs.count() and last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_copies_of_a_mixed_corpus(spark, tmp_path):
    """Every near copy of similarity 0.8 goes, in the order of doc_id, and nothing else does."""
    from test_llm_operators import similar_labels

    rng = random.Random(8)
    texts = [prose(rng.randrange(40, 200), i) for i in range(60)]
    for i in range(60, 150):
        w = texts[rng.randrange(60)].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w[: len(w) - rng.randrange(0, 12)]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert got == set(similar_labels(texts)) and 60 <= len(got) < 150
