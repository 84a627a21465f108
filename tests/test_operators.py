import json
import random
import time
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import quire
from quire.cli import print_outlines, process_documents
from quire.functions import text as T
from quire.operators import chunks as C
from quire.operators import layout as L
from quire.operators import outline as O
from quire.operators import pages as P
from quire.plans import catalogue
from quire.plans import process as R
from quire.sinks import chunks as S
from quire.sinks import packed
from quire.sources import documents as D

LONG = " ".join(f"substantial{i}" for i in range(20))
DOCS = "doc_id string, document_id string, source string, source_url string, n_pages int"


def outline_rows(spark, paths):
    return spark.createDataFrame([("d", i, f"d_{i}", *p) for i, p in enumerate(paths)], "doc_id string, seq int, chunk_id string, level_1_heading string, level_2_heading string, level_3_heading string")


def test_outline(spark):
    rows = outline_rows(spark, [("Doc", "Intro", "Overview"), ("Doc", "Design", "Parser"), ("Doc", "Design", "Parser"), ("Doc", "Design", "Pipelines"), (None, None, None), (None, "X", "")])
    nodes = O.outline_nodes(rows)
    assert O.outline_markdown(nodes).first()["markdown"] == "- Doc\n  - Intro\n    - Overview (1 chunk)\n  - Design\n    - Parser (2 chunks)\n    - Pipelines (1 chunk)\n- X (1 chunk)"
    got = {tuple(r.path): (r.own_count, r.chunk_count, r.chunk_ids) for r in nodes.collect()}
    assert got["Doc", "Design", "Parser"] == (2, 2, ["d_1", "d_2"]) and got[("Doc",)] == (0, 4, [])


def test_batches(spark):
    pages = spark.range(1, 6).select(F.col("id").cast("int").alias("page_num"))
    got = P.page_batches(pages, F.lit(5)).orderBy("page_num").collect()
    assert [(r.batch_no, r.page_start, r.page_end) for r in got] == [(0, 1, 2), (0, 1, 2), (1, 3, 4), (1, 3, 4), (2, 5, 5)]
    with pytest.raises(ValueError):
        P.page_batches(pages, F.lit(5), 0)


def test_page_text(spark):
    pages = spark.createDataFrame([("d", 2, "Second"), ("d", 1, " First\n"), ("d", 3, "  "), ("e", 1, "")], "d string, page_num int, text string")
    got = dict(P.page_text(pages, "d").collect())
    assert got == {"d": "--- page 1 ---\nFirst\n\n--- page 2 ---\nSecond", "e": ""}


def responses(spark, rows):
    return spark.createDataFrame([(d, b, json.dumps(x) if not isinstance(x, str) else x) for d, b, x in rows], "doc_id string, batch_no int, output_text string")


def test_process_recovers_and_numbers(spark):
    docs = spark.createDataFrame([("a", "A doc", "a", "", 4), ("b", "b", "b", "", 2)], DOCS)
    blocks = spark.createDataFrame([("a", 1, 0, 0, "kept text"), ("a", 2, 0, 0, LONG), ("a", 3, 0, 1, "Page 3 of 12"), ("b", 1, 0, 0, LONG)], "doc_id string, page_num int, block_no int, batch_no int, text string")
    first = {"chunks": [{"chunk_text": "kept text", "level_1_heading": "T", "level_2_heading": "S", "page_start": 0, "chunk_id": "mine"}]}
    chunks, status = R.process(blocks, responses(spark, [("a", 0, first), ("a", 1, {"chunks": [{"chunk_text": "more"}]}), ("b", 0, {"chunks": [{"chunk_text": "x", "content_type": ""}]})]), docs)
    got = chunks.orderBy("seq").collect()
    assert [r.chunk_id for r in got] == ["a_doc_0", "a_doc_1", "a_doc_2"]
    assert got[1].chunk_text == LONG and (got[1].level_1_heading, got[1].level_2_heading, got[1].page_start, got[1].continuation_status) == ("T", "S", 2, "partial")
    assert (got[0].page_start, got[0].page_end, got[2].page_start, got[2].page_end) == (1, 2, 3, 4)
    assert {r.doc_id: r.status for r in status.collect()} == {"a": "ok", "b": "failed"}


def test_no_false_recovery(spark):
    blocks = spark.createDataFrame([("a", 1, 0, 0, LONG)], "doc_id string, page_num int, block_no int, batch_no int, text string")
    chunks = spark.createDataFrame([("a", 0, LONG.upper(), None)], "doc_id string, batch_no int, chunk_text string, table_markdown string")
    assert C.find_missed_blocks(blocks, chunks).count() == 0
    assert C.find_missed_blocks(blocks, chunks.limit(0)).count() == 1


def test_flagship_plan_has_no_python(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_live_fold_carries_context(spark):
    seen = "previous_batch_summary"

    def backend(model, content, most, temperature):
        prompt = content[0]["text"]
        carried = prompt.split("Summary of the pages before: ")[1].split("\n")[0]
        if "FAIL" in prompt:
            raise RuntimeError("down")
        return json.dumps({"batch_summary": "s1", "chunks": [{"chunk_text": carried or "none", "page_start": 1}]})

    rows = [("d", "d", "d", i, 1, 2, "t", "", None) for i in range(2)] + [("e", "e", "e", 0, 1, 2, "FAIL", "", None)]
    batches = spark.createDataFrame(rows, "doc_id string, document_id string, source string, batch_no int, page_start int, page_end int, page_text string, known_outline string, images array<string>")
    got = R.live_responses(batches, backend, "m").orderBy("doc_id", "batch_no").collect()
    assert [json.loads(r.output_text)["chunks"][0]["chunk_text"] for r in got[:2]] == ["none", "s1"] and "down" in got[2].error and seen


def test_command_line_round_trip(spark, tmp_path, capsys):
    for name in ("one.pdf", "Two words.pdf", "bad.pdf", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())

    def reader(content, zoom):
        text = f"Intro of {content.decode()}\n{LONG}" if b"bad" not in content else "BROKEN"
        return [{"text": text, "blocks": [(0, 0, 1, 1, text, 0, 0)], "words": [(0, 0, 1, 1, "Intro", 0, 0, 0)], "png": b"x"}]

    def backend(model, content, most, temperature):
        if "BROKEN" in content[0]["text"]:
            return "no json"
        if content[0]["text"].startswith("List the headings"):
            return json.dumps({"level_1": "T"})
        return json.dumps({"chunks": [{"chunk_text": LONG, "level_1_heading": "T"}]})

    out = str(tmp_path / "out")
    found = process_documents(spark, str(tmp_path), out, backend, "m", reader=reader)
    assert [f.rsplit("/")[-1] for f in found] == ["Two_words.jsonl", "one.jsonl"]
    print_outlines(spark, found[0])
    assert capsys.readouterr().out == "- T (1 chunk)\n"
    line = (tmp_path / "out" / "one.jsonl").read_text().strip()
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == ["Two_words.jsonl", "one.jsonl"]
    assert list(json.loads(line))[:3] == ["chunk_id", "document_id", "source"] and json.loads(line)["table_markdown"] is None
    assert process_documents(spark, str(tmp_path), out, lambda *a: 1 / 0, "m", reader=reader) == found


def test_documents_that_fail_or_have_no_chunks(spark, tmp_path):
    """One file for each document that did not fail, also without chunks; bad answers fail their document only; templates of one's own."""
    for name in ("list", "text", "none", "types", "good"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())

    def reader(content, zoom):
        return [{"text": content.decode(), "blocks": [(0, 0, 1, 1, content.decode(), 0, 0)], "words": [], "png": b"x"}]

    answers = {"list": "[1]", "text": '"x"', "none": "{}", "types": '{"chunks": [{"keywords": "ab"}]}', "good": '{"chunks": [{"chunk_text": "t"}]}'}
    def backend(model, content, most, temperature):
        prompt = content[0]["text"]
        assert prompt.startswith(("mine ", "own "))
        return json.dumps({}) if prompt.startswith("mine ") else answers[prompt.split()[1]]

    out = str(tmp_path / "out")
    found = process_documents(spark, str(tmp_path), out, backend, "m", reader=reader, outline_template="mine {{document_id}}", chunk_template="own {{document_id}} {{known_outline}}", source_urls={"good": "https://x.example"})
    assert [f.rsplit("/")[-1] for f in found] == ["good.jsonl", "none.jsonl"]
    got = D.scan_chunks(spark, out).collect()
    assert [(r.chunk_id, r.document_id, r.source_url, r.metadata.source_url) for r in got] == [("good_0", "good", "https://x.example", "https://x.example")]
    assert process_documents(spark, str(tmp_path / "out"), out, backend, "m", reader=reader) == []
    assert quire.process_pdf(spark, str(tmp_path / "none.pdf"), out, backend, model="m", reader=reader).endswith("/none.jsonl")
    with pytest.raises(RuntimeError):
        quire.process_pdf(spark, str(tmp_path / "list.pdf"), out, backend, model="m", reader=reader, outline_template="mine", chunk_template="own {{document_id}}")
    with pytest.raises(FileNotFoundError):
        process_documents(spark, str(tmp_path / "nowhere"), out, backend, "m", reader=reader)


def test_both_ways_to_write_agree(spark, tmp_path, monkeypatch):
    """Files by the workers and by Spark: the same, in order, overwritten as a whole, with odd names."""
    from quire import schema

    docs = spark.createDataFrame([("a", "A b=c%"), ("b", "하나"), ("c", "none")], "doc_id string, file_id string")
    rows = [(d, i) for d, n in (("a", 30), ("b", 3)) for i in range(n)]
    chunks = spark.createDataFrame(rows, "doc_id string, seq int").select("*", *(F.lit(None).cast(t).alias(c) if c not in ("chunk_id", "chunk_text") else F.concat("doc_id", F.lit(" é "), F.col("seq").cast("string")).alias(c) for c, t in schema.CHUNK_FIELDS.items()))
    found = []
    for name, direct in (("workers", True), ("spark", False)):
        monkeypatch.setattr(S, "_direct", lambda session, folder, direct=direct: direct)
        out = tmp_path / name
        for _ in range(2):
            S.write_jsonl(chunks.orderBy(F.desc("seq")), docs, str(out) if direct else f"file:{out}")
        found.append({p.name: p.read_text() for p in out.iterdir() if not p.name.startswith(".")})
    assert found[0] == found[1] and sorted(found[0]) == ["A b=c%.jsonl", "none.jsonl", "하나.jsonl"] and found[0]["none.jsonl"] == "\n"
    assert [json.loads(x)["chunk_text"] for x in found[0]["A b=c%.jsonl"].splitlines()] == [f"a é {i}" for i in range(30)]
    monkeypatch.undo()
    here = S._qualified(spark, str(tmp_path))
    assert here == f"file://{tmp_path}" and S._direct(spark, here) and not S._direct(spark, "viewfs://store/x")
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
    assert not S._direct(cluster, here)  # each worker would write to a disk of its own


def test_paths_follow_the_default_file_system(spark, tmp_path):
    """A folder without a scheme is one of Hadoop's default file system, for writing as for listing."""
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert S._qualified(spark, "/in/x").startswith("viewfs://other/in/x")
        docs = spark.createDataFrame([("a", "one", 0, "x"), ("b", "two", 0, None)], "doc_id string, file_id string, seq int, line string")
        S.write_lines(docs.select("file_id", "seq", "line"), "/in/x")
        assert {r.document_id for r in S.finished(spark, "/in/x").collect()} == {"one", "two"}
    finally:
        conf.set("fs.defaultFS", old)
    assert (tmp_path / "x" / "one.jsonl").read_text() == "x\n"


def test_markup_is_read_in_one_pass(spark):
    """Blocks of random markup as by SQL, whose patterns run in linear time, and a megabyte without ends."""
    import duckdb
    import pandas as pd

    from quire.plans import catalogue as K

    rng = random.Random(0)
    parts = ["<p>", "<p ", "x", "<script>", "</script>", "<!--", "-->", "<b>", "</p>", "<", "&lt;", ">", "<div>", "y z", "</style>", "<style", "<h1>", "</h1>", "</b>"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(25)))) for i in range(2_000)]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "html"]))
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert sorted(map(tuple, D.html_blocks(pages).collect())) == sorted(con.execute(K.ORACLE["html_blocks"]).fetchall())
    assert sorted(map(tuple, D.html_headings(pages).collect())) == sorted(con.execute(K.ORACLE["html_outline"]).fetchall())
    long = spark.createDataFrame([(i, x * (1_000_000 // len(x))) for i, x in enumerate(["<p><script ", "<!--a", "<", "<p ", "<h1>", "<b "])], "page_id long, html string")
    began = time.time()
    assert D.html_blocks(long).count() >= 1 and D.html_headings(long).count() == 6
    assert time.time() - began < 60


def chunk_rows(spark, rows):
    """(doc_id, seq, chunk_text) in the chunk schema."""
    from quire import schema

    df = spark.createDataFrame(rows, "doc_id string, seq int, t string")
    return df.select("doc_id", "seq", *(F.lit(None).cast(t).alias(c) if c != "chunk_text" else F.col("t").alias(c) for c, t in schema.CHUNK_FIELDS.items()))


def texts_of(spark, folder):
    lines = packed.packed_lines(spark, folder).orderBy("file_id", "seq").collect()
    return [(r.file_id, r.seq, json.loads(r.line)["chunk_text"]) for r in lines]


def test_packed_folder(spark, tmp_path):
    """Runs add documents and replace them; a run that broke off leaves nothing to see; compacting keeps what is seen."""
    folder = str(tmp_path / "packed")
    files = lambda *ids: spark.createDataFrame([(i, f"F {i}") for i in ids], "doc_id string, file_id string")
    assert packed.finished_packed(spark, folder).count() == 0 and texts_of(spark, folder) == []
    packed.write_packed(chunk_rows(spark, [("a", 1, "a1"), ("a", 0, "a0"), ("b", 0, "b0"), ("no", 0, "of no document")]), files("a", "b", "empty"), folder)
    assert texts_of(spark, folder) == [("F a", 0, "a0"), ("F a", 1, "a1"), ("F b", 0, "b0")]
    assert {r.file_id: r.n_lines for r in packed.finished_packed(spark, folder).collect()} == {"F a": 2, "F b": 1, "F empty": 0}
    broken = spark.read.parquet(f"{folder}/lines").where("file_id = 'F b'").drop("run").withColumn("line", F.lit("x"))
    broken.write.parquet(f"{folder}/lines/run=000000001-broken")
    packed.write_packed(chunk_rows(spark, [("a", 0, "new"), ("c", 0, "c0")]), files("a", "c"), folder)
    want = [("F a", 0, "new"), ("F b", 0, "b0"), ("F c", 0, "c0")]
    assert texts_of(spark, folder) == want and spark.read.parquet(f"{folder}/lines").count() == 6
    left = S.skip_existing(files("a", "d").withColumnRenamed("file_id", "k"), packed.finished_packed(spark, folder).withColumnRenamed("file_id", "k"), "k")
    assert [r.k for r in left.collect()] == ["F d"]
    packed.compact(spark, folder)
    assert texts_of(spark, folder) == want and spark.read.parquet(f"{folder}/lines").count() == 3
    packed.compact(spark, folder)
    assert len(list((tmp_path / "packed" / "lines").glob("run=*"))) == 2
    packed.export_files(spark, folder, str(tmp_path / "files"))
    assert {p.name: p.read_text().strip() for p in (tmp_path / "files").glob("*.jsonl")}.keys() == {"F a.jsonl", "F b.jsonl", "F c.jsonl", "F empty.jsonl"}
    packed.export_lines(spark, folder, str(tmp_path / "lines"))
    assert D.scan_chunks(spark, str(tmp_path / "lines"), strict=False).count() == 3


@pytest.mark.parametrize("most", ["128m", "700"])
def test_chunks_keep_the_order_of_lines(spark, tmp_path, most):
    """Also where ids are no numbers, documents are mixed, and Spark splits the file."""
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"{rng.randrange(10**9):x}") for _ in range(80)]
    chunk = lambda d, x: json.dumps({"chunk_id": x, "document_id": d, "source": "s", "page_start": 1, "page_end": 1, "chunk_text": x, "metadata": {}})
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text("\n" + "\n\n".join(chunk(d, name + x) for d, x in rows) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, most)
    try:
        got = D.scan_chunks(spark, str(tmp_path), strict=False).collect()
        parts = D.file_lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 20 or most == "128m"
    for name in ("one", "two"):
        for d in "ab":
            mine = sorted((r.seq, r.chunk_text) for r in got if r.document_id == d and r.chunk_text.startswith(name))
            assert mine == list(enumerate(name + x for dd, x in rows if dd == d))


def test_both_ways_to_parse_agree(spark):
    from quire.plans import catalogue as K

    texts = [r[0] for r in K.BAD_RESPONSES] + [f'{{"chunks": [{r[0]}]}}' for r in K.CHUNK_TYPES] + ["", "no json", "``` \n{}```", '```json{"chunks": [{"chunk_text": "x", "extra": {"a": [1]}}]}```', 'a {"chunks": []} b', None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, output_text string")

    def told(strict):
        return sorted(((r.doc_id, r.ord, r.chunk_text, r.page_start, r.keywords, r.error if r.ord is not None else r.error is not None) for r in C.ingest(rows, strict).collect()), key=str)

    native, strict = told(False), told(True)
    assert [x for x in native if x[0] < len(texts) - 1] == [x for x in strict if x[0] < len(texts) - 1]
    raw = C.ingest(rows)
    status = {r.doc_id: (r.status, r.n_chunks) for r in C.document_status(raw, documents=rows).collect()}
    assert status[0] == ("ok", 1) and status[1][0] == "failed" and status[11] == ("ok", 0) and len(status) == len(texts)


def test_what_spark_refuses_goes_to_python(spark, monkeypatch):
    """Duplicate keys and NaN as Python reads them; of what parses, or can't, Python sees nothing."""
    texts = [
        '{"chunks": [{"chunk_text": "a", "chunk_text": "b"}]}', '{"chunks": [], "chunks": [{"chunk_text": "c"}]}', 'so: {"chunks": [{"chunk_text": "d", "x": NaN}]} done', '{"chunks": [{"page_start": NaN}]}', '{"chunks": [{"keywords": [NaN]}]}',
        '{"chunks": [NaN]}', '{"chunks": Infinity}', "NaN", '[{"a": -Infinity}]', '{"chunks": [{"chunk_text": NaN}]}', '{"batch_summary": "s", "batch_summary": "t", "chunks": []}', "{broken", "no json", '{"chunks": [{"chunk_text": "e"}]}', "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, output_text string")
    told = lambda strict: sorted(((r.doc_id, r.ord, r.chunk_text, r.error if r.ord is not None else r.error is not None) for r in C.ingest(rows, strict).collect()), key=str)
    native = told(False)
    assert [x for x in native if x[0] < 15] == [x for x in told(True) if x[0] < 15]
    assert {(i, 0, t, None) for i, t in ((0, "b"), (1, "c"), (2, "d"), (13, "e"))} <= set(native)
    assert {x[0]: x[3] for x in native if x[0] in (3, 4, 9)} == {3: "page_start", 4: "keywords", 9: "chunk_text"}
    assert all(x[3] is True for x in native if x[0] in (5, 6, 7, 8, 11, 12)) and not [x for x in native if x[0] == 10]
    assert {r.doc_id: r.batch_summary for r in C.batch_summaries(rows).collect()}[10] == "t"
    seen = rows.select(T.refused(F.col("output_text"), T.json_object_text(F.col("output_text"))).alias("t")).where("t is not null").collect()
    assert {r.t for r in seen} == {t for i, t in enumerate(texts) if t and i not in (12, 13)}


def test_table_function_gives_what_ingest_gives(spark):
    from quire.functions.tables import register
    from quire.plans import catalogue as K

    register(spark)
    texts = [r[0] for r in K.BAD_RESPONSES] + [f'{{"chunks": [{r[0]}]}}' for r in K.CHUNK_TYPES] + ["", "no json", '{"chunks": [{"chunk_text": "x", "chunk_text": "y"}, {"chunk_text": "z"}]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, output_text string")
    got = spark.sql("SELECT id, ord, try_parse_json(chunk) AS v, error FROM {r}, LATERAL extract_chunks(output_text)", r=rows)
    got = got.select("id", "ord", F.try_variant_get("v", "$.chunk_text", "string"), F.coalesce("error", F.when(F.col("v").isNotNull(), C.type_error(F.col("v")))))
    want = C.ingest(rows).select("id", "ord", "chunk_text", "error")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM extract_chunks(1)").collect()


def test_slugs_without_python(spark):
    import sys
    import unicodedata

    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in chars[1:]], "x string")
    stable = [r.x for r in df.where(T.normalized_already(F.col("x"))).collect()]
    assert len(stable) > 30_000 and all(unicodedata.normalize("NFKC", c) == c for c in stable)
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices(stable, k=8))
        assert unicodedata.normalize("NFKC", text) == text
    names = spark.createDataFrame([("Plain name (v2)",), ("하나은행 정기",), (None,), ("",)], "x string")
    assert "Python" not in T.slugified(names, "x", "slug")._jdf.queryExecution().toString()
    mixed = names.union(spark.createDataFrame([("ﬁnal①　ＡＢＣ",), ("e\u0301",)], "x string"))
    got = T.slugified(mixed, "x", "slug")
    assert sorted(map(str, got.collect())) == sorted(map(str, mixed.withColumn("slug", T.slugify(F.col("x"))).collect()))


def test_stream(spark, tmp_path):
    """Documents that arrive as files: the lost blocks of each are found once."""
    from quire.streaming import stream_missed_blocks

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    chunks = spark.createDataFrame([(1, 0, LONG, None)], "doc_id long, batch_no int, chunk_text string, table_markdown string")
    for k in (1, 2):
        spark.createDataFrame([(k, LONG, "en", "s", len(LONG))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream_missed_blocks(spark, str(tmp_path / "in"), chunks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_model_is_needed(monkeypatch):
    monkeypatch.delenv(R.MODEL_VARIABLE, raising=False)
    with pytest.raises(ValueError):
        R.model_name()


def test_strict_scan_refuses_bad_chunks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('\n{"chunk_id": "a_0", "document_id": "a", "source": "a", "page_start": 1, "page_end": 1, "content_type": "prose", "metadata": {}}\n')
    assert D.scan_chunks(spark, str(tmp_path / "c.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="invalid chunk"):
        D.scan_chunks(spark, str(tmp_path / "c.jsonl")).collect()


def plain_walk(page, at, tokens):
    found = []
    for t in tokens:
        window = page[at : at + L.AHEAD]
        if t in window:
            at += window.index(t)
            found.append(at)
        at += 1
    return found


def plain_match(page, tokens):
    """By looking at the words of the page, without an index."""
    best = ([], 0)
    for o in sorted({len(tokens) * i // L.ANCHORS for i in range(L.ANCHORS)}):
        probe = tokens[o : o + L.PROBE]
        scores = [(len(plain_walk(page, a, probe)), -a) for a, w in enumerate(page) if probe and w == probe[0]]
        if scores and max(scores)[0] >= max(2, len(probe) // 4):
            found = plain_walk(page, -max(scores)[1], tokens[o:])
            best = (found, o) if len(found) > len(best[0]) else best
    return best


def random_match(rng):
    kinds = [f"w{k}" for k in range(rng.choice([3, 8, 40]))]
    page = [rng.choice([*kinds, ""]) for _ in range(rng.randrange(60))]
    tokens = [rng.choice(kinds) for _ in range(rng.randrange(40))]
    if page and rng.random() < 0.5:
        a = rng.randrange(len(page))
        tokens = [x for x in page[a : a + rng.randrange(30)] if x and rng.random() < 0.9] + tokens[:5]
    return page, tokens


def test_match_words():
    page = "plan overview the plan covers many cases and more words follow here".split()
    assert L.match_words(L.token_places(page), "the plan covers many cases".split()) == ([2, 3, 4, 5, 6], 0)
    rng = random.Random(1)
    for _ in range(2_000):
        page, tokens = random_match(rng)
        assert L.match_words(L.token_places(page), tokens) == plain_match(page, tokens)


def test_pages_meet_chunks_once(spark, monkeypatch):
    """Primary and head pages are those of all pairs of chunk and page, over spots and batches, for few and for many declared
    pages; a page is sent twice at most, and pages that can't win are not matched."""
    rng = random.Random(3)
    kinds = [f"w{k}" for k in range(60)]
    texts = {(k, p): [rng.choice(kinds) for _ in range(rng.randrange(20, 60))] for k in range(2) for p in range(1, 101)}
    place = lambda i: (i % 10 * 50.0, i // 10 * 30.0)
    rows = [(k, p, [(x, y, x + 45, y + 12, w) for w, (x, y) in zip(t, map(place, range(len(t))), strict=True)]) for (k, p), t in texts.items()]
    pages = spark.createDataFrame(rows, "k int, page_num int, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    chunks = []
    for seq in range(80):
        k, p = seq % 2, rng.randrange(1, 100)
        both = texts[k, p] + texts[k, p + 1]
        start, end = rng.choice([(p, p), (p + 1, None), (1, 100), (max(1, p - 40), p + 9), (None, None)])
        chunks.append((k, seq, start, end, " ".join(both[rng.randrange(25) :][: rng.randrange(10, 80)]), None, "paragraph"))
    df = spark.createDataFrame(chunks, "k int, seq int, page_start int, page_end int, chunk_text string, table_markdown string, content_type string")
    want = {}
    for k, seq, start, end, text, *_ in chunks:
        tokens, scored = text.split(), []
        for p in range(max(1, (start or 1) - L.RADIUS), min(100, (end or start or 1000) + L.RADIUS) + 1):
            at, offset = plain_match(texts[k, p], tokens)
            regions = []
            for a, b in zip([None, *at], at, strict=False):
                if a is None or place(b)[1] < place(a)[1] - 3 or place(b)[1] > place(a)[1] + 12 + 40:
                    regions.append([])
                regions[-1].append(b)
            regions = [r for r in regions if len(r) >= L.MIN_REGION]
            score = sum(map(len, regions))
            if len(at) >= L.MIN_MATCHED and score >= L.MIN_MATCHED:
                box = lambda r: (min(place(i)[0] for i in r), min(place(i)[1] for i in r), max(place(i)[0] for i in r) + 45, max(place(i)[1] for i in r) + 12)
                scored.append((-score, p, offset, [box(r) for r in regions]))
        if scored:
            main = min(scored)
            want[k, seq, "primary"] = main
            heads = [x for x in scored if main[2] > len(tokens) * 0.1 and x[1] < main[1] and x[2] <= len(tokens) * 0.1 and -x[0] >= max(20, int(len(tokens) * 0.15))]
            if heads:
                want[k, seq, "head"] = min(heads)
    assert {role for _, _, role in want} == {"primary", "head"}
    for most in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got = {(r.k, r.seq, r.role): (-r.score, r.page_num, r.offset, [tuple(b) for b in r.boxes]) for r in L.find_matching_pages(df, pages, "k").collect()}
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sent = L._met(df, pages, "k").groupBy("_chunk").count().collect()
    assert next(r["count"] for r in sent if not r["_chunk"]) < 2 * len(texts)
    tried = []
    match = L.match_words
    monkeypatch.setattr(L, "match_words", lambda places, tokens: tried.append(1) or match(places, tokens))
    held = {p: SimpleNamespace(places=L.token_places(texts[0, p])) for p in range(1, 8)}
    for page in held.values():
        page.shared = lambda once, more, page=page: L._Page.shared(page, once, more)
        page.scored = lambda tokens, page=page: (len(L.match_words(page.places, tokens)[0]), 0, [])
    assert {n: s for n, (s, *_) in L.best_pages(held, texts[0, 4]).items()} == {4: len(texts[0, 4])} and len(tried) == 1


def test_pages_are_ruled_out_exactly(spark):
    """No page with a match of MIN_MATCHED words is ruled out, and what is left shares as many tokens; a page's rows
    make its index once, whatever batches they come in."""
    rng = random.Random(2)
    pairs = [random_match(rng) for _ in range(300)]
    word = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
    pages = spark.createDataFrame([(i, p, [(0.0, 0.0, 1.0, 1.0, w) for w in page]) for i in range(60) for p in (1, 2, 3) for page in [pairs[i + 60 * p][0]]], f"k int, page_num int, words array<{word}>")
    chunks = [(i, j, 2, None, " ".join(pairs[(i + 7 * j) % 60 + 60 * (1 + j % 3)][1]), None, "paragraph") for i in range(60) for j in range(4)]
    df = spark.createDataFrame(chunks, "k int, seq int, page_start int, page_end int, chunk_text string, table_markdown string, content_type string")
    near = L.possible_pages(df, pages, "k")
    left = {(r.k, r.seq, r.page_num) for r in near.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    got = {(r.k, r.seq, r.page_num): (r.places, r.offset) for r in L.matched(near, "k").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, j, _, _, text, *_ in chunks:
        for p in (1, 2, 3):
            page, tokens = pairs[i + 60 * p][0], text.split()
            shared = sum((Counter(tokens) & Counter(w for w in page if w)).values())
            assert ((i, j, p) in left) == (shared >= L.MIN_MATCHED)
            want = plain_match(page, tokens)
            assert len(want[0]) <= shared
            assert got.get((i, j, p)) == (want if want[0] and (i, j, p) in left else None)


def test_preceding_prose_against_all_pairs(spark):
    rng = random.Random(3)
    x, y = lambda: float(rng.randrange(60)), lambda: float(rng.randrange(700))
    figures = [(rng.randrange(4), i, a := x(), a + rng.choice([0, 0, 3, 8, -2]), b := y(), b + 5.0) for i in range(300)]
    prose = [(rng.randrange(5), a := x(), a + rng.choice([0, 0, 5, 30]), b := y(), b + 3.0, "word " * rng.randrange(6, 11)) for _ in range(400)]
    got = L.preceding_prose(spark.createDataFrame(figures, "k int, id int, x0 double, x1 double, y0 double, y1 double"), spark.createDataFrame(prose, "k int, x0 double, x1 double, y0 double, y1 double, text string"), "k")
    want = {}
    for k, i, x0, x1, y0, _ in figures:
        over = [b[4] for b in prose if x0 <= x1 and b[0] == k and len(b[5].split()) >= 8 and b[4] <= y0 + 2 and b[1] < x1 and b[2] > x0]
        want[i] = max(max(over) + 4 if over else y0 - 260, y0 - 260, 0.0)
    assert {r.id: r.top for r in got.collect()} == want


def test_rows_of_the_sweep_are_linear(spark):
    """Twice the boxes at one key give about twice the rows, where pairs would be four times as many."""
    made = []
    for n in (200, 400):
        e = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 31 % 500).cast("double").alias("x0"), (F.col("id") * 31 % 500 + 40).cast("double").alias("x1"), (F.col("id") * 7 % 90).cast("double").alias("y0"))
        e = e.withColumn("y1", F.col("y0") + 12)
        got = L.preceding_prose(e.where("id % 2 = 0"), e.where("id % 2 = 1").withColumn("text", F.repeat(F.lit("word "), 9)), "k")
        assert got.count() == n // 2
        rows = L.prose_sweep(e.where("id % 2 = 0"), e.where("id % 2 = 1").withColumn("text", F.repeat(F.lit("word "), 9)), ["k"], 8, 260.0, 4.0)
        made.append(rows.count())
    assert made[1] < 2.6 * made[0]


def test_skip_existing(spark):
    docs, done = spark.range(3).withColumnRenamed("id", "k"), spark.range(1).withColumnRenamed("id", "k")
    assert S.skip_existing(docs, done, "k").count() == 2 and S.skip_existing(docs, done, "k", overwrite=True).count() == 3


def test_few_requests_are_held_at_once(spark, monkeypatch):
    """Answers are handed on after a part of a batch, and a document goes on in the next part."""
    names = "doc_id string, document_id string, source string, batch_no int, page_start int, page_end int, page_text string, known_outline string, images array<string>"
    batches = spark.createDataFrame([], names)
    got, asked = [], []
    monkeypatch.setattr(type(batches), "mapInArrow", lambda self, f, schema: got.append(f))
    monkeypatch.setattr(R, "AT_ONCE", 3)
    R.live_responses(batches, lambda model, content, most, heat: asked.append(1) or json.dumps({"batch_summary": str(len(asked)), "chunks": []}), "m", template="{{previous_batch_summary}}")
    rows = [{"doc_id": "a" if i < 7 else "b", "document_id": "a", "source": "", "batch_no": i, "page_start": 1, "page_end": 2, "page_text": "x", "known_outline": "", "images": []} for i in range(10)]
    seen = []
    for b in got[0]([pa.RecordBatch.from_pylist(rows)]):
        seen.append((b.num_rows, len(asked)))
    assert seen == [(3, 3), (3, 6), (3, 9), (1, 10)]


def test_files_are_written_by_workers(spark, tmp_path, monkeypatch):
    """Not one after the other by the driver; the pages of each file are rows of their own."""
    rows = spark.createDataFrame([(f"S ({i}).pdf", f"a {i}\fb".encode()) for i in range(40)] + [("note.txt", b"no")], "name string, content binary")
    monkeypatch.setattr(type(rows), "toLocalIterator", lambda *_: pytest.fail("the driver writes"))
    folder = str(tmp_path / "files")
    S.write_files(rows, folder)
    found = D.scan_pdf_dir(spark, folder)
    assert {(r.document_id, bytes(r.content)) for r in found.collect()} == {(f"S_{i}", f"a {i}\fb".encode()) for i in range(40)}
    assert (tmp_path / "files" / "note.txt").read_bytes() == b"no"
    reader = lambda content, zoom: [{"text": t, "blocks": [(0, 0, 1, 1, t, 0, 0)] if t != "b" else [], "words": [(0, 0, 1, 1, w, 0, 0, i) for i, w in enumerate(t.split())], "png": b"x"} for t in content.decode().split("\f")]
    pages = D.pdf_pages(found, reader).where("document_id = 'S_3'").orderBy("page_num").collect()
    assert [(r.page_num, r.n_pages, r.text, [b.text for b in r.blocks], [(w.text, w.x1, w.word_no) for w in r.words]) for r in pages] == [(1, 2, "a 3", ["a 3"], [("a", 1.0, 0), ("3", 1.0, 1)]), (2, 2, "b", [], [("b", 1.0, 0)])]


def test_reports_read_kept_chunks(spark):
    """The chunks of a report are made once, not again for its cards, colors and outline."""
    from quire.plans import catalogue

    found = catalogue.report_counts(spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("/quire-files-" in f for f in found.inputFiles())


def test_reading_order_of_page_arrays(spark, tmp_path):
    """A page's array of words is sorted where it lies, as rows of words are; the query sends texts, not rows of words, and
    texts of one doc_id are one page."""
    rng = random.Random(5)
    words = [(1, rng.randrange(3), rng.randrange(3), i, 0.0, 0.0, 1.0, 1.0, f"w{i}") for i in range(40)]
    rng.shuffle(words)
    rows = spark.createDataFrame(words, "page int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    as_array = rows.groupBy("page").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text", "block_no", "line_no", "word_no")).alias("w"))
    got = as_array.select(P.reading_order(F.col("w")).alias("words")).first()["words"]
    assert got == P.page_words(rows, "page").first()["words"]
    assert [w["text"] for w in got] == [w[-1] for w in sorted(words)]
    spark.createDataFrame([(1, "a b"), (1, "c"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalogue.QUERIES["page_words"](spark, str(tmp_path))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.n_words, " ".join(sorted(r.words.split()))) for r in out.collect()} == {(1, 3, "a b c"), (3, 1, "")}


def test_usual_lines_need_no_long_check(spark):
    """Lines of the usual shape are told at once, and no line that the long check finds fault with is among them."""
    of = lambda fields: {k: 1 if t == "int" else [] if t == "array<string>" else "paragraph" if k == "content_type" else "new" if k == "continuation_status" else "x" for k, t in fields.items()}
    good = of(D.schema.CHUNK_FIELDS) | {"metadata": of(D.schema.METADATA_FIELDS)}
    bad = [{k: v for k, v in good.items() if k != c} for c in good] + [{**good, c: v} for c in good for v in (None, 1, 1.5, "x", [1], [None], ["a", None], {}, True)]
    bad += [{**good, "metadata": {**good["metadata"], c: v}} for c in good["metadata"] for v in (None, 1, 1.5, "x", [])]
    usual = [good, {**good, "keywords": ["a"], "table_markdown": None}]
    rows = spark.createDataFrame([(json.dumps(r), i < len(usual)) for i, r in enumerate(usual + bad)], "value string, usual boolean").withColumn("v", F.try_parse_json("value"))
    got = rows.select("usual", D.surely_valid(F.col("v")).alias("sure"), D.chunk_error(F.col("v")).alias("error")).collect()
    assert all(r.sure for r in got if r.usual) and not [r for r in got if r.sure and r.error] and sum(r.error is not None for r in got) > 100
    words = spark.createDataFrame([("\u212aelvin KELVIN Stra\u00dfe \u0130stan \uac00\ub098\ub2e4\ub77c",), ("\u00c9TATS Word",)], "t string").select(T.significant_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in words] == [["elvin", "kelvin", "stra", "stan", "\uac00\ub098\ub2e4\ub77c"], ["tats", "word"]]


def test_most_words_against_all_pairs(spark):
    """Also chunks over many spots, pages that are not there, and pages of many rows; a chunk is not sent to each of its pages."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"word{rng.randrange(30)}" for _ in range(n))
    lines = [(k, p, text(8)) for k in range(3) for p in range(1, 60) if p % 9 for _ in range(2)]
    chunks = [(k, i, s, e, text(rng.choice([4, 9, 20]))) for k in range(3) for i in range(60) for s in [rng.randrange(1, 70)] for e in [rng.choice([None, s, s + 2, s + 45, s - 1])]]
    pages = spark.createDataFrame(lines, "k int, page_num int, text string")
    df = spark.createDataFrame(chunks, "k int, seq int, page_start int, page_end int, chunk_text string")
    out = L.most_words(df, pages, "k")
    said, _ = L.near_spots(df.where("page_end is null"), pages, "k")
    assert said.count() == df.where("page_end is null and page_start <= 62").count()
    words = {}
    for k, p, t in lines:
        words.setdefault((k, p), set()).update(t.split())
    want = set()
    for k, i, s, e, t in chunks:
        near = [(-len(words[k, p] & set(t.split())), p) for p in range(max(1, s - 3), (s if e is None else e) + 4) if (k, p) in words]
        if near and -min(near)[0] >= L.MIN_MATCHED:
            want.add((k, i, s, min(near)[1], -min(near)[0]))
    assert {(r.k, r.seq, r.page_start, r.page_num, r.score) for r in out.collect()} == want and len(want) > 20


def test_all_matches_without_pairs(spark):
    rng = random.Random(8)
    pairs = [random_match(rng) for _ in range(90)]
    word = "struct<x0:double,y0:double,x1:double,y1:double,text:string>"
    texts = {(k, p): pairs[(k * 45 + p) % 90][0] for k in range(2) for p in range(1, 46)}
    texts[0, 3] = ["A\nb", *texts[0, 3]]
    pages = spark.createDataFrame([(k, p, [(0.0, 0.0, 1.0, 1.0, w) for w in ws]) for (k, p), ws in texts.items()], f"k int, page_num int, words array<{word}>")
    chunks = [(k, p, p, rng.choice([None, p, p + 1, p + 40]), " ".join(pairs[(k * 45 + p) % 90][1]), None, "paragraph") for k in range(2) for p in range(1, 46)]
    df = spark.createDataFrame(chunks, "k int, seq int, page_start int, page_end int, chunk_text string, table_markdown string, content_type string")
    got = {(r.k, r.seq, r.page_num): (r.places, r.offset) for r in L.all_matches(df, pages, "k").collect()}
    old = {(r.k, r.seq, r.page_num): (r.places, r.offset) for r in L.matched(L.possible_pages(df, pages, "k", 0), "k").collect() if r.n_tokens >= L.MIN_MATCHED}
    assert got == old and len(got) > 90


def test_texts_are_sent_not_their_tokens(spark):
    """Pages with words and pages with a text, whose boxes ``lay`` tells, give the same; behind the exchange by spots lie the
    arrays: of tokens, and of boxes that are told by rule, none is sent."""
    rng = random.Random(9)
    kinds = [*(f"W{k}," for k in range(40)), "--", "ß-x"]
    texts = {p: [rng.choice(kinds) for _ in range(rng.randrange(1, 80))] for p in range(1, 71)}
    lay = lambda n: [np.arange(n) % 10 * 50.0, np.arange(n) // 10 * 30.0, np.arange(n) % 10 * 50.0 + 45, np.arange(n) // 10 * 30.0 + 12]
    rows = [(1, p, [(*(float(x) for x in box), w) for box, w in zip(zip(*lay(len(t)), strict=True), t, strict=True)], rng.choice([" ", "\t  "]).join(t)) for p, t in texts.items()]
    pages = spark.createDataFrame([*rows, (1, 0, rows[0][2], rows[0][3]), (None, 1, rows[0][2], rows[0][3])], "k int, page_num int, words array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>, text string")
    chunks = [(1, i, p, e, " ".join(texts[p][rng.randrange(5) :] + texts[p + 1]), None, "paragraph") for i in range(60) for p in [rng.randrange(1, 70)] for e in [rng.choice([None, p, 70])]]
    df = spark.createDataFrame(chunks, "k int, seq int, page_start int, page_end int, chunk_text string, table_markdown string, content_type string")

    def sent(met):
        plan = met._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "RepartitionByExpression":
            plan = plan.children().head()
        columns = plan.child().output()
        return [columns.apply(i).dataType().simpleString() for i in range(columns.size())]

    assert [t for t in sent(L._met(df, pages.drop("text"), "k")) if "array" in t] == ["array<double>"] * 4  # the boxes
    assert not [t for t in sent(L._met(df, pages.drop("text"), "k", boxes=False)) if "array" in t]
    assert not [t for t in sent(L._met(df, pages.drop("words"), "k")) if "array" in t]
    found = lambda out: sorted((r.seq, r.role, r.page_num, r.score, r.offset, [tuple(b) for b in r.boxes]) for r in out.collect())
    got = found(L.find_matching_pages(df, pages.drop("words"), "k", lay=lay))
    assert got == found(L.find_matching_pages(df, pages.drop("text"), "k")) and len(got) >= 60


def test_chunks_and_pages_share_an_exchange(spark):
    """Chunks that are made of a document's pages are made where the pages are, of texts that are sent once."""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    df = catalogue.QUERIES["pages_by_hand"](spark, "/root/testdata/sf0.001")
    assert df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
