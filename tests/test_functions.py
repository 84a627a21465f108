import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_coverage(spark):
    def ratio(text, texts):
        return one(spark, T.coverage_ratio(F.lit(text), F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>")))

    assert ratio("The quick brown fox jumps", ["quick brown the fox jumps"]) == 1.0
    assert 0 < ratio("alpha beta gamma delta", ["alpha and beta"]) < 0.7
    assert ratio("", ["x"]) == 1.0 and ratio("1 2 3 - a an", []) == 1.0
    assert ratio("completely different words", ["nothing shared here"]) == 0.0
    assert ratio("UPPER Lower", ["upper LOWER"]) == 1.0


def test_words_keep_to_the_class(spark):
    # the Kelvin sign and the dotted capital I must not become letters of the class
    assert one(spark, T.significant_words(F.lit("Kelvin İstanbul schpfö 하나은행은 ab_cdefg"))) == ["elvin", "stanbul", "schpf", "하나은행은", "cdefg"]


def test_slugs(spark):
    assert one(spark, T.slugify(F.lit("Hana Bank: Term Deposit (v2).pdf"))) == "Hana_Bank_Term_Deposit_v2_.pdf"
    assert one(spark, T.slugify(F.lit("하나은행 정기예금"))) == "하나은행_정기예금"
    assert one(spark, T.slugify(F.lit("ﬁle"))) == "file"
    assert one(spark, T.safe_stem(F.lit("/a/b/Term Deposit.v2.pdf"))) == "Term_Deposit.v2"
    assert one(spark, T.id_resolver(F.lit("s"), F.lit("Term_Deposit_Guide"))) == "term_deposit_guide"
    assert one(spark, T.id_resolver(F.lit("s"), F.lit("어떤 문서_v2"))) == "v2"
    assert one(spark, T.id_resolver(F.lit("s"), F.lit("문서"))) == "document"


def test_slug_query_reads_whole_texts(spark, tmp_path):
    texts = ["(ﬁrst) " + "Ünïcode, words: " * 40 + "①② ｆｕｌｌ　ｗｉｄｔｈ 하나은행\nlast_line.", "a b", " \n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.slug for r in catalogue.QUERIES["slugify_nfkc"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else re.sub(r"[^\w.-]+", "_", unicodedata.normalize("NFKC", t)).strip("_") for i, t in enumerate(texts)}


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.strip(F.lit(T.WHITE + "x" + T.WHITE))) == "x"


@pytest.mark.parametrize("text", ['{"a": 1}', '```json\n{"a": 1}\n```', 'Here: {"a": 1} done.'])
def test_json_extraction(spark, text):
    assert T.extract_json(text) == {"a": 1}
    assert json.loads(one(spark, T.json_object_text(F.lit(text)))) == {"a": 1}


def test_json_extraction_fails(spark):
    with pytest.raises(ValueError):
        T.extract_json("no json here")
    assert one(spark, T.json_object_text(F.lit("no json here"))) is None
    assert one(spark, T.strict_json(F.lit("no json here")))["error"].startswith("no JSON object")


def test_embedding_text(spark):
    e = T.embedding_text(F.lit("S"), F.lit("A"), F.lit(None), F.lit(None), F.array(F.lit("k"), F.lit("l")), F.array().cast("array<string>"), F.lit("body  "))
    assert one(spark, e) == "source: S\ntitle: A\nsection: \ntopic: \nkeywords: k, l\nentities: \n\ncontent:\nbody"


def test_prompts(spark):
    s = F.lit
    p = one(spark, T.build_prompt(s("d {{source}}"), s("S"), s(1), s(2), s(""), s(None).cast("string"), s(""), s("")))
    assert "d S (S), pages 1 to 2" in p and T.NO_PAGE_TEXT in p and T.NO_OUTLINE in p and "{{" not in p
    assert T.NO_DOCUMENT_TEXT in one(spark, T.build_outline_prompt(s("d"), s("S"), s("")))


def test_known_outline(spark):
    def render(o):
        return one(spark, T.render_known_outline(F.from_json(F.lit(json.dumps(o)), T.OUTLINE_TYPE)))

    full = {"level_1": "D", "sections": [{"level_2": "A", "first_page": 1, "subsections": [{"level_3": "a"}, {"level_3": ""}]}, {"level_2": "", "subsections": [{"level_3": "x"}]}, {"level_2": "B"}]}
    assert render(full) == "- D\n  - A\n    - a\n  - B"
    assert render({}) == ""


def test_html(spark):
    assert one(spark, T.table_md_to_html(F.lit("one row"))) == "<pre>one row</pre>"
    assert one(spark, T.heading_breadcrumb(F.lit("A&B"), F.lit(""), F.lit("C"))) == "A&amp;B &rsaquo; C"
    assert one(spark, T.hex_to_rgb(F.lit("#0a10ff"))) == [10, 16, 255]


def test_colors(spark):
    import colorsys

    for i in range(12):
        rgb = colorsys.hls_to_rgb(i * T.TURN % 1.0, 0.45, 0.6)
        assert one(spark, T.section_color(F.lit(i))) == "#" + "".join(f"{round(c * 255):02x}" for c in rgb)


def test_images_have_one_line(spark):
    import base64

    data = bytes(range(256)) * 3
    assert one(spark, T.image_url(F.lit(data))) == "data:image/png;base64," + base64.b64encode(data).decode()


def test_settings_file(tmp_path, monkeypatch):
    from quire.plans import process as R

    (tmp_path / "env").write_text("# x\nexport QUIRE_VLM_MODEL='a b' # c\nSET=new\n")
    monkeypatch.setenv("SET", "old")
    monkeypatch.delenv(R.MODEL_VARIABLE, raising=False)
    monkeypatch.setattr("os.environ", dict(__import__("os").environ))
    assert R.load_env(str(tmp_path / "env")) == {"QUIRE_VLM_MODEL": "a b", "SET": "new"} and R.load_env(str(tmp_path / "none")) == {}
    assert R.model_name() == "a b" and __import__("os").environ["SET"] == "old"
