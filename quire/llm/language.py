"""Language ID of web pages by Bayesian evidence fusion.

Evidence: the likelihood of the visible text under character trigram models, the declared markup language, the address
suffix, and a prior for the host. The trigram models are learned from a sample of documents of known language. The
text-only posteriors of all pages, summed by grouped aggregation, then give the reliability of the other evidence:
P(declared | language) and P(suffix | language), smoothed over the values that occur, and host priors smoothed over the
hierarchy host, registrable domain, all pages. No page and no host counts twice: a page's own share is left out, and the domain's level
holds its other hosts only. The fused posterior is the normalised product.

The registrable domain is the last two labels of a host, or three after a short second level under a country (co.uk).
SAMPLE bounds the documents for learning (chosen by hash); the model's size is fixed. Pages with null or empty markup,
no address or no declaration use the evidence they have; without any it is the overall prior. Null page_ids are kept. Repeated rows get equal
results. Unknown languages in declarations are just another value. Ties go to the language that is first by name. Other
columns are ignored. An empty table gives an empty one; without documents of known language there is no language (null).
Hot hosts, suffixes and declarations are summed before the shuffle, and their sums are broadcast (``skewed_join``).
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import skewed_join, table, written

SAMPLE = 8_000  # documents for learning, about
BUCKETS = 1 << 16  # of hashed trigrams
TEMPER = 60.0  # a text counts as so many independent trigrams at most
SMOOTH = 5.0  # pseudo-pages that each level of the hierarchy lends to the one below
_STARTS = re.compile(r"(?i)<!--|<(script|style)\b|<")
_ENDS = {t: re.compile(rf"(?i)</{t}\s*>") for t in ("script", "style")}
_TOP = re.compile(r"(?i)<(html|meta)\b")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})\b""")
_CONTENT = re.compile(r"""(?i)content\s*=\s*["']?([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


# fixed values: second levels under which names are registered in many countries
_SECOND = {"ac", "co", "com", "edu", "gob", "gov", "gouv", "net", "nom", "or", "org"}


def visible(markup: str) -> str:
    """Markup with a blank for each script, style sheet, comment and tag. One pass: that an end is missing from here on is
    remembered, so that no start looks for it again."""
    out, at, missing = [], 0, set()
    while (m := _STARTS.search(markup, at)) is not None:
        out.append(markup[at : m.start()])
        end, kind = -1, "-->" if m[0] == "<!--" else (m[1] or "").lower()
        if kind and kind not in missing:
            if kind == "-->":
                found = markup.find(kind, m.end())
                end = found + 3 if found >= 0 else -1
            else:
                found = _ENDS[kind].search(markup, m.end())
                end = found.end() if found else -1
            if end < 0:
                missing.add(kind)
        if end < 0:
            end = markup.find(">", m.start()) + 1
            if not end:
                at = m.start()
                break
        out.append(" ")
        at = end
    return "".join([*out, markup[at:]])


def declared_language(markup: str) -> str:
    """The language that the first html tag with one, or meta tag for the content's language, names; or ''. What stands before
    the next ``>`` is read once, however many tags begin in it."""
    at = 0
    while (m := _TOP.search(markup, at)) is not None:
        end = markup.find(">", m.end())
        end = len(markup) if end < 0 else end
        tag, found = markup[m.start() : end], []
        for start in {k: t.start() for t in reversed([*_TOP.finditer(tag)]) for k in [t[1].lower()]}.items():
            if start[0] == "html":
                value = _LANG.search(tag, start[1] + 5)
            else:
                named = tag.lower().find("content-language", start[1] + 5)
                value = [*_CONTENT.finditer(tag, named + 16)][-1:] if named >= 0 else []
                value = value[0] if value else None
            if value:
                found.append((start[1], value[1].lower()))
        if found:
            return min(found)[1]
        at = end
    return ""


def registrable(host: str) -> str:
    parts = host.split(".")
    return ".".join(parts[-3:] if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in _SECOND else parts[-2:])


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the letters, in lower case, with single blanks between words."""
    clean = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not clean:
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return (h >> np.uint64(16)).astype(np.int64)


def learn(docs: DataFrame, bound: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of trigrams; BUCKETS counts of each language reach the driver."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) < int(bound / n * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])], ["lang", "bucket", "n"])

    rows = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    logs = np.zeros((len(langs), BUCKETS))
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        logs[k, mine["bucket"]] = mine["n"]
    logs = np.log((logs + 0.05) / (logs.sum(1, keepdims=True) + 0.05 * BUCKETS))
    return langs, logs


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, p (the text-only posterior, array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, url, markup in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                m = _HOST.match(url or "")
                host = m[1].lower().rstrip(".") if m else ""
                parts = host.split(".") if host else []
                t = trigrams(html_lib.unescape(visible(markup or "")))
                ll = logs[:, t].sum(1) * min(1.0, TEMPER / max(1, len(t))) if len(t) else np.zeros(len(langs))
                p = np.exp(ll - ll.max()) if len(langs) else ll
                rows.append((page, host, registrable(host), parts[-1] if parts else "", declared_language(markup or ""), (p / p.sum()).tolist() if len(langs) else []))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), *[pa.string()] * 4, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "host", "domain", "suffix", "declared", "p"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, p array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang, lang, confidence for every row of ``pages``."""
    langs, logs = learn(docs)
    seen = written(evidence(pages, langs, logs))
    if not langs:
        return seen.select("page_id", "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    k = range(len(langs))

    def sums(by: str, name: str, *more: str) -> DataFrame:
        return seen.groupBy(by, *more).agg(*(F.sum(F.col("p")[i]).alias(f"{name}{i}") for i in k), F.count("*").alias("n"))

    hosts = written(sums("host", "h", "domain"))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in k))
    hosts = hosts.join(domains, "domain").drop("domain")
    declared, suffixes = written(sums("declared", "m")), written(sums("suffix", "s"))
    # one number for each language, and two more, reach the driver
    whole = seen.agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"w{i}") for i in k), F.count("*").alias("n")).first()
    values = {"m": declared.count(), "s": suffixes.count()}
    out = skewed_join(seen, written(hosts), "host", "n", whole["n"])
    out = written(skewed_join(written(out), declared, "declared", "n", whole["n"]))  # read twice each, so written
    out = skewed_join(out, suffixes, "suffix", "n", whole["n"])
    p = [F.col("p")[i] for i in k]

    def share(own: list, above: list) -> list:
        n = sum(own[1:], start=own[0])
        return [(own[i] + SMOOTH * above[i]) / (n + SMOOTH) for i in k]

    def less(name: str, other: list) -> list:
        return [F.greatest(F.col(f"{name}{i}") - other[i], F.lit(0.0)) for i in k]

    top = [F.lit((whole[i] + 1) / (sum(whole[j] for j in k) + len(langs))) for i in k]
    host = share(less("h", p), share(less("d", [F.col(f"h{i}") for i in k]), top))
    logs_ = [F.log(F.greatest(p[i], F.lit(1e-12))) + F.log(host[i]) for i in k]
    for name, many in values.items():  # P(value | language), without the page itself
        logs_ = [x + F.log((less(name, p)[i] + 0.5) / (whole[i] + 0.5 * many)) for i, x in enumerate(logs_)]
    out = out.withColumn("_l", F.array(*logs_)).withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.array_max("_l"))))
    names = F.lit(langs)
    best = F.array_position("_e", F.array_max("_e")).cast("int")
    sum_e = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return out.select("page_id", "host", "declared", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"), F.element_at(names, best).alias("lang"), (F.array_max("_e") / sum_e).alias("confidence"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
