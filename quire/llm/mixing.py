"""Mixing sources to target weights: soft membership and projected-gradient least squares [native].

Domains are the values of a label, any number of them. A naive Bayes classifier over hashed words and word ends, the share of
different words and the number of words, learned by grouped counts from at most SAMPLE labelled rows, gives every document
its domain posteriors; how many words of a text count as independent evidence is chosen on rows of the sample that the
counts leave out. The expected tokens of domain k under rates r are
the sum over documents of tokens * posterior_k * r, and the rates minimise

    sum_k (expected_k - target_k)^2 / natural_k + RIDGE * sum tokens * (rate - 1)^2,   rate >= 0

over all documents. The rates' gradient is a combination of the posteriors with one coefficient for each domain, so every
iterate is the projection max(0, 1 - sum_k a_k * posterior_k); a step adds the gradient to the coefficients, scaled by the
Gram matrix of the posteriors of the documents whose rate is positive. Each step is one aggregation over the table of
posteriors; the driver sees a number for each domain and each pair of domains.

Targets are shares; their total is the largest that no domain has to be repeated for, times ``headroom``.
``copies`` is floor(rate + u), u a hash of doc_id: the expected number of copies is the rate.

Null and empty texts have no tokens, and posteriors by the prior and their bins. A domain without labelled rows is one of the prior only;
without labels all posteriors are equal. Labels of a doc_id that disagree count once for each domain. Repeated rows get
equal results. Other columns are kept, but for those that have the name of a result (tokens, p_*, rate, copies). An empty
table gives an empty one.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, quoted, table, without, written

SAMPLE = 30_000  # labelled rows for learning, about
BUCKETS = 1 << 15  # of hashed words and word ends
SMOOTH = 0.5  # pseudo-words in a bucket
SURE = 5.0  # standard errors from which a bucket's ratio of two domains counts at all
EVIDENCE = [0.0, *(2.0**k for k in range(0, 13))]  # numbers of words that are tried as the most a text's words count for
BINS = 12  # of the share of different words, and of the logarithm of the number of words
TARGETS = {"english": 0.55, "other": 0.4, "low": 0.05}
RIDGE = 0.001
STEPS, SMALL = 30, 1e-6


def _numbers(x) -> Column:
    """An array literal; a text that is parsed once is far quicker to plan than thousands of literals."""
    return F.from_json(F.lit(json.dumps([round(float(v), 6) for v in x])), "array<double>")


def _bucket(x: Column) -> Column:
    return F.xxhash64(x).bitwiseAND(BUCKETS - 1).cast("int")


def _buckets(word: Column) -> tuple[Column, Column]:
    """Of a word and of its end (three characters)."""
    return _bucket(word), _bucket(F.right(word, F.lit(3)))


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with columns by ``names``: the words, their number, the bin of the share of different words, the bin of
    the number."""
    words, tokens, variety, size = names
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" "))
    out = docs.withColumn(words, F.array_remove(F.split(text, " "), ""))
    out = out.withColumns({tokens: F.size(words).cast("long"), variety: F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))})
    return out.withColumns({variety: F.least((F.col(variety) * BINS).cast("int"), F.lit(BINS - 1)), size: F.least(F.log(F.col(tokens) + 1.0).cast("int"), F.lit(BINS - 1))})


def _ratios(counts: np.ndarray, sure: float = 0.0) -> np.ndarray:
    """Log-ratios of each domain's shares to the first one's; 0 where they may be chance."""
    n = counts + SMOOTH
    logs = np.log(n / n.sum(1, keepdims=True))
    error = np.sqrt(1 / n[1:] + 1 / n[:1])
    return np.where(np.abs(logs[1:] - logs[0]) >= sure * error, logs[1:] - logs[0], 0.0)


def _signs(names: list[str], model: dict) -> list[tuple[Column, Column]]:
    """For each domain but the first: the mean log-ratio of a text's words, and the sum of those of its two bins."""
    words, tokens, variety, size = names

    def total(weights: Column) -> Column:
        def add(a: Column, w: Column) -> Column:
            whole, end = _buckets(w)
            return a + F.get(weights, whole) + F.get(weights, end)

        return F.aggregate(words, F.lit(0.0), add)

    n = F.greatest(F.col(tokens), F.lit(1))
    return [(total(_numbers(w)) / n, F.get(_numbers(v), F.col(variety)) + F.get(_numbers(s), F.col(size))) for w, v, s in zip(model["words"], model["variety"], model["size"], strict=True)]


def _softmax(signs: list[tuple[Column, Column]], tokens: Column, prior: np.ndarray, evidence: list[float]) -> list[Column]:
    odds = []
    for k, (mean, bins) in enumerate(signs):
        x = mean * F.least(tokens.cast("double"), F.lit(float(evidence[k]))) + bins + float(math.log(prior[k + 1] / prior[0]))
        odds.append(F.exp(F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))
    total = sum(odds, start=F.lit(1.0))
    return [1.0 / total, *(o / total for o in odds)]


def learn(docs: DataFrame, labels: DataFrame, domains: list[str], bound: int = SAMPLE) -> dict:
    """A classifier from about ``bound`` labelled rows (chosen by hash of doc_id; labels: doc_id, domain).

    Three quarters of them are counted; on the rest it is chosen how much the words count for. The driver gets BUCKETS
    counts of each domain, and losses.
    """
    labels = labels.where("doc_id is not null").where(F.col("domain").isin(domains)).select("doc_id", "domain").distinct()
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["w", "tokens", "variety", "size"]
    rows = _counted(own.join(F.broadcast(labels), "doc_id"), names)  # labels: ``bound`` rows
    rows = written(rows.select(*names, F.array_position(F.lit(domains), F.col("domain")).cast("int").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).alias("fold")))
    prior = np.ones(len(domains))
    tables = {"words": np.zeros((len(domains), BUCKETS)), "variety": np.zeros((len(domains), BINS)), "size": np.zeros((len(domains), BINS))}
    counted = rows.where("fold > 0")
    for r in counted.groupBy("y", "variety", "size").count().collect():
        tables["variety"][r["y"] - 1, r["variety"]] += r["count"]
        tables["size"][r["y"] - 1, r["size"]] += r["count"]
        prior[r["y"] - 1] += r["count"]
    each = counted.select("y", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda w: F.array(*_buckets(w)))))).alias("b"))  # a bucket counts once a text
    for r in each.groupBy("y", "b").count().collect():
        tables["words"][r["y"] - 1, r["b"]] += r["count"]
    model = {"domains": domains, "prior": prior / prior.sum(), "evidence": [1.0] * (len(domains) - 1)} | {k: _ratios(v, SURE if k == "words" else 0.0) for k, v in tables.items()}
    held = written(rows.where("fold = 0").select("tokens", "y", *(x.alias(f"{name}{k}") for k, s in enumerate(_signs(names, model)) for name, x in zip("mv", s, strict=True))))
    signs = [(F.col(f"m{k}"), F.col(f"v{k}")) for k in range(len(domains) - 1)]
    for k in [*range(len(signs))] * 2 if len(signs) > 1 else [0] * len(signs):  # one domain's evidence after the other
        tried = [[*model["evidence"][:k], e, *model["evidence"][k + 1 :]] for e in EVIDENCE]
        loss = [F.avg(-F.log(F.greatest(F.get(F.array(*_softmax(signs, F.col("tokens"), model["prior"], t)), F.col("y") - 1), F.lit(1e-12)))) for t in tried]
        found = held.agg(*loss).first()
        best = min(range(len(EVIDENCE)), key=lambda i: (found[i] if found[i] is not None else 0.0, i))
        model |= {"evidence": tried[best], "loss": found[best]}
    return model


def posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """The rows and columns of ``docs``, and tokens and p_<domain>."""
    results = ["tokens", *(f"p_{d}" for d in model["domains"])]
    docs = without(docs, *results)
    names = fresh(docs, "words_", "tokens_", "variety_", "size_", *(f"{x}{k}_" for k in range(1, len(model["domains"])) for x in "mv"))
    signs = [x for s in _signs(names[:4], model) for x in s]
    out = _counted(docs, names[:4]).withColumns(dict(zip(names[4:], signs, strict=True)))
    pairs = [(F.col(m), F.col(v)) for m, v in zip(names[4::2], names[5::2], strict=True)]
    p = _softmax(pairs, F.col(names[1]), model["prior"], model["evidence"])
    return out.select(*map(quoted, docs.columns), F.col(names[1]).alias("tokens"), *(x.alias(r) for x, r in zip(p, results[1:], strict=True)))


def rate_of(p: list[Column], a: list[float]) -> Column:
    return F.greatest(F.lit(0.0), sum((-float(x) * c for x, c in zip(a, p, strict=True)), start=F.lit(1.0)))


def fit_rates(rows: DataFrame, targets: dict[str, float], headroom: float = 1.0, steps: int = STEPS) -> tuple[list[float], dict]:
    """The coefficients of the rates, and totals. rows: tokens, p_<domain>."""
    p = [F.col(f"p_{d}") for d in targets]
    many, share = len(p), np.array(list(targets.values())) / sum(targets.values())

    def sums(a: list[float]) -> tuple[np.ndarray, np.ndarray]:
        rate, t = rate_of(p, a), F.col("tokens")
        pairs = [(j, k) for j in range(many) for k in range(j, many)]
        row = rows.agg(*(F.sum(t * x * rate) for x in p), *(F.sum(F.when(rate > 0, t * p[j] * p[k])) for j, k in pairs)).first()
        gram = np.zeros((many, many))
        for (j, k), v in zip(pairs, row[many:], strict=True):
            gram[j, k] = gram[k, j] = v or 0.0
        return np.array([v or 0.0 for v in row[:many]]), gram

    a = np.zeros(many)
    natural, gram = sums(a.tolist())
    total = natural.sum()
    if not total:
        return a.tolist(), {"natural": [0.0] * many, "target": [0.0] * many, "expected": [0.0] * many, "steps": 0}
    natural = np.maximum(natural / total, 1e-12)
    target = share * headroom * min(n / s for n, s in zip(natural, share, strict=True) if s > 0)
    expected, done, length = natural, 0, 1.0
    off = np.abs((expected - target) / natural).max()
    for done in range(1, steps + 1):
        scaled = np.linalg.solve(gram / total + RIDGE * np.diag(natural), RIDGE * natural * a - (expected - target))
        while True:
            new = a - length * scaled
            got, new_gram = sums(new.tolist())
            left = np.abs((RIDGE * natural * new - (got / total - target)) / natural).max()
            if left < off or length < 1e-3:
                break
            length /= 2
        moved = np.abs(new - a).max()
        a, gram, expected, off, length = new, new_gram, got / total, left, min(1.0, 2 * length)
        if off < SMALL or moved < SMALL:
            break
    return a.tolist(), {"natural": natural.tolist(), "target": target.tolist(), "expected": expected.tolist(), "steps": done}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, headroom: float = 1.0, drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows and columns of ``docs`` (without those in ``drop``) with tokens, p_<domain>, rate and copies.

    labels: doc_id, domain; ``targets``: the share of each domain.
    """
    docs = without(docs, "rate", "copies")
    scored = written(without(posteriors(docs, learn(docs, labels, list(targets))), *drop))
    a, _ = fit_rates(scored, targets, headroom)
    out = scored.withColumn("rate", rate_of([F.col(f"p_{d}") for d in targets], a))
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 32)) / float(1 << 32)
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def quality_domain() -> Column:
    """low or high, by the label ``quality``."""
    return F.when(F.col("quality") > 0, "high").when(F.col("quality").isNotNull(), "low")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domains are texts of low quality and, of the others, those in English and in other languages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    marked = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    domain = F.when(quality_domain() == "low", "low").when(F.col("lang") == "en", "english").when(F.col("lang").isNotNull(), "other")
    return mix(docs, marked.select("doc_id", F.when(quality_domain().isNotNull(), domain).alias("domain")), drop=("text",))
