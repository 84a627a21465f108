"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

A lexicon is learned from labelled training rows: words and word beginnings whose document frequency among toxic rows exceeds that among
others by far, and surely. The trie of its words is walked by the Levenshtein automaton of each text word (prefix rows of the edit
distance, cut where all entries exceed the budget), turned around: the automaton of the whole trie is built lazily as a
deterministic one, its states being sets of (trie node, edits so far), so each text word is read once and most die
after a few letters. Words with digits or signs among their letters (``id1ot``, ``st*pid``) are read as they stand, each sign being a
wrong letter, and without the signs (``i.d.i.o.t``). A match has the weight its word learned; a misspelled one less, and none if the
surface form is common in harmless training rows. A match inside quotation marks or next to a word of speech within a window
of WINDOW words counts as quoted. A logistic regression over the logarithms of the matches' sums gives the score.

Learning uses at most SAMPLE labelled rows, about, chosen by hash, of those whose crc32(doc_id as text) mod 3 is not 1; lexicon
and harmless forms are words of these rows, so the sample bounds them as well. Near copies among them (``_training``) count once. Labels of one doc_id that disagree count as
toxic. Null and empty texts score as texts without matches. Null ``doc_id``s are scored and never held out. Repeated
rows get equal scores. Without toxic labels the score is that of an empty model. Other columns are kept, but for one that has the name
of the result ``score``. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import quoted, table, without, written
from quire.llm.simhash import SIMILAR, shingles

SAMPLE = 40_000  # labelled rows for learning, about
RATIO = 8.0  # of the smoothed document frequencies, for a lexicon word
CERTAIN = 28.0  # its log-likelihood ratio statistic; chance reaches it once in ten million words
STEMS = (4, 5, 6, 7, 8)  # letters of the word beginnings that can be lexicon entries, written with a star
WINDOW = 8  # words on either side of a match
THRESHOLD = 0.7
REMEMBERED = 200_000  # words, and states of an automaton by a quarter of it, that a worker remembers
_WORD = re.compile(r"[^\W\d_]+")
_INNER = r"[0-9@$*!|.·_+-]{1,3}"  # digits and signs that may stand for letters or between them
_NO_LETTER = re.compile(r"[\W\d_]+")
_HAS_INNER = re.compile(rf"(?<=[^\W\d_]){_INNER}(?=[^\W\d_])")
_SIGNED = re.compile(rf"[^\W\d_]+(?:{_INNER}[^\W\d_]+)+")
# fixed values: marks and words of quotation
_MARKS = "\"“”„«»‘’"
_SPEECH = {"said", "says", "quote", "quoted", "quoting", "wrote", "called", "cited", "sagte", "zitat", "dit", "citation", "dijo", "cita"}


class LexiconAutomaton:
    """All words within ``budget(word)`` edits of a lexicon word: one for words of ``least`` letters or more, two from 9.

    State: a frozen set of (trie node, edits); -1 is the dead state. Transitions are remembered.
    """

    def __init__(self, words: list[str], least: int = 5):
        self.least = least
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.room: list[int] = [0]  # the largest budget of a word below the node
        self.stem: list[int] = [-1]  # the beginning that ends at the node
        for k, w in enumerate(words):
            w, star, _ = w.partition("*")
            at, room = 0, 0 if star else self.budget(w)
            self.room[0] = max(self.room[0], room)
            for c in w:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.room.append(0)
                    self.stem.append(-1)
                at = nxt
                self.room[at] = max(self.room[at], room)
            (self.stem if star else self.word)[at] = k
        self.words = words
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.begins: list[int] = []
        self.start = self._state({0: 0})

    def budget(self, word: str) -> int:
        return 0 if len(word) < self.least else 1 if len(word) < 9 else 2

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # letters of the lexicon word that the text lacks
            n = todo.pop()
            for child in self.children[n].values():
                if nodes[n] + 1 <= self.room[child] and nodes[n] + 1 < nodes.get(child, 99):
                    nodes[child] = nodes[n] + 1
                    todo.append(child)
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            found = [(e, self.word[n]) for n, e in key if self.word[n] >= 0 and e <= self.budget(self.words[self.word[n]])]
            self.accepts.append(min(found) if found else None)
            self.begins.append(max([self.stem[n] for n, e in key if e == 0], default=-1))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for n, e in self.states[state]:
            for child_c, child in self.children[n].items():
                cost = e + (child_c != c)
                if cost <= self.room[child] and cost < nodes.get(child, 99):
                    nodes[child] = cost
            if e + 1 <= self.room[n] and e + 1 < nodes.get(n, 99):  # a letter that the lexicon word lacks
                nodes[n] = e + 1
        to = self._state(nodes)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, index) of the nearest lexicon entry: the word, else a longer word's beginning, else a misspelling."""
        if len(self.states) > REMEMBERED // 4:  # forget what is remembered; the answers stay the same
            self.states, self.ids, self.moves, self.accepts, self.begins = [], {}, [], [], []
            self.start = self._state({0: 0})
        state, moves, begins, begin = self.start, self.moves, self.begins, -1
        for c in word:
            if begins[state] >= 0:
                begin = begins[state]
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return (0, begin) if begin >= 0 else None
            state = to
        found = self.accepts[state]
        return (0, begin) if begin >= 0 and (found is None or found[0]) else found


class Matcher:
    """Finds lexicon words and their misspellings in texts; what a word is, is remembered."""

    def __init__(self, words: list[str], benign: set[str] = frozenset()):
        self.automaton, self.benign = LexiconAutomaton(words), benign
        # no plain word holds signs, so there words of four letters may differ as well
        self.signed = LexiconAutomaton([w for w in words if "*" not in w], 4)
        self.at = [k for k, w in enumerate(words) if "*" not in w]
        self.hits: dict[str, tuple[int, int]] = {}
        self.clean: set[str] = set()

    def near(self, word: str) -> tuple[int, int] | None:
        """(edits, index) of the nearest lexicon entry, of a plain word or of one with signs."""
        if _WORD.fullmatch(word):
            return self.automaton.match(word)
        found = [(m[0] + extra, self.at[m[1]]) for form, extra in ((word, 0), (_NO_LETTER.sub("", word), 1)) if (m := self.signed.match(form)) is not None]
        return min(found, default=None)

    def known(self, words: set[str]) -> dict[str, tuple[int, int]]:
        if len(self.clean) > REMEMBERED:
            self.clean.clear()
        for w in words - self.clean - self.hits.keys():
            m = self.near(w)
            if m is None or m[0] and w in self.benign:
                self.clean.add(w)
            else:
                self.hits[w] = m
        out = {w: self.hits[w] for w in words & self.hits.keys()}
        if len(self.hits) > REMEMBERED:
            self.hits.clear()
        return out

    def matches(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(surface, edits, lexicon index, quoted) of each match in a text."""
        low = text.lower()
        hits = self.known(set(_WORD.findall(low)))
        signed = {}
        if _HAS_INNER.search(low):
            signed = self.known({m for m in _SIGNED.findall(low)})
        if not hits and not signed:
            return []
        found = list(_WORD.finditer(low))
        out = [(m.start(), m.end(), m.group(), i, i) for i, m in enumerate(found) if m.group() in hits]
        if signed:
            starts = [m.start() for m in found]
            for m in _SIGNED.finditer(low):
                if m.group() in signed:
                    out.append((m.start(), m.end(), m.group(), bisect_left(starts, m.start()), bisect_left(starts, m.end()) - 1))
        rows = []
        for start, end, w, i, j in sorted(out):
            a, z = found[max(0, i - WINDOW)], found[min(len(found) - 1, j + WINDOW)]
            before, after = low[a.start() : start].rpartition("\n")[2], low[end : z.end()].partition("\n")[0]
            quoted = any(q in before for q in _MARKS) and any(q in after for q in _MARKS) or any(x.group() in _SPEECH for x in found[max(0, i - WINDOW) : i])
            rows.append((w, *(hits.get(w) or signed[w]), quoted))
        return rows


def features(text: str | None, weights: list[float], matcher: Matcher) -> list[float]:
    """1, logarithms of the sums of the weights of the different exact matches, of misspelled ones, both quoted, and of
    the number of matches."""
    sums = {(False, False): {}, (False, True): {}, (True, False): {}, (True, True): {}}
    found = matcher.matches(text or "")
    for w, edits, k, quoted in found:
        sums[edits > 0, quoted][w] = weights[k] / (1 + edits)
    tot = {k: sum(v.values()) for k, v in sums.items()}
    return [1.0, *map(math.log1p, (tot[False, False], tot[True, False], tot[False, True] + tot[True, True], len(found)))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """text, toxic of about ``bound`` labelled rows that are not held out.

    Near copies count once, so that a text with many copies teaches no more than another: of the rows of one label whose
    least hashes of five words in a row are equal, a row goes if an earlier one that stays has a similarity of SIMILAR
    or more (the order is that of the texts' hashes, so the same rows stay however they are dealt). Texts that only share a phrase
    stay. At one key meet the shingles of rows of the sample, which ``bound`` bounds.
    """
    labels = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = labels.count()
    if n > bound:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    # about ``bound`` rows of a number and a label: some hundred kilobytes
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id").select("text", "toxic")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [int(min(shingles(t.as_py(), 5), default=0)) - (1 << 63) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(least, pa.int64())], ["text", "toxic", "least"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that are no near copy of an earlier one of their key that stays."""
        at, held = None, []
        for b in batches:
            stay = []
            for text, *here in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("least").to_pylist(), strict=True):
                if here != at:
                    at, held = here, []
                h = shingles(text.as_py(), 5)
                stay.append(not any(_alike(h, other) for other in held))
                if stay[-1]:
                    held.append(h)
            yield b.filter(pa.array(stay, pa.bool_())).select(["text", "toxic"])

    by, order = ["toxic", "least"], [F.xxhash64("text"), F.col("text")]
    rows = rows.distinct().mapInArrow(key, "text string, toxic int, least long")
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(first, "text string, toxic int")


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a similarity of SIMILAR or more."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= SIMILAR * (len(a) + len(b) - same)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge and no negative weight for evidence."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def distinct_terms(bad: dict[str, int]) -> set[str]:
    """Of words and beginnings (with a star) with their toxic rows those that say something of their own: a beginning
    goes if a single longer entry makes up nearly all of it, and an entry under a beginning that stays if it is a small part."""

    def under(stem: str, entry: str) -> bool:
        return entry != stem and entry.startswith(stem[:-1])

    order, stems = sorted(bad), set()
    for w in order:  # entries under a beginning follow it
        if w.endswith("*"):
            most = 0
            for c in order[bisect_left(order, w[:-1]) :]:
                if not c.startswith(w[:-1]):
                    break
                most = max(most, bad[c] if c != w else 0)
            if most < 0.9 * bad[w]:
                stems.add(w)
    return {w for w in bad if (w in stems or not w.endswith("*")) and not any(under(s, w) and 2 * bad[w] < bad[s] for k in STEMS if (s := w[:k] + "*") in stems)}


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict:
    """Lexicon, weights and regression from about ``bound`` labelled rows. The driver gets the lexicon, harmless forms
    near it, and five sums for each row of the sample."""
    sample = written(_training(docs, labels, bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        totals = [0, 0]

        def out() -> pa.RecordBatch:
            rows = [*tally.items(), ("", totals)]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([int(c[1]) for _, c in rows], pa.int64()), pa.array([int(c[0]) for _, c in rows], pa.int64())], ["word", "bad", "good"])

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                totals[toxic > 0] += 1
                low = text.lower()
                found = set(_WORD.findall(low))
                signed = {w.replace("*", "\x00") for w in _SIGNED.findall(low)} if _HAS_INNER.search(low) else set()  # a star marks beginnings
                for w in found | signed | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}:
                    tally.setdefault(w, [0, 0])[toxic > 0] += 1
            if len(tally) > 200_000:
                yield out()
                tally, totals = {}, [0, 0]
        yield out()

    counts = written(sample.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    total = counts.where("word = ''").first()
    bad, good = (total["bad"], total["good"]) if total else (0, 0)
    if not bad:
        return {"words": [], "weights": [], "benign": set(), "regression": [math.log((bad + 0.5) / (good + 1)), 0, 0, 0, 0]}
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    both, share = F.col("bad") + F.col("good"), bad / (bad + good)
    part = [F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0) for n, p in ((F.col("bad"), share), (F.col("good"), max(1 - share, 1e-9)))]
    chosen = counts.where((F.length("word") >= 3) & (F.col("bad") > 0)).withColumns({"r": ratio, "g": 2 * (part[0] + part[1])})
    terms = chosen.where((F.col("r") >= RATIO) & (F.col("g") >= CERTAIN) & F.col("word").rlike(r"^[\p{L}\p{M}]+[*]?$")).orderBy(F.desc("g"), "word").collect()
    own = distinct_terms({t["word"]: t["bad"] for t in terms})
    words = [t["word"] for t in terms if t["word"] in own]
    weights = [math.log(t["r"]) for t in terms if t["word"] in own]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words)
        for b in batches:
            yield b.filter(pa.array([(m := matcher.near(w.replace("\x00", "*"))) is not None and m[0] > 0 for w in b.column("word").to_pylist()], pa.bool_()))

    # forms near a lexicon word that harmless rows use as often as toxic ones: words of the sample
    common = counts.where((F.col("word") != "") & ~F.col("word").endswith("*") & (F.col("good") >= 1) & (ratio < RATIO)).select("word").mapInArrow(near, "word string")
    model = {"words": words, "weights": weights, "benign": {r[0].replace("\x00", "*") for r in common.collect()}, "regression": []}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(words, model["benign"])
        for b in batches:
            x = np.array([features(t.as_py(), weights, matcher) for t in b.column("text")]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(5)), b.column("toxic").cast(pa.float64())], [*"abcde", "y"])

    data = sample.mapInArrow(measure, "a double, b double, c double, d double, e double, y double").toPandas().to_numpy()
    model["regression"] = _fit(data[:, :5], (data[:, 5] > 0).astype(float)).tolist()
    return model


def score_texts(docs: DataFrame, model: dict) -> DataFrame:
    """The rows and columns of ``docs`` and ``score``."""
    docs = without(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(model["words"], model["benign"]), np.array(model["regression"])
        for b in batches:
            x = np.array([features(t.as_py(), model["weights"], matcher) for t in b.column("text")]).reshape(-1, 5)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join(f"{quoted(c)} {t}" for c, t in docs.dtypes) + ", score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))  # texts go back through Arrow, but no further
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
