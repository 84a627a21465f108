"""License scans by patience alignment.

A template's words are aligned with a whole text's: words that stand exactly once in both are anchors, the longest
increasing subsequence of the anchors stays, the runs around each anchor are extended word by word, and the gaps
between anchors are aligned in the same way. In a gap without such a word, words that stand equally often in both are
anchors, the first with the first and so on; without those, the rarest word they share. So a gap ends when it shares no word.
The coverage is the share of the template's words that this aligns; a license is reported from COVERAGE on, over at most
SPREAD times its length of text.

So a template is aligned with windows of that size, and the window with the best coverage counts, of equal ones the tightest,
then the first. The length of the longest common subsequence, by bits, bounds what any alignment can cover and says where
windows begin: at each word of the text without which the window's bound would be less. Only windows (and texts) that pass
the bound are aligned, and the alignment alone gives the coverage. A notice is found wherever it stands. The templates are short notices, the headers that stand for the long licenses
(Apache, GPL, LGPL, AGPL, MPL), and whole short licenses.

Null and empty texts have no license. Every input row gives one output row, repeated rows equal ones; ties go to the
longer template, then the first name. Null doc_ids are kept. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.license_texts import HEADERS, LICENSES, NOTICES

COVERAGE = 0.75
SPREAD = 2.0
_WORD = re.compile(r"[^\W_]+")
TEMPLATES = NOTICES | HEADERS | LICENSES


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of (template, text) pairs, in template order, with increasing text places."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [y]
        ends[at : at + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Aligned places (template, text), increasing in both."""
    places: dict[str, list[int]] = {}
    wanted = set(template)
    for i, w in enumerate(text):
        if w in wanted:
            places.setdefault(w, []).append(i)
    done: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            done.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            done.append((b, d))
        if a >= b or c >= d:
            continue
        counts = Counter(template[a:b])
        inside = {w: p[bisect_left(p, c) : bisect_left(p, d)] for w in counts if (p := places.get(w))}
        anchors = _increasing([(i, inside[w][0]) for i, w in enumerate(template[a:b], a) if counts[w] == 1 and len(inside.get(w, ())) == 1])
        anchors = anchors or _increasing(_by_occurrence(template, inside, counts, a, b))
        if not anchors:
            continue
        done += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(x + 1, z, y + 1, t) for (x, y), (z, t) in zip(edges, edges[1:], strict=False)]
    return sorted(done)


def _by_occurrence(template: list[str], inside: dict[str, list[int]], counts: Counter, a: int, b: int) -> list[tuple[int, int]]:
    """Anchors of a gap (a to b in the template) by the order of a word's places: of the words that stand equally often on both
    sides; without those, of the rarest word on both."""
    shared = {w: max(counts[w], len(p)) for w, p in inside.items() if p}
    even = {w for w in shared if counts[w] == len(inside[w])} or {min(shared, key=lambda w: (shared[w], w))} if shared else set()
    seen: Counter = Counter()
    out = []
    for i, w in enumerate(template[a:b], a):
        if w in even and seen[w] < len(inside[w]):
            out.append((i, inside[w][seen[w]]))
            seen[w] += 1
    return out


def bits_of(template: list[str]) -> dict[str, int]:
    """The places of each word, as bits."""
    out: dict[str, int] = {}
    for i, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_length(bits: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence of a template of ``size`` words and ``words``, all of them in it."""
    full = (1 << size) - 1
    row = full
    for w in words:
        hit = row & bits[w]
        row = (row + hit | row - hit) & full
    return size - row.bit_count()


def windows(template: list[str], places: list[tuple[int, str]], least: float) -> Iterator[tuple[int, int]]:
    """(first, last) of the windows' ``places`` that hold a share ``least`` of the template's words.

    places: the places in the text, in order, of the template's words, and the words.
    """
    size, left, held, last = int(SPREAD * len(template)) + 2, Counter(template), 0, 0
    for first, (at, word) in enumerate(places):
        while last < len(places) and places[last][0] < at + size:
            w = places[last][1]
            left[w] -= 1
            held += left[w] >= 0
            last += 1
        if held / len(template) >= least:
            yield first, last
        left[word] += 1
        held -= left[word] > 0


def best_place(template: list[str], words: list[str], places: list[tuple[int, str]], least: float) -> tuple[int, int, int]:
    """How many words of the template a window aligns at most (0: less than ``least``), and the first and last word. The bound
    only spares windows that can't be the best."""
    bits, many = bits_of(template), len(template)
    best = (0, 0, 0)  # aligned words, words from the last to the first place (negative), first place
    for first, last in windows(template, places, least):
        inside = [w for _, w in places[first:last]]
        n = common_length(bits, many, inside)
        # a window whose first word is not needed is no better than one that begins later
        if n < best[0] or n / many < least or common_length(bits, many, inside[1:]) == n:
            continue
        at = places[first][0]
        text = words[at : places[last - 1][0] + 1]
        found = align(template, text)
        if len(found) / many < least:
            continue
        new = (len(found), found[0][1] - found[-1][1], at + found[0][1])
        if new[:2] > best[:2]:
            best = new
            if best[:2] == (many, 1 - many):
                break
    return best[0], best[2], best[2] - best[1]


def prepared(templates: dict[str, str]) -> list[tuple[str, list[str], Counter]]:
    """Name, words, and how often each word stands in it."""
    return [(k, words, Counter(words)) for k, v in sorted(templates.items()) if (words := words_of(v))]


def scan(text: str | None, templates: list[tuple[str, list[str], Counter]], least: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(name, coverage, first word, last word) of the licenses in a text, best first."""
    words = words_of(text or "")
    known, out = set(words), []
    close = [(name, t, n) for name, t, n in templates if sum(n[w] for w in n.keys() & known) >= least * len(t)]
    wanted = {w for _, _, n in close for w in n}
    places = [(i, w) for i, w in enumerate(words) if w in wanted] if wanted else []
    for name, t, n in close:
        many, first, last = best_place(t, words, [p for p in places if p[1] in n], least)
        if many:
            out.append((many / len(t), len(t), name, first, last))
    return [(n, c, a, z) for c, _, n, a, z in sorted(out, key=lambda x: (-x[0], -x[1], x[2]))]


def scan_table(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, licenses (all names) for every row of ``docs``."""
    known = prepared(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t, known, least) for t in b.column("text").to_pylist()]
            first = [f[0] if f else (None, 0.0, None, None) for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([f[i] for f in first], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))],
                ["doc_id", "license", "coverage", "first_word", "last_word", "licenses"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word int, last_word int, licenses array<string>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(table(spark, sf_dir, "documents"))
