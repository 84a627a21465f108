"""What the operators' queries give, in DuckDB SQL, where SQL can tell it."""

from __future__ import annotations

from quire.llm.fingerprints import PASSAGE

_WHITE = r" \t\n\x0B\f\r"
_PASSAGE = rf"[{_WHITE}]*(?:[^{_WHITE}]+[{_WHITE}]*){{1,{PASSAGE}}}|[{_WHITE}]+"


def _nodes(x: str) -> str:
    """The paragraphs' nodes of a text: digest d, leaves l, blank line e."""
    hashes = f"list_transform(regexp_extract_all({x}, '[^\\n]*\\n|[^\\n]+'), lambda p: list_transform(regexp_extract_all(p, '{_PASSAGE}'), lambda y: sha256(y)))"
    return f"list_transform({hashes}, lambda h: {{'d': sha256(array_to_string(h, '')), 'l': list_transform(h, lambda y: y[1:8]), 'e': h = [sha256(chr(10))]}})"


def _root(n: str) -> str:
    marked = f"list_transform({n}, lambda x, i: CASE WHEN i > 1 AND NOT x.e AND {n}[i - 1].e THEN '|' ELSE '' END || x.d)"
    return f"sha256(array_to_string(list_transform(CASE WHEN len({n}) = 0 THEN [] ELSE string_split(array_to_string({marked}, ''), '|') END, lambda s: sha256(s)), ''))"


def _likeness(a: str, b: str) -> str:
    n = f"(len(list_distinct({a})) + len(list_distinct({b})))"
    return f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / {n} END"


def _same_start(a: str, b: str) -> str:
    least = f"least(len({a}), len({b}))"
    return f"coalesce(list_min(list_filter(range(1, {least} + 1), lambda i: {a}[i].d <> {b}[i].d)) - 1, {least})"


OP2 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS pos, count(*) OVER () AS many FROM documents),
p AS (SELECT d.doc_id, d.n, d.text, d.text[1:d.n - d.n // 3] || o.text[1:d.n // 3] AS edited, o.text AS other FROM d JOIN d o ON o.pos = d.pos % d.many + 1),
t AS (SELECT doc_id, n, edited, {_nodes("text")} AS a, {_nodes("edited")} AS b, {_nodes("other")} AS c FROM p),
l AS (SELECT *, flatten(list_transform(a, lambda x: x.l)) AS la, flatten(list_transform(b, lambda x: x.l)) AS lb, flatten(list_transform(c, lambda x: x.l)) AS lc, {_same_start("a", "b")} AS same, {_same_start("list_reverse(a)", "list_reverse(b)")} AS same_end FROM t),
r AS (SELECT *, least(same_end, least(len(a), len(b)) - same) AS after FROM l)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_root("a")} || ':' || array_to_string(la, '') AS fingerprint, {_root("b")} || ':' || array_to_string(lb, '') AS edited_fingerprint,
{_likeness("la", "lb")} AS near_edited, {_likeness("la", "lc")} AS near_next, CAST(same AS INT) AS edit_from, CAST(len(a) - after AS INT) AS edit_until, CAST(len(b) - after AS INT) AS edited_until FROM r"""

# the table of the reflected polynomial, by its rule
_CRC_TABLE = "list_transform(range(256), lambda v: list_reduce(list_concat([v], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_SHARDS = 8


def _filled(capacity: str) -> str:
    """How far the shards reach under a capacity, each filled up to the last group end within it."""
    return f"list_reduce(list_concat([0::BIGINT], range({_SHARDS})), lambda c, k: coalesce(list_max(list_filter(ends, lambda e: e <= c + {capacity})), 0))"


OP5 = f"""WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST('0x' || md5(coalesce(text, ''))[1:15] AS BIGINT) AS grp FROM documents),
o AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(sum(size) OVER (ORDER BY grp) AS BIGINT) AS reach FROM d WINDOW w AS (ORDER BY grp, doc_id)),
g AS (SELECT list(reach ORDER BY reach) AS ends, max(reach) AS total, max(w) AS widest FROM (SELECT grp, max(reach) AS reach, sum(size) AS w FROM o GROUP BY grp)),
b AS (SELECT ends, total, list_reduce(list_concat([{{'lo': 0::BIGINT, 'hi': total}}], list_transform(range(48), lambda k: {{'lo': 0::BIGINT, 'hi': 0::BIGINT}})),
  lambda s, k: CASE WHEN s.hi - s.lo <= 1 THEN s WHEN {_filled("(s.lo + s.hi) // 2")} >= total THEN {{'lo': s.lo, 'hi': (s.lo + s.hi) // 2}} ELSE {{'lo': (s.lo + s.hi) // 2, 'hi': s.hi}} END).hi AS cap FROM g),
c AS (SELECT list_transform(range({_SHARDS - 1}), lambda j: list_reduce(list_concat([0::BIGINT], range(j + 1)), lambda c, k: coalesce(list_max(list_filter(ends, lambda e: e <= c + cap)), 0))) AS cuts FROM b),
s AS (SELECT o.*, CAST(len(list_filter(cuts, lambda x: x < o.reach)) AS INT) AS shard FROM o, c)
SELECT doc_id, size, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, v: xor(c >> 8, tab[CAST(xor(c, v) & 255 AS INT) + 1])), 4294967295::BIGINT) AS text_crc32,
'bytes' AS law, shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM s, crc"""


OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.w, c.w, true), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def _leaf(text: str) -> str:
    """The digest of a row with ``text`` in the place of its text."""
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC_ID = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, v: xor(c >> 8, tab[CAST(xor(c, v) & 255 AS INT) + 1])), 4294967295::BIGINT)"
# level by level up the trees of the sources, whose roots are the leaves of the last one (key NULL); then from every leaf up
OP13 = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS key, {_leaf("text")} AS leaf, {_leaf(f"CASE WHEN {_CRC_ID} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS start FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM d),
t AS (SELECT key, 0 AS lvl, i, n, leaf AS h FROM l UNION ALL SELECT key, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY key, lvl, i // 3, n),
s AS MATERIALIZED (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, n, subroot AS h FROM s UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
p AS MATERIALIZED (SELECT key, lvl, i // 3 AS up, string_agg(h, '' ORDER BY i) AS pre FROM t WHERE n > 1 GROUP BY key, lvl, i // 3),
v AS MATERIALIZED (SELECT lvl, i // 3 AS up, string_agg(h, '' ORDER BY i) AS pre FROM u WHERE n > 1 GROUP BY lvl, i // 3),
a AS (SELECT doc_id, key, leaf, 0 AS lvl, i, n, start AS acc, '' AS sib FROM l UNION ALL
  SELECT doc_id, a.key, leaf, a.lvl + 1, i // 3, (n + 2) // 3, sha256(left(pre, 64 * (i % 3)) || acc || pre[64 * (i % 3) + 65:]), sib || left(pre, 64 * (i % 3)) || pre[64 * (i % 3) + 65:] FROM a JOIN p ON p.key = a.key AND p.lvl = a.lvl AND p.up = i // 3 WHERE n > 1),
b AS (SELECT doc_id, leaf, subroot, 0 AS lvl, s.i, s.n, acc, sib FROM a JOIN s USING (key) WHERE a.n = 1 UNION ALL
  SELECT doc_id, leaf, subroot, b.lvl + 1, i // 3, (n + 2) // 3, sha256(left(pre, 64 * (i % 3)) || acc || pre[64 * (i % 3) + 65:]), sib || left(pre, 64 * (i % 3)) || pre[64 * (i % 3) + 65:] FROM b JOIN v ON v.lvl = b.lvl AND v.up = i // 3 WHERE n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(sib) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM b, (SELECT h FROM u WHERE n = 1) WHERE n = 1"""
