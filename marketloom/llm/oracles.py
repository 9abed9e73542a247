"""DuckDB SQL of the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .quality import POLICIES, RULES

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({{0}}, '{_SPACE}'), lambda x : x <> '')"
_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))


def _failed(policy: str) -> str:
    return " OR ".join(f"({r.fails})" for r in RULES if r.name in POLICIES[policy])


_QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) q),
r AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest([g.i, g.i + 1, g.i + 2]) AS p FROM g JOIN r ON g.doc_id = r.doc_id AND g.g = r.g) q GROUP BY doc_id),
m AS (SELECT l.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM l LEFT JOIN c ON c.doc_id = l.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_failed("base")}) AS base_failed, NOT ({_failed("v1")}) AS kept, CAST({_BITS} AS BIGINT) AS failure_bits FROM m
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0) q),
x AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) s) q),
h AS (SELECT x.doc_id, x.i, x.k, v.item_id FROM x JOIN v ON x.g = v.g AND x.k = v.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) q GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) q GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

SQL: dict[str, str] = {"op2_jaccard_join": _JACCARD, "op5_quality_rules": _QUALITY, "op7_decontamination": _DECONTAMINATION}

# 0xEDB88320 is the fixed polynomial of CRC-32
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda ch : ascii(ch)::BIGINT)), lambda a, b : "
    "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, _ : xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_TURN = "sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
_TRIE = rf"""
WITH t AS (SELECT conv_id::BIGINT AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS pos, {_TURN} AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS s, {_CRC.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t) q),
r AS (SELECT h.c, t.pos, t.k, t.w FROM h JOIN t ON t.c = h.s AND t.pos <= h.h UNION ALL SELECT h.c, t.pos, t.k, t.w FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, string_agg(k, '') OVER (PARTITION BY c ORDER BY pos) AS p, w FROM r),
m AS MATERIALIZED (SELECT c, d, p, w FROM d UNION ALL SELECT c, 0, '', 0 FROM h),
n AS MATERIALIZED (SELECT d, p, min(c) AS conv_id, count(*) AS n, min(w) AS w FROM m GROUP BY d, p),
e AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, p, d, max(d) OVER (PARTITION BY c) AS last FROM m) q WHERE d = last GROUP BY p),
k AS (SELECT left(p, 64 * (d::INT - 1)) AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
x AS MATERIALIZED (SELECT n.*, u.conv_id AS up, coalesce(k.kids, 0) AS kids, coalesce(e.ids, '') AS ids FROM n LEFT JOIN k ON k.p = n.p LEFT JOIN e ON e.p = n.p LEFT JOIN n u ON n.d > 0 AND u.p = left(n.p, 64 * (n.d::INT - 1))),
b AS (SELECT p, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((n - 1) * w)::BIGINT AS saved FROM (SELECT n, w, kids, left(p, 64 * unnest(range(0, d::INT + 1))::INT) AS p FROM x) q GROUP BY p)
SELECT x.conv_id, x.d::BIGINT AS depth, x.up AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(x.ids) AS ends_sha256 FROM x JOIN b ON b.p = x.p
"""
SQL["op11_prefix_trie"] = _TRIE


def _codes() -> str:
    """Product codes: two rounds of all distances, then the last codes."""
    near = (
        "SELECT v.row, v.m, min({d} * 64 + c.j) AS b FROM y v JOIN c{r} c ON c.m = v.m GROUP BY v.row, v.m"
    ).replace("{d}", "list_sum(list_transform(range(1, len(v.y) + 1), lambda i : (v.y[i] - c.y[i]) * (v.y[i] - c.y[i])))::BIGINT")
    floor = "(s - ((s % n) + n) % n) // n"
    mean = (
        "SELECT c.m, c.j, coalesce(list(t.e ORDER BY t.i), any_value(c.y)) AS y FROM c{r} c LEFT JOIN "
        f"(SELECT m, j, i, CAST({floor} AS BIGINT) AS e FROM (SELECT m, j, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT v.m, a.b % 64 AS j, unnest(range(1, len(v.y) + 1)) AS i, unnest(v.y) AS e FROM y v JOIN a{{r}} a ON a.row = v.row AND a.m = v.m) q GROUP BY m, j, i) w) t "
        "ON t.m = c.m AND t.j = c.j GROUP BY c.m, c.j"
    )
    mean = mean.replace("coalesce(list(t.e ORDER BY t.i), any_value(c.y))", "CASE WHEN count(t.e) > 0 THEN list(t.e ORDER BY t.i) ELSE any_value(c.y) END")
    tables = {
        "v": "SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x : floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0",
        "y": "SELECT row, m, x[m * (len(x) // 16) + 1 : (m + 1) * (len(x) // 16)] AS y FROM (SELECT row, x, unnest(range(16)) AS m FROM v) q",
        "f": "SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v QUALIFY j < 64",
        "c0": "SELECT y.m, f.j, y.y FROM f JOIN y ON y.row = f.row",
    }
    for r in range(3):
        tables[f"a{r}"] = near.replace("{r}", str(r))
        if r < 2:
            tables[f"c{r + 1}"] = mean.replace("{r}", str(r))
    tables["h"] = "SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY m, j)) AS sha FROM c2"
    tables["r"] = "SELECT v.vec_id, v.label, string_agg(printf('%02x', (a.b % 64)::INT), '' ORDER BY a.m) AS code, sum(a.b // 64)::BIGINT AS error FROM v JOIN a2 a ON a.row = v.row GROUP BY v.row, v.vec_id, v.label"
    named = ", ".join(f"{k} AS MATERIALIZED ({t})" for k, t in tables.items())
    return f"WITH {named} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM r, h"


SQL["op12_vector_codes"] = _codes()
