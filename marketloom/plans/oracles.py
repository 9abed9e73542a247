"""The registered queries as DuckDB SQL. Common tables are joined in front of each query by name."""

from __future__ import annotations

from marketloom.functions.parameters import rule_space
from marketloom.plans.queries import BRANCHES, BROKEN, DEEP, GRID, LMAX, NI, RANGES, SPARSE, THETA

_U = "((('0x' || substr(md5({0}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
_LAPLACE = "CASE WHEN 0.5 - {u} < 0 THEN {b} * ln(1 + 2 * (0.5 - {u})) ELSE -({b}) * ln(1 - 2 * (0.5 - {u})) END"
_SUBSETS = "list_transform(range(1, (1 << len({a})) - {less}), lambda m : list_filter({a}, lambda x, i : ((m >> (i - 1)) & 1) = 1))"
_BIN = "CASE " + " ".join(f"WHEN conf > {(9 - k) / 10} THEN {k}" for k in range(10)) + " END"


def _grid(grid: dict = GRID) -> str:
    from itertools import product

    return ", ".join(str((k, *c)) for k, c in enumerate(product(*grid.values())))


#: Common tables in the order in which they build on each other.
_TABLES = {
    "b": r"SELECT l_orderkey AS tid, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS item FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "cb": r"SELECT o_custkey AS tid, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "cp": "SELECT o_custkey AS tid, l_partkey::INT AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "cptop": "SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM cp GROUP BY item",
    "t": "SELECT DISTINCT tid FROM b",
    "c": "SELECT item, count(*) AS cnt FROM b GROUP BY item",
    "ranked": "SELECT item, cnt, row_number() OVER (ORDER BY cnt DESC, item) AS rank FROM c",
    "top": f"SELECT item, cnt, rank FROM ranked WHERE rank <= {NI}",
    "tb": "SELECT b.tid, b.item FROM b JOIN top USING (item)",
    "s": "SELECT a, array_to_string(a, ' ') AS k, sup FROM (SELECT [item] AS a, count(*) AS sup FROM tb GROUP BY item UNION ALL SELECT [x.item, y.item], count(*) FROM tb x JOIN tb y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item "
    "UNION ALL SELECT [x.item, y.item, z.item], count(*) FROM tb x JOIN tb y ON x.tid = y.tid AND x.item < y.item JOIN tb z ON z.tid = y.tid AND y.item < z.item GROUP BY x.item, y.item, z.item) q",
    "parts": f"SELECT a, k, sup, sub, array_to_string(sub, ' ') AS part FROM (SELECT a, k, sup, unnest({_SUBSETS.format(a='a', less=1)}) AS sub FROM s) q",
    "r": "SELECT p.a, p.k, p.sub, p.sup AS sup_ab, q.sup AS sup_a, p.sup / q.sup AS conf FROM parts p JOIN s q ON q.k = p.part",
    "stats": "SELECT a, max(sup_ab) AS support, count(*) FILTER (conf > 0.3) AS n30, count(*) FILTER (conf > 0.5) AS n50, count(*) FILTER (conf > 0.7) AS n70 FROM r GROUP BY a",
    "bins": "SELECT k AS bin, (9 - k) / 10 AS bound FROM range(10) g(k)",
    "zero": "SELECT g.i::INT AS item, coalesce(c.cnt, 0) AS cnt FROM (SELECT unnest(range(1, (SELECT max(item) FROM c) + 1)) AS i) g LEFT JOIN c ON c.item = g.i",
    "noisy": f"SELECT item, cnt AS real_count, greatest(cnt + ({_LAPLACE.format(u='u', b='(1 / 0.05)')}), 0.0) AS noisy_count FROM (SELECT item, cnt, {_U.format(chr(39) + '42|count|' + chr(39) + ' || item')} AS u FROM zero) q",
    "placed": "SELECT *, row_number() OVER (ORDER BY noisy_count DESC, item) AS pos FROM noisy",
    "pt": "SELECT DISTINCT p.sup AS sup_ab, q.sup AS sup_a FROM parts p JOIN s q ON q.k = p.part",
    # private runs of two levels, branch by branch
    "runs": f"SELECT * FROM (VALUES {_grid()}) v(run_id, {', '.join(GRID)})",
    "pn": f"SELECT run_id, item, cnt, greatest(cnt + ({_LAPLACE.format(u='u', b='(1 / (eps * ratio))')}), 0.0) AS nc FROM (SELECT *, {_U.format(chr(39) + chr(39) + ' || seed || ' + chr(39) + '|count|' + chr(39) + ' || item')} AS u FROM zero, runs) q",
    "pk": "SELECT run_id, item, cnt, nc, row_number() OVER (PARTITION BY run_id ORDER BY nc DESC, item) AS pos FROM pn",
    "ptop": "SELECT pk.*, eps, ratio, c0, lmax, bf, seed FROM pk JOIN runs USING (run_id) WHERE pos <= ni",
    "l0": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v, item) AS br FROM (SELECT *, ln(ln(1 / {_U.format('seed || ' + chr(39) + '|0||' + chr(39) + ' || item')})) - nc AS v FROM ptop) q) w WHERE br <= bf",
    "s2": "SELECT x.item AS i, y.item AS j, count(*) AS sup FROM b x JOIN b y ON x.tid = y.tid AND x.item <> y.item GROUP BY ALL",
    "cand": f"SELECT l.run_id, l.br, l.bf, l.item AS p, q.item AS x, least(l.item, q.item) AS i, greatest(l.item, q.item) AS j, coalesce(s2.sup, 0) AS sup, ln(ln(1 / {_U.format('l.seed || ' + chr(39) + '|1|' + chr(39) + ' || l.item || ' + chr(39) + '|' + chr(39) + ' || q.item')})) - l.eps * (1 - l.ratio) / (l.lmax - 1) / l.bf / l.bf * coalesce(s2.sup, 0) / 2 AS v FROM l0 l JOIN ptop q ON q.run_id = l.run_id AND q.item <> l.item LEFT JOIN s2 ON s2.i = l.item AND s2.j = q.item",
    "b1": "SELECT run_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v, x) AS n FROM cand WHERE br = 1) q WHERE n <= bf",
    "b2": "SELECT run_id, i, j FROM (SELECT c.*, row_number() OVER (PARTITION BY c.run_id ORDER BY v, x) AS n FROM cand c WHERE br = 2 AND NOT EXISTS (SELECT 1 FROM b1 WHERE b1.run_id = c.run_id AND b1.i = c.i AND b1.j = c.j)) q WHERE n <= bf",
    "leaf": "SELECT * FROM b1 UNION ALL SELECT * FROM b2",
    "pr": "SELECT run_id, i, j, a, coalesce(s2.sup, 0) AS sup_ab, z.cnt AS sup_a, CASE WHEN z.cnt = 0 THEN 0 ELSE coalesce(s2.sup, 0) / z.cnt END AS conf FROM (SELECT run_id, i, j, i AS a FROM leaf UNION ALL SELECT run_id, i, j, j FROM leaf) q LEFT JOIN s2 USING (i, j) JOIN zero z ON z.item = q.a",
    "ps": "SELECT run_id, i, j, count(*) FILTER (conf > 0.3) AS n30, count(*) FILTER (conf > 0.5) AS n50, count(*) FILTER (conf > 0.7) AS n70 FROM pr GROUP BY ALL",
    "ph0": f"SELECT run_id, {_BIN} AS bin, count(*) AS n FROM pr WHERE conf <> 0 GROUP BY ALL",
    "ph1": "SELECT g.run_id, bins.bin, bins.bound, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT run_id FROM leaf) g CROSS JOIN bins LEFT JOIN ph0 h ON h.run_id = g.run_id AND h.bin = bins.bin",
    "ph": "SELECT *, sum(n) OVER (PARTITION BY run_id ORDER BY bin) AS cum_n, sum(n) OVER (PARTITION BY run_id) AS tot FROM ph1",
    "rec": "SELECT (SELECT coalesce(sum(n30), 0) FROM ps WHERE run_id = 2) AS p30, (SELECT coalesce(sum(n50), 0) FROM ps WHERE run_id = 2) AS p50, (SELECT coalesce(sum(n70), 0) FROM ps WHERE run_id = 2) AS p70, "
    "(SELECT sum(n30) FROM stats WHERE len(a) = 2) AS n30, (SELECT sum(n50) FROM stats WHERE len(a) = 2) AS n50, (SELECT sum(n70) FROM stats WHERE len(a) = 2) AS n70",
    "sw": "SELECT u.run_id, 'orders.brand' AS db, u.eps, u.ratio AS epsh, u.c0, u.lmax AS rmax, u.ni AS nits, u.bf, u.seed, (SELECT count(*) FROM leaf WHERE leaf.run_id = u.run_id) AS leaves, "
    "(SELECT cum_n FROM ph WHERE ph.run_id = u.run_id AND bin = 9) AS rules, (SELECT cum_n FROM ph WHERE ph.run_id = u.run_id AND bin = 4) AS rules50, (SELECT n50 FROM rec) AS realrls FROM runs u",
    "av": "SELECT db, eps, c0, rmax, nits AS ni, bf, avg(rules) AS R, avg(rules50) AS R50, avg(realrls) AS RR FROM sw GROUP BY ALL",
}
_TABLES |= {
    # all brands, each with its rank
    "rb": "SELECT b.tid, b.item, ranked.rank FROM b JOIN ranked USING (item)",
    "s25": "SELECT a, array_to_string(a, ' ') AS k, top, sup FROM (SELECT [item] AS a, min(rank) AS top, count(*) AS sup FROM rb GROUP BY item UNION ALL SELECT [x.item, y.item], max(greatest(x.rank, y.rank)), count(*) FROM rb x JOIN rb y ON x.tid = y.tid AND x.item < y.item GROUP BY x.item, y.item "
    "UNION ALL SELECT [x.item, y.item, z.item], max(greatest(x.rank, y.rank, z.rank)), count(*) FROM rb x JOIN rb y ON x.tid = y.tid AND x.item < y.item JOIN rb z ON z.tid = y.tid AND y.item < z.item GROUP BY x.item, y.item, z.item) q",
    "r25": f"SELECT p.k, len(p.a) AS size, p.top, p.sup / q.sup AS conf FROM (SELECT a, k, top, sup, array_to_string(sub, ' ') AS part FROM (SELECT a, k, top, sup, unnest({_SUBSETS.format(a='a', less=1)}) AS sub FROM s25) w) p JOIN s25 q ON q.k = p.part",
    "nested": "SELECT g.l::INT AS lmax, h.n::INT AS ni, count(DISTINCT k) AS n_sets, count(k) AS n_rules, count(*) FILTER (conf > 0.3) AS n30, count(*) FILTER (conf > 0.5) AS n50, count(*) FILTER (conf > 0.7) AS n70 FROM range(2, 4) g(l) CROSS JOIN range(1, 26) h(n) LEFT JOIN r25 ON size <= g.l AND top <= h.n GROUP BY g.l, h.n",
}
_USES = {
    "cptop": "cp", "rb": "b ranked", "s25": "rb", "r25": "s25", "nested": "r25",
    "t": "b", "c": "b", "ranked": "c", "top": "ranked", "tb": "b top", "s": "tb", "parts": "s", "r": "s parts", "stats": "r", "zero": "c", "noisy": "zero", "placed": "noisy", "pt": "s parts",
    "pn": "zero runs", "pk": "pn", "ptop": "pk runs", "l0": "ptop", "s2": "b", "cand": "l0 ptop s2", "b1": "cand", "b2": "cand b1", "leaf": "b1 b2", "pr": "leaf s2 zero", "ps": "pr",
    "ph0": "pr", "ph1": "leaf bins ph0", "ph": "ph1", "rec": "ps stats", "sw": "runs leaf ph rec", "av": "sw",
}


#: Tables that are read several times.
_ONCE = {"b", "cb", "cp", "cptop", "rb", "s25", "r25", "c", "tb", "s", "parts", "r", "s2"}


def _with(names: str, body: str) -> str:
    wanted, todo = set(), names.split()
    while todo:
        x = todo.pop()
        if x not in wanted:
            wanted.add(x)
            todo += _USES.get(x, "").split()
    return "WITH " + ", ".join(f"{k} AS {'MATERIALIZED ' * (k in _ONCE)}({v})" for k, v in _TABLES.items() if k in wanted) + " " + body


def _text(a: str, sep: str = " ") -> str:
    return f"array_to_string({a}, '{sep}')"


_RULE = f"SELECT k AS itemset, {_text('sub')} AS antecedent, {_text('list_filter(a, lambda x : NOT list_contains(sub, x))')} AS consequent, sup_ab, sup_a, round(conf, 6) AS conf FROM r"
_HIST = "SELECT bin, bound, n, round(CASE WHEN tot = 0 THEN 0 ELSE n / tot END, 6) AS frac, cum_n, round(CASE WHEN tot = 0 THEN 0 ELSE cum_n / tot END, 6) AS cum_frac"
_FULL = f"(SELECT *, sum(n) OVER (ORDER BY bin) AS cum_n, sum(n) OVER () AS tot FROM (SELECT bins.bin, bins.bound, coalesce(h.n, 0) AS n FROM bins LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM r WHERE conf <> 0 GROUP BY ALL) h ON h.bin = bins.bin) q) w"
_POINTS = f"SELECT k AS itemset, {_text('sub')} AS antecedent, sup_a, sup_ab, len(sub) AS len_a, len(a) AS len_ab"
_LINE = f"{_text('sub')} || ' -> ' || {_text('list_filter(a, lambda x : NOT list_contains(sub, x))')} || ' | c=' || printf('%7.6f', conf)"
_WIDE = "SELECT u.*, (SELECT cum_n / nullif(tot, 0) FROM ph WHERE ph.run_id = u.run_id AND bin = 0) AS p90, (SELECT cum_n / nullif(tot, 0) FROM ph WHERE ph.run_id = u.run_id AND bin = 2) AS p70, (SELECT cum_n / nullif(tot, 0) FROM ph WHERE ph.run_id = u.run_id AND bin = 4) AS p50 FROM runs u WHERE seed = 1"
_M = "(SELECT count(*) FROM t)"


def _chain(score: str) -> str:
    least = "SELECT p.a, p.sup, min(q.sup) AS low FROM parts p JOIN s q ON q.k = p.part GROUP BY p.a, p.sup"
    return _with(
        "s parts top",
        f"SELECT * FROM (WITH m AS ({least}), k AS (SELECT a, CAST({score} AS DOUBLE) AS score FROM m), "
        "k2 AS (SELECT a, score FROM k WHERE len(a) = 2 AND list_contains(a, (SELECT item FROM top WHERE rank = 1)) ORDER BY score DESC, a LIMIT 1), "
        "k3 AS (SELECT k.a, k.score FROM k, k2 WHERE len(k.a) = 3 AND list_contains(k.a, k2.a[1]) AND list_contains(k.a, k2.a[2]) ORDER BY k.score DESC, k.a LIMIT 1) "
        f"SELECT len(a) AS step, {_text('a')} AS itemset, score FROM k2 UNION ALL SELECT len(a), {_text('a')}, score FROM k3) z",
    )


def _deep(inner: str, last: str, first_item: str = "noisy", grid: dict = DEEP, baskets: str = "b") -> str:
    """Leaves of three levels with some draws each, branch after branch. ``inner``, ``last``: scores of the levels after the first, from the
    support sup, that of the prefix sp, the count cx of the new item, and the counts c1, c2 of those before."""
    free, first = (1, "nc") if first_item == "noisy" else (0, "eps * (1 - ratio) / lmax / bf * cnt / 2")
    u = lambda level, prefix: _U.format(f"seed || '|{level}|' || {prefix} || '|' || item")
    share = lambda level: f"eps * (1 - ratio) / (lmax - {free}) / power(bf, {level}) / bf"
    draws = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY v, item) AS n FROM ({0}) q) w WHERE n <= bf"
    tables = {
        "runs": f"SELECT * FROM (VALUES {_grid(grid)}) v(run_id, {', '.join(grid)})",
        "d0": draws.format(f"SELECT *, '' AS path, ln(ln(1 / {u(0, repr(''))})) - ({first}) AS v FROM ptop"),
        "d1": draws.format(
            f"SELECT *, ln(ln(1 / {u(1, 'p1')})) - {share(1)} * ({inner}) / 2 AS v FROM (SELECT l.run_id, l.n::VARCHAR AS path, l.item AS p1, l.cnt AS c1, l.cnt AS sp, x.item, x.cnt AS cx, coalesce(s2.sup, 0) AS sup, "
            "x.eps, x.ratio, x.c0, x.lmax, x.bf, x.seed FROM d0 l JOIN ptop x ON x.run_id = l.run_id AND x.item <> l.item LEFT JOIN s2 ON s2.i = l.item AND s2.j = x.item) q"
        ),
        "s3": "SELECT x.item AS i, y.item AS j, z.item AS k, count(*) AS sup FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item JOIN b z ON z.tid = y.tid AND y.item < z.item GROUP BY ALL",
        "d2": f"SELECT *, ln(ln(1 / {u(2, 'pre')})) - {share(2)} * ({last}) / 2 AS v FROM (SELECT q.*, coalesce(s3.sup, 0) AS sup FROM (SELECT l.run_id, l.path || l.n AS path, l.p1 || ' ' || l.item AS pre, l.c1, l.cx AS c2, l.sup AS sp, x.item, x.cnt AS cx, "
        "list_sort([l.p1, l.item, x.item]) AS a, x.eps, x.ratio, x.c0, x.lmax, x.bf, x.seed FROM d1 l JOIN ptop x ON x.run_id = l.run_id AND x.item <> l.item AND x.item <> l.p1) q LEFT JOIN s3 ON s3.i = a[1] AND s3.j = a[2] AND s3.k = a[3]) w",
    }
    before: list[str] = []
    draws_each = range(1, max(grid["bf"]) + 1)
    for path in (f"{i}{j}" for i in draws_each for j in draws_each):
        gone = "".join(f" AND NOT EXISTS (SELECT 1 FROM e{k} WHERE e{k}.run_id = d2.run_id AND e{k}.a = d2.a)" for k in before)
        tables[f"e{path}"] = draws.format(f"SELECT run_id, path, item, a, bf, v FROM d2 WHERE path = '{path}'{gone}")
        before.append(path)
    common = _with("ptop s2", "").removeprefix("WITH ").split(", ptop AS", 1)
    named = ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in tables.items() if k != "runs")
    text = f"WITH {common[0]}, ptop AS{common[1]}, {named} " + " UNION ALL ".join(f"SELECT run_id, {_text('a')} AS itemset FROM e{k}" for k in before)
    return text.replace(_TABLES["runs"], tables["runs"]).replace(_TABLES["b"], _TABLES[baskets])


def _mt(theta: str) -> str:
    return f"(1e6 - sqrt(power(x - {theta}, 2) + power(y - {THETA}, 2))) / sqrt(2.0)"


_SCORES = (
    f"SELECT sup_a, sup_ab, round({_mt('m')}, 6) AS mt, round({_mt(str(THETA))}, 6) AS tt, round(x * y / (2 * m + 1), 6) AS aab, round(x * (m - y) / (2 * m - 1), 6) AS amab, "
    f"round(x * y * ({THETA} - y) / (2 * m * {THETA} + {THETA} - 1), 6) AS aabtab, round(x * exp(-abs({THETA} - y) / 1e3) / (m * (exp(1.0) - 1) + exp(1.0)), 6) AS exp, "
    f"round(0.5 * (1 / {THETA} - 1 / m) * (m * greatest(0.0, 1 - abs(x - m) / (m - {THETA}))) * ({THETA} * greatest(0.0, 1 - abs(y - {THETA}) / (m - {THETA}))), 6) AS xy "
    f"FROM (SELECT sup_a, sup_ab, sup_a::DOUBLE AS x, sup_ab::DOUBLE AS y, {_M}::DOUBLE AS m FROM pt) q"
)

SQL: dict[str, str] = {
    "item_counts": _with("c", "SELECT item, cnt FROM c"),
    "item_ranks": _with("ranked", "SELECT item, cnt, rank FROM ranked"),
    "top_items": _with("top", "SELECT item, cnt FROM top"),
    "zero_filled_counts": _with("c", "SELECT g.i::INT AS item, coalesce(c.cnt, 0) AS cnt FROM (SELECT unnest(range(1, 2 * (SELECT max(item) FROM c) + 1)) AS i) g LEFT JOIN c ON c.item * 2 = g.i"),
    "basket_lines": _with("b", "SELECT size, count(*) AS n FROM (SELECT tid, count(*) AS size FROM b GROUP BY tid) q GROUP BY size"),
    "basket_profile": _with("t ranked", f"SELECT {_M} AS t, (SELECT max(item) FROM b) AS n, (SELECT max(k) + 1 FROM (SELECT count(*) AS k FROM b GROUP BY tid) q) AS depth, (SELECT count(DISTINCT p) + 1 FROM (SELECT string_agg(item::VARCHAR, ' ') OVER (PARTITION BY tid ORDER BY rank) AS p FROM b JOIN ranked USING (item)) q) AS nodes"),
    "rank_sorted_baskets": _with("ranked", "SELECT tid, string_agg(item::VARCHAR, ' ' ORDER BY rank) AS items FROM b JOIN ranked USING (item) GROUP BY tid"),
    "restricted_baskets": _with("t tb", "SELECT tid, coalesce(string_agg(item::VARCHAR, ' ' ORDER BY item), '') AS items FROM t LEFT JOIN tb USING (tid) GROUP BY tid"),
    "weighted_baskets": _with("b", "SELECT items, count(*) AS w FROM (SELECT string_agg(item::VARCHAR, ' ' ORDER BY item) AS items FROM b GROUP BY tid) q GROUP BY items"),
    "itemset_enumeration": _with("s", f"SELECT {_text('a')} AS itemset, sup AS support FROM s WHERE len(a) > 1"),
    "dense_itemsets": _with("cb", "SELECT x.item || ' ' || y.item AS itemset, count(*) AS support FROM cb x JOIN cb y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL UNION ALL SELECT x.item || ' ' || y.item || ' ' || z.item, count(*) FROM cb x JOIN cb y ON x.tid = y.tid AND x.item < y.item JOIN cb z ON z.tid = y.tid AND y.item < z.item GROUP BY ALL"),
    "itemset_support": _with("top s2", "SELECT DISTINCT least(i, j) || ' ' || greatest(i, j) || suffix AS itemset, CASE WHEN suffix = '' THEN sup ELSE 0 END AS support FROM (SELECT top.item AS i, top.item % 25 + 1 AS j, coalesce(s2.sup, 0) AS sup FROM top LEFT JOIN s2 ON s2.i = top.item AND s2.j = top.item % 25 + 1) q CROSS JOIN (VALUES (''), (' 99')) v(suffix)"),
    "extended_prefixes": _with("top s2", "SELECT p.item::VARCHAR AS prefix, x.item, coalesce(s2.sup, 0) AS support FROM top p JOIN top x ON x.item <> p.item LEFT JOIN s2 ON s2.i = p.item AND s2.j = x.item WHERE p.rank <= 2"),
    "itemsets_within": _with("s top", f"SELECT {_text('a')} AS itemset, sup AS support FROM s, (SELECT list(item) AS four FROM top WHERE rank <= 4) q WHERE len(list_filter(a, lambda x : NOT list_contains(four, x))) = 0"),
    "supersets_of": _with("s top", f"SELECT {_text('a')} AS itemset, sup AS support FROM s WHERE len(a) = 3 AND list_contains(a, (SELECT item FROM top WHERE rank = 1))"),
    "expanded_leaves": _with("s", f"SELECT DISTINCT {_text('sub')} AS itemset FROM (SELECT unnest({_SUBSETS.format(a='a', less=0)}) AS sub FROM s WHERE len(a) = 3) q WHERE len(sub) >= 2"),
    "unseen_itemsets": _with("r", "SELECT k AS itemset FROM r WHERE len(a) = 2 GROUP BY k HAVING max(conf) <= 0.2"),
    "rules": _with("r", _RULE),
    "confident_rules": _with("r", _RULE + " WHERE conf > 0.15"),
    "nonzero_conf": _with("r", "SELECT len(a) AS size, count(*) AS n FROM r WHERE conf <> 0 GROUP BY ALL"),
    "exact_stats": _with("stats", f"SELECT {_text('a')} AS itemset, support, n30, n50, n70 FROM stats"),
    "conf_range": _with("r", "SELECT round(coalesce(min(conf), 1), 6) AS min_conf, round(coalesce(max(conf), 0), 6) AS max_conf FROM r"),
    "conf_histogram": _with("r bins", f"{_HIST} FROM {_FULL}"),
    "parsed_histogram": _with("r bins", f"SELECT bound, n, cum_n FROM {_FULL}"),
    "rule_points": _with("r", f"{_POINTS} FROM r"),
    "rule_points_improper": _with("r s", f"{_POINTS} FROM r WHERE len(a) <= 2 UNION ALL SELECT k, k, sup, sup, len(a), len(a) FROM s WHERE len(a) <= 2"),
    "rule_count_of_itemsets": _with("s", "SELECT sum((1 << len(a)) - 2)::BIGINT AS n_rules FROM s"),
    "lattice_check": _with("s", "SELECT *, n_itemsets = power(2, n_items) - 1 AND n_rules = power(3, n_items) - power(2, n_items + 1) + 1 AS complete FROM (SELECT count(*) FILTER (len(a) = 1) AS n_items, count(*) AS n_itemsets, sum((1 << len(a)) - 2)::BIGINT AS n_rules FROM s) q"),
    "rule_lines": _with("r", f"SELECT {_LINE} AS value FROM r"),
    "distinct_rule_digits": _with("r", f"SELECT g.k::INT AS digit, coalesce(n, 0) AS n FROM range(10) g(k) LEFT JOIN (SELECT d, count(*) AS n FROM (SELECT DISTINCT value, regexp_extract(value, 'c=0\\.(\\d)', 1) AS d FROM (SELECT {_LINE} AS value FROM r) q) w WHERE d <> '' GROUP BY d) h ON h.d = g.k::VARCHAR"),
    "itemset_lines": _with("s", f"SELECT {_text('a')} AS itemset, sup AS support FROM s WHERE len(a) <= 2"),
    "rules_space": _with("r c", f"SELECT (SELECT count(*) * (count(*) - 1) * (count(*) - 1) FROM c) AS possible, count(*) AS n_rules FROM r"),
    "noisy_items": _with("placed", "SELECT item, real_count, round(noisy_count, 6) AS noisy_count, pos FROM placed"),
    "above_noise_floor": _with("placed", "SELECT item, real_count, round(noisy_count, 6) AS noisy_count, pos FROM placed WHERE noisy_count >= 120.0 / 0.05"),
    "top_noisy_items": _with("placed", f"SELECT item, real_count, round(noisy_count, 6) AS noisy_count, pos FROM placed WHERE pos <= {NI}"),
    "scalar_functions": _with("c", f"SELECT item, round(u, 12) AS u, round({_LAPLACE.format(u='u', b='2.0')}, 6) AS noise, CASE WHEN item % 2 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(cnt::DOUBLE, 6) END AS ratio, item || '/' || (item + 1) || '/' || item || ' ' || (item + 1) || '/' || (item + 2) || '/' || item || ' ' || (item + 2) || '/' || (item + 1) || ' ' || (item + 2) AS parts FROM (SELECT item, cnt, {_U.format(chr(39) + '7|' + chr(39) + ' || item')} AS u FROM c) q"),
    "weighted_sample": _with("s", f"SELECT a, item, draw, round(v, 9) AS v FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY v, item) AS draw FROM (SELECT a[1] AS a, a[2] AS item, -ln({_U.format(chr(39) + '5|' + chr(39) + ' || a[1] || ' + chr(39) + '|' + chr(39) + ' || a[2]')}) / sup AS v FROM s WHERE len(a) = 2) q) w WHERE draw <= 3"),
    "extension_qualities": _with("top s2", "SELECT p.item::VARCHAR AS prefix, x.item, m.method, round(CASE m.method WHEN 'sigma' THEN sup WHEN 'delta' THEN sup - p.cnt WHEN 'd' THEN -abs(sup / 0.5 - x.cnt) ELSE least(sup / 0.5 - x.cnt, 0) END, 6)::DOUBLE AS q FROM top p JOIN top x ON x.item <> p.item LEFT JOIN (SELECT i, j, sup FROM s2) y ON y.i = p.item AND y.j = x.item CROSS JOIN (VALUES ('sigma'), ('delta'), ('d'), ('d asymmetric')) m(method)"),
    "reduced_delta": _with("s parts", "SELECT p.k AS itemset, max(p.sup) - min(q.sup) AS q FROM parts p JOIN s q ON q.k = p.part GROUP BY p.k"),
    "rule_qualities": _with("pt t", _SCORES),
    "em_probabilities": _with("pt t", f"SELECT sup_a, sup_ab, round(q, 6) AS q, round(e / sum(e) OVER (), 6) AS p FROM (SELECT *, exp(0.01 / 2 * (q - max(q) OVER ())) AS e FROM (SELECT sup_a, sup_ab, {_mt('m')} AS q FROM (SELECT sup_a, sup_ab, sup_a::DOUBLE AS x, sup_ab::DOUBLE AS y, {_M}::DOUBLE AS m FROM pt) w) v) u"),
    "best_extension_sigma": _chain("sup"),
    "best_extension_delta": _chain("sup - low"),
    "best_extension_d": _chain("sup / 0.5 - low"),
    "private_leaves": _with("leaf", "SELECT run_id, i || ' ' || j AS itemset FROM leaf"),
    "private_rules": _with("pr", "SELECT run_id, i || ' ' || j AS itemset, a::VARCHAR AS antecedent, sup_ab, sup_a, round(conf, 6) AS conf FROM pr"),
    "private_histogram": _with("ph", "SELECT run_id, " + _HIST.removeprefix("SELECT ") + " FROM ph"),
    "merge_real_private": _with("ps stats", f"SELECT coalesce({_text('s.a')}, i || ' ' || j) AS itemset, coalesce(s.n30, 0) AS n30, coalesce(s.n50, 0) AS n50, coalesce(s.n70, 0) AS n70, p.i IS NOT NULL AS dpseen, coalesce(p.n30, 0) AS p30, coalesce(p.n50, 0) AS p50, coalesce(p.n70, 0) AS p70 FROM (SELECT * FROM stats WHERE len(a) = 2) s FULL OUTER JOIN (SELECT * FROM ps WHERE run_id = 2) p ON s.a[1] = p.i AND s.a[2] = p.j"),
    "recall_report": _with("rec", "SELECT threshold, private, real, round(CASE WHEN real = 0 THEN CASE WHEN private = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE private / real END, 6) AS recall FROM (SELECT 0.3 AS threshold, p30 AS private, n30 AS real FROM rec UNION ALL SELECT 0.5, p50, n50 FROM rec UNION ALL SELECT 0.7, p70, n70 FROM rec) q"),
    "estimated_recall": _with("rec ph", f"SELECT threshold, private, estimated, round(CASE WHEN estimated = 0 THEN CASE WHEN private = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE private / estimated END, 6) AS recall FROM (SELECT h.bound AS threshold, CASE h.bin WHEN 6 THEN p30 WHEN 4 THEN p50 ELSE p70 END AS private, CAST(trunc({rule_space(NI, 2)} * (CASE WHEN tot = 0 THEN 0 ELSE cum_n / tot END)) AS BIGINT) AS estimated FROM ph h, rec WHERE run_id = 2 AND bin IN (2, 4, 6)) q"),
    "sweep": _with("sw", "SELECT run_id, db, eps, epsh, c0, rmax, nits, bf, seed, leaves, rules, rules50, round(rules50 / nullif(rules, 0), 6) AS prec50, realrls, round(rules50 / nullif(realrls, 0), 6) AS recall FROM sw"),
    "run_logs": _with("sw", "SELECT 'logs/run_' || run_id AS file, 'orders' AS db, eps, epsh, c0, rmax, nits, bf, seed, leaves, 0.5 AS time, round(0.5 / nullif(leaves, 0), 6) AS tpl, coalesce(rules, 0) AS rules, coalesce(rules50, 0) AS rules50, round(coalesce(rules50, 0) / nullif(coalesce(rules, 0), 0), 6) AS prec50, realrls, 0.25 AS recall FROM sw"),
    "average_runs": _with("av", "SELECT db, eps, c0, rmax, ni, bf, round(R, 6) AS R, round(R50, 6) AS R50, round(RR, 6) AS RR, round(CASE WHEN R = 0 THEN 0 ELSE R50 / R END, 6) AS precision, round(CASE WHEN RR = 0 THEN CASE WHEN R50 = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE R50 / RR END, 6) AS recall FROM av"),
    "series": _with("av", f"SELECT bf AS x, round(R, 6) AS y FROM av WHERE eps = 0.5 AND c0 = 0.5 AND rmax = 2 AND ni = {NI}"),
    "good_vs_all": _with("av", "SELECT round(R, 6) AS R, round(R50, 6) AS R50 FROM av WHERE rmax = 2 AND eps = 0.5 AND c0 = 0.5"),
    "precision_vs_k": _with("sw", "SELECT bf AS k, round(rules50 / nullif(rules, 0), 6) AS precision FROM sw WHERE seed = 1 AND eps = 0.5"),
    "precision_vs_eps": _with("ph runs", f"SELECT eps, round(coalesce(p90, 0), 6) AS p90, round(coalesce(p70, 0), 6) AS p70, round(coalesce(p50, 0), 6) AS p50 FROM ({_WIDE}) q WHERE bf = 2"),
    "precision_by_k": _with("ph runs", f"SELECT bf AS k, round(coalesce(p90, 0), 6) AS p90, round(coalesce(p70, 0), 6) AS p70, round(coalesce(p50, 0), 6) AS p50 FROM ({_WIDE}) q WHERE eps = 0.5"),
    "with_baseline": _with("sw", "SELECT db, seed, bf, eps, rules, CASE bf WHEN 2 THEN 'method' ELSE 'baseline' END AS method FROM sw WHERE seed = 1"),
    "average_histograms": _with("ph runs", "SELECT eps, bf, bound, runs, mean_total, mean_cum, round(mean_cum / nullif(mean_total, 0), 6) AS of_total, round(mean_cum / 100, 6) AS of_expected FROM (SELECT *, max(mean_cum) OVER (PARTITION BY eps, bf) AS mean_total FROM (SELECT eps, bf, bound, count(*) AS runs, avg(cum_n) AS mean_cum FROM ph JOIN runs USING (run_id) GROUP BY ALL) q) w"),
    "layer_bin_matrix": _with("ph runs", "SELECT bound, lmax AS shelves, " + ", ".join(f"coalesce(sum(cum_n) FILTER (bf = {k}) / 2, 0.0) AS \"{k}\"" for k in range(1, 11)) + " FROM ph JOIN runs USING (run_id) WHERE eps = 0.5 GROUP BY ALL"),
    "matrix_series": _with("ph runs", "SELECT lmax AS shelves, g.k::INT AS bins, coalesce(sum(cum_n) FILTER (bf = g.k) / 2, 0.0) AS value FROM ph JOIN runs USING (run_id) CROSS JOIN range(1, 11) g(k) WHERE eps = 0.5 AND bin = 9 GROUP BY ALL"),
}
_D = lambda c: f"-abs(sup / c0 - {c})"
_LACK = lambda c: f"least(sup / c0 - {c}, 0)"
SQL |= {
    "private_three": _deep("sup", "sup"),
    "private_three_delta": _deep("sup - sp", "sup - least(sp, c1, cx)"),
    "private_three_d": _deep(f"least({_LACK('c1')}, {_LACK('cx')})", f"least({_LACK('c1')}, {_LACK('c2')}, {_LACK('cx')})", "em"),
    "private_three_last": _deep("sup", _D("cx")),
    "private_branches": _deep("sup", "sup", grid=BRANCHES, baskets="cb"),
    # the second chain finds the set complete
    "best_extension_sigma_d": SQL["best_extension_sigma"],
    "best_extension_delta_d": SQL["best_extension_delta"],
    "stored_stats": SQL["exact_stats"],
    "run_table": SQL["run_logs"].replace("'logs/run_' || run_id AS file, ", ""),
    "experiment_report": SQL["average_runs"].replace("'orders.brand' AS db", "'orders' AS db"),
}


def _sparse() -> str:
    """Leaves of two levels with two draws each, where pairs without support are drawn as one class: of four, as two may be struck off."""
    u = lambda name, i: _U.format(f"seed || '|1|' || p || '|{name}|{i}'")
    e, rows = "0", []
    for i in range(1, 5):
        e = f"({e} - ln({u('zero', i)}) / (len(z) - {i - 1}))"
        rows.append(f"SELECT run_id, br, bf, p, r{i - 1}[a{i}] AS x, ln({e}) AS v FROM zr WHERE len(z) >= {i}")
    steps = "SELECT *, z AS r0 FROM zl"
    for i in range(1, 5):
        steps = f"SELECT *, list_concat(r{i - 1}[: a{i} - 1], r{i - 1}[a{i} + 1 :]) AS r{i} FROM (SELECT *, CAST(floor({u('which', i)} * (len(z) - {i - 1})) AS INT) + 1 AS a{i} FROM ({steps}) s{i}) t{i}"
    tables = {
        "zl": "SELECT c.run_id, c.br, c.bf, c.p, r.seed, list(c.x ORDER BY c.x) AS z FROM cand c JOIN runs r USING (run_id) WHERE c.sup = 0 GROUP BY ALL",
        "zr": steps,
        "every": "SELECT run_id, br, bf, x, least(p, x) AS i, greatest(p, x) AS j, v FROM (SELECT run_id, br, bf, p, x, v FROM cand WHERE sup > 0 UNION ALL " + " UNION ALL ".join(rows) + ") q",
        "f1": "SELECT run_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v, x) AS n FROM every WHERE br = 1) q WHERE n <= bf",
        "f2": "SELECT run_id, i, j FROM (SELECT c.*, row_number() OVER (PARTITION BY c.run_id ORDER BY v, c.x) AS n FROM every c LEFT JOIN f1 ON f1.run_id = c.run_id AND f1.i = c.i AND f1.j = c.j WHERE br = 2 AND f1.i IS NULL) q WHERE n <= bf",
    }
    text = _with("cand runs", "").rstrip() + ", " + ", ".join(f"{k} AS MATERIALIZED ({t})" for k, t in tables.items())
    text += " SELECT run_id, i || ' ' || j AS itemset FROM f1 UNION ALL SELECT run_id, i || ' ' || j FROM f2"
    parts = "SELECT l_orderkey AS tid, l_partkey::INT AS item FROM lineitem GROUP BY ALL"
    return text.replace(_TABLES["b"], parts).replace(_TABLES["runs"], f"SELECT * FROM (VALUES {_grid(SPARSE)}) v(run_id, {', '.join(SPARSE)})")


SQL["private_sparse"] = _sparse()
_RUN_LOGS = f"SELECT * FROM ph JOIN runs USING (run_id) WHERE run_id <> {BROKEN}"
_AVERAGED = f"(SELECT db, eps, c0, rmax, nits AS ni, bf, avg(rules) AS R, avg(rules50) AS R50, avg(realrls) AS RR FROM sw WHERE run_id <> {BROKEN} GROUP BY ALL) q"
SQL |= {
    "replaced_stats": _with("stats", f"SELECT lmax, {_text('a')} AS itemset, support, n30, n50, n70 FROM stats, (VALUES (2), (4)) v(lmax) WHERE lmax = 4 OR len(a) = 2"),
    "nested_thresholds": _with("nested", "SELECT * FROM nested WHERE ni >= 5"),
    "nested_recall": _with(
        "ps nested runs",
        "SELECT run_id::INT AS run_id, threshold, coalesce(CASE threshold WHEN 0.3 THEN p30 WHEN 0.5 THEN p50 ELSE p70 END, 0) AS private, CASE threshold WHEN 0.3 THEN n30 WHEN 0.5 THEN n50 ELSE n70 END AS real, "
        "round(CASE WHEN real = 0 THEN CASE WHEN private = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE private / real END, 6) AS recall FROM runs JOIN nested USING (lmax, ni) "
        "LEFT JOIN (SELECT run_id, sum(n30) AS p30, sum(n50) AS p50, sum(n70) AS p70 FROM ps GROUP BY run_id) q USING (run_id) CROSS JOIN (VALUES (0.3), (0.5), (0.7)) v(threshold)",
    ).replace(_TABLES["runs"], f"SELECT * FROM (VALUES {_grid(RANGES)}) v(run_id, {', '.join(RANGES)})"),
    "vertical_itemsets": _with(
        "cptop",
        "SELECT x.item || ' ' || y.item AS itemset, count(*) AS support FROM v x JOIN v y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL UNION ALL "
        "SELECT x.item || ' ' || y.item || ' ' || z.item, count(*) FROM v x JOIN v y ON x.tid = y.tid AND x.item < y.item JOIN v z ON z.tid = y.tid AND y.item < z.item GROUP BY ALL",
    ).replace(") SELECT x.item", "), v AS MATERIALIZED (SELECT tid, item FROM cp JOIN cptop USING (item) WHERE rank <= 200) SELECT x.item", 1),
    "many_supports": _with(
        "cptop",
        "SELECT CASE WHEN p.item = q.item THEN p.item::VARCHAR ELSE p.item || ' ' || q.item END AS itemset, coalesce(n, 0) AS support FROM v p JOIN v q ON p.item <= q.item LEFT JOIN "
        "(SELECT x.item AS i, y.item AS j, count(*) AS n FROM (SELECT * FROM cp JOIN v USING (item)) x JOIN (SELECT * FROM cp JOIN v USING (item)) y ON x.tid = y.tid AND x.item <= y.item GROUP BY ALL) w ON i = p.item AND j = q.item",
    ).replace(") SELECT CASE", "), v AS (SELECT item FROM cptop WHERE rank <= 160) SELECT CASE", 1),
    "unseen_by_run": _with("leaf s runs", "SELECT u.run_id::INT AS run_id, k AS itemset FROM runs u CROSS JOIN s LEFT JOIN leaf l ON l.run_id = u.run_id AND l.i = s.a[1] AND l.j = s.a[2] WHERE len(a) = 2 AND l.i IS NULL"),
    "log_histograms": _with(
        "ph runs",
        f"SELECT eps, bf, bound, runs, mean_saved, mean_total, mean_cum, round(mean_cum / nullif(mean_total, 0), 6) AS of_total, round(mean_cum / bf, 6) AS of_expected FROM (SELECT *, max(mean_cum) OVER (PARTITION BY eps, bf) AS mean_total FROM (SELECT eps, bf, bound, count(*) AS runs, avg(cum_n) AS mean_cum, avg(tot) AS mean_saved FROM ({_RUN_LOGS}) q GROUP BY ALL) q) w",
    ),
    "log_matrix": _with("ph runs", "SELECT bound, lmax AS shelves, " + ", ".join(f"coalesce(sum(cum_n) FILTER (bf = {k}) / 4, 0.0) AS \"{k}\"" for k in range(1, 11)) + f" FROM ({_RUN_LOGS}) q GROUP BY ALL"),
    "log_matrix_series": _with("ph runs", f"SELECT lmax AS shelves, g.k::INT AS bins, coalesce(sum(cum_n) FILTER (bf = g.k) / 4, 0.0) AS value FROM ({_RUN_LOGS}) q CROSS JOIN range(1, 11) g(k) WHERE bin = 4 GROUP BY ALL"),
    "log_series_by_draws": _with("sw", f"SELECT 'orders' AS db, eps, c0, rmax, ni, bf AS x, round(R, 6) AS R, round(R50, 6) AS R50 FROM {_AVERAGED}"),
    "log_series_by_budget": _with("sw", f"SELECT 'orders' AS db, c0, rmax, ni, bf, eps AS x, round(CASE WHEN R = 0 THEN 0 ELSE R50 / R END, 6) AS precision, round(CASE WHEN RR = 0 THEN CASE WHEN R50 = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END ELSE R50 / RR END, 6) AS recall FROM {_AVERAGED}"),
}
SQL |= {"restricted_to_table": SQL["restricted_baskets"], "itemset_enumeration_bitmap": SQL["itemset_enumeration"]}
assert LMAX == 3  # the set enumeration above has as many levels
