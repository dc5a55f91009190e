"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from .functions.scalars import SHARD_BASE, SHARD_PRIME
from .model import EPSILON, LOG_ZERO
from .sources.fixtures import SHAPES, occ_sql, profit_sql

LC = f"CASE WHEN prob <= 0 THEN 0e0 WHEN prob >= 1 THEN {LOG_ZERO}e0 ELSE ln(1e0 - prob) END"
CERTAIN = f"CASE WHEN p > 1e0 - {EPSILON} THEN {LOG_ZERO}e0 WHEN p <= 0 THEN 0e0 ELSE ln(1e0 - p) END"
EP = "1e0 - exp(greatest(sum({}), {}e0))".format("{}", LOG_ZERO)
GAIN = "CASE WHEN profit > 0 THEN profit * qty ELSE 0e0 END"
ORDER = "eu DESC, len(items) DESC, items DESC"
KEY = "array_to_string(list_sort(items), ',')"


def base(shape: str, min_prob: float = 0.0) -> str:
    """The chain of views from the fixture to the entries; queries continue it."""
    return f"""WITH RECURSIVE occ AS ({occ_sql(shape)}),
profit AS ({profit_sql(shape, f"range(1, {SHAPES[shape][0] + 1}) r(i)")}),
priced AS (SELECT tid, item, qty, prob, profit, profit * qty AS u FROM occ JOIN profit USING (item)),
ptu AS (SELECT tid, sum({GAIN}) AS ptu FROM priced GROUP BY tid),
stats AS (SELECT item, sum(ptu) AS ptwu, {EP.format(LC)} AS ep, sum(u * prob) AS eu, count(*) AS support FROM priced JOIN ptu USING (tid) GROUP BY item),
valid AS (SELECT * FROM stats WHERE ep >= {min_prob}e0 - {EPSILON} AND ptwu > 0),
ranks AS (SELECT item, row_number() OVER (ORDER BY ptwu, item) - 1 AS rank, ptwu, ep FROM valid),
entries AS (SELECT tid, item, rank, u, prob AS p, coalesce(sum(CASE WHEN profit > 0 THEN u ELSE 0e0 END) OVER (PARTITION BY tid ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0) AS ru
  FROM priced JOIN ranks USING (item) WHERE prob > 0),
one AS (SELECT [item] AS items, rank AS last_rank, rank AS first_rank, tid, u, p, ru FROM entries),
two AS (SELECT list_append(l.items, e.item) AS items, e.rank AS last_rank, l.first_rank, l.tid, l.u + e.u AS u, l.p * e.p AS p, least(l.ru, e.ru) AS ru FROM one l JOIN entries e ON l.tid = e.tid AND e.rank > l.last_rank),
three AS (SELECT list_append(l.items, e.item) AS items, e.rank AS last_rank, l.first_rank, l.tid, l.u + e.u AS u, l.p * e.p AS p, least(l.ru, e.ru) AS ru FROM two l JOIN entries e ON l.tid = e.tid AND e.rank > l.last_rank)
"""


def measured(rows: str) -> str:
    return f"SELECT items, last_rank, first_rank, count(*) AS support, sum(u * p) AS eu, {EP.format(CERTAIN)} AS ep, sum(p * greatest(u + ru, 0e0)) AS pub FROM {rows} GROUP BY items, last_rank, first_rank"


def shown(rows: str) -> str:
    """An itemset table in the form that queries return."""
    return f"SELECT {KEY} AS items, support, round(eu, 4) + 0e0 AS eu, round(ep, 6) AS ep, round(pub, 4) + 0e0 AS pub FROM ({rows}) m"


def stats_shown(rows: str) -> str:
    return f"SELECT CAST(item AS BIGINT) AS item, round(ptwu, 2) AS ptwu, round(ep, 6) AS ep, round(eu, 4) + 0e0 AS eu, support FROM {rows}"


def mined(shape: str, k: int, min_prob: float) -> str:
    """Exhaustive enumeration of all itemsets, then the best k."""
    return f"""{base(shape, min_prob)},
every AS (SELECT items, last_rank, tid, u, p FROM one UNION ALL
  SELECT list_append(l.items, e.item), e.rank, l.tid, l.u + e.u, l.p * e.p FROM every l JOIN entries e ON l.tid = e.tid AND e.rank > l.last_rank),
found AS (SELECT list_sort(items) AS items, sum(u * p) AS eu, {EP.format(CERTAIN)} AS ep FROM every GROUP BY list_sort(items)),
best AS (SELECT * FROM found WHERE ep >= {min_prob}e0 - {EPSILON} AND eu >= -{EPSILON} ORDER BY {ORDER} LIMIT {k})
SELECT row_number() OVER (ORDER BY {ORDER}) AS rank, array_to_string(items, ',') AS items, CAST(len(items) AS BIGINT) AS size, round(eu, 4) + 0e0 AS eu, round(ep, 6) AS ep FROM best"""


# Literal inputs of the parser, order and benchmark queries.
TOKENS = ("abc", "1:2", "1:2:0.5:9", "+7:1:.5", "1:2:1.5", "1:2:-0.1", "1:2:NaN", "1:2:0", "1:2:1", "-3:4:0.25", "7:x:0.5", "99999999999:1:0.5", "5:6:", "::", "8:3:0.125")
PATTERNS = (("1", 5.0), ("1,2", 5.0), ("1,3", 5.0), ("2", 7.0), ("1,2,3", 5.0), ("4", 0.0), ("2,10", 5.0), ("2,9", 5.0))
RUNS = (("full parallel", (274, 266, 300, 240, 292)), ("sequential", (2611, 2500, 2700, 2650, 2727)), ("phase 3", (62, 60, 70, 81, 90)))
# The 97.5 % points of Student's t for 1 to 9 degrees of freedom.
STUDENT = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262)
EDGES = ((0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (1e-12,), (0.999,))


def values(rows) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) and "e" not in repr(x) else repr(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def sql() -> dict[str, str]:
    out = {}
    for shape in SHAPES:
        out[f"fx_occ_{shape}"] = f"SELECT tid, CAST(item AS BIGINT) AS item, CAST(qty AS BIGINT) AS qty, round(prob, 9) AS prob FROM ({occ_sql(shape)}) o"
    out["fx_profit"] = f"SELECT CAST(item AS BIGINT) AS item, profit FROM ({profit_sql('u2', 'range(1, 201) r(i)')}) p"
    u1, u2 = base("u1", 0.7), base("u2", 0.0)
    out["db_sizes"] = f"{u1} SELECT (SELECT count(DISTINCT tid) FROM occ) AS transactions, (SELECT count(*) FROM occ) AS occurrences, (SELECT count(DISTINCT item) FROM occ) AS items, (SELECT count(*) FROM profit) AS profits"
    out["tok_roundtrip"] = f"{u1} SELECT tid, CAST(item AS BIGINT) AS item, CAST(qty AS BIGINT) AS qty, round(prob, 9) AS prob FROM occ"
    out["tok_reject"] = f"""SELECT CAST(string_split(t, ':')[1] AS BIGINT) AS item, CAST(string_split(t, ':')[2] AS BIGINT) AS qty, CAST(string_split(t, ':')[3] AS DOUBLE) AS prob FROM {values([(t,) for t in TOKENS])} v(t)
WHERE regexp_full_match(t, '-?[0-9]+:-?[0-9]+:-?[0-9.]+') AND TRY_CAST(string_split(t, ':')[1] AS INTEGER) IS NOT NULL AND TRY_CAST(string_split(t, ':')[3] AS DOUBLE) BETWEEN 0 AND 1"""
    out["tx_line_encode"] = f"{u1} SELECT tid, string_agg(item || ':' || qty, ' ' ORDER BY item) AS line FROM occ GROUP BY tid"
    out["profit_join"] = f"{u2} SELECT tid, CAST(item AS BIGINT) AS item, CAST(qty AS BIGINT) AS qty, round(prob, 9) AS prob, profit FROM priced"
    rich = profit_sql("u1", f"range(1, {SHAPES['u1'][0] + 1}) r(i)")
    out["profit_lookup"] = f"{u2} SELECT CAST(o.item AS BIGINT) AS item, coalesce(p.profit, 0e0) AS profit, count(*) AS n FROM occ o LEFT JOIN ({rich}) p USING (item) GROUP BY ALL"
    out["utility_rows"] = f"{u2} SELECT tid, CAST(item AS BIGINT) AS item, round(u, 2) + 0e0 AS u FROM priced"
    out["ptu_by_tx"] = f"{u2} SELECT tid, round(ptu, 2) AS ptu FROM ptu"
    out["ptu_broadcast"] = f"{u2} SELECT tid, CAST(item AS BIGINT) AS item, round(ptu, 2) AS ptu FROM priced JOIN ptu USING (tid)"
    out["ptwu_by_item"] = f"{u2} SELECT CAST(item AS BIGINT) AS item, round(ptwu, 2) AS ptwu FROM stats"
    out["log_complement"] = f"SELECT prob, round({LC}, 9) + 0e0 AS lc FROM {values(EDGES)} v(prob)"
    out["ep_by_item"] = f"{u2} SELECT CAST(item AS BIGINT) AS item, round(ep, 6) AS ep FROM stats"
    out["item_stats"] = f"{u2} {stats_shown('stats')}"
    out["item_stats_merge"] = out["item_stats"]
    out["valid_items"] = f"{base('u2', 0.94)} {stats_shown('valid')}"
    out["item_rank"] = f"{u2} SELECT CAST(item AS BIGINT) AS item, rank FROM ranks"
    out["first_rank"] = f"{u2} SELECT min(rank) AS rank FROM ranks WHERE ptwu >= 2000000e0 - {EPSILON}"
    out["suffix_sum"] = f"{u1} SELECT tid, CAST(item AS BIGINT) AS item, round(ru, 2) + 0e0 AS ru FROM entries"
    out["entries"] = f"{u2} SELECT tid, CAST(item AS BIGINT) AS item, rank, round(u, 2) + 0e0 AS u, round(p, 9) AS p, round(ru, 2) + 0e0 AS ru FROM entries"
    out["entries_by_item"] = f"{u2} SELECT CAST(item AS BIGINT) AS item, count(*) AS n, min(tid) AS first_tid, max(tid) AS last_tid FROM entries GROUP BY item"
    out["item_lists"] = f"{u2}, m AS ({measured('one')}) {shown('SELECT * FROM m')}"
    out["support_count"] = f"{u2} SELECT {KEY} AS items, support FROM ({measured('two')}) m"
    best = f"SELECT list_sort(items) AS items, eu, ep FROM m WHERE ep >= {{p}}e0 - {EPSILON} AND eu >= -{EPSILON} ORDER BY {ORDER} LIMIT {{k}}"
    out["topk_items"] = f"{u1}, m AS ({measured('one')}), b AS ({best.format(p=0.7, k=10)}) SELECT {KEY} AS items, round(eu, 4) + 0e0 AS eu, round(ep, 6) AS ep FROM b"
    out["theta0"] = f"{u1}, m AS ({measured('one')}), b AS ({best.format(p=0.7, k=10)}) SELECT round(CASE WHEN count(*) >= 10 THEN min(eu) ELSE 0e0 END, 4) AS theta FROM b"
    out["theta0_short"] = f"{u1}, m AS ({measured('one')}), b AS ({best.format(p=0.7, k=50)}) SELECT round(CASE WHEN count(*) >= 50 THEN min(eu) ELSE 0e0 END, 4) AS theta FROM b"
    for name in ("merge", "hash", "broadcast"):
        out[f"join_pairs_{name}"] = f"{u1} SELECT {KEY} AS items, tid, round(u, 2) + 0e0 AS u, round(p, 6) AS p, round(ru, 2) + 0e0 AS ru FROM two"
    out["pair_metrics"] = f"{u1} {shown(measured('two'))}"
    out["triple_metrics"] = f"{u1} {shown(measured('three'))}"
    out["pair_prune_ep"] = f"{u2} {shown(f'SELECT * FROM ({measured("two")}) x WHERE ep >= 1e-3 - {EPSILON}')}"
    over = f"m AS ({measured('two')}), o AS (SELECT * FROM m WHERE pub >= (SELECT avg(pub) FROM m) - {EPSILON})"
    out["pair_prune_pub"] = f"{u1}, {over} {shown('SELECT * FROM o')}"
    out["pair_prune_ptwu"] = f"{u1} {shown(f'SELECT x.* FROM ({measured("two")}) x JOIN ranks r ON r.rank = x.first_rank WHERE r.ptwu >= (SELECT avg(ptwu) FROM ranks) - {EPSILON}')}"
    out["semi_survivors"] = f"{u1}, {over} SELECT {KEY} AS items, count(*) AS n FROM two SEMI JOIN o USING (items) GROUP BY items"
    for name, (_, _, _, shape, k, p) in MINED.items():
        out[name] = mined(shape, k, p)
    out["result_table"] = f"WITH RECURSIVE m AS ({mined('u1', 10, 0.7)}) SELECT rank, '{{' || replace(items, ',', ', ') || '}}' AS itemset, printf('%.2f', eu) AS eu, printf('%.4f', ep) AS ep FROM m"
    dealt = f"m AS ({measured('two')}), s AS (SELECT list_sort(items) AS items, eu, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_sort(items)), lambda a, x: (a * {SHARD_BASE} + x) % {SHARD_PRIME}) % 4 AS BIGINT) AS shard FROM m)"
    out["topk_sharded_local"] = f"{u1}, {dealt} SELECT shard, {KEY} AS items, round(eu, 4) + 0e0 AS eu, place FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {ORDER}) AS place FROM s) x WHERE place <= 5"
    out["shard_counts"] = f"{u1}, {dealt} SELECT shard, count(*) AS n, round(min(eu), 4) AS weakest FROM s GROUP BY shard"
    out["work_parts"] = f"{u2} SELECT CAST(item AS BIGINT) AS item, least(7, CAST(floor((sum(ptwu) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) - ptwu / 2) / sum(ptwu) OVER () * 8) AS BIGINT)) AS part FROM ranks"
    out["split_point"] = f"{u1}, r AS (SELECT rank, sum(ptwu) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running, sum(ptwu) OVER () AS total FROM ranks) SELECT min(rank) AS rank FROM r WHERE running >= total / 2"
    out["pattern_order"] = f"WITH v AS (SELECT CAST(string_split(t, ',') AS INTEGER[]) AS items, eu FROM {values(PATTERNS)} v(t, eu)) SELECT row_number() OVER (ORDER BY {ORDER}) AS rank, {KEY} AS items, eu FROM v"
    out["upsert_dedupe"] = f"WITH v AS (SELECT [CAST(len(t) AS INTEGER)] AS items, eu, eu / 10 AS ep FROM {values(PATTERNS)} v(t, eu)) SELECT {KEY} AS items, max(eu) AS eu, max(ep) AS ep FROM v GROUP BY items"
    out["itemset_union"] = f"{u1} SELECT {KEY} AS items, count(*) AS n FROM two GROUP BY 1"
    out["tid_intersection"] = f"{u1} SELECT a.item AS a, b.item AS b, count(*) AS n FROM entries a JOIN entries b ON a.tid = b.tid AND a.item < b.item GROUP BY ALL"
    out["integrity"] = f"{u2} SELECT count(*) FILTER (qty <= 0) AS bad_quantity, count(*) FILTER (NOT (prob > 0 AND prob <= 1)) AS bad_probability, count(*) FILTER (item < 0) AS bad_item FROM occ"
    out["bound_ptwu"] = f"{u1} SELECT count(*) AS violations FROM ({measured('two')}) x JOIN ranks r ON r.rank = x.first_rank WHERE x.eu > r.ptwu + 1e-6"
    out["bound_pub"] = f"{u1} SELECT count(*) AS violations FROM ({measured('two')}) x JOIN ({measured('one')}) y ON y.first_rank = x.first_rank WHERE x.eu > y.pub + 1e-6"
    out["ep_antimonotone"] = f"{u2} SELECT count(*) AS violations FROM ({measured('two')}) x JOIN ({measured('one')}) y ON y.first_rank = x.first_rank WHERE x.ep > y.ep + 1e-9"
    out["bench_stats"] = f"SELECT config, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, round(stddev_pop(ms), 6) AS deviation, min(ms) AS fastest, max(ms) AS slowest, round(stddev_pop(ms) / avg(ms) * 100, 6) AS variation FROM {values([(c, float(t)) for c, ts in RUNS for t in ts])} v(config, ms) GROUP BY config"
    out["text_transactions"] = f"{u1} SELECT CAST(item AS BIGINT) AS item, CAST(qty AS BIGINT) AS qty, round(prob, 9) AS prob FROM occ"
    out["text_profits"] = f"SELECT CAST(item AS BIGINT) AS item, profit FROM ({rich}) p"
    out["baskets"] = f"{u1} SELECT 'Transaction{{id=' || tid || ', items=' || count(*) || '}}' AS shown, string_agg(item, ',' ORDER BY item) AS items, CAST(sum(qty) AS BIGINT) AS qty FROM occ GROUP BY tid"
    out["basket_lookup"] = f"{u1} SELECT tid, CAST(coalesce(max(qty) FILTER (item = 7), 0) AS BIGINT) AS qty, round(coalesce(max(prob) FILTER (item = 7), 0e0), 9) AS prob FROM occ GROUP BY tid"
    out["item_span"] = f"{u2} SELECT CAST(max(item) AS BIGINT) AS largest, CAST(max(item) + 1 AS BIGINT) AS dense, count(DISTINCT item) AS items FROM occ"
    out["pattern_text"] = f"SELECT 'Pattern{{items={{' || replace(t, ',', ', ') || '}}, EU=' || printf('%.4f', eu) || ', EP=0.500000}}' AS shown FROM {values(PATTERNS)} v(t, eu)"
    half = f"[{', '.join(f'{x}e0' for x in STUDENT)}][CAST(count(*) - 1 AS INTEGER)] * stddev_samp(ms) / sqrt(count(*))"
    out["bench_intervals"] = f"SELECT config, round(avg(ms), 6) AS mean, round(avg(ms) - {half}, 6) AS low, round(avg(ms) + {half}, 6) AS high FROM {values([(c, float(t)) for c, ts in RUNS for t in ts])} v(config, ms) GROUP BY config"
    return out


#: name -> search, join, collector, fixture, k, least probability
MINED = {
    "mine_bfs_u1_k10": ("breadth_first", "two_pointer", "baseline", "u1", 10, 0.7),
    "mine_bfs_u1_k50": ("breadth_first", "two_pointer", "baseline", "u1", 50, 0.7),
    "mine_bfs_u1_k1000": ("breadth_first", "two_pointer", "baseline", "u1", 1000, 0.7),
    "mine_bfs_u2_k200_p0": ("breadth_first", "two_pointer", "baseline", "u2", 200, 0.0),
    "mine_bfs_u2_k200_p01": ("breadth_first", "two_pointer", "baseline", "u2", 200, 0.01),
    "mine_dfs": ("depth_first", "two_pointer", "baseline", "u1", 50, 0.7),
    "mine_best_first": ("best_first", "two_pointer", "baseline", "u1", 50, 0.7),
    "mine_iddfs": ("iterative_deepening", "two_pointer", "baseline", "u1", 50, 0.7),
    "mine_join_two_pointer": ("breadth_first", "two_pointer", "baseline", "u1", 100, 0.7),
    "mine_join_exponential": ("breadth_first", "exponential", "baseline", "u1", 100, 0.7),
    "mine_join_binary": ("breadth_first", "binary", "baseline", "u1", 100, 0.7),
    "mine_topk_baseline": ("breadth_first", "two_pointer", "baseline", "u2", 100, 0.0),
    "mine_topk_sharded": ("breadth_first", "two_pointer", "sharded", "u2", 100, 0.0),
    "mine_topk_lazy": ("breadth_first", "two_pointer", "lazy", "u2", 100, 0.0),
}
