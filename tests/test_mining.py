import itertools
import math
import random

import pytest

from orelode.functions.scalars import pattern_text
from orelode.operators import stats, topk
from orelode.plans import grouped
from orelode.plans.mine import mine
from pyspark.sql import functions as F

OCC = "tid long, item int, qty int, prob double"


def brute(rows, profit, k, min_prob):
    """All itemsets, by their definitions."""
    by = {}
    for t, i, q, p in rows:
        by.setdefault(t, {})[i] = (q, p)
    ptu = {t: sum(profit[i] * q for i, (q, _) in x.items() if profit.get(i, 0) > 0) for t, x in by.items()}
    items = sorted({i for _, i, _, _ in rows if i in profit})
    keep = []
    for i in items:
        ep = 1 - math.prod(1 - x[i][1] for x in by.values() if i in x)
        if ep >= min_prob - 1e-10 and sum(ptu[t] for t, x in by.items() if i in x) > 0:
            keep.append(i)
    found = []
    for n in range(1, len(keep) + 1):
        for s in itertools.combinations(keep, n):
            held = [x for x in by.values() if all(i in x and x[i][1] > 0 for i in s)]
            if held:
                ps = [math.prod(x[i][1] for i in s) for x in held]
                eu = sum(p * sum(profit[i] * x[i][0] for i in s) for p, x in zip(ps, held))
                ep = 1 - math.prod(1 - p for p in ps)
                if ep >= min_prob - 1e-10 and eu >= -1e-10:
                    found.append((round(eu, 8), len(s), list(s), round(ep, 8)))
    return sorted(found, reverse=True)[:k]


def case(seed, items=6, transactions=25):
    r = random.Random(seed)
    rows = [(t, i, r.randint(1, 5), r.choice([0.0, 1.0, r.random(), r.random()])) for t in range(transactions) for i in range(items) if r.random() < 0.5]
    return rows, {i: round(r.uniform(-5, 9), 2) for i in range(items)}


def run(spark, rows, profit, k, p, **how):
    found = mine(spark.createDataFrame(rows, OCC), spark.createDataFrame(list(profit.items()), "item int, profit double"), k, p, **how).orderBy("rank").collect()
    return [(round(r.eu, 8), r.size, list(r["items"]), round(r.ep, 8)) for r in found]


def test_worked_example(spark):
    rows, profit = [(1, 1, 2, 0.8), (1, 2, 1, 0.9), (2, 1, 3, 0.7), (2, 3, 2, 0.6)], {1: 10.0, 2: 15.0, 3: 5.0}
    found = {tuple(x[2]): x for x in run(spark, rows, profit, 10, 0.0)}
    assert found[(1,)][0] == 37 and found[(1,)][3] == 0.94
    assert found[(1, 2)][0] == 25.2 and found[(1, 2)][3] == 0.72
    priced = stats.with_profit(spark.createDataFrame(rows, OCC), spark.createDataFrame(list(profit.items()), "item int, profit double"))
    assert {r.item: r.ptwu for r in stats.item_stats(priced).collect()} == {1: 75, 2: 35, 3: 40}


@pytest.mark.parametrize("how", [{}, {"search": "depth_first", "collector": "lazy"}, {"search": "best_first", "join": "binary"}, {"search": "iterative_deepening", "collector": "sharded", "join": "exponential"}])
@pytest.mark.parametrize("seed, k, p", [(1, 7, 0.0), (2, 100, 0.6)])
def test_against_brute_force(spark, how, seed, k, p):
    rows, profit = case(seed)
    assert run(spark, rows, profit, k, p, **how) == brute(rows, profit, k, p)


def test_wide_prefixes_go_by_levels(spark, monkeypatch):
    monkeypatch.setattr(grouped, "ROWS", 20)
    rows, profit = case(3)
    assert run(spark, rows, profit, 9, 0.1, search="depth_first") == brute(rows, profit, 9, 0.1)


def test_empty_inputs_and_bad_rows(spark):
    assert run(spark, [], {1: 1.0}, 5, 0.5) == []
    bad = [(1, 1, 0, 0.5), (1, 2, 1, float("nan")), (1, 3, 1, 1.5), (None, 1, 1, 0.5), (1, 4, None, 0.5), (2, 1, 2, 0.5)]
    assert run(spark, bad, {1: 3.0, 2: 1.0}, 5, 0.0) == [(3.0, 1, [1], 0.5)]


def test_order_of_ties(spark):
    rows = spark.createDataFrame([([1], 5.0, 1.0), ([1, 2], 5.0, 1.0), ([1, 3], 5.0, 1.0), ([2], 7.0, 1.0)], "items array<int>, eu double, ep double")
    assert [list(r["items"]) for r in topk.exact(rows, 4).collect()] == [[2], [1, 3], [1, 2], [1]]
    assert rows.select(pattern_text(F.col("items"), F.col("eu"), F.col("ep")).alias("t")).first().t == "Pattern{items={1}, EU=5.0000, EP=1.000000}"


def test_large_entries_are_not_broadcast(spark, monkeypatch):
    from orelode.operators import extend as ext
    from orelode.operators.entries import entries, first_level

    monkeypatch.setattr(ext, "BROADCAST", 5)
    rows, profit = case(4)
    priced = stats.with_profit(spark.createDataFrame(rows, OCC), spark.createDataFrame(list(profit.items()), "item int, profit double"))
    base = entries(priced, stats.ranking(stats.valid_items(stats.item_stats(priced), 0.0)))
    plan = ext.extend(first_level(base), base, "binary")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_collector_of_the_session(spark):
    rows, profit = case(5)
    spark.conf.set("spark.orelode.collector", "lazy")
    try:
        assert topk.configured(spark).name == "LAZY" and run(spark, rows, profit, 7, 0.0) == brute(rows, profit, 7, 0.0)
        spark.conf.set("spark.orelode.collector", "none of these")
        with pytest.raises(ValueError, match="collector"):
            run(spark, rows, profit, 7, 0.0)
    finally:
        spark.conf.unset("spark.orelode.collector")
    assert topk.configured(spark).name == "BASELINE"


def test_joins_by_transaction_are_not_cross_joins(spark):
    from orelode.operators.entries import entries, first_level
    from orelode.operators.extend import extend

    rows, profit = case(4)
    priced = stats.with_profit(spark.createDataFrame(rows, OCC), spark.createDataFrame(list(profit.items()), "item int, profit double"))
    base = entries(priced, stats.ranking(stats.valid_items(stats.item_stats(priced), 0.0)))
    for join, name in (("two_pointer", "SortMergeJoin"), ("exponential", "ShuffledHashJoin"), ("binary", "BroadcastHashJoin")):
        plan = extend(first_level(base), base, join)._jdf.queryExecution().executedPlan().toString()
        assert name in plan and "Cartesian" not in plan and "NestedLoop" not in plan
