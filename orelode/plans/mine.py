"""The mining query: top-k high-utility itemsets over uncertain transactions."""

from __future__ import annotations

import logging
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.lineage import cut, planned_as_dealt
from ..model import Join, Params, Search
from ..operators import topk
from ..operators.entries import entries, first_level
from ..operators.extend import extend, measured, prune_ep, prune_ptwu, prune_pub, surviving
from ..operators.stats import item_stats, ranking, valid_items, with_profit, with_ptu
from .grouped import prefix_search

log = logging.getLogger(__name__)
PATTERNS = "items array<int>, eu double, ep double"


def heap_used(spark) -> float:
    """MB of the driver's heap in use."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return (runtime.totalMemory() - runtime.freeMemory()) / 1e6


def _phase(spark, name: str, began: float) -> None:
    if log.isEnabledFor(logging.DEBUG):
        log.debug("%s: %.3f s since the start, %.0f MB of the driver's heap", name, time.perf_counter() - began, heap_used(spark))


def _held(spark, rows: list) -> DataFrame:
    return spark.createDataFrame([(list(r["items"]), r["eu"], r["ep"]) for r in rows], PATTERNS)


def level_wise(spark, base: DataFrame, ranks: DataFrame, n_items: int, params: Params, start: DataFrame | None = None, held: list | None = None, depth: int | None = None) -> tuple[list, bool]:
    """The best itemsets by levels.

    Rows are cut to the checkpoint folder after each level, still partitioned by
    transaction: extending is a co-partitioned join, measuring shuffles partial
    sums only, and survivors come back by broadcast while they are few. After
    each level the k best reach the driver (k rows at most), and their weakest
    utility prunes the next. Also returns whether the search came to its end
    before ``depth``.
    """
    rows, best, number = start if start is not None else first_level(base), held or [], 1
    n_entries = base.count() if params.join is Join.BINARY else None
    while True:
        found = measured(rows).persist(StorageLevel.MEMORY_AND_DISK)
        batch = topk.admitted(found, params.min_prob, best[-1]["eu"] if len(best) >= params.k else 0.0)
        best = topk.merged(best, topk.collect(batch, params.k, params.collector).collect(), params.k)
        theta = best[-1]["eu"] if len(best) >= params.k else 0.0
        alive = prune_ptwu(prune_pub(prune_ep(found, params.min_prob), theta), ranks, theta, n_items)
        n = alive.count()
        log.debug("level %d: %d alive, threshold %s", number, n, theta)
        if not n or number == depth:
            found.unpersist()
            return best, not n
        rows, number = cut(extend(surviving(rows, alive, n), base, params.join, n_entries), dealt=True), number + 1
        found.unpersist()


def prepared(occ: DataFrame, profit: DataFrame, min_prob: float) -> tuple[DataFrame, DataFrame, int]:
    """Entries, by transaction, the ranking, both computed once, and the number of ranked items.

    The input is read and dealt by transaction once; statistics and entries
    both start from there.
    """
    with planned_as_dealt(occ.sparkSession):
        priced = with_ptu(with_profit(occ, profit)).persist(StorageLevel.MEMORY_AND_DISK)
    ranks = cut(ranking(valid_items(item_stats(priced), min_prob)))
    n = ranks.count()
    base = cut(entries(priced, ranks, n), dealt=True)
    priced.unpersist()
    return base, ranks, n


def mine(occ: DataFrame, profit: DataFrame, k: int, min_prob: float, search: Search | str = Search.BREADTH_FIRST, join: str = "two_pointer", collector: str | None = None) -> DataFrame:
    """The ``k`` itemsets of highest expected utility whose existential probability reaches ``min_prob``.

    ``occ (tid, item, qty, prob)``, ``profit (item, profit)``. Returns ``rank,
    items, size, eu, ep``. Itemsets of negative expected utility are never
    returned, even where fewer than ``k`` are left. All searches, joins and
    collectors give the same rows; no collector means the one the session names. Occurrences with a null field, a quantity of
    0 or less, a probability outside 0 to 1 or an item without profit don't
    count; empty inputs give an empty result.
    """
    spark = occ.sparkSession
    params = Params(k, min_prob, search, join, topk.configured(spark) if collector is None else collector)
    began = time.perf_counter()
    clean = occ.where("qty > 0 and item >= 0 and prob between 0 and 1 and not isnan(prob) and tid is not null").select("tid", "item", "qty", "prob")
    prices = profit.where("profit is not null and not isnan(profit)").select("item", "profit")
    base, ranks, n = prepared(clean, prices, min_prob)
    _phase(spark, "statistics, ranking and entries", began)
    if params.search is Search.BREADTH_FIRST:
        best, _ = level_wise(spark, base, ranks, n, params)
    elif params.search is Search.ITERATIVE_DEEPENING:
        best, ended, depth = [], False, 0
        while not ended:  # each round starts anew, one level deeper, with the threshold of the last
            depth += 1
            best, ended = level_wise(spark, base, ranks, n, params, held=best, depth=depth)
    else:
        best = prefix_search(spark, base, ranks, n, params, level_wise)
    _phase(spark, params.search.value, began)
    return topk.ranked(_held(spark, best))

