"""Searches that follow one prefix item at a time, as grouped tasks.

The rows of all transactions that hold an item, from its rank upwards, make the
prefix's group. Prefixes are dealt to tasks by ranges of about equal work; a task
searches its groups one after the other with a threshold of its own, which never
exceeds the global one, so no result is lost. A prefix whose group has more than
``ROWS`` rows is searched by levels instead, spread over tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.shipping import ship
from ..model import EPSILON, LOG_ZERO, Params, Search
from ..operators import topk
from ..operators.entries import first_level, item_lists
from ..operators.stats import small, work_parts

#: Rows of the largest group that one task takes.
ROWS = 2_000_000


def _log_complement(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 1 - EPSILON, LOG_ZERO, np.log1p(-np.minimum(p, 1 - 1e-300)))


class _Search:
    """Depth-first or best-first search below one prefix over columnar lists (transactions, u, p, ru)."""

    def __init__(self, rows: pd.DataFrame, prefix: int, ptwu: float, k: int, min_prob: float, floor: float, heap: list[tuple]):
        self.k, self.min_prob, self.floor, self.ptwu = k, min_prob, floor, ptwu
        self.lists, self.item = {}, {}
        order = rows.sort_values(["rank", "tid"], kind="stable")
        for rank, part in order.groupby("rank", sort=True):
            self.lists[int(rank)] = tuple(part[c].to_numpy() for c in ("tid", "u", "p", "ru"))
            self.item[int(rank)] = int(part["item"].iloc[0])
        self.ranks, self.prefix = sorted(self.lists), prefix
        self.heap = heap

    def threshold(self) -> float:
        return max(self.floor, self.heap[0][0] if len(self.heap) >= self.k else 0.0)

    def _measure(self, found: tuple) -> tuple[float, float, float]:
        _, u, p, ru = found
        lc = max(float(_log_complement(p).sum()), LOG_ZERO)
        return float((u * p).sum()), 1 - math.exp(lc), float((p * np.maximum(u + ru, 0)).sum())

    def _join(self, left: tuple, right: tuple) -> tuple:
        _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
        return left[0][i], left[1][i] + right[1][j], left[2][i] * right[2][j], np.minimum(left[3][i], right[3][j])

    def _offer(self, ranks: tuple, eu: float, ep: float) -> None:
        if eu >= self.threshold() - EPSILON and eu >= -EPSILON:
            items = tuple(sorted(self.item[r] for r in ranks))
            entry = (eu, len(items), items, ep)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            else:
                heapq.heappushpop(self.heap, entry)

    def _grown(self, ranks: tuple, rows: tuple):
        """Extensions that survive pruning, each offered as a result first."""
        for r in self.ranks:
            if r <= ranks[-1] or self.ptwu < self.threshold() - EPSILON:
                continue
            joined = self._join(rows, self.lists[r])
            if not len(joined[0]):
                continue
            eu, ep, pub = self._measure(joined)
            if ep < self.min_prob - EPSILON or pub < self.threshold() - EPSILON:
                continue
            self._offer((*ranks, r), eu, ep)
            yield pub, (*ranks, r), joined

    def depth_first(self) -> None:
        stack = [self._grown((self.prefix,), self.lists[self.prefix])]
        while stack:
            got = next(stack[-1], None)
            if got is None:
                stack.pop()
            else:
                stack.append(self._grown(got[1], got[2]))

    def best_first(self) -> None:
        count = 0
        queue = [(0.0, count, (self.prefix,), self.lists[self.prefix])]
        while queue:
            bound, _, ranks, rows = heapq.heappop(queue)
            if count and -bound < self.threshold() - EPSILON:
                continue
            for pub, grown, joined in self._grown(ranks, rows):
                count += 1
                heapq.heappush(queue, (-pub, count, grown, joined))


def prefix_search(spark, base: DataFrame, ranks: DataFrame, n: int, params: Params, by_levels: Callable) -> list:
    """The best itemsets, prefix by prefix; ``by_levels`` searches prefixes with too many rows."""
    ship(spark)
    singles = item_lists(base).select(F.array("item").alias("items"), "eu", "ep", "pub")
    best = topk.exact(topk.admitted(singles, params.min_prob), params.k).collect()
    theta = best[-1]["eu"] if len(best) >= params.k else 0.0
    # No extension of an item has more utility than its upper bounds.
    able = singles.where(F.col("pub") >= theta - EPSILON).select(F.get("items", F.lit(0)).alias("item"))
    # A prefix's rows are counted without the join: of each of its transactions, what follows it.
    behind = F.count("*").over(Window.partitionBy("tid").orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    sizes = base.select("rank", behind.alias("n")).groupBy("rank").agg(F.sum("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = ranks.where(F.col("ptwu") >= theta - EPSILON).join(small(able, n), "item", "left_semi").join(small(sizes, n), "rank")
    heads = cut(work_parts(known.select(F.col("rank").alias("prefix"), "ptwu", "n"), "prefix", "n", parts))
    wide = [r["prefix"] for r in heads.where(F.col("n") > ROWS).select("prefix").collect()]  # one number an item at most
    left = base.select(F.col("tid").alias("l_tid"), F.col("rank").alias("prefix")).join(small(heads.where(F.col("n") <= ROWS), n), "prefix")
    rows = left.join(base, (F.col("l_tid") == F.col("tid")) & (F.col("rank") >= F.col("prefix"))).select("part", "prefix", "ptwu", "tid", "item", "rank", "u", "p", "ru")
    k, min_prob, kind = params.k, params.min_prob, params.search

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's prefixes one after the other; what they find raises the threshold of those that follow."""
        heap: list[tuple] = []

        def done(held: list[pd.DataFrame]) -> None:
            group = pd.concat(held) if len(held) > 1 else held[0]
            task = _Search(group, int(group["prefix"].iloc[0]), float(group["ptwu"].iloc[0]), k, min_prob, theta, heap)
            (task.best_first if kind is Search.BEST_FIRST else task.depth_first)()

        held: list[pd.DataFrame] = []
        for batch in batches:
            for prefix, part in batch.groupby("prefix", sort=True):
                if held and held[0]["prefix"].iloc[0] != prefix:
                    done(held)
                    held = []
                held.append(part)
        if held:
            done(held)
        yield pd.DataFrame([(list(i), eu, ep) for eu, _, i, ep in heap], columns=["items", "eu", "ep"])

    found = rows.repartitionById(parts, "part").sortWithinPartitions("prefix").mapInPandas(search, "items array<int>, eu double, ep double")
    best = topk.merged(best, topk.collect(found, params.k, params.collector).collect(), params.k)
    if wide:
        start = first_level(base).where(F.col("first_rank").isin(wide))
        best, _ = by_levels(spark, base, ranks, n, params, start=start, held=best)
    return best
