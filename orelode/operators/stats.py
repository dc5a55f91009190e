"""Per-transaction and per-item statistics, and the order of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_least, existential, log_complement, utility

#: Rows of an item table that are broadcast at most; a larger one is shuffled.
BROADCAST = 1_000_000


def small(table: DataFrame, n: int | None = None) -> DataFrame:
    """The table with a broadcast hint where its counted rows allow it."""
    return F.broadcast(table) if (table.count() if n is None else n) <= BROADCAST else table


def with_profit(occ: DataFrame, profit: DataFrame, n: int | None = None) -> DataFrame:
    """Occurrences of items that have a profit, with it; ``n``: rows of ``profit`` if known."""
    return occ.join(small(profit, n), "item").select("tid", "item", "qty", "prob", "profit")


def profit_or_zero(occ: DataFrame, profit: DataFrame, n: int | None = None) -> DataFrame:
    """All occurrences, with 0 for the profit of an item that has none."""
    return occ.join(small(profit, n), "item", "left").select("tid", "item", "qty", "prob", F.coalesce("profit", F.lit(0.0)).alias("profit"))


def utilities(priced: DataFrame) -> DataFrame:
    return priced.withColumn("u", utility(F.col("profit"), F.col("qty")))


def gain() -> Column:
    """The utility of an occurrence with positive profit, else 0."""
    return F.when(F.col("profit") > 0, F.col("profit") * F.col("qty")).otherwise(0.0)


def ptu(priced: DataFrame) -> DataFrame:
    """``tid, ptu``: the positive utility of each transaction."""
    return priced.groupBy("tid").agg(F.sum(gain()).alias("ptu"))


def with_ptu(priced: DataFrame) -> DataFrame:
    """Each occurrence with its transaction's positive utility: a window, not a join."""
    return priced.withColumn("ptu", F.sum(gain()).over(Window.partitionBy("tid")))


def _sums() -> list[Column]:
    return [F.sum("ptu").alias("ptwu"), F.sum(log_complement(F.col("prob"))).alias("lc"), F.sum(F.col("profit") * F.col("qty") * F.col("prob")).alias("eu"), F.count("*").alias("support")]


def _finish(sums: DataFrame) -> DataFrame:
    return sums.select("item", "ptwu", existential(F.col("lc")).alias("ep"), "eu", "support")


def item_stats(priced: DataFrame) -> DataFrame:
    """``item, ptwu, ep, eu, support``: one window by transaction (unless ``priced`` has ``ptu`` already), one aggregation by item."""
    rows = priced if "ptu" in priced.columns else with_ptu(priced)
    return _finish(rows.groupBy("item").agg(*_sums()))


def item_stats_merged(priced: DataFrame, parts: int = 8) -> DataFrame:
    """The same from partial sums by part of the transactions, merged: what an item with most rows needs."""
    partial = with_ptu(priced).groupBy("item", F.pmod("tid", F.lit(parts)).alias("part")).agg(*_sums())
    return _finish(partial.groupBy("item").agg(*(F.sum(c).alias(c) for c in ("ptwu", "lc", "eu", "support"))))


def valid_items(stats: DataFrame, min_prob: float) -> DataFrame:
    """Items that can be in a result at all."""
    return stats.where(at_least(F.col("ep"), min_prob) & (F.col("ptwu") > 0))


def ranking(valid: DataFrame) -> DataFrame:
    """``item, rank, ptwu, ep``: from 0 by ascending PTWU, then id. One row an item: its window is as small as that table."""
    return valid.select("item", (F.row_number().over(Window.orderBy("ptwu", "item")) - 1).alias("rank"), "ptwu", "ep")


def first_rank_at(ranks: DataFrame, least: float) -> DataFrame:
    """One row: the first rank whose PTWU reaches ``least`` (null for none)."""
    return ranks.where(at_least(F.col("ptwu"), least)).agg(F.min("rank").alias("rank"))


def split_point(ranks: DataFrame) -> DataFrame:
    """One row: the first rank at which the running PTWU reaches half of the total."""
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return ranks.select("rank", F.sum("ptwu").over(run).alias("running"), F.sum("ptwu").over(whole).alias("total")).where("running >= total / 2").agg(F.min("rank").alias("rank"))


def work_parts(work: DataFrame, order: str, weight: str, parts: int) -> DataFrame:
    """``work`` with ``part``: ranges of ``order`` with about equal sums of ``weight``, from 0 to ``parts`` - 1. One row an item."""
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    middle = (F.sum(weight).over(run) - F.col(weight) / 2) / F.sum(weight).over(Window.partitionBy())
    return work.withColumn("part", F.least(F.lit(parts - 1), F.floor(middle * parts)).cast("int"))


def integrity(occ: DataFrame) -> DataFrame:
    """One row with the counts of occurrences that break a rule of the model."""
    bad = {"quantity": F.col("qty") <= 0, "probability": ~((F.col("prob") > 0) & (F.col("prob") <= 1)) | F.isnan("prob"), "item": F.col("item") < 0}
    return occ.agg(*(F.count_if(c).alias(f"bad_{name}") for name, c in bad.items()))
