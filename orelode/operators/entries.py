"""Entries: the ranked occurrences with what their transaction still offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import certain_log_complement, existential, positive
from .stats import small


def entries(priced: DataFrame, ranks: DataFrame, n: int | None = None) -> DataFrame:
    """``tid, item, rank, u, p, ru`` of ranked occurrences with a probability over 0.

    ``ru`` is the positive utility of the transaction's entries of higher rank:
    a window by transaction, whose partitioning the joins by transaction use.
    """
    rows = priced.join(small(ranks.select("item", "rank"), n), "item").where("prob > 0").withColumn("u", F.col("profit") * F.col("qty"))
    after = Window.partitionBy("tid").orderBy("rank").rowsBetween(1, Window.unboundedFollowing)
    return rows.select("tid", "item", "rank", "u", F.col("prob").alias("p"), F.coalesce(F.sum(F.when(F.col("profit") > 0, F.col("u")).otherwise(0.0)).over(after), F.lit(0.0)).alias("ru"))


def measures() -> list:
    """Aggregates of an itemset's rows ``u, p, ru``: support, expected utility, existential probability, upper bound."""
    return [
        F.count("*").alias("support"),
        F.sum(F.col("u") * F.col("p")).alias("eu"),
        existential(F.sum(certain_log_complement(F.col("p")))).alias("ep"),
        F.sum(F.col("p") * positive(F.col("u") + F.col("ru"))).alias("pub"),
    ]


def first_level(found: DataFrame) -> DataFrame:
    """Entries as rows of itemsets of one item."""
    return found.select(F.array("item").alias("items"), F.col("rank").alias("last_rank"), F.col("rank").alias("first_rank"), "tid", "u", "p", "ru")


def item_lists(found: DataFrame) -> DataFrame:
    """Measures of each single item."""
    return found.groupBy("item").agg(*measures())
