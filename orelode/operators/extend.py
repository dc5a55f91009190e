"""From itemsets of one size to those of the next: join, measure, prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_least
from ..model import Join, choice
from .entries import measures
from .stats import BROADCAST, small


def extend(level: DataFrame, entries: DataFrame, join: Join | str = Join.TWO_POINTER, n: int | None = None) -> DataFrame:
    """Rows of all one-item extensions by higher ranks, in the transactions that have both.

    The hint picks the physical join; the rows are the same for all three. The
    entries grow with the data: where they have more than ``BROADCAST`` rows
    (``n`` if known, else they are counted) they are hashed, not broadcast.
    """
    join = choice(Join, join)
    if join is Join.BINARY and (entries.count() if n is None else n) > BROADCAST:
        join = Join.EXPONENTIAL
    right = entries.select(F.col("tid").alias("r_tid"), F.col("item").alias("r_item"), F.col("rank").alias("r_rank"), F.col("u").alias("r_u"), F.col("p").alias("r_p"), F.col("ru").alias("r_ru"))
    met = level.join(right.hint(join.value), (F.col("tid") == F.col("r_tid")) & (F.col("r_rank") > F.col("last_rank")))
    return met.select(
        F.concat("items", F.array("r_item")).alias("items"),
        F.col("r_rank").alias("last_rank"),
        "first_rank",
        "tid",
        (F.col("u") + F.col("r_u")).alias("u"),
        (F.col("p") * F.col("r_p")).alias("p"),
        F.least("ru", "r_ru").alias("ru"),
    )


def measured(level: DataFrame) -> DataFrame:
    """``items, last_rank, first_rank`` and the measures of each itemset, combined before the shuffle."""
    return level.groupBy("items", "last_rank", "first_rank").agg(*measures())


def prune_ep(found: DataFrame, min_prob: float) -> DataFrame:
    return found.where(at_least(F.col("ep"), min_prob))


def prune_pub(found: DataFrame, threshold: float) -> DataFrame:
    return found.where(at_least(F.col("pub"), threshold))


def prune_ptwu(found: DataFrame, ranks: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """The PTWU of an itemset is that of its lowest-ranked item."""
    heads = ranks.where(at_least(F.col("ptwu"), threshold)).select(F.col("rank").alias("first_rank"))
    return found.join(small(heads, n), "first_rank", "left_semi")


def surviving(level: DataFrame, survivors: DataFrame, n: int | None = None) -> DataFrame:
    """The rows of the surviving itemsets; with ``n`` survivors few enough, without a shuffle of the rows."""
    return level.join(small(survivors.select("items"), n), "items", "left_semi")
