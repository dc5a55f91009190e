"""Transactions as wholes: their items, quantities and probabilities, and the span of item ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(occ: DataFrame) -> DataFrame:
    """``tid, items, quantities, probabilities``: ascending item ids, and two maps by item. One occurrence an item and transaction."""
    rows = F.array_sort(F.collect_list(F.struct("item", "qty", "prob")))
    by = lambda name: F.map_from_arrays(F.col("rows")["item"], F.col("rows")[name])
    return occ.groupBy("tid").agg(rows.alias("rows")).select("tid", F.col("rows")["item"].alias("items"), by("qty").alias("quantities"), by("prob").alias("probabilities"))


def looked_up(found: DataFrame, item: int) -> DataFrame:
    """``tid, qty, prob`` of one item in all ``baskets``; 0 where a transaction lacks it."""
    value = lambda name, kind: F.coalesce(F.try_element_at(name, F.lit(item)), F.lit(0)).cast(kind)
    return found.select("tid", value("quantities", "int").alias("qty"), value("probabilities", "double").alias("prob"))


def item_span(occ: DataFrame) -> DataFrame:
    """One row: the largest item id (-1 for none), the size of an array by id, and the number of items."""
    return occ.agg(F.coalesce(F.max("item"), F.lit(-1)).alias("largest"), (F.coalesce(F.max("item"), F.lit(-1)) + 1).alias("dense"), F.countDistinct("item").alias("items"))
