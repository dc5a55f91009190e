"""The best k: by expected utility, then size, then ids, all descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_least, shard_of
from ..model import Collector, choice


def best_first() -> list[Column]:
    """The total order of results; ``items`` ascending within."""
    return [F.col("eu").desc(), F.size("items").desc(), F.col("items").desc()]


def admitted(found: DataFrame, min_prob: float, threshold: float = 0.0) -> DataFrame:
    """``items`` (ascending)``, eu, ep`` of itemsets that may be in the result: never one of negative utility."""
    return found.where(at_least(F.col("ep"), min_prob) & at_least(F.col("eu"), max(threshold, 0.0))).select(F.array_sort("items").alias("items"), "eu", "ep")


def exact(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(*best_first()).limit(k)


def per_shard(found: DataFrame, k: int, shards: int = 8) -> DataFrame:
    """The best k of each shard of itemsets, with ``shard`` and ``place``."""
    dealt = found.withColumn("shard", shard_of(F.col("items"), shards))
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(*best_first()))).where(F.col("place") <= k)


def sharded(found: DataFrame, k: int, shards: int = 8) -> DataFrame:
    """The best of the shards' bests, which is the same."""
    return exact(per_shard(found, k, shards).select("items", "eu", "ep"), k)


def upsert(found: DataFrame) -> DataFrame:
    """One row for each itemset, the one of highest utility."""
    return found.groupBy("items").agg(F.max("eu").alias("eu"), F.max_by("ep", "eu").alias("ep"))


def lazy(batch: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of a batch that may name an itemset more than once."""
    return exact(upsert(batch), k)


def collect(batch: DataFrame, k: int, collector: Collector | str) -> DataFrame:
    """What a batch can add to the best ``k``."""
    return {Collector.LAZY: lazy, Collector.SHARDED: sharded, Collector.BASELINE: exact}[choice(Collector, collector)](batch, k)


def merged(held: list, batch: list, k: int) -> list:
    """The best ``k`` rows of two lists of ``k`` at most, best first; an itemset met again counts once."""
    rows = {tuple(r["items"]): r for r in sorted([*batch, *held], key=lambda r: r["eu"])}
    return sorted(rows.values(), key=lambda r: (r["eu"], len(r["items"]), list(r["items"])), reverse=True)[:k]


def configured(spark: SparkSession) -> Collector:
    """The collector that the session names in ``spark.orelode.collector``, the plain one for none; an unknown name is a ``ValueError``."""
    return choice(Collector, spark.conf.get("spark.orelode.collector", None) or Collector.BASELINE)


def threshold(held: DataFrame, k: int) -> DataFrame:
    """One row: the weakest utility held, 0 until k are."""
    return held.agg(F.when(F.count("*") >= k, F.min("eu")).otherwise(0.0).alias("theta"))


def ranked(held: DataFrame) -> DataFrame:
    """``rank, items, size, eu, ep``; k rows at most."""
    return held.select(F.row_number().over(Window.orderBy(*best_first())).alias("rank"), "items", F.size("items").alias("size"), "eu", "ep")
