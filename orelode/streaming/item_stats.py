"""Item statistics kept up to date over a stream of transactions.

PTWU, the log complements, expected utility and support are plain sums, so a
micro-batch's sums can be added to those before it. A transaction must arrive
whole within a batch (its positive utility is shared by its items).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import existential, log_complement
from ..operators.stats import with_profit, with_ptu

SUMS = ("ptwu", "lc", "eu", "support")


def batch_sums(occ: DataFrame, profit: DataFrame) -> DataFrame:
    """``item`` and the sums of one batch of occurrences."""
    priced = with_ptu(with_profit(occ, profit))
    return priced.groupBy("item").agg(F.sum("ptu").alias("ptwu"), F.sum(log_complement(F.col("prob"))).alias("lc"), F.sum(F.col("profit") * F.col("qty") * F.col("prob")).alias("eu"), F.count("*").alias("support"))


def maintain(stream: DataFrame, profit: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes the sums of each batch under ``path`` by batch number, so a batch that runs again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch_sums(batch, profit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark, path: str) -> DataFrame:
    """``item, ptwu, ep, eu, support`` over all batches so far."""
    sums = spark.read.parquet(path).groupBy("item").agg(*(F.sum(c).alias(c) for c in SUMS))
    return sums.select("item", "ptwu", existential(F.col("lc")).alias("ep"), "eu", "support")
