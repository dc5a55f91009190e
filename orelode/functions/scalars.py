"""Scalar expressions of the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EPSILON, LOG_ZERO

#: Of the polynomial that deals itemsets to shards.
SHARD_BASE, SHARD_PRIME = 31, 1_000_003


def log_complement(p: Column) -> Column:
    """ln(1 - p), 0 for p <= 0 and the floor for p >= 1, where the logarithm itself would be null."""
    safe = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))
    return F.when(p <= 0, 0.0).when(p >= 1, LOG_ZERO).when(p < 0.5, F.log1p(-safe)).otherwise(F.log(1 - safe))


def certain_log_complement(p: Column) -> Column:
    """``log_complement`` where a probability within EPSILON of 1 counts as 1."""
    return F.when(p > 1 - EPSILON, LOG_ZERO).otherwise(log_complement(p))


def existential(log_sum: Column) -> Column:
    """1 - exp of a sum of log complements."""
    return 1 - F.exp(F.greatest(log_sum, F.lit(LOG_ZERO)))


def utility(profit: Column, qty: Column) -> Column:
    return profit * qty


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def at_least(x: Column, least: float) -> Column:
    """x >= least within the tolerance."""
    return x >= least - EPSILON


def itemset_text(items: Column) -> Column:
    """``{1, 2, 3}`` by ascending id."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(items).cast("array<string>"), ", "), F.lit("}"))


def itemset_key(items: Column) -> Column:
    """``1,2,3`` by ascending id."""
    return F.array_join(F.array_sort(items).cast("array<string>"), ",")


def shard_of(items: Column, shards: int) -> Column:
    """A shard from 0 to shards - 1, the same for every order of the items: a polynomial of the ascending ids."""
    value = F.aggregate(F.array_sort(items), F.lit(0).cast("long"), lambda a, x: F.pmod(a * SHARD_BASE + x, F.lit(SHARD_PRIME)))
    return F.pmod(value, F.lit(shards)).cast("int")


def pattern_text(items: Column, eu: Column, ep: Column) -> Column:
    return F.format_string("Pattern{items=%s, EU=%.4f, EP=%.6f}", itemset_text(items), eu, ep)


def transaction_text(tid: Column, items: Column) -> Column:
    return F.format_string("Transaction{id=%d, items=%d}", tid, items)
