"""Suffix ranks of a string that no task holds, by the difference cover {1, 2} modulo 3.

A string is a table of places and symbols. The triples at sampled places (not
divisible by 3) are sorted and named by their order; where names repeat, the
string of the names is ranked in the same way, one level down. The other
suffixes then have unique keys (a symbol and the rank of what follows), and one
global order of them with each half of the sampled ones merges all three.

Every global order is a sort by ranges: a task sees its range only, and the
driver nothing but counts. A string of ``LOCAL`` symbols is left to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Symbols of a string that one task sorts.
LOCAL = 1 << 20


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (numbers from 1) in order, by the same method within a task."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if s.max() >= 1 << 31:  # products of two symbols must fit 64 bits
        s = np.unique(s, return_inverse=True)[1] + 1
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    top = int(t.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with n % 3 == 1 an empty suffix parts the halves
    sample = np.concatenate([one, two])
    if top < 1 << 21:
        key = (t[sample] * top + t[sample + 1]) * top + t[np.minimum(sample + 2, n + 2)]
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, key[order][1:] != key[order][:-1])
    else:
        a, b, c = t[sample], t[sample + 1], t[np.minimum(sample + 2, n + 2)]
        order = np.lexsort((c, b, a))
        fresh = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (c[order][1:] != c[order][:-1]))
    names = np.cumsum(fresh)
    named = np.empty(len(sample), np.int64)
    named[order] = names
    if names[-1] < len(sample):
        order = suffix_array(named)
    sampled = sample[order]  # suffixes of the sample in order
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    wide = len(sample) + 2
    zero = np.arange(0, n, 3)
    by_one = t[zero] * wide + rank[zero + 1]
    zero = zero[np.argsort(by_one, kind="stable")]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key_one = lambda i: t[i] * wide + rank[i + 1]
    zero_one = key_one(zero)
    pair = np.unique(np.concatenate([t[zero] * top + t[zero + 1], t[twos] * top + t[twos + 1]]), return_inverse=True)[1]
    zero_two, twos_two = pair[: len(zero)] * wide + rank[zero + 2], pair[len(zero) :] * wide + rank[twos + 2]
    out = np.empty(n, np.int64)
    out[np.arange(len(zero)) + np.searchsorted(key_one(ones), zero_one) + np.searchsorted(twos_two, zero_two)] = zero
    place = np.empty(n + 3, np.int64)
    place[sampled] = np.arange(len(sampled))
    out[place[ones] + np.searchsorted(zero_one, key_one(ones))] = ones
    out[place[twos] + np.searchsorted(zero_two, twos_two)] = twos
    return out


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over all rows that stand before in the global ``order`` (without ties)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.withColumns({f"__{k}": c.cast("long") for k, c in sums.items()}).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__{k}_all") for k in sums))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("__part", *(F.coalesce(F.sum(f"__{k}_all").over(earlier), F.lit(0)).alias(f"__{k}_before") for k in sums))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "__part")
    return placed.select(*rows.columns, *((F.col(f"__{k}_before") + F.coalesce(F.sum(f"__{k}").over(within), F.lit(0))).alias(k) for k in sums))


def _ahead(symbols: DataFrame, steps: int, block: int = 1 << 16) -> DataFrame:
    """``i, c0, c1, ...``: each place with the symbols up to ``steps`` behind it, 0 beyond the end."""
    home = symbols.select("i", "c", F.floor(F.col("i") / block).alias("__block"), F.lit(0).alias("__guest"))
    guests = home.where((F.col("i") % block < steps) & (F.col("i") >= block)).withColumns({"__block": F.col("__block") - 1, "__guest": F.lit(1)})
    order = Window.partitionBy("__block").orderBy("i")
    found = home.unionByName(guests).select("i", "__guest", F.col("c").alias("c0"), *(F.coalesce(F.lead("c", k).over(order), F.lit(0).cast("long")).alias(f"c{k}") for k in range(1, steps + 1)))
    return found.where("__guest = 0").drop("__guest")


def _local(symbols: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            i, c = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(i)
            order = suffix_array(c[by])
            yield pa.RecordBatch.from_arrays([pa.array(i[by][order]), pa.array(np.arange(len(order)))], names=["i", "r"])

    return symbols.select("i", "c").coalesce(1).mapInArrow(run, "i long, r long")


def suffix_ranks(symbols: DataFrame, n: int) -> DataFrame:
    """``i, r``: the rank from 0 of the suffix that starts at each place; ``symbols (i, c)`` has the places 0 to n - 1 and symbols from 1."""
    if n <= max(3, LOCAL):
        return _local(symbols)
    empty = int(n % 3 == 1)  # an empty suffix parts the halves of the names
    n1, n2 = (n + 1) // 3 + empty, n // 3
    triples = written(_ahead(symbols, 2))
    sample = triples.where("i % 3 != 0")
    if empty:
        sample = sample.unionByName(symbols.sparkSession.range(1).select(F.lit(n).cast("long").alias("i"), *(F.lit(0).cast("long").alias(f"c{k}") for k in range(3))))
    keys = ["c0", "c1", "c2"]
    names = written(running(sample.select(*keys).distinct(), keys, name=F.lit(1)))
    named = sample.join(names, keys).select("i", (F.col("name") + 1).alias("name"))
    if names.count() == n1 + n2:
        ranked = written(named.withColumnRenamed("name", "r"))
    else:
        below = written(named.select(F.when(F.col("i") % 3 == 1, F.floor((F.col("i") - 1) / 3)).otherwise(n1 + F.floor((F.col("i") - 2) / 3)).alias("i"), F.col("name").alias("c")))
        up = F.when(F.col("i") < n1, 3 * F.col("i") + 1).otherwise(3 * (F.col("i") - n1) + 2)
        ranked = written(suffix_ranks(below, n1 + n2).select(up.alias("i"), (F.col("r") + 1).alias("r")))
    behind = lambda k: ranked.select((F.col("i") - k).alias("i"), F.col("r").alias(f"r{k}"))
    rows = triples.select("i", "c0", "c1")
    for k in range(3):
        rows = rows.join(behind(k), "i", "left").withColumn(f"r{k}", F.coalesce(f"r{k}", F.lit(0)))
    rows = written(rows)
    zero = F.col("i") % 3 == 0
    first = running(rows.where("i % 3 != 2").select("i", "c0", "r1", "r0"), ["c0", "r1"], zeros=F.when(zero, 1).otherwise(0), ones=F.when(zero, 0).otherwise(1))
    second = running(rows.where("i % 3 != 1").select("i", "c0", "c1", "r2", "r0"), ["c0", "c1", "r2"], zeros=F.when(zero, 1).otherwise(0), twos=F.when(zero, 0).otherwise(1))
    sampled = lambda df: df.where(~zero).select("i", (F.col("r0") - 1 - empty + F.col("zeros")).alias("r"))
    others = first.where(zero).select("i", "zeros", "ones").join(second.where(zero).select("i", "twos"), "i").select("i", (F.col("zeros") + F.col("ones") + F.col("twos")).alias("r"))
    return others.unionByName(sampled(first)).unionByName(sampled(second))
