"""Uncertain transactions derived from the order lines of a test folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Items, and the probability of a line, of the dense (u1) and the sparse (u2) fixture.
SHAPES = {
    "u1": (25, "CASE WHEN l_discount = 0 THEN 1e0 ELSE 5e-1 + {h} / 9998e0 END"),
    "u2": (200, "CASE WHEN l_discount = 0 THEN 0e0 ELSE {h} / 250000e0 END"),
}
_HASH = "(CAST(round(l_extendedprice * 100) AS BIGINT) % 4999)"


def occ_sql(shape: str, lines: str = "lineitem") -> str:
    """The occurrences, in SQL that Spark and DuckDB both run; the last line of an item counts."""
    m, prob = SHAPES[shape]
    return f"""SELECT tid, item, qty, prob FROM (
  SELECT l_orderkey AS tid, CAST(l_partkey % {m} + 1 AS INT) AS item, CAST(l_quantity AS INT) AS qty, {prob.format(h=_HASH)} AS prob,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey % {m} ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
  FROM {lines}) z WHERE rn = 1"""


def profit_sql(shape: str, numbers: str) -> str:
    """Signed profits of items 1 to M; ``numbers`` is a table function with column ``i``."""
    return f"SELECT CAST(i AS INT) AS item, round((((i * 37) % 100) - 20) / 10e0, 2) AS profit FROM {numbers}"


def occ(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    return spark.sql(occ_sql(shape, "{lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def profit(spark: SparkSession, shape: str) -> DataFrame:
    return spark.sql(profit_sql(shape, f"(SELECT id AS i FROM range(1, {SHAPES[shape][0] + 1}))"))
