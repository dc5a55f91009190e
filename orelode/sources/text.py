"""Transactions and profits in text form.

A transaction is a line of ``item:qty:prob`` tokens, a profit a line of ``item
profit`` (a colon serves as well). Everything is parsed by column expressions;
lines and tokens that don't parse are left out, as is a quantity of 0 or less
unless ``strict`` is off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE = r"^-?[0-9]+$"
_SPACE = r"[\s]+"


def tokens(lines: DataFrame, line: str = "value", tid: str = "tid") -> DataFrame:
    """``tid, at, token`` of ``lines``; blank lines have none."""
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    return lines.where(text != "").select(tid, F.posexplode(F.split(text, _SPACE)).alias("at", "token"))


def _whole(x: Column) -> Column:
    """An optional minus sign and digits, within 32 bits; else null."""
    return F.when(x.rlike(_WHOLE), x.try_cast("int"))


def parse_tokens(found: DataFrame) -> DataFrame:
    """``tid, at, item, qty, prob`` of the tokens with three good fields and a probability from 0 to 1."""
    parts = F.split("token", ":", -1)
    rows = found.where(F.size(parts) == 3).select("tid", "at", _whole(F.get(parts, F.lit(0))).alias("item"), _whole(F.get(parts, F.lit(1))).alias("qty"), F.get(parts, F.lit(2)).try_cast("double").alias("prob"))
    return rows.where("item is not null and qty is not null and prob is not null and not isnan(prob) and prob between 0 and 1")


def last_of_each(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of highest ``at`` for each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc()))).where("__n = 1").drop("__n")


def parse_transactions(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``tid, item, qty, prob`` of ``lines (tid, value)``; an item met twice on a line has its last token."""
    rows = last_of_each(parse_tokens(tokens(lines)), ["tid", "item"], "at").select(F.col("tid").cast("long").alias("tid"), "item", "qty", "prob")
    return rows.where("qty > 0 and item >= 0") if strict else rows


def read_transactions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Occurrences of a text file or folder. A transaction's id is unique, and rises with its place in the file."""
    return parse_transactions(spark.read.text(path).withColumn("tid", F.monotonically_increasing_id()), strict)


def parse_profits(lines: DataFrame) -> DataFrame:
    """``item, profit`` of ``lines (at, value)``; further fields are ignored, the last line of an item counts."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"[:\s]+", -1)
    rows = lines.where(F.size(parts) >= 2).select("at", _whole(F.get(parts, F.lit(0))).alias("item"), F.get(parts, F.lit(1)).try_cast("double").alias("profit"))
    return last_of_each(rows.where("item is not null and profit is not null and not isnan(profit)"), ["item"], "at").select("item", "profit")


def read_profits(spark: SparkSession, path: str) -> DataFrame:
    return parse_profits(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()))


def load(spark: SparkSession, transactions: str, profits: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both inputs; an empty path is a ``ValueError``, a missing one Spark's own error."""
    for path in (transactions, profits):
        if not path or not path.strip():
            raise ValueError("a path is empty")
    return read_transactions(spark, transactions, strict), read_profits(spark, profits)


def encode_lines(occ: DataFrame) -> DataFrame:
    """``tid, value``: a text line for each transaction, tokens by item."""
    token = F.concat_ws(":", "item", "qty", "prob")
    return occ.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", token.alias("t")))), lambda x: x["t"]), " ").alias("value"))


def sizes(occ: DataFrame, profit: DataFrame) -> DataFrame:
    """One row: transactions, occurrences, items, profits."""
    return occ.agg(F.countDistinct("tid").alias("transactions"), F.count("*").alias("occurrences"), F.countDistinct("item").alias("items")).crossJoin(F.broadcast(profit.agg(F.count("*").alias("profits"))))


def result_table(patterns: DataFrame) -> DataFrame:
    """``rank, itemset, eu, ep`` as text columns of fixed decimals."""
    from ..functions.scalars import itemset_text

    return patterns.select("rank", itemset_text(F.col("items")).alias("itemset"), F.format_string("%.4f", "eu").alias("eu"), F.format_string("%.6f", "ep").alias("ep"))


def write_results(patterns: DataFrame, path: str, form: str = "csv") -> None:
    """The ranked table as one file (k rows at most) of the given format."""
    out = result_table(patterns).coalesce(1).sortWithinPartitions("rank").write.mode("overwrite")
    out.option("header", True).csv(path) if form == "csv" else out.format(form).save(path)
