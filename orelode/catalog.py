"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions.lineage import shared_folder
from .functions.scalars import itemset_key, log_complement, pattern_text, transaction_text
from .model import Join
from .operators import extend as ext
from .operators import stats, topk, transactions
from .operators.entries import entries, first_level, item_lists
from .plans.mine import mine
from .sources import fixtures, text


def _occ(spark: SparkSession, d: str, shape: str) -> DataFrame:
    return fixtures.occ(spark, d, shape)


def _priced(spark: SparkSession, d: str, shape: str) -> DataFrame:
    return stats.with_profit(_occ(spark, d, shape), fixtures.profit(spark, shape), fixtures.SHAPES[shape][0])


def _ranks(spark: SparkSession, d: str, shape: str, p: float) -> DataFrame:
    return stats.ranking(stats.valid_items(stats.item_stats(_priced(spark, d, shape)), p))


def _entries(spark: SparkSession, d: str, shape: str, p: float) -> DataFrame:
    return entries(_priced(spark, d, shape), _ranks(spark, d, shape, p), fixtures.SHAPES[shape][0])


def _level(spark: SparkSession, d: str, shape: str, p: float, n: int, join: Join | str = "two_pointer") -> DataFrame:
    base = _entries(spark, d, shape, p)
    rows = first_level(base)
    for _ in range(n - 1):
        rows = ext.extend(rows, base, join)
    return rows


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _shown(found: DataFrame) -> DataFrame:
    return found.select(itemset_key(F.col("items")).alias("items"), "support", (F.round("eu", 4) + F.lit(0.0)).alias("eu"), F.round("ep", 6).alias("ep"), (F.round("pub", 4) + F.lit(0.0)).alias("pub"))


def _stats_shown(found: DataFrame) -> DataFrame:
    return found.select(F.col("item").cast("long").alias("item"), F.round("ptwu", 2).alias("ptwu"), F.round("ep", 6).alias("ep"), F.round("eu", 4).alias("eu"), "support")


def _pairs(spark: SparkSession, d: str, shape: str = "u1", p: float = 0.7) -> DataFrame:
    return ext.measured(_level(spark, d, shape, p, 2))


def _best_items(spark: SparkSession, d: str, k: int) -> DataFrame:
    found = item_lists(_entries(spark, d, "u1", 0.7)).withColumn("items", F.array("item"))
    return topk.exact(topk.admitted(found, 0.7), k)


def _mined(name: str) -> Callable[[SparkSession, str], DataFrame]:
    search, join, collector, shape, k, p = oracle.MINED[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        found = mine(_occ(spark, d, shape), fixtures.profit(spark, shape), k, p, search, join, collector)
        return _long(found, "rank", "size").withColumns({"items": itemset_key(F.col("items")), "eu": F.round("eu", 4) + F.lit(0.0), "ep": F.round("ep", 6)})

    return query


def _literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _patterns(spark: SparkSession) -> DataFrame:
    return _literal(spark, oracle.PATTERNS, "t string, eu double").select("t", F.split("t", ",").cast("array<int>").alias("items"), "eu")


def _runs(spark: SparkSession) -> DataFrame:
    return _literal(spark, [(c, float(t)) for c, ts in oracle.RUNS for t in ts], "config string, ms double")


def run_statistics(runs: DataFrame) -> DataFrame:
    """Statistics of run times by configuration."""
    return runs.groupBy("config").agg(
        F.round(F.avg("ms"), 6).alias("mean"),
        F.round(F.median("ms"), 6).alias("median"),
        F.round(F.stddev_pop("ms"), 6).alias("deviation"),
        F.min("ms").alias("fastest"),
        F.max("ms").alias("slowest"),
        F.round(F.stddev_pop("ms") / F.avg("ms") * 100, 6).alias("variation"),
    )


def _prob(df: DataFrame) -> DataFrame:
    return _long(df, "item", "qty").withColumn("prob", F.round("prob", 9))


def _violations(x: DataFrame, y: DataFrame, worse) -> DataFrame:
    return x.alias("x").join(stats.small(y, 1000).alias("y"), "first_rank").agg(F.count_if(worse).alias("violations"))


def _singles(spark: SparkSession, d: str, shape: str, p: float) -> DataFrame:
    return ext.measured(_level(spark, d, shape, p, 1)).select("first_rank", "pub", "ep")


def _sharded(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The best ``k`` pairs of each of four shards."""
    found = _pairs(spark, d).select(F.array_sort("items").alias("items"), "eu", "ep")
    return _long(topk.per_shard(found, k, 4), "shard", "place")


def _mean(found: DataFrame, name: str) -> float:
    """A threshold that parts the rows at every scale."""
    return found.agg(F.avg(name)).first()[0] or 0.0


def _over_mean(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return ext.prune_pub(pairs, _mean(pairs, "pub"))


def _pruned_by_ptwu(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d, "u1", 0.7)
    return ext.prune_ptwu(_pairs(spark, d), ranks, _mean(ranks, "ptwu"))


def _text_file(spark: SparkSession, lines: DataFrame) -> str:
    """The lines as a text file of the shared folder."""
    path = f"{shared_folder(spark)}/orelode-{uuid.uuid4().hex}"
    lines.select("value").write.text(path)
    return path


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dense fixture by way of text files, with lines that don't count."""
    noise = lambda *rows: _literal(spark, [(x,) for x in ("", "   ", "abc", *rows)], "value string")
    lines = text.encode_lines(_occ(spark, d, "u1")).select("value").unionByName(noise("1:2", "+7:1:.5 1:2:1.5 1:2:NaN"))
    prices = fixtures.profit(spark, "u1").select(F.concat_ws(" ", "item", "profit").alias("value")).unionByName(noise("1", "x 2", "+3 4", "5 NaN"))
    return text.load(spark, _text_file(spark, lines), _text_file(spark, prices))


def intervals(runs: DataFrame) -> DataFrame:
    """Mean run time of each configuration and its 95 % interval by Student's t, for 2 to 10 runs (null for others)."""
    wide = F.get(F.array(*map(F.lit, oracle.STUDENT)), (F.col("n") - 2).cast("int")) * F.col("s") / F.sqrt("n")
    found = runs.groupBy("config").agg(F.count("*").alias("n"), F.avg("ms").alias("m"), F.stddev_samp("ms").alias("s"))
    return found.select("config", F.round("m", 6).alias("mean"), F.round(F.col("m") - wide, 6).alias("low"), F.round(F.col("m") + wide, 6).alias("high"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "fx_occ_u1": lambda s, d: _prob(_occ(s, d, "u1")),
    "fx_occ_u2": lambda s, d: _prob(_occ(s, d, "u2")),
    "fx_profit": lambda s, d: _long(fixtures.profit(s, "u2"), "item"),
    "db_sizes": lambda s, d: text.sizes(_occ(s, d, "u1"), fixtures.profit(s, "u1")),
    "tok_roundtrip": lambda s, d: _prob(text.parse_transactions(text.encode_lines(_occ(s, d, "u1")))),
    "tok_reject": lambda s, d: _long(text.parse_tokens(_literal(s, [(1, i, t) for i, t in enumerate(oracle.TOKENS)], "tid long, at int, token string")).select("item", "qty", "prob"), "item", "qty"),
    "tx_line_encode": lambda s, d: text.encode_lines(_occ(s, d, "u1")).select("tid", F.regexp_replace("value", r"(:[^: ]+)(?= |$)", "").alias("line")),
    "profit_join": lambda s, d: _prob(_priced(s, d, "u2")),
    "profit_lookup": lambda s, d: _long(stats.profit_or_zero(_occ(s, d, "u2"), fixtures.profit(s, "u1")).groupBy("item", "profit").agg(F.count("*").alias("n")), "item"),
    "utility_rows": lambda s, d: stats.utilities(_priced(s, d, "u2")).select("tid", F.col("item").cast("long").alias("item"), (F.round("u", 2) + F.lit(0.0)).alias("u")),
    "ptu_by_tx": lambda s, d: stats.ptu(_priced(s, d, "u2")).withColumn("ptu", F.round("ptu", 2)),
    "ptu_broadcast": lambda s, d: stats.with_ptu(_priced(s, d, "u2")).select("tid", F.col("item").cast("long").alias("item"), F.round("ptu", 2).alias("ptu")),
    "ptwu_by_item": lambda s, d: _stats_shown(stats.item_stats(_priced(s, d, "u2"))).select("item", "ptwu"),
    "log_complement": lambda s, d: _literal(s, oracle.EDGES, "prob double").select("prob", (F.round(log_complement(F.col("prob")), 9) + F.lit(0.0)).alias("lc")),
    "ep_by_item": lambda s, d: _stats_shown(stats.item_stats(_priced(s, d, "u2"))).select("item", "ep"),
    "item_stats": lambda s, d: _stats_shown(stats.item_stats(_priced(s, d, "u2"))),
    "item_stats_merge": lambda s, d: _stats_shown(stats.item_stats_merged(_priced(s, d, "u2"))),
    "valid_items": lambda s, d: _stats_shown(stats.valid_items(stats.item_stats(_priced(s, d, "u2")), 0.94)),
    "item_rank": lambda s, d: _long(_ranks(s, d, "u2", 0.0).select("item", "rank"), "item", "rank"),
    "first_rank": lambda s, d: _long(stats.first_rank_at(_ranks(s, d, "u2", 0.0), 2e6), "rank"),
    "suffix_sum": lambda s, d: _entries(s, d, "u1", 0.7).select("tid", F.col("item").cast("long").alias("item"), (F.round("ru", 2) + F.lit(0.0)).alias("ru")),
    "entries": lambda s, d: _long(_entries(s, d, "u2", 0.0), "item", "rank").withColumns({"u": F.round("u", 2) + F.lit(0.0), "p": F.round("p", 9), "ru": F.round("ru", 2) + F.lit(0.0)}),
    "entries_by_item": lambda s, d: _long(_entries(s, d, "u2", 0.0).groupBy("item").agg(F.count("*").alias("n"), F.min("tid").alias("first_tid"), F.max("tid").alias("last_tid")), "item"),
    "item_lists": lambda s, d: _shown(item_lists(_entries(s, d, "u2", 0.0)).withColumn("items", F.array("item"))),
    "support_count": lambda s, d: _shown(_pairs(s, d, "u2", 0.0)).select("items", "support"),
    "topk_items": lambda s, d: _best_items(s, d, 10).select(itemset_key(F.col("items")).alias("items"), F.round("eu", 4).alias("eu"), F.round("ep", 6).alias("ep")),
    "theta0": lambda s, d: topk.threshold(_best_items(s, d, 10), 10).withColumn("theta", F.round("theta", 4)),
    "theta0_short": lambda s, d: topk.threshold(_best_items(s, d, 50), 50).withColumn("theta", F.round("theta", 4)),
    **{
        f"join_pairs_{name}": (lambda join: lambda s, d: _level(s, d, "u1", 0.7, 2, join).select(itemset_key(F.col("items")).alias("items"), "tid", (F.round("u", 2) + F.lit(0.0)).alias("u"), F.round("p", 6).alias("p"), (F.round("ru", 2) + F.lit(0.0)).alias("ru")))(join)
        for name, join in (("merge", Join.TWO_POINTER), ("hash", Join.EXPONENTIAL), ("broadcast", Join.BINARY))
    },
    "pair_metrics": lambda s, d: _shown(_pairs(s, d)),
    "triple_metrics": lambda s, d: _shown(ext.measured(_level(s, d, "u1", 0.7, 3))),
    "pair_prune_ep": lambda s, d: _shown(ext.prune_ep(_pairs(s, d, "u2", 0.0), 1e-3)),
    "pair_prune_pub": lambda s, d: _shown(_over_mean(s, d)),
    "pair_prune_ptwu": lambda s, d: _shown(_pruned_by_ptwu(s, d)),
    "semi_survivors": lambda s, d: ext.surviving(_level(s, d, "u1", 0.7, 2), _over_mean(s, d)).groupBy(itemset_key(F.col("items")).alias("items")).agg(F.count("*").alias("n")),
    **{name: _mined(name) for name in oracle.MINED},
    "result_table": lambda s, d: _long(text.result_table(mine(_occ(s, d, "u1"), fixtures.profit(s, "u1"), 10, 0.7)), "rank").withColumns({"eu": F.format_string("%.2f", F.col("eu").cast("double")), "ep": F.format_string("%.4f", F.col("ep").cast("double"))}),
    "topk_sharded_local": lambda s, d: _sharded(s, d, 5).select("shard", itemset_key(F.col("items")).alias("items"), F.round("eu", 4).alias("eu"), "place"),
    "shard_counts": lambda s, d: _sharded(s, d, 1 << 30).groupBy("shard").agg(F.count("*").alias("n"), F.round(F.min("eu"), 4).alias("weakest")),
    "work_parts": lambda s, d: stats.work_parts(_ranks(s, d, "u2", 0.0), "rank", "ptwu", 8).select(F.col("item").cast("long").alias("item"), F.col("part").cast("long").alias("part")),
    "split_point": lambda s, d: _long(stats.split_point(_ranks(s, d, "u1", 0.7)), "rank"),
    "pattern_order": lambda s, d: _long(topk.ranked(_patterns(s).withColumn("ep", F.lit(1.0))), "rank").select("rank", itemset_key(F.col("items")).alias("items"), "eu"),
    "upsert_dedupe": lambda s, d: topk.upsert(_patterns(s).select(F.array(F.length("t")).alias("items"), "eu", (F.col("eu") / 10).alias("ep"))).withColumn("items", itemset_key(F.col("items"))),
    "itemset_union": lambda s, d: _level(s, d, "u1", 0.7, 2).groupBy(itemset_key(F.col("items")).alias("items")).agg(F.count("*").alias("n")),
    "tid_intersection": lambda s, d: _level(s, d, "u1", 0.7, 2).groupBy(F.array_min("items").alias("a"), F.array_max("items").alias("b")).agg(F.count("*").alias("n")),
    "integrity": lambda s, d: stats.integrity(_occ(s, d, "u2")),
    "bound_ptwu": lambda s, d: _violations(_pairs(s, d), _ranks(s, d, "u1", 0.7).select(F.col("rank").alias("first_rank"), "ptwu"), F.expr("x.eu > y.ptwu + 1e-6")),
    "bound_pub": lambda s, d: _violations(_pairs(s, d), _singles(s, d, "u1", 0.7), F.expr("x.eu > y.pub + 1e-6")),
    "ep_antimonotone": lambda s, d: _violations(_pairs(s, d, "u2", 0.0), _singles(s, d, "u2", 0.0), F.expr("x.ep > y.ep + 1e-9")),
    "text_transactions": lambda s, d: _prob(_scanned(s, d)[0].select("item", "qty", "prob")),
    "text_profits": lambda s, d: _long(_scanned(s, d)[1], "item"),
    "baskets": lambda s, d: transactions.baskets(_occ(s, d, "u1")).select(transaction_text(F.col("tid"), F.size("items")).alias("shown"), itemset_key(F.col("items")).alias("items"), F.aggregate(F.map_values("quantities"), F.lit(0), lambda a, x: a + x).cast("long").alias("qty")),
    "basket_lookup": lambda s, d: _long(transactions.looked_up(transactions.baskets(_occ(s, d, "u1")), 7), "qty").withColumn("prob", F.round("prob", 9)),
    "item_span": lambda s, d: _long(transactions.item_span(_occ(s, d, "u2")), "largest", "dense"),
    "pattern_text": lambda s, d: _literal(s, oracle.PATTERNS, "t string, eu double").select(pattern_text(F.split("t", ",").cast("array<int>"), F.col("eu"), F.lit(0.5)).alias("shown")),
    "bench_intervals": lambda s, d: intervals(_runs(s)),
    "bench_stats": lambda s, d: run_statistics(_runs(s)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
