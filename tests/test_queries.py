"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from orelode import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    return c


def test_both_lists_name_the_same():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", ["fx_occ_u2", "tok_roundtrip", "tok_reject", "item_stats", "item_stats_merge", "item_rank", "suffix_sum", "pair_metrics", "pair_prune_pub", "pair_prune_ptwu", "semi_survivors", "topk_sharded_local", "shard_counts", "profit_lookup", "tx_line_encode", "text_transactions", "text_profits", "baskets", "basket_lookup", "item_span", "pattern_text", "bench_intervals", "work_parts", "split_point", "mine_bfs_u2_k200_p01", "mine_dfs", "mine_topk_lazy", "bench_stats"])
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = got.fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_thresholds_part_the_pairs(spark):
    from orelode.operators import extend as ext

    pairs, ranks = catalog._pairs(spark, SF), catalog._ranks(spark, SF, "u1", 0.7)
    n = pairs.count()
    for kept in (catalog._over_mean(spark, SF), catalog._pruned_by_ptwu(spark, SF)):
        assert 0 < kept.count() < n
    assert ext.prune_ptwu(pairs, ranks, 0.0).count() == n
