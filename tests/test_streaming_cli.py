import pytest

from orelode import cli
from orelode.operators import stats
from orelode.streaming import item_stats

OCC = "tid long, item int, qty int, prob double"


def test_stream_keeps_the_batch_statistics(spark, tmp_path):
    rows = [(t, i, 1 + (t + i) % 3, 0.1 + 0.8 * ((t * i) % 7) / 7) for t in range(12) for i in range(5) if (t + i) % 2]
    profit = spark.createDataFrame([(i, i - 1.5) for i in range(5)], "item int, profit double")
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[0] % 3 == n], OCC).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(OCC).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    item_stats.maintain(source, profit, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    form = lambda df: sorted((r.item, round(r.ptwu, 6), round(r.ep, 9), round(r.eu, 6), r.support) for r in df.collect())
    assert form(item_stats.current(spark, str(tmp_path / "out"))) == form(stats.item_stats(stats.with_profit(spark.createDataFrame(rows, OCC), profit)))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t").write_text("1:2:.8 2:1:.9\n1:3:.7 3:2:.6\n")
    (tmp_path / "p").write_text("1 10\n2 15\n3 5\n")
    run = lambda *a: cli.run(cli.parser().parse_args([str(tmp_path / "t"), str(tmp_path / "p"), *a]))
    assert run("1", "0.5") == 0
    assert "{1}  EU 37.0000  EP 0.940000" in capsys.readouterr().out
    assert run("2", "0.5", "--output", str(tmp_path / "out")) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert run("0", "0.5") == 1 and run("1", "0.5", "--search", "odd") == 1
    assert "error" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x"])
