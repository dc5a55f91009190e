import pytest

from orelode.model import Collector, Join, Params, Search
from orelode.sources import text


def lines(spark, *rows):
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(rows)], "tid long, value string")


def test_bad_lines_and_tokens_are_left_out(spark):
    found = text.parse_transactions(lines(spark, "", "   ", "abc", "1:2 1:2:0.5:9 +7:1:.5 1:2:1.5 1:2:-0.1 1:2:NaN", "1:2:0", "1:2:1", "1:1:.5 1:9:.25", "99999999999:1:.5", "2:0:.5 3:-1:.5 -4:1:.5"))
    assert sorted(map(tuple, found.collect())) == [(5, 1, 2, 0.0), (6, 1, 2, 1.0), (7, 1, 9, 0.25)]


def test_lenient_reading_keeps_other_quantities(spark):
    found = text.parse_transactions(lines(spark, "2:0:.5 3:-1:.5"), strict=False)
    assert sorted((r.item, r.qty) for r in found.collect()) == [(2, 0), (3, -1)]


def test_profits(spark):
    found = text.parse_profits(spark.createDataFrame(list(enumerate(["1 5", "2:-3.5", " 3  7 extra", "x 1", "4", "1 6", "5 NaN"])), "at long, value string"))
    assert sorted(map(tuple, found.collect())) == [(1, 6.0), (2, -3.5), (3, 7.0)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1:2:.8 2:1:.9\n\n1:3:.7 3:2:.6\n")
    (tmp_path / "p.txt").write_text("1 10\n2 15\n3 5\n")
    occ, profit = text.load(spark, str(tmp_path / "t.txt"), str(tmp_path / "p.txt"))
    assert occ.count() == 4 and profit.count() == 3
    again = text.parse_transactions(text.encode_lines(occ))
    assert sorted(map(tuple, again.select("item", "qty", "prob").collect())) == sorted(map(tuple, occ.select("item", "qty", "prob").collect()))
    assert text.sizes(occ, profit).first().transactions == 2


def test_paths(spark):
    with pytest.raises(ValueError):
        text.load(spark, " ", "x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.load(spark, "/nowhere/at/all", "/nowhere/else")


@pytest.mark.parametrize("k, p", [(0, 0.5), (-1, 0.5), (1.5, 0.5), (True, 0.5), (1, -0.1), (1, 1.1), (1, float("nan"))])
def test_bad_parameters(k, p):
    with pytest.raises(ValueError):
        Params(k, p)


def test_names_of_choices():
    p = Params(1, 0, "Depth-First", "BINARY", "lazy")
    assert (p.search, p.join, p.collector) == (Search.DEPTH_FIRST, Join.BINARY, Collector.LAZY)
    with pytest.raises(ValueError):
        Params(1, 0, "sideways")
