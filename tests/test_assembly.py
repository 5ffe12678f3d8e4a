import pytest
from pyspark.sql import functions as F

from priorform.catalog import market
from priorform.functions import dates, rates
from priorform.operators.sides import attach_roles, pair_sides
from priorform.sources.tables import Tables


def values(spark, schema, rows, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_ratios_and_guards(spark):
    rows = [(1, 2), (1, 0), (1, None), (None, 2), (None, None), (0, 4)]
    schema = "n int, d int"
    assert values(spark, schema, rows, rates.guarded_ratio("n", "d")) == [0.5, 0.0, None, None, None, 0.0]
    assert values(spark, schema, rows, rates.null_rate("n", "d")) == [0.5, None, None, None, None, 0.0]
    assert values(spark, schema, rows, rates.win_rate("n", "d")) == [pytest.approx(1 / 3), 1.0, 0.0, 0.0, 0.0, 0.0]
    assert values(spark, schema, [(3, 3), (0, 0)], rates.whip(F.col("n"), F.lit(1), "d")) == [4.0, 0.0]


def test_clamp_and_label_pass_null_as_defined(spark):
    assert values(spark, "x int", [(-50,), (-150,), (None,)], rates.clamp_upper("x", -100)) == [-100, -150, None]
    assert values(spark, "x string", [("W",), ("w",), ("L",), (None,)], rates.binary_label("x")) == [1, 1, 0, 0]
    assert values(spark, "a int, b int", [(3, 1), (None, 1)], *[rates.differences([("a", "b", "d")])]) == [2, None]


def test_text_and_dates(spark):
    rows = [("Adam Zed flies out",), ("One",), (None,)]
    assert values(spark, "t string", rows, dates.first_words("t")) == ["Adam Zed", "One", None]
    assert values(spark, "d string", [("2011-04-05",)], dates.season_text(F.to_date("d"))) == ["2011"]
    assert values(spark, "x double", [(12345.678,)], dates.exponent_text("x")) == ["1.234568e+04"]


def test_pair_sides_is_the_right_join(spark):
    rows = [(1, 1, 10), (1, 0, 4), (2, 1, 7), (3, 0, 9), (4, None, 1), (None, 0, 3), (None, 1, 2), (5, 1, 6), (5, 0, 1), (5, 0, 2), (6, 1, 1), (6, 1, 2), (6, 0, 8)]
    df = spark.createDataFrame(rows, "g bigint, flag int, x int")
    got = pair_sides(df, "g", "flag", {"x": ("x_home", "x_away")})
    home, away = df.where("flag = 1"), df.where("flag = 0").withColumnsRenamed({"g": "g2", "x": "x2"})
    expected = home.join(away, F.col("g") == F.col("g2"), "right").select("g", "x", "x2")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    assert {(None, None, 9), (None, None, 3), (5, 6, 1), (5, 6, 2), (6, 1, 8), (6, 2, 8)} <= {tuple(r) for r in got.collect()}


def test_attach_roles_is_one_left_join_per_role(spark):
    base = spark.createDataFrame([(1, 10, 20), (2, 10, 30), (3, None, 99)], "g bigint, home bigint, away bigint")
    feats = spark.createDataFrame([(1, 10, 5), (1, 20, 6), (1, 77, 1), (2, 30, 7)], "g bigint, p bigint, f int")
    got = attach_roles(base, feats, "g", "p", {"h_": "home", "a_": "away"}, ["f"])
    assert {tuple(r) for r in got.collect()} == {(1, 10, 20, 5, 6), (2, 10, 30, None, 7), (3, None, 99, None, None)}


def test_lines_of_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """More lines make more partitions; the lines of an order stay together."""
    spark.range(900).selectExpr("id div 3 as l_orderkey", "id as l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    monkeypatch.setattr(market, "LINES_PER_TASK", 30, raising=False)
    moved = market.by_order(t, t.lineitem).withColumn("p", F.spark_partition_id())
    orders = moved.groupBy("l_orderkey").agg(F.count_distinct("p").alias("p"), F.count("*").alias("n")).collect()
    assert moved.rdd.getNumPartitions() == 30 and len(orders) == 300 and {(r["p"], r["n"]) for r in orders} == {(1, 3)}
