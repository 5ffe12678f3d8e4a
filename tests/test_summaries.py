import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorform.operators import ordering, summaries


def data(spark, n=400, seed=2):
    """A third of the rows share one value; one group holds most rows."""
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["b", None]), 5.0 if rnd.random() < 0.33 else rnd.gauss(0, 10), rnd.choice([None, 1.0, 2.0])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, x double, k double")


def expected(values):
    return [float(np.quantile(values, p)) for p in (0.25, 0.5, 0.75)]


@pytest.mark.parametrize("way", ["brackets", "ranked", "fallback"])
def test_quantiles_are_exact(spark, monkeypatch, way):
    rows, df = data(spark)
    if way == "ranked":
        monkeypatch.setattr(summaries, "MAX_GROUPS", -1)
        monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 20)
    if way == "fallback":
        monkeypatch.setattr(summaries, "_from_brackets", lambda *a: None)
    plain = {r["column"]: r[1:] for r in summaries.quantiles(df, ["x", "k"]).collect()}
    assert list(plain["x"]) == pytest.approx(expected([x for _, x, _ in rows]))
    assert list(plain["k"]) == pytest.approx(expected([k for _, _, k in rows if k is not None]))
    grouped = {r["g"]: r[2:] for r in summaries.quantiles(df, ["x"], by=["g"]).collect()}
    for g in ("hot", "b", None):
        assert list(grouped[g]) == pytest.approx(expected([x for h, x, _ in rows if h == g]))


def test_brackets_decide_in_large_columns(spark):
    """More values than the sketch keeps apart."""
    df = spark.range(60_000).select((F.col("id") * F.col("id") % 1_000_003).cast("double").alias("x"))
    got = summaries.quantiles(df, ["x"]).first()
    assert list(got[1:]) == pytest.approx(expected(df.toPandas()["x"]))


def test_five_numbers_per_group(spark):
    rows, df = data(spark)
    got = {(r["g"], r["column"]): r for r in summaries.five_numbers(df, ["x", "k"], by=["g"]).collect()}
    ks = [k for g, _, k in rows if g is None and k is not None]
    r = got[None, "k"]
    assert (r["n"], r["min"], r["max"]) == (len(ks), min(ks), max(ks)) and r["mean"] == pytest.approx(np.mean(ks))


def test_row_index_over_many_ranges(spark):
    rnd = random.Random(4)
    rows = [(7 if rnd.random() < 0.4 else rnd.randrange(50) if rnd.random() < 0.9 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
    got = {(r["a"], r["b"]): r["idx"] for r in ordering.row_index(df, ["a", "b"], parts=9).collect()}
    order = sorted(rows, key=lambda t: (t[0] is not None, t))
    assert got == {k: i + 1 for i, k in enumerate(order)}
    assert got == {(r["a"], r["b"]): r["idx"] for r in ordering.row_index(df, ["a", "b"]).collect()}


def test_ranking_puts_missing_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "p string, m double")
    assert [r["p"] for r in ordering.ranked(df, "m", "p").collect()] == ["c", "a", "b"]


def test_crosstab_and_pivot(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 1)], "x string, y int")
    assert {tuple(r) for r in summaries.crosstab(df, "x", "y").collect()} == {("a", 1, 2), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1)}
    wide = {r["x"]: (r["1"], r["2"]) for r in summaries.value_counts_pivot(df, "x", "y").collect()}
    assert wide["a"] == (2, None) and wide["b"] == (None, 1)


def test_totals_ratio_of_sums(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 3, 4), ("b", 0, 0)], "k string, h int, ab int")
    got = {r["k"]: r["bavg"] for r in summaries.totals(df, ["k"], {"hit": "h", "AB": "ab"}, ("bavg", "hit", "AB")).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_histogram_keeps_every_row(spark):
    _, df = data(spark)
    cells = summaries.histogram_2d(df, "x", "k", bins=40)
    total = df.where("x is not null and k is not null").count()
    assert cells.agg(F.sum("n")).first()[0] == total
    assert summaries.marginals(cells).where("axis = 'x'").agg(F.sum("n")).first()[0] == total
