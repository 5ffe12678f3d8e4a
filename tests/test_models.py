import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from priorform.operators import forest, models
from priorform.operators.lsh import lsh_nearest
from priorform.operators.neighbours import _asked, _dealt, class_shares, nearest, routes, vote


def points(spark, n=120, dims=3, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [float(rnd.randrange(4)) for _ in range(dims)], rnd.choice("abc")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, features array<double>, label string")


def brute(rows, tests, k):
    out = set()
    for q in tests:
        best = sorted((float(np.linalg.norm(np.subtract(q[1], r[1]))), r[0]) for r in rows)[:k]
        out |= {(q[0], t, i + 1) for i, (_, t) in enumerate(best)}
    return out


@pytest.mark.parametrize("block_rows", [10**6, 4])
def test_nearest_with_many_ties(spark, block_rows):
    """Whole and split cells agree with the sorted list; grid points tie a lot."""
    rows, df = points(spark)
    test = df.where(F.col("id") % 10 == 0)
    got = nearest(df, test, 5, block_rows=block_rows).select("test_id", "train_id", "rank")
    assert {tuple(r) for r in got.collect()} == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_a_row_visits_few_cells(spark):
    """In clustered data the triangle inequality leaves a small part of all candidates, and loses none."""
    rnd = random.Random(6)
    rows = [(i, [50.0 * (i % 12) + rnd.gauss(0, 1), rnd.gauss(0, 1)], "a") for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label string")
    test = df.where("id % 40 = 0")
    dealt, cells = _dealt(df, 3)
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    candidates = sum(sizes[r["cell"]] for r in routes(test.select("id", "features"), cells, 3).collect())
    assert candidates < 0.2 * 1200 * 30
    got = {tuple(r) for r in nearest(df, test, 3).select("test_id", "train_id", "rank").collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 40 == 0], 3)


def test_a_row_is_sent_once_per_shelf(spark):
    """In noise no cell is ruled out; a test row still goes to few shelves, of bounded size, and finds its neighbours."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 16)], "a") for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label string")
    test = df.where("id % 30 = 0").select("id", "features")
    _, cells = _dealt(df, 3)
    first, parts = cells.shelves(300)
    assert int(cells.rows.sum()) == 900 and (first + parts).max() <= 8
    sent = sum(len(r["shelves"]) for r in _asked(test, cells, 3, first, parts, False).collect())
    assert sent <= 30 * (first + parts).max() < routes(test, cells, 3).count() / 2
    got = {tuple(r) for r in nearest(df, test, 3, block_rows=300).select("test_id", "train_id", "rank").collect()}
    assert got == brute(rows, rows[::30], 3)


def test_crowded_cells_have_several_shelves(spark):
    """Copies of one point and far single points: a crowded cell is parted, and ties go to the lowest ids."""
    rows = [(i, [0.0, 0.0], "a") for i in range(60)] + [(100 + i, [9.0 * i + 9, 1.0], "b") for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label string")
    test = df.where("id in (7, 59, 103)")
    got = {tuple(r) for r in nearest(df, test, 4, block_rows=8).select("test_id", "train_id", "rank").collect()}
    assert got == brute(rows, [r for r in rows if r[0] in (7, 59, 103)], 4)


def test_fewer_train_rows_than_k_and_no_test_rows(spark):
    rows, df = points(spark, n=3)
    assert nearest(df, df, 5).count() == 9
    assert nearest(df, df.where("id < 0"), 5).count() == 0


def test_votes_break_ties_by_label(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, "c")], "test_id bigint, label string")
    assert tuple(vote(df).first()) == (1, "a", 2, 0.4)
    assert {tuple(r) for r in class_shares(df).collect()} == {(1, "a", 0.4), (1, "b", 0.4), (1, "c", 0.2)}


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "x double, c double")
    scaled = models.standard_scale(df, ["x", "c"]).apply(df)
    assert [tuple(r) for r in scaled.collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_accuracy_rounds_half_even(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "actual string, prediction string")
    assert tuple(models.accuracy(df).first()) == (2, 3, 0.6667)


def separable(spark, n=80):
    rnd = random.Random(3)
    rows = [(i, rnd.gauss(3 if i % 2 else -3, 1), rnd.gauss(0, 1), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x double, z double, y int")


def test_models_beat_the_majority_class(spark):
    df = separable(spark)
    train, test = df.where("id < 60"), df.where("id >= 60")
    got = {r["model"]: r for r in models.compare_models(train, test, key="id", columns=["x", "z"], label="y").collect()}
    assert set(got) == {"Random Forest", "SGD", "KNN"}
    assert all(r["total"] == 20 and r["accuracy"] > 0.8 for r in got.values())


def test_model_choice():
    assert models.chosen("all") == ["rf", "sgd", "knn"] and models.chosen("none") == [] and models.chosen("knn") == ["knn"]
    with pytest.raises(ValueError):
        models.chosen("tree")


def test_importances_sum_to_one(spark):
    got = {r["predictor"]: r["importance"] for r in models.forest_importance(separable(spark), ["x", "z"], "y", categorical=True, trees=10).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["x"] > got["z"]


def forest_rows(spark, n=1500):
    rnd = random.Random(4)
    rows = []
    for _ in range(n):
        a, b, c, few = rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.expovariate(1), rnd.randrange(4)
        rows.append((a, b, c, few, "yes" if 2 * a + few + rnd.gauss(0, 0.5) > 1 else "no", 3 * c + b + rnd.gauss(0, 0.2)))
    return spark.createDataFrame(rows, "a double, b double, c double, few int, word string, number double")


@pytest.mark.parametrize("response", ["word", "number"])
def test_forests_weigh_predictors_as_those_of_spark(spark, monkeypatch, response):
    """The same method without a stored weight per row and tree, which Spark keeps in memory or on disk while it fits."""
    df, columns = forest_rows(spark), ["a", "b", "c", "few"]
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df)
    if response == "word":
        data = StringIndexer(inputCol="word", outputCol="label").fit(data).transform(data)
        model = RandomForestClassifier(numTrees=100, seed=1).fit(data)
    else:
        model = RandomForestRegressor(labelCol="number", numTrees=100, seed=1).fit(data)
    want = dict(zip(columns, model.featureImportances.toArray()))

    def refused(*_, **__):
        raise AssertionError("a weight per row and tree")

    monkeypatch.setattr(RandomForestClassifier, "fit", refused)
    monkeypatch.setattr(RandomForestRegressor, "fit", refused)
    found = models.forest_importance(df, columns, response, categorical=response == "word")
    got = {r["predictor"]: r["importance"] for r in found.collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert all(got[c] == pytest.approx(want[c], abs=0.05) for c in columns), (got, want)


def test_forest_does_not_depend_on_how_many_trees_are_counted_at_once(spark, monkeypatch):
    df = forest_rows(spark, 300).coalesce(1)
    fit = lambda: {r["predictor"]: r["importance"] for r in models.forest_importance(df, ["a", "c"], "word", categorical=True, trees=5).collect()}
    whole = fit()
    monkeypatch.setattr(forest, "COUNTED", 1)
    assert fit() == pytest.approx(whole)


def clustered(spark, n=1500, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (30, dims))
    rows = [(i, [float(v) for v in np.round(centres[i % 30] + rng.normal(0, 1, dims), 3)], "a") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, features array<double>, label string")


@pytest.mark.parametrize("block_rows", [20_000, 7])
def test_hashing_finds_most_neighbours(spark, block_rows):
    """Audited recall is that of all test rows, within the audit's error; found pairs carry exact distances."""
    rows, df = clustered(spark)
    test = df.where("id % 10 = 0").select("id", "features")
    got = lsh_nearest(df, test, 5, bucket=40, block_rows=block_rows)
    pairs = {(r["test_id"], r["train_id"], r["rank"]): r["distance"] for r in got.rows.collect()}
    truth = {(a, b) for a, b, _ in brute(rows, rows[::10], 5)}
    assert not got.exact and got.recall >= 0.9 and len(pairs) == 5 * 150
    assert len({p[:2] for p in pairs} & truth) / len(truth) == pytest.approx(got.recall, abs=1e-12)  # all were audited
    assert all(d == pytest.approx(float(np.linalg.norm(np.subtract(rows[a][1], rows[b][1])))) for (a, b, _), d in pairs.items())
    assert all(b == a and d == 0 for (a, b, rank), d in pairs.items() if rank == 1)


def test_few_tables_suffice(spark):
    """A test row also looks beyond the planes next to it, so that rows are sent to few tables."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 24) * 0.3 + 4.0 * np.eye(24)[i % 24]], "a") for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label string")
    got = lsh_nearest(df, df.where("id % 10 = 0"), 5, bucket=40)
    assert not got.exact and got.recall >= 0.9 and got.tables < 8


def test_hashing_gives_way_to_the_exact_search(spark):
    """One table of noise misses the recall; the answer is then the exact one."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 24)], "a") for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, label string")
    got = lsh_nearest(df, df.where("id % 20 = 0"), 5, bucket=4, tables=(1,))
    assert got.exact and got.recall < 0.9
    assert {tuple(r) for r in got.rows.select("test_id", "train_id", "rank").collect()} == brute(rows, rows[::20], 5)


def test_hashing_awkward_tables(spark):
    """Empty sides have no neighbours; fewer train rows than k are all found; repeats of one point share a bucket."""
    rows, df = points(spark, n=3)
    assert lsh_nearest(df.where("id < 0"), df, 5).rows.count() == 0 and lsh_nearest(df, df.where("id < 0"), 5).rows.count() == 0
    assert lsh_nearest(df, df, 5, bucket=1).rows.count() == 9
    same = spark.createDataFrame([(i, [1.0, 2.0], None) for i in range(50)], "id bigint, features array<double>, label string")
    got = lsh_nearest(same, same.where("id >= 48"), 3, bucket=1, block_rows=5).rows.select("test_id", "train_id", "rank")
    assert {tuple(r) for r in got.collect()} == {(t, i, i + 1) for t in (48, 49) for i in range(3)}
