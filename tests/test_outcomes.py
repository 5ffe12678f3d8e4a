"""Pair sums by products of bins, slopes by common Newton steps, stochastic gradient descent."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorform.operators import association, gram, report
from priorform.operators.report import Analysis


def table(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        x = [rnd.gauss(0, 1) if rnd.random() < 0.9 else None for _ in range(4)]
        rows.append((rnd.choice(["a", "b", "c", None]), rnd.choice(["u", "v"]), *x, 7.0, rnd.choice([0, 1, 1, None])))
    return spark.createDataFrame(rows, "c string, d string, v0 double, v1 double, v2 double, v3 double, flat double, r int")


def near(got, want):
    key = lambda r: (r["predictor_1"], r["predictor_2"])
    got, want = ({key(r): r.asDict() for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        for c, v in row.items():
            assert (got[k][c] == pytest.approx(v, rel=1e-9, abs=1e-12)) if isinstance(v, float) else got[k][c] == v, (k, c, got[k][c], v)


@pytest.mark.parametrize("rows,tile", [(8192, 64), (37, 2)])
def test_pair_tables_equal_the_grouped_ones(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(gram, "ROWS", rows)
    monkeypatch.setattr(gram, "TILE", tile)
    conts = ["v0", "v1", "v2", "v3", "flat"]
    a = Analysis(table(spark), ["c", "d", *conts], "r", ["c", "d"], conts, True)
    near(gram.cont_cont_table(a), report.cont_cont_table(a))
    near(gram.cat_cont_table(a), report.cat_cont_table(a))


def test_pair_tables_without_rows_or_values(spark):
    rows = table(spark).where("1 = 0").unionByName(table(spark, 3).withColumn("v0", F.lit(None).cast("double")).withColumn("c", F.lit(None).cast("string")))
    a = Analysis(rows, ["c", "v0", "v1"], "r", ["c"], ["v0", "v1"], True)
    assert gram.cont_cont_table(a, p_values=False).first()["dmr"] is None
    assert gram.cat_cont_table(a).count() == 0
    empty = Analysis(table(spark).where("1 = 0"), ["c", "v0", "v1"], "r", ["c"], ["v0", "v1"], True)
    assert gram.cont_cont_table(empty, p_values=False).count() == 0


def test_plan_does_not_grow_with_the_pairs(spark):
    def size(k):
        df = spark.range(50).select(*[F.rand(i).alias(f"x{i}") for i in range(k)], (F.col("id") % 2).alias("r"))
        a = Analysis(df, [], "r", [], [f"x{i}" for i in range(k)], True)
        plan = gram.cont_cont_table(a, p_values=False)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("\n"), len(plan)

    few, many = size(3), size(40)  # 3 and 780 pairs
    assert few[0] == many[0] and many[1] < 1.1 * few[1]


def plain_logit(xs, ys):
    b = 0.0
    for _ in range(200):
        p = [1 / (1 + math.exp(-b * x)) for x in xs]
        b += sum(x * (y - q) for x, y, q in zip(xs, ys, p)) / sum(x * x * q * (1 - q) for x, q in zip(xs, p))
    return b, 1 / math.sqrt(sum(x * x * q * (1 - q) for x, q in zip(xs, p)))


def test_logit_slopes_of_many_tests(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=300) * 1000
    y = (rnd.random(300) < 1 / (1 + np.exp(-x / 800))).astype(int)
    cols = {"x": x, "tiny": x * 1e-9, "zero": x * 0, "one": x * 0 + 2, "apart": np.where(y == 1, 1.0, -1.0), "almost": np.where(y == 1, np.abs(x), 0.0)}
    rows = [(*[float(v[i]) for v in cols.values()], int(y[i]) if i % 7 else None, None) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y int, none double")
    got = {r["name"]: r for r in association.logit_slopes(df, [(c, "y", c) for c in [*cols, "none"]]).collect()}
    kept = [i for i in range(300) if i % 7]
    for c in ("x", "tiny", "one"):
        b, se = plain_logit([cols[c][i] * (1e9 if c == "tiny" else 1) for i in kept], [y[i] for i in kept])
        b, se = (b * 1e9, se * 1e9) if c == "tiny" else (b, se)
        assert got[c]["b"] == pytest.approx(b, rel=1e-9) and got[c]["se"] == pytest.approx(se, rel=1e-9)
        assert got[c]["z"] == pytest.approx(b / se, rel=1e-9) and got[c]["n"] == len(kept) and 0 <= got[c]["p"] <= 1
    for c in ("zero", "apart", "almost", "none"):  # no slope exists
        assert got[c]["b"] is None and got[c]["z"] is None and got[c]["p"] is None
    assert got["none"]["n"] == 0
    with pytest.raises(ValueError, match="neither"):
        association.logit_slopes(df, [("bad", "one", "x")])


def test_slope_tests_use_pairs_of_their_own(spark):
    df = table(spark).select("v0", "v1", "v2")
    got = {r["predictor"]: r for r in association.slope_tests(df, ["v0", "v1"], "v2").collect()}
    for c in ("v0", "v1"):
        want = association.pearson_ols(df, c, "v2", complete=[c, "v2"]).first()
        assert got[c]["n"] == want["n"] and got[c]["t"] == pytest.approx(want["t"]) and got[c]["slope"] == pytest.approx(want["slope"])


# --- stochastic gradient descent ----------------------------------------------------------------


def points(spark, classes, n=3000, seed=5):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 3)) + np.stack([at == 0, at == 1, at == classes - 1], 1) * 1.5
    return spark.createDataFrame([(i, *map(float, x[i]), f"k{at[i]}") for i in range(n)], "id bigint, a double, b double, c double, y string")


def objective(x, y, w, penalty=1e-4):
    score = x @ w.T
    return float((np.logaddexp(0, score) - y * score).sum() / len(x) + penalty / 2 * (w[:, :-1] ** 2).sum())


def optimum(x, y, penalty=1e-4):
    """Newton to the end, one against the rest."""
    w = np.zeros((y.shape[1], x.shape[1]))
    keep = np.full(x.shape[1], penalty)
    keep[-1] = 0
    for k in range(y.shape[1]):
        for _ in range(30):
            p = 1 / (1 + np.exp(-(x @ w[k])))
            w[k] -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(keep), (p - y[:, k]) @ x / len(x) + keep * w[k])
    return w


@pytest.mark.parametrize("classes", [2, 4])
def test_descent_reaches_the_optimum(spark, monkeypatch, classes):
    from priorform.operators import sgd

    monkeypatch.setattr(sgd, "BLOCK", 700)
    df = points(spark, classes)
    model = sgd.fit(df, ["a", "b", "c"], "y")
    rows = df.collect()
    x = np.array([[r["a"], r["b"], r["c"], 1.0] for r in rows])
    y = np.array([[float(r["y"] == c) for c in (model.classes if classes > 2 else model.classes[1:])] for r in rows])
    least = objective(x, y, optimum(x, y))
    assert objective(x, y, model.weights) < 1.01 * least
    assert len(model.losses) < 100 and min(model.losses) < model.losses[0]
    again = sgd.fit(df.repartition(7).orderBy(F.rand(3)), ["a", "b", "c"], "y")
    assert again.weights == pytest.approx(model.weights, rel=1e-6)
    got = {r["id"]: r for r in model.apply(df).collect()}
    shares = 1 / (1 + np.exp(-(x @ model.weights.T)))
    shares = shares / shares.sum(1, keepdims=True) if classes > 2 else np.concatenate([1 - shares, shares], 1)
    for i, r in enumerate(rows):
        assert got[r["id"]]["prediction"] == model.classes[int(shares[i].argmax())]
        assert got[r["id"]]["probability"] == pytest.approx(shares[i].max())


def test_descent_with_few_classes_and_missing_values(spark):
    from priorform.operators import sgd

    df = spark.createDataFrame([(1, 1.0, "p"), (2, None, "p"), (3, 2.0, None), (4, 2.0, "p")], "id int, a double, y string")
    one = sgd.fit(df, ["a"], "y")
    assert one.classes == ["p"] and {r["prediction"] for r in one.apply(df.where("a is not null")).collect()} == {"p"}
    none = sgd.fit(df.where("1 = 0"), ["a"], "y")
    assert none.classes == []
    two = df.unionByName(spark.createDataFrame([(5, -3.0, "q"), (6, -2.0, "q")], df.schema))
    got = {r["id"]: r["prediction"] for r in sgd.fit(two, ["a"], "y").apply(two).collect()}
    assert got[1] == "p" and got[5] == "q" and got[2] is None
