import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from priorform.functions.pvalues import normal_two_sided, student_p
from priorform.operators import association, binned, models, report
from priorform.operators.summaries import grid_edges

INF = float("inf")


def corr(df):
    return df.first()["corr"]


def chi2(cells, yates=False):
    n, rows, cols = sum(cells.values()), {}, {}
    for (a, b), o in cells.items():
        rows[a], cols[b] = rows.get(a, 0) + o, cols.get(b, 0) + o
    total = 0.0
    for a in rows:
        for b in cols:
            e = rows[a] * cols[b] / n
            d = abs(cells.get((a, b), 0) - e)
            total += (max(0.0, d - 0.5) if yates else d) ** 2 / e
    return total, n, len(rows), len(cols)


def corrected(cells, tschuprow=False):
    x2, n, r, c = chi2(cells)
    phi2 = max(0.0, x2 / n - (r - 1) * (c - 1) / (n - 1))
    r, c = r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)
    return math.sqrt(phi2 / (math.sqrt((r - 1) * (c - 1)) if tschuprow else min(r - 1, c - 1)))


def cells_frame(spark, cells, schema="x string, y string"):
    return spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], schema)


def test_cramers_v_two_by_two(spark):
    cells = {("a", "p"): 30, ("a", "q"): 10, ("b", "p"): 8, ("b", "q"): 25}
    df = cells_frame(spark, cells)
    assert corr(association.cramers_v(df, "x", "y")) == pytest.approx(corrected(cells))
    x2, n, _, _ = chi2(cells, yates=True)
    assert corr(association.cramers_v(df, "x", "y", bias_correction=False)) == pytest.approx(math.sqrt(x2 / n))
    # Without any correction V is the absolute Pearson correlation of the codes.
    r = df.select(F.corr((F.col("x") == "a").cast("int"), (F.col("y") == "p").cast("int"))).first()[0]
    assert math.sqrt(chi2(cells)[0] / n) == pytest.approx(abs(r))


def test_larger_table_with_an_empty_cell_and_missing_levels(spark):
    cells = {("a", "p"): 9, ("a", "q"): 2, ("b", "q"): 8, ("b", "r"): 5, ("c", "p"): 1, ("c", "s"): 7, (None, "p"): 4, ("a", None): 3, ("0", "q"): 5}
    df = cells_frame(spark, cells)
    assert corr(association.cramers_v(df, "x", "y")) == pytest.approx(corrected(cells))
    assert corr(association.cramers_v(df, "x", "y", tschuprow=True)) == pytest.approx(corrected(cells, True))
    x2, n, r, c = chi2(cells)
    plain = association.cramers_v(df, "x", "y", bias_correction=False)
    assert corr(plain) == pytest.approx(math.sqrt(x2 / n / min(r - 1, c - 1)))


def test_missing_number_counts_as_zero(spark):
    cells = {(0, 1): 5, (1, 2): 9, (None, 2): 4, (2, 1): 6}
    merged = {(0, 1): 5, (1, 2): 9, (0, 2): 4, (2, 1): 6}
    assert corr(association.cramers_v(cells_frame(spark, cells, "x int, y int"), "x", "y")) == pytest.approx(corrected(merged))


def test_one_level_is_undefined(spark):
    assert corr(association.cramers_v(cells_frame(spark, {("a", "p"): 3, ("a", "q"): 4}), "x", "y")) is None


GROUPS = [("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 8.0), ("c", 4.0), (None, 9.0)]


def eta(rows):
    known = [r for r in rows if r[0] is not None]
    m = sum(v for _, v in known) / len(known)
    between = 0.0
    for g in {c for c, _ in known}:
        vs = [v for c, v in known if c == g]
        between += len(vs) * (sum(vs) / len(vs) - m) ** 2
    return between, m


def test_correlation_ratio(spark):
    df = spark.createDataFrame(GROUPS, "c string, v double")
    between, m = eta(GROUPS)
    dropped = sum((v - m) ** 2 for c, v in GROUPS if c)
    kept = sum((v - m) ** 2 for _, v in GROUPS)
    assert corr(association.correlation_ratio(df, "c", "v")) == pytest.approx(math.sqrt(between / dropped))
    assert corr(association.correlation_ratio(df, "c", "v", nulls="reference")) == pytest.approx(math.sqrt(between / kept))
    flat = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None)], "c string, v double")
    assert corr(association.correlation_ratio(flat, "c", "v")) == 0.0
    assert math.isnan(corr(association.correlation_ratio(flat, "c", "v", nulls="reference")))
    # Squared it is the R^2 of the one-hot regression.
    hot = df.na.drop().select("v", *[(F.col("c") == x).cast("double").alias(x) for x in "ab"])
    fit = LinearRegression(labelCol="v").fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(hot))
    assert corr(association.correlation_ratio(df, "c", "v")) ** 2 == pytest.approx(fit.summary.r2)


def noisy(spark, n=200, seed=1, mean=0.0):
    rnd = random.Random(seed)
    rows = [(x := rnd.gauss(mean, 1), 0.3 * x + rnd.gauss(0, 1), rnd.random()) for _ in range(n)]
    return spark.createDataFrame(rows, "x double, y double, z double")


def test_slope_test_matches_the_regression(spark):
    df = noisy(spark)
    got = association.with_p_values(association.pearson_ols(df, "x", "y")).first()
    model = LinearRegression(labelCol="y", solver="normal").fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    assert got["slope"] == pytest.approx(model.coefficients[0])
    assert got["t"] == pytest.approx(model.summary.tValues[0], rel=1e-5)
    assert got["p"] == pytest.approx(model.summary.pValues[0], rel=1e-3, abs=1e-12)


def test_slope_far_from_zero_keeps_its_digits(spark):
    df = noisy(spark, mean=1e6)
    got, rows = association.pearson_ols(df, "x", "y").first(), df.toPandas()
    x, y = rows["x"] - rows["x"].mean(), rows["y"] - rows["y"].mean()
    assert got["slope"] == pytest.approx((x * y).sum() / (x * x).sum(), rel=1e-9)
    assert got["corr"] == pytest.approx((x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()), rel=1e-9)


def test_listwise_rows(spark):
    df = noisy(spark).withColumn("z", F.when(F.col("z") < 0.5, F.col("z")))
    assert association.pearson_ols(df, "x", "y").first()["n"] == df.na.drop().count()
    assert association.pearson_ols(df, "x", "y", complete=["x", "y"]).first()["n"] == 200


def tails(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, dof double")
    return [r["p"] for r in df.withColumn("p", student_p(F.col("t"), F.col("dof"))).orderBy("i").collect()]


def test_student_tail(spark):
    known = [(0.0, 5, 1.0), (2.015048, 5, 0.1), (12.706205, 1, 0.05), (1.959964, 10**8, 0.05), (1.959964, 10**12, 0.05), (-2.228139, 10, 0.05)]
    assert tails(spark, [(t, float(dof)) for t, dof, _ in known]) == pytest.approx([p for *_, p in known], rel=1e-5)


def test_student_tail_is_the_integral_of_its_density(spark):
    """Simpson's rule over the angle whose tangent is t / sqrt(dof); both branches of the fraction, few and many degrees."""
    rows = [(t, float(dof)) for dof in (1, 2, 3, 7, 30, 251, 10**4, 10**6) for t in (0.01, 0.3, 0.9, 1.1, 1.7, 2.5, 6.0, 20.0)]
    for (t, dof), p in zip(rows, tails(spark, rows), strict=True):
        low = math.atan(t / math.sqrt(dof))
        angle, step = np.linspace(low, min(math.pi / 2 - 1e-12, low + 40 / math.sqrt(dof)), 200_001, retstep=True)
        weight = np.where(np.arange(len(angle)) % 2, 4.0, 2.0)
        weight[[0, -1]] = 1
        norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
        assert p == pytest.approx(2 * norm * step / 3 * (weight * np.exp((dof - 1) * np.log(np.cos(angle)))).sum(), rel=1e-7, abs=1e-12), (t, dof)


def test_tails_at_the_ends(spark):
    nan = float("nan")
    assert tails(spark, [(None, 3.0), (2.0, None), (nan, 3.0), (2.0, nan), (2.0, 0.0), (2.0, -1.0)]) == [None] * 6
    assert tails(spark, [(INF, 3.0), (-INF, 1e9)]) == [0.0, 0.0]
    assert tails(spark, [(60.0, 30.0), (5000.0, 1e9)]) == pytest.approx([0.0, 0.0], abs=1e-30)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)


def test_student_tail_runs_no_python(spark, capsys):
    spark.range(3).select(student_p(F.col("id"), F.col("id") + 1)).explain()
    assert "Python" not in capsys.readouterr().out


def test_logit_closed_form(spark):
    """For a 0/1 regressor without intercept: b = logit(mean of y where x = 1)."""
    rows = [(1, 1)] * 30 + [(1, 0)] * 10 + [(0, 1)] * 7 + [(0, 0)] * 9 + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "x int, y int")
    got = association.logit_slope(df, "y", "x").first()
    p, n1 = 30 / 40, 40
    b, se = math.log(p / (1 - p)), 1 / math.sqrt(n1 * p * (1 - p))
    assert got["n"] == 56 and got["b"] == pytest.approx(b, rel=1e-6)
    assert got["z"] == pytest.approx(b / se, rel=1e-5) and got["p"] == pytest.approx(normal_two_sided(b / se), rel=1e-4)


# --- binned response -----------------------------------------------------------------------


def brute_bins(rows, adaptive=False):
    rows = sorted((x, y) for x, y in rows if x is not None and y is not None)
    lo, n = rows[0][0], len(rows)
    step, mu, out = (rows[-1][0] - lo) / 10, sum(y for _, y in rows) / len(rows), []
    for b in range(10):
        width = step if b < 9 else INF
        got = [(x, y) for x, y in rows if lo <= x < lo + width]
        top = max((x for x, _ in got), default=lo + width)
        if got:
            m = sum(y for _, y in got) / len(got)
            msd = (m - mu) ** 2 / len(got)
            share = len(got) / n
            out.append((b, got[0][0], top, len(got), msd, msd / share if adaptive else msd * share))
        else:
            out.append((b, lo, lo + width, 0, None, None))
        lo = top if adaptive else lo + width
    return out


def bins_of(bins):
    rows = [tuple(bins_row[c] for c in ("bin", "lower", "upper", "n", "msd", "msd_weighted")) for bins_row in bins.collect()]
    return sorted(rows)


CASES = {
    "plain": [(float(i % 37), i % 2) for i in range(120)],
    "edges": [(round(0.01 * (i % 11), 2), int(i % 3 == 0)) for i in range(200)],
    "gap": [(float(x), x % 2) for x in (0, 1, 2, 3, 50, 51, 99, 100)],
    "constant": [(5.0, 1), (5.0, 0), (5.0, 1)],
    "missing": [(None, 1), (1.0, None), (1.0, 1), (2.0, 0), (3.0, 1), (9.0, 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_bins_match_the_definition(spark, name):
    df = spark.createDataFrame(CASES[name], "x double, y int")
    bins, summary = binned.dmr_1d(df, [], ["x"], "y")
    expected = brute_bins(CASES[name])
    got = bins_of(bins)
    assert len(got) == 10 and sum(r[3] for r in got) == len([1 for x, y in CASES[name] if None not in (x, y)])
    for g, e in zip(got, expected):
        assert g[:4] == e[:4] and g[4] == (pytest.approx(e[4]) if e[4] is not None else None)
    msd = [e[4] for e in expected if e[4] is not None]
    assert summary.first()["dmr"] == pytest.approx(sum(msd) / len(msd))
    adaptive, _ = binned.dmr_1d_adaptive(df, ["x"], "y")
    for g, e in zip(bins_of(adaptive), brute_bins(CASES[name], adaptive=True)):
        assert g[:4] == e[:4] and g[5] == (pytest.approx(e[5]) if e[5] is not None else None)


def test_edges_are_added_not_multiplied():
    edges = grid_edges(0.0, 0.1, 10)
    assert edges[3] == 0.0 + 0.01 + 0.01 + 0.01 and len(edges) == 10
    assert any(e != i * 0.01 for i, e in enumerate(edges))


def brute_2d(rows, key):
    n, ys = len(rows), [y for *_, y in rows if y is not None]
    mu, cells = sum(ys) / len(ys), {}
    for a, b, y in rows:
        k = key(a, b)
        if None not in k:
            cells.setdefault(k, []).append(y)
    dmr = []
    for vs in cells.values():
        m = sum(vs) / len(vs)
        dmr.append(((m - mu) ** 2 / len(vs), (m - mu) ** 2 / n))
    return tuple(sum(d) / len(dmr) for d in zip(*dmr))


def test_two_dimensions_keep_missing_rows_in_the_population(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("abc") if rnd.random() > 0.2 else None, rnd.choice([0.0, 1.0, 5.0, 9.5, 10.0, None]), rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string, v double, y int").withColumn("w", F.col("v") * 2)
    edges = grid_edges(0.0, 10.0, 10)
    bin_ = lambda v: None if v is None else sum(v >= e for e in edges)
    kinds = {"c": "cat", "v": "cont", "w": "cont"}
    got = binned.dmr_2d(df, [("c", "v")], kinds, "y").first()
    assert (got["dmr"], got["wdmr"]) == pytest.approx(brute_2d(rows, lambda a, b: (a, bin_(b))))
    both = binned.dmr_2d(df, [("v", "w")], {"v": "cont", "w": "cont"}, "y").first()
    assert (both["dmr"], both["wdmr"]) == pytest.approx(brute_2d(rows, lambda a, b: (bin_(b), bin_(b))))
    cells = {(r["a"], r["b"]): r for r in binned.dense_cells(df, "c", "v", kinds, "y").collect()}
    assert len(cells) == 30 and cells["a", "3"]["n"] == 0 and cells["a", "3"]["mean"] is None


def test_blocks_of_columns_give_the_cells_of_pairs(spark):
    rnd = random.Random(6)
    names = [f"x{i}" for i in range(7)]
    df = spark.createDataFrame([[rnd.random() for _ in names] + [rnd.randrange(2)] for _ in range(150)], [*names, "y"])
    pairs = binned.all_pairs(names)
    codes = binned.codes_for(df, {n: "cont" for n in names})
    sides = [
        {tuple(r) for r in binned.pair_cells(df, pairs, codes, F.col("y"), blocked=b).collect()} for b in (True, False)
    ]
    assert sides[0] == sides[1] and {r[0] for r in sides[0]} == set(range(len(pairs)))


def test_text_response_without_reading_has_no_dmr(spark):
    df = spark.createDataFrame([("a", "p", 1.0, "up"), ("b", "q", 2.0, "down"), ("a", "q", 3.0, "side")] * 5, "c string, d string, v double, r string")
    a = report.Analysis(df, ["c", "d", "v"], "r")
    assert a.y is None and a.response_cat and a.conts == ["v"]
    assert report.cat_cat_table(a).first()["dmr"] is None
    assert report.cat_cont_table(a).first()["wdmr"] is None


def test_response_table_dispatch(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), x := rnd.gauss(0, 1), x * 2 + rnd.gauss(0, 1)) for _ in range(120)]
    df = spark.createDataFrame(rows, "c string, x double, y double")
    got = {r["predictor"]: r for r in report.response_table(report.Analysis(df, ["c", "x"], "y")).collect()}
    assert got["x"]["corr_type"] == "Pearson's" and got["c"]["corr_type"] == "Correlation Ratio"
    assert got["x"]["corr"] == pytest.approx(df.select(F.corr("x", "y")).first()[0])
    assert got["x"]["rf_importance"] == pytest.approx(1.0) and got["c"]["rf_importance"] is None
    binary = df.withColumn("y", (F.col("y") > 0).cast("int"))
    got = {r["predictor"]: r for r in report.response_table(report.Analysis(binary, ["c", "x"], "y"), importance=False).collect()}
    assert got["x"]["corr_type"] == "Correlation Ratio" and got["c"]["corr_type"] == "Cramer's V"
    tables = report.pair_tables(report.Analysis(binary, ["c", "x"], "y"))
    assert list(tables) == ["cat_cont"]


def test_screening_types_and_tests(spark):
    rnd = random.Random(9)
    rows = [(x := rnd.gauss(0, 1), rnd.choice(["m", "f"]), x + rnd.gauss(0, 1) > 0) for _ in range(150)]
    df = spark.createDataFrame(rows, "x double, sex string, r boolean")
    got = {r["predictor"]: r for r in report.screen_predictors(df, ["x", "sex"], "r").collect()}
    assert got["x"]["predictor_type"] == "continuous" and got["sex"]["predictor_type"] == "categorical"
    assert got["x"]["t"] > 3 and got["x"]["p"] < 0.01 and got["sex"]["importance"] is None
    linear = report.screen_predictors(df.withColumn("r", F.col("x") * 2 + F.rand(1)), ["x"], "r").first()
    assert linear["response_type"] == "continuous" and linear["t"] > 3


def counted(df):
    """The frame, and how many of its rows were made so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(one, df.schema), made


def test_screening_makes_its_rows_once(spark):
    rnd = random.Random(9)
    rows = [(x := rnd.gauss(0, 1), rnd.choice(["m", "f"]), x + rnd.gauss(0, 1) > 0) for _ in range(150)]
    df, made = counted(spark.createDataFrame(rows, "x double, sex string, r boolean"))
    assert len(report.screen_predictors(df, ["x", "sex"], "r").collect()) == 2
    assert made.value == 150


def test_screening_grows_its_forest_without_stored_weights(spark, monkeypatch):
    """Spark's forest keeps a weight per row and tree, and most of the time of a screening went into it."""

    def refused(*_, **__):
        raise AssertionError("a weight per row and tree")

    monkeypatch.setattr(RandomForestClassifier, "fit", refused)
    rnd = random.Random(11)
    rows = [(x := rnd.gauss(0, 1), rnd.gauss(0, 1), x + rnd.gauss(0, 0.3) > 0) for _ in range(200)]
    got = {r["predictor"]: r["importance"] for r in report.screen_predictors(spark.createDataFrame(rows, "x double, z double, r boolean"), ["x", "z"], "r").collect()}
    assert got["x"] + got["z"] == pytest.approx(1.0) and got["x"] > 0.8


def test_forest_makes_its_rows_once(spark):
    rnd = random.Random(10)
    df, made = counted(spark.createDataFrame([(rnd.random(), i % 2) for i in range(80)], "x double, y int"))
    assert models.forest_importance(df, ["x"], "y", categorical=True, trees=3).first()["importance"] == pytest.approx(1.0)
    assert made.value == 80


def test_cells_of_numbers_are_those_of_the_blocks(spark, monkeypatch):
    rnd = random.Random(12)
    value = lambda: rnd.choice([None, float("nan"), rnd.gauss(0, 2), 1.0, 2.0, -3.0])
    rows = [(value(), value(), rnd.choice([None, 4]), None, rnd.choice([0, 1, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "p double, q double, one int, none double, y int")
    pairs, y = binned.all_pairs(["p", "q", "one", "none"]), F.col("y").cast("double")
    kinds = {c: "cont" for c in ("p", "q", "one", "none")}
    edges = binned.equal_width_edges(df, list(kinds))
    names = ["pair", "a", "b", "n", "n_response", "sum_response"]
    listed = lambda frame: sorted(map(str, frame.select(*names).collect()))
    blocks = listed(binned.pair_cells(df, pairs, binned.codes_for(df, kinds, edges), y))
    assert listed(binned.number_cells(df, pairs, edges, y)) == blocks

    def refused(*_, **__):
        raise AssertionError("bins as expressions")

    monkeypatch.setattr(binned, "pair_cells", refused)
    assert binned.dmr_2d(df, pairs, kinds, y).count() == len({b.split("pair=")[1].split(",")[0] for b in blocks if "None" not in b.split(" n=")[0]})
