"""Association between two columns: Cramer's V, Tschuprow's T, correlation ratio, Pearson, slopes.

All statistics are sums over cells or groups. Cells are combined before the shuffle and the
rest runs on cell-sized frames. An undefined statistic is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from priorform.functions.pvalues import normal_two_sided, student_p
from priorform.operators.cleaning import plain_double
from priorform.operators.literals import literal_rows


def missing_text(df: DataFrame, c: str) -> Column:
    """The level that missing values of a category count as.

    It is zero for a number. In a text column it is a level of its own, apart from the
    text "0" (as the number 0 is), written as a character that no text holds.
    """
    kind = df.schema[c].dataType
    if isinstance(kind, NumericType):
        return F.lit(0).cast(kind).cast("string")
    return F.lit("\x00")


def category(df: DataFrame, c: str) -> Column:
    """A category as text with missing values as in :func:`missing_text`."""
    return F.coalesce(F.col(c).cast("string"), missing_text(df, c))


def nominal_from_cells(
    cells: DataFrame,
    key: Sequence[str],
    *,
    bias_correction: bool = True,
    tschuprow: bool = False,
    name: str = "corr",
) -> DataFrame:
    """(key..., corr) from counts (key..., a, b, n) where no level is NULL.

    Chi-square needs no dense table: n * (sum(o^2 / (row * col)) - 1). With the correction
    off, a 2x2 table gets the Yates correction, which has a closed form in the row and
    column totals.
    """
    key = list(key)
    rows = cells.groupBy(*key, "a").agg(F.sum("n").alias("__row"))
    cols = cells.groupBy(*key, "b").agg(F.sum("n").alias("__col"))
    joined = cells.join(rows, on=[*key, "a"]).join(cols, on=[*key, "b"])
    o = F.col("n").cast("double")
    main = joined.groupBy(*key).agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(o * o / (F.col("__row").cast("double") * F.col("__col"))).alias("s"),
    )
    row_side = rows.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("r"), F.sum(1.0 / F.col("__row")).alias("ra")
    )
    col_side = cols.groupBy(*key).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum(1.0 / F.col("__col")).alias("ca")
    )
    both = (
        main.unionByName(row_side, allowMissingColumns=True)
        .unionByName(col_side, allowMissingColumns=True)
        .groupBy(*key)
        .agg(*[F.max(m).alias(m) for m in ("n", "s", "r", "c", "ra", "ca")])
    )
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    zero, one = F.lit(0.0), F.lit(1.0)
    chi2 = F.greatest(zero, n * (F.col("s") - one))
    if not bias_correction:
        scale = n * F.col("ra") * F.col("ca")
        off = F.greatest(zero, F.sqrt(chi2 / scale) - 0.5)
        chi2 = F.when((r == 2) & (c == 2), off * off * scale).otherwise(chi2)
    phi2 = chi2 / n
    if bias_correction:
        less = F.nullif(n - one, zero)
        phi2 = F.greatest(zero, phi2 - (r - one) * (c - one) / less)
        r = r - (r - one) * (r - one) / less
        c = c - (c - one) * (c - one) / less
    limit = F.sqrt((r - one) * (c - one)) if tschuprow else F.least(r - one, c - one)
    return both.select(*key, F.sqrt(phi2 / F.when(limit > 0, limit)).alias(name))


def nominal_cells(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(category(df, x).alias("a"), category(df, y).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )


def cramers_v(
    df: DataFrame, x: str, y: str, *, bias_correction: bool = True, tschuprow: bool = False
) -> DataFrame:
    """One row (x, y, corr): Cramer's V, or Tschuprow's T."""
    cells = nominal_cells(df, x, y).withColumns({"x": F.lit(x), "y": F.lit(y)})
    return nominal_from_cells(
        cells, ["x", "y"], bias_correction=bias_correction, tschuprow=tschuprow
    )


def centers(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """A mean per column, to subtract before squaring; 0 for a column without values."""
    row = df.agg(*[F.avg(plain_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[i] if row[i] is not None and math.isfinite(row[i]) else 0.0) for i, c in enumerate(columns)}


def correlation_ratios(
    df: DataFrame,
    cats: Sequence[str],
    conts: Sequence[str],
    *,
    nulls: str = "drop",
    center: dict[str, float] | None = None,
) -> DataFrame:
    """(cat, cont, corr) for every category and number: sqrt(between / total sum of squares).

    ``nulls="drop"`` uses complete pairs. ``nulls="reference"`` keeps rows without category
    in the total only and gives NaN as soon as one value is missing.

    Rows are grouped once per category column, whatever the number of continuous ones.
    """
    if nulls not in ("drop", "reference"):
        raise ValueError(f"unknown nulls {nulls!r}")
    center = center or centers(df, conts)
    levels = F.array(
        *[F.struct(F.lit(c).alias("cat"), F.col(c).cast("string").alias("level")) for c in cats]
    )
    values = [(plain_double(df, c) - F.lit(center[c])).alias(f"v{i}") for i, c in enumerate(conts)]
    long = df.select(*values, F.inline(levels))
    aggs = []
    for i in range(len(conts)):
        v = F.col(f"v{i}")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.sum(v).alias(f"s{i}"),
            F.sum(v * v).alias(f"q{i}"),
            F.count_if(v.isNull()).alias(f"x{i}"),
        ]
    groups = long.groupBy("cat", "level").agg(*aggs)
    per_cont = F.array(
        *[
            F.struct(
                F.lit(c).alias("cont"),
                F.col(f"n{i}").cast("double").alias("n"),
                F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("s"),
                F.coalesce(F.col(f"q{i}"), F.lit(0.0)).alias("q"),
                F.col(f"x{i}").alias("x"),
            )
            for i, c in enumerate(conts)
        ]
    )
    return ratios_from_groups(groups.select("cat", "level", F.inline(per_cont)), nulls=nulls)


def ratios_from_groups(flat: DataFrame, *, nulls: str = "drop") -> DataFrame:
    """(cat, cont, corr) from (cat, level, cont, n, s, q, x): values, their sum, sum of squares, missing values."""
    known = F.col("level").isNotNull()
    if nulls == "drop":
        flat = flat.where(known)

    def over_known(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(known, c)), F.lit(0.0))

    sums = flat.groupBy("cat", "cont").agg(
        over_known(F.col("n")).alias("n"),
        over_known(F.col("s")).alias("s"),
        over_known(F.when(F.col("n") > 0, F.col("s") * F.col("s") / F.col("n"))).alias("b"),
        F.sum("n").alias("n_all"),
        F.sum("s").alias("s_all"),
        F.sum("q").alias("q_all"),
        F.sum("x").alias("x_all"),
    )
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0.0))
    between = F.greatest(F.lit(0.0), F.col("b") - mean * F.col("s"))
    total = F.col("q_all") - 2 * mean * F.col("s_all") + mean * mean * F.col("n_all")
    eta = F.when(between == 0, F.lit(0.0)).otherwise(F.sqrt(between / F.when(total > 0, total)))
    if nulls == "reference":
        eta = F.when(F.col("x_all") > 0, F.lit(float("nan"))).otherwise(eta)
    return sums.select("cat", "cont", eta.alias("corr"))


def correlation_ratio(df: DataFrame, cat: str, cont: str, *, nulls: str = "drop") -> DataFrame:
    """One row (cat, cont, corr)."""
    return correlation_ratios(df, [cat], [cont], nulls=nulls)


def pearson_pairs(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    *,
    center: dict[str, float] | None = None,
    complete: Sequence[str] | None = None,
) -> DataFrame:
    """(x, y, n, corr, slope, t) for every pair, over rows complete in ``complete``.

    ``complete`` defaults to all columns of the frame. Sums of products of centred values
    come from one aggregate without a shuffle of rows, whatever the number of pairs.
    """
    rows = df.na.drop(subset=list(complete) if complete is not None else None)
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: i for i, c in enumerate(cols)}
    center = center or centers(rows, cols)
    values = rows.select(
        *[(plain_double(rows, c) - F.lit(center[c])).alias(f"v{i}") for c, i in at.items()]
    )
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    for i in range(len(cols)):
        v = F.col(f"v{i}")
        aggs += [F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}")]
    wanted = sorted({tuple(sorted((at[a], at[b]))) for a, b in pairs})
    aggs += [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i, j in wanted]
    sums = values.agg(*aggs)
    per_pair = []
    for a, b in pairs:
        i, j = at[a], at[b]
        lo, hi = sorted((i, j))
        per_pair.append(
            F.struct(
                F.lit(a).alias("x"),
                F.lit(b).alias("y"),
                F.col(f"s{i}").alias("sx"),
                F.col(f"s{j}").alias("sy"),
                F.col(f"q{i}").alias("qx"),
                F.col(f"q{j}").alias("qy"),
                F.col(f"p{lo}_{hi}").alias("pxy"),
            )
        )
    return pearson_from_sums(sums.select("n", F.inline(F.array(*per_pair))))


def pearson_from_sums(flat: DataFrame) -> DataFrame:
    """(x, y, n, corr, slope, t) from (x, y, n, sx, sy, qx, qy, pxy), sums of values, squares and products."""
    n = F.nullif(F.col("n"), F.lit(0.0))
    cxx = F.col("qx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("qy") - F.col("sy") * F.col("sy") / n
    cxy = F.col("pxy") - F.col("sx") * F.col("sy") / n
    r = cxy / F.sqrt(F.when((cxx > 0) & (cyy > 0), cxx * cyy))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    r = F.when((cxx > 0) & (cyy > 0), r)
    flat = flat.select("x", "y", "n", r.alias("corr"), (cxy / F.when(cxx > 0, cxx)).alias("slope"))
    corr = F.col("corr")
    left = F.col("n") - 2
    t = corr * F.sqrt(F.when(left > 0, left) / F.when(corr * corr < 1, 1 - corr * corr))
    return flat.select(
        "x", "y", F.col("n").cast("bigint").alias("n"), "corr", "slope", F.round(t, 6).alias("t")
    )


def pearson_ols(
    df: DataFrame, x: str, y: str, *, complete: Sequence[str] | None = None
) -> DataFrame:
    """One row (x, y, n, corr, slope, t) of the regression of ``y`` on ``x`` with a constant."""
    return pearson_pairs(df, [(x, y)], complete=complete)


def slope_tests(df: DataFrame, predictors: Sequence[str], response: str) -> DataFrame:
    """(predictor, n, corr, slope, t) of the response on each predictor with a constant, over complete pairs, in one aggregate."""
    y = plain_double(df, response)
    one = lambda x: F.struct(
        F.regr_count(y, x).cast("double").alias("n"), F.regr_sxx(y, x).alias("qx"), F.regr_syy(y, x).alias("qy"), F.regr_sxy(y, x).alias("pxy")
    )
    sums = df.agg(*[one(plain_double(df, c)).alias(f"r{i}") for i, c in enumerate(predictors)])
    flat = sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("x"), F.lit(response).alias("y"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), *[F.col(f"r{i}.{k}").alias(k) for k in ("n", "qx", "qy", "pxy")])
        for i, c in enumerate(predictors)
    ])))
    return pearson_from_sums(flat).select(F.col("x").alias("predictor"), "n", "corr", "slope", "t")


def with_p_values(pairs: DataFrame, name: str = "p") -> DataFrame:
    """Add the two-sided p-value of ``t`` with ``n - 2`` degrees of freedom."""
    return pairs.withColumn(name, student_p(F.col("t"), F.col("n") - 2))


MAX_STEPS = 60
SETTLED = 1e-10  # of a step, in standard errors


def logit_slopes(df: DataFrame, tests: Sequence[tuple[str, str | Column, str | Column]]) -> DataFrame:
    """(name, b, se, z, p, n) of logistic regressions of 0/1 outcomes on one regressor each, no intercept, all together.

    ``tests`` are (name, outcome, regressor); each uses its complete pairs. One aggregate finds what can be fitted, then
    every Newton step is one aggregate of the scores and informations of all tests that have not settled; a step that
    lowers the likelihood is halved. A slope is NULL where none exists: no pair with a regressor other than 0, or
    regressors whose signs separate the outcomes. Another outcome than 0 or 1 is refused.
    """
    spark, names = df.sparkSession, [name for name, _, _ in tests]
    column = lambda c: plain_double(df, c) if isinstance(c, str) else c
    rows = df.select(
        F.array(*[column(y) for _, y, _ in tests]).alias("ys"), F.array(*[column(x) for _, _, x in tests]).alias("xs")
    )

    def pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Outcomes and regressors, a column per test; an incomplete pair has a regressor of NaN."""
        ys, xs = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(tests)) for i in (0, 1))
        return ys, np.where(np.isnan(ys), np.nan, xs)

    def summed(one, width: int) -> np.ndarray:
        """Sums over all rows of ``one(ys, xs)``, ``width`` figures per test."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, len(tests)))
            for batch in batches:
                if batch.num_rows:
                    total += one(*pairs(batch))
            yield pa.RecordBatch.from_arrays([pa.array(range(width * len(tests)), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

        out = np.zeros(width * len(tests))
        for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(width, len(tests))

    def facts(ys, xs):
        toward = xs * (2 * ys - 1)  # comparisons with NaN are false
        other = ~np.isnan(xs) & (ys != 0) & (ys != 1)
        return np.stack([(~np.isnan(xs)).sum(0), (toward > 0).sum(0), (toward < 0).sum(0), other.sum(0)]).astype(np.float64)

    n, agree, differ, other = summed(facts, 4)
    if other.any():
        raise ValueError(f"an outcome of {[name for name, o in zip(names, other) if o]} is neither 0 nor 1")
    active = (agree > 0) & (differ > 0)
    slope, before, error = np.zeros(len(tests)), np.zeros(len(tests)), np.full(len(tests), np.nan)
    best, settled = np.full(len(tests), -np.inf), ~active
    for _ in range(MAX_STEPS):
        if settled.all():
            break
        asked, at = np.flatnonzero(~settled), slope.copy()

        def step(ys, xs):
            out = np.zeros((3, len(tests)))
            y, x = ys[:, asked], xs[:, asked]
            has = ~np.isnan(x)
            x, y = np.where(has, x, 0.0), np.where(has, y, 0.0)
            eta = np.clip(x * at[asked], -700, 700)
            share = 1 / (1 + np.exp(-eta))
            likely = np.where(has, y * eta - np.logaddexp(0, eta), 0.0)
            out[:, asked] = likely.sum(0), (x * (y - share)).sum(0), (x * x * share * (1 - share)).sum(0)
            return out

        likely, score, information = summed(step, 3)
        for i in asked:
            if likely[i] < best[i] - 1e-12 * abs(best[i]):
                slope[i] = (slope[i] + before[i]) / 2
                continue
            move = score[i] / information[i] if information[i] > 0 else 0.0
            best[i], before[i], error[i] = likely[i], slope[i], 1 / math.sqrt(information[i]) if information[i] > 0 else np.nan
            slope[i] += move
            settled[i] = abs(move) <= SETTLED * error[i] or not information[i] > 0
    fields = [("name", "string"), ("b", "double"), ("se", "double"), ("z", "double"), ("p", "double"), ("n", "bigint")]
    found = []
    for i, name in enumerate(names):
        ok = bool(active[i] and settled[i] and math.isfinite(error[i]))
        z = slope[i] / error[i] if ok else None
        found.append((name, float(slope[i]) if ok else None, float(error[i]) if ok else None, z and float(z), normal_two_sided(z), int(n[i])))
    return literal_rows(spark, fields, found)


def logit_slope(df: DataFrame, outcome: str | Column, regressor: str | Column) -> DataFrame:
    """One row (b, z, p, n): logistic regression of a 0/1 outcome on one regressor, no intercept."""
    return logit_slopes(df, [("slope", outcome, regressor)]).select("b", F.round("z", 6).alias("z"), "p", "n")


def matrix_form(pairs: DataFrame, a: str, b: str, value: str, names: Sequence[str] = ()) -> DataFrame:
    """(p1, p2, value) with absolute values, both directions and a unit diagonal for ``names``."""
    v = F.abs(F.col(value))
    there = pairs.select(F.col(a).alias("p1"), F.col(b).alias("p2"), v.alias("value"))
    back = pairs.select(F.col(b).alias("p1"), F.col(a).alias("p2"), v.alias("value"))
    out = there.unionByName(back)
    if names:
        diagonal = literal_rows(
            pairs.sparkSession,
            [("p1", "string"), ("p2", "string"), ("value", "double")],
            [(n, n, 1.0) for n in names],
        )
        out = out.unionByName(diagonal)
    return out


def correlation_matrix(df: DataFrame, conts: Sequence[str]) -> DataFrame:
    """Absolute Pearson correlations of all pairs in long form."""
    pairs = pearson_pairs(df.select(*conts), list(combinations(conts, 2)))
    return matrix_form(pairs, "x", "y", "corr", conts)
