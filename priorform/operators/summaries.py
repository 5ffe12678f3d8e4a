"""Totals, counts, quantiles and histograms."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorform.functions.dates import first_words
from priorform.functions.rates import col, guarded_ratio
from priorform.operators.cleaning import plain_double
from priorform.operators.literals import literal_rows
from priorform.operators.ordering import range_bucket

# Rank error of the sketch that brackets a quantile is one part in this many.
SKETCH_ACCURACY = 10_000
# Groups whose brackets the driver holds; with more groups values are ranked instead.
MAX_GROUPS = 200


def totals(
    df: DataFrame, keys: Sequence[Column | str], sums: Mapping[str, Column | str],
    ratio: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Sums per key and, as ``ratio=(name, numerator, denominator)``, a ratio of two sums."""
    out = df.groupBy(*keys).agg(*[F.sum(col(c)).alias(n) for n, c in sums.items()])
    if ratio:
        name, num, den = ratio
        out = out.withColumn(name, guarded_ratio(num, den))
    return out


def entity_name(df: DataFrame, entity: str, text: str, order: str, words: int = 2) -> DataFrame:
    """(entity, name): the first words of the entity's text with the lowest ``order``."""
    name = F.min_by(first_words(text, words), F.col(order))
    return df.groupBy(entity).agg(name.alias("name"))


def crosstab(df: DataFrame, x: str, y: str, *, dense: bool = True) -> DataFrame:
    """(x, y, n) counts. ``dense`` adds the pairs that never occur, with 0.

    The dense form is a pivot over the levels of ``y`` that is unpivoted again; the pivot
    raises beyond its configured number of levels.
    """
    if not dense:
        return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    wide = known.groupBy(x).pivot(y).agg(F.count(F.lit(1)))
    values = [c for c in wide.columns if c != x]
    long = wide.unpivot([x], values, y, "n") if values else known.groupBy(x, y).count()
    return long.select(x, F.col(y).cast(df.schema[y].dataType).alias(y), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def value_counts_pivot(df: DataFrame, x: str, y: str, values: Sequence | None = None) -> DataFrame:
    """Rows of ``x``, one column per level of ``y``, counts; absent pairs are NULL."""
    return df.groupBy(x).pivot(y, list(values) if values else None).agg(F.count(F.lit(1)))


def class_share(df: DataFrame, column: str) -> DataFrame:
    """(class, n, share of all rows)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per class.
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys where NULL equals NULL; the keys come out once."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(renamed, on=same, how="inner").drop(*[f"__right_{k}" for k in keys])


def _melt(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), plain_double(df, c).alias("value")) for c in columns]
    )
    return df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())


def _label(p: float) -> str:
    return "q" + f"{p:g}".replace("0.", "")


def _ranked_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Quantiles by rank: value counts, range partitions, running counts, interpolation."""
    group = [*by, "column"]
    counts = _melt(df, columns, by).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    bucket = range_bucket(counts, ["column", "value"], parts)
    counts = counts.withColumn("__b", F.lit(0) if bucket is None else bucket)
    # At most one row per range and group: the offset of each range.
    ranges = counts.groupBy(*group, "__b").agg(F.sum("n").alias("__m"))
    order = Window.partitionBy(*group).orderBy("__b")
    ranges = ranges.select(
        *group,
        "__b",
        F.coalesce(F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__m").over(Window.partitionBy(*group)).alias("__total"),
    )
    keys = [*group, "__b"]
    joined = join_null_safe(counts, ranges, keys)
    inside = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = joined.withColumn("__upto", F.col("__before") + F.sum("n").over(inside))
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("__total") - 1)
        for j, rank in enumerate((F.floor(at), F.ceil(at))):
            hit = (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("n"))
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"__{i}_{j}"))
    found = upto.groupBy(*group).agg(*aggs, F.max("__total").alias("__total"))
    out = []
    for i, p in enumerate(probs):
        at = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{i}_0"), F.col(f"__{i}_1")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(_label(p)))
    return found.select(*group, *out)


def _sketch(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> list:
    """Per group: count, extremes, mean and bracketing approximate quantiles of each column."""
    margin = 2.0 / SKETCH_ACCURACY
    fractions = [f for p in probs for f in (max(0.0, p - margin), min(1.0, p + margin))]
    aggs = []
    for i, c in enumerate(columns):
        v = plain_double(df, c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.percentile_approx(v, fractions, SKETCH_ACCURACY).alias(f"q{i}"),
        ]
    return df.groupBy(*by).agg(*aggs).limit(MAX_GROUPS + 1).collect()


def _from_brackets(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str], sketch: list
) -> list[list] | None:
    """Exact quantiles in one pass, as rows (by..., column, q...), or None if a bracket misses.

    Values inside a bracket are counted one by one, the stretches between brackets as a
    whole. Running counts over these few rows (about four in ten thousand of the values per
    quantile, repeated ones once) give the value at each rank. A rank that falls between
    brackets shows as a NULL.
    """
    kinds = [df.schema[b].dataType for b in by]
    fields = [(f"__b{j}", k) for j, k in enumerate(kinds)]
    slots = [(i, k) for i in range(len(columns)) for k in range(len(probs))]
    edges = [(f"{edge}{i}_{k}", "double") for i, k in slots for edge in ("lo", "hi")]
    table, wanted = [], []
    for g in sketch:
        key = [g[b] for b in by]
        row = []
        for i, k in slots:
            q = g[f"q{i}"]
            row += [q[2 * k], q[2 * k + 1]] if q else [None, None]
        table.append([*key, *row])
        wanted += [[*key, i, *[p * (g[f"n{i}"] - 1) for p in probs]] for i in range(len(columns)) if g[f"n{i}"]]
    if not wanted:
        return []
    values = df.select(*by, *[plain_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    if by:
        same = [F.col(b).eqNullSafe(F.col(f"__b{j}")) for j, b in enumerate(by)]
        # One row per group, at most MAX_GROUPS.
        brackets = F.broadcast(literal_rows(df.sparkSession, [*fields, *edges], table))
        values = values.join(brackets, on=same, how="inner").drop(*[n for n, _ in fields])
    else:
        values = values.select("*", *[F.lit(v).cast("double").alias(n) for v, (n, _) in zip(table[0], edges)])
    # Places first, entries second: two small steps compile where one large one would not.
    places, entries = [], []
    for i in range(len(columns)):
        v, past, inside = F.col(f"v{i}"), F.lit(0), F.lit(False)
        for k in range(len(probs)):
            past = past + (v > F.col(f"hi{i}_{k}")).cast("int")
            inside = inside | v.between(F.col(f"lo{i}_{k}"), F.col(f"hi{i}_{k}"))
        places += [v, past.alias(f"p{i}"), F.when(inside, v).alias(f"x{i}")]
        entries.append(
            F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("past"), F.col(f"x{i}").alias("value"), v.alias("v"))
        )
    counted = (
        values.select(*by, *places)
        .select(*by, F.inline(F.array(*entries)))
        .where(F.col("v").isNotNull())
        .groupBy(*by, "i", "past", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("at"))
    )
    upto = Window.partitionBy(*by, "i").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ranks = literal_rows(
        df.sparkSession, [*fields, ("__i", "int"), *[(f"r{k}", "double") for k in range(len(probs))]], wanted
    )
    same = [F.col(b).eqNullSafe(F.col(f"__b{j}")) for j, b in enumerate(by)] + [F.col("i") == F.col("__i")]
    ranked = counted.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(ranks), on=same, how="inner")

    def pick(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))

    picks = []
    for k in range(len(probs)):
        at = F.col(f"r{k}")
        picks += [pick(F.floor(at)), pick(F.ceil(at)), F.max(at)]
    out = []
    for r in ranked.groupBy(*by, "i").agg(*picks).collect():
        row, found = [*r[: len(by)], columns[r[len(by)]]], r[len(by) + 1 :]
        for k in range(len(probs)):
            lo, hi, at = found[3 * k : 3 * k + 3]
            if lo is None or hi is None:
                return None
            row.append(lo + (hi - lo) * (at - math.floor(at)))
        out.append(row)
    return out


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75), *, by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: (by..., column, q25, q5, q75).

    A sketch brackets each quantile and one pass over the brackets decides; the result is a
    constant table. Beyond MAX_GROUPS groups the values are ranked across range partitions
    instead. Either way no task holds a whole column or a whole group.
    """
    sketch = _sketch(df, columns, probs, by)
    return _quantiles(df, columns, probs, by, sketch)


def _quantiles(df, columns, probs, by, sketch) -> DataFrame:
    rows = _from_brackets(df, columns, probs, by, sketch) if len(sketch) <= MAX_GROUPS else None
    if rows is None:
        return _ranked_quantiles(df, columns, probs, by)
    fields = [(b, df.schema[b].dataType) for b in by]
    fields += [("column", "string"), *[(_label(p), "double") for p in probs]]
    return literal_rows(df.sparkSession, fields, rows)


def five_numbers(df: DataFrame, columns: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, min, q25, median, mean, q75, max) over non-missing values."""
    probs, keys = (0.25, 0.5, 0.75), [*by, "column"]
    sketch = _sketch(df, columns, probs, by)
    if len(sketch) <= MAX_GROUPS:
        facts = ("n", "min", "mean", "max")
        fields = [(b, df.schema[b].dataType) for b in by]
        fields += [("column", "string"), ("n", "bigint"), ("min", "double"), ("mean", "double"), ("max", "double")]
        rows = [
            [*[g[b] for b in by], c, *[g[f"{f}{i}"] for f in facts]]
            for g in sketch
            for i, c in enumerate(columns)
            if g[f"n{i}"]
        ]
        basic = literal_rows(df.sparkSession, fields, rows)
    else:
        basic = _melt(df, columns, by).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("min"),
            F.avg("value").alias("mean"), F.max("value").alias("max"),
        )
    q = _quantiles(df, columns, probs, by, sketch).withColumnRenamed("q5", "median")
    return join_null_safe(basic, q, keys).select(*keys, "n", "min", "q25", "median", "mean", "q75", "max")


def grid_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Lower edges of equal-width bins by repeated addition of the step."""
    step, edges = (hi - lo) / bins, [lo]
    for _ in range(bins - 1):
        edges.append(edges[-1] + step)
    return edges


def bin_number(value: Column, edges: Sequence[float]) -> Column:
    """1-based bin of a value: how many lower edges are not above it; NULL for NULL.

    A division guesses the bin and the two edges around it decide, so that an expression
    over many columns stays small enough to be compiled. The guess is off by one at most as
    long as the added-up edges stay near their places; else all edges are compared.
    """
    last = len(edges) - 1
    step = edges[1] - edges[0] if last else 0.0
    regular = step > 0 and all(abs(e - (edges[0] + i * step)) < step / 4 for i, e in enumerate(edges))
    if not regular:
        number = F.lit(1)
        for e in edges[1:]:
            number = number + (value >= F.lit(e)).cast("int")
        return F.when(value.isNotNull(), number)
    lower = F.array(*[F.lit(e) for e in (float("-inf"), *edges[1:])])
    guess = F.least(F.greatest((value - F.lit(edges[0])) / F.lit(step), F.lit(0.0)), F.lit(float(last)))
    at = F.floor(guess).cast("int")
    up = F.coalesce((value >= F.get(lower, at + 1)).cast("int"), F.lit(0))
    down = (value < F.get(lower, at)).cast("int")
    return F.when(value.isNotNull(), at + 1 + up - down)


def extremes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    """(min, max) per column, in one aggregate; None for a column without values."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(plain_double(df, c)).alias(f"lo{i}"), F.max(plain_double(df, c)).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {
        c: None if row[f"lo{i}"] is None else (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)
    }


def histogram_2d(
    df: DataFrame, x: str, y: str, *, bins: int = 40, by: Sequence[str] = ()
) -> DataFrame:
    """(by..., x_bin, y_bin, n) over exactly ``bins`` equal-width bins per axis."""
    span = extremes(df, [x, y])
    numbered = df
    for name, c in (("x_bin", x), ("y_bin", y)):
        value = plain_double(df, c)
        edges = grid_edges(*span[c], bins) if span[c] else [0.0]
        numbered = numbered.withColumn(name, bin_number(value, edges))
    both = numbered.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
    return both.groupBy(*by, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def marginals(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., axis, bin, n): the two marginal histograms of a :func:`histogram_2d`."""
    axes = F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x_bin").alias("bin")),
        F.struct(F.lit("y").alias("axis"), F.col("y_bin").alias("bin")),
    )
    return cells.select(*by, "n", F.inline(axes)).groupBy(*by, "axis", "bin").agg(F.sum("n").alias("n"))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept, r2, n) of the least-squares line through complete pairs."""
    a, b = plain_double(df, x), plain_double(df, y)
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.regr_count(b, a).alias("n"),
    )


def per_day(df: DataFrame, ts: str) -> DataFrame:
    """(day, n): rows per calendar day."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
