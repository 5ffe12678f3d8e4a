"""Encodings of categories, reproducible random columns, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from priorform.functions.dates import season
from priorform.operators.ordering import row_index


MAX_LEVELS = 10_000  # of a category that becomes columns or classes


def levels(df: DataFrame, column: str) -> list:
    """Sorted distinct non-NULL values, for outputs that have one column per level; refused beyond ``MAX_LEVELS``."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels; use label codes or the vector form")
    return sorted(r[0] for r in found)


def one_hot(
    df: DataFrame, column: str, *, prefix: str | None = None, values: Sequence | None = None
) -> DataFrame:
    """Replace a category by 0/1 columns for all its sorted levels but the first.

    A NULL category is 0 everywhere. Pass ``values`` to fix the levels (and save a pass). The result
    has a column per level; :func:`one_hot_vector` is the form for categories of very many levels.
    """
    values = list(values) if values is not None else levels(df, column)
    prefix = prefix or column
    dummies = [
        F.when(F.col(column) == v, F.lit(1)).otherwise(F.lit(0)).alias(f"{prefix}_{v}")
        for v in values[1:]
    ]
    return df.select(*[c for c in df.columns if c != column], *dummies)


def one_hot_vector(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add a sparse vector with a 1 at the place of the level, none for NULL and for the first level.

    Codes are joined, so the number of levels has no bound but the vector's length.
    """
    from pyspark.ml.feature import OneHotEncoder

    codes = label_codes(df, column)
    size, name = codes.count(), name or f"{column}_vector"
    # The place before the last one is for level 0 and NULL, which the encoder drops as the last category.
    place = F.when(F.col("code") > 0, F.col("code") - 1).otherwise(F.lit(max(size - 1, 0))).cast("double")
    coded = codes.select(F.col("level").alias("__level"), place.alias("__place"))
    joined = df.join(coded, F.col(column).eqNullSafe(F.col("__level")), "left").fillna({"__place": float(max(size - 1, 0))})
    largest = df.sparkSession.range(1).select(F.lit(float(max(size - 1, 0))).alias("__place"))
    return OneHotEncoder(inputCols=["__place"], outputCols=[name]).fit(largest).transform(joined).select(*df.columns, name)


def label_codes(df: DataFrame, column: str, *, order_by: str | None = None) -> DataFrame:
    """(level, code): codes from 0 by first appearance in ``order_by``, else by value."""
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level"))
    if order_by is None:
        table, order = seen.agg(F.count(F.lit(1)).alias("__n")), ["level"]
    else:
        table, order = seen.agg(F.min(order_by).alias("__first")), ["__first", "level"]
    return row_index(table, order, "code").select("level", (F.col("code") - 1).alias("code"))


def label_encode(
    df: DataFrame, column: str, *, order_by: str | None = None, name: str | None = None
) -> DataFrame:
    """Add ``bool_<column>``: booleans as 1/0, 0/1 numbers unchanged, else codes by appearance.

    The table of codes has one row per level and is joined back, so levels are not bounded.
    """
    name, kind = name or f"bool_{column}", df.schema[column].dataType
    if isinstance(kind, BooleanType):
        return df.withColumn(name, F.col(column).cast("bigint"))
    if isinstance(kind, NumericType):
        other = df.where(F.col(column).isNotNull() & ~F.col(column).isin(0, 1)).limit(1).count()
        if not other:
            return df.withColumn(name, F.col(column).cast("bigint"))
    codes = label_codes(df, column, order_by=order_by).withColumnRenamed("code", name)
    return df.join(codes.withColumnRenamed("level", column), on=column, how="left").select(
        *df.columns, name
    )


def hashed_choice(keys: Sequence[str], options: Sequence, seed: int = 0) -> Column:
    """A uniform choice per row that depends on the key and the seed only, by MD5 so that other engines can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
    pick = F.pmod(digits, F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), pick)


def split_label(ts: Column | str, holdout: int, policy: str = "before") -> Column:
    """"test" for the held-out season; "train" for the ones before it, or all others.

    ``before`` (default) never trains on later seasons, which then get NULL;
    ``not_equal`` trains on every season but the held-out one.
    """
    year = season(ts)
    if policy == "before":
        return F.when(year == holdout, "test").when(year < holdout, "train")
    if policy == "not_equal":
        return F.when(year == holdout, "test").when(year != holdout, "train")
    raise ValueError(f"unknown policy {policy!r}")


def time_split(
    df: DataFrame, ts: str, holdout: int, policy: str = "before"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by season."""
    label = split_label(ts, holdout, policy)
    return df.where(label == "train"), df.where(label == "test")


def nth_row_flag(df: DataFrame, order_by: Sequence[str], n: int = 10, name: str = "is_test") -> DataFrame:
    """Mark rows 0, n, 2n, ... of an order as test rows (all rows stay for training)."""
    return row_index(df, order_by, "__idx").withColumn(
        name, ((F.col("__idx") - 1) % n == 0).cast("int")
    ).drop("__idx")
