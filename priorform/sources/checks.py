"""Key checks and keyed corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break a primary key: more than one row, or a NULL part.

    The count is combined before the shuffle, so a hot key moves as one row per task.
    """
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | any_null)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if the keys are not a primary key of the frame."""
    bad = duplicate_keys(df, keys).take(5)
    if bad:
        raise ValueError(f"not a primary key {list(keys)}: {[tuple(r) for r in bad]}")
    return df


def apply_corrections(
    df: DataFrame, fixes: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Overwrite ``columns`` by the non-NULL values of the row with the same key in ``fixes``.

    ``fixes`` holds at most one row per key.
    """
    renamed = fixes.select(*keys, *[F.col(c).alias(f"__fix_{c}") for c in columns])
    joined = df.join(renamed, on=list(keys), how="left")
    return joined.select(
        *[
            F.coalesce(F.col(f"__fix_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )
