"""Global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorform.sources.sinks import stage

# Keys sampled per range when split points are chosen.
SAMPLES_PER_RANGE = 32
# Aimed-at rows per range; a table of no more rows than this is one range.
ROWS_PER_RANGE = 250_000
# Most ranges, which bounds what the driver holds: samples and one offset per range.
MAX_RANGES = 4096


def _key_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def range_bucket(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> Column | None:
    """A column 0..parts-1 that splits the rows into ascending key ranges; None for one range.

    Split points come from a hash sample of distinct keys: a bounded number of key values
    reaches the driver. They only balance the work; any points give the same results.
    The bucket is a function of the row alone, so a recomputed task lands it the same.
    """
    total = df.count()
    parts = parts or min(MAX_RANGES, -(-total // ROWS_PER_RANGE))
    if parts <= 1:
        return None
    every = max(1, total // (parts * SAMPLES_PER_RANGE))
    sample = df.select(*keys)
    if every > 1:
        sample = sample.where(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0)
    points = [
        tuple(r)
        for r in sample.distinct()
        .withColumn("__h", F.xxhash64(*keys))
        .orderBy("__h")
        .limit(2 * parts * SAMPLES_PER_RANGE)
        .drop("__h")
        .collect()
    ]
    points.sort(key=lambda t: tuple((v is not None, v) for v in t))
    cuts = sorted({i * len(points) // parts for i in range(1, parts)} - {0})
    if not cuts:
        return None
    types = [df.schema[k].dataType for k in keys]
    bounds = F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(f"k{j}") for j, (v, t) in enumerate(zip(points[i], types))])
            for i in cuts
        ]
    )
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    key = _key_struct(keys)
    # Binary search: how many split points are not above the key.
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda lo, step: F.when(F.get(bounds, lo + step - 1) <= key, lo + step).otherwise(lo),
    )


def row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "idx", parts: int | None = None
) -> DataFrame:
    """1-based position in the ascending order of ``order_by`` (which must be a total order).

    Rows are range partitioned, sorted inside their partitions and stored with their place there, so
    no recomputed task can deal them out anew; what comes before a partition is one number each.
    """
    ranged = df.repartitionByRange(parts, *order_by) if parts else df.repartitionByRange(*order_by)
    stored = stage(ranged.sortWithinPartitions(*order_by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    before, seen = [], 0
    for r in stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        before.append((r["p"], seen))
        seen += r["n"]
    # One row per partition.
    offsets = df.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
    position = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    placed = stored.join(F.broadcast(offsets), part == F.col("__part"))
    return placed.select(*df.columns, position.cast("bigint").alias(name))


def ranked(df: DataFrame, metric: str, *ties: str) -> DataFrame:
    """Sort a result table by a metric, highest first and NULLs last."""
    return df.orderBy(F.desc_nulls_last(metric), *[F.asc(t) for t in ties])


def top_n(df: DataFrame, order: Sequence[Column | str], n: int = 20) -> DataFrame:
    """The first ``n`` rows of an order (a take-ordered, not a full sort)."""
    return df.orderBy(*order).limit(n)
