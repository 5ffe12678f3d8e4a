"""History features per entity, latest values and gaps.

Every frame here is measured in whole days, so all rows of one entity on one day share the
same history. That gives two ways to the same result:

* in place: one shuffle by entity and range frames over the rows, for callers that know that
  entities are small.
* daily: rows are first combined to one row per (entity, day) on the map side, frames run
  over those daily rows (at most as many per entity as the calendar has days, however many
  rows there are), and the result is joined back on (entity, day). A hot entity never sits
  in one task: its raw rows are only ever grouped or joined by day, and a hot single day is
  a skewed left side of a join with one right row, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorform.functions.dates import day_number
from priorform.functions.rates import col

DAY = "__day"
SEASON = "__season"


@dataclass(frozen=True)
class Horizon:
    """Look-back in days relative to the row's day; ``first=None`` reaches back without end."""

    first: int | None
    last: int
    within_season: bool = False

    def window(self, entity: Sequence[str | Column]) -> Window:
        start = Window.unboundedPreceding if self.first is None else self.first
        parts = [*entity, SEASON] if self.within_season else list(entity)
        return Window.partitionBy(*parts).orderBy(DAY).rangeBetween(start, self.last)


# The three look-backs in use. "100 days" exists closed and open; to-date
# horizons leave out the day before.
CLOSED_100 = Horizon(-100, -1)
OPEN_100 = Horizon(-99, -1)
CAREER_TO_DATE = Horizon(None, -2)
SEASON_TO_DATE = Horizon(None, -2, within_season=True)


def _names(entity: str | Sequence[str]) -> list[str]:
    return [entity] if isinstance(entity, str) else list(entity)


def daily_history(
    df: DataFrame,
    entity: str | Sequence[str],
    ts: str,
    horizons: Mapping[str, Horizon],
    *,
    sums: Mapping[str, Column | str] | None = None,
    means: Mapping[str, Column | str] | None = None,
    count: str | None = "n",
) -> DataFrame:
    """History per (entity, day): ``{measure}_{horizon}`` columns, keyed by entity and ``__day``.

    ``sums`` add a row value over the frame, ``means`` average it over the frame's rows
    (a mean of per-row ratios stays a mean of ratios). The row count is a ``sum(1)``.
    An empty frame gives NULL throughout, also for the count.
    """
    entity, sums, means = _names(entity), dict(sums or {}), dict(means or {})
    keyed = df.withColumn(DAY, day_number(ts)).where(F.col(DAY).isNotNull())
    for e in entity:
        keyed = keyed.where(F.col(e).isNotNull())

    daily = [F.sum(c).alias(n) for n, c in _parts(sums, means).items()]
    per_day = keyed.groupBy(*entity, DAY).agg(*daily)
    return per_day.transform(_with_season, horizons).select(
        *entity, DAY, *_over(horizons, entity, sums, means, count)
    )


def _parts(sums: Mapping[str, Column | str], means: Mapping[str, Column | str]) -> dict[str, Column]:
    """What is added up per row: values, and for means also how many there are."""
    parts = {f"__s_{m}": col(c) for m, c in sums.items()}
    for m, c in means.items():
        parts |= {f"__a_{m}": col(c), f"__c_{m}": F.when(col(c).isNotNull(), F.lit(1).cast("bigint")).otherwise(0)}
    return parts | {"__n": F.lit(1).cast("bigint")}


def _with_season(df: DataFrame, horizons: Mapping[str, Horizon]) -> DataFrame:
    if any(h.within_season for h in horizons.values()):
        return df.withColumn(SEASON, F.year(F.date_from_unix_date(DAY)))
    return df


def _over(
    horizons: Mapping[str, Horizon], entity: Sequence[str | Column], sums, means, count: str | None
) -> list[Column]:
    out = []
    for suffix, h in horizons.items():
        w = h.window(entity)
        out += [F.sum(f"__s_{m}").over(w).alias(f"{m}_{suffix}") for m in sums]
        for m in means:
            total, rows = F.sum(f"__a_{m}").over(w), F.sum(f"__c_{m}").over(w)
            mean = total.cast("double") / F.nullif(rows, F.lit(0)).cast("double")
            out.append(mean.alias(f"{m}_{suffix}"))
        if count:
            out.append(F.sum("__n").over(w).alias(f"{count}_{suffix}"))
    return out


def with_history(
    df: DataFrame,
    entity: str | Sequence[str],
    ts: str,
    horizons: Mapping[str, Horizon],
    *,
    sums: Mapping[str, Column | str] | None = None,
    means: Mapping[str, Column | str] | None = None,
    count: str | None = "n",
    way: str = "daily",
) -> DataFrame:
    """The rows of ``df`` with their history columns; same arguments as :func:`daily_history`.

    Rows without entity or date are kept with NULL history. ``way`` is "daily" for entities of any
    size, or "in_place" if the caller knows that entities are small, such as after
    :func:`dedupe_entity_day`.
    """
    entity = _names(entity)
    if way not in ("daily", "in_place"):
        raise ValueError(f"unknown way {way!r}")
    if way == "in_place":
        return _history_in_place(df, entity, ts, horizons, dict(sums or {}), dict(means or {}), count)
    history = daily_history(df, entity, ts, horizons, sums=sums, means=means, count=count)
    added = [c for c in history.columns if c not in (*entity, DAY)]
    rows = df.withColumn(DAY, day_number(ts))
    return rows.join(history, on=[*entity, DAY], how="left").select(*df.columns, *added)


def listed_history(
    df: DataFrame,
    entity: str | Sequence[str],
    ts: str,
    horizons: Mapping[str, Horizon],
    wanted: Column,
    keep: Sequence[str],
    *,
    sums: Mapping[str, Column | str],
    count: str | None = "n",
) -> DataFrame:
    """(entity, ``keep``, history) of the rows where ``wanted`` holds; the history is that of all rows, as in :func:`with_history`.

    Rows move once, by entity, with the columns that are used; values are computed there. They are combined to daily rows,
    which list the wanted rows of their day, so nothing is joined back. The day number comes along as ``__day``. A day's
    list has to fit into a row; for entities with more than that in one day take :func:`with_history`.
    """
    entity, parts = _names(entity), _parts(sums, {})
    rows = df.withColumn(DAY, day_number(ts))
    unknown = F.col(DAY).isNull()
    for e in entity:
        unknown = unknown | F.col(e).isNull()
    # Rows without a place in time have no history; a hash of what is kept of them spreads them.
    rows = rows.withColumn("__apart", F.when(unknown, F.xxhash64(*entity, DAY, *keep))).withColumn("__wanted", wanted)
    rows = rows.repartition(*entity, "__apart").withColumns(parts)
    listed = F.collect_list(F.when(F.col("__wanted"), F.struct(*keep))).alias("__rows")
    per_day = rows.groupBy(*entity, "__apart", DAY).agg(*[F.sum(n).alias(n) for n in parts], listed)
    names = [f"{m}_{suffix}" for suffix in horizons for m in (*sums, *([count] if count else []))]
    frames = per_day.transform(_with_season, horizons).select(
        *entity, DAY, "__apart", "__rows", *_over(horizons, [*entity, "__apart"], sums, {}, count)
    )
    out = frames.select(*entity, DAY, "__apart", *names, F.explode("__rows").alias("__row"))
    return out.select(
        *entity, DAY, *[F.col(f"__row.{c}").alias(c) for c in keep],
        *[F.when(F.col("__apart").isNull(), F.col(n)).alias(n) for n in names],
    )


def _history_in_place(df, entity, ts, horizons, sums, means, count) -> DataFrame:
    rows = df.withColumn(DAY, day_number(ts)).withColumns(_parts(sums, means))
    rows = rows.transform(_with_season, horizons)
    unknown = F.col(DAY).isNull()
    for e in entity:
        unknown = unknown | F.col(e).isNull()
    # Rows without a place in time have no history; a hash of what is read anyway spreads them.
    apart = F.when(unknown, F.xxhash64(*entity, ts, *_parts(sums, means)))
    rows = rows.withColumn("__apart", apart)
    frames = _over(horizons, [*entity, "__apart"], sums, means, count)
    names = [n for suffix in horizons for n in [f"{m}_{suffix}" for m in (*sums, *means, *([count] if count else []))]]
    return rows.select(*df.columns, "__apart", *frames).select(
        *df.columns, *[F.when(F.col("__apart").isNull(), F.col(n)).alias(n) for n in names]
    )


def rolling(
    df: DataFrame,
    entity: str | Sequence[str],
    ts: str,
    first: int | None,
    last: int,
    *,
    sums: Mapping[str, Column | str] | None = None,
    means: Mapping[str, Column | str] | None = None,
    count: str | None = "n",
    suffix: str = "prior",
    within_season: bool = False,
) -> DataFrame:
    """One look-back frame of ``first``..``last`` days relative to each row."""
    horizon = {suffix: Horizon(first, last, within_season)}
    return with_history(df, entity, ts, horizon, sums=sums, means=means, count=count)


def history_at(
    df: DataFrame,
    entity: str,
    ts: str,
    horizons: Mapping[str, Horizon],
    rows: Column,
    **measures,
) -> DataFrame:
    """History of the rows that satisfy ``rows`` only.

    The filter may not run before the frames, or the history is lost. What may run
    before is a semi join on the entities that occur in the wanted rows.
    """
    wanted = df.where(rows)
    entities = wanted.select(entity).distinct()
    past = df.join(entities, on=entity, how="left_semi")
    history = daily_history(past, entity, ts, horizons, **measures)
    added = [c for c in history.columns if c not in (entity, DAY)]
    return (
        wanted.withColumn(DAY, day_number(ts))
        .join(history, on=[entity, DAY], how="left")
        .select(*df.columns, *added)
    )


def dedupe_entity_day(df: DataFrame, entity: str | Sequence[str], ts: str, order: str) -> DataFrame:
    """One row per (entity, day): the one with the lowest ``order`` value.

    A grouped minimum of (order, row), so a hot day is reduced before the shuffle.
    """
    entity = _names(entity)
    rest = [c for c in df.columns if c not in entity and c != order]
    row = F.struct(F.col(order), *[F.col(c) for c in rest])
    kept = (
        df.withColumn(DAY, day_number(ts))
        .groupBy(*entity, DAY)
        .agg(F.min_by(row, F.col(order)).alias("__row"))
    )
    return kept.select(
        *[F.col(c) if c in entity else F.col(f"__row.{c}").alias(c) for c in df.columns]
    )


def latest_with_ties(df: DataFrame, keys: str | Sequence[str], ts: str) -> DataFrame:
    """Rows at the latest time of their key, ties kept; rows without time or key are kept too.

    The maximum is combined before the shuffle. The rows meet it as the left side of a
    join with one right row per key.
    """
    keys = _names(keys)
    latest = (
        df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.max(ts).alias("__latest"))
    )
    joined = df.join(latest, on=keys, how="left")
    keep = F.col(ts).isNull() | (F.col(ts) == F.col("__latest"))
    for k in keys:
        keep = keep | F.col(k).isNull()
    return joined.where(keep).select(*df.columns)


def best_of_latest(
    df: DataFrame, key: str, ts: str, best: Mapping[str, Column | str]
) -> DataFrame:
    """Per key, the maximum of each column over what :func:`latest_with_ties` keeps.

    ``max(struct(time, value))`` finds the best value at the latest time in one combined
    aggregate, so the rows are neither joined nor shuffled whole.
    """
    dated = F.col(ts).isNotNull() & F.col(key).isNotNull()
    aggs = []
    for name, c in best.items():
        at_latest = F.max(F.when(dated, F.struct(F.col(ts).alias("t"), col(c).alias("v"))))
        undated = F.max(F.when(~dated, col(c)))
        aggs.append(F.greatest(at_latest["v"], undated).alias(name))
    return df.groupBy(key).agg(*aggs)


def next_gap(df: DataFrame, entity: str | Sequence[str], ts: str, name: str = "gap") -> DataFrame:
    """Whole days between a row and the entity's next later row, minus one.

    "Later" compares the full date-times, so two rows of one day are -1 apart. Rows with
    nothing later, and rows without entity or time, drop out. This looks ahead: do not
    use it as a predictor of the row's own outcome.

    A later row exists on the same day exactly when the row's time is below the day's
    maximum; otherwise the next day with any row decides. Both come from daily rows.
    :func:`listed_gap` gives the same without joining them back.
    """
    entity = _names(entity)
    rows = df.withColumn(DAY, day_number(ts)).where(F.col(DAY).isNotNull())
    following = Window.partitionBy(*entity).orderBy(DAY)
    days = (
        rows.groupBy(*entity, DAY)
        .agg(F.max(ts).alias("__last"))
        .withColumn("__next", F.lead(DAY).over(following))
    )
    gap = F.when(F.col(ts) < F.col("__last"), F.lit(-1)).otherwise(
        F.col("__next") - F.col(DAY) - 1
    )
    return (
        rows.join(days, on=[*entity, DAY], how="inner")
        .withColumn(name, gap.cast("bigint"))
        .where(F.col(name).isNotNull())
        .select(*df.columns, name)
    )


def listed_gap(df: DataFrame, entity: str, ts: str, key: str, name: str = "gap") -> DataFrame:
    """(key, gap) of :func:`next_gap`, by one move of the rows to their entity; a day's rows have to fit into a list."""
    rows = df.withColumn(DAY, day_number(ts)).where(F.col(DAY).isNotNull() & F.col(entity).isNotNull())
    days = rows.select(entity, DAY, ts, key).repartition(entity).groupBy(entity, DAY).agg(
        F.max(ts).alias("__last"), F.collect_list(F.struct(F.col(ts).alias("t"), F.col(key).alias("k"))).alias("__rows")
    )
    following = days.withColumn("__next", F.lead(DAY).over(Window.partitionBy(entity).orderBy(DAY)))
    gap = F.when(F.col("__row.t") < F.col("__last"), F.lit(-1)).otherwise(F.col("__next") - F.col(DAY) - 1)
    found = following.select(DAY, "__last", "__next", F.explode("__rows").alias("__row"))
    return found.select(F.col("__row.k").alias(key), gap.cast("bigint").alias(name)).where(F.col(name).isNotNull())
