"""Batting averages per career, season and last 100 days.

Inputs: ``batter_counts`` (game_id, team_id, batter, atBat, Hit, Walk, Home_Run), ``game``
(game_id, local_date), ``team`` (team_id, name_brief), ``atbat_r`` (batter, des).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorform.functions.dates import season, season_text
from priorform.functions.rates import guarded_ratio
from priorform.operators.ordering import row_index
from priorform.operators.summaries import entity_name
from priorform.operators.temporal import (
    CAREER_TO_DATE,
    CLOSED_100,
    OPEN_100,
    SEASON_TO_DATE,
    dedupe_entity_day,
    history_at,
    with_history,
)
from priorform.sources.sinks import stage

COUNTS = {"AB": "atBat", "hit": "Hit", "walk": "Walk", "HR": "Home_Run"}


def batter_names(atbat_r: DataFrame, order: str) -> DataFrame:
    """(batter, name): the first two words of a description; the one with the lowest ``order``."""
    return entity_name(atbat_r, "batter", "des", order)


def _labelled(totals: DataFrame, names: DataFrame, team: DataFrame) -> DataFrame:
    """Names and team beside totals: a batter has one name, and the lowest team id stands for his teams."""
    return (
        totals.join(names, on="batter", how="left")
        .join(team.select("team_id", F.col("name_brief").alias("team")), on="team_id", how="left")
        .withColumnsRenamed({"batter": "id", "team_id": "teamid"})
    )


def _totals(rows: DataFrame, *keys: Column | str) -> DataFrame:
    sums = [F.sum(c).alias(n) for n, c in COUNTS.items()]
    out = rows.groupBy(*keys).agg(F.min("team_id").alias("team_id"), *sums)
    return out.withColumn("bavg", guarded_ratio("hit", "AB"))


def career_totals(batter_counts: DataFrame, names: DataFrame, team: DataFrame) -> DataFrame:
    """Career sums and the ratio of sums per batter; totals first, then the lookups."""
    out = _labelled(_totals(batter_counts, "batter"), names, team)
    return out.select("id", "name", "teamid", "team", *COUNTS, "bavg")


def season_totals(
    batter_counts: DataFrame, game: DataFrame, names: DataFrame, team: DataFrame
) -> DataFrame:
    """The same per batter and season (as text); games without a date drop out."""
    dated = game.where(F.col("local_date").isNotNull()).select(
        "game_id", season_text("local_date").alias("year")
    )
    rows = batter_counts.join(dated, on="game_id", how="inner")
    out = _labelled(_totals(rows, "batter", "year"), names, team)
    return out.select("id", "name", "teamid", "team", *COUNTS, "bavg", "year")


def batter_games(batter_counts: DataFrame, game: DataFrame) -> DataFrame:
    """One row per batter and dated game: counts, their ratio, date, season."""
    dated = game.where(F.col("local_date").isNotNull()).select(
        "game_id", F.to_date("local_date").alias("local_date")
    )
    return (
        batter_counts.join(dated, on="game_id", how="inner")
        .select(
            F.col("batter").alias("batter_id"),
            F.col("team_id").alias("teamid"),
            F.col("game_id").alias("game"),
            *[F.col(c).alias(n) for n, c in COUNTS.items()],
            guarded_ratio("Hit", "atBat").alias("bavg"),
            "local_date",
            season("local_date").alias("season"),
        )
    )


def per_game_stats(
    batter_counts: DataFrame, game: DataFrame, names: DataFrame, team: DataFrame
) -> DataFrame:
    """One row per named batter and day (the lowest game of the day), numbered by batter and day."""
    day = dedupe_entity_day(batter_games(batter_counts, game), "batter_id", "local_date", "game")
    named = day.join(
        names.where(F.col("name").isNotNull()).withColumnRenamed("batter", "batter_id"), on="batter_id", how="inner"
    ).join(
        team.select(F.col("team_id").alias("teamid"), F.col("name_brief").alias("team")), on="teamid", how="left"
    )
    out = named.select(
        F.col("batter_id").alias("id"), "name", "teamid", "team", "game", *COUNTS, "bavg",
        F.col("local_date").alias("date"),
    )
    return row_index(stage(out), ["id", "date"], "idx")


def rolling_average(stats: DataFrame, *, keep_first: bool = False) -> DataFrame:
    """100-day sums and mean of per-game ratios per batter and day of :func:`per_game_stats`.

    Days without any game in the 100 days before are dropped unless ``keep_first``.
    """
    out = with_history(
        stats, "id", "date", {"100": CLOSED_100},
        sums={n: n for n in COUNTS}, means={"bavg": "bavg"}, count="num_game", way="in_place",
    ).select(
        "name", "id", "team", "teamid", "date",
        *[F.col(f"{n}_100").alias(f"100_day_{n.lower() if n == 'AB' else n}") for n in COUNTS],
        F.col("bavg_100").alias("100_day_bavg"),
        F.col("num_game_100").alias("num_game"),
    )
    return out if keep_first else out.where(F.col("num_game").isNotNull())


def batter_history(games: DataFrame) -> DataFrame:
    """Career, season and 100-day history of every batter and game in one pass.

    ``games`` is :func:`batter_games`, all games of a day counted.
    """
    return with_history(
        stage(games), "batter_id", "local_date",
        {"career": CAREER_TO_DATE, "season": SEASON_TO_DATE, "100": CLOSED_100},
        sums={n: n for n in COUNTS}, means={"bavg": "bavg"}, count="num_game",
    )


def hits_before_game(games: DataFrame, game: int) -> DataFrame:
    """Hits and at-bats in the 99 days before one game, for the batters of that game."""
    return history_at(
        games, "batter_id", "local_date", {"99": OPEN_100}, F.col("game") == F.lit(game).cast("bigint"),
        sums={"hits": "hit", "atbats": "AB"}, count=None,
    ).select(
        "game", "local_date", "batter_id",
        F.col("hits_99").alias("last_100_days_hits"), F.col("atbats_99").alias("last_100_days_atbats"),
    )
