"""History frames, latest values and gaps. The SQL twins use self-joins and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog import market
from priorform.catalog.market import CUSTOMER_GAMES_SQL, sql_with
from priorform.catalog.registry import bigints, doubles, money, query, rounded
from priorform.operators.ordering import row_index
from priorform.operators.temporal import (
    CAREER_TO_DATE,
    CLOSED_100,
    OPEN_100,
    SEASON_TO_DATE,
    best_of_latest,
    dedupe_entity_day,
    latest_with_ties,
    next_gap,
    with_history,
)
from priorform.plans import batting, game_features
from priorform.sources.tables import Tables


def _orders_history_sql(condition: str, suffix: str) -> str:
    c = f"case when {condition} then"
    return f"""
select a.o_orderkey, a.o_custkey,
       cast(sum({c} cast(b.o_totalprice as decimal(18,2)) end) as double) as total_{suffix},
       round(avg({c} b.o_totalprice end), 6) as mean_{suffix},
       cast(sum({c} 1 end) as bigint) as n_{suffix}
from orders a left join orders b on a.o_custkey = b.o_custkey
group by a.o_orderkey, a.o_custkey"""


def _orders_history(t: Tables, horizon, suffix: str) -> DataFrame:
    out = with_history(
        t.orders, "o_custkey", "o_orderdate", {suffix: horizon},
        sums={"total": money("o_totalprice")}, means={"mean": money("o_totalprice")},
    ).select("o_orderkey", "o_custkey", f"total_{suffix}", f"mean_{suffix}", f"n_{suffix}")
    return bigints(rounded(doubles(out, f"total_{suffix}"), f"mean_{suffix}"), f"n_{suffix}")


DAYS = "datediff('day', b.o_orderdate, a.o_orderdate)"


@query("rolling_100_sum", _orders_history_sql(f"{DAYS} between 1 and 100", "100"))
def rolling_100_sum(t: Tables) -> DataFrame:
    """Order value over the 100 days before each order, per customer."""
    return _orders_history(t, CLOSED_100, "100")


@query("career_to_date", _orders_history_sql(f"{DAYS} > 1", "career"))
def career_to_date(t: Tables) -> DataFrame:
    """Order value up to two days before each order."""
    return _orders_history(t, CAREER_TO_DATE, "career")


@query("season_to_date", _orders_history_sql(f"{DAYS} > 1 and year(a.o_orderdate) = year(b.o_orderdate)", "season"))
def season_to_date(t: Tables) -> DataFrame:
    """The same within the calendar year."""
    return _orders_history(t, SEASON_TO_DATE, "season")


_ROLLING_SQL = f"""
with {CUSTOMER_GAMES_SQL},
stats as (
  select * from (select g.*, n.name, s.s_name as team,
                        row_number() over (partition by g.batter_id, g.local_date order by g.game) as pick
                 from batter_games g left join names n on n.batter = g.batter_id
                 left join supplier s on s.s_suppkey = g.teamid where n.name is not null) where pick = 1
)
select p1.batter_id as id, p1.local_date as date, any_value(p1.name) as name, any_value(p1.team) as team,
       any_value(p1.teamid) as teamid,
       cast(sum(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then p2.AB end) as bigint) as "100_day_ab",
       cast(sum(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then p2.hit end) as bigint) as "100_day_hit",
       cast(sum(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then p2.walk end) as bigint) as "100_day_walk",
       cast(sum(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then p2.HR end) as bigint) as "100_day_HR",
       round(avg(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then p2.bavg end), 6) as "100_day_bavg",
       cast(sum(case when datediff('day', p2.local_date, p1.local_date) between 1 and 100 then 1 end) as bigint) as num_game
from stats p1 left join stats p2 on p1.name = p2.name and p1.batter_id = p2.batter_id
group by p1.batter_id, p1.local_date"""


def _stats(t: Tables) -> DataFrame:
    names = batting.batter_names(market.descriptions(t), "batter")
    return batting.per_game_stats(market.customer_games(t), market.dated_orders(t), names, market.teams(t))


@query("rolling_avg", _ROLLING_SQL)
def rolling_avg(t: Tables) -> DataFrame:
    """100-day sums and mean of per-game ratios per batter and day."""
    return rounded(batting.rolling_average(_stats(t), keep_first=True), "100_day_bavg")


@query("rolling_avg_nonnull", f"select * from ({_ROLLING_SQL}) where num_game is not null")
def rolling_avg_nonnull(t: Tables) -> DataFrame:
    """The same without days that have no history."""
    return rounded(batting.rolling_average(_stats(t)), "100_day_bavg")


@query(
    "per_game_stats",
    f"""
with {CUSTOMER_GAMES_SQL}
select row_number() over (order by batter_id, local_date) as idx, batter_id as id, name, teamid, team, game, AB, hit, walk, HR,
       round(bavg, 6) as bavg, local_date as date
from (select g.*, n.name, s.s_name as team,
             row_number() over (partition by g.batter_id, g.local_date order by g.game) as pick
      from batter_games g join names n on n.batter = g.batter_id left join supplier s on s.s_suppkey = g.teamid)
where pick = 1""",
)
def per_game_stats(t: Tables) -> DataFrame:
    """One row per batter and day, numbered, with the per-game ratio."""
    return rounded(_stats(t), "bavg")


_BATTER_FRAMES = {
    "career": "datediff('day', b.local_date, a.local_date) > 1",
    "season": "datediff('day', b.local_date, a.local_date) > 1 and year(a.local_date) = year(b.local_date)",
    "100": "datediff('day', b.local_date, a.local_date) between 1 and 100",
}


@query(
    "batter_history",
    f"with {CUSTOMER_GAMES_SQL}\nselect a.batter_id, a.game"
    + "".join(
        "".join(f",\n cast(sum(case when {c} then b.{m} end) as bigint) as \"{m}_{s}\"" for m in ("AB", "hit", "walk", "HR"))
        + f",\n round(avg(case when {c} then b.bavg end), 6) as \"bavg_{s}\""
        + f",\n cast(sum(case when {c} then 1 end) as bigint) as \"num_game_{s}\""
        for s, c in _BATTER_FRAMES.items()
    )
    + "\nfrom batter_games a left join batter_games b on a.batter_id = b.batter_id group by a.batter_id, a.game",
)
def batter_history(t: Tables) -> DataFrame:
    """Career, season and 100-day batting history of every game, in one pass."""
    games = batting.batter_games(market.customer_games(t), market.dated_orders(t))
    out = batting.batter_history(games)
    keep = [f"{m}_{s}" for s in _BATTER_FRAMES for m in ("AB", "hit", "walk", "HR", "bavg", "num_game")]
    out = out.select("batter_id", "game", *keep)
    return rounded(out, *[f"bavg_{s}" for s in _BATTER_FRAMES])


POINT_GAME = 1000


@query(
    "rolling_99_point",
    sql_with("pitcher_counts")
    + f""",
games as (select p.pitcher as batter_id, p.game_id as game, p.atBat as AB, p.Hit as hit, cast(o_orderdate as date) as local_date
          from pitcher_counts p join orders on o_orderkey = p.game_id)
select a.game, a.local_date, a.batter_id,
       cast((select sum(b.hit) from games b where b.local_date > a.local_date - interval 100 day
             and b.local_date < a.local_date and b.batter_id = a.batter_id) as bigint) as last_100_days_hits,
       cast((select sum(b.AB) from games b where b.local_date > a.local_date - interval 100 day
             and b.local_date < a.local_date and b.batter_id = a.batter_id) as bigint) as last_100_days_atbats
from games a where a.game = {POINT_GAME}""",
)
def rolling_99_point(t: Tables) -> DataFrame:
    """The 99 days before one game, for the players of that game."""
    games = batting.batter_games(market.player_games(t), market.dated_orders(t))
    return batting.hits_before_game(games, POINT_GAME)


_TEAM_MEASURES = list(game_features.TEAM_COUNTS)
_TEAM_SQL = (
    "team_per_game as (\n  select b.game_id, b.team_id, b.homeTeam as home_team, cast(o_orderdate as date) as local_date"
    + "".join(f", cast(sum(b.{c}) as bigint) as {n}" for n, c in game_features.TEAM_COUNTS.items())
    + "\n  from batter_counts b left join orders on o_orderkey = b.game_id group by b.game_id, b.team_id, b.homeTeam, o_orderdate\n)"
)
TEAM_HISTORY_SQL = (
    "team_100_split as (\n  select a.game_id, a.team_id, a.home_team, a.local_date, cast(sum(case when b.team_id is not null then 1 end) as bigint) as games_99"
    + "".join(f", cast(sum(b.{m}) as bigint) as {m}_99" for m in _TEAM_MEASURES)
    + """
  from team_per_game a left join team_per_game b on a.team_id = b.team_id
       and b.local_date > a.local_date - interval 100 day and b.local_date < a.local_date
  group by a.game_id, a.team_id, a.home_team, a.local_date
)"""
)


@query("team_per_game", sql_with("batter_counts") + ",\n" + _TEAM_SQL + "\nselect * from team_per_game")
def team_per_game(t: Tables) -> DataFrame:
    """Team sums per game."""
    return bigints(game_features.team_per_game(market.game_tables(t)), *_TEAM_MEASURES)


@query(
    "team_rolling_99",
    sql_with("batter_counts") + ",\n" + _TEAM_SQL
    + "\nselect a.game_id, a.team_id, cast((select sum(1) from team_per_game b where b.local_date > a.local_date - interval 100 day"
    " and b.local_date < a.local_date and a.team_id = b.team_id) as bigint) as games_99"
    + "".join(
        f",\n cast((select sum(b.{m}) from team_per_game b where b.local_date > a.local_date - interval 100 day"
        f" and b.local_date < a.local_date and a.team_id = b.team_id) as bigint) as {m}_99"
        for m in _TEAM_MEASURES
    )
    + "\nfrom team_per_game a",
)
def team_rolling_99(t: Tables) -> DataFrame:
    """Twelve sums over the open 100-day look-back per team and game."""
    out = game_features.team_history(market.game_tables(t))
    names = ["games_99", *[f"{m}_99" for m in _TEAM_MEASURES]]
    return bigints(out.select("game_id", "team_id", *names), *names)


@query(
    "dedupe_entity_day",
    """
select o_custkey, o_orderkey, o_orderdate, o_totalprice, o_orderstatus
from (select *, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey) as pick from orders)
where pick = 1""",
)
def dedupe(t: Tables) -> DataFrame:
    """One order per customer and day, the lowest key."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return dedupe_entity_day(rows, "o_custkey", "o_orderdate", "o_orderkey")


@query(
    "row_index",
    "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as idx from orders",
)
def row_number(t: Tables) -> DataFrame:
    """Global position by customer and key, without a single-task window."""
    return row_index(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "idx")


@query(
    "latest_with_ties",
    """
with po as (select event_id, user_id, cast(ts as date) as day, value from events)
select po.event_id, po.user_id, po.day, po.value
from po left join po b on po.user_id = b.user_id and po.day < b.day where b.day is null""",
)
def latest(t: Tables) -> DataFrame:
    """Events on the last day of their user."""
    rows = t.events.select("event_id", "user_id", F.to_date("ts").alias("day"), "value")
    return latest_with_ties(rows, "user_id", "day")


@query(
    "best_odds",
    """
with po as (select event_id, user_id, cast(ts as date) as day, value, event_type from events),
     safe as (select po.* from po left join po b on po.user_id = b.user_id and po.day < b.day where b.day is null)
select user_id, max(value) as best_value, max(event_type) as best_type from safe group by user_id""",
)
def best(t: Tables) -> DataFrame:
    """Best values per user over the events of the last day."""
    rows = t.events.select("user_id", F.to_date("ts").alias("day"), "value", "event_type")
    return best_of_latest(rows, "user_id", "day", {"best_value": "value", "best_type": "event_type"})


@query(
    "next_event_gap",
    """
select a.event_id, a.user_id, cast(datediff('day', a.ts, min(b.ts)) - 1 as bigint) as gap
from events a join events b on a.user_id = b.user_id and a.ts < b.ts group by a.event_id, a.user_id, a.ts""",
)
def gap(t: Tables) -> DataFrame:
    """Days between an event and the user's next one, less one."""
    return next_gap(t.events.select("event_id", "user_id", "ts"), "user_id", "ts").select("event_id", "user_id", "gap")


@query(
    "gap_diff",
    sql_with("game")
    + """,
home as (select p1.game_id, datediff('day', p1.local_date, min(p2.local_date)) - 1 as g from game p1 join game p2
         on p1.home_team_id = p2.home_team_id where p1.local_date < p2.local_date group by p1.game_id, p1.local_date),
away as (select p1.game_id, datediff('day', p1.local_date, min(p2.local_date)) - 1 as g from game p1 join game p2
         on p1.away_team_id = p2.away_team_id where p1.local_date < p2.local_date group by p1.game_id, p1.local_date)
select game.game_id, cast(home.g as bigint) as home_days_off, cast(away.g as bigint) as away_days_off,
       cast(home.g - away.g as bigint) as days_off_diff
from game left join home on home.game_id = game.game_id left join away on away.game_id = game.game_id""",
)
def gap_diff(t: Tables) -> DataFrame:
    """Difference of the gaps of both sides of a game."""
    games = market.game(t).select("game_id", "local_date", "home_team_id", "away_team_id")
    home, away = (game_features.days_off(games, side) for side in ("home", "away"))
    return (
        games.select("game_id")
        .join(home, on="game_id", how="left")
        .join(away, on="game_id", how="left")
        .withColumn("days_off_diff", F.col("home_days_off") - F.col("away_days_off"))
    )
