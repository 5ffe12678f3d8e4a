"""Projections, joins, sides, rates and the wide game tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog import market
from priorform.catalog.market import sql_with
from priorform.catalog.registry import bigints, doubles, money, query, rounded
from priorform.catalog.temporal import _TEAM_MEASURES, _TEAM_SQL, TEAM_HISTORY_SQL
from priorform.functions.rates import (
    binary_label,
    clamp_upper,
    differences,
    guarded_ratio,
    null_rate,
    whip,
    win_rate,
)
from priorform.operators.sides import pair_sides
from priorform.plans import game_features as gf
from priorform.sources.tables import Tables


@query("scan_project", "select c_custkey as id, c_name as name, c_mktsegment as segment from customer")
def scan_project(t: Tables) -> DataFrame:
    """Projection and renaming; only the named columns are read."""
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )


@query(
    "left_join_chain",
    """
select l_orderkey, l_linenumber, l_partkey, o_custkey, c_name, n_name, s_name
from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey
left join nation on n_nationkey = c_nationkey left join supplier on s_suppkey = l_suppkey""",
)
def left_join_chain(t: Tables) -> DataFrame:
    """Lines with order, customer, nation and supplier; small lookups broadcast by their measured size."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    supplier = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return (
        lines.join(orders, on="l_orderkey", how="left")
        .join(customer, on="o_custkey", how="left")
        .join(nation, on="c_nationkey", how="left")
        .join(supplier, on="l_suppkey", how="left")
        .select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name", "n_name", "s_name")
    )


@query(
    "null_reject_join",
    """
select o_orderkey, l_partkey, split_part(cast(cast(o_orderdate as date) as varchar), '-', 1) as year
from lineitem left join orders on o_orderkey = l_orderkey
where split_part(cast(cast(o_orderdate as date) as varchar), '-', 1) is not null""",
)
def null_reject_join(t: Tables) -> DataFrame:
    """A left join whose filter drops unmatched rows, planned as an inner join."""
    year = F.substring_index(F.to_date("o_orderdate").cast("string"), "-", 1)
    return (
        t.lineitem.select("l_orderkey", "l_partkey")
        .join(t.orders.select("o_orderkey", "o_orderdate"), on=F.col("o_orderkey") == F.col("l_orderkey"), how="left")
        .where(year.isNotNull())
        .select("o_orderkey", "l_partkey", year.alias("year"))
    )


@query(
    "inner_two_key",
    sql_with("game", "team_results")
    + "\nselect g.game_id, g.home_team_id, r.win_lose from game g join team_results r"
    " on g.game_id = r.game_id and g.home_team_id = r.team_id",
)
def inner_two_key(t: Tables) -> DataFrame:
    """Games with the home team's result."""
    return gf.labelled_games(market.game_tables(t)).select("game_id", "home_team_id", "win_lose")


_SIDES_SQL = sql_with("batter_counts") + """,
team_per_game as (select game_id, team_id, homeTeam as home_team, cast(sum(Hit) as bigint) as hit, cast(sum(Home_Run) as bigint) as HR
                  from batter_counts group by game_id, team_id, homeTeam)"""


def _side_rows(t: Tables) -> DataFrame:
    return (
        market.batter_counts(t)
        .groupBy("game_id", "team_id", F.col("homeTeam").alias("home_team"))
        .agg(F.sum("Hit").alias("hit"), F.sum("Home_Run").alias("HR"))
    )


_SIDE_COLUMNS = {"team_id": ("home_team_id", "away_team_id"), "hit": ("hit_home", "hit_away"), "HR": ("HR_home", "HR_away")}


@query(
    "pair_sides",
    _SIDES_SQL
    + """
select t1.game_id, t1.team_id as home_team_id, t2.team_id as away_team_id, t1.hit as hit_home, t2.hit as hit_away,
       t1.HR as HR_home, t2.HR as HR_away
from (select * from team_per_game where home_team = 1) t1
right join (select * from team_per_game where home_team = 0) t2 on t1.game_id = t2.game_id""",
)
def pair_sides_query(t: Tables) -> DataFrame:
    """Home and away rows of a game side by side."""
    return pair_sides(_side_rows(t), "game_id", "home_team", _SIDE_COLUMNS)


@query(
    "side_diff",
    _SIDES_SQL
    + """
select t1.game_id, t1.hit - t2.hit as hit_diff, t1.HR - t2.HR as HR_diff
from (select * from team_per_game where home_team = 1) t1
right join (select * from team_per_game where home_team = 0) t2 on t1.game_id = t2.game_id""",
)
def side_diff(t: Tables) -> DataFrame:
    """Home minus away."""
    pairs = pair_sides(_side_rows(t), "game_id", "home_team", _SIDE_COLUMNS)
    return pairs.select("game_id", *differences([("hit_home", "hit_away", "hit_diff"), ("HR_home", "HR_away", "HR_diff")]))


@query(
    "guarded_ratio",
    """
select l_orderkey, l_partkey, l_linenumber, l_extendedprice,
       round(case when l_discount = 0 then 0.0 else l_tax / l_discount end, 6) as tax_per_discount from lineitem""",
)
def guarded(t: Tables) -> DataFrame:
    """A ratio that is 0 for a zero denominator."""
    out = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", guarded_ratio("l_tax", "l_discount").alias("tax_per_discount")
    )
    return rounded(out, "tax_per_discount")


@query(
    "per_game_ratio_scaled",
    sql_with("pitcher_counts")
    + """
select pitcher, game_id, round(case when plateApperance = 0 then 0.0
       else (Walk + Hit) / (cast(plateApperance as double) / 3) end, 6) as WHIP from pitcher_counts""",
)
def scaled(t: Tables) -> DataFrame:
    """Walks and hits per third of the appearances."""
    out = market.pitcher_counts(t).select("pitcher", "game_id", whip("Walk", "Hit", "plateApperance").alias("WHIP"))
    return rounded(out, "WHIP")


@query(
    "null_rate",
    "select l_orderkey, l_partkey, l_linenumber, l_extendedprice, round(l_tax / nullif(l_discount, 0), 6) as rate from lineitem",
)
def null_rate_query(t: Tables) -> DataFrame:
    """A ratio that is NULL for a zero denominator."""
    out = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", null_rate("l_tax", "l_discount").alias("rate")
    )
    return rounded(out, "rate")


@query(
    "win_rate",
    """
select o_custkey, cast(w as bigint) as w, cast(l as bigint) as l,
       round(case when w + l > 0 then w / cast(w + l as double) else 0.0 end, 6) as win_rate
from (select o_custkey, count(*) filter (where o_orderstatus = 'F') as w, count(*) filter (where o_orderstatus = 'O') as l
      from orders group by o_custkey)""",
)
def win_rate_query(t: Tables) -> DataFrame:
    """Share of filled among decided orders, 0 without any."""
    counts = t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("w"), F.count_if(F.col("o_orderstatus") == "O").alias("l")
    )
    return rounded(counts.withColumn("win_rate", win_rate("w", "l")), "win_rate")


@query("binary_label", "select o_orderkey, case when upper(o_orderstatus) = 'F' then 1 else 0 end as label from orders")
def binary(t: Tables) -> DataFrame:
    """1 for filled orders."""
    return t.orders.select("o_orderkey", binary_label("o_orderstatus", "F").alias("label"))


@query(
    "clamp_upper",
    "select s_suppkey, case when s_acctbal > -100 then -100.0 else s_acctbal end as clamped from supplier",
)
def clamp(t: Tables) -> DataFrame:
    """Balances above -100 become -100."""
    return doubles(t.supplier.select("s_suppkey", clamp_upper("s_acctbal", -100.0).alias("clamped")), "clamped")


@query("point_filter", "select o_orderkey, o_custkey, o_totalprice from orders where o_custkey = cast('40' as bigint)")
def point_filter(t: Tables) -> DataFrame:
    """Rows of one entity; the comparison reaches the parquet scan."""
    return t.orders.where(F.col("o_custkey") == F.lit("40").cast("bigint")).select("o_orderkey", "o_custkey", "o_totalprice")


# --- the wide tables ---------------------------------------------------------------------

_FRAMES = {
    "100": "datediff('day', b.local_date, a.local_date) between 1 and 100",
    "season": "datediff('day', b.local_date, a.local_date) > 1 and a.season = b.season",
    "career": "datediff('day', b.local_date, a.local_date) > 1",
}
_COUNTS = (*gf.PITCHER_COUNTS, "WHIP")
_PITCHER_SQL = """pitcher_per_game as (
  select p.*, case when plateApperance = 0 then 0.0 else (Walk + Hit) / (cast(plateApperance as double) / 3) end as WHIP,
         cast(o_orderdate as date) as local_date, year(o_orderdate) as season
  from pitcher_counts p join orders on o_orderkey = p.game_id where o_orderdate is not null
),
history as (
  select a.pitcher, a.game_id""" + "".join(
    "".join(
        f",\n    sum(case when {c} then b.\"{m}\" end) as \"{m}_{s}\"" if m == "WHIP"
        else f",\n    cast(sum(case when {c} then b.\"{m}\" end) as bigint) as \"{m}_{s}\""
        for m in _COUNTS
    )
    + f",\n    cast(sum(case when {c} then 1 end) as bigint) as \"num_game_{s}\""
    for s, c in _FRAMES.items()
) + """
  from pitcher_per_game a left join pitcher_per_game b on a.pitcher = b.pitcher
  group by a.pitcher, a.game_id
)"""
_ODDS_SQL = """odds as (
  select game_id, max(home_line) as home_best_odds, max(away_line) as away_best_odds
  from (select po.* from pregame_odds po left join pregame_odds b on po.game_id = b.game_id and po.capture_date < b.capture_date
        where b.capture_date is null) group by game_id
)"""
_SIDE_NAMES = (("home", "hp"), ("away", "ap"))
_RECENT = (*_COUNTS, "num_game")


def _features_sql() -> str:
    out = [
        "g.game_id", "case when tr.win_lose = 'W' then 1 else 0 end as home_team_wins", "g.home_team_id", "g.away_team_id",
        "g.local_date",
    ]
    out += [f"case when g.{s}_w + g.{s}_l > 0 then g.{s}_w / cast(g.{s}_w + g.{s}_l as double) else 0.0 end as {s}_win_rate" for s, _ in _SIDE_NAMES]
    out += ["g.home_pitcher", "g.away_pitcher"]
    for s, p in _SIDE_NAMES:
        out += [f'{p}."{m}_100" as "{s}_pitcher_{m}_100"' for m in _RECENT]
        out += [f"pg.{s}_throwinghand", f"pg.{s}_streak as {s}_team_streak"]
        out += [f"pg.{s}_{f} as {s}_pitcher_season_{f}" for f in ("wins", "losses", "hits", "runs", "errors")]
        out += [f"po.{s}_best_odds", f"{p}.Hit_100 / cast(nullif({p}.atBat_100, 0) as double) as {s}_pitcher_hit_rate_100"]
        out += [f'{p}."{m}_season" as "{s}_pitcher_{m}_season"' for m in ("Home_Run", "Walk", "WHIP", "Strikeout", "num_game")]
        out += [
            f"{p}.{m}_season / cast(nullif({p}.atBat_season, 0) as double) as {s}_pitcher_{n}_rate_season"
            for m, n in (("Hit", "hit"), ("Walk", "walk"), ("Home_Run", "HR"))
        ]
        out += [f"{p}.{m}_career as {s}_pitcher_{m}_career" for m in ("Strikeout", "Home_Run", "Walk")]
        out += [f"{p}.Home_Run_career / cast(nullif({p}.atBat_career, 0) as double) as {s}_pitcher_HR_rate_career"]
    return "features as (\n  select " + ",\n    ".join(out) + """
  from game g left join history hp on g.home_pitcher = hp.pitcher and hp.game_id = g.game_id
  left join history ap on g.away_pitcher = ap.pitcher and ap.game_id = g.game_id
  join team_results tr on g.game_id = tr.game_id and g.home_team_id = tr.team_id
  left join pregame_detail pg on g.game_id = pg.game_id left join odds po on g.game_id = po.game_id
)"""


_BASE_SQL = (
    sql_with("game", "pitcher_counts", "batter_counts", "team_results", "pregame_detail", "pregame_odds")
    + ",\n" + _PITCHER_SQL + ",\n" + _ODDS_SQL + ",\n" + _features_sql()
)
_RATES = [f"{s}_win_rate" for s, _ in _SIDE_NAMES] + [
    f"{s}_pitcher_{n}"
    for s, _ in _SIDE_NAMES
    for n in ("WHIP_100", "WHIP_season", "hit_rate_100", "hit_rate_season", "walk_rate_season", "HR_rate_season", "HR_rate_career")
]


def _rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns)


@query("game_features", _BASE_SQL + f"\nselect * replace ({_rounded_sql(_RATES)}) from features")
def game_features(t: Tables) -> DataFrame:
    """The first wide table, 75 columns per game."""
    return rounded(gf.game_features(market.game_tables(t)), *_RATES)


def _features_2_sql() -> str:
    out = [
        "g.game_id", "g.home_team_wins", "g.home_team_id", "g.away_team_id", "g.local_date", "g.home_throwinghand",
        "g.away_throwinghand", "g.home_team_streak", "g.away_team_streak", "g.home_win_rate - g.away_win_rate as win_rate_diff",
    ]
    out += [f'g."home_pitcher_{c}" - g."away_pitcher_{c}" as "pitcher_{n}"' for c, n in gf.PITCHER_DIFFS.items()]
    out += [f"g.{s}_pitcher_season_wins - g.{s}_pitcher_season_losses as {s}_pitcher_W_L_diff" for s, _ in _SIDE_NAMES]
    team = {n: m for m, n in gf.TEAM_PAIRS.items()}
    out += [f"t1.{team[c]}_99 - t2.{team[c]}_99 as {n}" for c, n in gf.TEAM_DIFFS.items()]
    return "features_2 as (\n  select " + ",\n    ".join(out) + """
  from features g left join (select * from team_100_split where home_team = 1) t1 on t1.game_id = g.game_id
  left join (select * from team_100_split where home_team = 0) t2 on t2.game_id = t1.game_id
)"""


_BASE_2_SQL = _BASE_SQL + ",\n" + _TEAM_SQL + ",\n" + TEAM_HISTORY_SQL + ",\n" + _features_2_sql()
_RATE_DIFFS = ["win_rate_diff"] + [
    f"pitcher_{gf.PITCHER_DIFFS[c]}"
    for c in ("WHIP_100", "WHIP_season", "hit_rate_100", "hit_rate_season", "walk_rate_season", "HR_rate_season", "HR_rate_career")
]
_INT_DIFFS = [n for n in (*(f"pitcher_{v}" for v in gf.PITCHER_DIFFS.values()), *gf.TEAM_DIFFS.values()) if n not in _RATE_DIFFS]


@query("game_features_2", _BASE_2_SQL + f"\nselect * replace ({_rounded_sql(_RATE_DIFFS)}) from features_2")
def game_features_2(t: Tables) -> DataFrame:
    """The 43 differences."""
    tables = market.game_tables(t)
    out = gf.game_features_2(gf.game_features(tables), gf.team_pairs(tables))
    return rounded(bigints(out, *_INT_DIFFS), *_RATE_DIFFS)


_DAYS_OFF_SQL = ",\n".join(
    f"""{s}_off as (select p1.game_id, datediff('day', p1.local_date, min(p2.local_date)) - 1 as g from features p1 join features p2
         on p1.{s}_team_id = p2.{s}_team_id where p1.local_date < p2.local_date group by p1.game_id, p1.local_date)"""
    for s, _ in _SIDE_NAMES
)


@query(
    "game_features_3",
    _BASE_2_SQL + ",\n" + _DAYS_OFF_SQL
    + f"""
select gf.* replace ({_rounded_sql([f'gf.{c}' for c in _RATE_DIFFS]).replace(' as gf.', ' as ')}),
       cast(h.g - a.g as bigint) as days_off_diff,
       case when f.home_best_odds > -100 then -100 else f.home_best_odds end as home_negative_odds
from features_2 gf left join home_off h on gf.game_id = h.game_id left join away_off a on gf.game_id = a.game_id
left join features f on gf.game_id = f.game_id""",
)
def game_features_3(t: Tables) -> DataFrame:
    """The final table, 54 columns per game, in one plan."""
    out = gf.all_features(market.game_tables(t))
    return rounded(bigints(out, *_INT_DIFFS, "home_negative_odds"), *_RATE_DIFFS)
