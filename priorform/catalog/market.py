"""The sample tables in the roles of the game tables, as frames and as SQL.

Orders are games, suppliers are teams, parts are players, lines are appearances. Counts
are small integers derived from the line's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.plans.game_features import GameTables
from priorform.sources.sinks import stage
from priorform.sources.tables import Tables

# Count -> SQL over a line, valid in both engines.
LINE_COUNTS = {
    "atBat": "cast(l_quantity as bigint)",
    "Hit": "cast(round(l_discount * 100) as bigint)",
    "toBase": "cast(l_quantity as bigint) + l_linenumber",
    "Home_Run": "cast(round(l_tax * 100) as bigint)",
    "Strikeout": "cast(l_linenumber as bigint)",
    "Grounded_Into_DP": "case when l_returnflag = 'R' and l_linestatus = 'O' then 1 else 0 end",
    "Ground_Out": "case when l_returnflag = 'R' then 1 else 0 end",
    "Line_Out": "case when l_returnflag = 'A' then 1 else 0 end",
    "Pop_Out": "case when l_returnflag = 'N' then 1 else 0 end",
    "Walk": "case when l_linestatus = 'O' then 1 else 0 end",
    "Double_Play": "case when l_discount > 0.05 then 1 else 0 end",
    "Triple_Play": "case when l_tax > 0.04 then 1 else 0 end",
}
PITCHER_SUMS = {
    "atBat": "cast(l_quantity as bigint)",
    "plateApperance": "cast(l_quantity as bigint) + l_linenumber",
    "Hit": "cast(round(l_discount * 100) as bigint)",
    "Single": "case when l_returnflag = 'R' then 1 else 0 end",
    "Double": "case when l_returnflag = 'A' then 1 else 0 end",
    "Triple": "case when l_returnflag = 'N' then 1 else 0 end",
    "Home_Run": "cast(round(l_tax * 100) as bigint)",
    "Walk": "case when l_linestatus = 'O' then 1 else 0 end",
    "Strikeout": "cast(l_linenumber as bigint)",
    "Hit_By_Pitch": "case when l_discount > 0.05 then 1 else 0 end",
}


LINES_PER_TASK = 400_000


def by_order(t: Tables, lines: DataFrame) -> DataFrame:
    """Lines moved to their order. Beyond the rows of one task their number decides the number of partitions, so that
    neither a fixed number of these nor their merging lets a task's sorted and grouped rows grow with the table."""
    spark, parts = lines.sparkSession, -(-t.lineitem.count() // LINES_PER_TASK)
    if parts <= 1:
        return lines.repartition("l_orderkey")
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(max(parts, cores), "l_orderkey")


def sides(t: Tables) -> DataFrame:
    """Per order: lowest supplier as home, highest other supplier as away, and a part of each."""
    # narrow rows move whole: two pairs per order, combined before, are wider than its lines
    lines = by_order(t, t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey"))
    low = F.min(F.struct(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")))
    high = F.min(F.struct((-F.col("l_suppkey")).alias("s"), F.col("l_partkey").alias("p")))
    both = lines.groupBy(F.col("l_orderkey").alias("game_id")).agg(low.alias("h"), high.alias("a"))
    two = F.col("h.s") != -F.col("a.s")
    return both.select(
        "game_id",
        F.col("h.s").alias("home_team_id"),
        F.when(two, -F.col("a.s")).alias("away_team_id"),
        F.col("h.p").alias("home_pitcher"),
        F.when(two, F.col("a.p")).alias("away_pitcher"),
    )


def game(t: Tables) -> DataFrame:
    """Games with both sides; stored, as the table it stands for would be."""
    team = t.supplier.select(
        F.col("s_suppkey").alias("k"),
        F.col("s_nationkey").cast("bigint").alias("w"),
        F.floor(F.col("s_acctbal") / 1000).cast("bigint").alias("l"),
    )
    home, away = (team.select(*[F.col(c).alias(f"{side}_{c}") for c in ("k", "w", "l")]) for side in ("home", "away"))
    found = sides(t)
    return (
        t.orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("local_date"))
        .join(found, on="game_id", how="left")
        .join(home, on=F.col("home_team_id") == F.col("home_k"), how="left")
        .join(away, on=F.col("away_team_id") == F.col("away_k"), how="left")
        .drop("home_k", "away_k")
    )


def batter_counts(t: Tables, games: DataFrame | None = None) -> DataFrame:
    """Lines with counts; the flag is 1 for the home supplier, 0 for the away one, else NULL."""
    who = (sides(t) if games is None else games).select("game_id", "home_team_id", "away_team_id")
    # lines move by order as they are: the counts made of them are wider
    lines = by_order(t, t.lineitem).select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_suppkey").alias("team_id"),
        F.col("l_partkey").alias("batter"),
        *[F.expr(e).cast("bigint").alias(n) for n, e in LINE_COUNTS.items()],
    )
    flag = F.when(F.col("team_id") == F.col("home_team_id"), 1).when(F.col("team_id") == F.col("away_team_id"), 0)
    return lines.join(who, on="game_id").withColumn("homeTeam", flag).drop("home_team_id", "away_team_id")


def pitcher_counts(t: Tables) -> DataFrame:
    """Lines summed by part and order; they move by order, so that what is joined by order finds them in place."""
    return by_order(t, t.lineitem).groupBy(F.col("l_partkey").alias("pitcher"), F.col("l_orderkey").alias("game_id")).agg(
        F.min("l_suppkey").alias("team_id"),
        *[F.sum(F.expr(e)).cast("bigint").alias(n) for n, e in PITCHER_SUMS.items()],
    )


def team_results(t: Tables, games: DataFrame) -> DataFrame:
    """Open orders are lost, filled ones won; pending orders have no result."""
    done = t.orders.where(F.col("o_orderstatus").isin("F", "O")).select(
        F.col("o_orderkey").alias("game_id"), F.when(F.col("o_orderstatus") == "F", "W").otherwise("L").alias("win_lose")
    )
    known = games.where(F.col("home_team_id").isNotNull()).select("game_id", F.col("home_team_id").alias("team_id"))
    return done.join(known, on="game_id")


def pregame_detail(t: Tables, games: DataFrame) -> DataFrame:
    part = t.part.select(
        F.col("p_partkey").alias("k"), F.col("p_type").alias("throwinghand"),
        (F.col("p_size") - F.length("p_name")).cast("bigint").alias("streak"),
        F.col("p_size").cast("bigint").alias("wins"), F.length("p_name").cast("bigint").alias("losses"),
        (F.col("p_size") + F.length("p_name")).cast("bigint").alias("hits"),
        F.floor("p_retailprice").cast("bigint").alias("runs"), F.length("p_brand").cast("bigint").alias("errors"),
    )
    home, away = (part.select(*[F.col(c).alias(f"{side}_{c}") for c in part.columns]) for side in ("home", "away"))
    return (
        games.select("game_id", "home_pitcher", "away_pitcher")
        .join(home, on=F.col("home_pitcher") == F.col("home_k"), how="left")
        .join(away, on=F.col("away_pitcher") == F.col("away_k"), how="left")
        .drop("home_pitcher", "away_pitcher", "home_k", "away_k")
    )


def pregame_odds(t: Tables) -> DataFrame:
    """Lines as odds captured on the ship date."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("game_id"), F.col("l_shipdate").alias("capture_date"),
        (F.lit(-75) - F.col("l_quantity").cast("bigint")).alias("home_line"),
        (F.lit(-90) - 3 * F.round(F.col("l_tax") * 100).cast("bigint")).alias("away_line"),
    )


def game_tables(t: Tables) -> GameTables:
    games = stage(game(t))
    return GameTables(
        game=games, pitcher_counts=pitcher_counts(t), batter_counts=batter_counts(t, games),
        team_results=team_results(t, games), pregame_detail=pregame_detail(t, games), pregame_odds=pregame_odds(t),
    )


_SIDES = """
sides as (
  select game_id, home_team_id, away_team_id,
         (select min(l_partkey) from lineitem l where l.l_orderkey = b.game_id and l.l_suppkey = b.home_team_id) as home_pitcher,
         (select min(l_partkey) from lineitem l where l.l_orderkey = b.game_id and l.l_suppkey = b.away_team_id) as away_pitcher
  from (select l_orderkey as game_id, min(l_suppkey) as home_team_id,
               case when max(l_suppkey) <> min(l_suppkey) then max(l_suppkey) end as away_team_id
        from lineitem group by l_orderkey) b
)"""

SQL_TABLES = {
    "game": """game as (
  select o_orderkey as game_id, o_orderdate as local_date, s.home_team_id, s.away_team_id, s.home_pitcher, s.away_pitcher,
         cast(h.s_nationkey as bigint) as home_w, cast(floor(h.s_acctbal / 1000) as bigint) as home_l,
         cast(a.s_nationkey as bigint) as away_w, cast(floor(a.s_acctbal / 1000) as bigint) as away_l
  from orders left join sides s on s.game_id = o_orderkey
  left join supplier h on h.s_suppkey = s.home_team_id
  left join supplier a on a.s_suppkey = s.away_team_id
)""",
    "batter_counts": "batter_counts as (\n  select l_orderkey as game_id, l_suppkey as team_id, l_partkey as batter,\n"
    "         case when l_suppkey = s.home_team_id then 1 when l_suppkey = s.away_team_id then 0 end as homeTeam,\n"
    + ",\n".join(f"         cast({e} as bigint) as {n}" for n, e in LINE_COUNTS.items())
    + "\n  from lineitem join sides s on s.game_id = l_orderkey\n)",
    "pitcher_counts": "pitcher_counts as (\n  select l_partkey as pitcher, l_orderkey as game_id, min(l_suppkey) as team_id,\n"
    + ",\n".join(f"         cast(sum({e}) as bigint) as \"{n}\"" for n, e in PITCHER_SUMS.items())
    + "\n  from lineitem group by l_partkey, l_orderkey\n)",
    "team_results": """team_results as (
  select o_orderkey as game_id, s.home_team_id as team_id, case when o_orderstatus = 'F' then 'W' else 'L' end as win_lose
  from orders join sides s on s.game_id = o_orderkey where o_orderstatus in ('F', 'O')
)""",
    "pregame_detail": "pregame_detail as (\n  select s.game_id"
    + "".join(
        f""",
         {p}.p_type as {side}_throwinghand, cast({p}.p_size - length({p}.p_name) as bigint) as {side}_streak,
         cast({p}.p_size as bigint) as {side}_wins, cast(length({p}.p_name) as bigint) as {side}_losses,
         cast({p}.p_size + length({p}.p_name) as bigint) as {side}_hits,
         cast(floor({p}.p_retailprice) as bigint) as {side}_runs, cast(length({p}.p_brand) as bigint) as {side}_errors"""
        for side, p in (("home", "h"), ("away", "a"))
    )
    + """
  from sides s left join part h on h.p_partkey = s.home_pitcher left join part a on a.p_partkey = s.away_pitcher
)""",
    "pregame_odds": """pregame_odds as (
  select l_orderkey as game_id, l_shipdate as capture_date, -75 - cast(l_quantity as bigint) as home_line,
         -90 - 3 * cast(round(l_tax * 100) as bigint) as away_line
  from lineitem
)""",
}


def sql_with(*names: str) -> str:
    """``with`` clause that defines the named game tables."""
    return "with " + ",\n".join([_SIDES.strip(), *[SQL_TABLES[n] for n in names]])


def customer_games(t: Tables) -> DataFrame:
    """One appearance per order: the customer as batter, line counts summed."""
    names = ("atBat", "Hit", "Walk", "Home_Run")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.min("l_suppkey").alias("team_id"),
        *[F.sum(F.expr(LINE_COUNTS[n])).cast("bigint").alias(n) for n in names],
    )
    who = t.orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_custkey").alias("batter"))
    return lines.join(who, on="game_id", how="inner")


def dated_orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").alias("local_date"))


def player_games(t: Tables) -> DataFrame:
    """One appearance per part and order."""
    return pitcher_counts(t).withColumnRenamed("pitcher", "batter")


def descriptions(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("batter"), F.concat_ws(" ", "c_mktsegment", "c_name", F.lit("singles")).alias("des")
    )


def teams(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("team_id"), F.col("s_name").alias("name_brief"))


CUSTOMER_GAMES_SQL = """customer_games as (
  select l_orderkey as game_id, o_custkey as batter, min(l_suppkey) as team_id, """ + ", ".join(
    f"cast(sum({LINE_COUNTS[n]}) as bigint) as {n}" for n in ("atBat", "Hit", "Walk", "Home_Run")
) + """
  from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey, o_custkey
),
names as (select c_custkey as batter, c_mktsegment || ' ' || c_name as name from customer),
batter_games as (
  select batter as batter_id, team_id as teamid, game_id as game, atBat as AB, Hit as hit, Walk as walk, Home_Run as HR,
         case when atBat = 0 then 0.0 else Hit / cast(atBat as double) end as bavg, cast(o_orderdate as date) as local_date
  from customer_games join orders on o_orderkey = game_id where o_orderdate is not null
)"""
