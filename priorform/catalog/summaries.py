"""Totals, counts, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog import market
from priorform.catalog.market import CUSTOMER_GAMES_SQL
from priorform.catalog.registry import bigints, query, rounded
from priorform.operators import summaries
from priorform.operators.report import predictor_profile
from priorform.plans import batting
from priorform.sources.tables import Tables


def _names(t: Tables) -> DataFrame:
    return batting.batter_names(market.descriptions(t), "batter")


@query(
    "career_totals",
    f"""
with {CUSTOMER_GAMES_SQL},
totals as (select batter, min(team_id) as team_id, sum(atBat) as AB, sum(Hit) as hit, sum(Walk) as walk, sum(Home_Run) as HR
           from customer_games group by batter)
select t.batter as id, n.name, team_id as teamid, s_name as team, cast(AB as bigint) as AB, cast(hit as bigint) as hit,
       cast(walk as bigint) as walk, cast(HR as bigint) as HR,
       round(case when AB = 0 then 0.0 else cast(hit as double) / cast(AB as double) end, 6) as bavg
from totals t left join names n on n.batter = t.batter left join supplier on s_suppkey = team_id""",
)
def career_totals(t: Tables) -> DataFrame:
    """Career sums and ratio of sums per batter."""
    out = batting.career_totals(market.customer_games(t), _names(t), market.teams(t))
    return rounded(out, "bavg")


@query(
    "season_totals",
    f"""
with {CUSTOMER_GAMES_SQL},
totals as (select batter, split_part(cast(cast(o_orderdate as date) as varchar), '-', 1) as year, min(team_id) as team_id,
                  sum(atBat) as AB, sum(Hit) as hit, sum(Walk) as walk, sum(Home_Run) as HR
           from customer_games left join orders on o_orderkey = game_id where o_orderdate is not null group by 1, 2)
select t.batter as id, n.name, team_id as teamid, s_name as team, cast(AB as bigint) as AB, cast(hit as bigint) as hit,
       cast(walk as bigint) as walk, cast(HR as bigint) as HR,
       round(case when AB = 0 then 0.0 else cast(hit as double) / cast(AB as double) end, 6) as bavg, year
from totals t left join names n on n.batter = t.batter left join supplier on s_suppkey = team_id""",
)
def season_totals(t: Tables) -> DataFrame:
    """The same per batter and season."""
    out = batting.season_totals(market.customer_games(t), market.dated_orders(t), _names(t), market.teams(t))
    return rounded(out, "bavg")


@query(
    "conditional_agg",
    """
select l_suppkey, cast(sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) end) as bigint) as returned,
       round(avg(case when l_linestatus = 'O' then l_discount end), 6) as open_discount,
       cast(sum(case when l_tax > 0.05 then 1 end) as bigint) as high_tax from lineitem group by l_suppkey""",
)
def conditional_agg(t: Tables) -> DataFrame:
    """Sums, means and counts over the rows that satisfy a condition."""
    out = t.lineitem.groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint"))).alias("returned"),
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_discount").cast("decimal(18,2)"))).alias("open_discount"),
        F.sum(F.when(F.col("l_tax") > 0.05, 1)).alias("high_tax"),
    )
    return bigints(rounded(out, "open_discount"), "returned", "high_tax")


@query(
    "entity_name",
    """
select source, array_to_string(string_split(text, ' ')[1:2], ' ') as name
from (select *, row_number() over (partition by source order by doc_id) as pick from documents) where pick = 1""",
)
def entity_name(t: Tables) -> DataFrame:
    """First two words of the first document of each source."""
    return summaries.entity_name(t.documents, "source", "text", "doc_id")


@query(
    "crosstab",
    """
select p_brand, p_type, cast(coalesce(n, 0) as bigint) as n
from (select * from (select distinct p_brand from part), (select distinct p_type from part))
left join (select p_brand, p_type, count(*) as n from part group by p_brand, p_type) using (p_brand, p_type)""",
)
def crosstab(t: Tables) -> DataFrame:
    """Counts of all pairs of levels, absent pairs 0."""
    return summaries.crosstab(t.part, "p_brand", "p_type")


# The levels that become columns.
_LANGS = ("de", "en", "es", "fr")


@query(
    "value_counts_pivot",
    "select source, " + ", ".join(f"nullif(count(*) filter (where lang = '{v}'), 0) as {v}" for v in _LANGS) + " from documents group by source",
)
def value_counts_pivot(t: Tables) -> DataFrame:
    """Counts by source and language, absent pairs NULL."""
    return summaries.value_counts_pivot(t.documents, "source", "lang", _LANGS)


_STATS = ("min", "q25", "median", "mean", "q75", "max")


def _stats_sql(c: str) -> str:
    return (
        f"round(min({c}), 4) as min, round(quantile_cont({c}, 0.25), 4) as q25, round(median({c}), 4) as median,"
        f" round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c}), 4) as max"
    )


_LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "summary_stats",
    "\nunion all ".join(f"select '{c}' as \"column\", count({c}) as n, {_stats_sql(c)} from lineitem" for c in _LINE_COLUMNS),
)
def summary_stats(t: Tables) -> DataFrame:
    """Five numbers and the mean of each column."""
    return rounded(summaries.five_numbers(t.lineitem, _LINE_COLUMNS), *_STATS, places=4)


@query(
    "box_stats",
    "\nunion all ".join(
        f"select l_returnflag, '{c}' as \"column\", count({c}) as n, {_stats_sql(c)} from lineitem group by l_returnflag"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def box_stats(t: Tables) -> DataFrame:
    """The same per class."""
    out = summaries.five_numbers(t.lineitem, ("l_quantity", "l_extendedprice"), by=("l_returnflag",))
    return rounded(out, *_STATS, places=4)


@query(
    "predictor_profile",
    "\nunion all ".join(
        f"select '{c}' as predictor, min({c}) as min, round(median({c}), 6) as median, max({c}) as max from lineitem" for c in _LINE_COLUMNS
    ),
)
def profile(t: Tables) -> DataFrame:
    """Extremes and median of each predictor."""
    return rounded(predictor_profile(t.lineitem, _LINE_COLUMNS), "median")


@query(
    "class_share",
    "select label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from embeddings group by label",
)
def class_share(t: Tables) -> DataFrame:
    """Share of every class."""
    return rounded(summaries.class_share(t.embeddings, "label"), "share")


def _edges_sql(table: str, column: str, bins: int, name: str) -> str:
    """Rows (b, e): lower edges by repeated addition."""
    return f"""{name}_r(b, e, step) as (
  select 1, min({column}), (max({column}) - min({column})) / {bins} from {table}
  union all select b + 1, e + step, step from {name}_r where b < {bins}
)"""


_HIST_SQL = f"""
with recursive {_edges_sql("events", "value", 40, "vx")},
{_edges_sql("(select extract(epoch from ts) % 86400 as s from events)", "s", 40, "sy")},
rows as (select event_type, value, extract(epoch from ts) % 86400 as s from events),
cells as (select event_type, cast((select count(*) from vx_r where e <= value) as int) as x_bin,
                 cast((select count(*) from sy_r where e <= s) as int) as y_bin, count(*) as n from rows group by all)"""


def _seconds(t: Tables) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.extract(F.lit("SECOND"), F.col("ts"))
    return t.events.select("event_type", "value", second.cast("double").alias("s"))


@query("hist_2d", f"{_HIST_SQL} select * from cells")
def hist_2d(t: Tables) -> DataFrame:
    """Value against time of day on a 40 by 40 grid, per event type."""
    return summaries.histogram_2d(_seconds(t), "value", "s", bins=40, by=("event_type",))


@query(
    "hist_marginal",
    f"""{_HIST_SQL} select event_type, 'x' as axis, x_bin as bin, cast(sum(n) as bigint) as n from cells group by event_type, x_bin
union all select event_type, 'y', y_bin, cast(sum(n) as bigint) from cells group by event_type, y_bin""",
)
def hist_marginal(t: Tables) -> DataFrame:
    """Both marginal histograms of the grid."""
    return summaries.marginals(summaries.histogram_2d(_seconds(t), "value", "s", bins=40, by=("event_type",)), ("event_type",))


@query(
    "trend_line",
    """
select round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) as r2, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n from lineitem""",
)
def trend_line(t: Tables) -> DataFrame:
    """Least-squares line of price on quantity."""
    return rounded(summaries.trend_line(t.lineitem, "l_quantity", "l_extendedprice"), "slope", "intercept", "r2")


@query("events_per_day", "select cast(o_orderdate as date) as day, count(*) as n from orders where o_orderdate is not null group by 1")
def events_per_day(t: Tables) -> DataFrame:
    """Orders per calendar day."""
    return summaries.per_day(t.orders, "o_orderdate")
