"""The reference's formulations of some queries, to measure ours against on the same Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorform.catalog import market
from priorform.catalog.statistics import CONTS, _facts
from priorform.operators import binned
from priorform.plans.game_features import TEAM_COUNTS, team_per_game
from priorform.sources.sinks import stage
from priorform.sources.tables import Tables


def reference_forms(spark: SparkSession, folder: str) -> dict[str, Callable[[], DataFrame]]:
    t = Tables(spark, folder)
    for name in ("orders", "events"):
        getattr(t, name).createOrReplaceTempView(name)

    def rolling() -> DataFrame:
        within = "datediff(a.o_orderdate, b.o_orderdate) between 1 and 100"
        return spark.sql(f"""
            select a.o_orderkey, a.o_custkey,
                   sum(case when {within} then cast(b.o_totalprice as decimal(18,2)) end) as total_100,
                   avg(case when {within} then b.o_totalprice end) as mean_100, sum(case when {within} then 1 end) as n_100
            from orders a left join orders b on a.o_custkey = b.o_custkey group by a.o_orderkey, a.o_custkey""")

    def latest() -> DataFrame:
        return spark.sql("""
            with po as (select event_id, user_id, cast(ts as date) as day, value from events)
            select po.* from po left join po b on po.user_id = b.user_id and po.day < b.day where b.day is null""")

    def gap() -> DataFrame:
        return spark.sql("""
            select a.event_id, a.user_id, datediff(min(b.ts), a.ts) - 1 as gap
            from events a join events b on a.user_id = b.user_id where a.ts < b.ts group by a.event_id, a.user_id, a.ts""")

    def team() -> DataFrame:
        stage(team_per_game(market.game_tables(t))).createOrReplaceTempView("team_per_game")
        past = """from team_per_game t2 where t2.local_date > date_add(t1.local_date, -100)
                  and t2.local_date < t1.local_date and t1.team_id = t2.team_id"""
        sums = ", ".join(f"(select sum({m}) {past}) as {m}_99" for m in TEAM_COUNTS)
        return spark.sql(f"select t1.game_id, t1.team_id, (select sum(1) {past}) as games_99, {sums} from team_per_game t1")

    def one_scan_per_cell() -> DataFrame:
        """One of the fifteen pairs: a hundred filtered aggregates."""
        rows = _facts(t)
        a, b = CONTS[:2]
        edges = binned.equal_width_edges(rows, [a, b])
        out = []
        for i in range(10):
            for j in range(10):
                cell = rows.where(F.col(a) >= edges[a][i]).where(F.col(b) >= edges[b][j])
                cell = cell.where(F.col(a) < edges[a][i + 1]) if i < 9 else cell
                cell = cell.where(F.col(b) < edges[b][j + 1]) if j < 9 else cell
                out.append((i, j, *cell.agg(F.count(F.lit(1)), F.avg("filled")).first()))
        return spark.createDataFrame(out, "i int, j int, n bigint, m double")

    return {
        "rolling_100_sum": rolling,
        "latest_with_ties": latest,
        "next_event_gap": gap,
        "team_rolling_99": team,
        "pair_table_cont_cont": one_scan_per_cell,
    }
