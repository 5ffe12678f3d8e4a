import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from priorform.operators import temporal as tp
from priorform.operators.temporal import CAREER_TO_DATE, CLOSED_100, OPEN_100, SEASON_TO_DATE, Horizon

BASE = dt.date(2010, 6, 1)
HORIZONS = {"closed": CLOSED_100, "open": OPEN_100, "career": CAREER_TO_DATE, "season": SEASON_TO_DATE}


def day(n):
    return BASE + dt.timedelta(days=n)


def inside(name, a, b):
    gap = (a - b).days
    return {
        "closed": 1 <= gap <= 100,
        "open": 1 <= gap <= 99,
        "career": gap > 1,
        "season": gap > 1 and a.year == b.year,
    }[name]


def brute(rows):
    """The self-join: every row against all rows of its entity."""
    out = {}
    for e, d, g, v in rows:
        for name in HORIZONS:
            past = [r for r in rows if r[0] == e and e is not None and d and r[1] and inside(name, d, r[1])]
            values = [r[3] for r in past if r[3] is not None]
            out[g, name] = (
                sum(values) if values else None,
                sum(values) / len(values) if values else None,
                len(past) or None,
            )
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "e bigint, day date, game bigint, v bigint")


def history(spark, rows, **kw):
    out = tp.with_history(frame(spark, rows), "e", "day", HORIZONS, sums={"s": "v"}, means={"m": "v"}, **kw)
    return {
        (r["game"], name): (r[f"s_{name}"], r[f"m_{name}"], r[f"n_{name}"]) for r in out.collect() for name in HORIZONS
    }


EDGES = [0, 1, 2, 99, 100, 101, 101, 214, 215, 216, 220]


@pytest.mark.parametrize("way", ["daily", "in_place"])
def test_frames_match_the_self_join(spark, way):
    rows = [(1, day(n), i, i * i) for i, n in enumerate(EDGES)]
    rows += [(2, day(5), 50, 7), (3, day(0), 60, None), (3, day(3), 61, 4), (3, None, 62, 1), (None, day(3), 63, 1)]
    assert history(spark, rows, way=way) == brute(rows)


def test_empty_frame_is_null_also_for_the_count(spark):
    assert history(spark, [(1, day(0), 1, 5)])[1, "closed"] == (None, None, None)


def test_closed_and_open_differ_exactly_at_distance_100(spark):
    rows = [(1, day(n), i, 1) for i, n in enumerate(EDGES)]
    got = history(spark, rows)
    differ = {i for i in range(len(EDGES)) if got[i, "closed"] != got[i, "open"]}
    assert differ == {i for i, n in enumerate(EDGES) if n - 100 in EDGES}


def test_frames_with_a_map_column_read_only_what_they_use(spark, tmp_path):
    rows = [(1, day(0), {"a": 1}, 5), (1, day(3), {"b": 2}, 6), (None, day(3), {}, 7)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "e bigint, day date, m map<string,int>, v bigint").write.parquet(path)
    for way in ("daily", "in_place"):
        out = tp.with_history(spark.read.parquet(path), "e", "day", HORIZONS, sums={"s": "v"}, way=way)
        assert sorted(((r["v"], r["s_closed"]) for r in out.collect()), key=str) == [(5, None), (6, 5), (7, None)]
        plan = out.select("e", "day", "s_closed")._jdf.queryExecution().executedPlan().toString()
        assert "m#" not in plan.split("ReadSchema")[-1] and "map<" not in plan


def test_hot_entity_and_hot_day(spark):
    """A third of all rows on one entity, half of those on one day."""
    rnd = random.Random(3)
    rows = [(9, day(40 if rnd.random() < 0.5 else rnd.randrange(300)), i, rnd.randrange(9)) for i in range(200)]
    rows += [(rnd.randrange(8), day(rnd.randrange(300)), 1000 + i, rnd.randrange(9)) for i in range(400)]
    assert history(spark, rows) == brute(rows)


def test_rows_without_place_in_time_stay_apart(spark):
    rows = [(e, day(n), 100 * e + n, n) for e in (1, 2) for n in sorted(set(EDGES))]
    rows += [(1, None, 900, 1), (None, day(1), 901, 1), (None, day(2), 902, 1), (1, None, 903, 1)]
    assert history(spark, rows, way="in_place") == history(spark, rows, way="daily") == brute(rows)


def test_no_leak_from_the_present_or_the_future(spark):
    rows = [(1, day(n), i, i + 1) for i, n in enumerate(EDGES)]
    before = history(spark, rows)
    cut = 101
    changed = [(e, d, g, v * 1000 if (d - BASE).days >= cut else v) for e, d, g, v in rows]
    after = history(spark, changed)
    for i, n in enumerate(EDGES):
        if n <= cut:
            assert all(before[i, h] == after[i, h] for h in HORIZONS)


def test_history_at_keeps_the_past_of_other_games(spark):
    rows = [(1, day(0), 1, 5), (1, day(10), 2, 7), (2, day(3), 3, 1), (2, day(10), 2, 9)]
    got = tp.history_at(frame(spark, rows), "e", "day", {"h": OPEN_100}, F.col("game") == 2, sums={"s": "v"})
    assert {(r["e"], r["s_h"]) for r in got.collect()} == {(1, 5), (2, 1)}


def test_rolling_is_one_frame(spark):
    rows = [(1, day(0), 1, 5), (1, day(7), 2, 7), (1, day(8), 3, 1)]
    got = tp.rolling(frame(spark, rows), "e", "day", -7, -1, sums={"s": "v"})
    assert {r["game"]: r["s_prior"] for r in got.collect()} == {1: None, 2: 5, 3: 7}
    assert Horizon(-7, -1).within_season is False


def test_dedupe_takes_the_lowest_game(spark):
    rows = [(1, day(0), 7, 1), (1, day(0), 3, 2), (1, day(1), 9, 3)]
    got = tp.dedupe_entity_day(frame(spark, rows), "e", "day", "game").collect()
    assert {(r["e"], r["day"], r["game"], r["v"]) for r in got} == {(1, day(0), 3, 2), (1, day(1), 9, 3)}


def at(n, h=0):
    return dt.datetime(2010, 6, 1) + dt.timedelta(days=n, hours=h)


def test_latest_keeps_ties_missing_times_and_missing_keys(spark):
    rows = [(1, at(1), 1), (1, at(2), 2), (1, at(2), 3), (1, None, 4), (None, at(1), 5), (None, at(9), 6), (2, at(0), 7)]
    df = spark.createDataFrame(rows, "k bigint, t timestamp_ntz, line int")
    kept = {r["line"] for r in tp.latest_with_ties(df, "k", "t").collect()}
    brute_kept = {
        line for k, t, line in rows
        if not any(k is not None and k == k2 and t is not None and t2 is not None and t < t2 for k2, t2, _ in rows)
    }
    assert kept == brute_kept == {2, 3, 4, 5, 6, 7}


def test_best_of_latest_equals_max_over_the_latest(spark):
    rows = [(1, at(1), 99, 1), (1, at(2), 5, None), (1, at(2), 3, 4), (1, None, 6, 2), (2, None, 1, 1), (2, None, 2, None),
            (None, at(1), 8, 1), (None, at(2), 1, 2), (3, at(1), None, 3)]
    df = spark.createDataFrame(rows, "k bigint, t timestamp_ntz, a int, b int")
    got = {tuple(r) for r in tp.best_of_latest(df, "k", "t", {"x": "a", "y": "b"}).collect()}
    kept = tp.latest_with_ties(df, "k", "t").groupBy("k").agg(F.max("a"), F.max("b"))
    assert got == {tuple(r) for r in kept.collect()}


def test_next_gap_matches_the_theta_join(spark):
    rows = [(1, at(0, 9), 1), (1, at(0, 20), 2), (1, at(0, 20), 3), (1, at(3, 1), 4), (1, at(3, 1), 5), (2, at(0), 6),
            (2, at(400), 7), (None, at(1), 8), (None, at(2), 9), (2, None, 10)]
    df = spark.createDataFrame(rows, "e bigint, ts timestamp_ntz, g bigint")
    expected = {}
    for e, ts, g in rows:
        later = [t for e2, t, _ in rows if e is not None and e2 == e and t and ts and ts < t]
        if later:
            expected[g] = (min(later).date() - ts.date()).days - 1
    got = {r["g"]: r["gap"] for r in tp.next_gap(df, "e", "ts").collect()}
    assert got == expected
    assert got[1] == -1 and 5 not in got


@pytest.mark.parametrize("wanted", ["flag", "true"])
def test_listed_history_is_that_of_the_wanted_rows(spark, wanted):
    rnd = random.Random(11)
    day = lambda: dt.datetime(2006, 12, 1) + dt.timedelta(days=rnd.randrange(300), hours=rnd.randrange(24))
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([day(), day(), None]), rnd.choice([rnd.randrange(9), None]), rnd.random() < 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, e string, ts timestamp_ntz, v int, flag boolean")
    horizons = {"100": tp.CLOSED_100, "season": tp.SEASON_TO_DATE, "career": tp.CAREER_TO_DATE}
    names = [f"{m}_{h}" for h in horizons for m in ("v", "n")]
    full = tp.with_history(df, "e", "ts", horizons, sums={"v": "v"}).where(wanted)
    got = tp.listed_history(df, "e", "ts", horizons, F.expr(wanted), ["g"], sums={"v": "v"})
    key = lambda frame: sorted(map(tuple, frame.select("g", "e", *names).collect()))
    assert [*map(str, key(got))] == [*map(str, key(full))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_listed_gap_is_the_gap(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice([1, 2, None]), rnd.choice([dt.datetime(2007, 1, 1) + dt.timedelta(hours=rnd.randrange(900)), None])) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, e int, ts timestamp_ntz")
    full = {r["g"]: r["gap"] for r in tp.next_gap(df, "e", "ts").collect()}
    assert {r["g"]: r["gap"] for r in tp.listed_gap(df, "e", "ts", "g").collect()} == full and len(full) > 20
