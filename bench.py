"""Headline queries at one scale; prints one JSON line.

    python bench.py            the headline queries
    python bench.py --forms    our operators against the reference's formulations, same Spark
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from priorform.catalog import QUERIES  # noqa: E402
from priorform.session import local_session  # noqa: E402

HEADLINE = (
    "rolling_100_sum", "career_to_date", "season_to_date", "rolling_avg", "team_rolling_99", "batter_history",
    "latest_with_ties", "best_odds", "next_event_gap", "gap_diff", "pair_sides", "left_join_chain", "game_features_3",
    "career_totals", "one_hot", "row_index", "summary_stats", "box_stats", "cramers_v", "correlation_ratio",
    "corr_matrix", "dmr_1d_cont", "dmr_1d_adaptive", "dmr_2d_cont_cont", "pair_table_cat_cat", "pair_table_cat_cont",
    "pair_table_cont_cont", "rank_predictors", "knn_topk", "knn_classify",
    "logit_z_all", "game_pairs_cat_cont",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    start = time.perf_counter()
    run(make())
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    if "--forms" in sys.argv:
        return forms(spark, folder)
    names = [a for a in sys.argv[1:] if not a.startswith("-")] or HEADLINE
    run(QUERIES["rolling_100_sum"](spark, folder))
    seconds, runs = {}, int(os.environ.get("BENCH_RUNS", "1"))
    for name in names:
        seconds[name] = round(statistics.median(timed(lambda: QUERIES[name](spark, folder)) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total wall seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


def forms(spark, folder: str) -> None:
    """Median of three: the reference's way of asking, and ours."""
    from bench_forms import reference_forms

    out, names = {}, [a for a in sys.argv[1:] if not a.startswith("-")]
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name, form in reference_forms(spark, folder).items():
        if names and name not in names:
            continue
        ours = statistics.median([timed(lambda: QUERIES[name](spark, folder)) for _ in range(runs)])
        theirs = statistics.median([timed(form) for _ in range(runs)])
        out[name] = {"reference_form_sec": round(theirs, 2), "ours_sec": round(ours, 2)}
        print(name, out[name], file=sys.stderr, flush=True)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
