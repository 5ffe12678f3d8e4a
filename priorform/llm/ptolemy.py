"""Centroid clustering of whole-number vectors, with Ptolemaic lower bounds from fixed pivots.

For pivots p, s, a vector x and a centroid c, Ptolemy's inequality says
``|x - c| * |p - s| >= | |x - p| * |c - s| - |x - s| * |c - p| |``. The distances of every vector to the pivots are
computed once and stored; a round needs those of the centroids only. The centroid with the least bound is measured first,
and every other one whose bound, rounded down, does not exceed that is measured exactly, in whole numbers. Ties go to the
smaller number. Sums of a round are added per batch, so that the shuffle sees a few rows per task.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import map_arrow, store

PIVOTS = 5  # the first of the initial centroids; ten pairs
SLACK = 1e-11  # relative; far above the rounding of the few operations of a bound
LARGEST = 1 << 26  # of a component, so that a squared distance of 64 components fits 64 bits
ROWS_AT_ONCE = 4096


def whole(embedding: str, scale: int):
    """Components times ``scale``, rounded down; refused from ``LARGEST`` on."""
    return F.expr(
        f"transform({embedding}, v -> if(abs({scale} * cast(v as double)) < {LARGEST}, floor({scale} * cast(v as double)), "
        f"cast(raise_error('a component times {scale} reaches {LARGEST}') as bigint)))"
    )


def roots(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all rows to all others, from exact squares."""
    return np.sqrt(((rows[:, None, :] - others[None, :, :]) ** 2).sum(2).astype(np.float64))


def bounds(to_pivots: np.ndarray, centroids_to_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of rows to centroids; never above the true ones."""
    best = np.zeros((len(to_pivots), len(centroids_to_pivots)))
    for p, s in itertools.combinations(range(len(between)), 2):
        if between[p, s] > 0:
            one = to_pivots[:, p, None] * centroids_to_pivots[None, :, s]
            two = to_pivots[:, s, None] * centroids_to_pivots[None, :, p]
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / between[p, s], out=best)
    return best * best * (1 - SLACK)


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroids_to_pivots: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each row's nearest centroid, and how many distances were measured."""
    number, distance, measured = [], [], 0
    for start in range(0, len(rows), ROWS_AT_ONCE):
        x = rows[start : start + ROWS_AT_ONCE]
        least = bounds(to_pivots[start : start + ROWS_AT_ONCE], centroids_to_pivots, between)
        each = np.arange(len(x))
        guess = least.argmin(1)
        d = np.full(least.shape, np.iinfo(np.int64).max)
        d[each, guess] = ((x - centroids[guess]) ** 2).sum(1)
        left = least <= d[each, guess][:, None]
        left[each, guess] = False
        for c in np.flatnonzero(left.any(0)):
            asked = np.flatnonzero(left[:, c])
            d[asked, c] = ((x[asked] - centroids[c]) ** 2).sum(1)
            measured += len(asked)
        number.append(d.argmin(1))
        distance.append(d.min(1))
        measured += len(x)
    if not number:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return np.concatenate(number), np.concatenate(distance), measured


def matrix(lists, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256
) -> DataFrame:
    """Nearest centroid of every vector after ``rounds`` rounds from ``k`` vectors drawn by hash.

    Kept are vectors with exactly ``width`` components, none of them null or not finite; the others give no row. One row
    per kept row, repeated ones too: ``id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured`` (how
    many distances its batch measured, a figure of the method). A null id hashes as an empty one; rows whose hash is equal
    go by their components. With fewer than ``k`` vectors all are centroids; an empty table gives none. A component that
    reaches 2^26 when scaled is refused with an error, as distances would leave 64 bits.
    """
    spark = vectors.sparkSession
    usable = (F.size(vector_col) == width) & ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull() & usable).select(
        F.col(id_col).alias("id"), whole(f"`{vector_col}`", scale).alias("q"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256).alias("h"),
    )
    drawn = kept.orderBy("h", "q").limit(k).collect()
    result = "id {0}, cluster int, distance bigint, measured bigint".format(vectors.schema[id_col].dataType.simpleString())
    if not drawn:
        empty = spark.createDataFrame([], result)
        return empty.select(F.col("id").alias(id_col), "cluster", "distance", F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"), "measured")
    centroids = np.array([r["q"] for r in drawn], np.int64)
    pivots = centroids[:PIVOTS].copy()
    between = roots(pivots, pivots)

    def measure(cols):
        rows = matrix(cols["q"], width)
        return {"id": cols["id"], "q": cols["q"], "far": list(roots(rows, pivots))}

    id_type = vectors.schema[id_col].dataType.simpleString()
    points = store(map_arrow(kept.select("id", "q"), measure, f"id {id_type}, q array<bigint>, far array<double>", keep=["id", "q"]))

    def sums_of(centroids):
        to_pivots = roots(centroids, pivots)

        def of(cols):
            rows = matrix(cols["q"], width)
            number, _, _ = nearest(rows, matrix(cols["far"], len(pivots)), centroids, to_pivots, between)
            used = np.unique(number)
            return {"cluster": used, "n": [int((number == c).sum()) for c in used], "total": [rows[number == c].sum(0) for c in used]}

        return of

    for _ in range(rounds):
        sums = map_arrow(points.select("q", "far"), sums_of(centroids), "cluster int, n bigint, total array<bigint>", keep=["q", "far"])
        means = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()
        centroids = centroids.copy()
        for r in means:  # at most k rows
            centroids[r["cluster"]] = [t // r["n"] for t in r["total"]]

    def assign(cols):
        number, distance, measured = nearest(matrix(cols["q"], width), matrix(cols["far"], len(pivots)), centroids, last, between)
        return {"id": cols["id"], "cluster": number, "distance": distance, "measured": np.full(len(number), measured)}

    last = roots(centroids, pivots)
    found = store(map_arrow(points, assign, result, keep=["id", "q", "far"]))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(inertia.values())
    facts = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(F.broadcast(table), "cluster")  # at most k rows
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured")
