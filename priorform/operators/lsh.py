"""Approximate k nearest neighbours by locality-sensitive hashing, with audited recall.

A table of hashes is a few random directions; a row's bucket in it is the sides of the mean on which the row lies. A
train row goes to its bucket of each table. A test row, of which there are fewer, also goes to the buckets beyond the
planes that it is nearest to, so few tables suffice, and rows are sent few times. It meets the train rows of its buckets,
block by block, and only its k best leave a task.
Some test rows are asked exactly first: tables are added until these find ``recall`` of their neighbours, and if the most
tables do not suffice, the exact search answers all. So it does for test rows whose buckets hold fewer than k train rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorform.operators.neighbours import BLOCK_ROWS, _matrix, best_in_cells, nearest
from priorform.sources.sinks import stage

TABLES = (2, 4, 8, 16, 32, 64)
NEAR_PLANES = 3  # of a table, on both sides of which a test row looks
AUDITED = 200  # test rows asked exactly, drawn by hash
BUCKET = 256  # train rows of a bucket, on average
KINDS = "id bigint, features array<double>"


@dataclass(frozen=True)
class Found:
    """``rows``: (test_id, train_id, label, distance, rank); ``recall``: as measured on the audited test rows, with
    ``tables`` tables (None: no test row or no train row), and whether the exact search had to answer all."""

    rows: DataFrame
    recall: float | None
    tables: int
    exact: bool


def bucketed(df: DataFrame, centre: np.ndarray, bits: int, tables: int, seed: int, planes_near: int = 0) -> DataFrame:
    """Each row once per table, with ``cell``: the table in the upper bits, the bucket in the lower 40; with
    ``planes_near`` also in the buckets that differ in some of so many planes, those nearest to the row."""
    directions = np.random.default_rng(seed).normal(size=(max(TABLES), bits, len(centre)))[:tables]
    shared = df.sparkSession.sparkContext.broadcast((directions.reshape(tables * bits, -1), centre))

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, middle = shared.value
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for b in batches:
            if len(b):
                along = ((_matrix(b["features"]) - middle) @ planes.T).reshape(len(b), tables, bits)
                cells = ((along > 0) @ weights + (np.arange(tables, dtype=np.int64) << 40))[:, :, None]
                for near in np.moveaxis(np.argsort(np.abs(along), axis=2, kind="stable")[:, :, :planes_near], 2, 0):
                    cells = np.concatenate([cells, cells ^ weights[near][:, :, None]], axis=2)
                yield b.assign(cells=list(cells.reshape(len(b), -1)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(sides, f"{kinds}, cells array<bigint>").withColumn("cell", F.explode("cells")).drop("cells")


def _ranked(best: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("test_id").orderBy("distance", "train_id")
    once = best.repartition("test_id").dropDuplicates(["test_id", "train_id"])
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lsh_nearest(
    train: DataFrame, test: DataFrame, k: int = 5, *, recall: float = 0.9, seed: int = 0, bucket: int = BUCKET,
    tables: tuple[int, ...] = TABLES, block_rows: int = BLOCK_ROWS,
) -> Found:
    """The k nearest of ``train`` (id, features, label) to each row of ``test`` (id, features), most of them.

    Ids are unique integers, features arrays of doubles of one length. Distances are exact; what may be missing is a
    neighbour. Equal rows always meet. Ties in distance go to the lower train id.
    """
    ids = F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features")
    train = stage(train.select(*ids, F.col("label").cast("string").alias("label")))
    test = stage(test.select(*ids))
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    if not size["n"] or test.isEmpty():
        return Found(nearest(train, test, k), None, 0, True)
    means = train.agg(*[F.avg(F.get("features", i)) for i in range(size["d"])]).first()
    centre, bits = np.array(means, dtype=np.float64), min(40, max(1, round(math.log2(size["n"] / bucket + 1))))
    audited = stage(test.orderBy(F.xxhash64("id")).limit(AUDITED))
    truth = stage(nearest(train, audited, k).select("test_id", "train_id"))
    wanted, reached, used = truth.count(), 0.0, tables[0]

    def search(rows: DataFrame, count: int, few: bool = False) -> DataFrame:
        near, asked = bucketed(train, centre, bits, count, seed), bucketed(rows, centre, bits, count, seed, NEAR_PLANES)
        if few:  # the buckets of few test rows are few
            near = near.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")
        return stage(_ranked(best_in_cells(near, asked, k, block_rows), k))

    for used in tables:
        reached = search(audited, used, True).join(truth, ["test_id", "train_id"], "left_semi").count() / wanted
        if reached >= recall:
            break
    else:
        return Found(nearest(train, test, k), reached, used, True)
    found = search(test, used)
    full = found.groupBy("test_id").count().where(F.col("count") >= min(k, size["n"])).select(F.col("test_id").alias("id"))
    short = stage(test.join(full, "id", "left_anti"))
    if not short.isEmpty():
        found = found.join(short.select(F.col("id").alias("test_id")), "test_id", "left_anti").unionByName(nearest(train, short, k))
    return Found(found.select("test_id", "train_id", "label", "distance", "rank"), reached, used, False)
