"""Connected components of links that are only ever stored, joined and grouped in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.llm._common import drop_stored, free_shuffles, gathered, store


def _print(links: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal sets of links have equal prints."""
    sums = [F.sum(F.xxhash64("u", "v", F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)), *sums).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 200) -> DataFrame:
    """``node, comp``: for each node of an edge the smallest node that it reaches.

    Alternating star rounds: every node hands its smallest neighbour to its larger ones, then every node
    connects its smaller neighbours to the smallest of them, until the edges stay the same. Each round is one
    minimum per node and one join, so a node with very many neighbours is split like any other join key; each
    round is stored, so a lost executor costs one round, and its shuffles and the round before are freed. Few links
    are gathered in one task, where a round needs no exchange. Raises if ``max_rounds`` do not suffice.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    links = store(both.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    now = _print(links)
    for _ in range(max_rounds if now[0] else 1):
        old, links = links, gathered(links, now[0])
        ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        around = links.select(ways.alias("x")).select("x.u", "x.v")
        least = around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = store(small.where("u <> v").distinct())
        before, now = now, _print(links)
        drop_stored(old)
        free_shuffles(edges.sparkSession)
        if now == before:
            break
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    old, links = links, gathered(links, now[0])
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = store(links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops))
    drop_stored(old)
    return out
