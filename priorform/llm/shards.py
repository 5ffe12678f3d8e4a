"""Shards that all hold the sources in the mixture of the whole, by proportional stratified interleaving.

Rows are shuffled inside their source by a seeded hash and ranked there; a row's fractional rank is (rank - 1/2)
over the size of its source, so the fractional ranks of every source are spread evenly over 0 to 1. Sorted by it,
any stretch of rows has each source in its share, and the order is cut into shards of equal row counts.

Only columns and SQL functions. Neither a source nor the whole is ever sorted in one task: rows are ranked in
cells of an even grid over the hash, respectively over the fractional rank, and cells get their offsets from
running sums over cell counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorform.llm._common import store


def _running(cells: DataFrame, stratum: list[str], cell: str, n: str) -> DataFrame:
    """``before``: rows in the earlier cells of the stratum. Two levels, so that no task sees all cells."""
    block = (F.col(cell) / 4096).cast("long")
    blocks = cells.groupBy(*stratum, block.alias("__block")).agg(F.sum(n).alias("__n"))
    over = Window.partitionBy(*stratum).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*stratum, "__block", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*stratum, "__block").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.withColumn("__block", block)
        .withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(blocks, [*stratum, "__block"])
        .withColumn("before", F.col("__in") + F.col("__start"))
        .drop("__block", "__in", "__start", n)
    )


def shuffled(seed: int, id_col: Column) -> Column:
    """Hexadecimal key of the seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def interleave(
    docs: DataFrame, shards: int, *, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", rows_per_cell: int = 2048,
) -> DataFrame:
    """``id, size, text_crc32, shard, slot``: one row per input row, shards 0 to ``shards - 1``.

    Row counts differ by at most one; slots are 0, 1, ... without gaps in each shard. ``size`` is the text's
    UTF-8 bytes plus 1 (null: 1, with the CRC of no bytes). Rows without source are a source of their own.
    Equal hashes are ordered by id, CRC and size, so repeated rows are interchangeable. An empty table has no
    rows. Other columns are not read.
    """
    binary = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = store(
        docs.select(
            F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"),
            (F.octet_length(binary) + 1).cast("long").alias("size"), F.crc32(binary).alias("crc"), shuffled(seed, F.col(id_col)).alias("h"),
        )
    )
    total = facts.count()
    cells = max(1, -(-total // rows_per_cell))
    unit = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = facts.withColumn("cell", F.floor(unit * cells))
    counts = placed.groupBy("s", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n_s"))
    offsets = _running(counts, ["s"], "cell", "n").join(sizes, "s")
    here = Window.partitionBy("s", "cell").orderBy("h", "id", "crc", "size")
    ranked = store(
        placed.withColumn("r", F.row_number().over(here)).join(offsets, ["s", "cell"])
        .withColumn("f", (F.col("before") + F.col("r") - 0.5) / F.col("n_s")).drop("cell", "before", "r", "n_s")
    )
    spread = ranked.withColumn("cell", F.least(F.floor(F.col("f") * cells), F.lit(cells - 1)))
    offsets = _running(spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell", "n")
    here = Window.partitionBy("cell").orderBy("f", "h", "s", "id", "crc", "size")
    at = F.col("before") + F.col("r") - 1
    shard = F.expr(f"(before + r - 1) * {shards} div {max(total, 1)}")
    cut = spread.withColumn("r", F.row_number().over(here)).join(offsets, "cell").withColumn("shard", shard.cast("int"))
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return cut.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (at - start).cast("long").alias("slot"))
