"""Small constant tables built inside the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def literal_rows(spark: SparkSession, fields: Sequence[tuple[str, str | DataType]], rows: Sequence[Sequence]) -> DataFrame:
    """A frame of constants: ``fields`` are (name, type). Its size is that of ``rows``."""
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows
    ]
    base = spark.range(1, numPartitions=1)
    if not structs:
        return base.select(*[F.lit(None).cast(t).alias(n) for n, t in fields]).where(F.lit(False))
    return base.select(F.inline(F.array(*structs)))
