"""Table sources and view registration."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Tables:
    """Parquet tables of one folder as attributes: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def jdbc_options(
    *,
    url: str,
    dbtable: str,
    user: str,
    password: str,
    driver: str,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a database table, split on ``partition_column`` when given.

    Without a partition column one task reads the whole table, so pass it for
    everything but small tables.
    """
    options = {
        "url": url,
        "dbtable": dbtable,
        "user": user,
        "password": password,
        "driver": driver,
        "fetchsize": str(fetch_size),
    }
    split = (partition_column, lower, upper, num_partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("partition_column, lower, upper and num_partitions go together")
        options |= {
            "partitionColumn": str(partition_column),
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(num_partitions),
        }
    return options


def jdbc_table(spark: SparkSession, **kwargs) -> DataFrame:
    """A database table as a frame; arguments as in :func:`jdbc_options`."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


def read_csv(
    spark: SparkSession, path: str, *, schema: StructType | str | None = None, header: bool = True
) -> DataFrame:
    """CSV with or without a header line.

    A schema names the columns of a headerless file. Without one the types are
    inferred, which costs a pass over the file.
    """
    if schema is None:
        return spark.read.csv(path, header=header, inferSchema=True)
    return spark.read.schema(schema).csv(path, header=header)


def query(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text over registered views and over the given frames (as ``{name}``)."""
    return spark.sql(sql, **frames)


def register_view(df: DataFrame, name: str, *, on_disk: bool = False) -> DataFrame:
    """Name a frame for SQL; ``on_disk`` also keeps it on the executors' disks."""
    if on_disk:
        df = df.persist(StorageLevel.DISK_ONLY)
    df.createOrReplaceTempView(name)
    return df
