"""Sources and sinks: what was written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorform.catalog.registry import money, query
from priorform.sources.sinks import materialize, shared_folder, snapshot, write_csv
from priorform.sources.tables import Tables, read_csv, register_view
from priorform.sources.tables import query as run_sql

_PARTS = "select p_partkey, p_name, p_brand, p_size from part"


def _place(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/written-{uuid.uuid4().hex}"


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_brand", "p_size")


@query("csv_with_header", _PARTS)
def csv_with_header(t: Tables) -> DataFrame:
    """A CSV report with a header line, read back with inferred types."""
    path = _place(t)
    write_csv(_parts(t), path)
    return read_csv(t.spark, path, header=True).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("csv_without_header", _PARTS)
def csv_without_header(t: Tables) -> DataFrame:
    """A CSV file without a header line, named and typed by a schema."""
    path = _place(t)
    _parts(t).write.csv(path, header=False)
    return read_csv(t.spark, path, schema=_parts(t).schema, header=False)


_VERSIONED = "select o_orderkey, o_custkey, cast(year(o_orderdate) as int) as o_year, {version} as version from orders"


def _versioned(t: Tables, version: str) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"), F.lit(version).alias("version"))


@query("create_if_absent", _VERSIONED.format(version="'first'"))
def create_if_absent(t: Tables) -> DataFrame:
    """A table that exists already is kept and reused, whatever is written later."""
    path = _place(t)
    materialize(_versioned(t, "first"), path, mode="ignore", partition_by=["o_year"])
    return materialize(_versioned(t, "second"), path, mode="ignore", partition_by=["o_year"])


@query("replace_table", _VERSIONED.format(version="'second'"))
def replace_table(t: Tables) -> DataFrame:
    """An overwritten table holds the new rows only; it is partitioned by year."""
    path = _place(t)
    materialize(_versioned(t, "first"), path, mode="overwrite", partition_by=["o_year"])
    return materialize(_versioned(t, "second"), path, mode="overwrite", partition_by=["o_year"])


_BY_YEAR = """select cast(year(o_orderdate) as int) as o_year, count(*) as n,
       sum(cast(o_totalprice as decimal(18,2))) as total from orders group by 1"""


@query("snapshot_reuse", _BY_YEAR)
def snapshot_reuse(t: Tables) -> DataFrame:
    """Yearly totals as a snapshot of the order files; the second call finds what the first one stored."""
    totals = t.orders.groupBy(F.year("o_orderdate").alias("o_year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice")).alias("total")
    )
    snapshot(totals, "yearly-orders", _BY_YEAR)
    return snapshot(totals, "yearly-orders", _BY_YEAR)


@query(
    "named_view",
    "select o_orderpriority, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by 1",
)
def named_view(t: Tables) -> DataFrame:
    """A frame that is named, kept on disk and asked by SQL text."""
    name = f"orders_{uuid.uuid4().hex}"
    register_view(t.orders.select("o_orderpriority", "o_totalprice"), name, on_disk=True)
    return run_sql(
        t.spark,
        f"select o_orderpriority, count(*) as n, sum(cast(o_totalprice as decimal(18,2))) as total from {name} group by 1",
    )
