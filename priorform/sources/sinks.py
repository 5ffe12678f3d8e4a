"""Stored stages and report files."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def materialize(
    df: DataFrame, path: str, *, mode: str = "ignore", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Store a stage as parquet and read it back.

    ``ignore`` keeps an existing table (create if absent, or reuse of a snapshot),
    ``overwrite`` rebuilds it. Reading back also cuts the lineage, so a lost
    executor never recomputes the stages before.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """CSV report with a header line."""
    df.write.mode(mode).csv(path, header=True)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """All rows but those where the predicate is true (unknown keeps the row)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a plain local session without that setting gets a folder of its own; on a cluster the setting is
    required, because a folder of one machine is not shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="priorform-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Store an intermediate table that several branches read, and return it read back.

    It goes to a new subfolder of :func:`shared_folder`, as parquet, so later branches read only the columns
    they need and a lost executor costs no recomputation.
    """
    return materialize(df, f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}", mode="error")


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed; one that broke off leaves no such mark."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def snapshot_path(df: DataFrame, name: str, recipe: str) -> str:
    """Where :func:`snapshot` stores the frame: it goes with the recipe, the schema and the files read.

    Files count by path, size and time of change; their contents are not read. A frame without files is refused.
    """
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        raise ValueError("a snapshot needs a frame that reads files")
    facts = spark.read.format("binaryFile").load(files).select("path", "modificationTime", "length")
    # sums of hashes do not depend on the order of the files and are combined before the shuffle
    hashes = [F.xxhash64(F.lit(i), "path", "modificationTime", "length").cast("decimal(38,0)") for i in range(2)]
    found = facts.agg(F.count(F.lit(1)), *(F.sum(h) for h in hashes)).first()
    key = hashlib.sha256("\n".join([recipe, df.schema.json(), *map(str, found)]).encode()).hexdigest()[:32]
    return f"{shared_folder(spark)}/{name}-{key}"


def snapshot(df: DataFrame, name: str, recipe: str) -> DataFrame:
    """A stored stage that is reused while its inputs and its ``recipe`` stay, and built again when one changes.

    ``recipe`` is the statement or the version of the code that makes the frame: two frames of one recipe over the
    same files are taken to be the same. A write that broke off is no snapshot and is done again.
    """
    path = snapshot_path(df, name, recipe)
    if _finished(df.sparkSession, path):
        return df.sparkSession.read.parquet(path)
    return materialize(df, path, mode="overwrite")
