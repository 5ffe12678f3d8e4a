import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from priorform.catalog.statistics import DATASETS
from priorform.sources import checks, sinks, tables

SMALL = "/root/testdata/sf0.001"


def test_jdbc_options_split_only_when_complete():
    base = dict(url="jdbc:x", dbtable="game", user="u", password="p", driver="d")
    assert "partitionColumn" not in tables.jdbc_options(**base)
    full = tables.jdbc_options(**base, partition_column="game_id", lower=0, upper=9, num_partitions=3)
    assert (full["partitionColumn"], full["lowerBound"], full["upperBound"], full["numPartitions"]) == ("game_id", "0", "9", "3")
    with pytest.raises(ValueError):
        tables.jdbc_options(**base, partition_column="game_id")


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("5.1,3.5,a\n4.9,3.0,b\n")
    named = tables.read_csv(spark, str(tmp_path / "iris.csv"), schema="w double, l double, c string", header=False)
    assert [tuple(r) for r in named.collect()] == [(5.1, 3.5, "a"), (4.9, 3.0, "b")]
    sinks.write_csv(named, str(tmp_path / "out"))
    again = tables.read_csv(spark, str(tmp_path / "out"))
    assert dict(again.dtypes) == {"w": "double", "l": "double", "c": "string"} and again.count() == 2


def test_materialize_ignore_keeps_and_overwrite_rebuilds(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.materialize(spark.range(3), path).count() == 3
    assert sinks.materialize(spark.range(5), path).count() == 3
    assert sinks.materialize(spark.range(5), path, mode="overwrite").count() == 5


def test_stage_is_read_back_from_the_configured_folder(spark):
    out = sinks.stage(spark.range(4).withColumn("x", F.col("id") * 2))
    assert {r["x"] for r in out.collect()} == {0, 2, 4, 6}
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in out.inputFiles())


def test_delete_where_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert [r[0] for r in sinks.delete_where(df, F.col("x") > 1).collect()] == [1, None]


def test_views_and_disk(spark):
    kept = tables.register_view(spark.range(2), "kept_view", on_disk=True)
    assert kept.storageLevel == StorageLevel.DISK_ONLY
    assert spark.sql("select count(*) from kept_view").first()[0] == 2
    kept.unpersist()


def test_duplicate_and_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None), (3, 3)], "a int, b int")
    assert {(r["a"], r["b"], r["n"]) for r in checks.duplicate_keys(df, ["a", "b"]).collect()} == {(1, 1, 2), (2, None, 1)}
    with pytest.raises(ValueError):
        checks.assert_unique(df, ["a", "b"])
    assert checks.assert_unique(df.where("a = 3"), ["a"]).count() == 1


def test_corrections_touch_one_key(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "k int, a double, b string")
    fix = spark.createDataFrame([(2, None, "z")], "k int, a double, b string")
    assert [tuple(r) for r in checks.apply_corrections(df, fix, ["k"], ["a", "b"]).orderBy("k").collect()] == [(1, 1.0, "x"), (2, 2.0, "z")]


def test_dataset_choice(spark):
    spec = DATASETS.choose("lines")
    assert spec.load(spark, SMALL).columns == [*spec.predictors, spec.response]
    assert DATASETS.choose(seed=1).name in DATASETS.names()
    with pytest.raises(ValueError):
        DATASETS.choose("nothing")


def test_sql_over_frames(spark):
    assert tables.query(spark, "select max(id) as m from {rows}", rows=spark.range(7)).first()["m"] == 6


def test_snapshot_is_reused_until_input_or_recipe_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = lambda *v: spark.createDataFrame([(i,) for i in v], "x int").coalesce(1)
    rows(1, 2).write.parquet(source)
    read = lambda: spark.read.schema("x int").parquet(source)
    name = f"t{tmp_path.name}"
    path = sinks.snapshot_path(read(), name, "all")
    first = sinks.snapshot(read(), name, "all")
    assert sorted(r["x"] for r in first.collect()) == [1, 2] and sinks.snapshot_path(read(), name, "all") == path
    files = first.inputFiles()
    assert sinks.snapshot(read(), name, "all").inputFiles() == files  # not written again
    assert sinks.snapshot_path(read(), name, "other") != path
    rows(3).write.mode("append").parquet(source)
    assert sorted(r["x"] for r in sinks.snapshot(read(), name, "all").collect()) == [1, 2, 3]
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [1, 2]
    broken = sinks.snapshot_path(read(), name, "broken")
    rows(9).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(broken)
    assert sorted(r["x"] for r in sinks.snapshot(read(), name, "broken").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.snapshot(spark.range(3), name, "no files")
