"""Split tables, snapshots, metrics and source mixing from tables."""

import os

from pyspark.sql import functions as F

from prefloom.plans import jobs
from prefloom.sources import tables
from tests.conftest import rows


def test_splits_roundtrip_and_pruning(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("problem_id"), F.lit(1).alias("pair_rank"),
                                (F.col("id") * 2).alias("v"))
    path = str(tmp_path / "ds")
    tables.write_splits({"train": df.where("problem_id < 10"), "rest": df.where("problem_id >= 10")}, path)
    tr = tables.read_split(spark, path, tables.pool_split(True))
    rest = tables.read_split(spark, path, tables.pool_split(False))
    assert tr.count() == 10 and rest.count() == 20
    plan = rest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split" in plan
    assert {"split=rest", "split=train"} <= set(os.listdir(path))


def test_csv_snapshot_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", "b")], "problem string, accepted string, rejected string")
    tables.write_table(df, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert rows(back) == [("p", "a", "b")]
    tables.write_metrics(spark, [{"round": 1, "accuracy": 0.5}], str(tmp_path / "m"))
    tables.write_metrics(spark, [{"round": 2, "accuracy": 0.6}], str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_load_sources_by_ratio(spark, tmp_path):
    specs = []
    for i, ratio in enumerate([1.0, 1.0, 2.0]):
        path = str(tmp_path / f"s{i}")
        df = spark.range(100).select((F.col("id") + 1000 * i).alias("problem_id"), F.lit(f"t{i}").alias("problem"))
        tables.write_splits({"train": df}, path)
        specs.append({"name": f"s{i}", "path": path, "split": "train", "ratio": ratio})
    mixed = jobs.load_sources(spark, specs, 40, 42)
    got = dict(rows(mixed.groupBy("source_name").count(), "source_name", "count"))
    assert got == {"s0": 10, "s1": 10, "s2": 20}
    assert mixed.select("problem_id").distinct().count() == 40
    ids = rows(mixed.where("source_name = 's2'"), "problem_id", "source_problem_id")
    assert all(p == f"2:{s}" for p, s in ids)


def test_load_sources_rekeys_overlapping_ids(spark, tmp_path):
    specs = []
    for i in range(2):
        path = str(tmp_path / f"o{i}")
        tables.write_splits({"train": spark.range(5).withColumnRenamed("id", "problem_id")}, path)
        specs.append({"name": f"o{i}", "path": path, "split": "train", "ratio": 1.0})
    mixed = jobs.load_sources(spark, specs, 10, 1)
    assert mixed.select("problem_id").distinct().count() == 10


def test_load_sources_one_path_two_splits_and_large_ids(spark, tmp_path):
    path = str(tmp_path / "both")
    big = spark.range(1).select((F.lit(1 << 40) + F.col("id")).alias("problem_id"))
    tables.write_splits({"train": spark.range(3).withColumnRenamed("id", "problem_id"), "rest": big.union(spark.range(1))}, path)
    specs = [{"path": path, "split": "train"}, {"path": path, "split": "rest"}]
    ids = [r[0] for r in rows(jobs.load_sources(spark, specs, None, 1), "problem_id")]
    assert sorted(ids) == ["0:0", "0:1", "0:2", "1:0", f"1:{1 << 40}"]


def test_split_dataset_by_problem(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") / 4).cast("long").alias("problem_id"),
                                  (F.col("id") % 4).cast("int").alias("pair_rank"))
    out = jobs.split_dataset(spark, df, 0.2, 7, str(tmp_path / "sp"))
    tr, ev = tables.read_split(spark, out, "train"), tables.read_split(spark, out, "eval")
    assert tr.count() + ev.count() == 2000
    assert tr.select("problem_id").intersect(ev.select("problem_id")).count() == 0
    share = ev.select("problem_id").distinct().count() / 500
    assert 0.12 < share < 0.28


def test_scale_conf():
    from prefloom.session import scale_conf

    c = scale_conf(100 * 10**12, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 372530  # 100 TB / 256 MB
    assert c["spark.sql.files.maxPartitionBytes"] == "256m"
    small = scale_conf(10**9, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least two tasks per core


def test_scratch_under_checkpoint_root(spark):
    from prefloom.session import checkpoint_root, reliable_checkpoint, scratch_path

    root = checkpoint_root(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert root == conf.rstrip("/")
    p1, p2 = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert p1.startswith(root + "/prefloom/x-") and p1 != p2
    df = spark.range(5).withColumn("y", F.col("id") * 2)
    back = reliable_checkpoint(df, "unit")
    assert sorted(rows(back)) == [(i, 2 * i) for i in range(5)]
    assert "FileScan parquet" in back._jdf.queryExecution().executedPlan().toString()
