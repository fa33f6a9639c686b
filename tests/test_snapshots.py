"""Merged stream output and published table versions."""

import pytest
from pyspark.sql import functions as F

from prefloom.streaming import snapshots as S
from tests.conftest import rows


def write(spark, out, n):
    spark.range(3 * n, 3 * n + 3).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch_id={n}")


def files(path):
    return [p for p in path.rglob("*.parquet") if "_manifest" not in str(p)]


def test_many_batches_stay_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FAN", 3)
    out = str(tmp_path / "out")
    most = 0
    for n in range(60):
        write(spark, out, n)
        if n % 2:
            S.compact(spark, out, n)
            most = max(most, len(files(tmp_path)))
    assert most <= 20  # segments of four levels, with those the last merge replaced
    got = rows(S.read_snapshots(spark, out), "id", "batch_id")
    assert sorted(got) == [(i, i // 3) for i in range(180)]


def test_replays_and_a_merge_cut_short(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for n in range(4):
        write(spark, out, n)
    S.compact(spark, out, 2)
    write(spark, out, 1)  # a replay of a merged batch
    want = sorted((i, i // 3) for i in range(12))
    assert sorted(rows(S.read_snapshots(spark, out), "id", "batch_id")) == want
    S.compact(spark, out, 2)
    assert sorted(rows(S.read_snapshots(spark, out), "id", "batch_id")) == want

    def killed(*a, **b):
        raise KeyboardInterrupt

    monkeypatch.setattr(S, "write_metrics", killed)
    with pytest.raises(KeyboardInterrupt):  # the segment is written, the manifest is not
        S.compact(spark, out, 3)
    monkeypatch.undo()
    assert sorted(rows(S.read_snapshots(spark, out), "id", "batch_id")) == want
    S.compact(spark, out, 3)
    assert sorted(rows(S.read_snapshots(spark, out), "id", "batch_id")) == want
    assert S.batch_folders(spark, out) == []
    with pytest.raises(ValueError):
        S.read_snapshots(spark, str(tmp_path / "none"))


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    df = spark.range(40).withColumn("split", F.col("id") % 2)
    assert S.write_version(df, path, partition_by=["split"]) == 0
    old = S.read_version(spark, path)
    bad = df.withColumn("id", F.when(F.col("id") > 30, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        S.write_version(bad, path)
    assert S.read_version(spark, path).count() == 40
    assert S.write_version(df.where("id < 5"), path) == 1
    assert S.read_version(spark, path).count() == 5 and S.read_version(spark, path, 0).count() == old.count() == 40
    with pytest.raises(ValueError):
        S.read_version(spark, path, 7)
