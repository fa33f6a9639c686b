"""Parquet tables with explicit keys and a ``split`` partition column.

Covers reading a named dataset split (partition-pruned), choosing the pool
split for active selection, and the writers: single table, split table,
per-batch snapshot and metrics record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_split(spark: SparkSession, path: str, split: str | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read a dataset written with ``write_splits``; the split filter prunes partitions."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.where(F.col("split") == F.lit(split))
    if columns:
        df = df.select(*columns)
    return df


def read_sources(spark: SparkSession, specs: Sequence[dict]) -> list[DataFrame]:
    """One DataFrame per source spec ``{"path": ..., "split": ..., "ratio": ...}``."""
    return [read_split(spark, s["path"], s.get("split")) for s in specs]


def pool_split(initial: bool) -> str:
    """The pool of the first selection round is ``train``, later ones ``rest``."""
    return "train" if initial else "rest"


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, fmt: str = "parquet") -> str:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    return path


def write_splits(splits: dict[str, DataFrame], path: str, mode: str = "overwrite") -> str:
    """Write several splits into one table partitioned by ``split``."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return write_table(out, path, mode=mode, partition_by=["split"])


def write_metrics(spark: SparkSession, records: list[dict], path: str, mode: str = "append", schema=None) -> str:
    """Append a few metric rows (a handful of driver-side numbers) as a table.
    Give a ``schema`` where values may be null."""
    return write_table(spark.createDataFrame(records, schema), path, mode=mode)
