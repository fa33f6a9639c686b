"""Merged snapshots of a stream's output, and tables with published versions.

Micro-batches write ``batch_id=N`` folders. ``compact`` merges them into
segments: ten segments of a level become one of the next, so the number of
files grows with the logarithm of the number of batches. What is live is told
by a manifest, a one-row table written after the data it names: readers take
the last one and never see half a merge, a job that dies leaves the former
state, and a batch that is replayed after its merge is ignored (its rows, which
are the same, are in a segment).

``write_version`` and ``read_version`` do the same for whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.sources.tables import write_metrics, write_table

#: Segments of a level that are merged, and bytes of a merged file, about.
FAN, FILE_BYTES = 10, 128 << 20
_MANIFEST = "version long, segments array<struct<folder:string,level:int,first:long,last:long>>"
_VERSION = "version long, folder string"


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _last(spark: SparkSession, path: str, schema: str):
    """The row of the highest version in a manifest, None if there is none."""
    try:
        return spark.read.schema(schema).parquet(path).orderBy(F.desc("version")).first()
    except AnalysisException:  # not written yet
        return None


def batch_folders(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the ``batch_id=N`` folders that are there."""
    fs, p = _fs(spark, out)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id="))


def _read_batches(spark: SparkSession, out: str, batches: Sequence[int]) -> DataFrame:
    paths = [f"{out}/batch_id={n}" for n in batches]
    return spark.read.option("basePath", out).parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("long"))


def _merge(spark: SparkSession, out: str, df: DataFrame, paths: Sequence[str], level: int, first: int, last: int) -> dict:
    size = sum(fs.getContentSummary(p).getLength() for fs, p in (_fs(spark, x) for x in paths))
    folder = f"{level}-{first}-{last}-{uuid.uuid4().hex[:12]}"
    df.coalesce(int(size // FILE_BYTES) + 1).write.parquet(f"{out}/_segments/{folder}")
    return {"folder": folder, "level": level, "first": first, "last": last}


def compact(spark: SparkSession, out: str, batch_id: int) -> None:
    """Merge the batches up to ``batch_id`` that are in no segment yet.

    Merged folders go once the manifest is published; segments that a merge
    replaced stay until the next one, for readers of the last manifest."""
    out = out.rstrip("/")
    now = _last(spark, f"{out}/_manifest", _MANIFEST)
    segments = [s.asDict() for s in now["segments"]] if now else []
    before = {s["folder"] for s in segments}
    done = segments[-1]["last"] if segments else -1
    batches = [n for n in batch_folders(spark, out) if done < n <= batch_id]
    if not batches:
        return
    paths = [f"{out}/batch_id={n}" for n in batches]
    segments.append(_merge(spark, out, _read_batches(spark, out, batches), paths, 0, done + 1, batch_id))
    while len(segments) >= FAN and len({s["level"] for s in segments[-FAN:]}) == 1:
        some = segments[-FAN:]
        paths = [f"{out}/_segments/{s['folder']}" for s in some]
        segments[-FAN:] = [_merge(spark, out, spark.read.parquet(*paths), paths, some[0]["level"] + 1, some[0]["first"], some[-1]["last"])]
    write_metrics(spark, [{"version": now["version"] + 1 if now else 0, "segments": segments}], f"{out}/_manifest", schema=_MANIFEST)
    live = before | {s["folder"] for s in segments}
    fs, p = _fs(spark, f"{out}/_segments")
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in live]
    for old in [*gone, *[_fs(spark, f"{out}/batch_id={n}")[1] for n in batch_folders(spark, out) if n <= batch_id]]:
        fs.delete(old, True)


def read_snapshots(spark: SparkSession, out: str) -> DataFrame:
    """All rows of a stream's output with their ``batch_id``: the segments of
    the last manifest and the batches after them."""
    out = out.rstrip("/")
    now = _last(spark, f"{out}/_manifest", _MANIFEST)
    segments = now["segments"] if now else []
    later = [n for n in batch_folders(spark, out) if not segments or n > segments[-1]["last"]]
    parts = [spark.read.parquet(*[f"{out}/_segments/{s['folder']}" for s in segments])] if segments else []
    parts += [_read_batches(spark, out, later)] if later else []
    if not parts:
        raise ValueError(f"{out} holds no batches")
    return reduce(DataFrame.unionByName, parts)


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> int:
    """Write the table's next version beside the others, then publish it; one
    writer at a time. Returns its number."""
    spark, path = df.sparkSession, path.rstrip("/")
    now = _last(spark, f"{path}/_versions", _VERSION)
    version = now["version"] + 1 if now else 0
    folder = f"{version}-{uuid.uuid4().hex[:12]}"
    write_table(df, f"{path}/_data/{folder}", partition_by=partition_by)
    write_metrics(spark, [{"version": version, "folder": folder}], f"{path}/_versions", schema=_VERSION)
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last published version of a table, or a given one."""
    path = path.rstrip("/")
    rows = spark.read.schema(_VERSION).parquet(f"{path}/_versions")
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).first()
    if found is None:
        raise ValueError(f"{path} has no version {version}")
    return spark.read.parquet(f"{path}/_data/{found['folder']}")
