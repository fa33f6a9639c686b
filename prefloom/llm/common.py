"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import checkpoint_root, reliable_checkpoint

U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once under ``spark.checkpoint.dir`` and read back: cuts lineage,
    survives lost executors."""
    checkpoint_root(df.sparkSession)
    return reliable_checkpoint(df, f"llm-{name}")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose string column holds about ``most_bytes``
    (a longer single text is a slice of its own), so that memory is bounded
    by the longest text."""
    for batch in batches:
        col = batch.column(column)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if str(col.type).startswith("large") else np.int32)
        offsets = offsets[col.offset:col.offset + len(col) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class StaticTable:
    """Read-only hash table from distinct uint64 keys to their row numbers,
    probed for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, U64)
        self.bits = max(4, int(max(1, len(keys)) * 2 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.zeros(size, U64)
        self.rows = np.full(size, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            # of the keys that want a free slot, the last written one gets it
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]
            placed = free & (self.rows[slot] == left)
            self.keys[slot[placed]] = keys[left[placed]]
            slot, left = (slot[~placed] + 1) & (size - 1), left[~placed]

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> StaticTable:
        """The table that has these arrays."""
        out = cls.__new__(cls)
        out.keys, out.rows, out.bits = keys, rows, len(rows).bit_length() - 1
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(GOLDEN)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            rows = self.rows[slot]
            used = rows >= 0
            hit = used & (self.keys[slot] == keys)
            out[at[hit]] = rows[hit]
            more = used & ~hit
            at, slot, keys = at[more], (slot[more] + 1) & (len(self.rows) - 1), keys[more]
        return out


def most_frequent(counted: DataFrame, most: int, ties: list[str], n: str = "n") -> DataFrame:
    """The ``most`` rows with the largest counts, ties by ``ties``.

    A histogram of the counts' magnitudes (16 steps for each power of 2) tells
    which rows can be among them; only these are ranked, so that about ``most``
    rows meet in one place instead of ``most`` from each task. Give ``counted``
    saved, since it is read twice.
    """
    step = F.floor(F.log2(n) * 16).cast("int")
    seen, least = 0, 0
    for magnitude, rows in sorted(counted.groupBy(step).count().collect(), reverse=True):
        seen, least = seen + rows, magnitude
        if seen >= most:
            break
    return counted.where(step >= F.lit(least)).orderBy(F.desc(n), *ties).limit(most)


def running_total(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` per ``group`` (a long) in ``order``.

    One range exchange on (group, order): a group that holds a third of all
    rows spreads over many tasks. Each task sums its own rows; the totals of
    earlier tasks, one row per (task, group), are added by a join.
    """
    keys = [group, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_task", F.spark_partition_id())
    fields = df.columns
    g, v = fields.index(group), fields.index(value)

    def local(batches):
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(g).to_numpy(zero_copy_only=False)
            values = batch.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(values)
            first = np.concatenate([[True], groups[1:] != groups[:-1]])
            if last is not None and groups[0] == last:
                total += carried
            at = np.flatnonzero(first)
            base = np.where(at == 0, 0, total[at - 1])
            run = total - np.repeat(base, np.diff(np.append(at, len(total))))
            last, carried = groups[-1], int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64())],
                                             names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", `{name}` bigint"
    local_runs = saved(dealt.mapInArrow(local, schema), "runs")
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local_runs.groupBy(group, "_task").agg(F.sum(value).alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum"))
    return (local_runs.join(offsets, [group, "_task"])
            .withColumn(name, F.col(name) + F.col("_before")).drop("_task", "_before"))
