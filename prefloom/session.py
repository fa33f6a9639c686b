"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Conf used by tests and bench; on a cluster the user's session is used as is.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "prefloom", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and incremental state.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir). A
    single-process session (``local[...]``, as in tests) without either gets a
    temporary folder of its own; a cluster without it is an error, since its
    machines would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="prefloom-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the checkpoint root."""
    return f"{checkpoint_root(spark)}/prefloom/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df, name: str = "ckpt"):
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage and survives executor loss (unlike a local checkpoint).
    A Parquet write computes the plan once; ``DataFrame.checkpoint`` would
    compute it twice (once to count, once to write) unless cached.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Suggested settings for a large run (to pass to ``build_session`` or a
    cluster's defaults).

    Scan and shuffle partitions target ``partition_bytes`` (so a task's
    share fits executor memory and spills little); the initial shuffle
    width is sized for the largest exchange (the text join moves about the
    input's text volume) and AQE coalesces the narrow ones; skew splitting
    and runtime broadcast stay on with explicit thresholds.
    """
    import math

    width = max(2 * total_cores, math.ceil(input_bytes / partition_bytes))
    mb = f"{partition_bytes >> 20}m"
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(width),
        "spark.sql.shuffle.partitions": str(width),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": mb,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        # model calls: Arrow batches of whole texts stay moderate in size
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    }
