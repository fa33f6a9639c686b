"""Incremental preference / SFT generation and running accuracy.

The reference loops over slices of problems and rewrites its whole output
at each snapshot, resuming from an index. Here the input is a file stream
of problems (one row per problem, so a problem is never cut by a batch);
each micro-batch generates its responses (or reads them from a static
table pruned to the batch), scores, pairs and writes ``batch_id=N`` by
overwrite,
so a replayed batch replaces its own output instead of duplicating it.
Progress lives in the checkpoint: a second run with the same checkpoint
processes only new files (``trigger(availableNow=True)``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators import evaluate
from prefloom.operators.sampling import running_sums
from prefloom.plans import preference
from prefloom.streaming import snapshots


def problem_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def in_buckets(table: DataFrame, batch: DataFrame, bucket_col: str) -> DataFrame:
    """The rows of a table partitioned by ``bucket_col`` in the buckets of the
    batch's rows: their numbers become literals of the filter, so the scan
    reads these folders alone."""
    found = [r[0] for r in batch.select(bucket_col).where(F.col(bucket_col).isNotNull()).distinct().collect()]  # a number for each bucket
    return table.where(F.col(bucket_col).isin(found))


def _batch_path(out: str, batch_id: int) -> str:
    return f"{out.rstrip('/')}/batch_id={batch_id}"


def incremental_preferences(spark: SparkSession, problems_path: str, problem_schema, responses: DataFrame | None,
                            out: str, checkpoint: str, scorer: str = "math", max_pairs: int = 4,
                            max_files_per_trigger: int = 1, bucket_col: str | None = None,
                            make_generate_fn: Callable | None = None, num_samples: int = 8,
                            prompt_col: str = "prompt", batch_size: int = 64, save_every: int | None = None) -> str:
    """Preference pairs per micro-batch of problems.

    With ``save_every`` the batches' folders are merged each time so many are
    written (``snapshots.compact``); read the output with
    ``snapshots.read_snapshots`` then.

    ``problems_path`` holds problem rows (``problem_id, problem, answer`` and,
    for generation, ``prompt``). Responses come either from
    ``make_generate_fn`` (generated inside the micro-batch, as the
    reference's batch loop does; written once before scoring) or from a
    static ``responses`` table (``problem_id, response_idx, response``).
    A static table should be partitioned by ``bucket_col`` (a problem bucket
    the problem rows carry too, with a fixed number of buckets), so that a
    batch reads its own buckets alone (``in_buckets``). Buckets that follow
    the order in which problems arrive are then read about once in all.
    """
    if (responses is None) == (make_generate_fn is None):
        raise ValueError("give either responses or make_generate_fn")

    def handle(batch: DataFrame, batch_id: int) -> None:
        probs = batch.select(*([bucket_col] if bucket_col else []), "problem_id", "problem", "answer",
                             *([prompt_col] if make_generate_fn else []))
        if make_generate_fn is not None:
            from prefloom.operators import model

            gen = model.generate(probs.select("problem_id", prompt_col), make_generate_fn, num_samples, batch_size)
            path = f"{out.rstrip('/')}/_completions/batch_id={batch_id}"
            gen.select("problem_id", "response_idx", "response").write.mode("overwrite").parquet(path)
            resp = batch.sparkSession.read.parquet(path).join(probs.select("problem_id", "answer"), "problem_id")
        else:
            keys = [bucket_col, "problem_id"] if bucket_col else ["problem_id"]
            resp = in_buckets(responses, probs, bucket_col) if bucket_col else responses
            resp = resp.join(probs.select(*keys, "answer"), keys).drop(*([bucket_col] if bucket_col else []))
        scored = preference.score_responses(resp, scorer)
        out_df = preference.preference_data(scored, probs.select("problem_id", "problem"), max_pairs)
        out_df.write.mode("overwrite").parquet(_batch_path(out, batch_id))
        if save_every and (batch_id + 1) % save_every == 0:
            snapshots.compact(batch.sparkSession, out, batch_id)

    _run(problem_stream(spark, problems_path, problem_schema, max_files_per_trigger), handle, checkpoint)
    return out


def incremental_sft(spark: SparkSession, problems_path: str, problem_schema, completions: DataFrame | None,
                    out: str, checkpoint: str, max_files_per_trigger: int = 1, bucket_col: str | None = None,
                    make_generate_fn: Callable | None = None, num_samples: int = 1,
                    prompt_col: str = "prompt", batch_size: int = 64) -> str:
    """(problem, completion) rows per micro-batch of problems; resumable
    like the preference run (the reference's SFT script ignores its resume
    flag). Completions are generated in the batch or read from a static
    table, pruned by ``bucket_col`` as in ``incremental_preferences``."""
    if (completions is None) == (make_generate_fn is None):
        raise ValueError("give either completions or make_generate_fn")

    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = [bucket_col, "problem_id"] if bucket_col and make_generate_fn is None else ["problem_id"]
        probs = batch.select(*keys, "problem")
        if make_generate_fn is not None:
            from prefloom.operators import model

            comp = model.generate(batch.select("problem_id", prompt_col), make_generate_fn, num_samples, batch_size)
        else:
            comp = in_buckets(completions, probs, bucket_col) if bucket_col else completions
        rows = preference.sft_data(probs, comp, keys)
        rows.select("problem_id", "response_idx", "problem", "completion") \
            .write.mode("overwrite").parquet(_batch_path(out, batch_id))

    _run(problem_stream(spark, problems_path, problem_schema, max_files_per_trigger), handle, checkpoint)
    return out


def incremental_accuracy_counts(spark: SparkSession, pairs_path: str, pair_schema, out: str, checkpoint: str,
                                max_files_per_trigger: int = 1, group_cols: Sequence[str] = ()) -> str:
    """Per-micro-batch pair counts of scored pairs (``r_accepted``,
    ``r_rejected``) for each group, appended as ``batch_id=N``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        acc = evaluate.pairwise_accuracy(batch, group_cols).select(*group_cols, "n_pairs", "n_correct", "n_ties")
        acc.write.mode("overwrite").parquet(_batch_path(out, batch_id))

    _run(problem_stream(spark, pairs_path, pair_schema, max_files_per_trigger), handle, checkpoint)
    return out


def running_accuracy_from_counts(spark: SparkSession, counts_path: str, where=None) -> DataFrame:
    """Accuracy after each micro-batch: running sums of the per-batch counts
    (of the group that the condition ``where`` names)."""
    counts = spark.read.parquet(counts_path)
    if where is not None:
        counts = counts.where(where)
    cum = running_sums(counts, ["batch_id"], ["n_pairs", "n_correct"])
    return cum.select("batch_id", F.col("n_pairs_cum").alias("seen"), F.col("n_correct_cum").alias("correct"),
                      (F.col("n_correct_cum") / F.col("n_pairs_cum")).alias("accuracy"))


def streaming_accuracy(spark: SparkSession, pairs_path: str, pair_schema, out: str, checkpoint: str,
                       group_cols: Sequence[str] = (), batch_col: str = "batch_id", max_files_per_trigger: int = 1) -> str:
    """Pair counts of each evaluation batch, kept in the stream's state store.

    Pairs carry the number of their evaluation batch (``sampling.batch_ids``),
    so the counts, and the running accuracy made of them
    (``evaluate.accuracy_from_counts`` on ``latest_counts``), do not depend on
    which files arrive together or in what order. Each micro-batch writes the
    counts that changed as ``update=N`` by overwrite: a replay replaces its own
    output, and a restart with the same checkpoint goes on from the state. The
    state is one narrow row per group and batch, spread over the shuffle
    partitions; with the RocksDB provider it is on disk.
    """
    win, tie = F.col("r_accepted") > F.col("r_rejected"), F.col("r_accepted") == F.col("r_rejected")
    counts = problem_stream(spark, pairs_path, pair_schema, max_files_per_trigger).groupBy(*group_cols, batch_col).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(win).alias("n_correct"), F.count_if(tie).alias("n_ties"))

    def handle(changed: DataFrame, n: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/update={n}")

    q = (counts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest_counts(spark: SparkSession, out: str, group_cols: Sequence[str] = (), batch_col: str = "batch_id") -> DataFrame:
    """The counts after the last update of each group and batch."""
    counts = F.struct("n_pairs", "n_correct", "n_ties")
    return (spark.read.parquet(out).groupBy(*group_cols, F.col(batch_col).alias("batch_id"))
            .agg(F.max_by(counts, "update").alias("_c")).select(*group_cols, "batch_id", "_c.*"))


def pending_problems(problems: DataFrame, written: DataFrame, key: str = "problem_id") -> DataFrame:
    """Problems not yet in the output (resume by anti-join, no index
    arithmetic; duplicate keys in the output need no distinct)."""
    return problems.join(written.select(key), key, "left_anti")

