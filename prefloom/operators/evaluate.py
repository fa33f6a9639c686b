"""Pairwise accuracy of reward scores, per group, as a matrix, and running.

Accuracy is strictly-greater over all pairs; a tie counts as wrong (and is
reported). An empty input has null accuracy instead of a division by zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import count_tokens
from prefloom.operators.sampling import batch_ids, join_same, running_sums


def _flags(chosen: str, rejected: str):
    c, r = F.col(chosen), F.col(rejected)
    return (c > r).cast("long"), (c == r).cast("long")


def pairwise_accuracy(scored_pairs: DataFrame, group_cols: Sequence[str] = (),
                      chosen: str = "r_accepted", rejected: str = "r_rejected") -> DataFrame:
    """``n_pairs, n_correct, n_ties, accuracy`` per group (partial aggregation)."""
    win, tie = _flags(chosen, rejected)
    aggs = [F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum(win), F.lit(0)).alias("n_correct"),
            F.coalesce(F.sum(tie), F.lit(0)).alias("n_ties")]
    g = scored_pairs.groupBy(*group_cols) if group_cols else scored_pairs.groupBy()
    out = g.agg(*aggs)
    acc = F.when(F.col("n_pairs") > 0, F.col("n_correct") / F.col("n_pairs"))
    return out.withColumn("accuracy", acc)


def accuracy_cells(scored_pairs: DataFrame, row: str = "model", col: str = "domain",
                   chosen: str = "r_accepted", rejected: str = "r_rejected") -> DataFrame:
    """``row, col, n_pairs, accuracy``: a row for each cell that occurs
    (partial aggregation)."""
    win, _ = _flags(chosen, rejected)
    return scored_pairs.groupBy(row, col).agg(F.count(F.lit(1)).alias("n_pairs"),
                                              F.avg(win.cast("double")).alias("accuracy"))


def accuracy_matrix(scored_pairs: DataFrame, row: str = "model", col: str = "domain",
                    values: Sequence[str] | None = None, chosen: str = "r_accepted",
                    rejected: str = "r_rejected") -> DataFrame:
    """``accuracy_cells`` pivoted to a column for each value of ``col`` (or of
    ``values`` alone), for display."""
    cells = accuracy_cells(scored_pairs, row, col, chosen, rejected).groupBy(row)
    p = cells.pivot(col, list(values)) if values is not None else cells.pivot(col)
    return p.agg(F.first("accuracy"))


def running_accuracy(scored_pairs: DataFrame, order_cols: Sequence[str], batch_size: int,
                     chosen: str = "r_accepted", rejected: str = "r_rejected",
                     every: int = 1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Accuracy after each batch (every ``every``-th batch and the last), per
    group of ``group_cols`` (the models of an evaluation, say) in one plan.

    Pairs are numbered in ``order_cols`` order (distributed positions),
    counted per batch, and the per-batch counts are summed in batch order
    with a distributed running sum.
    """
    groups = list(group_cols)
    win, _ = _flags(chosen, rejected)
    b = batch_ids(scored_pairs, order_cols, batch_size, groups)
    per = b.groupBy(*groups, "batch_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(win).alias("n_correct"))
    return accuracy_from_counts(per, every, groups)


def accuracy_from_counts(per: DataFrame, every: int = 1, group_cols: Sequence[str] = ()) -> DataFrame:
    """``batch_id, seen, correct, accuracy`` after each batch, from its counts
    ``n_pairs`` and ``n_correct`` (per group; every ``every``-th and the last)."""
    groups = list(group_cols)
    out = running_sums(per, ["batch_id"], ["n_pairs", "n_correct"], group_cols=groups)
    if every > 1:  # log every `every`-th batch and the last one
        last = per.groupBy(*groups).agg(F.max("batch_id").alias("_last"))
        out = join_same(out, last, groups) if groups else out.crossJoin(F.broadcast(last))  # one row
        out = out.where((F.col("batch_id") % every == 0) | (F.col("batch_id") == F.col("_last")))
    return out.select(*groups, "batch_id", F.col("n_pairs_cum").alias("seen"), F.col("n_correct_cum").alias("correct"),
                      (F.col("n_correct_cum") / F.col("n_pairs_cum")).alias("accuracy"))


def length_filter(pairs: DataFrame, max_tokens: int, texts: Sequence[str] = ("accepted", "rejected"),
                  problem: str | None = "problem") -> DataFrame:
    """Keep pairs whose longest side (problem + response) has at most
    ``max_tokens`` white-space tokens (the problem is counted once)."""
    longest = F.greatest(*[count_tokens(c) for c in texts])
    if problem:
        longest = longest + count_tokens(problem)
    return pairs.where(longest <= F.lit(int(max_tokens)))


def length_filter_narrow(pairs: DataFrame, responses: DataFrame, problems: DataFrame, max_tokens: int,
                         key_cols: Sequence[str] = ("problem_id",), order_col: str = "response_idx",
                         text_col: str = "response", problem_col: str = "problem") -> DataFrame:
    """``length_filter`` on narrow pairs: tokens are counted once per
    response and per problem, and only the counts (not the texts) are joined
    to the pairs, on unique keys."""
    g = list(key_cols)
    rt = responses.select(*g, F.col(order_col), count_tokens(text_col).alias("_nt"))
    pt = problems.select(*g, count_tokens(problem_col).alias("_np"))
    ra = rt.withColumnRenamed(order_col, "accepted_idx").withColumnRenamed("_nt", "_na")
    rr = rt.withColumnRenamed(order_col, "rejected_idx").withColumnRenamed("_nt", "_nr")
    j = pairs.join(ra, g + ["accepted_idx"]).join(rr, g + ["rejected_idx"]).join(pt, g)
    longest = F.col("_np") + F.greatest(F.col("_na"), F.col("_nr"))
    return j.where(longest <= F.lit(int(max_tokens))).drop("_na", "_nr", "_np")


def truncate_tokens(c, max_tokens: int):
    """First ``max_tokens`` white-space tokens, joined by single spaces (the
    single-pair evaluation path truncates; the model sees at most that)."""
    from prefloom.functions.text import WS, py_strip
    toks = F.split(py_strip(c), f"{WS}+", -1)
    return F.array_join(F.slice(toks, 1, int(max_tokens)), " ")
