"""Preference pairs: the first ``k`` unequal-score pairs of each group.

Semantics (per group, responses ordered by ``order_col``): walk all pairs
``(i, j)`` with ``i < j`` in lexicographic order, drop pairs with equal
scores, orient each kept pair so that the higher score is ``accepted``, keep
the first ``k``.

Plan. Enumerating all pairs of a group is quadratic and putting a group in
one task does not survive a group that holds a third of the data. Instead two
limits keep the responses that can take part in the first ``k`` pairs:

* The first ``2k`` responses of each (group, score). A pair's first response
  is among the group's first ``k`` (every response before the final run of
  equal scores opens at least one pair, so ``k`` of them open ``k`` pairs).
  A head needs at most ``k`` partners of another score, and the first ``2k``
  of a score hold at least ``k`` that come after such a head.
* Of these the first ``4k`` of each group: after a head at least ``3k`` rows
  remain, at most ``2k`` of its own score, so ``k`` partners are there.

Both are ``row_number() <= limit``, which Spark limits on the map side
(``WindowGroupLimit``): a hot group sends at most ``2k`` rows per score and
task, then ``4k`` per task. The pairs of the at most ``4k`` rows left are
formed within one row, without a join.

Texts are joined after the cap (late materialisation), on unique
``(group, order)`` keys, so no text crosses the pairing shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cap(max_pairs) -> int:
    if max_pairs is None:
        raise ValueError("max_pairs is required: emitting every pair of a group is quadratic; "
                         "use pair_counts() for the uncapped number of pairs")
    k = int(max_pairs)
    if k <= 0:
        raise ValueError(f"max_pairs must be positive, got {max_pairs!r} "
                         "(a negative cap slicing from the end is not supported)")
    return k


def preference_pairs(scored: DataFrame, max_pairs: int, group_cols: Sequence[str] = ("problem_id",),
                     order_col: str = "response_idx", score_col: str = "score") -> DataFrame:
    """Narrow capped pairs.

    Returns ``group_cols, pair_rank, i, j, accepted_idx, rejected_idx,
    accepted_score, rejected_score``; ``pair_rank`` is 1-based in (i, j)
    order. ``(group, order_col)`` is unique; responses with a null score are
    left out, since they cannot be compared.
    """
    k = _cap(max_pairs)
    g = list(group_cols)
    base = scored.select(*[F.col(c) for c in g], F.col(order_col).alias("_o"),
                         F.col(score_col).alias("_s")).where(F.col("_s").isNotNull())
    per_score = F.row_number().over(Window.partitionBy(*g, "_s").orderBy("_o"))
    per_group = F.row_number().over(Window.partitionBy(*g).orderBy("_o"))
    first = base.withColumn("_r", per_score).where(F.col("_r") <= 2 * k).drop("_r")
    first = first.withColumn("_r", per_group).where(F.col("_r") <= 4 * k).drop("_r")
    rows = first.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("_o", "_s"))).alias("_a"))

    def partners(head):
        later = F.filter("_a", lambda y: (y["_o"] > head["_o"]) & (y["_s"] != head["_s"]))
        return F.transform(F.slice(later, 1, k), lambda y: F.struct(head.alias("x"), y.alias("y")))

    found = F.slice(F.flatten(F.transform(F.slice("_a", 1, k), partners)), 1, k)
    out = rows.select(*g, F.posexplode(found).alias("_p", "_q"))
    oi, oj, si, sj = F.col("_q.x._o"), F.col("_q.y._o"), F.col("_q.x._s"), F.col("_q.y._s")
    return out.select(
        *g, (F.col("_p") + 1).alias("pair_rank"), oi.alias("i"), oj.alias("j"),
        F.when(si > sj, oi).otherwise(oj).alias("accepted_idx"), F.when(si > sj, oj).otherwise(oi).alias("rejected_idx"),
        F.greatest(si, sj).alias("accepted_score"), F.least(si, sj).alias("rejected_score"))


def pair_counts(scored: DataFrame, max_pairs: int | None = None,
                group_cols: Sequence[str] = ("problem_id",), score_col: str = "score") -> DataFrame:
    """Pairs per group before and after the cap, without listing pairs.

    ``n_pairs_all = C(n, 2) - sum over scores of C(c_s, 2)`` (pairs minus
    ties), from one partial aggregation. Exact in ``decimal(38,0)``: a hot
    group of 10^11 responses has about 5 * 10^21 pairs, beyond ``bigint``
    and beyond the integers a double holds exactly.
    """
    g = list(group_cols)
    dec = "decimal(38,0)"
    scored = scored.where(F.col(score_col).isNotNull())  # as in preference_pairs
    score_n = scored.groupBy(*g, F.col(score_col).alias("_s")).agg(F.count(F.lit(1)).alias("_cs"))
    c = F.col("_cs").cast(dec)
    per_group = score_n.groupBy(*g).agg(
        F.sum("_cs").alias("n_responses"),
        F.sum(c * (c - F.lit(1)) / F.lit(2)).cast(dec).alias("_ties"),
    )
    n = F.col("n_responses").cast(dec)
    all_pairs = (n * (n - F.lit(1)) / F.lit(2)).cast(dec) - F.col("_ties")
    out = per_group.select(*g, F.col("n_responses").cast("bigint").alias("n_responses"),
                           all_pairs.cast(dec).alias("n_pairs_all"))
    if max_pairs is not None:
        k = _cap(max_pairs)
        out = out.withColumn("n_pairs_kept", F.least(F.col("n_pairs_all"), F.lit(k).cast(dec)).cast("bigint"))
    return out


def attach_texts(pairs: DataFrame, responses: DataFrame, problems: DataFrame | None = None,
                 group_cols: Sequence[str] = ("problem_id",), order_col: str = "response_idx",
                 text_col: str = "response", problem_col: str = "problem") -> DataFrame:
    """Join response texts (and the problem text) to capped pairs.

    The responses that pairs use, at most ``2k`` of a group, are listed once
    and fetched by one join on the unique ``(group, order)`` key: one exchange
    of response texts. What they hold is brought together by group, where the
    pairs look up both sides and the problem: one exchange of chosen texts.
    """
    g = list(group_cols)
    names = [c for c in pairs.columns if c not in g]
    groups = pairs.groupBy(*g).agg(F.collect_list(F.struct(*names)).alias("_pairs"))
    used = groups.select(*g, F.explode(F.array_distinct(F.flatten(F.transform(
        "_pairs", lambda p: F.array(p["accepted_idx"], p["rejected_idx"]))))).alias(order_col))
    texts = responses.select(*g, order_col, text_col).join(used, [*g, order_col])
    held = texts.groupBy(*g).agg(F.map_from_entries(F.collect_list(F.struct(order_col, text_col))).alias("_texts"))
    out = groups.join(held, g).select(*g, "_texts", F.explode("_pairs").alias("_p"))
    out = out.select(*g, "_p.*", F.col("_texts")[F.col("_p.accepted_idx")].alias("accepted"),
                     F.col("_texts")[F.col("_p.rejected_idx")].alias("rejected"))
    if problems is not None:
        out = out.join(problems.select(*g, F.col(problem_col)), g)
    return out
