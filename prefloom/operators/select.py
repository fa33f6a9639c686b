"""Active selection: a seeded window of the pool, a gap-weighted sample
without replacement, and the complement.

The weight ``exp(-gap / temp)`` stays in log space: the Gumbel-top-k key
``-gap/temp - ln(-ln u)`` orders rows so that the first ``k`` are a weighted
sample without replacement (same distribution as successive draws, not the
same draws). Both the window and ``k`` are parameters; only they reach a
single task (``TakeOrderedAndProject``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.hashing import gumbel_key
from prefloom.operators.sampling import restrict, take_sample, top_keys
from prefloom.session import reliable_checkpoint


def selection_window(pool: DataFrame, max_to_look_at: int, seed, key_cols: Sequence[str]) -> DataFrame:
    """The first ``max_to_look_at`` pool rows of a seeded shuffle (clamped)."""
    return take_sample(pool, max_to_look_at, seed, key_cols, strict=False)


def with_gap(df: DataFrame, chosen: str = "r_accepted", rejected: str = "r_rejected") -> DataFrame:
    return df.withColumn("gap", F.abs(F.col(chosen) - F.col(rejected)))


def select_uncertain(window: DataFrame, k: int, seed, key_cols: Sequence[str], temp: float = 1.0,
                     gap_col: str = "gap", check: bool = True) -> DataFrame:
    """``k`` rows drawn with weight ``exp(-gap/temp)``, without replacement.

    Adds ``select_rank`` (1 = first in key order). More rows requested than
    the window holds is an error, as in the reference.
    """
    if temp <= 0:
        raise ValueError("temp must be positive")
    if check:
        have = window.count()
        if k > have:
            raise ValueError(f"cannot select {k} rows from a window of {have}")
    key = gumbel_key(-F.col(gap_col) / F.lit(float(temp)), f"{seed}:draw", *key_cols)
    keys = top_keys(window, k, [key], key_cols, rank_name="select_rank", descending=True)
    return restrict(window, keys, key_cols)


def split_selection(pool: DataFrame, selected: DataFrame, window: DataFrame, key_cols: Sequence[str],
                    keep_unseen: bool = False) -> DataFrame:
    """The rest after selection: window rows not selected (``left_anti``).
    With ``keep_unseen`` the pool rows outside the window are added back."""
    keys = list(key_cols)
    rest = window.join(selected.select(*keys), keys, "left_anti")
    if keep_unseen:
        unseen = pool.join(window.select(*keys), keys, "left_anti")
        rest = rest.unionByName(unseen.select(*rest.columns))
    return rest


def active_selection(pool: DataFrame, k: int, max_to_look_at: int, seed, key_cols: Sequence[str],
                     temp: float = 1.0, keep_unseen: bool = False,
                     score: Callable[[DataFrame], DataFrame] | None = None):
    """Window, rewards, gaps, weighted sample and complement: ``(selected, rest)``.

    ``score`` adds ``r_accepted`` and ``r_rejected`` to the window's rows, and
    to no others (without it the pool has them). The scored window is written
    once, since it feeds the count, the draw and the complement. Rows of the
    rest that the window never held have a null gap if ``score`` is given.
    """
    window = selection_window(pool, max_to_look_at, seed, key_cols)
    window = reliable_checkpoint(with_gap(score(window) if score else window), "window")
    selected = select_uncertain(window, k, seed, key_cols, temp)
    unseen = with_gap(pool) if score is None else pool.select(
        "*", *[F.lit(None).cast(window.schema[c].dataType).alias(c) for c in window.columns if c not in pool.columns])
    rest = split_selection(unseen, selected, window, key_cols, keep_unseen)
    return selected, rest
