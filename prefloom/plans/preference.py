"""Preference, SFT and evaluation data as whole DataFrame plans.

These compose the operators the way the reference's scripts chain their
steps; each returns a lazy DataFrame, Catalyst plans it whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions import scoring
from prefloom.operators import code_exec, pairs, prompts


def score_responses(responses: DataFrame, scorer: str = "math", response_col: str = "response",
                    answer_col: str = "answer", **kw) -> DataFrame:
    """Add ``score`` from a registered scorer (``math``, ``medical``, ...)."""
    if scorer == "math" and kw:
        col = scoring.math_score(response_col, answer_col, **kw).cast("int")
    elif scorer == "medical" and kw:
        col = scoring.choice_score(response_col, answer_col, **kw)
    else:
        col = scoring.get_scorer(scorer)(F.col(response_col), F.col(answer_col))
    return responses.withColumn("score", col)


def preference_data(scored: DataFrame, problems: DataFrame | None, max_pairs: int,
                    key_cols: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Capped pairs with texts: ``problem, accepted, rejected`` plus keys."""
    narrow = pairs.preference_pairs(scored, max_pairs, group_cols=key_cols)
    return pairs.attach_texts(narrow, scored, problems, group_cols=key_cols)


def code_preference_data(responses: DataFrame, results: DataFrame, problems: DataFrame | None,
                         max_pairs: int, on_error: str = "zero") -> DataFrame:
    """Code pairs: scores are passed test cases (0 for forbidden code or a
    failed run), then the same capped pairing."""
    counts = code_exec.pass_counts(results, on_error=on_error)
    scored = code_exec.code_scores(responses, counts)
    return preference_data(scored, problems, max_pairs)


def output_projection(pairs_with_text: DataFrame, keys: Sequence[str] = ("problem_id", "pair_rank")) -> DataFrame:
    """The published shape: ``problem, accepted, rejected`` (keys kept)."""
    return pairs_with_text.select(*keys, "problem", "accepted", "rejected")


def chat_pairs(pairs_with_text: DataFrame, keep_original: bool = True) -> DataFrame:
    """Message lists ``chosen``/``rejected_messages`` for reward training,
    evaluation and selection; the original texts stay beside them."""
    chosen, rejected = prompts.pair_messages("problem", "accepted", "rejected")
    out = pairs_with_text.withColumn("chosen", chosen).withColumn("rejected_messages", rejected)
    if not keep_original:
        out = out.drop("accepted", "rejected")
    return out


def sft_data(problems: DataFrame, completions: DataFrame, key_cols: Sequence[str] = ("problem_id",)) -> DataFrame:
    """(problem, completion) rows, one per sampled response, unscored."""
    return prompts.sft_rows(problems, completions, key_cols)
