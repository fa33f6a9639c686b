"""Model calls cut by padded tokens."""

import random
import sys

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from prefloom.operators import model
from tests.conftest import rows


@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 120))
def test_calls_hold_all_rows_within_the_budget(lengths, budget):
    calls = model.token_batches(np.array(lengths, np.int64), budget)
    assert sorted(i for c in calls for i in c.tolist()) == list(range(len(lengths)))
    for c in calls:
        longest = max(1, max(lengths[i] for i in c))
        assert len(c) == 1 or len(c) * longest <= budget


def test_less_padding_than_fixed_batches(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * (rng.choice([3, 5, 8]) if rng.random() < 0.9 else 400)) for _ in range(600)] + ["", None, "x" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3).persist()
    padded, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        def fn(batch):
            size = [len(str(t).split()) for t in batch]
            padded.add(len(batch) * max(size))
            calls.add(1)
            return np.array(size, float)
        return fn

    got = dict(rows(model.predict_scores_by_tokens(df, make, "t", 1024, "n"), "i", "n"))
    assert got == {i: None if t is None else float(len(t.split())) for i, t in enumerate(texts)}
    by_tokens, n_calls = padded.value, calls.value
    padded.value = calls.value = 0
    fixed = dict(rows(model.predict_scores(df.where("t IS NOT NULL"), make, ["t"], 8, "n"), "i", "n"))
    assert fixed == {i: x for i, x in got.items() if x is not None}
    assert by_tokens < padded.value / 2 and n_calls < calls.value
    real = sum(len(t.split()) for t in texts if t)
    assert by_tokens < 1.1 * real + 1024


def test_both_sides_by_tokens(spark):
    df = spark.createDataFrame([(1, "a b c", "a"), (2, "a", None)], "k long, chosen_text string, rejected_text string")
    got = rows(model.score_pair_sides(df, model.make_length_reward, token_budget=8), "k", "r_accepted", "r_rejected")
    plain = rows(model.score_pair_sides(df.where("k = 1"), model.make_length_reward), "k", "r_accepted", "r_rejected")
    assert sorted(got)[0] == plain[0] and sorted(got)[1][2] is None
    with pytest.raises(ValueError):
        model.predict_scores_by_tokens(df, model.make_length_reward, "chosen_text", 0)


def test_a_worker_converts_one_call_at_a_time(spark):
    """Of an Arrow batch of 9,000 rows only one call's texts are Python strings."""
    df = spark.range(9000).selectExpr("id AS i", "concat('text ', id) AS t").coalesce(1)

    def make():
        before = sys.getallocatedblocks()
        return lambda texts, *_: np.full(len(texts), float(sys.getallocatedblocks() - before))

    scored = model.predict_scores(df, make, ["t"], 8, "n")
    assert scored.selectExpr("max(n)").first()[0] < 5000
    by_tokens = model.predict_scores_by_tokens(df.where("i < 3000").repartition(1), make, "t", 64, "n")
    assert by_tokens.selectExpr("count(n)").first()[0] == 3000


def test_calls_take_numbers_and_nulls_as_before(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (None, None, None), (3, 1.0, "b")], "k long, x double, t string").coalesce(1)

    def numbers():
        return lambda k, x: np.where(np.isnan(k), -1.0, k + x)

    assert [r.n for r in model.predict_scores(df, numbers, ["k", "x"], 2, "n").collect()] == [3.5, -1.0, 4.0]

    def texts():
        return lambda t: np.array([0.0 if s is None else float(len(s)) for s in t])

    assert [r.n for r in model.predict_scores(df, texts, ["t"], 2, "n").collect()] == [1.0, 0.0, 1.0]
    assert model.predict_scores(df.where("false"), texts, ["t"], 2, "n").count() == 0
