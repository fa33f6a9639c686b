"""Pairing operator against a brute-force enumeration of all pairs."""

import random
import re

import pytest

from prefloom.operators import pairs
from prefloom.sources import testdata
from tests.conftest import SF_MID, rows


def brute(groups, k):
    out = []
    for g, scores in groups.items():
        got = []
        n = len(scores)
        for i in range(n):
            for j in range(i + 1, n):
                if scores[i] == scores[j]:
                    continue
                acc, rej = (i, j) if scores[i] > scores[j] else (j, i)
                got.append((g, i, j, acc, rej))
        out += [(g, r + 1, *t[1:]) for r, t in enumerate(got[:k])]
    return sorted(out)


def run(spark, groups, k):
    data = [(g, i, s) for g, sc in groups.items() for i, s in enumerate(sc)]
    df = spark.createDataFrame(data, "problem_id long, response_idx int, score int")
    p = pairs.preference_pairs(df, k)
    return sorted(rows(p, "problem_id", "pair_rank", "i", "j", "accepted_idx", "rejected_idx"))


def test_golden_rows(spark):
    assert run(spark, {0: [1, 0, 1]}, 10) == [(0, 1, 0, 1, 0, 1), (0, 2, 1, 2, 2, 1)]
    assert run(spark, {0: [3, 1, 2]}, 2) == [(0, 1, 0, 1, 0, 1), (0, 2, 0, 2, 0, 2)]


def test_random_groups_match_brute_force(spark):
    rnd = random.Random(7)
    groups = {}
    for g in range(60):
        n = rnd.choice([1, 2, 3, 5, 8, 13])
        levels = rnd.choice([1, 2, 3, 5])
        groups[g] = [rnd.randrange(levels) for _ in range(n)]
    # long runs of equal scores at the start and at the end
    groups[100] = [1] * 30 + [0] + [1] * 5
    groups[101] = [0, 1] + [2] * 40
    for k in (1, 4, 16):
        assert run(spark, groups, k) == brute(groups, k)


def test_hot_group(spark):
    # one group with most of the rows, scores in long runs
    hot = [(i // 700) % 3 for i in range(3000)]
    groups = {0: hot, 1: [0, 1, 0, 1], 2: [5] * 10}
    assert run(spark, groups, 4) == brute(groups, 4)


def test_bad_caps(spark):
    df = spark.createDataFrame([(0, 0, 1)], "problem_id long, response_idx int, score int")
    for bad in (None, 0, -1):
        with pytest.raises(ValueError):
            pairs.preference_pairs(df, bad)


def test_pair_counts(spark):
    groups = {0: [1, 0, 1], 1: [2, 2, 2, 1], 2: [7]}
    data = [(g, i, s) for g, sc in groups.items() for i, s in enumerate(sc)]
    df = spark.createDataFrame(data, "problem_id long, response_idx int, score int")
    got = sorted(rows(pairs.pair_counts(df, 2), "problem_id", "n_responses", "n_pairs_all", "n_pairs_kept"))
    assert got == [(0, 3, 2, 2), (1, 4, 3, 2), (2, 1, 0, 0)]


def test_candidates8_counts(spark):
    c = testdata.candidates(spark, SF_MID, 8)
    p = pairs.preference_pairs(c, 4)
    assert p.count() == 480
    assert p.select("problem_id").distinct().count() == 120
    assert pairs.pair_counts(c).agg({"n_pairs_all": "sum"}).collect()[0][0] == 1585


def test_plan_has_group_limit_and_no_cartesian(spark):
    c = testdata.candidates(spark, SF_MID, 8)
    plan = pairs.preference_pairs(c, 4)._jdf.queryExecution().executedPlan().toString()
    # both limits (per score, per group) run map-side first; pairs need no join of candidates
    assert plan.count("WindowGroupLimit") >= 4 and plan.count("Partial") >= 2
    assert plan.count("Join") == 1  # the label join of the input
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_cross_two_exchanges(spark):
    """One exchange of response texts, one of the chosen ones."""
    from prefloom.plans import preference

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = preference.score_responses(testdata.math_candidates(spark, SF_MID), "math")
        df = pairs.attach_texts(pairs.preference_pairs(scored, 4), scored)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    project = re.findall(r"Exchange hashpartitioning\([^)]*\)[^\n]*\n[^\n]*Project \[([^\n]*)", plan)
    assert sum("response#" in p for p in project) == 1


def test_pairs_unchanged_by_repartition(spark):
    c = testdata.candidates(spark, SF_MID, 8)
    cols = ("problem_id", "pair_rank", "accepted_idx", "rejected_idx")
    a = sorted(rows(pairs.preference_pairs(c, 4), *cols))
    b = sorted(rows(pairs.preference_pairs(c.repartition(17, "response_idx"), 4), *cols))
    assert a == b


def test_null_scores_take_no_part(spark):
    data = [(0, 0, 1), (0, 1, None), (0, 2, 0), (0, 3, None), (0, 4, 1)]
    df = spark.createDataFrame(data, "problem_id long, response_idx int, score int")
    got = sorted(rows(pairs.preference_pairs(df, 10), "pair_rank", "i", "j"))
    assert got == [(1, 0, 2), (2, 2, 4)]


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=25),
       st.integers(1, 20))
def test_pairs_property(spark, groups_list, k):
    groups = dict(enumerate(groups_list))
    assert run(spark, groups, k) == brute(groups, k)


def test_composite_group_key(spark):
    rnd = random.Random(3)
    groups = {(a, b): [rnd.randrange(3) for _ in range(rnd.randrange(1, 9))] for a in range(4) for b in ("x", "y")}
    data = [(a, b, i, s) for (a, b), sc in groups.items() for i, s in enumerate(sc)]
    df = spark.createDataFrame(data, "a long, b string, response_idx int, score int")
    p = pairs.preference_pairs(df, 3, group_cols=("a", "b"))
    got = sorted(rows(p, "a", "b", "pair_rank", "i", "j", "accepted_idx", "rejected_idx"))
    exp = sorted((g[0], g[1], *t[1:]) for g, sc in groups.items() for t in brute({g: sc}, 3))
    assert got == exp


def test_candidates16_totals_match_fixture_counts(spark):
    c = testdata.candidates16(spark, SF_MID)
    t = pairs.pair_counts(c, 16).agg({"n_pairs_all": "sum", "n_pairs_kept": "sum"}).first()
    assert (int(t["sum(n_pairs_all)"]), int(t["sum(n_pairs_kept)"])) == (5990, 1008)
    assert pairs.preference_pairs(c, 16).count() == 1008


def test_sparse_orders_and_continuous_scores(spark):
    rnd = random.Random(11)
    data, exp = [], []
    for g in range(40):
        orders = sorted(rnd.sample(range(10 ** 9), rnd.randrange(1, 30)))
        scores = [rnd.choice([rnd.random(), 0.5, 0.25]) for _ in orders]
        data += [(g, o, s) for o, s in zip(orders, scores)]
        exp += [(g, r, orders[i], orders[j]) for _, r, i, j, _, _ in brute({g: scores}, 5)]
    df = spark.createDataFrame(data, "problem_id long, response_idx long, score double")
    assert sorted(rows(pairs.preference_pairs(df, 5), "problem_id", "pair_rank", "i", "j")) == sorted(exp)
