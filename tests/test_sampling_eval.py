"""Sampling, evaluation and selection: golden rows and properties."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from prefloom.operators import evaluate, sampling, select
from prefloom.plans import catalog
from tests.conftest import rows


def test_shares_truncate():
    assert sampling.source_shares(10, [1, 1, 1]) == [3, 3, 3]
    assert sampling.source_shares(70, [1.0, 0.5, 0.25]) == [40, 20, 10]


def test_take_sample_strict_and_clamped(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        sampling.take_sample(df, 11, 42, ["k"], strict=True)
    assert sampling.take_sample(df, 11, 42, ["k"], strict=False).count() == 10


def test_sample_stable_under_repartition(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = sorted(rows(sampling.take_sample(df, 50, 7, ["k"], strict=True, rank_name="r"), "k", "r"))
    b = sorted(rows(sampling.take_sample(df.repartition(13), 50, 7, ["k"], strict=True, rank_name="r"), "k", "r"))
    assert a == b and len(a) == 50


def test_nested_subsets_are_prefixes(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    s = sampling.nested_subsets(df, [10, 50, 100], 3, ["k"])
    small = {r[0] for r in rows(s.where("subset_size <= 10"), "k")}
    mid = {r[0] for r in rows(s.where("subset_size <= 50"), "k")}
    assert len(small) == 10 and len(mid) == 50 and small < mid
    direct = {r[0] for r in rows(sampling.take_sample(df, 50, 3, ["k"]), "k")}
    assert direct == mid


def test_global_position_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("one"))
    pos = rows(sampling.global_position(df, ["k"]), "k", "position")
    assert all(k == p for k, p in pos)
    rs = rows(sampling.running_sums(df, ["k"], ["one"]), "k", "one_cum")
    assert all(k + 1 == c for k, c in rs)


def test_accuracy_golden(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (0.0, 3.0), (5.0, 4.0)], "r_accepted double, r_rejected double")
    r = evaluate.pairwise_accuracy(df).first()
    assert (r.n_pairs, r.n_correct, r.n_ties, r.accuracy) == (4, 2, 1, 0.5)
    swapped = evaluate.pairwise_accuracy(df, chosen="r_rejected", rejected="r_accepted").first()
    assert swapped.accuracy == pytest.approx(1 - 0.5 - 0.25)


def test_accuracy_empty_is_null(spark):
    df = spark.createDataFrame([], "r_accepted double, r_rejected double")
    r = evaluate.pairwise_accuracy(df).first()
    assert r.n_pairs == 0 and r.accuracy is None


def test_running_accuracy(spark):
    data = [(i, 1.0 if i % 3 else 0.0, 0.5) for i in range(20)]
    df = spark.createDataFrame(data, "k long, r_accepted double, r_rejected double")
    got = rows(evaluate.running_accuracy(df, ["k"], 8), "batch_id", "seen", "correct")
    assert got == [(0, 8, 5), (1, 16, 10), (2, 20, 13)]


def test_selection_all_rows_and_error(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "k long, r_accepted double, r_rejected double")
    sel, rest = select.active_selection(df, 6, 100, 1, ["k"])
    assert sel.count() == 6 and rest.count() == 0
    with pytest.raises(ValueError):
        select.active_selection(df, 7, 100, 1, ["k"])


def test_selection_partition_of_window(spark):
    df = spark.createDataFrame([(i, float(i % 5), 0.0) for i in range(200)], "k long, r_accepted double, r_rejected double")
    sel, rest = select.active_selection(df, 30, 120, 9, ["k"])
    s, r = {x[0] for x in rows(sel, "k")}, {x[0] for x in rows(rest, "k")}
    assert len(s) == 30 and len(r) == 90 and not (s & r)
    _, rest_all = select.active_selection(df, 30, 120, 9, ["k"], keep_unseen=True)
    assert rest_all.count() == 170
    ranks = sorted(x[0] for x in rows(sel, "select_rank"))
    assert ranks == list(range(1, 31))


def _exact_inclusion(weights, k):
    """Inclusion probabilities of successive weighted draws without replacement."""
    n = len(weights)
    probs = [0.0] * n
    for order in itertools.permutations(range(n), k):
        p, left = 1.0, sum(weights)
        for i in order:
            p *= weights[i] / left
            left -= weights[i]
        for i in order:
            probs[i] += p
    return probs


def test_gumbel_topk_distribution(spark):
    gaps = [0.0, 0.5, 1.0, 2.0, 3.0]
    runs = 4000
    data = [(s, i, g) for s in range(runs) for i, g in enumerate(gaps)]
    df = spark.createDataFrame(data, "run long, k long, gap double")
    key = F.col("gap") * -1.0 - F.ln(-F.ln(__import__("prefloom.functions.hashing", fromlist=["x"]).uniform(5, "run", "k")))
    from pyspark.sql import Window
    w = Window.partitionBy("run").orderBy(F.desc("_key"))
    top = df.withColumn("_key", key).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    freq = {k: c / runs for k, c in rows(top.groupBy("k").count(), "k", "count")}
    exact = _exact_inclusion([math.exp(-g) for g in gaps], 2)
    for i, p in enumerate(exact):
        assert abs(freq.get(i, 0.0) - p) < 0.03


def test_truncate_tokens_and_matrix(spark):
    df = spark.createDataFrame([("  a b\t c\nd  ",)], "t string")
    assert rows(df.select(evaluate.truncate_tokens("t", 2)))[0][0] == "a b"
    assert rows(df.select(evaluate.truncate_tokens("t", 10)))[0][0] == "a b c d"
    sp = spark.createDataFrame([("m1", "x", 2.0, 1.0), ("m1", "y", 0.0, 1.0), ("m2", "x", 1.0, 1.0)],
                               "model string, domain string, r_accepted double, r_rejected double")
    got = sorted(rows(evaluate.accuracy_matrix(sp), "model", "x", "y"))
    assert got == [("m1", 1.0, 0.0), ("m2", 0.0, None)]


def test_top_keys_distributed_path_equals_single_task(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    for desc in (False, True):
        a = sorted(rows(sampling.top_keys(df, 250, [F.col("v")], ["k"], "r", descending=desc), "k", "r"))
        b = sorted(rows(sampling.top_keys(df, 250, [F.col("v")], ["k"], "r", descending=desc,
                                          single_task_max=10), "k", "r"))
        assert a == b and len(a) == 250


def test_top_keys_order_of_nulls_is_the_same_for_every_size(spark):
    df = spark.createDataFrame([(1, 0.1), (2, None), (3, 5.0), (4, float("nan"))], "k long, v double")
    for desc, ids in ((True, [4, 3]), (False, [1, 3])):
        for most in (1, 100):
            got = sampling.top_keys(df, 2, [F.col("v")], ["k"], "r", descending=desc, single_task_max=most)
            assert [k for _, k in sorted(rows(got, "r", "k"))] == ids


def test_repeated_sample_keys_are_refused(spark):
    import pytest

    df = spark.range(50).select((F.col("id") % 10).alias("k"))
    with pytest.raises(ValueError):
        sampling.take_sample(df, 20, 1, ["k"])


def test_only_the_window_is_scored(spark):
    from prefloom.operators import select

    seen = spark.sparkContext.accumulator(0)

    def score(df):
        def count(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(r_accepted=1.0, r_rejected=0.5)
        return df.mapInPandas(count, "k long, r_accepted double, r_rejected double")

    sel, rest = select.active_selection(spark.range(500).withColumnRenamed("id", "k"), 5, 40, 1, ["k"], score=score)
    assert sel.count() == 5 and rest.count() == 35 and seen.value == 40


def test_length_filter_text_and_narrow_agree(spark):
    from prefloom.plans import catalog
    from prefloom.sources import testdata
    from tests.conftest import SF_MID

    wide = catalog._pairs8_text(spark, SF_MID)
    a = sorted(rows(evaluate.length_filter(wide, 1024), "problem_id", "pair_rank"))
    narrow = evaluate.length_filter_narrow(catalog._pairs8(spark, SF_MID), testdata.responses(spark, SF_MID, 8),
                                           testdata.problems(spark, SF_MID, 8), 1024)
    b = sorted(rows(narrow, "problem_id", "pair_rank"))
    assert a == b and 0 < len(a) < wide.count()


def test_stream_running_accuracy_has_every_model(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.model: (r.n_pairs, r.n_correct) for r in evaluate.pairwise_accuracy(catalog.scored_pairs(spark, sf), ["model"]).collect()}
    last = {}
    for r in sorted(catalog.q_stream_running_accuracy(spark, sf).collect(), key=lambda r: r.batch_id):
        last[r.model] = (r.seen, r.correct)
    assert set(last) == set(catalog.REWARD_MODELS) and last == want
