"""Mixing, positions and running sums of all groups in one plan; streams and rounds that go on after a stop."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prefloom.operators import evaluate, model, sampling
from prefloom.plans import active, catalog
from prefloom.session import scratch_path
from prefloom.streaming import incremental
from tests.conftest import rows


def hot_table(spark, n=3000):
    """Two thirds of the rows in one group, the rest in 30."""
    g = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 91 % 30).cast("string")))
    return spark.range(n).select(F.col("id").alias("k"), g.alias("g"))


@pytest.mark.parametrize("rank_rows", [50, 1 << 16])
def test_all_groups_are_sampled_at_once(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(sampling, "RANK_ROWS", rank_rows)
    df = hot_table(spark).repartition(7)
    sizes = dict(rows(df.groupBy("g").count()))
    quotas = {g: [0, 1, n // 2, n][i % 4] for i, (g, n) in enumerate(sorted(sizes.items()))} | {"hot": 1234, "none": 5}
    got = defaultdict(list)
    for g, k, r in rows(sampling.stratified_sample(df, "g", quotas, 9, ["k"], strict=False), "g", "k", "sample_rank"):
        got[g].append((r, k))
    order = defaultdict(list)
    for _, k, g in sorted(rows(df.select(sampling.seeded_key(9, ["k"]).alias("u"), "k", "g"))):
        order[g].append(k)
    for g, n in quotas.items():
        assert sorted(got[g]) == [(i + 1, k) for i, k in enumerate(order[g][:n])]


def test_quotas_are_checked(spark):
    df = hot_table(spark, 300)
    with pytest.raises(ValueError, match="none"):
        sampling.stratified_sample(df, "g", {"hot": 3, "none": 1}, 1, ["k"])
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, "g", {"hot": -1}, 1, ["k"])
    with pytest.raises(Exception, match="does not identify"):
        sampling.stratified_sample(df.withColumn("k", F.col("k") % 5), "g", {"hot": 150}, 1, ["k"]).collect()
    assert sampling.stratified_sample(df.where("false"), "g", {"hot": 0}, 1, ["k"]).count() == 0


def test_jobs_do_not_grow_with_the_sources(spark):
    df, sc = hot_table(spark).persist(), spark.sparkContext
    df.count()

    def jobs(name, groups):
        sc.setJobGroup(name, name)
        sampling.stratified_sample(df, "g", dict.fromkeys(groups, 3), 5, ["k"], strict=False).collect()
        sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(name))

    jobs("warm", ["hot"])
    assert jobs("one", ["hot"]) == jobs("many", ["hot"] + [f"g{i}" for i in range(30)])


def test_sources_of_one_name_stay_apart(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(1000, 1100).withColumnRenamed("id", "k")
    out = rows(sampling.mix_sources([("x", a, 3.0), ("x", b, 1.0)], 40, 42, ["k"]), "source_name", "k", "sample_rank")
    assert {n for n, _, _ in out} == {"x"} and sum(k < 1000 for _, k, _ in out) == 30 and len(out) == 40
    assert sampling.mix_sources([("x", a, 3.0), ("y", b, 1.0)], None, 42, ["k"]).count() == 200


def test_positions_and_sums_per_group(spark):
    df = hot_table(spark).withColumn("g", F.when(F.col("g") != "g1", F.col("g"))).withColumn("v", F.col("k") % 7).repartition(5)
    order = sampling.seeded_key(3, ["k"])
    df = df.withColumn("o", order)
    pos = {k: p for k, p in rows(sampling.global_position(df, ["o", "k"], group_cols=["g"]), "k", "position")}
    cum = {k: c for k, c in rows(sampling.running_sums(df, ["o", "k"], ["v"], group_cols=["g"]), "k", "v_cum")}
    groups = defaultdict(list)
    for g, o, k, v in rows(df, "g", "o", "k", "v"):
        groups[g].append((o, k, v))
    assert None in groups and len(pos) == len(cum) == 3000
    for members in groups.values():
        total = 0
        for i, (_, k, v) in enumerate(sorted(members)):
            total += v
            assert (pos[k], cum[k]) == (i, total)


@pytest.mark.parametrize("every", [1, 3])
def test_running_accuracy_of_all_groups(spark, every):
    df = hot_table(spark, 700).withColumn("r_accepted", F.col("k") % 5).withColumn("r_rejected", F.lit(2))
    got = sorted(rows(evaluate.running_accuracy(df, ["k"], 8, every=every, group_cols=["g"]), "g", "batch_id", "seen", "correct"))
    want, groups = [], defaultdict(list)
    for g, k in sorted(rows(df, "g", "k")):
        groups[g].append(k % 5 > 2)
    for g, wins in groups.items():
        last = (len(wins) - 1) // 8
        want += [(g, b, min(len(wins), 8 * b + 8), sum(wins[:8 * b + 8])) for b in range(last + 1) if b % every == 0 or b == last]
    assert got == sorted(want)


def test_stream_goes_on_after_a_failure(spark, monkeypatch, tmp_path):
    """The second micro-batch fails after its output is written; files come later; the result is that of one run."""
    df = sampling.batch_ids(hot_table(spark, 900).withColumn("r_accepted", F.col("k") % 5).withColumn("r_rejected", F.lit(2)),
                            ["k"], 8, ["g"]).select("g", "batch_id", "r_accepted", "r_rejected")
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    df.where("batch_id % 3 < 2").repartition(4).write.parquet(src)
    read, calls = incremental.problem_stream, []

    class Stop(Exception):
        pass

    from pyspark.sql.streaming import DataStreamWriter
    plain = DataStreamWriter.foreachBatch

    def failing(self, fn):
        def once(batch, n):
            fn(batch, n)
            calls.append(n)
            if len(calls) == 2:
                raise Stop("killed")
        return plain(self, once)

    monkeypatch.setattr(DataStreamWriter, "foreachBatch", failing)
    with pytest.raises(Exception, match="killed"):
        incremental.streaming_accuracy(spark, src, df.schema, out, ckpt, ["g"])
    monkeypatch.undo()
    assert incremental.problem_stream is read
    df.where("batch_id % 3 = 2").repartition(3).write.mode("append").parquet(src)
    incremental.streaming_accuracy(spark, src, df.schema, out, ckpt, ["g"], max_files_per_trigger=2)
    got = evaluate.accuracy_from_counts(incremental.latest_counts(spark, out, ["g"]), group_cols=["g"])
    win = df.groupBy("g", "batch_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.expr("r_accepted > r_rejected")).alias("n_correct"))
    want = evaluate.accuracy_from_counts(win, group_cols=["g"])
    cols = ("g", "batch_id", "seen", "correct", "accuracy")
    assert sorted(rows(got, *cols)) == sorted(rows(want, *cols))


def test_rounds_go_on_after_a_kill(spark, monkeypatch):
    emb = F.array(*[(F.col("id") * 37 % (11 + i) / 11).cast("double") for i in range(4)])
    pairs = spark.range(240).select(F.col("id").alias("problem_id"), F.lit(1).alias("pair_rank"), emb.alias("emb_accepted"),
                                    F.reverse(emb).alias("emb_rejected"))
    pool, held = active.split_by_problem(pairs, 0.25, 5)

    def run(root, rounds=4, k=12):
        return rows(active.active_rounds(spark, pool, held, ["problem_id", "pair_rank"], [0.1] * 4, rounds=rounds, k=k,
                                         max_to_look_at=150, seed=3, accumulate=True, out_root=root))

    whole = run(scratch_path(spark, "whole"))
    root, train, calls = scratch_path(spark, "killed"), model.train_pairwise, []

    def killed(data):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return train(data)

    monkeypatch.setattr(model, "train_pairwise", killed)
    with pytest.raises(KeyboardInterrupt):
        run(root)
    assert [r["round"] for r in active.finished_rounds(spark, root)] == [0, 1, 2]
    again = run(root)
    assert len(calls) == 5 and len(whole) == 4  # two whole rounds, the one cut short, and two after the restart
    assert [r[:3] + r[4:] for r in again] == [r[:3] + r[4:] for r in whole]
    assert all(math.isclose(a[3], b[3]) for a, b in zip(again, whole))
    assert run(root, rounds=2) == again[:2] and len(calls) == 5
    with pytest.raises(ValueError, match="other parameters"):
        run(root, k=13)


def test_mixing_takes_every_source(spark):
    got = rows(catalog.q_mix_sources_by_ratio(spark, "/root/testdata/sf0.001"), "source_name", "sample_rank")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("source IS NOT NULL")
    assert {s for s, _ in got} == {s for s, in rows(docs, "source")}
