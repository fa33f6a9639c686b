"""Pairing at a larger scale with one hot group (skew)."""

from pyspark.sql import functions as F

from prefloom.operators import pairs
from tests.conftest import rows


def first_k_pairs(scores, k):
    out = []
    n = len(scores)
    for i in range(n):
        for j in range(i + 1, n):
            if scores[i] != scores[j]:
                out.append((i, j))
                if len(out) == k:
                    return out
    return out


def test_hot_group_and_many_small_groups(spark):
    k = 4
    hot_n = 50_000
    small = spark.range(800_000).select((F.col("id") / 8).cast("long").alias("problem_id"),
                                        (F.col("id") % 8).cast("int").alias("response_idx"),
                                        (F.hash("id") % 3).cast("int").alias("score"))
    # hot group: 20,000 equal scores first, then alternating blocks
    hot = spark.range(hot_n).select(F.lit(-1).cast("long").alias("problem_id"),
                                    F.col("id").cast("int").alias("response_idx"),
                                    F.when(F.col("id") < 20_000, 1).otherwise((F.col("id") / 7).cast("int") % 2)
                                    .cast("int").alias("score"))
    df = small.unionByName(hot)
    got = pairs.preference_pairs(df, k)
    counts = pairs.pair_counts(df, k)
    per_group = got.groupBy("problem_id").agg(F.count(F.lit(1)).alias("c"), F.max("pair_rank").alias("mx"),
                                              F.min("pair_rank").alias("mn"))
    check = counts.join(per_group, "problem_id", "left").where(
        (F.coalesce("c", F.lit(0)) != F.col("n_pairs_kept")) |
        (F.col("c").isNotNull() & ((F.col("mx") != F.col("c")) | (F.col("mn") != 1))))
    assert check.count() == 0
    bad = got.where((F.col("accepted_score") <= F.col("rejected_score")) | (F.col("i") >= F.col("j")))
    assert bad.count() == 0
    hot_scores = [1 if i < 20_000 else (i // 7) % 2 for i in range(hot_n)]
    exp = first_k_pairs(hot_scores, k)
    hot_got = sorted((r.i, r.j) for r in got.where("problem_id = -1").collect())
    assert hot_got == exp


def test_sft_pairs_long_conversation(spark, tmp_path):
    from prefloom.sources import testdata

    roles = ["user", "assistant", "user", "system", "assistant", "user"]
    long_conv = [(0, t, roles[t % len(roles)], f"m{t}") for t in range(20_000)]
    short = [(c, t, r, f"c{c}t{t}") for c in range(1, 300) for t, r in enumerate(["user", "assistant"])]
    df = spark.createDataFrame(long_conv + short, "conv_id long, turn long, role string, text string")
    d = tmp_path / "sf"
    d.mkdir()
    df.write.parquet(str(d / "conversations.parquet"))
    got = sorted(rows(testdata.sft_source(spark, str(d)), "conv_id", "turn", "problem", "completion"))
    data = long_conv + short
    by = {(c, t): (r, x) for c, t, r, x in data}
    exp = sorted((c, t, x, by[(c, t + 1)][1]) for c, t, r, x in data
                 if r == "user" and (c, t + 1) in by and by[(c, t + 1)][0] == "assistant")
    assert got == exp


def test_runs_of_a_hot_problem_are_spread(spark):
    from prefloom.operators import code_exec

    resp = spark.range(400).select(F.lit(1).cast("long").alias("problem_id"),
                                   F.col("id").cast("int").alias("response_idx"),
                                   F.lit("print(input())").alias("response"))
    io = spark.createDataFrame([(1, '{"inputs": ["x", "x", "x", "x", "x"], "outputs": ["x", "x", "x", "x", "x"]}')],
                               "problem_id long, input_output string")

    def runner(code, fn, inp):
        return inp, True, ""

    res = code_exec.run_responses(resp, io, runner, num_partitions=8)
    per_task = res.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 2000 * 0.3
    assert res.count() == 2000
    assert res.columns == ["problem_id", "response_idx", "case_idx", "fn_name", "expected", "actual", "ok", "error"]


def test_a_micro_batch_reads_its_own_buckets(spark, tmp_path):
    """A stream's batch scans the folders of its buckets alone, and ranges of ids are even buckets."""
    from prefloom.plans import catalog
    from prefloom.streaming import incremental

    ids = [i * i * 1000 for i in range(3200)]  # far from evenly spread
    docs = spark.createDataFrame([(i * 8 + k, "t", "s", "en", 1) for i in ids for k in range(2)],
                                 "doc_id long, text string, source string, lang string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.createDataFrame([(i, "r") for i in ids] + [(None, "r")], "problem_id long, response string")
    table = table.select(catalog._bucket(spark, str(tmp_path)), "*")
    sizes = [r["count"] for r in table.groupBy("problem_bucket").count().collect()]
    assert len(sizes) == catalog.STREAM_BUCKETS and max(sizes) < 200
    table.write.partitionBy("problem_bucket").parquet(f"{tmp_path}/responses")
    batch = table.where(f"problem_id < {ids[800]}").drop("response")
    kept = incremental.in_buckets(spark.read.parquet(f"{tmp_path}/responses"), batch, "problem_bucket")
    assert 800 <= kept.count() <= 1000
    assert {f.split("problem_bucket=")[1].split("/")[0] for f in kept.inputFiles()} >= {"0"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [problem_bucket" in plan and "DataFilters: []" in plan
    assert incremental.in_buckets(kept, batch.where("false"), "problem_bucket").count() == 0


def test_sft_stream_on_buckets_equals_the_join(spark, tmp_path):
    from prefloom.streaming import incremental

    probs = spark.createDataFrame([(i // 5, i, f"p{i}") for i in range(40)], "b int, problem_id long, problem string")
    comp = spark.createDataFrame([(i // 5, i, k, f"c{i}.{k}") for i in range(45) for k in range(2)],
                                 "b int, problem_id long, response_idx int, response string")
    probs.repartitionByRange(4, "problem_id").write.parquet(f"{tmp_path}/p")
    comp.write.partitionBy("b").parquet(f"{tmp_path}/c")
    out = incremental.incremental_sft(spark, f"{tmp_path}/p", probs.schema, spark.read.parquet(f"{tmp_path}/c"),
                                      f"{tmp_path}/o", f"{tmp_path}/k", bucket_col="b")
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("problem_id", "response_idx", "problem", "completion").collect())
    assert got == sorted((i, k, f"p{i}", f"c{i}.{k}") for i in range(40) for k in range(2))
