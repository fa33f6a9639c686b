"""Prompts, messages, code runs with a stub runner, streaming = batch."""

from pyspark.sql import functions as F

from prefloom.operators import code_exec, prompts
from prefloom.plans import catalog
from tests.conftest import SF_SMALL, rows


def test_render_matches_python_format(spark):
    df = spark.createDataFrame([("Find {x} in {{y}}",)], "problem string")
    got = rows(df.select(prompts.render_prompt("problem", prompts.MATH_TEMPLATE)))[0][0]
    assert got == prompts.MATH_TEMPLATE.format(problem="Find {x} in {{y}}")


def test_starter_code_null_is_empty(spark):
    df = spark.createDataFrame([("p", None), ("p", ""), ("p", "def f():")], "question string, starter_code string")
    got = [r[0] for r in rows(df.select(prompts.with_starter_code(
        prompts.render_prompt("question", prompts.CODE_TEMPLATE), "starter_code")))]
    base = prompts.CODE_TEMPLATE.format(problem="p")
    assert got == [base, base, base + prompts.STARTER_NOTE + "def f():"]


def test_chat_text(spark):
    df = spark.createDataFrame([("q", "a")], "p string, c string")
    msgs = F.array(prompts.message("user", "p"), prompts.message("assistant", "c"))
    got = rows(df.select(prompts.chat_text(msgs, "[{role}] ", "|")))[0][0]
    assert got == "[user] q|[assistant] a|"


def test_testcases_cut_at_shorter(spark):
    df = spark.createDataFrame([(1, '{"inputs": ["1", "2", "3"], "outputs": ["a", "b"]}'),
                                (2, '{"fn_name": "f", "inputs": [[1, 2]], "outputs": [3]}'),
                                (3, "not json"), (4, '{"fn_name": "", "inputs": ["z"], "outputs": ["z"]}')],
                               "problem_id long, input_output string")
    got = sorted(rows(code_exec.explode_testcases(df), "problem_id", "case_idx", "fn_name", "input", "expected"))
    assert got == [(1, 0, None, "1", "a"), (1, 1, None, "2", "b"), (2, 0, "f", "[1,2]", "3"), (4, 0, None, "z", "z")]


def test_run_responses_with_stub_runner(spark):
    def runner(code, fn_name, inp):
        if "boom" in code:
            return "", False, "Traceback (most recent call last):\nValueError: boom"
        return inp.upper() + "\n", True, ""

    resp = spark.createDataFrame([(1, 0, "```python\nprint(input().upper())\n```"), (1, 1, "boom"),
                                  (1, 2, "import subprocess")], "problem_id long, response_idx int, response string")
    io = spark.createDataFrame([(1, '{"inputs": ["a b", "c", "unpaired"], "outputs": ["A  B", "X"]}'), (2, "not json")],
                               "problem_id long, input_output string")
    res = code_exec.run_responses(resp, io, runner)
    counts = {r[0]: r[1] for r in rows(code_exec.pass_counts(res), "response_idx", "score")}
    assert counts == {0: 1, 1: 0, 2: 0}
    scored = {r[0]: r[1] for r in rows(code_exec.code_scores(resp, code_exec.pass_counts(res)), "response_idx", "score")}
    assert scored == {0: 1, 1: 0, 2: 0}
    reasons = rows(code_exec.failure_reasons(res), "reason", "n_failed")
    assert ("ValueError: boom", 2) in reasons and ("subprocess is not allowed", 2) in reasons


def test_reduce_error(spark):
    err = ('Traceback (most recent call last):\n  File "/tmp/x/tmp.py", line 3, in <module>\n'
           '    main()\nsomething else\nValueError: bad')
    df = spark.createDataFrame([(err,)], "e string")
    got = rows(df.select(code_exec.reduce_error("e", "/tmp/x/tmp.py")))[0][0]
    assert got == 'Traceback (most recent call last):\n  File "\n    main()\nValueError: bad'


def test_streaming_equals_batch(spark):
    batch = sorted(rows(catalog.q_preference_pairs_math(spark, SF_SMALL), "problem_id", "pair_rank", "accepted", "rejected"))
    stream = sorted(rows(catalog.q_stream_preference_pairs(spark, SF_SMALL), "problem_id", "pair_rank", "accepted", "rejected"))
    assert batch == stream and len(batch) > 0


def test_streaming_restart_adds_nothing(spark, tmp_path):
    from prefloom.streaming import incremental
    from prefloom.sources import testdata

    probs = testdata.problems(spark, SF_SMALL, 8).select("problem_id", "problem")
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    probs.repartition(3).write.parquet(src)
    comp = testdata.responses(spark, SF_SMALL, 8).select("problem_id", "response_idx", "response")
    incremental.incremental_sft(spark, src, probs.schema, comp, out, ck)
    n1 = spark.read.parquet(out).count()
    incremental.incremental_sft(spark, src, probs.schema, comp, out, ck)
    assert spark.read.parquet(out).count() == n1 == 200


def test_generate_preference_job(spark, tmp_path):
    from prefloom.operators import model
    from prefloom.plans import jobs
    from prefloom.sources import testdata

    probs = testdata.problems(spark, SF_SMALL, 8).select(
        "problem_id", "problem", F.lit("\\boxed{3}").alias("solution"))
    out = jobs.generate_preference_data(spark, probs, "math", model.make_echo_generator, 8, 4, str(tmp_path / "p"))
    assert set(out.columns) >= {"problem", "accepted", "rejected"}
    n = out.count()
    assert 0 < n <= 4 * probs.count()
    sft = jobs.generate_sft_data(spark, probs, "math", model.make_echo_generator, 2, str(tmp_path / "s"))
    assert sft.count() == 2 * probs.count()


def test_eval_select_and_training_jobs(spark, tmp_path):
    from prefloom.operators import model
    from prefloom.plans import catalog, jobs
    from prefloom.sources.tables import read_split, write_splits

    pairs = catalog._pairs8_text(spark, SF_SMALL)
    acc, running = jobs.evaluate_reward_model(spark, pairs, model.make_length_reward, batch_size=4,
                                              max_tokens=4096, running_every=5, out=str(tmp_path / "rw"))
    a = acc.first()
    assert a.n_pairs == pairs.count() and 0.0 <= a.accuracy <= 1.0
    last = running.orderBy(F.desc("batch_id")).first()
    assert last.seen == a.n_pairs and last.correct == a.n_correct

    ds = str(tmp_path / "ds")
    write_splits({"train": pairs}, ds)

    def score(df):
        return df.withColumn("r_accepted", F.length("accepted").cast("double")) \
                 .withColumn("r_rejected", F.length("rejected").cast("double"))

    out = jobs.select_active_data(spark, ds, True, score, 10, 60, str(tmp_path / "sel"))
    tr, rest = read_split(spark, out, "train"), read_split(spark, out, "rest")
    assert tr.count() == 10 and rest.count() == 50
    assert tr.join(rest, ["problem_id", "pair_rank"]).count() == 0

    td = jobs.reward_training_data(pairs, [20, 40], seed=1)
    assert td.where("subset_size <= 20").count() == 20 and "chosen" in td.columns


def test_replayed_batch_is_replaced_not_duplicated(spark, tmp_path):
    import os

    from prefloom.sources import testdata
    from prefloom.streaming import incremental

    mc = testdata.math_candidates(spark, SF_SMALL)
    probs = testdata.problems(spark, SF_SMALL, 8).select("problem_id", "problem",
                                                         testdata.math_answer().alias("answer"))
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    probs.repartition(3).write.parquet(src)
    resp = mc.select("problem_id", "response_idx", "response")
    incremental.incremental_preferences(spark, src, probs.schema, resp, out, ck)
    first = sorted(rows(spark.read.parquet(out), "batch_id", "problem_id", "pair_rank"))
    commits = sorted(os.listdir(os.path.join(ck, "commits")), key=lambda x: int(x) if x.isdigit() else -1)
    last = [c for c in commits if c.isdigit()][-1]
    os.remove(os.path.join(ck, "commits", last))  # crash after the write, before the commit
    crc = os.path.join(ck, "commits", f".{last}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    incremental.incremental_preferences(spark, src, probs.schema, resp, out, ck)
    again = sorted(rows(spark.read.parquet(out), "batch_id", "problem_id", "pair_rank"))
    assert os.path.exists(os.path.join(ck, "commits", last))  # the batch ran again
    assert again == first and len(first) > 0


def test_stream_generates_inside_batches(spark, tmp_path):
    from prefloom.operators import model
    from prefloom.sources import testdata
    from prefloom.streaming import incremental

    probs = testdata.problems(spark, SF_SMALL, 8).select(
        "problem_id", "problem", F.lit("\\boxed{3}").alias("answer"),
        prompts.render_prompt("problem", prompts.MATH_TEMPLATE).alias("prompt"))
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    probs.repartitionByRange(3, "problem_id").write.parquet(src)
    incremental.incremental_preferences(spark, src, probs.schema, None, out, ck, "math", 4,
                                        make_generate_fn=model.make_echo_generator, num_samples=8)
    got = spark.read.parquet(out)
    per = got.groupBy("problem_id").count().where("count > 4").count()
    assert got.count() > 0 and per == 0
    assert got.select("batch_id").distinct().count() == 3


def py_reduce(err, path):
    msgs = err.split("\n")
    out, want = [], False
    for m in msgs:
        if "Traceback" in m or m == msgs[-1]:
            out.append(m)
        elif path in m:
            st = m.index('"/') + 1 if '"/' in m else 0
            out.append(m[:st])
            want = True
        elif want:
            out.append(m)
            want = False
    return "\n".join(out).strip()


def test_error_digest_against_python(spark):
    from prefloom.sources import testdata

    got = catalog.QUERIES["error_digest"](spark, SF_SMALL)
    res = testdata.code_results(spark, SF_SMALL).where(~F.col("ok"))
    exp = sorted((r.problem_id, r.response_idx, r.case_idx, py_reduce(r.error, "/tmp/run/tmp.py"))
                 for r in res.collect())
    assert sorted(rows(got)) == exp and len(exp) > 0


def test_generate_code_preference_job(spark, tmp_path):
    import numpy as np

    from prefloom.plans import jobs

    def make_gen():
        def fn(prompts, idx):
            good = "```python\nprint(input())\n```"
            return np.array([good if int(i) % 2 == 0 else "print('nope')" for i in idx], dtype=object)
        return fn

    probs = spark.createDataFrame(
        [(1, "Echo the line.", '{"inputs": ["a b", "c"], "outputs": ["a b", "c"]}', ""),
         (2, "Echo again.", '{"inputs": ["x"], "outputs": ["x"]}', None)],
        "problem_id long, question string, input_output string, starter_code string")
    out = jobs.generate_preference_data(spark, probs, "code", make_gen, 4, 16, str(tmp_path / "c"),
                                        code_runner=lambda code, fn, inp: (inp + "\n" if "print(input())" in code else "nope", True, ""))
    got = rows(out, "problem_id", "accepted", "rejected")
    # 2 passing and 2 failing samples per problem: 4 unequal pairs each
    assert len(got) == 8
    assert all("print(input())" in a and "nope" in r for _, a, r in got)


def test_split_template_follows_format():
    import pytest

    for t in ["A {{problem}} B {problem} C", "{problem}", "x {{}} {problem} {{y}}", "a}}{problem}{{b"]:
        pre, post = prompts.split_template(t)
        assert pre + "P" + post == t.format(problem="P")
    for bad in ["no field", "{problem} {problem}", "{x} {problem}", "{problem} }"]:
        with pytest.raises(ValueError):
            prompts.split_template(bad)


def test_code_job_runs_each_case_once(spark, tmp_path):
    import numpy as np

    from prefloom.plans import jobs

    log = str(tmp_path / "runs.log")

    def runner(code, fn_name, inp):
        with open(log, "a") as f:
            f.write("x\n")
        return (inp if "echo" in code else "?"), True, ""

    def make_gen():
        return lambda prompts, idx: np.array(["echo" if int(i) % 2 == 0 else "no" for i in idx], dtype=object)

    probs = spark.createDataFrame(
        [(1, "q1", '{"inputs": ["a", "b"], "outputs": ["a", "b"]}', ""),
         (2, "q2", '{"inputs": ["c"], "outputs": ["c"]}', "")],
        "problem_id long, question string, input_output string, starter_code string")
    out = jobs.generate_preference_data(spark, probs, "code", make_gen, 4, 16, str(tmp_path / "o"),
                                        code_runner=runner)
    assert out.count() == 8
    with open(log) as f:
        assert len(f.readlines()) == 4 * (2 + 1)
