"""Code answers: test cases, runs, pass counts and failure reasons.

Running untrusted programs is the job of a runner supplied by the caller
(``run_responses``); everything around it is DataFrame work: parse the test-case
JSON, hand each response with its case list to the runner, compare outputs,
count passes per response.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import _col, contains_any, extract_code, normalize_output, py_strip

# Libraries a program may not name (plain substring test).
FORBIDDEN_LIBS = ("subprocess", "venv")

TESTCASE_SCHEMA = "fn_name string, inputs array<string>, outputs array<string>"


def parse_testcases(c) -> Column:
    """Test-case JSON to ``struct<fn_name, inputs, outputs>``.

    JSON only (never evaluated); nested values stay as their JSON text and a
    malformed document gives null fields.
    """
    return F.from_json(_col(c), TESTCASE_SCHEMA)


def explode_testcases(problems: DataFrame, io_col: str = "input_output",
                      key_cols: Sequence[str] = ("problem_id",)) -> DataFrame:
    """One row per test case, inputs and outputs cut at the shorter list.

    Returns ``key_cols, case_idx, fn_name, input, expected``.
    """
    tc = parse_testcases(io_col)
    p = problems.select(*key_cols, tc.alias("_tc"))
    m = F.least(F.size("_tc.inputs"), F.size("_tc.outputs"))
    fn = F.col("_tc.fn_name")
    fn = F.when(fn != "", fn)  # an empty name means the stdin form, as a falsy name does
    p = p.select(*key_cols, fn.alias("fn_name"), F.col("_tc.outputs").alias("_outs"),
                 F.posexplode(F.slice("_tc.inputs", 1, F.greatest(m, F.lit(0)))).alias("case_idx", "input"))
    return p.select(*key_cols, F.col("case_idx").cast("int").alias("case_idx"), "fn_name", "input",
                    F.element_at("_outs", F.col("case_idx") + 1).alias("expected"))


def is_forbidden(code, libs: Sequence[str] = FORBIDDEN_LIBS) -> Column:
    """Substring test, also in comments and strings, as the reference does."""
    return contains_any(code, libs)


Runner = Callable[[str, "str | None", str], tuple]


def run_one(runner: Runner, code: str | None, fn: str | None, inp: str | None, libs: Sequence[str]) -> tuple:
    """(actual, ok, error) of one case; programs naming a forbidden library
    are not run and a crashing runner is a failed case."""
    bad = next((lib for lib in libs if code is not None and lib in code), None)
    if bad is not None:
        return "", False, f"{bad} is not allowed"
    try:
        actual, ok, error = runner(code, fn, inp)
        return actual, bool(ok), error
    except Exception as e:
        return "", False, f"{type(e).__name__}: {e}"


RESULT_SCHEMA = "case_idx int, fn_name string, expected string, actual string, ok boolean, error string"


def run_responses(responses: DataFrame, problems: DataFrame, runner: Runner, libs: Sequence[str] = FORBIDDEN_LIBS,
                  num_partitions: int | None = None, response_col: str = "response", io_col: str = "input_output",
                  key_cols: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Run every response's program on its problem's cases with
    ``runner(code, fn_name, input) -> (actual, ok, error)``.

    One row per response goes to the runner, with its code once and the
    problem's case list; narrow rows per case come out (``key_cols,
    response_idx`` and ``RESULT_SCHEMA``). Responses are spread by (problem,
    response) over ``num_partitions`` tasks first: a run costs seconds, so a
    problem with many responses must not stay in the task of its join
    partition. A timeout is the runner's business and should come back as
    ``ok = False``.
    """
    spark = responses.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*key_cols, "response_idx"]
    code = responses.select(*keys, extract_code(response_col).alias("code"))
    cases = problems.select(*key_cols, parse_testcases(io_col).alias("cases"))
    rows = code.join(cases, list(key_cols)).select(*keys, "code", "cases.*").repartition(n, *keys)
    out = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", " + RESULT_SCHEMA
    names = [*keys, "case_idx", "fn_name", "expected", "actual", "ok", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                inputs = [] if row.inputs is None or row.outputs is None else row.inputs
                fn = row.fn_name or None  # an empty name means the stdin form
                done = [(*(getattr(row, k) for k in keys), i, fn, expected, *run_one(runner, row.code, fn, inp, libs))
                        for i, (inp, expected) in enumerate(zip(inputs, row.outputs if len(inputs) else []))]
                if done:
                    yield pd.DataFrame(done, columns=names)

    return rows.mapInPandas(run, out)


def case_passed(actual="actual", expected="expected", fn_name="fn_name") -> Column:
    """Stdin form: outputs equal after white-space normalisation; function
    form: ``str(result) == str(expected)``, i.e. plain string equality."""
    a, e, f = _col(actual), _col(expected), _col(fn_name)
    return F.coalesce(F.when(f.isNull(), normalize_output(a) == normalize_output(e)).otherwise(a == e),
                      F.lit(False))


def pass_counts(results: DataFrame, on_error: str = "zero",
                key_cols: Sequence[str] = ("problem_id", "response_idx")) -> DataFrame:
    """Cases passed per response (partial aggregation).

    ``on_error="zero"``: a case that failed to run ends the whole program in
    the reference, so the response scores 0; ``"count_passed"`` keeps the
    passes of the other cases.
    """
    if on_error not in ("zero", "count_passed"):
        raise ValueError("on_error must be 'zero' or 'count_passed'")
    passed = (F.col("ok") & case_passed()).cast("int")
    agg = results.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum(passed).alias("n_passed"),
        F.bool_and(F.col("ok")).alias("all_ran"),
    )
    score = F.col("n_passed") if on_error == "count_passed" else \
        F.when(F.col("all_ran"), F.col("n_passed")).otherwise(F.lit(0))
    return agg.withColumn("score", score.cast("int"))


def code_scores(responses: DataFrame, counts: DataFrame, response_col: str = "response",
                libs: Sequence[str] = FORBIDDEN_LIBS, keep_counts: bool = False) -> DataFrame:
    """Score per response: passes, 0 if the code names a forbidden library
    or nothing ran. ``keep_counts`` also keeps ``n_cases`` and ``n_passed``
    (0 for responses without results)."""
    r = responses.withColumn("_forbidden", is_forbidden(extract_code(response_col), libs))
    cols = [F.col("score").alias("_passes")]
    if keep_counts:
        cols += ["n_cases", "n_passed"]
    j = r.join(counts.select("problem_id", "response_idx", *cols), ["problem_id", "response_idx"], "left")
    j = j.withColumn("score", F.when(F.col("_forbidden"), F.lit(0))
                     .otherwise(F.coalesce(F.col("_passes"), F.lit(0))).cast("int"))
    if keep_counts:
        j = (j.withColumn("n_cases", F.coalesce("n_cases", F.lit(0)).cast("bigint"))
              .withColumn("n_passed", F.coalesce("n_passed", F.lit(0)).cast("bigint")))
    return j.drop("_forbidden", "_passes")


def reduce_error(c, program_path: str) -> Column:
    """Shorten a traceback: keep ``Traceback`` lines, lines equal to the last
    line, lines naming the program (cut after the opening quote of the path)
    and the line after each of those, as the reference's REPL does."""
    lines = F.split(_col(c), "\n", -1)
    last = F.element_at(lines, -1)
    init = F.struct(F.lit(False).alias("want"), F.array().cast("array<string>").alias("out"))

    def step(acc, m):
        is_tb = m.contains("Traceback")
        is_last = m == last
        is_path = m.contains(program_path)
        quote = F.locate('"/', m)
        cut = F.when(quote > 0, F.substring(m, 1, quote)).otherwise(F.lit(""))
        out = (F.when(is_tb | is_last, F.array_append(acc["out"], m))
               .when(is_path, F.array_append(acc["out"], cut))
               .when(acc["want"], F.array_append(acc["out"], m))
               .otherwise(acc["out"]))
        want = (F.when(is_tb | is_last, acc["want"])
                .when(is_path, F.lit(True))
                .when(acc["want"], F.lit(False))
                .otherwise(acc["want"]))
        return F.struct(want.alias("want"), out.alias("out"))

    return py_strip(F.array_join(F.aggregate(lines, init, step)["out"], "\n"))


def failure_reasons(results: DataFrame) -> DataFrame:
    """Count of failed cases by the last line of their error text."""
    failed = results.where(~F.col("ok"))
    reason = F.substring_index(F.col("error"), "\n", -1)
    return failed.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_failed"))
