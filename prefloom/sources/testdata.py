"""Inputs derived from the test tables (documents, labels, embeddings, ...).

The test data has no problems, sampled responses or test results; these
functions build them deterministically and in full from the given tables, so
that the work grows with the tables. Each derivation has an equivalent SQL
form in ``prefloom.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.sources.tables import read_table

# Fixed values of the fixtures (ours, not from the reference): box contents for
# math responses and answers, and answer shapes for multiple choice.
MATH_VALUES = ["5", "5.0", "\\frac{1}{2}", "0.5", "1,000", "1000", "x+1"]
CHOICE_VALUES = ["A", "B", "A,B", "B,C", '["A","C"]']
STARTER_EN = "class Solution:\n    def solve(self, line):"


def _pick(values, idx_col):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx_col + F.lit(1)).cast("int"))


def responses(spark: SparkSession, sf_dir: str, group_size: int = 8) -> DataFrame:
    """Documents as sampled responses: ``group_size`` consecutive documents per problem."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.expr(f"doc_id div {group_size}").alias("problem_id"),
        F.expr(f"cast(doc_id % {group_size} as int)").alias("response_idx"),
        "doc_id", F.col("text").alias("response"), "n_chars", "lang", "source",
    )


def problems(spark: SparkSession, sf_dir: str, group_size: int = 8) -> DataFrame:
    """One problem per group: its statement is the group's first document."""
    r = responses(spark, sf_dir, group_size)
    return r.where(F.col("response_idx") == 0).select(
        "problem_id", F.col("response").alias("problem"), "lang", "source", "n_chars")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the statement of a problem of its own."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("problem_id"), F.col("text").alias("problem"), "lang", "source", "n_chars")


def candidates(spark: SparkSession, sf_dir: str, group_size: int = 8) -> DataFrame:
    """Responses scored by the label table (quality 0/1, 0 when unlabelled)."""
    r = responses(spark, sf_dir, group_size)
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (r.join(lab, "doc_id", "left")
            .withColumn("score", F.coalesce(F.col("quality"), F.lit(0)).cast("int"))
            .drop("quality"))


def candidates16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of 16 with scores 0-4 (``n_chars % 5``)."""
    r = responses(spark, sf_dir, 16)
    return r.withColumn("score", F.expr("cast(n_chars % 5 as int)"))


def math_answer(problem_id="problem_id"):
    """The boxed answer of a math problem (a function of its id)."""
    pid = F.col(problem_id) if isinstance(problem_id, str) else problem_id
    return F.concat(F.lit("\\boxed{"), _pick(MATH_VALUES, pid % 7), F.lit("}"))


def math_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts ending in a boxed final answer, with the problem's answer."""
    r = responses(spark, sf_dir, 8)
    box = _pick(MATH_VALUES, F.col("n_chars") % 7)
    return r.select(
        "problem_id", "response_idx", "doc_id",
        F.concat(F.col("response"), F.lit(" So \\boxed{"), box, F.lit("} holds")).alias("response"),
        math_answer().alias("answer"),
    )


def choice_candidates(spark: SparkSession, sf_dir: str, spaced: bool = False) -> DataFrame:
    """Whole texts ending in a boxed choice; ``spaced`` writes ``A, B`` in the box."""
    r = responses(spark, sf_dir, 8)
    box = _pick(CHOICE_VALUES, F.col("n_chars") % 5)
    if spaced:
        box = F.replace(box, F.lit(","), F.lit(", "))
    return r.select(
        "problem_id", "response_idx", "doc_id",
        F.concat(F.col("response"), F.lit(" \\boxed{"), box, F.lit("}")).alias("response"),
        _pick(CHOICE_VALUES, F.col("problem_id") % 5).alias("answer"),
    )


def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in the five fence shapes, chosen by ``n_chars % 5``."""
    r = responses(spark, sf_dir, 16)
    t = F.col("response")
    shape = F.col("n_chars") % 5
    resp = (F.when(shape == 0, t)
            .when(shape == 1, F.concat(F.lit("Here is my code:\n```python\n"), t, F.lit("\n```\nThat is all.")))
            .when(shape == 2, F.concat(F.lit("```\n"), t, F.lit("\n```")))
            .when(shape == 3, F.concat(F.lit("Code:\n```python"), t))
            .otherwise(F.concat(F.lit("```python\nimport subprocess\n"), t, F.lit("\n```"))))
    return r.select("problem_id", "response_idx", "doc_id", "n_chars", resp.alias("response"))


def code_problems(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Code problems with JSON test cases built from the statement's lines.

    ``problem_id % 3``: 0 = stdin form; 1 = stdin form with one output fewer;
    2 = function form with ``fn_name``. Starter code by language.
    """
    p = problems(spark, sf_dir, 16) if p is None else p
    lines = F.split(F.col("problem"), "\n", -1)
    outs = F.transform(lines, lambda x: F.replace(x, F.lit(" "), F.lit("_")))
    form = F.col("problem_id") % 3
    outs = F.when(form == 1, F.slice(outs, 1, F.greatest(F.size(outs) - 1, F.lit(0)))).otherwise(outs)
    fn = F.when(form == 2, F.lit("solve"))
    io = F.to_json(F.struct(fn.alias("fn_name"), lines.alias("inputs"), outs.alias("outputs")))
    starter = F.when(F.col("lang") == "en", F.lit(STARTER_EN)).when(F.col("lang") == "de", F.lit(""))
    return p.select("problem_id", F.col("problem").alias("question"), io.alias("input_output"),
                    starter.alias("starter_code"), "lang")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def doc_vec_id(spark: SparkSession, sf_dir: str, doc_col="doc_id"):
    """Embedding row of a document: ``doc_id mod (number of embeddings)``."""
    n = embeddings(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return F.pmod(F.col(doc_col), n)


def sft_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user turn, next assistant turn) pairs of the conversations.

    A keyed self-join on ``turn + 1`` instead of ``lead`` over a conversation
    window: a long conversation is then spread by turn, not held by one task.
    Turns are dense per conversation, so the next turn is ``turn + 1``.
    """
    c = read_table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("problem"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return u.join(a, ["conv_id", "turn"])


# Fixed values of the fixtures: error kinds of failed runs.
ERROR_KINDS = ["ValueError: invalid literal for int()", "IndexError: list index out of range",
               "TimeoutError: Timed out after 10 seconds."]


def code_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (response, case) run results as a runner would return them.

    ``actual`` by ``(n_chars + case_idx) % 5``: 0 the expected text, 1 with
    doubled spaces, 2 with a trailing newline, otherwise a different text;
    ``ok`` false when ``n_chars % 11 = 0`` for case 1.
    """
    from prefloom.operators.code_exec import explode_testcases

    cases = explode_testcases(code_problems(spark, sf_dir))
    resp = code_candidates(spark, sf_dir).select("problem_id", "response_idx", "n_chars")
    # spread like code_exec.run_responses does before a runner: a problem with many
    # responses is split over tasks (and AQE may split the skewed join)
    j = resp.join(cases, "problem_id").repartition("problem_id", "response_idx", "case_idx")
    v = (F.col("n_chars") + F.col("case_idx")) % 5
    e = F.col("expected")
    actual = (F.when(v == 0, e).when(v == 1, F.regexp_replace(e, " ", "  "))
              .when(v == 2, F.concat(e, F.lit("\n"))).otherwise(F.concat(e, F.lit(" x"))))
    ok = ~((F.col("n_chars") % 11 == 0) & (F.col("case_idx") == 1))
    err = F.when(~ok, F.concat(
        F.lit('Traceback (most recent call last):\n  File "/tmp/run/tmp.py", line '),
        (F.col("case_idx") + 3).cast("string"), F.lit(", in <module>\n    main()\n"),
        _pick(ERROR_KINDS, F.col("n_chars") % 3))).otherwise(F.lit(""))
    return j.select("problem_id", "response_idx", "case_idx", "fn_name", "expected",
                    F.when(ok, actual).otherwise(F.lit("")).alias("actual"), ok.alias("ok"),
                    err.alias("error"))
