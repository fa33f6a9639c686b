"""Prompts, chat message lists and completion fan-out.

Templates are unescaped once on the driver and split at ``{problem}``; the
prompt is ``concat(literal, problem, literal)``, constant-folded literals
around the column, so the problem text is never parsed as a template.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import _col

# The prompt templates (format syntax, "{{"/"}}" are literal
# braces) and the starter-code note, as the reference uses them.
MATH_TEMPLATE = (
    "Please solve the following problem and make sure to put your final inside \\boxed{{}}. "
    "E.g. \\boxed{{5}}, \\boxed{{A}}, \\boxed{{\\frac{{5}}{{100}}}}.\n"
    "Here is the math problem: {problem}"
)
CODE_TEMPLATE = (
    "Please solve the following programming problem using python and make sure to put your code "
    "between ```. \n"
    "It is important you use input() to take in the input from the command line and print the "
    "output normally.\n"
    "Here is the coding problem: {problem}\n"
)
STARTER_NOTE = ("\nHere is a starter code that you must use, we will call this function when "
                "evaluating your code:\n")

TEMPLATES = {"math": MATH_TEMPLATE, "code": CODE_TEMPLATE, "medical": MATH_TEMPLATE}


def split_template(template: str) -> tuple[str, str]:
    """Text before and after the single ``{problem}`` field, with ``{{`` and
    ``}}`` unescaped, read left to right as ``str.format`` does."""
    import re

    parts, field_at = [""], None
    for tok in re.split(r"(\{\{|\}\}|\{problem\}|\{|\})", template):
        if tok == "{{":
            parts[-1] += "{"
        elif tok == "}}":
            parts[-1] += "}"
        elif tok == "{problem}":
            if field_at is not None:
                raise ValueError("template must contain {problem} exactly once")
            field_at = len(parts)
            parts.append("")
        elif tok in ("{", "}"):
            raise ValueError("template may only contain the {problem} field")
        else:
            parts[-1] += tok
    if field_at is None:
        raise ValueError("template must contain {problem} exactly once")
    return parts[0], parts[1]


def render_prompt(problem, template: str) -> Column:
    pre, post = split_template(template)
    return F.concat(F.lit(pre), _col(problem), F.lit(post))


def with_starter_code(prompt, starter_code) -> Column:
    """Append the starter code when it is non-empty; null counts as empty."""
    s = _col(starter_code)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(_col(prompt), F.lit(STARTER_NOTE), s)) \
            .otherwise(_col(prompt))


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _col(content).alias("content"))


def user_messages(prompt) -> Column:
    """One-turn message list ``[{"role": "user", "content": prompt}]``."""
    return F.array(message("user", prompt))


def pair_messages(problem, accepted, rejected) -> tuple[Column, Column]:
    """(user, accepted) and (user, rejected) message lists of a pair."""
    return (F.array(message("user", problem), message("assistant", accepted)),
            F.array(message("user", problem), message("assistant", rejected)))


def chat_text(messages, prefix: str = "<|im_start|>{role}\n", suffix: str = "<|im_end|>\n") -> Column:
    """Message list to one text with user-given role markers.

    ``prefix`` may contain ``{role}``. The real markers of a model live in its
    tokenizer; ChatML-style markers are only the default.
    """
    pre_a, _, pre_b = prefix.partition("{role}")
    has_role = "{role}" in prefix

    def one(m):
        head = F.concat(F.lit(pre_a), m["role"], F.lit(pre_b)) if has_role else F.lit(prefix)
        return F.concat(head, m["content"], F.lit(suffix))

    return F.array_join(F.transform(_col(messages), one), "")


def render_problems(problems: DataFrame, domain: str, template: str | None = None,
                    key_cols: Sequence[str] = ("problem_id",)) -> DataFrame:
    """Map source columns to ``problem``/``solution`` and render the prompt.

    Code sources have ``question``, ``input_output`` and ``starter_code``;
    math sources ``problem`` and ``solution``.
    """
    template = template or TEMPLATES[domain]
    if domain == "code":
        prompt = with_starter_code(render_prompt("question", template), "starter_code")
        out = problems.select(*key_cols, F.col("question").alias("problem"),
                              F.col("input_output").alias("solution"), prompt.alias("prompt"))
    else:
        out = problems.select(*key_cols, "problem", "solution",
                              render_prompt("problem", template).alias("prompt"))
    return out.withColumn("messages", user_messages("prompt"))


def fan_out(df: DataFrame, n: int, name: str = "sample_idx") -> DataFrame:
    """``n`` rows per input row with a sample index 0..n-1 (narrow, no shuffle)."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sft_rows(problems: DataFrame, completions: DataFrame, key_cols: Sequence[str] = ("problem_id",),
             completion_col: str = "response") -> DataFrame:
    """One unscored (problem, completion) row per sampled response."""
    return completions.join(problems.select(*key_cols, "problem"), list(key_cols)) \
        .withColumnRenamed(completion_col, "completion")
