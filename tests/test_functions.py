"""Golden rows for the scalar functions (FIXTURES.md part 3)."""

import random
import time

from pyspark.sql import functions as F

from prefloom.functions import scoring, text
from tests.conftest import rows


def _one(spark, values, fn, schema="a string"):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in df.select(fn(df).alias("x")).collect()]


def test_boxed_first_brace(spark):
    vals = ["a \\boxed{5} b \\boxed{6}", "\\boxed{\\frac{1}{2}}", "\\boxed{}", "none \n",
            "\\boxed{a\nb}", "\\boxed{ 7 }"]
    got = _one(spark, vals, lambda d: text.extract_boxed(d.a))
    assert got == ["5", "\\frac{1", "", "none", "\\boxed{a\nb}", "7"]


def test_boxed_balanced_and_last(spark):
    vals = ["\\boxed{\\frac{1}{2}}", "x \\boxed{1} y \\boxed{2} z"]
    assert _one(spark, vals, lambda d: text.extract_boxed(d.a, "balanced")) == ["\\frac{1}{2}", "1"]
    assert _one(spark, vals, lambda d: text.extract_boxed(d.a, which="last"))[1] == "2"


def test_balanced_long_box_no_overflow(spark):
    long = "\\boxed{" + ("ab{c}" * 4000) + "}"
    assert _one(spark, [long], lambda d: F.length(text.extract_boxed(d.a, "balanced"))) == [20000]


def test_unicode_strip(spark):
    assert _one(spark, ["\u3000\x1c x \xa0\n"], lambda d: text.py_strip(d.a)) == ["x"]


def test_math_score_modes(spark):
    df = spark.createDataFrame([("\\boxed{\\frac{1}{2}}", "\\boxed{\\frac{1}{3}}")], "r string, a string")
    assert rows(df, scoring.math_score(df.r, df.a).alias("x")) == [(True,)]
    assert rows(df, scoring.math_score(df.r, df.a, mode="balanced").alias("x")) == [(False,)]


def test_rational_equal(spark):
    pairs = [("0.50", "\\frac{1}{2}", True), ("5", "5.0", True), ("1/2", "\\dfrac{2}{4}", True),
             ("x+1", "1+x", False), ("1,000", "1000", True), ("-3", "\\frac{-6}{2}", True),
             ("1/0", "1/0", False), ("2", "3", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(scoring.rational_equal(df.a, df.b)).collect()]
    assert got == [e for _, _, e in pairs]


def test_choice_score(spark):
    cases = [("\\boxed{A}", "A", 1), ("\\boxed{A}", "B", -1), ("\\boxed{A}", "A,B", -1),
             ('\\boxed{["A","C"]}', '["A","B"]', 0), ('\\boxed{["A","C"]}', '["A","B","B"]', 0),
             ('\\boxed{["C","D","E"]}', '["A","B"]', -3), ("\\boxed{A,B}", "B,A", 2)]
    df = spark.createDataFrame([(r, a) for r, a, _ in cases], "r string, a string")
    got = [r[0] for r in df.select(scoring.choice_score(df.r, df.a)).collect()]
    assert got == [e for _, _, e in cases]
    perfect = [r[0] for r in df.select(scoring.choice_score(df.r, df.a, only_perfect_match=True)).collect()]
    assert perfect == [1, -1, -1, 0, 0, 0, 1]


def test_extract_code(spark):
    vals = ["no fence here", "x```python\nprint(1)\n```y", "```python3\nprint(1)```",
            "a```tail", "```"]
    got = _one(spark, vals, lambda d: text.extract_code(d.a))
    assert got == ["no fence here", "\nprint(1)\n", "3\nprint(1)", "tail", ""]


def test_normalize_and_last_line(spark):
    assert _one(spark, ["1 2\n", "  1\n2"], lambda d: text.normalize_output(d.a)) == ["1,2", "1,2"]
    assert _one(spark, ["Expected...\n3", "Traceback ...", " 7 ", "5.0"],
                lambda d: text.last_line_int(d.a)) == [3, 0, 7, 0]
    assert _one(spark, ["a  b\tc\n", "", "   "], lambda d: text.count_tokens(d.a)) == [3, 0, 0]


def test_boxes_of_any_depth(spark):
    deep = "ans \\boxed{\\frac{\\sqrt{\\frac{1}{2}}}{3}} ok"
    vals = [deep, "\\boxed{a \\boxed{b}} \\boxed{c}", "} \\boxed{ open \\boxed{x}", "{\\boxed{}}", " none } { ", "\\boxed{" * 40 + "}" * 39]
    first = _one(spark, vals, lambda d: text.extract_boxed(d.a, "balanced"))
    last = _one(spark, vals, lambda d: text.extract_boxed(d.a, "balanced", "last"))
    assert first[:5] == ["\\frac{\\sqrt{\\frac{1}{2}}}{3}", "a \\boxed{b}", "x", "", "none } {"]
    assert last[:5] == ["\\frac{\\sqrt{\\frac{1}{2}}}{3}", "c", "x", "", "none } {"]
    assert first[5] == "\\boxed{" * 38 + "}" * 38 and last[5] == ""


def test_numbers_of_any_length(spark):
    cases = [("1000000000000000000000", "1,000,000,000,000,000,000,000", True), ("1234567890123456789", "1234567890123456789.0", True),
             ("-0.0", "0", True), ("007.50", "7.5", True), ("1234567890123456789", "1234567890123456788", False), ("100", "1", False),
             ("0.10", "0.1000000000000000000000000", True), ("1/2", "0.5", True), ("x", "x1", False)]
    df = spark.createDataFrame(cases, "a string, b string, e boolean")
    assert [r[0] for r in df.select(scoring.rational_equal("a", "b")).collect()] == [c[2] for c in cases]


def test_last_lines_of_any_length(spark):
    assert _one(spark, ["1234567890123456789", "a\n" + "9" * 38, "9" * 39, "-5"], lambda d: text.last_line_int(d.a)) == [
        1234567890123456789, int("9" * 38), None, -5]


def test_choice_trim_option(spark):
    df = spark.createDataFrame([("\\boxed{A, B}", "A,B")], "r string, a string")
    assert rows(df, scoring.choice_score(df.r, df.a)) == [(0,)]
    assert rows(df, scoring.choice_score(df.r, df.a, trim=True)) == [(2,)]


def test_math_score_with_cas(spark):
    df = spark.createDataFrame([(0, "\\boxed{x+1}", "\\boxed{1+x}"), (1, "\\boxed{5}", "\\boxed{5.0}"),
                                (2, "\\boxed{y}", "\\boxed{z}")], "id int, response string, answer string")

    def cas(a, b):  # toy: equal as sorted characters
        return sorted(a) == sorted(b)

    got = sorted(rows(scoring.math_score_with_cas(df, cas), "id", "correct"))
    assert got == [(0, True), (1, True), (2, False)]


def test_fractions_of_any_length(spark):
    rng = random.Random(4)
    cases = []
    for size in (1, 5, 17, 18, 19, 20, 40, 41, 300):
        for _ in range(6):
            n, d, k = (rng.randrange(10 ** (size - 1), 10 ** size) for _ in range(3))
            sign = rng.choice(["", "-"])
            cases.append((f"{sign}{n}/{d}", f"{sign}\\frac{{{n * k}}}{{{d * k}}}", True))
            cases.append((f"{n}/{d}", f"\\dfrac{{-{n * k}}}{{-{d * k}}}", True))
            cases.append((f"{n}/{d}", f"{n * k + 1}/{d * k}", False))
            cases.append((f"{n}/{d}", f"-{n}/{d}", False))
            cases.append((f"{n}.{d}", f"{n}{d}/1{'0' * len(str(d))}", True))
            cases.append((f"{n}.{d}", f"{n}{d}/1{'0' * (len(str(d)) + 1)}", False))
    cases += [("0/5", "0.00", True), ("-0/7", "0", True), ("0/9", "1/9", False), ("1/0", "1/0", False), ("0" * 50 + "1/3", "2/6", True),
              ("1/" + "0" * 30, "1", False), (None, "1/2", False), ("1/2", None, False)]
    df = spark.createDataFrame(cases, "a string, b string, e boolean")
    got = df.select("a", "b", "e", scoring.rational_equal("a", "b").alias("g")).where("g <> e OR g IS NULL").collect()
    assert got == []


def test_boxes_against_a_stack(spark):
    rng = random.Random(9)
    vals = ["".join(rng.choices(["{", "}", "\\boxed{", "a", " "], k=rng.randrange(30))) for _ in range(400)]

    def by_hand(t, last):
        found, open_ = [], []
        for i, ch in enumerate(t):
            if ch == "{":
                open_.append(i + 1 if t[:i + 1].endswith("\\boxed{") else 0)
            elif ch == "}" and open_:
                start = open_.pop()
                if start:
                    found.append((start, t[start:i]))
        return (sorted(found)[-1 if last else 0][1] if found else t).strip()

    for which in ("first", "last"):
        assert _one(spark, vals, lambda d: text.extract_boxed(d.a, "balanced", which)) == [by_hand(v, which == "last") for v in vals]


def test_a_million_braces(spark):
    n = 250_000
    deep = "\\boxed{" + "{}" * n + "{" * n + "}" * n + "} tail"
    df = spark.createDataFrame([(deep,)], "a string").repartition(1).persist()
    df.count()
    out = df.select(F.length(text.extract_boxed("a", "balanced")).alias("n"))
    out.collect()
    start = time.time()
    assert out.collect()[0][0] == 4 * n
    assert time.time() - start < 10  # alone about a second; a fold that copies its stack takes minutes
