"""Response scorers as Column expressions, and their registry.

Each scorer maps (response, answer) columns to a score column. The pairing
operator only needs the score to be comparable; booleans are cast to 0/1.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import _col, bound, extract_boxed, py_strip


# -- rational numbers ---------------------------------------------------------

_DEC = r"^-?[0-9]+(\.[0-9]+)?$"
_THOUSANDS = r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
_FRACTION = r"^(?:(-?)\\[dt]?frac\{(-?[0-9]+)\}\{(-?[0-9]+)\}|(-?[0-9]+)/(-?[0-9]+))$"
#: Digits of a limb: products of limbs can be summed 9 million times in a long.
_LIMB = 6
#: Digits a side up to which products fit a decimal.
_SHORT = 18


def _without_separators(s: Column) -> Column:
    return F.when(s.rlike(_THOUSANDS), F.regexp_replace(s, ",", "")).otherwise(s)


def parse_rational(c) -> Column:
    """Exact value of a number as ``struct<neg boolean, num string, den string>``
    (digits without sign or leading zeros; any length).

    Accepts integers and decimals, thousands separators (``1,000``),
    ``\\frac{a}{b}`` / ``\\dfrac`` / ``\\tfrac`` and ``a/b`` of integers.
    Anything else, and a zero denominator, is null: this is the numeric part
    of answer equality only, not a computer-algebra system.
    """
    def digits(x):
        return F.regexp_replace(x, r"^-?0*(?=[0-9])", "")

    def parsed(s):
        ip, fp = F.regexp_extract(s, r"^-?([0-9]+)", 1), F.regexp_extract(s, r"\.([0-9]+)$", 1)
        decimal = F.struct(s.startswith("-").alias("neg"), digits(F.concat(ip, fp)).alias("num"),
                           F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(fp))).alias("den"))
        num = F.concat(F.regexp_extract(s, _FRACTION, 2), F.regexp_extract(s, _FRACTION, 4))
        den = F.concat(F.regexp_extract(s, _FRACTION, 3), F.regexp_extract(s, _FRACTION, 5))
        neg = (num.startswith("-") != den.startswith("-")) != (F.regexp_extract(s, _FRACTION, 1) == "-")
        fraction = F.struct(neg.alias("neg"), digits(num).alias("num"), digits(den).alias("den"))
        return F.when(s.rlike(_DEC), decimal).when(s.rlike(_FRACTION) & (digits(den) != "0"), fraction)

    return bound(_without_separators(_col(c)), parsed)


def _limbs(digits: Column) -> Column:
    """An integer's digits as limbs of ``_LIMB`` digits, the lowest first."""
    size = F.ceil(F.length(digits) / F.lit(_LIMB)).cast("int") * _LIMB
    cut = F.regexp_extract_all(F.lpad(digits, size, F.lit("0")), F.lit(f"[0-9]{{{_LIMB}}}"), F.lit(0))
    return F.transform(F.reverse(cut), lambda x: x.cast("long"))


def _times(x: Column, y: Column) -> Column:
    """Product of two integers in limbs, without carries."""
    return F.transform(
        F.sequence(F.lit(0), F.size(x) + F.size(y) - 2),
        lambda k: F.aggregate(F.sequence(F.greatest(k - F.size(y) + 1, F.lit(0)), F.least(k, F.size(x) - 1)), F.lit(0).cast("long"),
                              lambda total, i: total + F.get(x, i) * F.get(y, k - i)))


def _long_products_equal(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a * b = c * d, for digit strings of any length: the limbs'
    differences must all go into carries, the last of which is zero."""
    base = F.lit(10 ** _LIMB).cast("long")
    state = F.struct(F.lit(0).cast("long").alias("carry"), F.lit(True).alias("same"))

    def step(s, gap):
        t = s["carry"] + gap  # a multiple of the base if equal so far; its quotient is below 2^53
        return F.struct(F.rint((t - t % base) / base).cast("long").alias("carry"), (s["same"] & (t % base == 0)).alias("same"))

    def compared(v):
        gaps = F.zip_with(_times(v["a"], v["b"]), _times(v["c"], v["d"]),
                          lambda p, q: F.coalesce(p, F.lit(0).cast("long")) - F.coalesce(q, F.lit(0).cast("long")))
        return F.aggregate(gaps, state, step, lambda s: s["same"] & (s["carry"] == 0))

    return bound(F.struct(*[_limbs(x).alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))]), compared)


def canonical_decimal(c) -> Column:
    """A decimal of any length in its shortest form (no separators, leading
    zeros, trailing fraction zeros or sign of zero); null for anything else."""
    def shortest(s):
        short = F.regexp_replace(F.regexp_replace(s, r"^(-?)0+(?=[0-9])", "$1"), r"(\.[0-9]*?)0+$", "$1")
        return F.when(s.rlike(_DEC), bound(F.regexp_replace(short, r"\.$", ""), lambda x: F.when(x == "-0", F.lit("0")).otherwise(x)))

    return bound(_without_separators(_col(c)), shortest)


def rational_equal(a, b) -> Column:
    """True iff both are the same number; false (not null) otherwise.

    Two decimals compare by their shortest form. Where a side is a fraction,
    both are cross-multiplied exactly: as decimals for up to 18 digits a part,
    limb by limb beyond, at any length.
    """
    def crossed(v):
        x, y = F.get(v, 0), F.get(v, 1)
        parts = (x["num"], y["den"], y["num"], x["den"])
        short = F.greatest(*[F.length(p) for p in parts]) <= _SHORT
        p, q, r, t = [part.try_cast(f"decimal({_SHORT},0)") for part in parts]
        zero = (x["num"] == "0") & (y["num"] == "0")
        return zero | ((x["neg"] == y["neg"]) & F.when(short, p * q == r * t).otherwise(_long_products_equal(*parts)))

    def compared(sides):
        shortest = F.transform(sides, canonical_decimal)
        fraction = F.exists(sides, lambda s: s.rlike(_FRACTION))
        return F.when(fraction, bound(F.transform(sides, parse_rational), crossed)).otherwise(
            bound(shortest, lambda s: F.get(s, 0) == F.get(s, 1)))

    return F.coalesce(bound(F.array(_col(a), _col(b)), compared), F.lit(False))


# -- math ---------------------------------------------------------------------

def math_score(response, answer, mode: str = "first_brace", which: str = "first",
               rational: bool = True) -> Column:
    """Correct iff the boxed cores are equal strings, or equal numbers.

    Both sides are box-extracted (stripped text when there is no box). The
    reference's symbolic check is replaced by ``rational_equal``; expressions
    beyond numbers compare by string only (``math_score_with_cas`` takes a
    user computer-algebra callable for the rest).
    """
    def same(core):
        equal = core["r"].eqNullSafe(core["a"])
        return equal | rational_equal(core["r"], core["a"]) if rational else equal

    return bound(F.struct(extract_boxed(response, mode, which).alias("r"),
                          extract_boxed(answer, mode, which).alias("a")), same)


def cas_equal(cas_fn: Callable[[str, str], bool]):
    """Wrap a user computer-algebra check ``cas_fn(response_core, answer_core)
    -> bool`` as an Arrow-batched UDF.

    Results are memoised per Python worker, so repeated (response, answer)
    cores are solved once per worker without a shuffle; exceptions count as
    not equal. Use it only for rows the built-in checks leave unequal
    (``math_score_with_cas``).
    """
    memo: dict = {}

    @F.pandas_udf("boolean")
    def _eq(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            key = (x, y)
            if key not in memo:
                try:
                    memo[key] = bool(cas_fn(x, y))
                except Exception:
                    memo[key] = False
                if len(memo) > 100_000:
                    memo.clear()
            out.append(memo[key])
        return pd.Series(out, dtype=bool)

    return _eq


def math_score_with_cas(df, cas_fn, response_col: str = "response", answer_col: str = "answer",
                        mode: str = "first_brace", out_col: str = "correct"):
    """``math_score`` plus a user CAS for the rows it leaves unequal.

    Rows already decided by string or rational equality never reach Python:
    the frame is split on that column, the CAS runs on the rest, and the two
    parts are unioned (no join, no shuffle).
    """
    rc = extract_boxed(response_col, mode)
    ac = extract_boxed(answer_col, mode)
    base = df.withColumn("_rc", rc).withColumn("_ac", ac) \
             .withColumn("_fast", rc.eqNullSafe(ac) | rational_equal(rc, ac))
    decided = base.where(F.col("_fast")).withColumn(out_col, F.lit(True))
    rest = base.where(~F.col("_fast")).withColumn(out_col, cas_equal(cas_fn)(F.col("_rc"), F.col("_ac")))
    return decided.unionByName(rest).drop("_rc", "_ac", "_fast")


# -- multiple choice ------------------------------------------------------------

def parse_choice(c, trim: bool = False) -> Column:
    """Answer shape: ``struct<is_list boolean, items array<string>, text string>``.

    A bracketed JSON list literal is a list; otherwise a comma splits into a
    list (by default without trimming, as the reference: ``A, B`` gives ``A``
    and `` B``; ``trim=True`` strips the items); otherwise one string.
    Never evaluated as code.
    """
    t = _col(c)
    parsed = F.from_json(t, "array<string>")
    bracket_list = t.contains("[") & parsed.isNotNull()
    comma = t.contains(",")
    items = F.when(bracket_list, parsed).when(comma, F.split(t, ",", -1))
    if trim:
        items = F.transform(items, lambda x: py_strip(x))
    return F.struct(items.isNotNull().alias("is_list"), items.alias("items"), t.alias("text"))


def choice_score(response, answer, only_perfect_match: bool = False,
                 mode: str = "first_brace", trim: bool = False) -> Column:
    """Multiple-choice score.

    -1 if one side is a list and the other not; for strings +1 / -1; for lists
    ``len(correct) - missing - extra`` with duplicates counted each time (may
    be negative). The response is box-extracted first, the answer is not.
    ``only_perfect_match`` changes the list case only: 1 if the lists match
    (``score == len(correct)``), else 0 - the reference returns a boolean
    there and the integers above elsewhere, which compare the same way.
    """
    parsed = F.struct(bound(extract_boxed(response, mode), lambda t: parse_choice(t, trim)).alias("g"),
                      bound(_col(answer), lambda t: parse_choice(t, trim)).alias("c"))
    return bound(parsed, lambda p: _choice_score(p["g"], p["c"], only_perfect_match))


def _choice_score(g: Column, c: Column, only_perfect_match: bool) -> Column:
    gi, ci = g["items"], c["items"]
    missing = F.size(F.filter(ci, lambda x: ~F.array_contains(gi, x)))
    extra = F.size(F.filter(gi, lambda x: ~F.array_contains(ci, x)))
    list_score = F.size(ci) - missing - extra
    if only_perfect_match:
        list_score = (list_score == F.size(ci)).cast("int")
    str_score = F.when(g["text"] == c["text"], F.lit(1)).otherwise(F.lit(-1))
    return (F.when(g["is_list"] != c["is_list"], F.lit(-1))
            .when(g["is_list"], list_score)
            .otherwise(str_score))


# -- registry -----------------------------------------------------------------

Scorer = Callable[[Column, Column], Column]

SCORERS: dict[str, Scorer] = {
    "math": lambda r, a: math_score(r, a).cast("int"),
    "medical": lambda r, a: choice_score(r, a),
}


def register_scorer(name: str, fn: Scorer) -> None:
    """Add a scorer ``(response_col, answer_col) -> score_col``."""
    SCORERS[name] = fn


def get_scorer(name: str) -> Scorer:
    try:
        return SCORERS[name]
    except KeyError:
        raise KeyError(f"unknown scorer {name!r}; known: {sorted(SCORERS)} "
                       "(code scores come from test results, see operators.code_exec)") from None


__all__ = ["parse_rational", "rational_equal", "math_score", "parse_choice",
           "choice_score", "SCORERS", "register_scorer", "get_scorer", "py_strip"]
