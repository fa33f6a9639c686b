"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` lists ratios of a text (length, symbols, stop words, lines) with
the range in which they are accepted. ``judge`` adds the counts and the
verdict as column expressions only: no user function, no exchange, the text
is read once.

The stop-word rule speaks for the languages of its words only: where a
language column names another one, the other rules decide.

Defined results: a null text counts as empty, has no words and is rejected;
an empty table gives an empty table; equal rows get equal verdicts; columns
of the input with clashing names are kept apart (the caller gets new columns
from ``features`` and chooses their names).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rules: fewest words, most words (per cent) in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Languages of the stop words. A text without a language is judged by them.
STOP_LANGUAGES = ("en", "fr", "de", "es")
#: Frequent function words of these languages (lower case; capitals also count).
STOP_WORDS = [
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "au", "dans", "de", "des", "du", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "für", "im", "ist", "mit", "nicht",
    "sich", "sie", "und", "von", "zu",
    "al", "como", "con", "del", "el", "es", "las", "los", "no", "para", "por", "se", "su", "una", "y",
]


class Rule(NamedTuple):
    """Accepted range of a ratio; a bound of None is open."""

    name: str
    part: str
    whole: str
    least: float | None
    most: float | None


#: The table. Ratios are of columns of ``features``.
RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
]

_SPACE = " \t\n\x0b\x0c\r"


def stop_words() -> list[str]:
    """The stop words as they may be written."""
    return list(dict.fromkeys(v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())))


def features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words and n_stop_words.

    Repeated 3-word windows: every window is hashed to 64 bits, its position
    takes the low ``b`` bits (as many as the word count needs), and one sort
    of longs brings equal windows together; neighbours of equal hash count as
    equal only if their words are.
    """
    stop = ", ".join("'" + w + "'" for w in stop_words())
    texts = df.select(*(keep or []), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = texts.select("*", F.btrim("_text", F.lit(_SPACE)).alias("_trimmed")).select(
        "*",
        F.expr(f"if(_trimmed = '', cast(array() as array<string>), split(_trimmed, '[{_SPACE}]+'))").alias("_words"),
        F.expr(f"filter(split(_text, '\n'), l -> btrim(l, '{_SPACE}') != '')").alias("_lines"))
    counted = words.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(_words, w -> w in ({stop}))) as bigint)").alias("n_stop_words"),
        F.length(F.bin(F.size("_words").cast("long"))).alias("_bits"))
    windows = counted.select("*", F.expr(
        "if(n_words < 3, cast(array() as array<bigint>), sort_array(transform(slice(_words, 1, cast(n_words - 2 as int)),"
        " (w, i) -> shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | cast(i as bigint))))")
        .alias("_windows"))
    def word(x, k):
        return f"get(_words, cast({x} & (shiftleft(1L, _bits) - 1) as int) + {k})"

    def equal(y):
        same = " and ".join(f"{word('x', k)} = {word(y, k)}" for k in range(3))
        return f"coalesce(shiftright(x, _bits) = shiftright({y}, _bits) and {same}, false)"

    found = windows.select("*", F.expr(
        f"sort_array(transform(filter(_windows, (x, i) -> {equal('get(_windows, i - 1)')} or {equal('get(_windows, i + 1)')}),"
        " x -> x & (shiftleft(1L, _bits) - 1)))").alias("_at"))
    return found.select(
        *(keep or []), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words",
        F.expr("aggregate(transform(_at, (p, i) -> least(3L, coalesce(get(_at, i + 1), p + 3L) - p)), 0L,"
               " (a, x) -> a + x)").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def verdict(rules: list[Rule] | None = None, lang: Column | None = None) -> Column:
    """The table as one condition: true if every ratio lies in its range (an
    undefined ratio, of a text without words or lines, is outside). A rule on
    stop words holds where ``lang`` is null or one of theirs."""
    out = F.lit(True)
    for r in RULES if rules is None else rules:
        other = F.lit(False) if lang is None or r.part != "n_stop_words" else F.coalesce(~lang.isin(*STOP_LANGUAGES), F.lit(False))
        ratio = F.try_divide(F.col(r.part), F.col(r.whole)).cast("double")
        if r.least is not None:
            out = out & (other | F.coalesce(ratio >= F.lit(r.least), F.lit(False)))
        if r.most is not None:
            out = out & (other | F.coalesce(ratio <= F.lit(r.most), F.lit(False)))
    return out


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None,
          rules: list[Rule] | None = None, lang: str | None = None) -> DataFrame:
    """``features`` with base_failed and kept; ``lang`` is the language column, if there is one."""
    kept = list(keep or [])
    held = df if lang is None else df.withColumn("_lang", F.col(f"`{lang}`").cast("string"))
    out = features(held, text, kept + ["_lang"] * (lang is not None)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules, None if lang is None else F.col("_lang"))).drop("_lang")


def accepted(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with their own columns only (a filter stage)."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").alias("_t"),
                       (F.col(f"`{lang}`") if lang in df.columns else F.lit(None)).cast("string").alias("_l"))
    judged = judge(packed, "_t", ["_row"], lang="_l")
    # The optimiser would push a plain filter below the projection and so copy every expression into the
    # condition, where each lambda evaluates its arrays anew; a non-deterministic column stays where it is.
    return judged.withColumn("_kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("_kept").select("_row.*")
