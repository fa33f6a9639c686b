"""Grouping of spelling variants by reduced-alphabet generation.

Each letter is hashed to one of a few symbols, which maps a word to a reduced
word. If two words differ by one edit, so do their reduced words, or these are
equal. For each distinct reduced word the full one-edit neighbourhood (itself,
all deletions, replacements and insertions over the few symbols) is generated
and joined with the reduced vocabulary; words of linked reduced words are then
compared as they are, and pairs at distance one are kept.

A reduced word is held as one number, its symbols (from 1) as digits in base
symbols + 1, so a neighbour costs a few operations on whole arrays and 8
bytes, whatever the word's length. Up to 20 letters the number is exact; beyond
it wraps around, which can only add candidates for the comparison.

Everything is joins and aggregations on distinct words: a word's frequency
adds no work after counting, which sums within tasks first. Variant chains are
followed by pointer doubling; a form is at least ``ratio`` times as frequent,
so chains are acyclic and their number of rounds is logarithmic in the
logarithm of the largest count.

Defined results: a null text has no words; a null id counts as an empty
string; repeated rows count again; an empty table gives an empty table; other
columns are ignored; words of any length are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import U64, mix64, saved

#: Symbols that letters are hashed to.
SYMBOLS = 8
#: Letters and occurrences of a word at least, and how much more frequent a form is.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One run in so many is misspelt by ``misspelt``.
EVERY = 199
#: Symbols whose neighbours are held at once by a task.
SLICE = 1 << 15

_BASE = U64(SYMBOLS + 1)
_INVERSE = U64(pow(SYMBOLS + 1, -1, 1 << 64))  # the base is odd


def runs(docs: DataFrame, least: int = LETTERS) -> DataFrame:
    """doc_id (string), run: the maximal letter runs of at least ``least``
    letters of every text, A-Z in lower case."""
    run = F.col("run")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{int(least)},}}"), F.lit(0))).alias("run"),
    ).select("doc_id", F.when(run.rlike("[A-Z]"), F.translate(run, upper, lower)).otherwise(run).alias("run"))


def misspelt(found: DataFrame) -> DataFrame:
    """The runs, of which one in ``EVERY`` (by crc32 of ``doc_id:run``) has lost a letter."""
    run, key = F.col("run"), F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = F.pmod(F.col("_h"), F.length(run).cast("long")).cast("int")
    short = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return (found.withColumn("_h", key)
            .select("doc_id", F.when(F.col("_h") % EVERY == 0, short).otherwise(run).alias("run")))


def vocabulary(found: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n of all runs that are long and frequent enough."""
    return (found.where(F.length("run") >= letters).groupBy(F.col("run").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences))


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' symbols (1 to SYMBOLS) in one array, and the words' lengths."""
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    return mix64(letters.astype(U64) + U64(1)) % U64(SYMBOLS) + U64(1), size


def _laid_out(digit: np.ndarray, size: np.ndarray):
    """Number of each word, and per symbol its place's power, the number of the
    symbols before it and of the word."""
    start = np.cumsum(size) - size
    powers = np.full(int(size.max(initial=0)) + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    power = powers[np.arange(len(digit)) - np.repeat(start, size)]
    summed = np.concatenate([np.zeros(1, U64), np.cumsum(digit * power)])  # wraps around
    total = summed[start + size] - summed[start]
    before = summed[:-1] - np.repeat(summed[start], size)
    return total, power, before, np.repeat(total, size), powers[size]


def codes(words: list[str]) -> np.ndarray:
    """The number of each word's reduced word."""
    return _laid_out(*symbols(words))[0]


def neighbourhood(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row of the word, number of a reduced word) for every distinct reduced
    word at most one edit from the word's own."""
    digit, size = symbols(words)
    total, power, before, whole, end = _laid_out(digit, size)
    row = np.arange(len(words))
    owner = np.repeat(row, size)
    behind = whole - before  # the symbol and those after it, at their places
    last = np.zeros(len(digit), bool)
    last[np.cumsum(size)[size > 0] - 1] = True
    # of a run of equal symbols only the last one is deleted, and one is only inserted behind it
    differs = last | (digit != np.concatenate([digit[1:], digit[:1]]))
    rows, near = [row, owner[differs]], [total, (before + (behind - digit * power) * _INVERSE)[differs]]
    for s in range(1, SYMBOLS + 1):
        other = digit != U64(s)
        rows += [owner[other], owner[other], row]
        near += [(whole + (U64(s) - digit) * power)[other], (before + U64(s) * power + behind * _BASE)[other], total + U64(s) * end]
    return np.concatenate(rows), np.concatenate(near)


def _sliced(words: list[str]):
    """Parts of the list of about SLICE letters."""
    part, letters = [], 0
    for w in words:
        part.append(w)
        letters += len(w)
        if letters >= SLICE:
            yield part
            part, letters = [], 0
    if part:
        yield part


def with_codes(words: DataFrame) -> DataFrame:
    """word, n and the number of the reduced word."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = pa.array(codes(batch.column(0).to_pylist()).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, code], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def links(coded: DataFrame) -> DataFrame:
    """code, near: reduced words of the vocabulary at most one edit apart (both ways, and each with itself)."""
    reduced = coded.groupBy("code").agg(F.min("word").alias("word"))

    def run(batches):
        for batch in batches:
            for part in _sliced(batch.column(1).to_pylist()):
                rows, near = neighbourhood(part)
                yield pa.RecordBatch.from_arrays([pa.array(codes(part).view(np.int64)[rows]), pa.array(near.view(np.int64))],
                                                 names=["code", "near"])

    return reduced.mapInArrow(run, "code long, near long").join(reduced.select(F.col("code").alias("near")), "near")


def near_words(coded: DataFrame) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of words that differ by exactly
    one inserted, deleted or replaced code point."""
    left = coded.select("code", "word", "n")
    right = coded.select(F.col("code").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = links(coded).join(left, "code").join(right, "near")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def followed(forms: DataFrame) -> DataFrame:
    """word, root: from each word along ``form`` to the last, by pointer doubling."""
    at = saved(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = saved(at.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words and counts.

    A word's form is its most frequent near word (ties: the smallest) if it is
    at least ``ratio`` times as frequent; its root ends the chain of forms.
    """
    coded = saved(with_codes(words), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    found = near_words(coded).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    forms = coded.select("word", "n").join(found, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    forms = saved(forms.select("word", F.when(enough, F.col("best.word")).alias("form"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(enough, -F.col("best.less")).alias("form_n")), "near")
    return (forms.join(followed(forms), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
