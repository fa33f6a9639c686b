import random
import re
from collections import Counter

from prefloom.llm import quality_table as Q


def by_hand(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat),
            n < 50 or 100 * len(repeat) > 50 * n)


def test_counts(spark, docs, no_docs):
    rows = Q.judge(docs, keep=["doc_id", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == by_hand(r.text)
        assert not (r.kept and r.base_failed)
    assert Q.judge(no_docs).count() == 0


def test_stage_keeps_columns_and_whole_rows(spark, docs, no_docs):
    prose = " ".join(f"the {w} of" for w in map("word{}".format, range(60)))
    more = docs.union(docs.limit(1).selectExpr(
        "99L", f"'{prose}'", "'en'", "null", "1L", "null", "null", "null")).union(docs.limit(1).selectExpr(
            "98L", f"'{prose.replace(' ', '%%% ')}'", "'en'", "null", "1L", "null", "null", "null"))
    out = Q.accepted(more)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert 99 in kept and 98 not in kept and not kept & {0, 1, 2}
    assert Q.accepted(no_docs).count() == 0


def test_no_user_function(spark, docs):
    plan = Q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_languages_without_stop_words_are_judged_by_the_other_rules(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    english = " ".join(f"THE {w}" for w in text.split())
    rows = [(1, text, "pl"), (2, text, "en"), (3, text, None), (4, english, "en"), (5, english, None), (6, "!! " * 80, "pl"), (7, None, "pl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in Q.judge(df, keep=["doc_id"], lang="lang").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    assert {r.doc_id for r in Q.accepted(df).collect()} == {1, 4, 5} and Q.accepted(df).columns == df.columns
    assert {r.doc_id for r in Q.accepted(df.drop("lang")).collect()} == {4, 5}


def test_a_million_words(spark):
    """Windows of very long texts are confirmed on their words."""
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(10 ** 5)) for _ in range(10 ** 6)) + " a b c d a b c"
    df = spark.createDataFrame([(1, text), (2, "x y z " * 20)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.judge(df, keep=["doc_id"]).collect()}
    assert got == {1: by_hand(text)[4], 2: 60}
