import random
import re
import zlib
from collections import Counter

import pytest

from prefloom.llm import queries
from prefloom.llm import spelling_variants as V

COLUMNS = [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def counted(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    """Every pair of words compared (of close lengths)."""
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == COLUMNS
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def edits(word, signs):
    out = {word} | {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + s + word[i + 1:] for i in range(len(word)) for s in signs}
    return out | {word[:i] + s + word[i:] for i in range(len(word) + 1) for s in signs}


@pytest.mark.parametrize("word", ["a", "aaaa", "abcab", "éßñaz÷", "zzzyyzzz"])
def test_neighbourhood_is_that_of_the_reduced_word(word, monkeypatch):
    digits = tuple(V.symbols([word])[0].tolist())

    def number(d):
        return sum(x * (V.SYMBOLS + 1) ** i for i, x in enumerate(d)) % 2 ** 64

    want = {digits} | {digits[:i] + digits[i + 1:] for i in range(len(digits))}
    for s in range(1, V.SYMBOLS + 1):
        want |= {digits[:i] + (s,) + digits[i + 1:] for i in range(len(digits))}
        want |= {digits[:i] + (s,) + digits[i:] for i in range(len(digits) + 1)}
    rows, near = V.neighbourhood(["xyz", word, "q"])
    mine = near[rows == 1].tolist()
    assert len(mine) == len(set(mine)) and set(mine) == set(map(number, want))
    assert V.codes(["xyz", word])[1] == number(digits)
    other = V.codes(sorted(edits(word, "abzé")))
    assert set(other.tolist()) <= set(mine)  # one edit of the word is at most one of its reduced word


def test_words_against_brute_force(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(60):
        base = "".join(rng.choices("abcdeé", k=rng.choice([6, 7, 8, 25, 30])))
        words[base] = 5 ** rng.randint(1, 6) * rng.randint(1, 3)
        for v in rng.sample(sorted(edits(base, "abxyzßÿ")), 12):
            words.setdefault(v, 5 ** rng.randint(1, 5) * rng.randint(1, 3))
            for u in rng.sample(sorted(edits(v, "abk")), 4):
                words.setdefault(u, 5 ** rng.randint(1, 3))
    words |= {"x" * 5000: 100, "x" * 4999: 5, "x" * 5000 + "y": 7, "x" * 5001: 500, "tiesab": 5, "tiesabc": 25, "tiesaba": 25}
    words |= {f"abcdefgh{'i' * k}": 5 * 5 ** k for k in range(9)}  # a chain of forms
    words = {w: n for w, n in words.items() if len(w) > 5}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert got(V.group_variants(df)) == brute(words)


def test_query_on_odd_rows(spark, docs, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["Receive", "recieve", "RECEIVE", "receives", "ÀÉreceive", "× ", "÷sevenß", "colour", "color "], k=40)) for _ in range(3)]
    rows = [(i % 7 if i % 7 else None, " ".join(rng.choices(["Receive", "recieve", "RECEIVE", "receives", "reeceive", "Éclairs", "éclairs",
                                                             "a1sevens", "naïveté", "İstanbul", "x" * 300, "short"], k=30)))
            for i in range(60)] + [(1, t) for t in texts] + [(2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' AS word", "1 AS n", "2 AS code")
    df.unionByName(docs.selectExpr("doc_id", "text", "'w' AS word", "1 AS n", "2 AS code")).write.parquet(f"{tmp_path}/documents.parquet")
    all_rows = rows + [(r.doc_id, r.text) for r in docs.collect()]
    assert got(queries.op13_spelling_variants(spark, str(tmp_path))) == brute(counted(all_rows))
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert got(queries.op13_spelling_variants(spark, f"{tmp_path}/none")) == []


def test_test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got(queries.op13_spelling_variants(spark, sf)) == brute(counted([(r.doc_id, r.text) for r in docs]))
