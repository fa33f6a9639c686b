import random
import re
from collections import defaultdict

from prefloom.llm import sparse_suffix as S


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
    return dict(out)


def by_hand(texts, length=S.LENGTH):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    seen = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - length + 1):
            seen[tuple(w[a:a + length])].add(i)
    out = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - length + 1):
            if len(seen[tuple(w[a:a + length])]) > 1:
                out[i] |= set(range(a, a + length))
    return dict(out)


def test_planted_passages_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 75, 160)]
    texts = {}
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if i % 2:
            p = rng.choice(passages)
            cut = rng.randint(0, 10) if i % 5 == 0 else 0
            own = own[:rng.randint(0, len(own))] + p[cut:] + own[rng.randint(0, len(own)):]
        texts[i] = " ".join(own)
    texts[60] = texts[1] + "\n" + texts[1]
    texts[61] = texts[4]
    texts[62] = " ".join(passages[4][:30] * 4)  # repeats within itself alone
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert covered(S.repeated_passages(rows).collect()) == by_hand(texts)


def test_odd_rows(spark, docs, no_docs):
    out = S.repeated_passages(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in out} == {12, 15}  # the equal prose; the very long text and self-repeating ones are clean
    assert all(r.end_word - r.start_word == len(texts[15].split()) for r in out)
    assert S.repeated_passages(no_docs).count() == 0


def test_passages_with_a_frequent_core_are_found(spark):
    """Each of 40 passages is in two texts; its last 35 words are also in many others, with other words around."""
    rng = random.Random(8)
    fresh = iter(range(10 ** 6))

    def own(n):
        return [f"u{next(fresh)}" for _ in range(n)]

    texts, n = {}, 0
    for _ in range(40):
        head, core = own(25), own(35)
        for _ in range(2):
            texts[n] = " ".join(own(rng.randint(0, 40)) + head + core + own(rng.randint(0, 40)))
            n += 1
        for _ in range(12):
            texts[n] = " ".join(own(rng.randint(30, 60)) + core + own(rng.randint(30, 60)))
            n += 1
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    hand = by_hand(texts)
    assert len(hand) == 80 and covered(S.repeated_passages(rows).collect()) == hand


def test_texts_that_repeat_themselves(spark):
    """Two texts of one short period, far longer than a task's step of rows, and a family of near copies."""
    rng = random.Random(5)
    period = " ".join(f"p{i}" for i in range(17))
    texts = {1: " ".join([period] * 600), 2: "start " + " ".join([period] * 500) + " end"}
    base = [f"b{i}" for i in range(400)]
    for i in range(3, 40):
        w = list(base)
        for _ in range(12):
            w[rng.randrange(400)] = f"x{rng.randrange(5)}"
        texts[i] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert covered(S.repeated_passages(rows).collect()) == by_hand(texts)
