import random
import re

import numpy as np

from prefloom.llm import fast_minhash as D


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def by_hand(texts, width=2, percent=80):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(n // 8)]
    texts = {}
    for i in range(n):
        w = list(rng.choice(bases[:1] if i % 3 == 0 else bases))
        for _ in range(rng.randint(0, max(1, len(w) // 9))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts[i * 3 + 1] = " ".join(x.upper() if rng.random() < 0.2 else x for x in w)
    return texts


def test_components_equal_brute_force(spark):
    texts = near_copies(240, 4) | {2: None, 5: "", 8: "one", 11: "One", 14: " \n"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(rows).collect()}
    assert got == by_hand(texts)


def test_family_of_mostly_unlinked_copies(spark):
    """Copies on both sides of the threshold, so that many pairs of a bucket stay in different components."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(2, 13)):
            w[k] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(w[rng.randint(0, 6):])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(rows).collect()}
    want = by_hand(texts)
    assert len({c for _, c in want.values()}) > 10
    assert got == want


def test_odd_rows(spark, docs, no_docs):
    out = D.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert {r.component_id for r in out if r.doc_id == 15} == {12}
    assert {r.component_id for r in out if r.doc_id in (0, 1, 2)} == {0, 1, 2}
    kept = D.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in kept.select("doc_id", "text").collect() if r.text)
    assert len(ids) == len(set(ids)) and (15, docs.where("doc_id = 15").first().text) not in ids
    assert D.near_duplicates(no_docs).count() == 0 and D.deduplicated(no_docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    for size, share in ((3, 1 / 3), (40, 0.5), (2000, 0.9)):
        a = np.unique(pool[:size])
        n = int(round(size * 2 * share / (1 + share)))
        b = np.unique(np.concatenate([a[:n], pool[-(size - n):] if size > n else a[:0]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = D.sketches([a, b])
        assert abs((s[0] == s[1]).mean() - true) < 0.17


def test_word_shingles_match_python():
    texts = ["", " a ", "A b  C\x0bd", "é É é É x", "a b a b a", "one"]
    for width in (1, 2, 5):
        sets = D.shingle_sets([t.encode() for t in texts], width)
        assert [len(s) for s in sets] == [len(shingles(t, width)) for t in texts]


def test_words_of_a_polynomial_collision_differ(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64, whatever the base and the codes."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    words, _ = D.word_hashes([morse.encode(), other.encode(), b"x " + morse.encode(), b"ab ba", b"Ab"])
    assert len(set(words.tolist())) == 5 and words[0] == words[3]
    assert not set(D.word_hashes([morse.encode()], seed=1 << 32)[0].tolist()) & set(words.tolist())
    texts = {1: f"{morse} one two", 2: f"{other} one two", 3: f"{morse.upper()} one two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(df).collect()}
    assert got == by_hand(texts) == {1: (2, 1), 2: (2, 2), 3: (2, 1)}


def test_a_member_is_compared_with_few_leads(spark):
    """A family of near copies shares its buckets in many ways; components still equal brute force."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(df).collect()} == by_hand(texts)


def test_bitmaps_never_understate_what_two_sets_share():
    rng = np.random.default_rng(5)
    pool = rng.integers(-1 << 63, (1 << 63) - 1, 400)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 7, 60, 180, 300)]
    marks = [[int(x) & (1 << 64) - 1 for x in row] for row in D.bitmaps(sets)]
    for x, mx in zip(sets, marks):
        for y, my in zip(sets, marks):
            alone = sum((a & ~b).bit_count() for a, b in zip(mx, my))
            assert len(x) - alone >= len(np.intersect1d(x, y))


def test_few_members_of_a_group_are_compared_across(spark, monkeypatch):
    """Copies that differ too much from each other are not confirmed on their texts one by one."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(60), 4 if i % 8 else 2):  # alone below the threshold from each other, near the base
            w[k] = rng.choice([f"n{i}x{k}", f"s{k}"])
        texts[i] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found, across = [], D.across_pairs

    def counted(*args):
        out = across(*args)
        found.append(out.select("a", "b").distinct().count())
        return out

    monkeypatch.setattr(D, "across_pairs", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in D.near_duplicates(rows).collect()}
    assert got == by_hand(texts)
    assert found[0] < 200  # 1,014 by the prefixes alone
