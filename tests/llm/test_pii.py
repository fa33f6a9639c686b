import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.llm import pii_disclosure as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The four patterns as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return [[m.span() for m in EMAIL.finditer(text)],
            [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))],
            [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and P.luhn(digits(m))],
            [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]]


@settings(max_examples=500, deadline=None)
@given(st.text("aZ.@-+%_ 0123456789()\n,é", max_size=80))
def test_spans_equal_the_plain_patterns(text):
    assert P.base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.d", "a@b", "@", ".x", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112",
                                 "+1 (578) 555-6437", "+12", " ", ",", "-", "x@y.z@w.v", "1.2.3.4.5.6.7.8"]), max_size=8))
def test_spans_of_near_misses(parts):
    assert P.base_spans("".join(parts)) == plain("".join(parts))


def test_very_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+" * 400_000, "a@" * 200_000, "1." * 200_000, "1-" * 200_000 + "x"):
        P.base_spans(text)


def test_disclosing_terms(spark, docs, no_docs):
    filler = ["river", "stone", "cloud", "paper", "light", "table", "green", "music"]
    rows = [(i, f"{filler[i % 8]} note {i} says that zorblax wrote from zed@corp.example.com about {filler[i % 5]}") for i in range(5)]
    rows += [(100 + i, f"note {i} says that {filler[i % 8]} wrote from {filler[(i + 3) % 8]} about the rest") for i in range(200)]
    rows += [(400, None), (401, ""), (402, "zorblax alone"), (403, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in P.personal_data(table).collect()}
    text = rows[0][1]
    at = text.index("zorblax")
    assert out[0].spans.split(",")[0].startswith("email:") and f"term:{at}:{at + 7}" in out[0].spans.split(",")
    assert out[0].n_term == 1 and out[403].spans == out[0].spans  # common words stay, copies agree
    assert all(r.spans == "" for i, r in out.items() if i >= 100 and i != 403)
    clean = {r.doc_id: r.text for r in P.redact(table).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "zed@" not in clean[0]
    assert clean[150] == dict(rows)[150] and clean[400] is None
    again = P.redact(docs)
    assert again.columns == docs.columns and again.count() == docs.count()
    assert P.personal_data(no_docs).count() == 0 and P.redact(no_docs).count() == 0


def test_overlapping_spans_are_one():
    assert P.redacted("call +1 578 555 6437 now", "card:6:20,phone:5:20") == "call [PHONE] now"


def marked_by_hand(texts):
    """doc -> spans that the method adds, by counting every word of every text."""
    import math

    found = {i: P.base_spans(t or "") for i, t in texts.items()}
    distinct = {t: i for i, t in sorted(texts.items(), reverse=True)}  # one document of each text
    holds, named = {}, {}
    for t, i in distinct.items():
        holds[t] = {t[a:b].lower() for a, b in P.free_words(t or "", found[i])} if t else set()
        named[t] = set(P.entities(t or "", found[i]))
    everywhere = {t: {m.lower() for m in re.findall(r"[^\W\d_]{3,}", t or "")} for t in distinct}
    n, risky = len(distinct), set()
    for e in set().union(*named.values()):
        mine = [t for t in distinct if e in named[t]]
        if len(mine) < P.SUPPORT or len(mine) == n:
            continue
        for w in set().union(*[holds[t] for t in mine]):
            both, all_ = sum(w in holds[t] for t in mine), sum(w in s for s in everywhere.values())
            if both >= P.SUPPORT and math.log(n * both / (all_ * len(mine))) / math.log(n / len(mine)) >= P.THRESHOLD - 1e-12:
                risky.add((e, w))
    return {i: [f"term:{a}:{b}" for a, b in P.free_words(t or "", found[i])
                if any((e, t[a:b].lower()) in risky for e in named[t])] for i, t in texts.items()}


def test_terms_equal_a_count_over_whole_texts(spark):
    """Names near and far from the mention, more than once in a text, and in texts without the entity."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "paper", "light") for b in ("bank", "wall", "mill", "yard", "gate", "lane")]
    texts = {}
    for i in range(300):
        w = rng.choices(words, k=rng.randint(5, 90))
        if i % 10 == 0:  # the name opens the text, the address is up to 90 words on; the name comes again at the end
            w = ["Zorblax"] + w + ["zed@corp.example.com"] + rng.choices(words, k=45) + ["zorblax", "said"]
        if i % 15 == 1:
            w = ["Quillon", *w, "10.1.2.3", "quillon"]
        if i % 60 == 2:
            w = ["Rare", "entity", f"r{i % 2}@x.org", *w]
        if i % 100 == 3:
            w += ["zorblax", "alone"]
        texts[i] = " ".join(w)
    texts |= {300: None, 301: "", 302: texts[0], 303: "İx " * 5 + "zed@corp.example.com Zorblax"}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = marked_by_hand(texts)
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term:")] for r in P.personal_data(table).collect()}
    assert got == want
    assert sum(len(x) >= 2 for x in want.values()) > 40 and not want[3]  # the last word of text 3 is "alone" without the address


def test_clashing_columns(spark):
    rows = [(i, f"call a{i}@b.org now", 1, "x", "y", "z") for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, text_hash int, _hash string, _spans string, spans string")
    out = P.redact(table)
    assert out.columns == table.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, "call [EMAIL] now", 1, "x", "y", "z") for i in range(4)]


def test_terms_are_counted_by_distinct_texts_and_summed_in_the_task(spark):
    texts = [f"alpha beta w{'abcdefghij'[i % 10] * 3} {'x' * 3 if i % 2 else 'yyy'} alpha {i}" for i in range(300)]
    texts += texts[:40] + texts[:7] + [None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    terms = spark.createDataFrame([("alpha",), ("xxx",), ("waaa",), ("absent",)], "term string")
    want = {"alpha": 300, "xxx": 150, "waaa": 30}
    assert {r.term: r.n_term for r in P.document_counts(rows, terms).collect()} == want
    table = rows.selectExpr("xxhash64(text) AS text_hash", "text")
    sent = P.term_rows(table, bytes([255]) * (P.BITMAP // 8), P.repeated(table))
    # 5 tasks send each of 14 words once; the 40 texts that come again send theirs with each copy
    assert sent.count() <= 5 * 14 + 87 * 4


def test_repeated_texts_are_in_the_bitmap(spark):
    hashes = [-1 << 63, -5, 9, 7, (1 << 63) - 1, (1 << 40) + 3]
    bits = P.repeated(spark.createDataFrame([(h,) for h in hashes + hashes[::2]], "text_hash long"))
    held = [bool(bits[h % P.COPIES >> 3] >> (h % P.COPIES & 7) & 1) for h in hashes]
    assert held == [i % 2 == 0 for i in range(6)] and len(bits) == P.COPIES // 8
