import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from prefloom.llm import ppm_langid as P
from prefloom.sources.tables import read_table
from tests.llm.conftest import PROSE


def by_hand(train: dict[str, list[str]], text: str) -> dict[str, float]:
    """Code lengths with dictionaries, byte by byte (method C escapes)."""
    out = {}
    for lang, texts in train.items():
        tree = defaultdict(Counter)
        for t in texts:
            raw = bytes(P.ORDER) + t.lower().encode()
            for i in range(P.ORDER, len(raw)):
                for k in range(P.ORDER + 1):
                    tree[raw[i - k:i]][raw[i]] += 1
        raw, bits = bytes(P.ORDER) + text.lower().encode(), 0.0
        for i in range(P.ORDER, len(raw)):
            for k in range(P.ORDER, -1, -1):
                seen = tree.get(raw[i - k:i])
                if seen is None:
                    continue
                total = sum(seen.values()) + len(seen)
                if raw[i] in seen:
                    bits -= math.log2(seen[raw[i]] / total)
                    break
                bits -= math.log2(len(seen) / total)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_are_exact(spark):
    train = {lang: [text, text[10:60]] for lang, text in PROSE.items()}
    rows = spark.createDataFrame([(t, lang) for lang, texts in train.items() for t in texts], "text string, lang string")
    trees = P.train(rows)
    asked = ["the house", "le chat du roi", "qéz 77 und", "ß", "zzzzzz the the"]
    for text, row in zip(asked, trees.lengths(asked)):
        hand = by_hand(train, text)
        assert np.allclose(row, [hand[x] for x in trees.langs], rtol=1e-5)


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = P.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_odd_rows(spark, docs, no_docs):
    out = P.identify(docs).toPandas()
    assert len(out) == docs.count()
    assert out.score.between(0, 1).all()
    by = {r.text: r.doc_id for r in docs.collect()}
    for text in (None, "", "12345 !!! ???"):
        row = out[out.doc_id == by[text]].iloc[0]
        assert (row.lang_pred, row.score) == ("und", 0.0)
    assert P.identify(no_docs).count() == 0
    assert set(P.identify(docs.where("lang is null")).toPandas().lang_pred) == {"und"}


def test_rare_language_keeps_its_tree(spark):
    """Two large languages with far more than 2^18 nodes, each seen more often than those of a rare one."""
    rng = np.random.default_rng(5)
    big = {lang: "".join(rng.choice(list(letters), 300_000)) for lang, letters in
           (("xx", "abcdefghijklmnop"), ("yy", "klmnopqrstuvwxyz"))}
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(big["xx"], "xx"), (big["yy"], "yy")] * 2 + [(PROSE["fr"], "rare")])]
    trees = P.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.langs == ["rare", "xx", "yy"]
    asked = ["le chat dans la maison du roi", big["xx"][:50], big["yy"][-50:]]
    assert trees.lengths(asked).argmin(axis=1).tolist() == [0, 1, 2]
    hand = by_hand({"rare": [PROSE["fr"]]}, asked[0])["rare"]
    assert np.isclose(trees.lengths(asked)[0][0], hand, rtol=1e-5)
