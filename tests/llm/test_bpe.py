import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefloom.llm import bpe_lexicon as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = B.Codec(PATH)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'stre<|>endoftx \x1c "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_ids_equal_the_library_and_decode_back(texts):
    for text, ids in zip(texts, CODEC.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == expected(text)
        assert CODEC.decode(ids) == LIBRARY.decode(expected(text), skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=30))
def test_lexicon_holds_its_words_and_no_others(tmp_path_factory, words, others):
    entries = {w: np.frombuffer(w, np.uint8).astype(np.int32) for w in words}
    path = tmp_path_factory.mktemp("lexicon") / "a.bin"
    path.write_bytes(B.Lexicon.compile(entries))
    lexicon = B.Lexicon(str(path))
    asked = [*words, *others]
    for word, number in zip(asked, lexicon.find(asked) if asked else []):
        assert (number >= 0) == (word in words)
        if number >= 0:
            assert lexicon.ids[lexicon.start[number]:lexicon.start[number + 1]].tolist() == list(word)


def test_suffixes_are_shared(tmp_path):
    path = tmp_path / "a.bin"
    path.write_bytes(B.Lexicon.compile({p + b"ation": np.array([1]) for p in (b"n", b"st", b"rel", b"not")}))
    assert len(B.Lexicon(str(path)).final) < 12  # one chain for the common ending


def test_documents(spark, docs, no_docs):
    out = B.encode(docs, PATH, decoded=True).toPandas()
    texts = docs.toPandas()
    assert sorted(out["ids"].map(lambda x: hashlib.sha256(x).hexdigest())) == sorted(
        hashlib.sha256(np.array(expected(t), "<u4").tobytes()).hexdigest() for t in texts["text"])
    assert sorted(out["decoded"]) == sorted(t or "" for t in texts["text"])
    back = B.decode(B.encode(docs, PATH), PATH).toPandas()
    assert sorted(back["text"]) == sorted(out["decoded"])
    assert B.encode(no_docs, PATH).count() == 0


@pytest.mark.parametrize("text", ["ab" * 3000, "\U0001f600" * 500, "aaaa" * 777 + " " + "zq" * 10])
def test_long_words_merge_as_the_library_does(text):
    assert np.frombuffer(CODEC.encode([text])[0], "<u4").tolist() == expected(text)
