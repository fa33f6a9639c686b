import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prefloom.llm import queries
from prefloom.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTS = T.Counts(PATH)
SIGNS = st.one_of(st.sampled_from(" \n\t'stre<|>endoftx \x1c "), st.characters(exclude_categories=["Cs"]))


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(SIGNS, max_size=40), st.text("ab \n", max_size=60)), max_size=6))
def test_counts_equal_the_library(texts):
    assert COUNTS.count(texts) == [expected(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aabcthein é\U0001f600"), min_size=1, max_size=200))
def test_a_pre_token_alone_counts_as_in_a_batch(text):
    words = [w.encode() for w in T._PRETOKENS.findall(text)]
    assert [T.count_long(w, COUNTS.merges) if len(w) > 1 else 1 for w in words] == T.count_ragged(words, COUNTS.merges).tolist()


@pytest.mark.parametrize("word", ["ab" * 9000, "x" * 20_001, "\U0001f600" * 3000, "tionationsthe" * 700, "=" * 5000 + "-" * 4999, "y" * 2049])
def test_long_pre_tokens(word):
    assert COUNTS.count([word, f"a {word} b\n{word}", "a"]) == [expected(word), expected(f"a {word} b\n{word}"), 1]


def test_slices_and_small_memo(monkeypatch):
    monkeypatch.setattr(T, "MEMO", 5)
    text = " the  cat\n\nsat;  on\t\tmats, über 12 'll <|endoftext|> z" * 40
    for most in (1, 2, 7, 50):
        assert "".join(T.slices(text, most)) == text
        monkeypatch.setattr(T, "SLICE", most)
        assert sum(COUNTS.count(list(T.slices(text.replace("<|endoftext|>", ""), most)))) == expected(text.replace("<|endoftext|>", ""))
        assert COUNTS.count([text, None, text]) == [expected(text), 0, expected(text)]


def test_query(spark, docs, no_docs, tmp_path):
    docs.withColumnsRenamed({"score": "n_tokens"}).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op12_token_counts(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    want = [(r.doc_id, len((r.text or "").encode()), expected(r.text), expected(r.text) > 1024) for r in docs.collect()]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert T.count_tokens(no_docs, PATH).count() == 0


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: expected(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, "/root/testdata/sf0.01").collect()} == want
