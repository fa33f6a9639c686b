"""Each registered query: its columns, and its digests against plain versions over the whole smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefloom.llm import pii_disclosure, queries
from prefloom.sources.tables import read_table
from tests.llm import test_dedup, test_pii, test_suffix

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe_lexicon": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_ppm_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_rans_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_rp_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_pareto_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_fast_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_html_ratio": "page_id bigint, url string, text string, n_chars bigint",
    "op9_pii_disclosure": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_quality_table": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                          "base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}


def run(spark, name):
    out = getattr(queries, name)(spark, SF)
    if name in COLUMNS:
        found = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema]
        assert found[:len(COLUMNS[name].split(", "))] == COLUMNS[name].split(", ")
    return out.collect()


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_op1(spark, texts):
    t = library("byte_bpe_50k.json")
    want = {}
    for i, x in texts.items():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:4] for r in run(spark, "op1_bpe_lexicon")} == want


def test_op2(spark, texts):
    rows = run(spark, "op2_ppm_langid")
    langs = {r.doc_id: r.lang for r in read_table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in texts}
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", texts[r.doc_id] or "")) for r in rows)
    asked = [r for r in rows if r.held_out and langs[r.doc_id] and len(texts[r.doc_id] or "") > 100]
    assert sum(r.lang_pred == langs[r.doc_id] for r in asked) >= 0.95 * len(asked)


def test_op3(spark, texts):
    assert test_suffix.covered(run(spark, "op3_sparse_suffix")) == test_suffix.by_hand(texts)


def test_op4(spark, texts):
    t, start, want = library("word_bpe_49k.json"), 0, {}
    for i in sorted(texts):
        ids = t.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:4] for r in run(spark, "op4_rans_output")} == want


def test_op5(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in read_table(spark, SF, "embeddings").collect()}
    usable = {i: v for i, v in table.items() if np.isfinite(v).all() and v.any()}
    got = {}
    for r in run(spark, "op5_rp_forest"):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in usable if i % 100 == 0):
        near = sorted((float(np.sqrt(((usable[q] - v) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, len(near) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(abs(s - np.sqrt(((usable[q] - usable[i]) ** 2).sum())) < 1e-9 for _, i, s in found)
        hits, total = hits + len({i for _, i in near} & {i for _, i, _ in found}), total + len(near)
    assert set(got) == {i for i in usable if i % 100 == 0} and hits >= 0.9 * total


def test_op6(spark, texts):
    rows = run(spark, "op6_pareto_mix")
    assert {r.doc_id: r.size for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}


def test_op7(spark, texts):
    hand = test_dedup.by_hand(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in run(spark, "op7_fast_minhash")} == {
        i: (n, c, i == c) for i, (n, c) in hand.items()}


def test_op8(spark):
    rows = run(spark, "op8_html_ratio")
    pages = {r.page_id: r for r in read_table(spark, SF, "pages").collect()}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert not re.search(r"[\t\r\f\v]|  |\n\n\n|(?<!\n)\n(?!\n)", r.text) and r.text == r.text.strip()


def test_op9(spark, texts):
    for r in run(spark, "op9_pii_disclosure"):
        found = test_pii.plain(texts[r.doc_id] or "")
        base = ",".join(f"{k}:{a}:{b}" for k, spans in zip(pii_disclosure.KINDS, found) for a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == base or r.spans.startswith(base + ",term:") or not base and r.spans.startswith("term:")


def test_op10(spark, texts):
    from tests.llm.test_quality import by_hand

    for r in run(spark, "op10_quality_table"):
        assert tuple(r)[1:7] == by_hand(texts[r.doc_id]) and not (r.kept and r.base_failed)
