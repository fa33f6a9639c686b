"""Registered queries and the pipeline at the smallest size."""

import corpus_pipeline
import __spark_entry__ as E
from prefloom.llm import pareto_mix
from prefloom.sources.tables import read_table
from tests.llm import test_bpe, test_dedup, test_pii, test_quality

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


def test_stages_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()}
        out = pareto_mix.saved(stage(spark, out, SF), "test-stage")
        rows = out.collect()
        if name != "encoded":
            assert out.columns == docs.columns
        if name == "quality":
            base = {i for i, r in before.items() if test_quality.by_hand(r.text)[-1]}
            assert not base & {r.doc_id for r in rows}
            assert len(rows) >= 0.75 * len(before)
        if name == "near_duplicates":
            hand = test_dedup.by_hand({i: r.text for i, r in before.items()}, 5)
            assert {r.doc_id for r in rows} == {i for i, (_, c) in hand.items() if i == c}
        if name == "personal_data":
            for r in rows:
                assert not any(test_pii.plain(r.text)[:1])
                if not any(test_pii.plain(before[r.doc_id].text)):
                    assert r == before[r.doc_id]
                assert r.n_chars == len(r.text)
        if name == "mixture":
            assert all(sum(x.doc_id == r.doc_id for x in rows) <= 2 for r in rows[:50])
            assert all(before[r.doc_id] == r for r in rows)
        if name == "encoded":
            assert len(rows) == n_mixed
            assert all(test_bpe.expected(before[r.doc_id].text) == list(memoryview(r.ids).cast("I")) for r in rows[:100])
        n_mixed = len(rows)


def test_rest_of_the_library_does_not_import_this():
    import pathlib
    import re

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("prefloom/**/*.py"), *root.glob("*.py")]:
        if "llm" not in path.parts and path.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert not re.search(r"\bllm\b", path.read_text()), path


