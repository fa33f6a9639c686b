import numpy as np
import pytest

from prefloom.llm import rp_forest as A

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def by_hand(vecs, asked, k=10):
    ids = np.array(sorted(vecs))
    m = np.stack([np.array(vecs[i], float) for i in ids])
    out = {}
    for q in asked:
        d = np.sqrt(((m - np.array(vecs[q], float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 2
    vecs = {i: (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist() for i in range(2400)}
    same = rng.normal(size=16).astype(np.float32).tolist()
    return vecs | {i: same for i in range(0, 2400, 3)}  # a third share one vector


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_all_leaves_give_brute_force(spark, vectors):
    rows = [(i, v, "x", 1) for i, v in vectors.items()]
    rows += [(9000, None, "x", 1), (9100, [0.0] * 16, "x", 1), (9200, [None] + [1.0] * 15, "x", 1),
             (9300, [float("nan")] + [1.0] * 15, "x", 1), (9400, [1.0, 2.0], "x", 1), (None, [1.0] * 16, "x", 1), rows[100]]
    got = result(A.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), "vec_id % 100 = 0", share=99.0))
    hand = by_hand(vectors, [i for i in vectors if i % 100 == 0])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in hand.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in hand[q]], rtol=1e-12, atol=1e-12) for q in hand)


def test_recall_of_the_default_search(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vecs = {r.vec_id: r.embedding for r in table.collect()}
    asked = [i for i in vecs if i % 100 == 0]
    got, hand = result(A.neighbours(table, "vec_id % 100 = 0", search=0)), by_hand(vecs, asked)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in hand[q]}) for q in asked)
    assert hits >= 0.9 * sum(len(x) for x in hand.values())


def test_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "", 0), (1, [0.0, 1.0], "", 0), (100, [1.0, 1.0], "", 0)], SCHEMA)
    assert result(A.neighbours(few, "vec_id % 100 = 0")) == {0: [(100, 1.0), (1, 2 ** 0.5)], 100: [(0, 1.0), (1, 1.0)]}
    assert A.neighbours(few.where("false"), "vec_id % 100 = 0").count() == 0
