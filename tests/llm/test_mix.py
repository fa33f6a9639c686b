import re
from collections import defaultdict

import duckdb

from prefloom.llm import pareto_mix as M
from prefloom.sources.tables import read_table


def targets_by_hand(sizes):
    """Water filling in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % len(M.WEIGHTS)] for i, s in enumerate(names)}
    total, full = M.SHARE * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        out = {s: 2.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_and_words(spark, docs, no_docs):
    for table in (docs, read_table(spark, "/root/testdata/sf0.001", "documents")):
        rows = M.plan_mix(table).collect()
        assert len(rows) == table.count()
        sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in table.collect())
        hand = targets_by_hand(sizes)
        for s in sizes:
            assert abs(target[s] - hand[s]) <= 1e-6 * max(1, hand[s])
            assert abs(taken[s] - target[s]) <= largest[s]
    assert M.plan_mix(no_docs).count() == 0


def test_reruns_agree_and_rows_are_repeated(spark, docs):
    plan = sorted(map(tuple, M.plan_mix(docs).collect()), key=str)
    assert plan == sorted(map(tuple, M.plan_mix(docs.repartition(7)).collect()), key=str)
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken_copies for r in M.plan_mix(docs).collect())
    assert M.mix(docs.where("false")).count() == 0


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is taken as often as its expected copies say."""
    rows = spark.createDataFrame([(i, "w " * 20, "s" if i % 2 else None) for i in range(60)], "doc_id long, text string, source string")
    sized = M.saved(M.sizes(rows), "sizes")
    targets = M.source_targets(sized)
    n = defaultdict(int)
    for seed in range(12):
        for r in M.take(sized, M.pareto_cuts(sized, targets, seed), seed).collect():
            n[r.source, r.doc_id] += r.taken_copies
    share = {r.source: r.target / r.source_size for r in targets.collect()}
    for s in share:
        counts = [v for (x, _), v in n.items() if x == s]
        assert abs(sum(counts) / len(counts) / 12 - share[s]) < 0.05
        assert len(set(counts)) > 1 or share[s] == int(share[s])


def test_repeated_rows_are_taken_one_by_one(spark, tmp_path):
    """Forty equal rows of a source whose target lies between two of them; the SQL agrees."""
    from prefloom.llm import oracle, queries

    rows = [(7, "w " * 100, "a", i) for i in range(40)] + [(8, "v " * 10, "b", 1)] * 3 + [(None, "u u", None, 2)] * 2 + [
        (i, f"x{i} " * (i % 9), "b", i) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rep int")
    plan = M.plan_mix(df).collect()
    for s in ("a", "b"):
        taken, target = sum(r.taken for r in plan if r.source == s), next(r.target for r in plan if r.source == s)
        assert abs(taken - target) <= max(r.size for r in plan if r.source == s)
    assert len({r.taken_copies for r in plan if r.source == "a"}) > 1 or target % 100 == 0
    mixed = M.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.taken_copies for r in plan)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_pareto_mix(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(oracle.MIX).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
