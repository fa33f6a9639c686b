"""Active-learning rounds: select uncertain pairs, train, evaluate, repeat.

Each round scores the pool with the current linear reward, draws ``k``
pairs weighted by ``exp(-gap)``, trains a Bradley-Terry model on the
selection, measures pairwise accuracy on a held-out set and writes
``train``/``rest`` as splits; the next round reads ``rest`` back, which
cuts the lineage at every round.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators import evaluate, model, select
from prefloom.session import scratch_path
from prefloom.sources.tables import read_split, write_metrics, write_splits, write_table


def score_pairs_linear(pairs: DataFrame, weights: Sequence[float], emb_accepted: str = "emb_accepted",
                       emb_rejected: str = "emb_rejected") -> DataFrame:
    return (pairs.withColumn("r_accepted", model.linear_reward(emb_accepted, weights))
                 .withColumn("r_rejected", model.linear_reward(emb_rejected, weights)))


#: A finished round: its model, what it trained on and left, and the parameters it ran with.
ROUND = "weights array<double>, n_train long, n_eval long, accuracy double, n_rest long, parameters string"


def finished_rounds(spark: SparkSession, out_root: str) -> list:
    """The manifest rows of the whole rounds written so far: 0 (pool and
    held-out pairs), 1, 2, ... without a gap. The driver reads a row a round."""
    try:
        rows = spark.read.schema(ROUND + ", round int").parquet(f"{out_root}/manifest").orderBy("round").collect()
    except AnalysisException:  # nothing written yet
        return []
    return [r for i, r in enumerate(rows) if r["round"] == i]


def active_rounds(spark: SparkSession, pool: DataFrame, eval_pairs: DataFrame, key_cols: Sequence[str],
                  initial_weights: Sequence[float], rounds: int = 3, k: int = 2500,
                  max_to_look_at: int = 40000, seed: int = 42, temp: float = 1.0,
                  accumulate: bool = False, out_root: str | None = None) -> DataFrame:
    """Run the rounds; returns one metrics row per round run.

    ``pool`` and ``eval_pairs`` carry ``emb_accepted``/``emb_rejected``.
    ``accumulate=False`` trains on this round's selection only, as the
    reference does; ``True`` trains on all selections so far. The rounds
    end early when the pool left holds fewer than ``k`` pairs (a single
    selection of more rows than it has is an error).

    A round ends by writing its row to ``out_root/manifest``. A loop that was
    killed goes on after its last whole round if it is called again with the
    same ``out_root`` and parameters: pool and held-out pairs are read from
    there, and a round cut short is written anew. Other parameters than those
    of the rounds found are an error.
    """
    out_root = (out_root or scratch_path(spark, "active")).rstrip("/")
    keys = list(key_cols)
    parameters = json.dumps({"k": k, "max_to_look_at": max_to_look_at, "seed": seed, "temp": temp, "accumulate": accumulate,
                             "keys": keys, "weights": [float(w) for w in initial_weights]})

    def finish(r: int, **values) -> None:
        write_metrics(spark, [{**values, "parameters": parameters}], f"{out_root}/manifest/round={r}", mode="overwrite", schema=ROUND)

    done = finished_rounds(spark, out_root)
    if any(d["parameters"] != parameters for d in done):
        raise ValueError(f"{out_root} holds rounds of other parameters")
    if not done:
        # both are read in several rounds: written once instead of recomputed
        write_table(pool, f"{out_root}/pool")
        write_table(eval_pairs, f"{out_root}/eval")
        finish(0, weights=[float(w) for w in initial_weights], n_train=0, n_eval=spark.read.parquet(f"{out_root}/eval").count(),
               accuracy=None, n_rest=spark.read.parquet(f"{out_root}/pool").count())
        done = finished_rounds(spark, out_root)
    eval_pairs = spark.read.parquet(f"{out_root}/eval")
    weights, left = list(done[-1]["weights"]), done[-1]["n_rest"]
    for r in range(len(done), rounds + 1):
        if left < k:
            break
        current = spark.read.parquet(f"{out_root}/pool") if r == 1 else read_split(spark, f"{out_root}/round={r - 1}", "rest").drop("split")
        selected, rest = select.active_selection(current, k, max_to_look_at, f"{seed}:{r}", keys, temp,
                                                 score=lambda w, by=tuple(weights): score_pairs_linear(w, by))
        cols = [c for c in current.columns]
        path = f"{out_root}/round={r}"
        write_splits({"train": selected.select(*cols), "rest": rest.select(*cols)}, path)
        train = read_split(spark, path, "train")
        if accumulate:
            for p in range(1, r):
                train = train.unionByName(read_split(spark, f"{out_root}/round={p}", "train"))
        weights = model.train_pairwise(train)
        acc = evaluate.pairwise_accuracy(score_pairs_linear(eval_pairs, weights)).first()
        left = read_split(spark, path, "rest").count()
        finish(r, weights=weights, n_train=int(train.count()), n_eval=int(acc["n_pairs"]),
               accuracy=None if acc["accuracy"] is None else float(acc["accuracy"]), n_rest=int(left))
    manifest = spark.read.schema(ROUND + ", round int").parquet(f"{out_root}/manifest")
    return manifest.where(F.col("round").between(1, rounds)).select("round", "n_train", "n_eval", "accuracy", "n_rest").orderBy("round")


def split_by_problem(pairs: DataFrame, eval_share: float, seed, key: str = "problem_id"):
    """Train/eval split by a hash of the problem, so no problem is on both sides."""
    from prefloom.functions.hashing import uniform

    u = uniform(f"{seed}:split", key)
    return pairs.where(u >= eval_share), pairs.where(u < eval_share)

