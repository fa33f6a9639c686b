"""The reference's five scripts as Spark jobs, with keyword arguments
instead of YAML configs.

* ``generate_preference_data`` - sources -> mix -> prompts -> N samples per
  problem -> score -> capped pairs -> table.
* ``generate_sft_data`` - the same without scoring: (problem, completion).
* ``evaluate_reward_model`` - pairs -> reward per side -> accuracy (+ running).
* ``select_active_data`` - pool -> window -> gaps -> weighted draw -> splits.
* ``reward_training_data`` - pairs -> nested subsets -> message lists.

Model output is written before it is used twice (a model call is not
repeated by plan rewrites or retries of later stages).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators import code_exec, evaluate, model, prompts, sampling, select
from prefloom.plans import preference
from prefloom.session import reliable_checkpoint, scratch_path
from prefloom.sources.tables import read_split, write_splits, write_table


def load_sources(spark: SparkSession, sources: Sequence[dict], max_examples: int | None, seed: int,
                 key_cols: Sequence[str] = ("problem_id",), strict: bool = True,
                 rekey: bool = True) -> DataFrame:
    """Read each ``{"path", "split", "ratio"}`` source, sample its share,
    concatenate (duplicates kept).

    Sources may reuse ids, so with ``rekey`` the ``problem_id`` becomes the
    text ``<source index>:<problem_id>`` (the source's own id is kept as
    ``source_problem_id``); later steps group by ``problem_id``. A source's
    index is its place in the list, so one path may be read with two splits.
    """
    parts = []
    for i, spec in enumerate(sources):
        df = read_split(spark, spec["path"], spec.get("split")).drop("split")
        parts.append((spec.get("name", spec["path"]), df.withColumn("_source", F.lit(i)), float(spec.get("ratio", 1.0))))
    mixed = sampling.mix_sources(parts, max_examples, seed, key_cols, strict=strict)
    if rekey and "problem_id" in key_cols:
        mixed = (mixed.withColumn("source_problem_id", F.col("problem_id"))
                 .withColumn("problem_id", F.concat_ws(":", "_source", "problem_id")))
    return mixed.drop("_source")


def generate_preference_data(spark: SparkSession, problems: DataFrame, domain: str,
                             make_generate_fn: Callable, num_samples: int, max_pairs: int, out: str,
                             batch_size: int = 64, template: str | None = None,
                             code_runner=None, completions_path: str | None = None,
                             num_partitions: int | None = None) -> DataFrame:
    """Preference pairs from problems (``problem_id`` plus the domain's
    columns: ``problem, solution`` or ``question, input_output,
    starter_code``). Code answers need ``code_runner`` (see
    ``code_exec.run_responses``). Writes ``out`` and returns it read back.
    Completions and run results are written once before they are reused, so
    neither the model nor a program runs twice."""
    if domain == "code" and code_runner is None:
        raise ValueError("code answers need a code_runner(code, fn_name, input) -> (output, ok, error)")
    rendered = prompts.render_problems(problems, domain, template)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    comp = model.generate(rendered.select("problem_id", "prompt"), make_generate_fn, num_samples, batch_size,
                          num_partitions=n)
    completions_path = completions_path or scratch_path(spark, "completions")
    write_table(comp.select("problem_id", "response_idx", "response"), completions_path)
    comp = spark.read.parquet(completions_path)
    probs = rendered.select("problem_id", "problem", "solution")
    if domain == "code":
        results = code_exec.run_responses(comp, probs.withColumnRenamed("solution", "input_output"), code_runner)
        results = reliable_checkpoint(results, "code-runs")
        pairs = preference.code_preference_data(comp, results, probs, max_pairs)
    else:
        scored = preference.score_responses(
            comp.join(probs.select("problem_id", F.col("solution").alias("answer")), "problem_id"), domain)
        pairs = preference.preference_data(scored, probs, max_pairs)
    write_table(preference.output_projection(pairs), out)
    return spark.read.parquet(out)


def generate_sft_data(spark: SparkSession, problems: DataFrame, domain: str, make_generate_fn: Callable,
                      num_samples: int, out: str, batch_size: int = 64,
                      num_partitions: int | None = None) -> DataFrame:
    rendered = prompts.render_problems(problems, domain)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    comp = model.generate(rendered.select("problem_id", "prompt"), make_generate_fn, num_samples, batch_size,
                          num_partitions=n)
    rows = preference.sft_data(rendered.select("problem_id", "problem"), comp)
    write_table(rows.select("problem_id", "response_idx", "problem", "completion"), out)
    return spark.read.parquet(out)


def evaluate_reward_model(spark: SparkSession, pairs: DataFrame, make_predict_fn: Callable,
                          batch_size: int = 8, max_tokens: int | None = None, seed: int = 42,
                          max_examples: int | None = None, running_every: int | None = None,
                          out: str | None = None, metrics: str | None = None):
    """Accuracy of a reward model on (problem, accepted, rejected) pairs.

    Rewards are written once; returns ``(accuracy, running)`` DataFrames
    (``running`` is None unless ``running_every``). With ``metrics`` both are
    written below that path, as tables ``accuracy`` and ``running``, and read back."""
    if max_examples is not None:
        pairs = sampling.take_sample(pairs, max_examples, seed, ["problem_id", "pair_rank"], strict=False)
    cp = preference.chat_pairs(pairs)
    cp = cp.select("problem_id", "pair_rank", prompts.chat_text("chosen").alias("chosen_text"),
                   prompts.chat_text("rejected_messages").alias("rejected_text"))
    scored = model.score_pair_sides(cp, make_predict_fn, batch_size=batch_size, max_tokens=max_tokens)
    out = out or scratch_path(spark, "rewards")
    write_table(scored.select("problem_id", "pair_rank", "r_accepted", "r_rejected"), out)
    scored = spark.read.parquet(out)
    acc = evaluate.pairwise_accuracy(scored)
    running = None
    if running_every:
        from prefloom.functions.hashing import shuffle_key
        keyed = scored.withColumn("_key", shuffle_key(seed, "problem_id", "pair_rank"))
        running = evaluate.running_accuracy(keyed, ["_key", "problem_id", "pair_rank"], batch_size,
                                            every=running_every)
    if metrics is not None:
        acc = spark.read.parquet(write_table(acc, f"{metrics}/accuracy"))
        running = None if running is None else spark.read.parquet(write_table(running, f"{metrics}/running"))
    return acc, running


def select_active_data(spark: SparkSession, dataset_path: str, initial: bool, score_pairs: Callable,
                       k: int, max_to_look_at: int, out: str, seed: int = 42, temp: float = 1.0,
                       keep_unseen: bool = False) -> str:
    """One selection round: pool split (``train`` if initial, else ``rest``),
    rewards of the window alone by ``score_pairs(df) -> df + r_accepted,
    r_rejected``, weighted draw, and ``train``/``rest`` written as splits of ``out``."""
    from prefloom.sources.tables import pool_split

    pool = read_split(spark, dataset_path, pool_split(initial)).drop("split")
    sel, rest = select.active_selection(pool, k, max_to_look_at, seed, ["problem_id", "pair_rank"], temp,
                                        keep_unseen=keep_unseen, score=score_pairs)
    cols = pool.columns
    write_splits({"train": sel.select(*cols), "rest": rest.select(*cols)}, out)
    return out


def reward_training_data(pairs: DataFrame, sizes: Sequence[int], seed: int = 42,
                         max_tokens: int | None = None) -> DataFrame:
    """Nested training subsets with message lists; ``where(subset_size <= n)``
    is the training set of size ``n``."""
    s = sampling.nested_subsets(pairs, sizes, seed, ["problem_id", "pair_rank"])
    if max_tokens is not None:
        s = evaluate.length_filter(s, max_tokens)
    return preference.chat_pairs(s)


def sft_training_text(rows: DataFrame, prefix: str = "<|im_start|>{role}\n",
                      suffix: str = "<|im_end|>\n") -> DataFrame:
    """(problem, completion) rows to one chat text each, with the model's
    role markers (the reference takes them from its tokenizer)."""
    msgs = F.array(prompts.message("user", "problem"), prompts.message("assistant", "completion"))
    return rows.withColumn("text", prompts.chat_text(msgs, prefix, suffix))


def split_dataset(spark: SparkSession, pairs: DataFrame, eval_share: float, seed: int, out: str,
                  key: str = "problem_id") -> str:
    """Write ``train`` and ``eval`` splits of a pair table, split by a hash
    of the problem so that no problem is on both sides (a row-local filter,
    no shuffle)."""
    from prefloom.plans.active import split_by_problem

    if not 0.0 <= eval_share <= 1.0:
        raise ValueError("eval_share must be in [0, 1]")
    train, held_out = split_by_problem(pairs, eval_share, seed, key)
    write_splits({"train": train, "eval": held_out}, out)
    return out
