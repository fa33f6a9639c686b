"""Registered queries on the test tables: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the whole given tables (or data Spark derives from them);
limits appear only where sampling is the operator. Parameters follow the
reference's configurations where they exist (cap 4 for math, 16 for code,
1,024-token training limit, batch size 8, seed 42).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import scoring, text
from prefloom.functions.hashing import shuffle_key
from prefloom.operators import code_exec, evaluate, model, pairs, prompts, sampling, select
from prefloom.plans import preference
from prefloom.session import reliable_checkpoint
from prefloom.sources import testdata
from prefloom.sources.tables import read_table

SEED = 42
MATH_CAP = 4
CODE_CAP = 16
MAX_TOKENS = 1024
EVAL_BATCH = 8
CUT_TOKENS = 64
TOKEN_BUDGET = 4096
# Sizes of samples follow the tables: one row in so many.
SELECT_WINDOW = 2
SELECT_K = 16
MIX_EXAMPLES = 4
SUBSETS = (8, 4, 2)
SOURCE_RATIOS = (1.0, 0.5, 0.25)  # of the sources in order of their names, repeating
FAN_OUT = 4
REWARD_MODELS = {"lin3": 3, "lin5": 5}


# -- shared derived inputs --------------------------------------------------------

def _pairs8(spark, sf):
    return pairs.preference_pairs(testdata.candidates(spark, sf, 8), MATH_CAP)


def _pairs8_text(spark, sf):
    c = testdata.candidates(spark, sf, 8)
    return preference.preference_data(c, testdata.problems(spark, sf, 8), MATH_CAP)


def rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Two linear reward models over the embedding table."""
    emb = testdata.embeddings(spark, sf)
    parts = [emb.select(F.lit(name).alias("model"), "vec_id",
                        model.linear_reward("embedding", model.rule_weights(64, m)).alias("reward"))
             for name, m in REWARD_MODELS.items()]
    return parts[0].unionByName(parts[1])


def scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Capped label pairs scored by each reward model, with the problem's language.

    Each pair is repeated per model name (a literal list) so that both reward
    joins use the key (model, vec_id) against the same relation: the rewards
    are shuffled once and the second join reuses the exchange.
    """
    p = _pairs8(spark, sf)
    vec = testdata.doc_vec_id
    p = (p.withColumn("_da", F.col("problem_id") * 8 + F.col("accepted_idx"))
          .withColumn("_dr", F.col("problem_id") * 8 + F.col("rejected_idx")))
    p = p.withColumn("vec_accepted", vec(spark, sf, "_da")).withColumn("vec_rejected", vec(spark, sf, "_dr"))
    p = p.withColumn("model", F.explode(F.array(*[F.lit(m) for m in REWARD_MODELS])))
    rw = rewards(spark, sf)
    for side, name in (("vec_accepted", "r_accepted"), ("vec_rejected", "r_rejected")):
        p = (p.withColumnRenamed(side, "vec_id").join(rw, ["model", "vec_id"])
              .withColumnRenamed("vec_id", side).withColumnRenamed("reward", name))
    dom = testdata.problems(spark, sf, 8).select("problem_id", F.col("lang").alias("domain"))
    return p.join(dom, "problem_id").drop("_da", "_dr")


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# -- preference pairs -------------------------------------------------------------------

def q_preference_pairs(spark, sf):
    out = _pairs8_text(spark, sf)
    return out.select("problem_id", "pair_rank", "i", "j", "accepted_idx", "rejected_idx",
                      "accepted_score", "rejected_score", "problem", "accepted", "rejected")


def q_preference_pairs_math(spark, sf):
    scored = preference.score_responses(testdata.math_candidates(spark, sf), "math")
    out = preference.preference_data(scored, testdata.problems(spark, sf, 8), MATH_CAP)
    return out.select("problem_id", "pair_rank", "accepted_idx", "rejected_idx", "accepted_score",
                      "rejected_score", "problem", "accepted", "rejected")


def q_preference_pairs_medical(spark, sf):
    scored = preference.score_responses(testdata.choice_candidates(spark, sf), "medical")
    out = preference.preference_data(scored, testdata.problems(spark, sf, 8), MATH_CAP)
    return out.select("problem_id", "pair_rank", "accepted_idx", "rejected_idx", "accepted_score",
                      "rejected_score", "accepted", "rejected")


def q_preference_pairs_code(spark, sf):
    out = preference.code_preference_data(testdata.code_candidates(spark, sf), testdata.code_results(spark, sf),
                                          testdata.problems(spark, sf, 16), CODE_CAP)
    return out.select("problem_id", "pair_rank", "accepted_idx", "rejected_idx", "accepted_score",
                      "rejected_score", "problem", "accepted", "rejected")


def q_pair_count_by_problem(spark, sf):
    return pairs.pair_counts(testdata.candidates(spark, sf, 8), MATH_CAP)


def q_pair_count_by_problem16(spark, sf):
    """Groups of 16 with five score levels, capped at the code cap."""
    return pairs.pair_counts(testdata.candidates16(spark, sf), CODE_CAP)


# -- sampling ---------------------------------------------------------------------------

def q_mix_sources_by_ratio(spark, sf):
    """A quarter as many documents as there are, from all sources."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_name"))
    sizes = docs.where("source_name IS NOT NULL").groupBy("source_name").count().collect()  # a row for each source
    names = sorted(r[0] for r in sizes)
    ratios = {n: SOURCE_RATIOS[i % len(SOURCE_RATIOS)] for i, n in enumerate(names)}
    mixed = sampling.mix_by_source(docs, ratios, sum(r["count"] for r in sizes) // MIX_EXAMPLES, SEED, ["doc_id"], strict=False)
    return mixed.select("source_name", "doc_id", F.col("sample_rank").cast("int").alias("sample_rank"))


def q_nested_subsets(spark, sf):
    p = reliable_checkpoint(_pairs8(spark, sf).select("problem_id", "pair_rank"))
    n = p.count()
    s = sampling.nested_subsets(p, [n // part for part in SUBSETS], SEED, ["problem_id", "pair_rank"])
    return s.select("problem_id", "pair_rank", F.col("subset_rank").cast("int").alias("subset_rank"),
                    "subset_size")


# -- prompts, messages, SFT ------------------------------------------------------------------

def q_render_prompt_math(spark, sf):
    p = testdata.statements(spark, sf)
    return p.select("problem_id", prompts.render_prompt("problem", prompts.MATH_TEMPLATE).alias("prompt"))


def _code_statements(spark, sf):
    return testdata.code_problems(spark, sf, testdata.statements(spark, sf))


def q_render_prompt_code(spark, sf):
    r = prompts.render_problems(_code_statements(spark, sf), "code")
    return r.select("problem_id", "prompt")


def q_user_messages(spark, sf):
    """The message list of each code prompt, flattened to role and content."""
    r = prompts.render_problems(_code_statements(spark, sf), "code").select("problem_id", F.explode("messages").alias("m"))
    return r.select("problem_id", "m.role", "m.content")


def q_chat_pair_messages(spark, sf):
    cp = preference.chat_pairs(_pairs8_text(spark, sf))

    def flat(c):
        return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")

    return cp.select("problem_id", "pair_rank", flat(F.col("chosen")).alias("chosen_text"),
                     flat(F.col("rejected_messages")).alias("rejected_text"))


def q_sft_pairs(spark, sf):
    return testdata.sft_source(spark, sf).select("conv_id", "turn", "problem", "completion")


def q_sft_text(spark, sf):
    s = testdata.sft_source(spark, sf)
    msgs = F.array(prompts.message("user", "problem"), prompts.message("assistant", "completion"))
    return s.select("conv_id", "turn", prompts.chat_text(msgs).alias("text"))


def q_sft_rows(spark, sf):
    """A row for each response with its problem, through the SFT operator."""
    rows = preference.sft_data(testdata.problems(spark, sf, 8), testdata.responses(spark, sf, 8)
                               .select("problem_id", "response_idx", "response"))
    return rows.select("problem_id", "response_idx", "problem", "completion")


def q_fan_out_samples(spark, sf):
    p = testdata.statements(spark, sf)
    r = p.select("problem_id", prompts.render_prompt("problem", prompts.MATH_TEMPLATE).alias("prompt"))
    return prompts.fan_out(r, FAN_OUT).select("problem_id", "sample_idx", "prompt")


# -- extraction and scoring ------------------------------------------------------------------

def q_extract_boxed(spark, sf):
    m = testdata.math_candidates(spark, sf)
    return m.select("problem_id", "response_idx", text.extract_boxed("response").alias("core"))


def q_extract_boxed_balanced(spark, sf):
    m = testdata.math_candidates(spark, sf)
    return m.select("problem_id", "response_idx", text.extract_boxed("response", "balanced").alias("core"))


def q_math_score(spark, sf):
    m = testdata.math_candidates(spark, sf)
    return m.select("problem_id", "response_idx", scoring.math_score("response", "answer").alias("correct"))


def q_math_score_rational(spark, sf):
    m = testdata.math_candidates(spark, sf)
    return m.select("problem_id", "response_idx",
                    scoring.math_score("response", "answer", mode="balanced").alias("correct"))


def q_medical_score(spark, sf):
    m = testdata.choice_candidates(spark, sf)
    return m.select("problem_id", "response_idx",
                    scoring.choice_score("response", "answer").alias("score"),
                    scoring.choice_score("response", "answer", only_perfect_match=True).alias("perfect"))


def q_extract_code(spark, sf):
    c = testdata.code_candidates(spark, sf)
    return c.select("problem_id", "response_idx", text.extract_code("response").alias("code"))


def q_forbidden_code(spark, sf):
    c = testdata.code_candidates(spark, sf)
    return c.select("problem_id", "response_idx",
                    code_exec.is_forbidden(text.extract_code("response")).alias("forbidden"))


def q_testcase_explode(spark, sf):
    return code_exec.explode_testcases(_code_statements(spark, sf))


def q_code_pass_count(spark, sf):
    counts = code_exec.pass_counts(testdata.code_results(spark, sf))
    scored = code_exec.code_scores(testdata.code_candidates(spark, sf), counts, keep_counts=True)
    return scored.select("problem_id", "response_idx", "n_cases", "n_passed", "score")


def echo_runner(code, fn_name, inp):
    """A stand-in for a program runner: the input with underscores; inputs
    whose length is a multiple of 7 fail."""
    return inp.replace(" ", "_"), len(inp) % 7 != 0, "" if len(inp) % 7 else "ValueError: seven"


def q_code_run_responses(spark, sf):
    """All responses run on their problem's cases by the stand-in runner."""
    results = code_exec.run_responses(testdata.code_candidates(spark, sf), testdata.code_problems(spark, sf), echo_runner)
    return code_exec.pass_counts(results).select("problem_id", "response_idx", "n_cases", "n_passed", "score")


def q_failure_reasons(spark, sf):
    return code_exec.failure_reasons(testdata.code_results(spark, sf))


# -- evaluation ---------------------------------------------------------------------------

def q_length_filter(spark, sf):
    kept = evaluate.length_filter_narrow(_pairs8(spark, sf), testdata.responses(spark, sf, 8),
                                         testdata.problems(spark, sf, 8), MAX_TOKENS)
    return kept.select("problem_id", "pair_rank")


def q_reward_score_linear(spark, sf):
    return rewards(spark, sf).select("model", "vec_id", _r6("reward"))


def q_pair_gap(spark, sf):
    sp = select.with_gap(scored_pairs(spark, sf))
    return sp.select("model", "problem_id", "pair_rank", _r6("r_accepted"), _r6("r_rejected"), _r6("gap"))


def q_pairwise_accuracy(spark, sf):
    acc = evaluate.pairwise_accuracy(scored_pairs(spark, sf), ["model"])
    return acc.select("model", "n_pairs", "n_correct", "n_ties", _r6("accuracy"))


def q_running_accuracy(spark, sf):
    return _running(spark, sf, 1)


def q_running_accuracy_every10(spark, sf):
    """As the evaluation loop logs it: every 10th batch and the last."""
    return _running(spark, sf, 10)


def _ordered_pairs(spark, sf):
    """Scored pairs of all models with the seeded order of the evaluation."""
    sp = reliable_checkpoint(scored_pairs(spark, sf).select("model", "problem_id", "pair_rank", "r_accepted", "r_rejected"))
    return sp.withColumn("_key", shuffle_key(SEED, "problem_id", "pair_rank"))


def _running(spark, sf, every):
    out = evaluate.running_accuracy(_ordered_pairs(spark, sf), ["_key", "problem_id", "pair_rank"], EVAL_BATCH, every=every,
                                    group_cols=["model"])
    return out.select("model", "batch_id", "seen", "correct", _r6("accuracy"))


def q_eval_matrix(spark, sf):
    m = evaluate.accuracy_cells(scored_pairs(spark, sf), "model", "domain")
    return m.select("model", "domain", "n_pairs", _r6("accuracy"))


def _selection(spark, sf, part, keep_unseen=False):
    """Part 0 (selected) or 1 (rest) of each reward model's selection."""
    pool = reliable_checkpoint(scored_pairs(spark, sf).select("model", "problem_id", "pair_rank", "r_accepted", "r_rejected"))
    sizes = {r["model"]: r["count"] for r in pool.groupBy("model").count().collect()}
    return reduce(DataFrame.unionByName, [
        select.active_selection(pool.where(F.col("model") == m).drop("model"), sizes.get(m, 0) // SELECT_K, sizes.get(m, 0) // SELECT_WINDOW,
                                SEED, ["problem_id", "pair_rank"], keep_unseen=keep_unseen)[part].withColumn("model", F.lit(m))
        for m in REWARD_MODELS])


def q_active_selected(spark, sf):
    return _selection(spark, sf, 0).select("model", "problem_id", "pair_rank",
                                           F.col("select_rank").cast("int").alias("select_rank"), _r6("gap"))


def q_active_rest(spark, sf):
    return _selection(spark, sf, 1).select("model", "problem_id", "pair_rank", _r6("gap"))


def q_resume_pending(spark, sf):
    from prefloom.streaming.incremental import pending_problems

    p = testdata.problems(spark, sf, 8).select("problem_id")
    return pending_problems(p, read_table(spark, sf, "labels").select(F.expr("doc_id div 8").alias("problem_id")))



def q_extract_boxed_last(spark, sf):
    m = testdata.choice_candidates(spark, sf)
    both = m.withColumn("response", F.concat(F.lit("First \\boxed{0} then "), F.col("response")))
    return both.select("problem_id", "response_idx", text.extract_boxed("response", which="last").alias("core"))


def q_medical_score_trim(spark, sf):
    m = testdata.choice_candidates(spark, sf, spaced=True)
    return m.select("problem_id", "response_idx",
                    scoring.choice_score("response", "answer", trim=True).alias("score"))


def q_code_pass_count_partial(spark, sf):
    counts = code_exec.pass_counts(testdata.code_results(spark, sf), on_error="count_passed")
    scored = code_exec.code_scores(testdata.code_candidates(spark, sf), counts)
    return scored.select("problem_id", "response_idx", "score")


def q_active_rest_keep_unseen(spark, sf):
    return _selection(spark, sf, 1, keep_unseen=True).select("model", "problem_id", "pair_rank", _r6("gap"))


def q_eval_batches(spark, sf):
    b = sampling.batch_ids(_ordered_pairs(spark, sf), ["_key", "problem_id", "pair_rank"], EVAL_BATCH, ["model"])
    return b.select("model", "problem_id", "pair_rank", "batch_id")


def q_last_line_int(spark, sf):
    """Whole texts that end in a line of 0 to 44 digits."""
    r = testdata.responses(spark, sf, 8)
    t = F.concat("response", F.lit("\n "), F.expr("repeat('7', cast(n_chars % 45 as int))"), F.lit(" "))
    return r.select("problem_id", "response_idx", text.last_line_int(t).alias("value"))


def q_truncate_tokens(spark, sf):
    """The first tokens of each text, as the single-pair evaluation cuts them."""
    r = testdata.responses(spark, sf, 8)
    return r.select("problem_id", "response_idx", evaluate.truncate_tokens("response", 64).alias("cut"))


def q_output_projection(spark, sf):
    return preference.output_projection(preference.chat_pairs(_pairs8_text(spark, sf)))


def q_tables_round_trip(spark, sf):
    """Scored pairs written as two splits, read back by split, and as CSV."""
    from prefloom.plans.active import split_by_problem
    from prefloom.session import scratch_path
    from prefloom.sources import tables

    p = _pairs8(spark, sf)
    rest, train = split_by_problem(p, 0.25, SEED)
    out = scratch_path(spark, "splits")
    tables.write_splits({"train": train, "rest": rest}, out)
    back = [tables.read_split(spark, out, tables.pool_split(first)).withColumn("split", F.lit(tables.pool_split(first)))
            for first in (True, False)]
    both = back[0].unionByName(back[1]).select("split", "problem_id", "pair_rank", "accepted_idx", "rejected_idx")
    csv = scratch_path(spark, "csv")
    tables.write_table(both, csv, fmt="csv")
    return spark.read.csv(csv, header=True, schema=both.schema)


def q_strict_sample(spark, sf):
    """A quarter of all documents by a strict sample (an error if there were fewer)."""
    d = read_table(spark, sf, "documents").select("doc_id")
    s = sampling.take_sample(d, d.count() // 4, SEED, ["doc_id"], strict=True, rank_name="sample_rank")
    return s.select("doc_id", "sample_rank")


QUERIES = {
    "preference_pairs": q_preference_pairs,
    "preference_pairs_math": q_preference_pairs_math,
    "preference_pairs_medical": q_preference_pairs_medical,
    "preference_pairs_code": q_preference_pairs_code,
    "pair_count_by_problem": q_pair_count_by_problem,
    "pair_count_by_problem16": q_pair_count_by_problem16,
    "mix_sources_by_ratio": q_mix_sources_by_ratio,
    "nested_subsets": q_nested_subsets,
    "render_prompt_math": q_render_prompt_math,
    "render_prompt_code": q_render_prompt_code,
    "chat_pair_messages": q_chat_pair_messages,
    "sft_pairs": q_sft_pairs,
    "sft_text": q_sft_text,
    "fan_out_samples": q_fan_out_samples,
    "extract_boxed": q_extract_boxed,
    "extract_boxed_balanced": q_extract_boxed_balanced,
    "math_score": q_math_score,
    "math_score_rational": q_math_score_rational,
    "medical_score": q_medical_score,
    "extract_code": q_extract_code,
    "forbidden_code": q_forbidden_code,
    "testcase_explode": q_testcase_explode,
    "code_pass_count": q_code_pass_count,
    "failure_reasons": q_failure_reasons,
    "length_filter": q_length_filter,
    "reward_score_linear": q_reward_score_linear,
    "pair_gap": q_pair_gap,
    "pairwise_accuracy": q_pairwise_accuracy,
    "running_accuracy": q_running_accuracy,
    "eval_matrix": q_eval_matrix,
    "active_selected": q_active_selected,
    "active_rest": q_active_rest,
    "resume_pending": q_resume_pending,
    "extract_boxed_last": q_extract_boxed_last,
    "medical_score_trim": q_medical_score_trim,
    "code_pass_count_partial": q_code_pass_count_partial,
    "active_rest_keep_unseen": q_active_rest_keep_unseen,
    "eval_batches": q_eval_batches,
    "running_accuracy_every10": q_running_accuracy_every10,
    "user_messages": q_user_messages,
    "sft_rows": q_sft_rows,
    "last_line_int": q_last_line_int,
    "truncate_tokens": q_truncate_tokens,
    "output_projection": q_output_projection,
    "tables_round_trip": q_tables_round_trip,
    "strict_sample": q_strict_sample,
}


# -- rows-only: model functions, training, rounds, streaming ------------------------------

def pairs_with_embeddings(spark, sf):
    """Capped label pairs with the embeddings of both sides."""
    p = _pairs8(spark, sf).select("problem_id", "pair_rank", "accepted_idx", "rejected_idx")
    vec = testdata.doc_vec_id
    p = (p.withColumn("_da", F.col("problem_id") * 8 + F.col("accepted_idx"))
          .withColumn("_dr", F.col("problem_id") * 8 + F.col("rejected_idx"))
          .withColumn("vec_accepted", vec(spark, sf, "_da")).withColumn("vec_rejected", vec(spark, sf, "_dr")))
    emb = testdata.embeddings(spark, sf)
    ea = emb.select(F.col("vec_id").alias("vec_accepted"), F.col("embedding").alias("emb_accepted"))
    er = emb.select(F.col("vec_id").alias("vec_rejected"), F.col("embedding").alias("emb_rejected"))
    return p.join(ea, "vec_accepted").join(er, "vec_rejected").drop("_da", "_dr")


def q_train_pairwise_reward(spark, sf):
    w = model.train_pairwise(pairs_with_embeddings(spark, sf))
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(w)], "dim int, weight double")


def q_single_pair_rewards(spark, sf):
    """The single-pair evaluation path: texts cut to their first tokens, one pair a call."""
    cp = preference.chat_pairs(_pairs8_text(spark, sf))
    cp = cp.select("problem_id", "pair_rank", prompts.chat_text("chosen").alias("chosen_text"),
                   prompts.chat_text("rejected_messages").alias("rejected_text"))
    s = model.score_pair_sides(cp, model.make_length_reward, batch_size=1, max_tokens=CUT_TOKENS)
    return s.select("problem_id", "pair_rank", _r6("r_accepted"), _r6("r_rejected"))


def q_pair_rewards_by_tokens(spark, sf):
    """Whole texts of both sides, in calls of at most 4,096 padded tokens."""
    cp = preference.chat_pairs(_pairs8_text(spark, sf))
    cp = cp.select("problem_id", "pair_rank", prompts.chat_text("chosen").alias("chosen_text"),
                   prompts.chat_text("rejected_messages").alias("rejected_text"))
    s = model.score_pair_sides(cp, model.make_length_reward, token_budget=TOKEN_BUDGET)
    return s.select("problem_id", "pair_rank", _r6("r_accepted"), _r6("r_rejected"))


def q_evaluation_metrics(spark, sf):
    """Accuracy and running accuracy of the stand-in reward model, as the job writes them."""
    from prefloom.plans import jobs
    from prefloom.session import scratch_path

    pairs_ = _pairs8_text(spark, sf).select("problem_id", "pair_rank", "problem", "accepted", "rejected")
    acc, running = jobs.evaluate_reward_model(spark, pairs_, model.make_length_reward, batch_size=EVAL_BATCH, max_tokens=CUT_TOKENS,
                                              seed=SEED, running_every=10, metrics=scratch_path(spark, "metrics"))
    whole = acc.select(F.lit(-1).cast("long").alias("batch_id"), F.col("n_pairs").alias("seen"), F.col("n_correct").alias("correct"),
                       _r6("accuracy"))
    return whole.unionByName(running.select("batch_id", "seen", "correct", _r6("accuracy")))


def q_render_problems_math(spark, sf):
    """The math side of the column mapping: problem, solution, prompt and its message."""
    p = testdata.problems(spark, sf, 8).select("problem_id", "problem", testdata.math_answer().alias("solution"))
    m = F.element_at("messages", 1)
    return prompts.render_problems(p, "math").select("problem_id", "problem", "solution", "prompt", m["role"].alias("role"),
                                                     m["content"].alias("content"))


def q_pairwise_gradient(spark, sf):
    """The training loss's slope at zero weights, from the rows the fit gets:
    each pair once as (difference, 1) and once as (its negation, 0)."""
    from pyspark.ml.functions import vector_to_array

    rows = model.pairwise_features(pairs_with_embeddings(spark, sf))
    each = rows.select("label", F.posexplode(vector_to_array("features")).alias("dim", "x"))
    return each.groupBy((F.col("dim") + 1).alias("dim")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("n_positive"),
        F.round(F.sum((F.col("label") - 0.5) * F.col("x")), 3).alias("slope"))


def _rounds(spark, sf):
    """Three rounds on the whole pool: its own pairs, its metrics, and where they are written."""
    from prefloom.plans import active
    from prefloom.session import scratch_path

    out = scratch_path(spark, "active")
    pe = reliable_checkpoint(pairs_with_embeddings(spark, sf))
    pool, held_out = active.split_by_problem(pe, 0.2, SEED)
    n = pool.count()
    metrics = active.active_rounds(spark, pool, held_out, ["problem_id", "pair_rank"], model.rule_weights(64, 3), rounds=3,
                                   k=max(1, n // SELECT_K), max_to_look_at=n // SELECT_WINDOW, seed=SEED, out_root=out)
    return metrics, out


def q_active_rounds(spark, sf):
    return _rounds(spark, sf)[0]


def q_active_round_sizes(spark, sf):
    """What each round trained on, looked at and left, and how many pairs it
    trained on that an earlier round had or that it left (none)."""
    metrics, out = _rounds(spark, sf)
    keys = ["problem_id", "pair_rank"]
    rounds = [r[0] for r in metrics.select("round").collect()]
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/round={r}").select(*keys, "split", F.lit(r).alias("round"))
                                          for r in rounds])
    train = rows.where("split = 'train'").select(*keys, "round")
    other = rows.select(*keys, F.col("round").alias("_r"), F.col("split").alias("_s"))
    clash = (train.join(other, keys).where("(_s = 'train' AND _r < round) OR (_s = 'rest' AND _r = round)")
             .groupBy("round").agg(F.count(F.lit(1)).alias("n_shared")))
    return metrics.join(clash, "round", "left").select("round", "n_train", "n_eval", "n_rest",
                                                       F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))


def q_generate_completions(spark, sf):
    p = testdata.statements(spark, sf)
    r = p.select("problem_id", prompts.render_prompt("problem", prompts.MATH_TEMPLATE).alias("prompt"))
    return model.generate(r, model.make_echo_generator, FAN_OUT, batch_size=64) \
        .select("problem_id", "response_idx", "response")


def q_reward_model_scores(spark, sf):
    cp = preference.chat_pairs(_pairs8_text(spark, sf))
    cp = cp.select("problem_id", "pair_rank", prompts.chat_text("chosen").alias("chosen_text"),
                   prompts.chat_text("rejected_messages").alias("rejected_text"))
    s = model.predict_scores(cp, model.make_length_reward, ["chosen_text"], 8, "r_accepted")
    s = model.predict_scores(s, model.make_length_reward, ["rejected_text"], 8, "r_rejected")
    return s.select("problem_id", "pair_rank", _r6("r_accepted"), _r6("r_rejected"))


def _stream_input(spark, df, name, parts=4, order_col=None):
    """Write ``df`` as several files under the shared scratch folder (the
    stream's input); with ``order_col`` each file holds a contiguous range,
    as problems arrive in order."""
    from prefloom.session import scratch_path

    path = scratch_path(spark, name)
    out = df.repartitionByRange(parts, order_col) if order_col else df.repartition(parts)
    out.write.mode("overwrite").parquet(path)
    return path


STREAM_BUCKETS = 32  # buckets of the written responses table, whatever its size


def _bucket(spark, sf):
    """The bucket of a problem: a range of ids with about the same number of
    responses as the others. Problems arrive by id, so a micro-batch has few buckets."""
    shares = [k / STREAM_BUCKETS for k in range(1, STREAM_BUCKETS)]
    bounds = testdata.responses(spark, sf, 8).approxQuantile("problem_id", shares, 0.001)
    edges = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    return F.size(F.filter(edges, lambda b: b <= F.col("problem_id"))).alias("problem_bucket")


def q_stream_preference_pairs(spark, sf):
    from prefloom.session import scratch_path
    from prefloom.streaming import incremental

    bucket = _bucket(spark, sf)
    mc = testdata.math_candidates(spark, sf).select(bucket, "problem_id", "response_idx", "response")
    resp_path = scratch_path(spark, "stream-responses")
    mc.repartition("problem_bucket").write.partitionBy("problem_bucket").parquet(resp_path)
    probs = testdata.problems(spark, sf, 8).select(bucket, "problem_id", "problem", testdata.math_answer().alias("answer"))
    src = _stream_input(spark, probs, "stream-problems", order_col="problem_id")
    out = scratch_path(spark, "stream-pairs")
    incremental.incremental_preferences(spark, src, probs.schema, spark.read.parquet(resp_path), out,
                                        scratch_path(spark, "stream-ckpt"), "math", MATH_CAP,
                                        bucket_col="problem_bucket")
    return spark.read.parquet(out).drop("batch_id", "problem_bucket")


def q_stream_preference_pairs_merged(spark, sf):
    """The same pairs from choice responses, merged every second micro-batch."""
    from prefloom.session import scratch_path
    from prefloom.streaming import incremental, snapshots

    c = testdata.choice_candidates(spark, sf).select(_bucket(spark, sf), "problem_id", "response_idx", "response", "answer")
    resp_path = scratch_path(spark, "stream-choices")
    c.drop("answer").repartition("problem_bucket").write.partitionBy("problem_bucket").parquet(resp_path)
    answers = c.groupBy("problem_bucket", "problem_id").agg(F.min("answer").alias("answer"))
    probs = testdata.problems(spark, sf, 8).select("problem_id", "problem").join(answers, "problem_id")
    probs = probs.select("problem_bucket", "problem_id", "problem", "answer")
    src = _stream_input(spark, probs, "stream-choice-problems", parts=5, order_col="problem_id")
    out = scratch_path(spark, "stream-merged")
    incremental.incremental_preferences(spark, src, probs.schema, spark.read.parquet(resp_path), out,
                                        scratch_path(spark, "stream-merged-ckpt"), "medical", MATH_CAP,
                                        bucket_col="problem_bucket", save_every=2)
    return snapshots.read_snapshots(spark, out).select("problem_id", "pair_rank", "accepted_idx", "rejected_idx",
                                                       "accepted_score", "rejected_score", "accepted", "rejected")


def q_versioned_pairs(spark, sf):
    """The capped pairs as the second version of a table, next to one that was never published."""
    from prefloom.session import scratch_path
    from prefloom.streaming import snapshots

    p, out = _pairs8(spark, sf).select("problem_id", "pair_rank", "accepted_idx", "rejected_idx"), scratch_path(spark, "versions")
    snapshots.write_version(p.where("pair_rank = 1"), out)
    snapshots.write_version(p, out, partition_by=["pair_rank"])
    p.where("false").write.parquet(f"{out}/_data/2-unpublished")
    return snapshots.read_version(spark, out).select("problem_id", "pair_rank", "accepted_idx", "rejected_idx")


def q_stream_sft(spark, sf):
    from prefloom.session import scratch_path
    from prefloom.streaming import incremental

    bucket = _bucket(spark, sf)
    probs = testdata.problems(spark, sf, 8).select(bucket, "problem_id", "problem")
    src = _stream_input(spark, probs, "stream-sft-problems", order_col="problem_id")
    out = scratch_path(spark, "stream-sft")
    comp_path = scratch_path(spark, "stream-completions")
    comp = testdata.responses(spark, sf, 8).select(bucket, "problem_id", "response_idx", "response")
    comp.repartition("problem_bucket").write.partitionBy("problem_bucket").parquet(comp_path)
    incremental.incremental_sft(spark, src, probs.schema, spark.read.parquet(comp_path), out,
                                scratch_path(spark, "stream-sft-ckpt"), bucket_col="problem_bucket")
    return spark.read.parquet(out).drop("batch_id")


def q_stream_running_accuracy(spark, sf):
    """Accuracy after each evaluation batch, from a stream whose files hold
    pairs of any batches: the counts are the stream's state."""
    from prefloom.session import scratch_path
    from prefloom.streaming import incremental

    b = sampling.batch_ids(_ordered_pairs(spark, sf), ["_key", "problem_id", "pair_rank"], EVAL_BATCH, ["model"])
    b = b.select("model", "batch_id", "r_accepted", "r_rejected")
    src = _stream_input(spark, b, "stream-scored")
    out = scratch_path(spark, "stream-acc")
    incremental.streaming_accuracy(spark, src, b.schema, out, scratch_path(spark, "stream-acc-ckpt"), ["model"])
    counts = incremental.latest_counts(spark, out, ["model"])
    return evaluate.accuracy_from_counts(counts, group_cols=["model"]).select("model", "batch_id", "seen", "correct", _r6("accuracy"))


def q_error_digest(spark, sf):
    """Shortened tracebacks of the failed runs."""
    res = testdata.code_results(spark, sf).where(~F.col("ok"))
    return res.select("problem_id", "response_idx", "case_idx",
                      code_exec.reduce_error("error", "/tmp/run/tmp.py").alias("digest"))


ROWS_ONLY = {
    "error_digest": q_error_digest,
    "train_pairwise_reward": q_train_pairwise_reward,
    "pairwise_gradient": q_pairwise_gradient,
    "active_rounds": q_active_rounds,
    "active_round_sizes": q_active_round_sizes,
    "single_pair_rewards": q_single_pair_rewards,
    "pair_rewards_by_tokens": q_pair_rewards_by_tokens,
    "render_problems_math": q_render_problems_math,
    "evaluation_metrics": q_evaluation_metrics,
    "generate_completions": q_generate_completions,
    "code_run_responses": q_code_run_responses,
    "reward_model_scores": q_reward_model_scores,
    "stream_preference_pairs": q_stream_preference_pairs,
    "stream_preference_pairs_merged": q_stream_preference_pairs_merged,
    "versioned_pairs": q_versioned_pairs,
    "stream_sft": q_stream_sft,
    "stream_running_accuracy": q_stream_running_accuracy,
}
QUERIES.update(ROWS_ONLY)
