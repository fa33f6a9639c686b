"""Model surface: batch completion and reward scoring with user-supplied
model functions, and a Spark ML pairwise (Bradley-Terry) reward model.

Model calls go through Arrow functions (one model instance per Python worker)
that convert the rows of one call at a time, so that beside Spark's own batch
of at most ``spark.sql.execution.arrow.maxBytesPerBatch`` bytes a worker holds
one call's texts, whatever the batch's rows. The model result is selected into a column
and should be written before it is used twice, so that plan rewrites cannot
call the model again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions.text import _col
from prefloom.operators.prompts import fan_out


def linear_reward(embedding, weights: Sequence[float]) -> Column:
    """Dot product of an embedding column with fixed weights (JVM-side)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    prods = F.zip_with(_col(embedding), w, lambda x, y: x.cast("double") * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda a, b: a + b)


def rule_weights(dim: int, modulus: int) -> list[float]:
    """Weights ``(k mod m) - (m // 2)`` for k = 1..dim (fixture reward models)."""
    return [float((k % modulus) - modulus // 2) for k in range(1, dim + 1)]


_MODELS: dict[str, Callable] = {}


def _built(key: str, make: Callable) -> Callable:
    """The model instances of a Python worker, kept over its tasks; three at most."""
    if key not in _MODELS:
        while len(_MODELS) > 2:
            del _MODELS[next(iter(_MODELS))]
        _MODELS[key] = make()
    return _MODELS[key]


def _values(column: pa.Array) -> np.ndarray:
    """A column as the model gets it: numbers as such (nulls: NaN), anything else as objects (nulls: None)."""
    return column.to_numpy(zero_copy_only=False)


def _call_udf(make: Callable, returns: T.DataType, arrow: pa.DataType, batch_size: int) -> Callable:
    """A column function that calls ``make()``'s function on ``batch_size`` rows at a time."""
    key = uuid.uuid4().hex

    def predict(batches):
        fn = _built(key, make)
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            parts = []
            for i in range(0, len(columns[0]), batch_size):
                inputs = [_values(c.slice(i, batch_size)) for c in columns]
                found = np.asarray(fn(*inputs))
                if found.shape[:1] != (len(inputs[0]),) or found.size != len(inputs[0]):
                    raise ValueError(f"the model gave {found.shape} values for {len(inputs[0])} rows")
                parts.append(pa.array(found.reshape(-1), arrow, from_pandas=True))
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return predict(batches)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return predict(batches)

    # evaluated hints: the module's own are strings
    one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    several.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}

    def column(*columns: Column) -> Column:
        return F.arrow_udf(one if len(columns) == 1 else several, returns)(*columns)

    return column


def generate(prompts: DataFrame, make_generate_fn: Callable, n: int, batch_size: int = 64,
             prompt_col: str = "prompt", out_col: str = "response",
             num_partitions: int | None = None) -> DataFrame:
    """``n`` completions per prompt.

    ``make_generate_fn()`` returns ``fn(prompts: np.ndarray, sample_idx:
    np.ndarray) -> np.ndarray[str]``; the sample index is an input so that
    the samples of one prompt differ and a retried task repeats them.
    ``num_partitions`` first spreads the prompts evenly over that many tasks
    (a sample drawn from a large table otherwise sits in its source
    partitions, a few rows per task or many in a few).
    """
    udf = _call_udf(make_generate_fn, T.StringType(), pa.string(), batch_size)
    if num_partitions:
        prompts = prompts.repartition(int(num_partitions))
    fanned = fan_out(prompts, n, "response_idx")
    return fanned.withColumn(out_col, udf(F.col(prompt_col), F.col("response_idx")))


def predict_scores(df: DataFrame, make_predict_fn: Callable, input_cols: Sequence[str],
                   batch_size: int = 8, out_col: str = "reward") -> DataFrame:
    """Reward per row from a user model: ``make_predict_fn()`` returns
    ``fn(*arrays) -> np.ndarray[float]``."""
    udf = _call_udf(make_predict_fn, T.DoubleType(), pa.float64(), batch_size)
    return df.withColumn(out_col, udf(*[F.col(c) for c in input_cols]))


def token_batches(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Rows in calls of at most ``budget`` tokens, padding counted: shortest
    first, a call's size times its longest row. A row beyond the budget is a
    call of its own."""
    order = np.argsort(lengths, kind="stable")
    calls, start = [], 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (i + 1 - start) * max(1, int(lengths[order[i]])) > budget:
            calls.append(order[start:i])
            start = i
    return calls


def predict_scores_by_tokens(df: DataFrame, make_predict_fn: Callable, input_col: str, budget: int,
                             out_col: str = "reward", count: Callable[[str], int] = lambda t: len(t.split())) -> DataFrame:
    """``predict_scores`` of one text column with calls cut by tokens, not rows.

    Within an Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``
    rows) texts are ordered by length, so that a call pads little, and a call
    holds at most ``budget`` padded tokens, whatever the texts' lengths.
    ``count`` gives a text's tokens; a null text has none and no reward. Rows
    keep their order.
    """
    key, at = uuid.uuid4().hex, df.columns.index(input_col)
    if budget <= 0:
        raise ValueError("budget must be positive")

    def run(batches):
        fn = _built(key, make_predict_fn)
        for batch in batches:
            texts = batch.column(at)
            known = np.flatnonzero(np.asarray(texts.is_valid()))
            lengths = np.array([count(texts[i].as_py()) for i in known.tolist()], np.int64)
            scores: list = [None] * len(texts)
            for call in token_batches(lengths, budget):
                rows = known[call]
                some = np.array([texts[i].as_py() for i in rows.tolist()], dtype=object)
                for i, x in zip(rows.tolist(), np.asarray(fn(some), float).tolist()):
                    scores[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())]))


def score_pair_sides(pairs: DataFrame, make_predict_fn: Callable, chosen_col: str = "chosen_text",
                     rejected_col: str = "rejected_text", batch_size: int = 8,
                     max_tokens: int | None = None, token_budget: int | None = None) -> DataFrame:
    """Reward of both sides of each pair in one model pass per side.

    ``batch_size=1`` with ``max_tokens`` is the single-pair evaluation path
    (texts truncated to ``max_tokens`` white-space tokens first); every pair
    is scored once whatever the batch size. With ``token_budget`` calls are cut
    by padded tokens instead (``predict_scores_by_tokens``).
    """
    from prefloom.operators.evaluate import truncate_tokens

    c, r = F.col(chosen_col), F.col(rejected_col)
    if max_tokens is not None:
        c, r = truncate_tokens(c, max_tokens), truncate_tokens(r, max_tokens)
    tmp = pairs.withColumn("_c_in", c).withColumn("_r_in", r)
    for col, out in (("_c_in", "r_accepted"), ("_r_in", "r_rejected")):
        tmp = (predict_scores(tmp, make_predict_fn, [col], batch_size, out) if token_budget is None
               else predict_scores_by_tokens(tmp, make_predict_fn, col, token_budget, out))
    return tmp.drop("_c_in", "_r_in")


def pairwise_features(pairs: DataFrame, emb_accepted: str = "emb_accepted",
                      emb_rejected: str = "emb_rejected") -> DataFrame:
    """Each pair twice: (accepted - rejected, label 1) and the negation
    (label 0), emitted in one pass over the pairs."""
    from pyspark.ml.functions import array_to_vector

    diff = F.zip_with(F.col(emb_accepted), F.col(emb_rejected), lambda a, b: a.cast("double") - b.cast("double"))
    both = pairs.select(F.explode(F.array(
        F.struct(diff.alias("d"), F.lit(1.0).alias("label")),
        F.struct(F.transform(diff, lambda x: -x).alias("d"), F.lit(0.0).alias("label")),
    )).alias("_x"))
    return both.select(array_to_vector("_x.d").alias("features"), F.col("_x.label").alias("label"))


def train_pairwise(pairs: DataFrame, emb_accepted: str = "emb_accepted", emb_rejected: str = "emb_rejected",
                   reg: float = 1e-3, max_iter: int = 50) -> list[float]:
    """Bradley-Terry reward ``r(x) = w . x`` by logistic regression without
    intercept on embedding differences (distributed L-BFGS). Returns ``w``;
    score with ``linear_reward(embedding, w)``. The small L2 term keeps the
    fit finite when a selection is linearly separable (a few thousand pairs
    in many dimensions), where the unregularised optimum is at infinity."""
    from pyspark.ml.classification import LogisticRegression

    data = pairwise_features(pairs, emb_accepted, emb_rejected)
    lr = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=max_iter, standardization=False)
    model = lr.fit(data)
    return [float(x) for x in np.asarray(model.coefficients.toArray())]


# -- stand-in model functions (for tests and demos; real ones are the user's) --

def make_echo_generator():
    """A deterministic stand-in for a completion model: the last words of
    the prompt, the sample index and a boxed number."""
    def fn(prompts: np.ndarray, sample_idx: np.ndarray) -> np.ndarray:
        out = []
        for p, i in zip(prompts, sample_idx):
            tail = " ".join(str(p).split()[-5:])
            out.append(f"{tail} ... so the answer is \\boxed{{{(len(str(p)) + int(i)) % 7}}}")
        return np.array(out, dtype=object)
    return fn


def make_length_reward():
    """A stand-in reward model on chat texts: more distinct words, more reward."""
    def fn(texts: np.ndarray) -> np.ndarray:
        return np.array([float(len(set(str(t).split()))) / (1.0 + len(str(t)) ** 0.5) for t in texts])
    return fn
