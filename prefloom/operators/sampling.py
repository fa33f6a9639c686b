"""Source mixing, seeded sampling, nested subsets and distributed positions.

A seeded shuffle is an order by a hash of (seed, key): the same under any
partitioning and on retries. The hash is uniform, so the first ``n`` lie below
a threshold near ``n / N``; only rows below it are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.hashing import shuffle_key
from prefloom.session import reliable_checkpoint


def source_shares(max_examples: int, ratios: Sequence[float]) -> list[int]:
    """Rows per source: ``int(max_examples * ratio / total)``; the remainder is lost."""
    total = sum(ratios)
    return [int(max_examples * r / total) for r in ratios]


def seeded_key(seed, key_cols: Sequence[str]) -> Column:
    return shuffle_key(seed, *key_cols)


#: Samples up to this size are merged in one task; larger ones are ranked by
#: distributed positions in the same order.
SINGLE_TASK_TOP_N = 1_000_000


def top_keys(df: DataFrame, n: int, order: Sequence[Column], key_cols: Sequence[str],
             rank_name: str | None = None, extra: Sequence[str] = (), descending: bool = False,
             single_task_max: int = SINGLE_TASK_TOP_N) -> DataFrame:
    """The ``n`` smallest (``descending``: largest) rows by ``order``, as
    narrow key rows; nulls come last either way, ties are broken by
    ``key_cols`` ascending. With ``rank_name`` a 1-based rank is added.

    Only ``key_cols`` (plus ``extra``) take part: the top-n moves ids and
    sort keys, not wide rows. The order is the same for every ``n``; above
    ``single_task_max`` no task holds the whole sample.
    """
    cols = list(dict.fromkeys([*key_cols, *extra]))
    ord_names = [f"_ord{i}" for i in range(len(order))]
    narrow = df.select(*cols, *[o.alias(nm) for o, nm in zip(order, ord_names)])
    ords = [F.col(nm).desc_nulls_last() if descending else F.col(nm).asc_nulls_last() for nm in ord_names]
    ords += [F.col(c).asc() for c in key_cols]
    if n > single_task_max:
        top = global_position(narrow, ords, "_pos").where(F.col("_pos") < int(n))
        if rank_name:
            top = top.withColumn(rank_name, F.col("_pos") + 1)
        return top.drop("_pos", *ord_names)
    top = narrow.orderBy(*ords).limit(int(n))
    if rank_name:
        top = top.withColumn(rank_name, F.row_number().over(Window.orderBy(*ords)).cast("long"))
    return top.drop(*ord_names)


def restrict(df: DataFrame, keys: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, with the columns of ``keys``
    attached (Spark broadcasts the keys if they are small enough)."""
    return df.join(keys, list(key_cols))


def likely_smallest(df: DataFrame, n: int, key: Column, have: int) -> DataFrame:
    """Rows that hold the ``n`` smallest of a uniform ``key`` in [0, 2^52).

    Of ``have`` rows about ``share * have`` lie below ``share * 2^52``; the
    share is set above ``n / have`` and widened until enough rows are kept, so
    the rows that reach the merge are about ``n`` in all, not ``n`` per task.
    """
    share = (1.1 * n + 1000.0) / max(have, 1)
    while share < 1.0:
        some = df.where(key < F.lit(share * 2 ** 52))
        if some.count() >= n:
            return some
        share *= 2
    return df


def take_sample(df: DataFrame, n: int, seed, key_cols: Sequence[str], strict: bool = True,
                rank_name: str | None = None) -> DataFrame:
    """The first ``n`` rows of a seeded shuffle.

    ``strict``: too few rows is an error (generation and training);
    otherwise the sample is clamped to the source size (evaluation).
    ``key_cols`` must identify a row: a repeated key among the chosen ones is
    an error, since it would return more than ``n`` rows.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    key = seeded_key(seed, key_cols)
    keys_only = reliable_checkpoint(df.select(*key_cols), "sample-keys")
    have = keys_only.count()
    if strict and have < n:
        raise ValueError(f"source has {have} rows, fewer than the {n} requested")
    keys = top_keys(likely_smallest(keys_only, n, key, have), n, [key], key_cols, rank_name)
    if not keys.groupBy(*key_cols).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(key_cols)} does not identify a row")
    return restrict(df, keys, key_cols)


#: Steps of a group's histogram for each doubling of the hash key: the rows
#: below a threshold exceed the sample by 1/16 of a doubling (4.4 %) at most.
STEPS = 16
#: Sampled rows that one task ranks, about.
RANK_ROWS = 1 << 16


def sample_limits(keyed: DataFrame, group: str, quotas: dict) -> dict:
    """group -> (rows it has, last histogram step its sample needs).

    One histogram of the hash key ``_u`` for all groups; the driver receives
    a row for each configured group."""
    step = F.floor(F.log2(F.col("_u") + 1) * STEPS).cast("int")
    wanted = keyed.sparkSession.createDataFrame(list(quotas.items()), keyed.select(group).schema.add("_n", "long"))
    below = F.sum("_rows").over(Window.partitionBy(group).orderBy("_step"))
    steps = (keyed.groupBy(group, step.alias("_step")).agg(F.count(F.lit(1)).alias("_rows"))
             .withColumn("_below", below).join(wanted, group))
    found = steps.groupBy(group).agg(F.max("_below").alias("have"), F.min(F.when(F.col("_below") >= F.col("_n"), F.col("_step"))).alias("step"))
    have = {r[0]: (r["have"], r["step"]) for r in found.collect()}
    return {g: have.get(g, (0, None)) for g in quotas}


def stratified_sample(df: DataFrame, group: str, quotas: dict, seed, key_cols: Sequence[str], strict: bool = True,
                      rank_name: str = "sample_rank") -> DataFrame:
    """The first ``quotas[g]`` rows of a seeded shuffle of each group ``g``, all
    groups at once; ``rank_name`` is the 1-based place in the group's order.

    The number of jobs does not depend on the number of groups: one histogram
    of the keys gives each group its own threshold, and the rows below it are
    ranked together. A group's order is cut into slices of equal hash ranges,
    about ``RANK_ROWS`` rows each, that are ranked apart and shifted by the
    sizes of the slices before; so no task ranks a whole hot group. ``df`` is
    read several times, only its keys but for the last: give a table.
    ``strict``: a group with fewer rows than its quota is an error
    (``ValueError``). A key that repeats within a group's sample is an error
    when the result is computed. Groups without a quota take no part.
    """
    if any(n < 0 for n in quotas.values()):
        raise ValueError("quotas must be >= 0")
    spark, keys = df.sparkSession, list(key_cols)
    quotas = {g: int(n) for g, n in quotas.items()}
    known = [g for g in quotas if g is not None]
    keyed = df.where(F.col(group).isin(known)).select(group, *keys, seeded_key(seed, keys).alias("_u"))
    limits = sample_limits(keyed, group, quotas)
    if strict:
        few = {g: have for g, (have, _) in limits.items() if have < quotas[g]}
        if few:
            raise ValueError(f"sources with fewer rows than requested: {sorted(few.items(), key=str)[:5]}")
    cuts = [(g, n, 2.0 ** 53 if limits[g][1] is None else 2.0 ** ((limits[g][1] + 1) / STEPS),
             max(1, -(-min(n, limits[g][0]) // RANK_ROWS))) for g, n in quotas.items()]
    plan = spark.createDataFrame(cuts, keyed.select(group).schema.add("_n", "long").add("_width", "double").add("_slices", "long"))
    cut = F.least(F.floor(F.col("_u") * F.col("_slices") / F.col("_width")), F.col("_slices") - 1)
    near = keyed.join(plan, group).where(F.col("_u") < F.col("_width")).withColumn("_slice", cut)
    order = Window.partitionBy(group, "_slice").orderBy("_u", *keys)
    one = F.struct(*[F.col(k) for k in keys])
    ranked = near.withColumn("_again", F.lag(one).over(order).eqNullSafe(one)).withColumn("_at", F.row_number().over(order))
    if all(c[3] == 1 for c in cuts):  # no slice is behind another
        ranked = ranked.withColumn("_before", F.lit(0))
    else:
        earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        sizes = near.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        ranked = ranked.join(sizes.select(group, "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")),
                             [group, "_slice"])
    ranked = ranked.withColumn(rank_name, F.col("_before") + F.col("_at")).where(F.col(rank_name) <= F.col("_n"))
    text = F.lit(f"{keys} does not identify a row")
    ranked = ranked.select(group, *keys, F.when(F.col("_again"), F.raise_error(text).cast("long")).otherwise(F.col(rank_name)).alias(rank_name))
    return restrict(df, ranked, [group, *keys])


def mix_by_source(df: DataFrame, ratios: dict, max_examples: int | None, seed, key_cols: Sequence[str],
                  strict: bool = True, source: str = "source_name") -> DataFrame:
    """One table whose ``source`` column names each row's source, mixed by
    ``ratios``: each source's share of ``max_examples``, sampled, with
    ``sample_rank`` (null if ``max_examples`` is None, which keeps all rows)."""
    if max_examples is None:
        return df.where(F.col(source).isin(list(ratios))).withColumn("sample_rank", F.lit(None).cast("long"))
    quotas = dict(zip(ratios, source_shares(max_examples, list(ratios.values()))))
    return stratified_sample(df, source, quotas, seed, key_cols, strict)


def mix_sources(sources: Sequence[tuple[str, DataFrame, float]], max_examples: int | None,
                seed, key_cols: Sequence[str], strict: bool = True) -> DataFrame:
    """Sample each source by its share of ``max_examples`` and concatenate.

    Adds ``source_name`` and ``sample_rank`` (1-based position in the seeded
    order of its source). With ``max_examples=None`` all rows are kept and
    ``sample_rank`` is null. Sources are told apart by their place in the
    list, so a name may occur twice; all are sampled in one pass.
    """
    parts = [df.withColumn("source_name", F.lit(name)).withColumn("_place", F.lit(i)) for i, (name, df, _) in enumerate(sources)]
    table = reduce(lambda a, b: a.unionByName(b), parts)
    ratios = {i: r for i, (_, _, r) in enumerate(sources)}
    return mix_by_source(table, ratios, max_examples, seed, key_cols, strict, source="_place").drop("_place")


def nested_subsets(df: DataFrame, sizes: Sequence[int], seed, key_cols: Sequence[str]) -> DataFrame:
    """Training subsets of several sizes that are prefixes of one seeded order.

    Returns the rows of the largest subset with ``subset_rank`` and
    ``subset_size`` (the smallest requested size that contains the row);
    ``where(subset_size <= n)`` gives the subset of size ``n``.
    """
    sizes = sorted(int(s) for s in sizes)
    ranked = take_sample(df, sizes[-1], seed, key_cols, strict=False, rank_name="subset_rank")
    size = F.lit(None).cast("int")
    for s in reversed(sizes):
        size = F.when(F.col("subset_rank") <= s, F.lit(s)).otherwise(size)
    return ranked.withColumn("subset_size", size)


def _range_tagged(df: DataFrame, order_cols: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted rows tagged with partition id and a local id,
    frozen with a reliable checkpoint so that both stay fixed on reuse."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    return reliable_checkpoint(tagged)


def _partition_offsets(tagged: DataFrame, value_cols: Sequence[str] = (), group_cols: Sequence[str] = ()) -> DataFrame:
    """Totals and exclusive prefix sums of each (task, group); a row for each
    partition, plus one for each further group."""
    aggs = [F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_base")]
    aggs += [F.sum(c).alias(f"_tot_{c}") for c in value_cols]
    sizes = tagged.groupBy("_pid", *group_cols).agg(*aggs)
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    for c in value_cols:
        out = out.withColumn(f"_off_{c}", F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)))
    return out


def _with_offsets(tagged: DataFrame, offs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Each row with the offsets of its task and group. Without groups the
    offsets are one row per task and broadcast; with groups Spark decides by
    their size (null groups match)."""
    if not group_cols:
        return tagged.join(F.broadcast(offs), "_pid")
    return join_same(tagged, offs, ["_pid", *group_cols])


def join_same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on equal ``cols`` where nulls are equal as well."""
    names = [f"_r{i}" for i in range(len(cols))]
    right = right.withColumnsRenamed(dict(zip(cols, names)))
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cols, names)])).drop(*names)


def global_position(df: DataFrame, order_cols: Sequence, name: str = "position", group_cols: Sequence[str] = ()) -> DataFrame:
    """0-based position in the total order of ``order_cols`` (unique), per group
    of ``group_cols``, without a window over all rows or over a whole group:
    range partitions on (group, order) are numbered locally and shifted by the
    sizes of the group's rows in the partitions before. A group that holds most
    rows spreads over many tasks, and one plan serves any number of groups."""
    groups = list(group_cols)
    tagged = _range_tagged(df, [*groups, *order_cols])
    offs = _partition_offsets(tagged, group_cols=groups).select("_pid", *groups, "_off", "_base")
    pos = F.col("_off") + F.col("_mid") - F.col("_base")
    return _with_offsets(tagged, offs, groups).withColumn(name, pos).drop("_pid", "_mid", "_off", "_base")


def running_sums(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                 suffix: str = "_cum", group_cols: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in the total order, per group of
    ``group_cols``, computed in each range partition and shifted by the group's
    totals in earlier partitions."""
    groups = list(group_cols)
    tagged = _range_tagged(df, [*groups, *order_cols])
    offs = _partition_offsets(tagged, value_cols, groups).select("_pid", *groups, *[f"_off_{c}" for c in value_cols])
    w = Window.partitionBy("_pid", *groups).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _with_offsets(tagged, offs, groups)
    for c in value_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_off_{c}") + F.sum(c).over(w))
    return out.drop("_pid", "_mid", *[f"_off_{c}" for c in value_cols])


def batch_ids(df: DataFrame, order_cols: Sequence[str], batch_size: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """``batch_id = floor(position / batch_size)`` in the given order, per group."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    pos = global_position(df, order_cols, "_position", group_cols)
    return pos.withColumn("batch_id", F.expr(f"_position div {int(batch_size)}")).drop("_position")


def num_batches(n_rows: int, batch_size: int) -> int:
    """Ceiling division, as the batch loops use."""
    return n_rows // batch_size + (1 if n_rows % batch_size else 0)
