"""Mixing sources to target weights by Pareto order sampling.

Each document gets an expected number of copies: its source's target over
the source's size. The whole part is taken for certain; for the rest every
document has an inclusion probability ``p`` and a random ``u`` of its key,
and documents are ranked by the odds ratio ``(u / (1-u)) / (p / (1-p))``
(Rosen's Pareto order sampling). The sample is of fixed size in words: each
source takes its ranking as far as it fits the words still open, and the last
place goes to the remaining document that fits best, so that a source misses
its target by less than a document.

Scale: the text is read once to count words; everything after that is a
narrow row per document. The per-source running sum is a range exchange on
(source, rank), so a source that holds a third of all rows spreads over many
tasks. Only the table of sources, one row each, is ordered in one task.

Defined results: a null text has size 0 and takes 0; a null source is a
source of its own, the last one; rows that repeat an id and its text share
their random number, are ranked one after another and taken one by one; an
empty table gives an empty table; a document of size 0 is never more than its
certain copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.hashing import uniform
from prefloom.llm.common import running_total, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20
#: A table with a row for each source is broadcast up to so many sources.
BROADCAST_SOURCES = 10_000
#: The keys of rows that repeat are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20


def _text_hash(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words), a hash of the text, and ``rep``, which
    numbers rows that are equal in all of these."""
    spaces = " \t\n\x0b\x0c\r"
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(spaces))
    return _numbered(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{spaces}]+"))).cast("long").alias("size"),
        _text_hash(text).alias("text_hash")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rep`` from 1 for rows equal in source, id and text."""
    same = Window.partitionBy("source", "doc_id", "text_hash")
    return rows.withColumn("rep", F.row_number().over(same.orderBy(F.lit(0))).cast("long"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_rank, source_size, target.

    Targets are ``min(most * size, level * weight)`` with the one level at
    which they add up to ``share`` of all sizes: what a full source leaves
    over goes to the others by weight. Sorted by size over weight the full
    sources come first, so the level follows from running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = per.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    w = ordered.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(1))
    filling = everything.orderBy(F.col("most") / F.col("weight"), "source_rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    levels = (w.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
              .withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
              .withColumn("open_weight", F.sum("weight").over(everything)
                          - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
              .withColumn("open", F.col("level") * F.col("weight") <= F.col("most")))
    found = levels.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True)
                              .over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("level") * F.col("weight")))
    return found.select("source", "source_rank", "source_size", target.alias("target"))


def _key(seed) -> Column:
    """Rank of a row: random odds over inclusion odds, ties by id, text and number."""
    p = F.col("copies") - F.floor("copies")
    u = uniform(seed, "doc_id", "text_hash")
    odds = F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))).otherwise(F.lit(float("inf")))
    return F.struct(odds.alias("odds"), F.col("doc_id"), F.col("text_hash"), F.col("rep"))


def pareto_cuts(sized: DataFrame, targets: DataFrame, seed=SEED) -> DataFrame:
    """Targets with ``copies`` (expected, of each document), ``cut`` (the last
    rank that is taken) and ``fill`` (the rank that gets the last place)."""
    wanted = (targets.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                 .otherwise(F.lit(0.0)))
              .withColumn("open_size", F.col("target") - F.floor("copies") * F.col("source_size")))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    rows = (sized.alias("d").join(wanted.alias("t"), same).where("copies > floor(copies) and size > 0")
            .select("source_rank", "doc_id", "text_hash", "rep", "size", "copies", "open_size")
            .withColumn("key", _key(seed)))
    flat = rows.select("source_rank", "size", "open_size", "key.*")
    run = running_total(flat, "source_rank", ["odds", "doc_id", "text_hash", "rep"], "size", "run")
    run = saved(run.withColumn("in", F.col("run") <= F.col("open_size"))
                .withColumn("key", F.struct("odds", "doc_id", "text_hash", "rep")), "ranked")
    taken = run.groupBy("source_rank").agg(
        F.max(F.when(F.col("in"), F.col("key"))).alias("cut"),
        (F.max("open_size") - F.coalesce(F.sum(F.when(F.col("in"), F.col("size"))), F.lit(0))).alias("gap"))
    few = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda x: x
    fill = (run.where(~F.col("in")).join(few(taken.select("source_rank", "gap")), "source_rank")
            .withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where("miss < gap")
            .groupBy("source_rank").agg(F.min(F.struct("miss", "key")).alias("best"))
            .select("source_rank", F.col("best.key").alias("fill")))
    return saved(wanted.join(taken.select("source_rank", "cut"), "source_rank", "left").join(fill, "source_rank", "left"), "cuts")


def take(rows: DataFrame, cuts: DataFrame, seed=SEED) -> DataFrame:
    """Rows (doc_id, source, text_hash, ...) with source_size, target and
    ``taken_copies``: the whole part for certain, one more up to the cut. A row
    needs its source's cut alone, so texts stay where they are if the table of
    cuts is small enough to be broadcast."""
    cuts = cuts.withColumnRenamed("source", "_source")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_key", _key(seed))
    more = (F.col("_key") <= F.col("cut")) | F.col("_key").eqNullSafe(F.col("fill"))
    partial = F.col("copies") > F.floor("copies")
    copies = F.floor("copies") + (partial & F.coalesce(more, F.lit(False))).cast("long")
    return joined.withColumn("taken_copies", copies).drop("_source", "_key", "cut", "fill", "copies", "open_size", "source_rank")


def plan_mix(docs: DataFrame, seed=SEED) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken_copies, taken."""
    sized = saved(sizes(docs), "sizes")
    out = take(sized, pareto_cuts(sized, source_targets(sized), seed), seed)
    return out.withColumn("taken", F.col("taken_copies") * F.col("size"))


def mix(docs: DataFrame, seed=SEED) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it."""
    sized = saved(sizes(docs), "sizes")
    cuts = pareto_cuts(sized, source_targets(sized), seed)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id",
                         F.col("source").cast("string").alias("source"), _text_hash("text").alias("text_hash"))
    # only rows that repeat need a number, so texts of others stay where they are
    again = saved(sized.where("rep = 2").select(*[F.col(c).alias(f"_{c}") for c in ("source", "doc_id", "text_hash")]), "repeats")
    held = again.agg(F.sum(F.coalesce(F.length("_source"), F.lit(0)) + 64)).first()[0] or 0
    again = F.broadcast(again) if held <= BROADCAST_BYTES else again
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source", "doc_id", "text_hash")])
    packed = packed.join(again, same, "left_anti").withColumn("rep", F.lit(1).cast("long")).union(
        _numbered(packed.join(again, same, "left_semi")))
    some = take(packed, cuts, seed).where("taken_copies > 0")
    copies = F.sequence(F.lit(1), F.col("taken_copies").cast("int"))
    return some.select("_row", F.explode(copies)).select("_row.*")
