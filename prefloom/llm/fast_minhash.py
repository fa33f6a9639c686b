"""MinHash near-dedup by fast similarity sketching.

A document's set is its distinct word shingles. Rounds of hashed placement
fill a sketch of ``COORDS`` coordinates: in round ``i`` every shingle falls
into a hashed bin with a value ``i`` plus a hash; rounds ``COORDS`` and on
send all shingles to one given bin each, so that every coordinate fills
(Dahlgaard, Knudsen and Thorup). ``BANDS`` bands of ``ROWS`` coordinates give
candidates, which are confirmed on the full shingle sets. At the threshold
0.8 a pair shares no band with probability (1 - 0.8^5)^26 = 3e-5.

Groups of copies: documents with equal sets are one class. A class is first
compared with one representative, the least of its buckets' leads; classes
that are linked by then need no further comparison. What is left, buckets whose
members still lie in several components, is compared with the bucket's lead,
then with another member (stars, not all pairs). The pairs across components that
remain are found through the differences from the bucket's representative:
members x, y with symmetric differences Dx, Dy from it are linked if and only
if Dx and Dy share a number of shingles that follows from four set sizes (see
``across_pairs``), so a prefix filter over the rarest differences, and bitmaps
of all differences, find every link without comparing all members. No link of
the candidates is lost.

Defined results: a document without words (or null) has an empty set and is
linked with nothing; a null id takes no part (component null, kept); rows
that repeat an id with another text are documents of their own; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import GOLDEN, U64, mix64, pieces, saved

ROWS, BANDS = 5, 26
COORDS = ROWS * BANDS
PERCENT = 80
#: Bits of the bitmap of a member's differences.
BITS = 256
#: A list of ids is broadcast up to so many rows (16 MB), else joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(GOLDEN))
_FOLDED = _CODES.copy()
_FOLDED[0x41:0x5B] = _CODES[0x61:0x7B]  # A-Z count as a-z


def word_hashes(texts: list[bytes], fold: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased if ``fold``), and each text's first word.

    A word's hash is the sum of random numbers, one for each pair of place and
    byte, mixed with its length: unlike a polynomial in the bytes it has no
    structure that words could share. Other seeds give independent hashes."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=0, append=0)
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = size - start
    place = mix64(np.arange(1 + seed, 1 + seed + int(size.max(initial=0)), dtype=U64) * U64(0xD1342543DE82EF95))
    first = np.cumsum(size) - size  # of each word among the bytes of words
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    at = np.repeat(start, size) + inside
    values = mix64((_FOLDED if fold else _CODES)[data[at]] ^ place[inside])
    sums = np.add.reduceat(values, first) if len(first) else np.zeros(0, U64)
    words = mix64(sums + size.astype(U64) * U64(GOLDEN))
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, np.searchsorted(start, begin)


def shingle_sets(texts: list[bytes], width: int = 2, seed: int = 0) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts, seed=seed)
    rolled = words.copy()
    for k in range(1, width):
        rolled[:-k] = mix64(rolled[:-k] * U64(GOLDEN) + words[k:])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            s = np.sort(rolled[a:b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            one = words[a:a + 1] + U64(b - a)
            for k in range(a + 1, b):
                one = mix64(one * U64(GOLDEN) + words[k:k + 1])
            out.append(mix64(one))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Sketch matrix, a row of ``COORDS`` values for each non-empty set."""
    n = len(sets)
    table = np.full(n * COORDS, ~U64(0), U64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, U64)
    for i in range(2 * COORDS):
        if not len(items):
            break
        h = mix64(items ^ U64((i + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        bins = ((h >> U64(32)) * U64(COORDS) >> U64(32)).astype(np.int64) if i < COORDS else i - COORDS
        np.minimum.at(table, owner * COORDS + bins, U64(i << 48) | (mix64(h) >> U64(16)))
        still = (table.reshape(n, COORDS) == ~U64(0)).any(axis=1)[owner]
        items, owner = items[still], owner[still]
    return table.reshape(n, COORDS)


def band_keys(table: np.ndarray) -> np.ndarray:
    bands = table.reshape(len(table), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(GOLDEN), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key ^ bands[:, :, r]) * U64(GOLDEN)
    return key


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _narrow(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BITS`` bits, as 64-bit numbers, for each set of hashes: bit ``h % BITS`` for each hash."""
    bits = np.zeros((len(sets), BITS), bool)
    for row, s in zip(bits, sets):
        row[s.view(U64) % U64(BITS)] = True
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(sets), BITS // 64)


def sketch_documents(docs: DataFrame, text: str = "text", width: int = 2) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (16 bytes, null if empty) and band keys."""

    def run(batches):
        for batch in pieces(batches, 1):
            sets = shingle_sets(_texts(batch, 1), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(sketches([sets[i] for i in full])).view(np.int64) if full else np.zeros((0, BANDS), np.int64)
            bands = [None] * len(sets)
            for k, i in enumerate(full):
                bands[i] = keys[k]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_id", "bands"])

    return _narrow(docs, text).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, set_id binary, bands array<bigint>")


def class_texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int) -> DataFrame:
    """set_id, text of the classes in ``nodes`` (distinct set ids).

    Texts are fetched by the class's first document and recognised by the
    set's digest.
    """
    wanted = saved(nodes.join(classes.select("set_id", "first_doc"), "set_id"), "wanted")
    ids = wanted.select(F.col("first_doc").alias("doc_id")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = _narrow(docs, text).join(ids, "doc_id", "left_semi")

    def identify(batches):
        for batch in pieces(batches, 1):
            sets = shingle_sets(_texts(batch, 1), width)
            yield pa.RecordBatch.from_arrays([
                pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), batch.column(1)],
                names=["set_id", "text"])

    return saved(some.mapInArrow(identify, "set_id binary, text string").where("set_id is not null")
                 .join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "texts")


def confirm(edges: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The edges (a, b) between set ids whose full sets are similar enough.

    The two text joins are on set ids, which adaptive execution splits where
    one is hot.
    """
    nodes = edges.select(F.col("a").alias("set_id")).union(edges.select("b")).distinct()
    texts = class_texts(nodes, classes, docs, text, width)
    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        for batch in pieces(pieces(batches, 2), 3):
            sides = [_texts(batch, 2), _texts(batch, 3)]
            one = list(dict.fromkeys(sides[0] + sides[1]))
            # hashes of their own: a link does not rest on the hashes that proposed it
            sets = dict(zip(one, shingle_sets(one, width, seed=1 << 32)))
            keep = []
            for x, y in zip(*sides):
                x, y = sets[x], sets[y]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(check, "a binary, b binary")


def across_pairs(several: DataFrame, classes: DataFrame, docs: DataFrame, text: str, width: int,
                 percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked; no link between
    members of one bucket is missing, given that each was compared with the
    bucket's lead ``c`` or is in its component.

    With R = c - x, A = x - c, D = R + A and W = 200 |R| + 2 percent |A| -
    (100 - percent) |c|, the sets x and y are linked if and only if
    S |Dx & Dy| >= Wx + Wy, where S = 2 (100 + percent). Where Wx + Wy <= 0 both
    are linked with c, hence in one component. Else, of a pair with Wx <= Wy, x
    shares at least 2 Wx / S differences, and y at least (Wy + L) / S, where
    L = (2 percent Wy - S (100 - percent) |c|) / 200 is the least Wx that |Dx|
    allows. So a linked pair meets in the first |D| - need + 1 differences of
    either side, rarest first. Differences are keyed by a hash of lead and
    shingle: equal hashes only add candidates. Of the pairs that meet, those go
    whose bitmaps rule out so many shared differences: each bit of x that y
    lacks stands for a difference of x alone.
    """
    marks = [f"mark{i}" for i in range(BITS // 64)]
    scale = 2 * (100 + percent)
    units = several.where("set_id <> lead").select("lead", "set_id", "component").distinct()
    units = saved(units.withColumn("u", F.monotonically_increasing_id()), "units")
    nodes = units.select("set_id").union(units.select("lead")).distinct()
    texts = class_texts(nodes, classes, docs, text, width)
    both = (units.join(texts.select(F.col("set_id").alias("lead"), F.col("text").alias("lead_text")), "lead")
            .join(texts, "set_id").select("u", "lead_text", "text"))

    def differ(batches):
        for batch in pieces(pieces(batches, 1), 2):
            sides = [_texts(batch, 1), _texts(batch, 2)]
            one = list(dict.fromkeys(sides[0] + sides[1]))
            sets = dict(zip(one, shingle_sets(one, width)))
            removed, added, lead, diff = [], [], [], []
            for c, x in zip(*sides):
                c, x = sets[c], sets[x]
                gone, new = np.setdiff1d(c, x, assume_unique=True), np.setdiff1d(x, c, assume_unique=True)
                removed.append(len(gone))
                added.append(len(new))
                lead.append(len(c))
                diff.append(np.concatenate([gone, new]).view(np.int64))
            bits = bitmaps(diff)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(removed, pa.int64()), pa.array(added, pa.int64()),
                pa.array(lead, pa.int64()), pa.array(diff, pa.list_(pa.int64())), *[pa.array(x) for x in bits.T.copy()]],
                names=["u", "removed", "added", "n_lead", "diff", *marks])

    sized = both.mapInArrow(differ, "u long, removed long, added long, n_lead long, diff array<bigint>, "
                            + ", ".join(f"{m} long" for m in marks))
    sized = sized.select("u", "n_lead", "diff", *marks, (F.col("removed") + F.col("added")).alias("d"),
                         (F.col("n_lead") - F.col("removed") + F.col("added")).alias("size"),
                         (F.lit(200) * F.col("removed") + F.lit(2 * percent) * F.col("added")
                          - F.lit(100 - percent) * F.col("n_lead")).alias("w"))
    lower = F.floor((F.lit(2 * percent) * F.col("w") - F.lit(scale * (100 - percent)) * F.col("n_lead")) / 200)
    units = saved(units.join(sized.select(
        "u", "diff", "d", "w", "size", *marks,
        F.greatest(F.lit(1), F.ceil(2 * F.col("w") / scale)).alias("need_small"),
        F.greatest(F.lit(1), F.ceil((F.col("w") + lower) / scale)).alias("need_large")), "u"), "differences")
    # a difference that no other unit of the lead has joins nothing, but counts as the rarest
    item = units.select("u", "d", "need_small", "need_large", "lead", F.explode("diff").alias("shingle")).select(
        "u", "d", "need_small", "need_large", F.xxhash64("lead", "shingle").alias("key"))
    often = item.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = Window.partitionBy("u")
    ranked = (item.join(often, "key")
              .withColumn("pos", F.row_number().over(mine.orderBy("n", "key")) - 1)
              .withColumn("pos", F.col("d") - F.count(F.lit(1)).over(mine) + F.col("pos")))
    head = ranked.where(F.col("pos") <= F.col("d") - F.least("need_small", "need_large")).select(
        "u", "key", (F.col("d") - F.col("pos")).alias("rest"),
        (F.col("pos") <= F.col("d") - F.col("need_small")).alias("small"),
        (F.col("pos") <= F.col("d") - F.col("need_large")).alias("large"))
    head = saved(head.join(units.select("u", "set_id", "component", "d", "w", "size", *marks), "u").drop("u"), "heads")

    def side(flag, suffix):
        return head.where(flag).select("key", *[F.col(c).alias(c + suffix) for c in ("set_id", "component", "d", "w", "rest", "size", *marks)])

    def common(x, y):
        """The most differences that x can share with y."""
        alone = [F.bit_count(F.col(f"{m}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{y}")))) for m in marks]
        return F.col(f"d_{x}") - reduce(Column.__add__, alone)

    met = side("small", "_x").join(side("large", "_y"), "key").where(
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("w_x") < F.col("w_y")) | ((F.col("w_x") == F.col("w_y")) & (F.col("set_id_x") < F.col("set_id_y"))))
        & (100 * F.least("size_x", "size_y") >= percent * F.greatest("size_x", "size_y"))
        & (scale * F.least("rest_x", "rest_y", common("x", "y"), common("y", "x")) >= F.col("w_x") + F.col("w_y")))
    return met.select(F.col("set_id_x").alias("a"), F.col("set_id_y").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """set_id, component: the smallest set id reachable, for all linked ids.

    Alternates the large-star and small-star steps (Kiveris et al.) until
    every id points straight at its component's smallest id.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(small_least.select("a", F.col("m").alias("b"))))
        edges = saved(small.where("a > b").distinct(), "star")
        parents = edges.select(F.col("b").alias("a")).distinct()
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        if not edges.join(parents, "a", "left_semi").select("a").union(twice).head(1):
            return edges.select(F.col("a").alias("set_id"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_id, component_id, kept for each row."""
    sketched = saved(sketch_documents(docs, text, width), "sketches")
    named = sketched.where("set_id is not null and doc_id is not null")
    classes = saved(named.groupBy("set_id").agg(
        F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    member = classes.select("set_id", "size", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("set_id", "size")).alias("_lead")).where("n > 1")
    member = saved(member.join(shared, "bucket").select(
        "bucket", "set_id", "size", F.col("_lead.set_id").alias("lead"), F.col("_lead.size").alias("lead_size")), "members")

    def sized(edges):
        """Edges (a, b of sizes sa, sb) once each, without those whose sizes rule them out."""
        possible = F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * percent
        return edges.where((F.col("a") != F.col("b")) & possible).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def label(links):
        """Components, and the members of buckets that still hold several."""
        comp = components(links)
        now = member.join(comp, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        order = F.xxhash64("set_id", "bucket")
        several = now.groupBy("bucket").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "set_id").alias("lead_component"),
            F.min_by("set_id", order).alias("other"), F.min_by("size", order).alias("other_size"),
            F.min_by("component", order).alias("other_component")).where("low < high")
        return comp, saved(now.join(several, "bucket"), "several")

    def star(comp):
        return comp.select(F.col("set_id").alias("a"), F.col("component").alias("b"))

    def confirmed(edges):
        return confirm(edges, classes, docs, text, width, percent)

    # one comparison of each member first; then, where a bucket still holds several components, with its lead, and with another
    first = member.groupBy("set_id", "size").agg(F.min(F.struct("lead", "lead_size")).alias("_lead"))
    seen = saved(sized(first.select(F.col("set_id").alias("a"), F.col("_lead.lead").alias("b"), F.col("size").alias("sa"),
                                    F.col("_lead.lead_size").alias("sb"))), "edges")
    comp, several = label(confirmed(seen))
    for side in ("lead", "other"):
        new = sized(several.where(F.col("component") != F.col(f"{side}_component"))
                    .select(F.col("set_id").alias("a"), F.col(side).alias("b"), F.col("size").alias("sa"), F.col(f"{side}_size").alias("sb")))
        new = saved(new.join(seen, ["a", "b"], "left_anti"), "edges")
        comp, several = label(star(comp).union(confirmed(new)))
        seen = seen.union(new)
    across = across_pairs(several, classes, docs, text, width, percent)
    across = across.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    across = saved(across.join(seen, ["a", "b"], "left_anti"), "edges")
    comp = components(star(comp).union(confirmed(across)))
    labelled = classes.select("set_id", "first_doc").join(comp, "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    smallest = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_set = labelled.join(smallest, "component").select("set_id", "component_id")
    out = sketched.select("doc_id", "text_hash", "n_shingles", "set_id").join(by_set, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns of ``docs``."""
    decided = near_duplicates(docs, text, width, percent).where("kept")
    stay = decided.where("doc_id is not null").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_hash"))
    nameless = packed.where("_id is null").select("_row")
    named = packed.where("_id is not null").join(stay, ["_id", "_hash"], "left_semi")
    return named.dropDuplicates(["_id", "_hash"]).select("_row").union(nameless).select("_row.*")
