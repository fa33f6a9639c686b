"""Repeated passages by sparse suffix arrays.

Of a text's suffixes (one for each word) only those are retained that begin at
a minimiser: the smallest hash of ``GRAM`` words within ``LENGTH`` words. Any
two passages of ``LENGTH`` equal words retain a suffix at the same place, so
retained suffixes whose first words occur in one text alone go. The others
are sorted by their words (right context, then the words to the left), each
is compared with its neighbours in that order, and matches are extended to
the left and right; matches of ``LENGTH`` words or more are repeated passages.
Within reach of one suffix a match extends ``LENGTH`` words; longer passages
are the union of their suffixes' matches.

A neighbour in the order shares the most words to the right, not to both
sides, so where three suffixes or more begin with the same words a partner may
be missed by its neighbours. There the windows of ``LENGTH`` words around the
suffix are hashed whole, and those that no match covers yet and that occur in
another text are passages as well (grouped by hash, never paired); with two
suffixes the comparison is complete.

The sort is a range exchange on the whole order, so a passage that a third of
all documents share spreads over many tasks; the rows at the tasks' edges are
compared in a second, small step. Documents with equal text are compared
once; if they have ``LENGTH`` words, all of them are repeated as a whole.

Defined results: null and short texts have no passages; a text that repeats a
passage only within itself has none; rows with equal id and text are copies;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import GOLDEN, U64, mix64, pieces, saved
from prefloom.llm.fast_minhash import word_hashes

LENGTH = 50
GRAM = 12
#: Documents with candidates are fetched by a broadcast of their ids up to so many.
BROADCAST_IDS = 1_000_000


def minimisers(words: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a text's retained suffixes and the hashes of their first words."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = words[:len(words) - gram + 1].copy()
    for k in range(1, gram):
        grams = mix64(grams * U64(GOLDEN) + words[k:len(words) - gram + 1 + k])
    window = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
    at = np.unique(window.argmin(axis=1) + np.arange(len(window)))
    return at, grams[at]


def _words(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    words, first = word_hashes([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()], fold=False)
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def retained(docs: DataFrame, text: str = "text") -> DataFrame:
    """text_hash, gram: the retained suffixes of every text (narrow)."""

    def run(batches):
        for batch in pieces(batches, 1):
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            found = [minimisers(w)[1] for w in _words(batch, 1)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(hashes, [len(g) for g in found]), pa.int64()),
                pa.array((np.concatenate(found) if found else np.zeros(0, U64)).view(np.int64))], names=["text_hash", "gram"])

    return _hashed(docs, text).mapInArrow(run, "text_hash long, gram long")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))


_SUFFIX = "gram long, right binary, left binary, text_hash long, at int"


def suffixes(texts: DataFrame) -> DataFrame:
    """The retained suffixes whose gram is listed for their text, with the words
    that follow and (reversed) precede them as big-endian 32-bit hashes."""
    reach = LENGTH - GRAM

    def run(batches):
        for batch in pieces(batches, 1):
            rows: list[tuple] = []
            for h, words, listed in zip(batch.column(0).to_pylist(), _words(batch, 1), batch.column(2).to_pylist()):
                at, grams = minimisers(words)
                short = np.maximum(words >> U64(32), U64(1)).astype(">u4")
                for p, g in zip(at.tolist(), grams.view(np.int64).tolist()):
                    if g in (wanted := listed if isinstance(listed, set) else set(listed)):
                        rows.append((g, short[p:p + LENGTH].tobytes(), short[max(0, p - reach):p][::-1].tobytes(), h, p))
                    listed = wanted
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()))],
                names=["gram", "right", "left", "text_hash", "at"])

    return texts.select("text_hash", "text", "grams").mapInArrow(run, _SUFFIX)


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column), ">u4").reshape(-1, width)


def matches(rows: list[tuple]) -> list[tuple]:
    """(text_hash, start, stop, other) of sorted suffixes that match a
    neighbour, the nearest row of another text on either side."""
    if len(rows) < 2:
        return []
    gram = np.array([r[0] for r in rows])
    text = np.array([r[3] for r in rows])
    at = np.array([r[4] for r in rows])
    right, left = _matrix([r[1] for r in rows], LENGTH), _matrix([r[2] for r in rows], LENGTH - GRAM)
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(rows))
    out = []
    for other in (begin[run] - 1, end[run]):
        i = np.flatnonzero((other >= 0) & (other < len(rows)))
        j = other[i]
        i, j = i[gram[i] == gram[j]], j[gram[i] == gram[j]]

        def shared(m):
            same = (m[i] == m[j]) & (m[i] != 0)
            return np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1))

        r, l = shared(right), shared(left)  # noqa: E741
        ok = r + l >= LENGTH
        out += zip(text[i][ok].tolist(), (at[i] - l)[ok].tolist(), (at[i] + r)[ok].tolist(), text[j][ok].tolist())
    return out


def _compare(batches):
    """Matches of sorted suffixes, and the rows at both ends of the task."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
    names = ["text_hash", "start", "stop", "other", "gram", "right", "left", "edge_text", "at"]

    def emit(found, edges=()):
        rows = [(*f, None, None, None, None, None) for f in found] + [(None, None, None, None, *e) for e in edges]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def ends(rows, backwards):
        """The outer run of one text and the first row of the next."""
        out = []
        for r in reversed(rows) if backwards else rows:
            out.append(r)
            if (r[0], r[3]) != (out[0][0], out[0][3]):
                break
        return out[::-1] if backwards else out

    head: list[tuple] | None = None
    carried: list[tuple] = []
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            some = batch.slice(a, 4096)
            new = list(zip(*[c.to_pylist() for c in some.columns]))
            if carried and (carried[0][0], carried[0][3]) == (new[-1][0], new[-1][3]):
                carried += new  # all of one run, which is compared when it ends
                continue
            rows = carried + new
            head = ends(rows, False) if head is None or len(head) < 2 else head
            yield emit(set(matches(rows)))
            carried = ends(rows, True)
    if carried:
        head = ends(carried, False) if head is None else head
        yield emit((), dict.fromkeys(head + carried))


_COMPARED = ("text_hash long, start int, stop int, other long, gram long, right binary, left binary, edge_text long, at int")


def window_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` words from each place on."""
    n = len(words) - LENGTH + 1
    out = words[:n].copy()
    for k in range(1, LENGTH):
        out = mix64(out * U64(GOLDEN) + words[k:n + k])
    return out


def windows_around(texts: DataFrame) -> DataFrame:
    """text_hash, start, window, open: the windows that hold a listed suffix
    (``at``) of their text whole, and whether they lie in none of its ``spans``."""

    def run(batches):
        for batch in pieces(batches, 1):
            hashes, starts, windows, opens = [], [], [], []
            for h, words, at, spans in zip(batch.column(0).to_pylist(), _words(batch, 1), batch.column(2).to_pylist(),
                                           batch.column(3).to_pylist()):
                n = len(words) - LENGTH + 1
                near = np.zeros(n + 1, np.int64)  # windows from p - (LENGTH - GRAM) to p hold the suffix at p
                at = np.array(at, np.int64)
                np.add.at(near, np.maximum(at - (LENGTH - GRAM), 0), 1)
                np.add.at(near, np.minimum(at + 1, n), -1)
                near = np.flatnonzero(np.cumsum(near)[:n])
                open_ = np.ones(n, bool)
                for x in spans or ():
                    open_[x["start"]:max(x["start"], x["stop"] - LENGTH + 1)] = False
                hashes.append(np.full(len(near), h, np.int64))
                starts.append(near)
                windows.append(window_hashes(words)[near])
                opens.append(open_[near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(starts), pa.int32()),
                 pa.array(np.concatenate(windows).view(np.int64)), pa.array(np.concatenate(opens))],
                names=["text_hash", "start", "window", "open"])

    return texts.select("text_hash", "text", "at", "spans").mapInArrow(run, "text_hash long, start int, window long, open boolean")


def merged_spans(found: DataFrame) -> DataFrame:
    """text_hash, spans: overlapping matches of a text as one passage; a text's
    matches are as many as its retained suffixes."""
    return found.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("m")).select(
        "text_hash", F.expr(
            "aggregate(m, cast(array() as array<struct<start:int,stop:int>>), (a, x) ->"
            " if(size(a) > 0 and element_at(a, -1).stop >= x.start,"
            " concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,"
            " 'stop', greatest(element_at(a, -1).stop, x.stop)))), concat(a, array(x))))").alias("spans"))


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, n_words, n_copies (documents of the same
    text): each maximal repeated passage of each document."""
    kept = saved(retained(docs, text), "retained")
    shared = kept.groupBy("gram").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high")
    wanted = saved(kept.join(shared.select("gram"), "gram", "left_semi").distinct().groupBy("text_hash").agg(
        F.collect_list("gram").alias("grams")), "wanted")
    some = _hashed(docs, text)
    ids = wanted.select("text_hash")
    some = some.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "text_hash", "left_semi")
    texts = saved(some.dropDuplicates(["text_hash"]).join(wanted, "text_hash"), "texts")
    rows = saved(suffixes(texts), "suffixes")
    order = ["gram", "right", "left", "text_hash", "at"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
    compared = saved(dealt.mapInArrow(_compare, _COMPARED), "compared")
    edges = compared.where("gram is not null").select("gram", "right", "left", F.col("edge_text").alias("text_hash"), "at")
    edges = edges.coalesce(1).sortWithinPartitions(*order).mapInArrow(_compare, _COMPARED)  # a few rows of each task
    found = saved(compared.union(edges).where("text_hash is not null").select("text_hash", "start", "stop").distinct(), "matches")
    many = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("gram")
    at = rows.select("gram", "text_hash", "at").join(many, "gram", "left_semi").groupBy("text_hash").agg(F.collect_list("at").alias("at"))
    around = texts.select("text_hash", "text").join(at, "text_hash").join(merged_spans(found), "text_hash", "left")
    windows = saved(windows_around(around), "windows")
    twice = windows.groupBy("window").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"),
                                          F.bool_or("open").alias("open")).where("open and low < high")
    also = windows.where("open").join(twice.select("window"), "window", "left_semi").select(
        "text_hash", "start", (F.col("start") + LENGTH).alias("stop"))
    merged = merged_spans(found.union(also))
    spaces = " \t\n\x0b\x0c\r"
    trimmed = F.btrim(F.col(text), F.lit(spaces))
    named = docs.where(F.col(text).isNotNull()).select(
        "doc_id", F.xxhash64(text).alias("text_hash"),
        F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"[{spaces}]+"))).alias("words"))
    named = saved(named, "named")
    copies = named.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n_copies"))
    out = named.join(copies, "text_hash").join(merged, "text_hash", "left")
    whole = (F.col("n_copies") > 1) & (F.col("words") >= LENGTH)
    spans = F.when(whole, F.array(F.struct(F.lit(0).alias("start"), F.col("words").alias("stop")))).otherwise(F.col("spans"))
    return out.select("doc_id", "n_copies", F.explode(spans).alias("s")).select(
        "doc_id", F.col("s.start").alias("start_word"), F.col("s.stop").alias("end_word"),
        (F.col("s.stop") - F.col("s.start")).alias("n_words"), "n_copies")
