"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ``ORDER`` counts which
byte follows. A byte's code length is that of its longest known context; a
context that does not know the byte pays its escape (method C: as many
escapes as distinct followers) and passes it on to the next shorter one, down
to a uniform byte. Statistics are frozen after training, so a text's exact
code length under every language is a sum over its bytes, and the language
with the shortest code wins.

All training documents are counted: each task counts the longest contexts
(their shorter ones are sums of them) before a shuffle adds them up. Every
node is kept, so that a rare language has its whole tree beside large ones.
The trees are laid out as tables of code lengths with a column for each
language, so that scoring looks up a byte once for all languages. The driver
fills the tables one language after the other in a file, which is sent once to
each executor by ``SparkContext.addFile`` and memory-mapped by its Python
workers: the model's size follows the training data, memory holds a few numbers
for each node.

Defined results: a null text, or one without letters, is ``und`` with score
0, as is any text if nothing can be learned from; an empty table gives an
empty table; equal texts get equal predictions.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import U64, StaticTable, pieces, saved

ORDER = 4
UNDETERMINED = "und"


def context_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER + 1 bytes at every byte of the lower-cased texts (zeros
    before a text's start), and where each text begins."""
    pad = bytes(ORDER)
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8).astype(U64)
    n = len(data) - ORDER
    keys = np.zeros(max(n, 0), U64)
    for k in range(ORDER + 1):
        keys = keys << U64(8) | data[k:k + n]
    length = np.array([len(r) for r in raw], np.int64)
    real = np.ones(max(n, 0), bool)
    starts = np.cumsum(length + ORDER) - length - ORDER  # of the pad before each text
    for k in range(ORDER):
        at = starts[1:] - ORDER + k
        real[at[(at >= 0) & (at < n)]] = False
    return keys[real], np.cumsum(length) - length


def count_contexts(docs: DataFrame, text: str = "text", lang: str = "lang", flush: int = 2_000_000) -> DataFrame:
    """lang, key, n: how often each longest context with its byte occurs."""

    def run(batches):
        sums: dict[str, list] = {}

        def rows():
            for name, parts in sums.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64)
                for a in range(0, len(keys), 100_000):
                    b = min(a + 100_000, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (b - a), pa.string()), pa.array(keys[a:b].view(np.int64)), pa.array(n[a:b])],
                        names=["lang", "key", "n"])
            sums.clear()

        for batch in pieces(batches, 0, 1 << 20):
            by: dict[str, list] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                sums.setdefault(name, []).append(np.unique(context_keys(texts)[0], return_counts=True))
            if sum(len(k) for parts in sums.values() for k, _ in parts) > flush:
                for name, parts in sums.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    sums[name] = [(keys, np.bincount(at, np.concatenate([c for _, c in parts])).astype(np.int64))]
                if sum(len(k) for parts in sums.values() for k, _ in parts) > flush // 2:
                    yield from rows()
        yield from rows()

    some = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    return some.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Arrays:
    """Arrays one after the other in a file, memory-mapped."""

    def __init__(self, path: str):
        self.path, self.at = path, {}
        self.size = 0
        open(path, "wb").close()

    def add(self, name: str, dtype, shape: tuple) -> np.ndarray:
        """A new array of zeros, to be filled."""
        self.at[name] = self.size, np.dtype(dtype), shape
        length = max(1, int(np.prod(shape)) * np.dtype(dtype).itemsize)
        out = np.memmap(self.path, np.uint8, "r+", self.size, (length,))  # extends the file
        self.size += -(-length // 64) * 64
        return out.view(np.ndarray)[:int(np.prod(shape)) * np.dtype(dtype).itemsize].view(dtype).reshape(shape)

    def put(self, name: str, value: np.ndarray):
        self.add(name, value.dtype, value.shape)[:] = value

    @staticmethod
    def load(path: str, at: dict) -> dict[str, np.ndarray]:
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
        return {name: data[a:a + int(np.prod(shape)) * dtype.itemsize].view(dtype).reshape(shape)
                for name, (a, dtype, shape) in at.items()}


class Trees:
    """Frozen statistics: for each order, code lengths of known (context, byte)
    and escape costs of known contexts, a column for each language.

    ``counts(lang)`` gives a language's longest contexts (each once) and how
    often they occur; it is asked twice for each."""

    def __init__(self, langs: list[str], counts, path: str):
        self.langs, self.name, self.tables = langs, os.path.basename(path), None
        file = Arrays(path)
        longest = np.empty(0, U64)
        for name in langs:
            longest = np.union1d(longest, counts(name)[0])
        nodes = [np.unique(longest & U64((1 << 8 * (order + 1)) - 1)) for order in range(ORDER + 1)]
        contexts = [np.unique(node >> U64(8)) for node in nodes]
        codes = [file.add(f"codes{k}", np.float32, (len(nodes[k]) if k else 256, len(langs))) for k in range(ORDER + 1)]
        escapes = [file.add(f"escapes{k}", np.float32, (len(contexts[k]), len(langs))) for k in range(ORDER + 1)]
        for column, name in enumerate(langs):
            keys, n = counts(name)
            known, lower = np.arange(256, dtype=U64), np.full(256, 8.0)
            for order, (node, context) in enumerate(zip(nodes, contexts)):
                at = np.searchsorted(node, keys & U64((1 << 8 * (order + 1)) - 1))
                number = np.bincount(at, n, len(node))
                of = np.searchsorted(context, node >> U64(8))
                total = np.bincount(of, number, len(context))
                distinct = np.bincount(of, number > 0, len(context))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(total > 0, np.log2((total + distinct) / np.maximum(distinct, 1)), 0.0)
                    direct = np.log2((total + distinct)[of] / number)
                suffix = node & U64((1 << 8 * max(order, 1)) - 1) if order else node
                code = np.where(number > 0, direct, escape[of] + lower[np.searchsorted(known, suffix)])
                if order == 0:  # any byte has a code, known or not
                    full = escape[0] + np.full(256, 8.0) if len(context) else np.full(256, 8.0)
                    full[node.astype(np.int64)] = code
                    known, lower = np.arange(256, dtype=U64), full
                else:
                    known, lower = node, code
                codes[order][:, column] = lower
                escapes[order][:, column] = escape
        for order in range(1, ORDER + 1):
            for name, keys in (("node", nodes[order]), ("context", contexts[order])):
                table = StaticTable(keys)
                file.put(f"{name}{order}_keys", table.keys)
                file.put(f"{name}{order}_rows", table.rows)
        self.at = file.at

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text (not empty) under each language."""
        if self.tables is None:
            self.tables = Arrays.load(SparkFiles.get(self.name), self.at)
            for name in [f"{x}{k}" for x in ("node", "context") for k in range(1, ORDER + 1)]:
                self.tables[name] = StaticTable.of(self.tables[f"{name}_keys"], self.tables[f"{name}_rows"])
        keys, start = context_keys(texts)
        cost = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            key = keys[left] & U64((1 << 8 * (order + 1)) - 1)
            row = self.tables[f"node{order}"].find(key)
            hit = row >= 0
            cost[left[hit]] += self.tables[f"codes{order}"][row[hit]]
            left, key = left[~hit], key[~hit]
            row = self.tables[f"context{order}"].find(key >> U64(8))
            cost[left[row >= 0]] += self.tables[f"escapes{order}"][row[row >= 0]]
        cost[left] += self.tables["codes0"][(keys[left] & U64(255)).astype(np.int64)]
        return np.add.reduceat(cost, start, axis=0, dtype=np.float64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Trees | None:
    counted = saved(count_contexts(docs, text, lang), "contexts")
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return None

    def counts(name):
        rows = counted.where(F.col("lang") == name).select("key", "n").toArrow()
        return rows["key"].to_numpy().view(U64), rows["n"].to_numpy()

    path = os.path.join(place := tempfile.mkdtemp(prefix="trees-"), f"{os.path.basename(place)}.bin")
    trees = Trees(langs, counts, path)
    docs.sparkSession.sparkContext.addFile(path)
    return trees


def predict(docs: DataFrame, trees: Trees | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred, score (the share of the shortest code's
    probability) and bits (its length)."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    width = len(keep)

    def run(batches):
        model = sent.value
        for batch in pieces(batches, width, 1 << 20):
            texts = [t or "" for t in batch.column(width).to_pylist()]
            pred, score, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if model and any(map(str.isalpha, t))]
            if some:
                length = model.lengths([texts[i] for i in some])
                best = length.argmin(axis=1)
                least = length[np.arange(len(some)), best]
                share = 1.0 / np.exp2(np.maximum(least[:, None] - length, -1000.0)).sum(axis=1)
                for i, b, s, x in zip(some, best.tolist(), share.tolist(), least.tolist()):
                    pred[i], score[i], bits[i] = model.langs[b], s, x
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                names=[*keep, "lang_pred", "score", "bits"])

    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits; learned from the rows that are
    not held out (crc32 of the id's text modulo 3 is 1)."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    marked = docs.select("doc_id", text, lang, out.alias("held_out"))
    trees = train(marked.where(~F.col("held_out")), text, lang)
    return predict(marked, trees, ["doc_id", "held_out"], text)
