"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones of a batch are held as one
ragged numpy array of symbols. Each round finds the lowest merge rank of every
pre-token and applies it to all of them at once; a pre-token without a
mergeable pair leaves the array, and its surviving symbols are its count. A
text's count is the sum over its pre-tokens. No ids are made.

A very long pre-token (one "word" of thousands of bytes) would have the array
rewritten once for each of its ranks. It is merged alone: its symbols are a
linked list, and the places of each rank are kept, so that a round touches the
places it merges only.

A batch is cut so that memory is bounded: long texts are read in slices that
end where white space follows another character, which no pre-token crosses.
Counts of pre-tokens are remembered by a task in two generations of bounded
size; those used lately stay.

Defined results: a null text is empty and has no bytes and no tokens; a special
token's string in a text is one token, as the file asks; an empty table gives
an empty table; other columns than id and text are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import U64, StaticTable, pieces

#: Pre-tokens of one generation of the memo, and letters of the longest one it holds.
MEMO, MEMO_LETTERS = 250_000, 64
#: Bytes of a pre-token that is merged alone.
LONG = 2_048
#: Characters of a slice of a text.
SLICE = 1 << 20
NONE = np.int32(2 ** 31 - 1)

# Fixed value: the pre-token pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRETOKENS = regex.compile(PATTERN)
_CUT = re.compile(r"(?<=\S)\s")


class MergeTable:
    """Ranks and results of a byte-level BPE file's merges."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], U64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = StaticTable(keys)
        made = {int(t): r for r, t in reversed(list(enumerate(self.merged)))}
        # one merge per token, after its parts': then equal pairs of a sequence can go together
        if len(made) < len(pairs) or any(max(made.get(int(k) >> 32, -1), made.get(int(k) & 0xFFFFFFFF, -1)) >= r
                                         for r, k in enumerate(keys)):
            raise ValueError("merges must make each token once, after the tokens it is made of")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        signs = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(sorted({*range(0x100)} - {*plain}))}
        self.byte = np.array([vocab[signs[b]] for b in range(0x100)], np.int32)
        left, right = np.divmod(np.arange(0x10000), 0x100)
        self.first = self.rank(self.byte[left], self.byte[right])  # of two bytes, by both
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE if it has none."""
        row = self.table.find(left.astype(U64) << U64(32) | right.astype(U64))
        return np.where(row >= 0, row, NONE).astype(np.int32)


def alternate(follows: np.ndarray) -> np.ndarray:
    """Which of some places in order are merged, if a place that ``follows``
    the one before overlaps it: every second one of a run, from the left."""
    start = np.flatnonzero(~follows)
    nth = np.arange(len(follows)) - np.repeat(start, np.diff(np.append(start, len(follows))))
    return nth % 2 == 0


def count_ragged(words: list[bytes], merges: MergeTable) -> np.ndarray:
    """Symbols left of each non-empty byte string when no pair can be merged."""
    out = np.zeros(len(words), np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    row = np.arange(len(words))  # of each sequence in the array
    ids = merges.byte[data]
    rank = np.full(len(ids), NONE)  # of the pair that begins at a symbol
    rank[:-1] = merges.first[data[:-1].astype(np.int64) << 8 | data[1:]]
    rank[np.cumsum(size) - 1] = NONE
    while len(row):
        start = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, start)
        done = best == NONE
        if done.any():
            out[row[done]] = size[done]
            left = np.repeat(~done, size)
            ids, rank = ids[left], rank[left]
            row, size, best = row[~done], size[~done], best[~done]
            if not len(row):
                break
        at = np.flatnonzero(rank == np.repeat(best, size))
        at = at[alternate(np.diff(at, prepend=-2) == 1)]
        ids[at] = merges.merged[rank[at]]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        last = np.zeros(len(ids), bool)
        last[np.cumsum(size) - 1] = True
        tail = last[at + 1]  # the merged symbol ends its sequence
        sequence = np.repeat(np.arange(len(size)), size)
        size = size - np.bincount(sequence[at], minlength=len(size))
        new = np.cumsum(keep)[at] - 1
        ids, rank = ids[keep], rank[keep]
        rank[new] = NONE
        head = np.zeros(len(ids), bool)
        head[np.cumsum(size) - size] = True
        after, before = new[~tail], new[~head[new]] - 1
        at = np.concatenate([after, before])
        rank[at] = merges.rank(ids[at], ids[at + 1])
    return out


def count_long(word: bytes, merges: MergeTable) -> int:
    """The same of one long byte string, by a linked list."""
    data = np.frombuffer(word, np.uint8)
    n = len(data)
    ids = merges.byte[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n + 1, NONE)
    rank[:n - 1] = merges.first[data[:-1].astype(np.int64) << 8 | data[1:]]
    places: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []
    left = n

    def note(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        at = at[np.argsort(rank[at], kind="stable")]
        values, start = np.unique(rank[at], return_index=True)
        for r, group in zip(values.tolist(), np.split(at, start[1:])):
            if r not in places:
                places[r] = []
                heapq.heappush(ranks, r)
            places[r].append(group)

    note(np.arange(n - 1))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(places.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = at[alternate(np.concatenate([[False], after[at[:-1]] == at[1:]]))]
        gone = after[at]
        ids[at] = merges.merged[r]
        rank[gone] = NONE
        after[at] = after[gone]
        inner = at[after[at] < n]
        before[after[inner]] = inner
        left -= len(at)
        rank[at] = NONE
        rank[inner] = merges.rank(ids[inner], ids[after[inner]])
        prior = before[at]
        prior = prior[prior >= 0]
        rank[prior] = merges.rank(ids[prior], ids[after[prior]])
        note(np.unique(np.concatenate([inner, prior])))
    return left


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``most`` characters that pre-tokens do not cross."""
    start = 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if not cut:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Counts:
    """Token counts of texts under one file."""

    def __init__(self, path: str):
        self.merges = MergeTable(path)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _counted(self, words: set[str]) -> dict[str, int]:
        """The count of each pre-token, remembered or merged now."""
        if len(self.young) > MEMO:
            self.young, self.old = {}, self.young
        known = self.young
        new = [w for w in words if w not in known]
        back = {w: self.old[w] for w in new if w in self.old}
        known.update(back)
        raw = [(w, w.encode("utf-8", "surrogatepass")) for w in new if w not in back]
        short = [(w, b) for w, b in raw if len(b) <= LONG]
        found = dict(zip([w for w, _ in short], count_ragged([b for _, b in short], self.merges).tolist())) if short else {}
        known.update((w, n) for w, n in found.items() if len(w) <= MEMO_LETTERS)
        return {w: n for w, n in found.items() if len(w) > MEMO_LETTERS} | {
            w: count_long(b, self.merges) for w, b in raw if len(b) > LONG}

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; texts are taken in slices, many short ones together."""
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        letters = 0

        def settle():
            rare = self._counted(set().union(*[words for _, words in held]))
            known = self.young
            for i, words in held:
                out[i] += sum(map(known.__getitem__, words)) if not rare else sum(
                    known[w] if w in known else rare[w] for w in words)
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.marks.search(text):
                parts = self.marks.split(text)
                out[i] += len(parts) - 1
            for part in chain.from_iterable(map(slices, parts)):
                held.append((i, _PRETOKENS.findall(part)))
                letters += len(part)
                if letters > SLICE:
                    settle()
                    letters = 0
        settle()
        return out


@functools.lru_cache(maxsize=1)
def counts(path: str) -> Counts:
    """One for each worker and file."""
    return Counts(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each text."""

    def run(batches):
        c = counts(path)
        for batch in pieces(batches, 1, 2 << 20):
            n = pa.array(c.count(batch.column(1).to_pylist()), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)],
                                             names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
