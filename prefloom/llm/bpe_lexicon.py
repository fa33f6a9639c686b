"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's most frequent chunks (a word with the white space before it) are
counted over all documents, encoded once and compiled into a minimal acyclic
automaton whose arcs carry the number of words they skip: the sum along a
word's path is its number, which points at its token ids. Equal suffixes
share states. The automaton is one file, sent to every executor by
``SparkContext.addFile`` and memory-mapped by its Python workers, which so
share its pages. Chunks that it does not hold are merged exactly: all unseen
chunks of a batch together, lowest rank first, as array operations.

A chunk ends where white space follows a character that is not white space;
no pre-token of the byte-level pattern crosses such a place, and its split
depends on the chunk alone, so chunks encode independently.

Defined results: a null text is empty and has no ids; texts of any length go
through chunk by chunk; the special token's string in a text becomes its id,
as the tokenizer's file asks; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import json
import os
import re
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import U64, StaticTable, most_frequent, pieces, saved

#: Words of the lexicon, the most frequent chunks of the corpus.
LEXICON_WORDS = 32_768
#: Chunks of one generation that a worker remembers, and letters of the longest one.
MEMO, MEMO_LETTERS = 200_000, 64
#: Counters of a task that counts chunks.
COUNTERS = 200_000

# The pre-token pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRETOKENS = regex.compile(PATTERN)
_ODD_SPACE = re.compile(r"\s[ \n]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """The merge table of a BPE file, applied to many byte strings at once."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        key = [vocab[a] << 32 | vocab[b] for a, b in pairs]
        first = dict(zip(reversed(key), range(len(key) - 1, -1, -1)))  # a repeated pair keeps its best rank
        self.ranks = np.array(list(first.values()), np.int64)
        self.table = StaticTable(np.array(list(first), U64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        symbols = byte_symbols()
        self.byte = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)

    def _rank(self, left, right):
        row = self.table.find(left.astype(U64) << U64(32) | right.astype(U64))
        return np.where(row >= 0, self.ranks[row], _NONE)

    def apply(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each non-empty byte string, as little-endian 32-bit numbers."""
        out: list = [None] * len(words)
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.byte[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(start, len(ids)))
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            if done.any():
                left = np.repeat(~done, size)
                raw, stop = ids[~left].astype("<u4").tobytes(), (np.cumsum(size[done]) * 4).tolist()
                for word, a, b in zip(owner[start[done]].tolist(), [0, *stop], stop):
                    out[word] = raw[a:b]
                ids, owner, rank = ids[left], owner[left], rank[left]
                best, size = best[~done], size[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # of overlapping equal pairs (x x x) every second one is merged, from the left
            run = np.concatenate([[True], np.diff(at) > 1])
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[nth % 2 == 0]
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = (np.cumsum(keep) - 1)[at]
            ids, owner = ids[keep], owner[keep]
            rank = rank[keep]
            rank[new] = _NONE
            near = np.unique(np.concatenate([new, new - 1]))
            near = near[(near >= 0) & (near + 1 < len(ids))]
            same = owner[near] == owner[near + 1]
            rank[near[~same]] = _NONE
            near = near[same]
            rank[near] = self._rank(ids[near], ids[near + 1])
        return out


_NONE = np.int64(1 << 40)


class Lexicon:
    """A minimal acyclic automaton over byte strings with id outputs."""

    PARTS = [("keys", "<u8"), ("rows", "<i4"), ("to", "<i4"), ("skip", "<i4"), ("final", "<i1"), ("start", "<i4"), ("ids", "<i4")]

    @staticmethod
    def compile(entries: dict[bytes, np.ndarray]) -> bytes:
        """The file of an automaton for the entries (added in sorted order,
        each new suffix merged with an equal one already there)."""
        words = sorted(entries)
        nodes: list[tuple[bool, tuple]] = []
        counts: list[int] = []
        known: dict[tuple[bool, tuple], int] = {}

        def settle(final: bool, arcs: list) -> int:
            node = (final, tuple(arcs))
            if node not in known:
                known[node] = len(nodes)
                nodes.append(node)
                counts.append(final + sum(counts[to] for _, to in arcs))
            return known[node]

        path: list[list] = [[False, []]]  # the unfinished states of the last word
        last = b""
        for word in [*words, b""]:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
            for _ in word[same:]:
                path.append([False, []])
            path[-1][0] = path[-1][0] or bool(word)
            last = word
        root = settle(*path[0])
        keys, to, skip = [], [], []
        for state, (final, arcs) in enumerate(nodes):
            before = int(final)
            for byte, target in arcs:
                keys.append(state << 8 | byte)
                to.append(target)
                skip.append(before)
                before += counts[target]
        table = StaticTable(np.array(keys, U64))
        ids = [entries[w] for w in words]
        parts = {"keys": table.keys, "rows": table.rows, "to": np.array(to), "skip": np.array(skip),
                 "final": np.array([f for f, _ in nodes]), "start": np.cumsum([0, *map(len, ids)]),
                 "ids": np.concatenate(ids) if ids else np.zeros(0)}
        raw = [np.ascontiguousarray(parts[k], t).tobytes() for k, t in Lexicon.PARTS]
        head = json.dumps({"root": root, "bits": table.bits, "sizes": [len(r) for r in raw]}).encode()
        body = b"".join(r + bytes(-len(r) % 8) for r in raw)
        return len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8) + body

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still mapped; slices of a plain array are cheaper
        size = int(data[:8].view("<u8")[0])
        head = json.loads(bytes(data[8:8 + size]))
        at = 8 + size + -size % 8
        for (name, kind), n in zip(self.PARTS, head["sizes"]):
            setattr(self, name, data[at:at + n].view(kind))
            at += n + -n % 8
        self.root = head["root"]
        self.table = StaticTable.__new__(StaticTable)
        self.table.bits, self.table.keys, self.table.rows = head["bits"], self.keys, self.rows

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words that are not held."""
        lengths = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        number = np.zeros(len(words), np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        number[lengths == 0] = -1
        while len(live):
            arc = self.table.find(state[live].astype(U64) << U64(8) | data[begin[live] + step].astype(U64))
            number[live[arc < 0]] = -1
            live, arc = live[arc >= 0], arc[arc >= 0]
            number[live] += self.skip[arc]
            state[live] = self.to[arc]
            step += 1
            ended = lengths[live] == step
            number[live[ended & (self.final[state[live]] == 0)]] = -1
            live = live[~ended]
        return number


class Codec:
    """Encoder and decoder of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        raw = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            plain = all(c in raw for c in token)
            self.bytes[i] = bytes(raw[c] for c in token) if plain else token.encode()
        self.lexicon: Lexicon | None = None
        self.chunks: dict[str, bytes] = {}  # of a word that follows a space, or of a line's start
        self.others: dict[str, bytes] = {}  # of chunks and pre-tokens as they are
        self.old: tuple[dict, dict] = ({}, {})  # the generation before

    def _renew(self) -> None:
        """Memos beyond their size become the older generation; long entries go."""
        if len(self.chunks) > MEMO or len(self.others) > MEMO:
            self.old = tuple({w: x for w, x in memo.items() if len(w) <= MEMO_LETTERS} for memo in (self.chunks, self.others))
            self.chunks, self.others = {}, {}

    def _unseen(self, words: set[str], which: int) -> list[str]:
        """Words in neither generation of a memo; those of the older one come back."""
        memo, old = (self.chunks, self.others)[which], self.old[which]
        new = words.difference(memo)
        if old:
            back = {w: old[w] for w in new if w in old}
            memo.update(back)
            new.difference_update(back)
        return list(new)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        out: list = [None] * len(chunks)
        number = self.lexicon.find([c.encode() for c in chunks]) if self.lexicon else np.full(len(chunks), -1)
        held = np.flatnonzero(number >= 0)
        if len(held):
            start = self.lexicon.start
            for i, a, b in zip(held.tolist(), start[number[held]].tolist(), start[number[held] + 1].tolist()):
                out[i] = self.lexicon.ids[a:b].tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        split = [_PRETOKENS.findall(chunks[i]) for i in rest]
        unseen = [p for p in dict.fromkeys(p for s in split for p in s) if p not in self.others]
        for p, ids in zip(unseen, self.merges.apply([p.encode() for p in unseen]) if unseen else []):
            self.others[p] = ids
        for i, s in zip(rest, split):
            out[i] = b"".join(map(self.others.__getitem__, s))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        self._renew()
        parts = [self.marks.split(t) if self.marks.search(t) else [t] for t in texts]
        marks = [self.marks.findall(t) if len(p) > 1 else [] for t, p in zip(texts, parts)]
        flat = [chunked(p) for s in parts for p in s]
        unseen = self._unseen(set().union(*[after for _, after in flat]), 0)
        if unseen:
            self.chunks.update(zip(unseen, self.encode_chunks([w if w[:1] == "\n" else " " + w for w in unseen])))
        unseen = self._unseen(set().union(*[first for first, _ in flat]), 1)
        if unseen:
            self.others.update(zip(unseen, self.encode_chunks(unseen)))
        ids = iter([b"".join([*map(self.others.__getitem__, first), *map(self.chunks.__getitem__, after)])
                    for first, after in flat])
        out = []
        for split, found in zip(parts, marks):
            row = [next(ids)]
            for mark in found:
                row += [self.special[mark].to_bytes(4, "little"), next(ids)]
            out.append(b"".join(row))
        return out

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, tokens)).decode("utf-8", "replace")


def chunked(text: str) -> tuple[list[str], list[str]]:
    """(chunks as they are, words that each follow a space or start a line).

    Texts with runs of white space are split into pre-tokens instead."""
    if _ODD_SPACE.search(text):
        return _PRETOKENS.findall(text), []
    first, *after = text.replace("\n", " \n").split(" ")
    return [first] if first else [], after


@functools.lru_cache(maxsize=1)
def codec(path: str, lexicon: str | None = None) -> Codec:
    """One codec for each worker, file and lexicon (by its file's name)."""
    c = Codec(path)
    if lexicon:
        c.lexicon = Lexicon(SparkFiles.get(lexicon))
    return c


def thinned(count: Counter) -> Counter:
    """The counters without the rarer half: the median count is taken off all
    of them and those that reach zero go (Misra and Gries), so a chunk's count
    is low by at most the sum of what was taken off."""
    off = int(np.partition(np.fromiter(count.values(), np.int64, len(count)), len(count) // 2)[len(count) // 2])
    return Counter({w: n - off for w, n in count.items() if n > off})


def chunk_counts(docs: DataFrame, text: str = "text", most: int = COUNTERS) -> DataFrame:
    """chunk, n over all documents, for the choice of the lexicon's words.

    A task keeps at most about ``most`` counters (see ``thinned``), whatever
    its texts, and sends each once; so counts of chunks that are rare in every
    task are low or missing, those of frequent ones low by a few. The choice
    affects speed only: words outside the lexicon are merged exactly."""

    def run(batches):
        count: Counter = Counter()
        for batch in pieces(batches, 0, 2 << 20):
            after: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    first, rest = chunked(t)
                    count.update(first)
                    after.update(rest)
            for w, n in after.items():
                count[w if w[:1] == "\n" else " " + w] += n
            if len(count) > most:
                count = thinned(count)
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                         names=["chunk", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent chunks; returns the name under which
    executors find the file."""
    top = most_frequent(saved(chunk_counts(docs, text), "chunks"), words, ["chunk"])
    chunks = [r[0] for r in top.select("chunk").collect()]  # bounded by ``words``
    c = Codec(path)
    chunks = [x for x in chunks if x and not c.marks.search(x)]
    entries = {x.encode(): np.frombuffer(ids, "<u4") for x, ids in zip(chunks, c.encode_chunks(chunks))}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(place, "wb") as f:
        f.write(Lexicon.compile(entries))
    docs.sparkSession.sparkContext.addFile(place)
    return name


def encode(docs: DataFrame, path: str, text: str = "text", lexicon: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit numbers) and, if asked, the
    text decoded from these ids."""
    lexicon = lexicon or build_lexicon(docs, path, text)

    def run(batches):
        c = codec(path, lexicon)
        for batch in pieces(batches, 1, 2 << 20):
            ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decoded:
                columns.append(pa.array([c.decode(x) for x in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""

    def run(batches):
        c = codec(path)
        for batch in pieces(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
