"""Token-ID output by a static range asymmetric numeral system.

Documents are dealt by ascending id, encoded by the tokenizer's library and
grouped into blocks of whole documents. One frequency table, counted over all
blocks, serves every block. A block's tokens are dealt to interleaved coder
states ("lanes"; token ``i`` belongs to lane ``i mod lanes``), which share one
stream of 32-bit words. Every ``CHECKPOINT`` steps a block stores the states
and the place in the stream, so that parts of a block decode in parallel, and
each block ends with a CRC-32.

The file format is a folder of three Parquet tables, written and read by
Spark: ``frequencies`` (id, frequency out of 2^SCALE), ``blocks`` (task,
block, before, doc_ids, lengths, payload; ``before`` counts the task's ids
before the block) and ``starts`` (task, start: the ids of all
documents before the task's). Blocks in (task, block) order are the ids in
ascending doc_id order.

The library encodes distinct pieces only: white space separates pieces in
this tokenizer, so a text's ids are those of its pieces, and a piece of Latin
letters, digits and signs is cut as the tokenizer's pattern cuts it. A worker
remembers words and pieces it has seen. The words of a batch are numbered, so
that only distinct ones are looked up, and their ids gathered as one array.

Defined results: a null text is empty and has the end id alone; a null id
comes first; rows that repeat an id follow each other by text hash; a
document longer than a block is a block of its own; an empty table gives
empty tables.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.llm.bpe_lexicon import byte_symbols
from prefloom.llm.common import U64, pieces
from prefloom.session import checkpoint_root, scratch_path

END_ID = 2
SCALE = 20
LANES = 1024
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 128
#: Words of one generation that a worker remembers.
MEMO = 500_000
#: The starts, a row for each task of the writer, are broadcast up to so many.
BROADCAST_TASKS = 1_000_000
#: A row holds a block: writers look at their sizes after each one, so that pages, groups of rows and with them
#: readers' buffers stay small (the default is 100 rows of half a megabyte at least).
SMALL_PAGES = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
# The tokenizer's pattern, for lower-case text in the range of _LATIN (where NFC changes nothing).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN = "^[!-~\u00a1-\u024f]+$"
_SIGNS = string.punctuation
_LOW = U64(1 << 31)
_HEAD = np.dtype([("magic", "<u4"), ("lanes", "<u4"), ("tokens", "<u8"), ("words", "<u8"), ("marks", "<u4"), ("every", "<u4")])
_MAGIC = 0x31534E41


class FrequencyTable:
    """Frequencies that add up to 2^SCALE, at least 1 for each id in use."""

    def __init__(self, frequency: np.ndarray):
        self.frequency = frequency.astype(U64)
        self.first = np.concatenate([np.zeros(1, U64), np.cumsum(self.frequency)[:-1]])
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint16 if len(frequency) <= 1 << 16 else np.uint32),
                                frequency.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Frequencies in proportion to the counts; rounding goes to the largest."""
        total, whole = int(counts.sum()), 1 << SCALE
        if not total:
            return np.zeros(len(counts), np.int64)
        used = int((counts > 0).sum())
        share = (counts > 0) + np.floor(counts * ((whole - used) / total)).astype(np.int64)
        share[int(np.argmax(counts))] += whole - int(share.sum())
        return share


def encode_block(ids: np.ndarray, table: FrequencyTable, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """Header, marks (step's stream place and states), states, words, CRC-32."""
    ids = np.asarray(ids, np.int64)
    state = np.full(lanes, _LOW, U64)
    steps = -(-len(ids) // lanes)
    out: list[np.ndarray] = []
    written, marks = 0, []
    limit = U64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        row = ids[step * lanes:(step + 1) * lanes]
        f, first = table.frequency.take(row), table.first.take(row)
        x = state[:len(row)]
        full = x >= (f << limit)
        at = np.flatnonzero(full)
        if len(at):
            out.append(x.astype("<u4").take(at))  # the low half
            written += len(at)
            x >>= full.astype(U64) << U64(5)
        quotient = x // f
        x += quotient * (U64(1 << SCALE) - f) + first  # the quotient goes up by SCALE bits, the remainder stays
        if step and step % every == 0:
            marks.append((step, written, state.copy()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    head = np.array([(_MAGIC, lanes, len(ids), len(stream), len(marks), every)], _HEAD)
    # a mark holds the states with which decoding of its step begins
    body = b"".join([head.tobytes(), *[np.array([s, len(stream) - w], "<u8").tobytes() + x.astype("<u8").tobytes()
                                       for s, w, x in reversed(marks)],
                     state.astype("<u8").tobytes(), stream.tobytes()])
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode_block(payload: bytes, table: FrequencyTable, part: int | None = None) -> np.ndarray:
    """All ids of a block, or those from its mark ``part`` (0: the start) to the next."""
    if zlib.crc32(payload[:-4]) != int.from_bytes(payload[-4:], "little"):
        raise ValueError("block checksum differs")
    head = np.frombuffer(payload, _HEAD, 1)[0]
    if head["magic"] != _MAGIC:
        raise ValueError("not a block")
    lanes, tokens, marks, every = (int(head[k]) for k in ("lanes", "tokens", "marks", "every"))
    size, at = 16 + 8 * lanes, _HEAD.itemsize
    begin, last, place = 0, -(-tokens // lanes), 0
    states = at + marks * size
    if part is not None and part > 0:
        mark = at + (part - 1) * size
        begin, place = (int(v) for v in np.frombuffer(payload, "<u8", 2, mark))
        states_at = mark + 16
    else:
        states_at = states
    if part is not None and part < marks:
        last = int(np.frombuffer(payload, "<u8", 1, at + part * size)[0])
    state = np.frombuffer(payload, "<u8", lanes, states_at).astype(U64)
    stream = np.frombuffer(payload, "<u4", int(head["words"]), states + 8 * lanes).astype(U64)
    out = np.empty(max(0, min(last * lanes, tokens) - begin * lanes), table.symbol.dtype)
    mask = U64((1 << SCALE) - 1)
    for step in range(begin, last):
        n = min(lanes, tokens - step * lanes)
        x = state[:n]
        slot = x & mask
        symbol = table.symbol.take(slot.view(np.int64))
        out[(step - begin) * lanes:(step - begin) * lanes + n] = symbol
        row = symbol.astype(np.int64)
        x >>= U64(SCALE)
        x *= table.frequency.take(row)
        x += slot - table.first.take(row)
        at = np.flatnonzero(x < _LOW)
        if len(at):
            x[at] = x.take(at) << U64(32) | stream[place:place + len(at)]
            place += len(at)
    return out


class PieceEncoder:
    """Ids by the tokenizers library, word by word, remembered as 16- or 32-bit strings.

    Unseen pieces go to the library's model one by one, lower-case and with the
    byte-level file's signs for bytes, as its normalizer and pre-tokenizer give
    them; other words, and texts with special tokens, go through all of the
    library. Words are remembered in two generations of bounded size, so those
    in use stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.signs = "".join(byte_symbols())
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.memo: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def piece_ids(self, found: Iterable[str]) -> list[bytes]:
        """Ids of pieces, each of which the tokenizer's pattern leaves whole."""
        tokenize, signs, code = self.model.tokenize, self.signs, "H" if self.kind == "<u2" else "I"
        return [array(code, [t.id for t in tokenize(p if p.isascii() else charmap_decode(p.encode(), "strict", signs)[0])]).tobytes()
                for p in found]

    def _unseen(self, words: Iterable[str]) -> list[str]:
        """Words in neither generation; those of the older one come back."""
        memo, old = self.memo, self.old
        new = [w for w in words if w not in memo]
        if old and new:
            found = list(map(old.get, new))
            memo.update([(w, x) for w, x in zip(new, found) if x is not None])
            new = [w for w, x in zip(new, found) if x is None]
        return new

    def _learn(self, unseen: list[str]) -> None:
        """Remember the ids of distinct words that are in neither generation."""
        if not unseen:
            return
        latin = pc.match_substring_regex(pa.array(unseen, pa.large_string()), _LATIN).to_numpy(zero_copy_only=False).tolist()
        other = [w for w, is_latin in zip(unseen, latin) if not is_latin]
        alone: set[str] = set()
        one: list[tuple[str, str]] = []  # a word and its only piece
        cut: list[tuple[str, list[str]]] = []
        for w in compress(unseen, latin):
            low = w.lower()
            if low.isalpha():
                alone.add(low)
                if low != w:
                    one.append((w, low))
            else:
                stem = low.rstrip(_SIGNS)
                part = [stem, low[len(stem):]] if stem.isalpha() else _PIECES.findall(low)
                alone.update(part)
                cut.append((w, part))
        new = self._unseen(alone)
        known = self.memo
        known.update(zip(new, self.piece_ids(new)))
        known.update(zip(other, self.ids(other)))
        known.update([(w, known[p]) for w, p in one])
        known.update([(w, b"".join([known[p] for p in part])) for w, part in cut])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text: those of its distinct words, gathered by the words' numbers."""
        if len(self.memo) > MEMO:
            self.memo, self.old = {"": b""}, self.memo
        whole = [i for i, t in enumerate(texts) if self.special.search(t)]
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        split = pc.split_pattern(pc.replace_substring(pa.array(rest, pa.large_string()), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.memo.get, words))
        at = [i for i, x in enumerate(known) if x is None]
        missing = [words[i] for i in at]
        self._learn(self._unseen(missing))
        for i, x in zip(at, map(self.memo.__getitem__, missing)):
            known[i] = x
        ids = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // ids.itemsize
        number = numbered.indices.to_numpy()
        each = size[number]
        end = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat((np.cumsum(size) - size)[number] - end[:-1], each)
        place += np.arange(len(place))
        raw, stop = ids[place].tobytes(), (end[split.offsets.to_numpy()] * ids.itemsize).tolist()
        out = [raw[i:j] for i, j in zip(stop, stop[1:])]
        for i in whole:
            out[i] = self.ids([texts[i]])[0]
        return out


@functools.lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def token_blocks(docs: DataFrame, path: str, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """task, block, doc_ids, lengths, ids: whole documents in ascending order."""
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash") \
        .sortWithinPartitions("doc_id", "_hash").withColumn("_task", F.spark_partition_id())

    def run(batches):
        encoder = piece_encoder(path)
        end = np.array([end_id], encoder.kind).tobytes()
        width, block, ids, held, size, before = len(end), 0, [], [], 0, 0

        def emit(task):
            return pa.RecordBatch.from_arrays([
                pa.array([task], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(x) // width for x in held]], pa.list_(pa.int64())), pa.array([width], pa.int32()),
                pa.array([b"".join(held)], pa.binary())],
                names=["task", "block", "before", "doc_ids", "lengths", "width", "ids"])

        task = 0
        for batch in pieces(batches, 1, 4 << 20):
            task = batch.column(3)[0].as_py()
            rows = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for i, x in zip(batch.column(0).to_pylist(), rows):
                x += end
                if held and size + len(x) > BLOCK_TOKENS * width:
                    yield emit(task)
                    block, before, ids, held, size = block + 1, before + size // width, [], [], 0
                ids.append(i)
                held.append(x)
                size += len(x)
        if held:
            yield emit(task)

    return dealt.mapInArrow(run, "task int, block int, before long, doc_ids array<bigint>, lengths array<bigint>, width int, ids binary")


def id_counts(blocks: DataFrame) -> DataFrame:
    """id, n: summed per task first, then per id (as many rows as the vocabulary)."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(n) > len(total):
                    n[:len(total)] += total
                    total = n
                else:
                    total[:len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return blocks.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _table(rows) -> FrequencyTable:
    frequency = np.zeros(max([r[0] for r in rows], default=0) + 1, np.int64)
    for i, n in rows:
        frequency[i] = n
    return FrequencyTable(frequency)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all documents in the file format to ``folder``."""
    spark = docs.sparkSession
    raw_path = scratch_path(spark, "llm-token-blocks")
    token_blocks(docs, tokenizer, text, end_id).write.options(**SMALL_PAGES).parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    counts = id_counts(raw).collect()  # a row for each id of the vocabulary at most
    most = np.zeros(max([r[0] for r in counts], default=0) + 1, np.int64)
    for i, n in counts:
        most[i] = n
    scaled = FrequencyTable.scaled(most)
    rows = [(int(i), int(scaled[i])) for i in np.flatnonzero(scaled)]
    spark.createDataFrame(rows, "id int, frequency int").coalesce(1).write.parquet(f"{folder}/frequencies")

    def run(batches):
        table = FrequencyTable(scaled)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(6)[i].as_py(), f"<u{batch.column(5)[i].as_py()}")
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([encode_block(ids, table)], pa.binary())],
                                                 names=["task", "block", "before", "doc_ids", "lengths", "payload"])

    raw.mapInArrow(run, "task int, block int, before long, doc_ids array<bigint>, lengths array<bigint>, payload binary") \
        .write.options(**SMALL_PAGES).parquet(f"{folder}/blocks")
    per_task = raw.select("task", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).groupBy("task").agg(
        F.sum("n").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    per_task.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start")) \
        .write.parquet(f"{folder}/starts")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) from the files."""
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/frequencies").select("id", "frequency").collect()]
    starts = spark.read.parquet(f"{folder}/starts")
    blocks = spark.read.parquet(f"{folder}/blocks")
    if starts.count() <= BROADCAST_TASKS:
        starts = F.broadcast(starts)
    placed = blocks.join(starts, "task").select(
        (F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def run(batches):
        table = _table(rows)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.array(batch.column(2)[i].as_py(), np.int64)
                ids = decode_block(batch.column(3)[i].as_py(), table).astype("<u4")
                ends, start = np.cumsum(lengths), batch.column(0)[i].as_py()
                n, doc_ids = len(lengths), batch.column(1)[i].as_py()
                for a in range(0, n, 512):
                    z = range(a, min(a + 512, n))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_ids[k] for k in z], pa.int64()), pa.array((start + ends - lengths)[a:a + 512], pa.int64()),
                        pa.array(lengths[a:a + 512], pa.int64()),
                        pa.array([ids[ends[k] - lengths[k]:ends[k]].tobytes() for k in z], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def written(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Write the files below ``spark.checkpoint.dir`` and read them back."""
    checkpoint_root(docs.sparkSession)
    folder = scratch_path(docs.sparkSession, "llm-token-files")
    write_ids(docs, folder, tokenizer, text)
    return read_ids(docs.sparkSession, folder)
