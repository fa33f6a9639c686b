"""PII by information-theoretic sanitisation.

Protected entities are the personal data that the base patterns find (email,
ip, card, phone). A term discloses an entity if the corpus says so: with
document counts, ``PMI(term; entity) = log(N * n_both / (n_term * n_entity))``
over the entity's information ``log(N / n_entity)`` is 1 for a term that
never occurs without the entity (Sanchez and Batet). A term whose ratio reaches
``THRESHOLD`` is marked wherever it occurs in the entity's texts, as a span of
kind ``term``; ``redact`` generalises all spans to their kind. Texts that hold
the term alone do not name the entity and keep it.

Counts are over whole, distinct texts, so that copies of one document do not
make its rare words look like evidence. Every word of the entity's texts that
overlaps no base span is a candidate, at any distance from the mention. With
fewer than ``SUPPORT`` distinct texts there is no estimate (each rare word of a
single text would occur nowhere without the entity): the words of entities
that are rarer stay, their base spans are marked as all are.

Scale: one pass finds the base spans; only texts of entities with enough texts
are read again, for (entity, term) counts that are summed in the task first;
one pass counts the documents of the terms left, in the task where a text comes
once (bitmaps of fixed size keep other words out of the shuffle and tell texts
that may come twice, a join decides). Patterns run in time linear in
the text.

Defined results: a null text is empty and has no spans; rows with equal text
get equal spans; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.common import pieces, saved

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3
THRESHOLD = 0.9
BITMAP = 1 << 20
#: Bits that tell texts which may come twice (4 MB).
COPIES = 1 << 25
#: Tables of texts' spans or entities are broadcast up to so many bytes, else joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Pairs that a task counts before it sends them on.
FLUSH = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits matches as a whole or not at all, so starts inside it are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Every ``@`` with the longest run of local characters before it (not
    reaching into the last match) and a dotted domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of ``KINDS``."""
    found = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        if "." in text:
            found[1] = [m.span() for m in _IP.finditer(text)
                        if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found[2].append(m.span())
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def free_words(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The words that overlap no span."""
    covered = sorted(s for kind in spans for s in kind)
    starts = [s for s, _ in covered]
    reach = np.maximum.accumulate([e for _, e in covered]) if covered else []

    def free(a, b):
        i = bisect.bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    return [m.span() for m in _WORD.finditer(text) if free(*m.span())]


def entities(text: str, spans: list[list[tuple[int, int]]]) -> list[str]:
    """The distinct entities that the spans mention."""
    return sorted({f"{kind}:{text[s:e].lower() if kind in ('email', 'ip') else _digits(text[s:e])}"
                   for kind, found in zip(KINDS, spans) for s, e in found})


def _join(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, found in zip(KINDS, spans) for s, e in found)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, counts, base (spans joined) and the entities of each text."""

    def run(batches):
        for batch in pieces(batches, 2, 2 << 20):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            spans = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([len(s[k]) for s in spans], pa.int64()) for k in range(4)],
                 pa.array([_join(s) for s in spans], pa.string()),
                 pa.array([entities(t, s) for t, s in zip(texts, spans)], pa.list_(pa.string()))],
                names=["doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base", "entities"])

    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_email long, n_ip long,"
        " n_card long, n_phone long, base string, entities array<string>")


def _small(df: DataFrame, size) -> DataFrame:
    """The table, to be broadcast if its rows hold few enough bytes."""
    held = df.agg(F.sum(size + 16).alias("n")).first()["n"] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def whole_texts(docs: DataFrame, lists: DataFrame, column: str, text: str = "text") -> DataFrame:
    """text_hash, text and the list ``column`` of the texts in ``lists``, each once."""
    lists = _small(lists, F.expr(f"aggregate({column}, 0L, (a, x) -> a + length(x))"))
    return (docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
            .join(lists, "text_hash").dropDuplicates(["text_hash"]))


def together(texts: DataFrame) -> DataFrame:
    """entity, term, n: the texts that hold both; with a null entity, the texts that hold the term."""

    def run(batches):
        count: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array([e for e, _ in count], pa.string()), pa.array([w for _, w in count], pa.string()),
                                              pa.array(list(count.values()), pa.int64())], names=["entity", "term", "n"])
            count.clear()
            return out

        for batch in pieces(batches, 0, 2 << 20):
            for t, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = {t[a:b].lower() for a, b in free_words(t, base_spans(t))}
                for entity in (None, *known):
                    count.update((entity, w) for w in terms)
                    if len(count) > FLUSH:
                        yield rows()
        yield rows()

    return texts.select("text", "entities").mapInArrow(run, "entity string, term string, n long").groupBy("entity", "term").agg(
        F.sum("n").alias("n"))


def _slot(term: str) -> int:
    return zlib.crc32(term.encode()) % BITMAP


def repeated(hashes: DataFrame) -> bytes:
    """A bitmap of ``COPIES`` bits in which those of the hashes that come twice or more are set (and bits of others
    that share their place)."""
    place = F.pmod(F.col("text_hash"), F.lit(COPIES)) + 1
    twice = hashes.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(place.alias("p"))
    parts = twice.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = bytearray(COPIES // 8)
    for part, bits in parts.collect():  # COPIES / 8 bytes at most
        out[(part - 1) * len(bits):part * len(bits)] = bits
    return bytes(out)


def term_rows(table: DataFrame, packed: bytes, copies: bytes) -> DataFrame:
    """term, text_hash, n of the table's (text_hash, text) rows, for terms whose slot is set in ``packed``.

    Texts that come once are counted in the task (a null hash). Those in the
    bitmap ``copies`` may come again: their terms go with the text's hash."""

    def run(batches):
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).tobytes()
        count: Counter = Counter()

        def rows(terms, hashes, n):
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(hashes, pa.int64()), pa.array(n, pa.int64())],
                                              names=["term", "text_hash", "n"])

        def counted():
            out = rows(list(count), [None] * len(count), list(count.values()))
            count.clear()
            return out

        for batch in pieces(batches, 1, 2 << 20):
            out, terms = [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hit = [w for w in set(_WORD.findall((t or "").lower())) if wanted[_slot(w)]]
                place = h % COPIES
                if copies[place >> 3] >> (place & 7) & 1:
                    out += [h] * len(hit)
                    terms += hit
                else:
                    count.update(hit)
            if terms:
                yield rows(terms, out, [1] * len(terms))
            if len(count) > FLUSH:
                yield counted()
        yield counted()

    return table.mapInArrow(run, "term string, text_hash long, n long")


def document_counts(docs: DataFrame, terms: DataFrame, text: str = "text", hashes: DataFrame | None = None) -> DataFrame:
    """term, n_term: the distinct texts of the whole table that hold each term.

    ``hashes`` is a text_hash for each row of the table, if that is at hand."""
    slot = F.crc32(F.col("term").cast("binary")) % BITMAP  # at most BITMAP numbers reach the driver
    used = [int(r[0]) for r in terms.select(slot.alias("s")).distinct().collect()]
    bits = np.zeros(BITMAP, bool)
    bits[used] = True
    table = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    copies = repeated(table if hashes is None else hashes)
    held = term_rows(table, np.packbits(bits).tobytes(), copies).join(terms, "term", "left_semi")
    texts = held.groupBy("term", "text_hash").agg(F.sum("n").alias("n"))
    return texts.groupBy("term").agg(F.sum(F.when(F.col("text_hash").isNull(), F.col("n")).otherwise(1)).alias("n_term"))


def disclosures(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT,
                threshold: float = THRESHOLD) -> DataFrame:
    """entity, term, ratio of the pairs whose ratio reaches the threshold."""
    schema = "entity string, term string, ratio double"
    nothing = docs.sparkSession.createDataFrame([], schema)
    mention = found.select("text_hash", F.explode("entities").alias("entity")).distinct()
    entity = saved(mention.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support), "entities")
    if entity.isEmpty():
        return nothing
    known = mention.join(entity, "entity").groupBy("text_hash").agg(F.collect_list("entity").alias("entities"))
    counted = saved(together(whole_texts(docs, saved(known, "mentions"), "entities", text)), "together")
    held = counted.where("entity IS NULL").select("term", F.col("n").alias("n_held"))
    both = counted.where("entity IS NOT NULL").where(F.col("n") >= support).withColumnRenamed("n", "n_both")
    n = float(found.agg(F.count_distinct("text_hash")).first()[0])
    information = F.log(F.lit(n) / F.col("n_entity"))

    def ratio(n_term):
        pmi = F.log(F.lit(n) * F.col("n_both") / (F.col(n_term) * F.col("n_entity")))
        return F.when(information > 0, pmi / information)

    # a term is in at least as many texts as in those of the entities: pairs that fall short even so need no count
    open_ = saved(both.join(entity, "entity").join(held, "term").where(ratio("n_held") >= threshold).drop("n_held"), "open")
    terms = saved(open_.select("term").distinct(), "terms")
    if terms.isEmpty():
        return nothing
    sized = open_.join(document_counts(docs, terms, text, found.select("text_hash")), "term")
    return sized.select("entity", "term", ratio("n_term").alias("ratio")).where(F.col("ratio") >= threshold)


def term_spans(texts: DataFrame) -> DataFrame:
    """text_hash, n_term, extra: every occurrence of the texts' ``terms`` outside base spans."""

    def run(batches):
        for batch in pieces(batches, 1, 2 << 20):
            spans = []
            for t, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                terms = set(terms)
                spans.append([(a, b) for a, b in free_words(t, base_spans(t)) if t[a:b].lower() in terms])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array([",".join(f"term:{a}:{b}" for a, b in s) for s in spans], pa.string())], names=["text_hash", "n_term", "extra"])

    return texts.select("text_hash", "text", "terms").mapInArrow(run, "text_hash long, n_term long, extra string")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_email, n_ip, n_card, n_phone, n_term, base, spans."""
    found = saved(find(docs, text), "found")
    risky = saved(disclosures(docs, found, text), "disclosures")
    told = (found.select("text_hash", F.explode("entities").alias("entity")).distinct().join(risky, "entity")
            .groupBy("text_hash").agg(F.collect_set("term").alias("terms")))
    spans = saved(term_spans(whole_texts(docs, saved(told, "told"), "terms", text)), "spans")
    out = found.drop("entities").join(_small(spans, F.length("extra")), "text_hash", "left")
    out = out.withColumn("n_term", F.coalesce("n_term", F.lit(0).cast("long")))
    return out.withColumn("spans", F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "extra")])).drop("extra")


def redacted(text: str, spans: str) -> str:
    """Each span, overlapping ones together, replaced by its kind in brackets."""
    marks = sorted((int(s), int(e), kind) for kind, s, e in (x.split(":") for x in spans.split(",") if x))
    out, at, i = [], 0, 0
    while i < len(marks):
        start, end, kind = marks[i]
        i += 1
        while i < len(marks) and marks[i][0] < end:
            end = max(end, marks[i][1])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their personal data generalised; n_chars follows."""
    found = personal_data(docs, text).where("spans <> ''").select("text_hash", "spans").dropDuplicates(["text_hash"])
    found = _small(saved(found, "redactions"), F.length("spans"))
    columns, schema = docs.columns, docs.schema
    at = columns.index(text)
    chars = columns.index("n_chars") if "n_chars" in columns else None
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # names of its own: none clashes with those of the join
    joined = plain.withColumn("text_hash", F.xxhash64(f"c{at}")).join(found, "text_hash", "left").select(*plain.columns, "spans")

    def run(batches):
        for batch in pieces(batches, at):
            spans = batch.column(len(columns)).to_pylist()
            texts = [redacted(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans)]
            out = list(batch.columns[:len(columns)])
            out[at] = pa.array(texts, out[at].type)
            if chars is not None:
                out[chars] = pa.array([n if not s else len(t) for n, t, s in zip(batch.column(chars).to_pylist(), texts, spans)],
                                      out[chars].type)
            yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(columns))])

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    return joined.mapInArrow(run, kinds).toDF(*columns)
