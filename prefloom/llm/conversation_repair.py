"""Conversation structure repair by scalar big-integer weights.

A conversation's rows, in order, form a layered graph: before each row the
state is what the repaired conversation ends in (nothing, system, user,
assistant), and an edge keeps, re-roles or deletes the row, with or without an
inserted row before it. An edge's weight is one integer: its cost in the high
digits, and in the low digits, at the row's own fixed place, the letters it
adds to the audit. A row's letters ("D", "IK", "IR", "K", "R") are a
prefix-free code whose digits are in ASCII order, the last place holds the
insertion after all rows, and zero stands for the end; so sums of weights order
paths by cost, then by audit, and a plain integer minimum decides everything.
("ID" is left out: "DI" costs the same and is smaller.)

A long conversation is taken in blocks of rows: between blocks a state's
audit so far, which cannot change any more, is replaced by its rank among the
states' audits in the digits above the block's places. Time is linear in rows.

All rows of a conversation go to one task, which streams them: its SHA-256 is
over the whole text in order, so no split of this work exists. The task holds
one block of rows and, for each of at most four paths, a running hash and its
letters; sorting is Spark's and spills. Duplicates are found by a sort of the
same partition before.

Defined results: null role or text counts as one space; rows of equal turn are
taken by role, then text (null turns first); a null ``conv_id`` is a
conversation like others; rows that repeat are duplicates of the first; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose letters are in the low digits at once.
BLOCK = 64
NON_SPACE = r"[^\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

# States: what the repaired rows end in.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
# A row's digits, in the order of their letters, and those of the last place.
LETTERS = ("", "D", "IK", "IR", "K", "R")
LAST = ("", "I", "II")
#: Costs of completing the repaired rows at the end, for each state: (digit, cost).
CLOSING = {EMPTY: (0, 0), SYSTEM: (2, 2 * INSERT), USER: (1, INSERT), ASSISTANT: (0, 0)}


def _edges(initial: str | None, delete: bool, cut: int) -> list[tuple[int, int, int, int]]:
    """(state before, state after, cost, digit) of a row with this role initial."""
    out = [(s, s, DELETE, 1) for s in range(4)]
    if delete:
        return out
    for before in range(4):
        after = ASSISTANT if before == USER else USER  # what may follow, but for a first system row
        other = USER if after == ASSISTANT else ASSISTANT  # what may follow an inserted row
        if initial == "s" and before == EMPTY:
            out.append((before, SYSTEM, KEEP + cut, 4))
        for state, digit, cost in ((after, 4, 0), (other, 2, INSERT)):
            if (initial, state) in (("u", USER), ("a", ASSISTANT)):
                out.append((before, state, KEEP + cost + cut, digit))
        out.append((before, after, REROLE + cut, 5))
        out.append((before, other, REROLE + INSERT + cut, 3))
    return out


#: Edges by (role initial or "" for any other, row must go, row is truncated).
EDGES = {(i, d, c): _edges(i, d, int(c)) for i in ("s", "u", "a", "") for d in (False, True) for c in (False, True)}


def shortest(codes: list[tuple], entry: dict[int, tuple[int, int]], last: bool) -> dict[int, tuple[int, int, int]]:
    """Smallest weight into each state after these rows: state -> (cost, rank
    of the state it came from, digits).

    ``entry`` gives each open state's cost and rank. After the last rows the
    closing insertions are added and only the best state is returned.
    """
    places = len(codes) + 1
    low = 3 * places
    weight = {s: (cost << 2 | rank) << low for s, (cost, rank) in entry.items()}
    for i, code in enumerate(codes):
        place, new = 3 * (places - 1 - i), {}
        for before, after, cost, digit in EDGES[code]:
            if before in weight:
                w = weight[before] + (cost << low + 2) + (digit << place)
                if after not in new or w < new[after]:
                    new[after] = w
        weight = new
    if last:
        closed = {s: w + (CLOSING[s][1] << low + 2) + CLOSING[s][0] for s, w in weight.items()}
        best = min(closed, key=closed.get)
        weight = {best: closed[best]}
    return {s: (w >> low + 2, w >> low & 3, w & (1 << low) - 1) for s, w in weight.items()}


class Path:
    """One way through the rows so far: its last state, letters, hash and, if
    wanted, texts. Letters and texts are chains of parts shared between paths."""

    __slots__ = ("state", "audit", "hash", "texts")

    def __init__(self, state=EMPTY, audit=None, sha=None, texts=None):
        self.state, self.audit, self.hash, self.texts = state, audit, sha or hashlib.sha256(), texts

    def grown(self, rows: list[tuple], letters: list[str], state: int, texts: bool) -> Path:
        """The path that goes on over ``rows`` (role, text as bytes) by ``letters``."""
        out: list[bytes] = []
        at = self.state
        for row, edit in zip(rows, letters):
            for letter in edit:
                if letter == "D":
                    continue
                role = b"assistant" if at == USER else b"user"
                if letter == "K":
                    out.append(row[0] + b":" + row[1])
                    at = SYSTEM if at == EMPTY and row[0][:1] == b"s" else ASSISTANT if at == USER else USER
                else:
                    out.append(role + b":" + (row[1] if letter == "R" else b""))
                    at = ASSISTANT if at == USER else USER
        sha = self.hash.copy()
        if out:
            sha.update((b"" if self.state == EMPTY else b"\n") + b"\n".join(out))
        return Path(state, (self.audit, "".join(letters)), sha, (self.texts, out) if texts else None)


def unchained(chain) -> list:
    parts = []
    while chain is not None:
        chain, part = chain
        parts.append(part)
    return parts[::-1]


def decoded(digits: int, n: int) -> list[str]:
    """The letters of ``n`` rows and of the last place."""
    return [LETTERS[digits >> 3 * (n - i) & 7] for i in range(n)] + [LAST[digits & 7]]


class Repair:
    """State of one conversation while its rows pass by."""

    def __init__(self, texts: bool = False):
        self.paths = [Path()]
        self.cost = {EMPTY: 0}  # of each open state; self.paths is in the order of their audits
        self.codes: list[tuple] = []
        self.rows: list[tuple] = []
        self.texts = texts

    def add(self, code: tuple, role: bytes, text: bytes) -> None:
        if len(self.codes) == BLOCK:
            self._advance(False)
        self.codes.append(code)
        self.rows.append((role, text))

    def _advance(self, last: bool) -> int:
        entry = {p.state: (self.cost[p.state], rank) for rank, p in enumerate(self.paths)}
        found = shortest(self.codes, entry, last)
        order = sorted(found, key=lambda s: found[s][1:])
        rows = self.rows + [(b"", b"")]
        self.paths = [self.paths[found[s][1]].grown(rows, decoded(found[s][2], len(self.codes)), s, self.texts) for s in order]
        self.cost = {s: found[s][0] for s in order}
        self.codes, self.rows = [], []
        return self.cost[order[0]]

    def end(self) -> tuple[int, str, str, bytes | None]:
        """Cost, audit, SHA-256 and, if wanted, the repaired text."""
        cost = self._advance(True)
        path = self.paths[0]
        text = b"\n".join(x for part in unchained(path.texts) for x in part) if self.texts else None
        return cost, "".join(unchained(path.audit)), path.hash.hexdigest(), text


def damage(convs: DataFrame) -> DataFrame:
    """The rows with the damage that crc32 of ``conv_id:turn`` (nulls: one
    space) modulo 20 names: 0 drops the row (``present`` is false), 1 empties
    the text, 2 removes its ``[.!?]``, 3 repeats the row, 4 sets role user."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = convs.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        (F.crc32(F.concat(place[0], F.lit(":"), place[1])) % 20).alias("_hit"))
    hit = F.col("_hit")
    text = F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (rows.withColumn("_copy", F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (hit != 0).alias("present")))


def repair(rows: DataFrame, present: Column | None = None, texts: bool = False) -> DataFrame:
    """One row per ``conv_id``: gaps, counts of faults and of illegal
    neighbours, the cheapest repair's cost and audit, the SHA-256 of its rows
    (``role:text``, newline-joined) and, with ``texts``, these as ``repaired``.

    Rows for which ``present`` is false only name their conversation.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    text = F.coalesce("text", F.lit(" "))
    end = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    by_conv = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
        here.alias("_here"), (end == "").alias("_blank"), (~end.isin(".", "!", "?")).alias("_cut")).repartition("conv_id")
    # the windows use the same partitions: their keys begin with conv_id
    same = Window.partitionBy("conv_id", "_here", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = by_conv.withColumn("_again", F.row_number().over(same) > 1)
    ordered = (marked.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_again"))
               .select("conv_id", "_here", "turn", F.substring("role", 1, 1).alias("_initial"), F.col("role").cast("binary").alias("role"),
                       F.col("text").cast("binary").alias("text"), "_blank", "_again", "_cut"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string" + ", repaired string" * texts)

    def run(batches):
        conv = state = None
        count: dict = {}
        done: list[tuple] = []

        def finish():
            cost, audit, sha, text = state.end()
            gaps = count["last"] - count["first"] + 1 - count["turns"] if count["turns"] else 0
            done.append((conv[0], gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, sha,
                         *([text.decode()] if texts else [])))

        def flushed():
            columns = list(zip(*done)) if done else [()] * len(fields)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=fields)

        fields = [f.split()[0] for f in schema.split(", ")]
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 6, *[pa.string()] * (len(fields) - 7)]
            held = 0
            for cid, here, turn, initial, role, text, blank, again, cut in zip(*[c.to_pylist() for c in batch.columns]):
                if conv is None or conv[0] != cid:
                    if conv is not None:
                        finish()
                        held += len(done[-1][7]) + len(done[-1][-1])
                        if held > 4 << 20:
                            yield flushed()
                            held = 0
                    conv, state = (cid,), Repair(texts)
                    count = dict(blank=0, duplicate=0, truncated=0, illegal=0, turns=0, first=None, last=None, before=None)
                if not here:
                    continue
                fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
                if fault:
                    count[fault] += 1
                if count["before"] is not None and count["before"] + initial not in ("su", "ua", "au"):
                    count["illegal"] += 1
                count["before"] = initial
                if turn is not None and turn != count["last"]:
                    count["turns"] += 1
                    count["first"] = turn if count["first"] is None else count["first"]
                    count["last"] = turn
                state.add((initial if initial in ("s", "u", "a") else "", blank or again, fault == "truncated"), role, text)
            if done:
                yield flushed()
        if conv is not None:
            finish()
            yield flushed()

    return ordered.mapInArrow(run, schema)
