import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from prefloom.llm import conversation_repair as C
from prefloom.llm import oracle, queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
LEGAL = re.compile("(s?(ua)+)?")


def last_char(text):
    return (re.findall(r"[^\x20\x09-\x0D]", text) or [""])[-1]


def faults(rows):
    """(blank, duplicate, truncated) of each row."""
    out = []
    for i, row in enumerate(rows):
        blank, again = not last_char(row[1]), row in rows[:i]
        out.append((blank, again, last_char(row[1]) not in (".", "!", "?")))
    return out


def every_edit(rows):
    """Smallest (cost, audit, repaired) over all edits of every row with up to two insertions before each and at the end."""
    best = None
    marks = faults(rows)
    inserts = [[], [("I", "user")], [("I", "assistant")], [("I", "user"), ("I", "assistant")], [("I", "assistant"), ("I", "user")]]
    edits = [("K", None), ("R", "user"), ("R", "assistant"), ("D", None)]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for chosen in product(edits, repeat=len(rows)):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(gaps):
                for letter, role in gap:
                    cost, audit = cost + 2, audit + letter
                    out.append((role, ""))
                if i < len(rows):
                    letter, role = chosen[i]
                    blank, again, cut = marks[i]
                    if letter != "D" and (blank or again):
                        break
                    cost += {"K": 0, "R": 2, "D": 3}[letter] + (letter != "D" and cut)
                    audit += letter
                    if letter != "D":
                        out.append((role or rows[i][0], rows[i][1]))
            else:
                if LEGAL.fullmatch("".join(r[:1] if r[:1] in "sua" and r else "x" for r, _ in out)):
                    found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                    best = min(best, found) if best else found
    return best


def by_rows(rows):
    """The same by one pass over the rows: state -> smallest (cost, audit), with the repaired rows."""
    marks = faults(rows)
    paths = {"": (0, "", [])}
    for (role, text), (blank, again, cut) in zip(rows, marks):
        new = {}

        def offer(state, cost, audit, out):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, out)

        for state, (cost, audit, out) in paths.items():
            offer(state, cost + 3, audit + "D", out)
            if blank or again:
                continue
            gaps = [(state, [], "")]
            role_next = "assistant" if state == "u" else "user"
            gaps.append((role_next[0], [(role_next, "")], "I"))
            for at, inserted, letter in gaps:
                turn = "assistant" if at == "u" else "user"
                price = cost + 2 * len(inserted) + cut
                if role[:1] == turn[0] or role[:1] == "s" and at == "":
                    offer(role[:1], price, audit + letter + "K", out + inserted + [(role, text)])
                offer(turn[0], price + 2, audit + letter + "R", out + inserted + [(turn, text)])
        paths = new
    closing = {"": [], "a": [], "u": [("assistant", "")], "s": [("user", ""), ("assistant", "")]}
    cost, audit, out = min((c + 2 * len(closing[s]), a + "I" * len(closing[s]), o + closing[s]) for s, (c, a, o) in paths.items())
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def repaired(rows, texts=False):
    state = C.Repair(texts=texts)
    for (role, text), (blank, again, cut) in zip(rows, faults(rows)):
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        state.add((initial, blank or again, cut), role.encode(), text.encode())
    return state.end()


def some_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]),
             rng.choice(["Yes.", "and so", " ", "Good!", f"text {rng.random()}.", f"cut {rng.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_edit_of_short_conversations(n):
    rng = random.Random(n)
    for _ in range([1, 30, 20, 4][n]):
        rows = some_rows(rng, n)
        cost, audit, text = every_edit(rows)
        assert by_rows(rows) == (cost, audit, text)
        got = repaired(rows, texts=True)
        assert got == (cost, audit, hashlib.sha256(text.encode()).hexdigest(), text.encode())


@pytest.mark.parametrize("n", [5, 63, 64, 65, 128, 300])
def test_blocks_decide_as_whole_conversations_do(n):
    rng = random.Random(n)
    for k in range(12):
        rows = some_rows(rng, n)
        if k % 3 == 1:  # no role fits: which row to delete is open up to the end
            rows = [("tool", f"{i}.") for i in range(n + k % 2)]
        if k % 3 == 2:
            rows = [(["user", "assistant"][i % 2 if i < n // 2 else (i + 1) % 2], f"{i}.") for i in range(n)]
        cost, audit, text = by_rows(rows)
        assert repaired(rows)[:3] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


ODD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, None, None, None), (1, None, "system", "Be good."),
       (2, 0, "user", ""), (None, 3, "user", "No id."), (None, None, "assistant", "x"), (3, 5, "user", "Same."), (3, 5, "user", "Same."),
       (3, 5, "assistant", "Same."), (3, 9, "assistant", "Far?"), (4, 0, "user", "long. " * 200_000), (4, 1, "assistant", "y " * 300_000),
       (5, 1, "tool", "İΣ\U0001f600."), (5, 2, "", "no role"), (5, 3, "ä", "   ")]


def from_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(oracle.REPAIR)
    names = [d[0] for d in got.description]
    return sorted(([r[names.index(c)] for c in COLUMNS] for r in got.fetchall()), key=repr)


def query(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_conversation_repair(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        (c, "bigint" if c not in ("audit", "repaired_sha256") else "string") for c in COLUMNS]
    return sorted((list(r) for r in out.collect()), key=repr)


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = ODD + [(10 + i % 40, rng.choice([None, *range(12)]), *some_rows(rng, 1)[0]) for i in range(600)]
    rows += [(100, i, ["user", "assistant"][rng.random() < 0.5], f"turn {i % 150}.") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS present", "'x' AS _here", "2L AS cost", "role AS audit")  # clashing columns
    assert query(spark, tmp_path, df) == from_sql(rows)


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two") for i in range(40) for t in range(5)]
    out = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv, turn, _, _ in rows:
        hit = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        got = [(r.role, r.text, r.present) for r in out if (r.conv_id, r.turn) == (conv, turn)]
        want = ("user" if hit == 4 else "assistant", {1: "", 2: "One Two"}.get(hit, "One. Two"), hit != 0)
        assert got == [want] * (2 if hit == 3 else 1)


def test_texts_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    for r in C.repair(df, texts=True).collect():
        assert hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256
        assert LEGAL.fullmatch("".join(x[:1] for x in r.repaired.split("\n") if r.repaired))
    assert query(spark, tmp_path, df.where("false")) == []
    gone = C.repair(df, present=df.conv_id > 4).where("conv_id < 5").collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
