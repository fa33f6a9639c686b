"""Column functions against Python's own string semantics on random texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from prefloom.functions import text

ALPHABET = st.sampled_from(list("ab 5{}\\`\n\t,.-") + ["\\boxed{", "```", "```python", "　", "\x85",
                                                        "\xa0", "\x1c", "\r", " ", "python", "}"])
TEXTS = st.lists(ALPHABET, max_size=25).map("".join)


def py_norm(t):
    return ",".join(t.strip().rstrip("\n").split())


def py_last_int(t):
    try:
        v = int(t.split("\n")[-1])
    except ValueError:
        return 0
    return v


@settings(max_examples=3, deadline=None)
@given(st.lists(TEXTS, min_size=300, max_size=300))
def test_against_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.extract_boxed("t").alias("b"), text.extract_code("t").alias("c"),
                    text.normalize_output("t").alias("n"), text.count_tokens("t").alias("k"),
                    text.last_line_int("t").alias("l")).collect()
    for r in got:
        t = texts[r.i]
        # properties of the extracts; their golden rows are in test_functions
        assert r.b == r.b.strip() and r.b in t and "}" not in (r.b if "\\boxed{" + r.b + "}" in t else "")
        assert r.c in t and "```" not in r.c and ("```" in t or r.c == t)
        assert r.n == py_norm(t), (t, r.n)
        assert r.k == len(t.split()), (t, r.k)
        last = t.split("\n")[-1]
        # int() also takes '_' separators and non-ASCII digits
        if "_" not in last and last.strip().lstrip("+-").isascii() and len(last.strip()) <= 38:
            assert r.l == py_last_int(t), (t, r.l)
