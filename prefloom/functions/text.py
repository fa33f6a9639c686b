"""Text helpers as Spark Column expressions.

All of them are built-in expressions (regexp, split_part, trim, higher-order
functions) so that they stay inside whole-stage codegen and work on whole
texts without a Python round trip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as
# white space (str.isspace), as escapes: \t \n \x0b \x0c \r \x1c \x1d \x1e \x1f
# space \x85 \xa0 \u1680 \u2000-\u200a \u2028 \u2029 \u202f \u205f \u3000.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character class body, valid in Java and RE2.
WS_CLASS_BODY = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Spark-side form of the same set: Java's Unicode \s is the White_Space
# property; with \x1C-\x1F added it is exactly Python's set, and matches
# about twice as fast as the explicit class.
WS = r"(?U)[\s\x{1C}-\x{1F}]"
NON_WS = r"(?U)[^\s\x{1C}-\x{1F}]"

# Box patterns. (?d): '.' excludes only '\n', as Python's '.' does.
BOXED_FIRST = r"(?d)\\boxed\{(.*?)\}"
BOXED_LAST = r"(?d)(?s:.*)\\boxed\{(.*?)\}"
BOX = "\\boxed{"

FENCE = "```"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trim the full Unicode white-space set."""
    return F.trim(_col(c), F.lit(PY_WHITESPACE_CHARS))


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once: inside a lambda it is a
    variable, where a plain column expression would be repeated at each use."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _box_opening(pieces: Column, which: str) -> Column:
    """Number (from 1) of the piece that ends in the first or last box brace
    that closes, 0 if none does.

    Read from the end, a brace that opens closes if a closing brace behind it
    is still free; so the state is three numbers, whatever the depth."""
    state = F.struct(F.size(pieces).alias("at"), F.lit(0).alias("free"), F.lit(0).alias("box"))

    def step(a, piece):
        opens = piece.endswith("{")
        closes = opens & (a["free"] > 0) & piece.endswith(BOX)
        if which == "last":
            closes = closes & (a["box"] == 0)
        return F.struct((a["at"] - 1).alias("at"),
                        F.when(~opens, a["free"] + 1).otherwise(F.greatest(a["free"] - 1, F.lit(0))).alias("free"),
                        F.when(closes, a["at"]).otherwise(a["box"]).alias("box"))

    return F.aggregate(F.reverse(pieces), state, step, lambda a: a["box"])


def _until_closed(pieces: Column) -> Column:
    """Number of pieces up to the brace that closes one opened before them."""
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(a, piece):
        depth = a["depth"] + F.when(piece.endswith("{"), 1).otherwise(-1)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n")))

    return F.aggregate(pieces, state, step, lambda a: a["n"])


def _balanced(t: Column, which: str) -> Column:
    """The first (or last) box whose brace closes, null if there is none.

    The text from its first box on (no brace before it matters) is cut after
    each brace; two folds over the pieces, each with a state of fixed size,
    find the box and its end: linear in the braces."""
    def content(pieces):
        return bound(_box_opening(pieces, which), lambda box: F.when(box > 0, bound(
            F.slice(pieces, box + 1, F.size(pieces)),
            lambda rest: F.regexp_replace(F.array_join(F.slice(rest, 1, _until_closed(rest)), ""), r"\}\z", ""))))

    boxes = F.regexp_extract(t, r"(?s)\\boxed\{.*", 0)
    return bound(F.regexp_extract_all(boxes, F.lit(r"([^{}]*+[{}])"), F.lit(1)), content)


def extract_boxed(c, mode: str = "first_brace", which: str = "first") -> Column:
    """Content of a ``\\boxed{...}``, stripped; the stripped text if none.

    ``first_brace`` stops at the first closing brace (``\\boxed{\\frac{1}{2}}``
    gives ``\\frac{1``); ``balanced`` matches nested braces of any depth.
    """
    if mode not in ("first_brace", "balanced"):
        raise ValueError(f"mode must be 'first_brace' or 'balanced', got {mode!r}")
    if which not in ("first", "last"):
        raise ValueError(f"which must be 'first' or 'last', got {which!r}")
    t = _col(c)
    if mode == "balanced":
        return py_strip(F.coalesce(_balanced(t, which), t))
    p = BOXED_FIRST if which == "first" else BOXED_LAST
    return py_strip(F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(t))


def extract_code(c, strip_any_tag: bool = False) -> Column:
    """Code of the first fenced block; the whole text if there is no fence.

    Only a leading ``python`` tag is removed (``python3`` leaves ``3``) unless
    ``strip_any_tag``. An unclosed fence yields everything after it.
    """
    t = _col(c)
    body = F.split_part(t, F.lit(FENCE), F.lit(2))
    if strip_any_tag:
        body = F.regexp_replace(body, r"^[A-Za-z0-9_+.-]+", "")
    else:
        body = F.when(body.startswith("python"), F.substr(body, F.lit(7))).otherwise(body)
    return F.when(t.contains(FENCE), body).otherwise(t)


def normalize_output(c) -> Column:
    """``','.join(x.strip().split())``: white-space runs become one comma."""
    return F.regexp_replace(py_strip(c), f"{WS}+", ",")


# int() strips the Unicode White_Space set only: \x1c-\x1f are white space
# to str.strip() but make int() fail.
INT_WHITESPACE_CHARS = "".join(ch for ch in PY_WHITESPACE_CHARS if ch not in "\x1c\x1d\x1e\x1f")


def last_line_int(c) -> Column:
    """Last line (after the final ``\\n``) as ``decimal(38,0)``, as ``int()``
    reads it (ASCII digits, optional sign, surrounding white space); 0 if it
    is no integer, null if it has more than 38 digits."""
    last = F.substring_index(_col(c), "\n", -1)
    core = F.trim(last, F.lit(INT_WHITESPACE_CHARS))
    ok = core.rlike(r"^[+-]?[0-9]+$")
    return F.when(ok, core.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)"))


def count_tokens(c) -> Column:
    """Number of white-space separated tokens (``len(x.split())``)."""
    return F.regexp_count(_col(c), F.lit(f"{NON_WS}+")).cast("int")


def contains_any(c, needles) -> Column:
    t = _col(c)
    out = F.lit(False)
    for n in needles:
        out = out | t.contains(n)
    return out
