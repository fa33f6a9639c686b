"""HTML extraction by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one for each
block of text, with the text's characters and the tags met on the way. Each
line's ratio of characters to tags is smoothed by a Gaussian over its
neighbours, and the lines at or above a threshold (a share of the page's
standard deviation, as in CETR) form clusters: the content regions. All
regions together choose the page's container: its articles if they hold at
least half of the regions' text, else the deepest element around nearly all of
it, never a block of one line. Blocks of the container are kept whole, also
short ones that the threshold alone would lose, and a region outside it is kept
with the element around it, so no region is lost; what the markup declares as
something else (navigation, forms, adverts, comments, scripts) never counts,
neither as content nor in a ratio. Scripts and the like are never read; other
such elements are judged when the page has been read (see ``declared``), so
that a wrapper around the page is not taken for the sidebar in its name. A part
of a longer name that may as well be an ordinary word ("related-work") counts
only where the ratio agrees that the element is no prose.

Lines point into a tree of elements; everything that is summed or asked along
a line's elements is one pass over the tree, up or down, so time is linear in
the page however deep its elements are nested.

Defined results: a null or empty page, or one without text, has the empty
text; unclosed and stray tags are closed by the blocks around them; an empty
table gives an empty table; equal pages get equal texts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import pieces

SIGMA = 1.0
SHARE = 0.5
#: Part of the regions' text that the container holds where no article does.
AROUND = 0.9

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
                    "tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template iframe object svg math canvas button select option textarea input label "
                     "head title audio video".split())
_OTHER_TAGS = frozenset("nav header footer aside dialog menu".split())
_CLOSES_P = _BLOCKS
#: Elements that can be the container; others are parts of a text (paragraphs, items, rows, tables).
_HOLDERS = frozenset("html body main article section div center details td".split())
#: Words of class, id or role that mark what is not the article.
_OTHER = re.compile(
    r"ads?|advert\w*|banner\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|header|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|recommend\w*|replies|"
    r"respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo", re.I)
#: Those of them that mark an element also as a part of any longer name.
_STRONG = re.compile(
    r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|nav|navbar|navigation|newsletter|pager|"
    r"pagination|replies|sidebar|sponsor\w*|subscribe|complementary|contentinfo", re.I)
#: Parts of names that say where or how something is laid out, not what it is.
_PLACES = frozenset("area article articles bar block body bottom box button buttons card cards col column container content "
                    "elementor form grid group icon icons id image inline inner item items js left link links list main media "
                    "outer page panel post posts right row section site text title top ui wp wrap wrapper".split())
#: Names that begin so tell a layout, not what the element is (has-sidebar, no-comments).
_LAYOUT = frozenset("has no with without".split())
#: Characters to a tag from which on a line counts as prose, and prose of an article that needs no other.
PROSE = 10
ENOUGH = 500
#: Whether an element is declared as something else: no, if it is no prose (an ordinary word in a longer name),
#: perhaps (part of a name, a form), yes (its tag, a whole name).
NO, WEAK, PERHAPS, YES = range(4)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|post|entry|story)(?:$|[\s_-])|articlebody", re.I)
_SPACE = re.compile(r"\s+")


def declared(tag: str, marks: str) -> int:
    """What an element's tag and names (class, id, role, itemprop) say of it."""
    if tag in _OTHER_TAGS:
        return YES
    doubt = PERHAPS if tag == "form" else NO
    if tag in ("html", "body", "article", "main"):
        return doubt
    for name in marks.split():
        parts = [x for x in re.split("[_-]+", name) if x]
        if parts and parts[0].lower() not in _LAYOUT:
            other = [bool(_OTHER.fullmatch(x)) for x in parts]
            if all(other):
                return YES
            if any(other):
                sure = any(_STRONG.fullmatch(x) for x in parts) or all(
                    o or x.lower() in _PLACES or x.isdigit() for x, o in zip(parts, other))
                doubt = max(doubt, PERHAPS if sure else WEAK)
    return doubt


class Tree:
    """Elements in page order, so a parent's number is smaller; 0 is the page."""

    def __init__(self):
        self.parent = [0]
        self.article, self.holder, self.tagged = [False], [False], [False]  # tagged: an article or main element
        self.doubt = [NO]

    def add(self, parent: int, tag: str, article: bool, doubt: int) -> int:
        self.parent.append(parent)
        self.article.append(article)
        self.holder.append(tag in _HOLDERS)
        self.tagged.append(tag in ("article", "main"))
        self.doubt.append(doubt)
        return len(self.parent) - 1

    def summed(self, at: list[int], values: list[float]) -> list[float]:
        """Each element's sum of the values of lines inside it."""
        out = [0] * len(self.parent)
        for n, v in zip(at, values):
            out[n] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def inside(self, mark) -> list[bool]:
        """Whether an element or one around it is marked (a set of numbers, or a list of flags)."""
        flags = mark if isinstance(mark, list) else [n in mark for n in range(len(self.parent))]
        out = [bool(flags[0])]
        for n in range(1, len(flags)):
            out.append(bool(flags[n]) or out[self.parent[n]])
        return out

    def nearest(self, flags: list[bool]) -> list[int]:
        """The innermost flagged element around each (or itself), 0 if there is none."""
        out = [0]
        for n in range(1, len(flags)):
            out.append(n if flags[n] else out[self.parent[n]])
        return out


class Lines(HTMLParser):
    """Lines of (text, tags, element) from the parser's events, and the tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.tree = Tree()
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, number, dropped, doubt
        self.open: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
        self.blocks: list[int] = []  # places of blocks, and of elements in doubt
        self.doubts: list[int] = []
        self.outer: dict[int, int] = {}  # tags met before each open element in doubt
        self.tags = 0
        self.text: list[str] = []

    def end_line(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1] if self.stack else 0))
            self.tags = 0
        self.text = []

    def cut(self, at: int):
        """Close the elements from this place of the stack on."""
        for tag, *_ in self.stack[at:]:
            self.open[tag].pop()
        del self.stack[at:]
        for places in (self.blocks, self.doubts):
            while places and places[-1] >= at:
                places.pop()

    def pop_to(self, at: int):
        self.end_line()
        left = [self.outer.pop(n) for _, n, _, doubt in self.stack[at:] if doubt]
        if left:
            self.tags = left[0]
        self.cut(at)

    def handle_starttag(self, tag, attrs):
        dropped = bool(self.stack) and self.stack[-1][2]
        if not dropped:
            self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            if tag == "hr" and not dropped:
                self.end_line()
            return
        if tag in _BLOCKS:
            # a block ends an open paragraph, a list item the item before it
            name = self.stack[self.blocks[-1]][0] if self.blocks else None
            if name == "p" or name == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                self.pop_to(self.blocks[-1])
            self.end_line()
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
        gone = dropped or tag in _DROPPED or tag not in ("html", "body") and (
            any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            or any(k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs))
        doubt = NO if gone else declared(tag, marks)
        if (gone or doubt) and not dropped:
            self.end_line()
        article = tag in ("article", "main") or tag in ("div", "section", "td") and bool(_ARTICLE.search(marks))
        number = self.tree.add(self.stack[-1][1] if self.stack else 0, tag, article and not gone, doubt)
        at = len(self.stack)
        if doubt:
            self.outer[number], self.tags = self.tags, 0
            self.doubts.append(at)
        if tag in _BLOCKS:
            self.blocks.append(at)
        self.open[tag].append(at)
        self.stack.append((tag, number, gone, doubt))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        at = self.open[tag][-1]
        if not self.stack[at][2]:
            self.tags += 1
        if tag in _BLOCKS or self.stack[at][2] or self.stack[at][3]:
            self.pop_to(at)
        elif self.blocks and self.blocks[-1] > at:
            return  # an inline tag that closes across blocks
        elif self.doubts and self.doubts[-1] >= at:
            self.pop_to(at)
        else:
            self.cut(at)

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][2]):
            self.text.append(data)

    def close(self):
        super().close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma ** 2))
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach:reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach:reach + len(ratio)] / weight


def read_on(lines: list[tuple[str, int, int]], tree: Tree) -> list[tuple[str, int, int]]:
    """The lines outside of what is declared as something else.

    An element with an ordinary word in its name counts as content if it is
    prose. Another element in doubt counts as content after all if nothing
    outside such elements is an article, and it holds an article or most of the
    page's prose (a name that says so as a whole, or a tag: an article of most
    of the prose, or most of the prose and ``ENOUGH`` of it where hardly any is
    left).
    """
    if not any(tree.doubt):
        return lines
    at = [n for _, _, n in lines]
    chars, prose = [len(t) for t, _, _ in lines], [len(t) if len(t) >= PROSE * max(1, tags) else 0 for t, tags, _ in lines]
    total, held = sum(prose), tree.summed(at, prose)
    doubt = tree.doubt
    if WEAK in doubt:
        read, tags = tree.summed(at, chars), tree.summed(at, [max(1, tags) for _, tags, _ in lines])
        doubt = [d if d != WEAK else NO if held[n] * 2 > read[n] and read[n] >= 2 * PROSE * tags[n] else PERHAPS
                 for n, d in enumerate(doubt)]
    in_doubt, in_article = tree.inside([d != NO for d in doubt]), tree.inside(tree.article)
    article = sum(p for p, n in zip(prose, at) if in_article[n] and not in_doubt[n])
    cleared: set[int] = set()

    def blocked():
        return tree.inside([d != NO and n not in cleared for n, d in enumerate(doubt)])

    if total and article < ENOUGH and article * 10 < total:
        whole = [0] * len(doubt)  # prose of article elements inside
        for n in range(len(doubt) - 1, 0, -1):
            whole[tree.parent[n]] += held[n] if tree.tagged[n] else whole[n]
        cleared = {n for n, d in enumerate(doubt) if d == PERHAPS and (whole[n] or held[n] * 2 > total) or d == YES and whole[n] * 2 > total}
        gone = blocked()
        left = [(p, n) for p, n in zip(prose, at) if not gone[n]]
        rest = sum(p for p, _ in left)
        if rest < ENOUGH and rest * 10 < total and not any(in_article[n] for _, n in left):
            cleared |= {n for n, d in enumerate(doubt) if d and held[n] * 2 > total and held[n] >= ENOUGH}
    gone = blocked()
    return [line for line in lines if not gone[line[2]]]


def content(lines: list[tuple[str, int, int]], tree: Tree) -> list[str]:
    """The blocks of the page's content, in page order."""
    lines = read_on(lines, tree)
    if not lines:
        return []
    chars = np.array([len(t) for t, _, _ in lines], float)
    plain = chars / np.array([max(1, n) for _, n, _ in lines], float)
    ratio = smoothed(plain)
    threshold = SHARE * ratio.std()
    dense = ratio >= threshold
    # clusters of dense lines
    edge = np.flatnonzero(np.diff(np.concatenate([[False], dense, [False]]).astype(int)))
    regions = list(zip(edge[::2].tolist(), edge[1::2].tolist())) or [(0, len(lines))]
    core = []
    for a, b in regions:
        while a + 1 < b and plain[a] < threshold:  # smoothing carries a region over its edges
            a += 1
        while a + 1 < b and plain[b - 1] < threshold:
            b -= 1
        core += range(a, b)
    # elements that can hold the content: articles, and others of more than one line
    at = [n for _, _, n in lines]
    size = tree.summed(at, [1] * len(at))
    holder = [a or h and n > 1 for a, h, n in zip(tree.article, tree.holder, size)]
    around_article = tree.inside(tree.article)
    outermost = tree.nearest([a and not around_article[p] for a, p in zip(tree.article, tree.parent)])
    total = chars[core].sum()
    if sum(chars[i] for i in core if outermost[at[i]]) * 2 >= total:
        kept = {outermost[at[i]] for i in core} - {0}
    else:
        held = tree.summed([at[i] for i in core], [float(chars[i]) for i in core])
        kept = {max((n for n, h in enumerate(holder) if h and held[n] and held[n] >= AROUND * total), default=0)}
        if 0 in kept:
            return [t for t, _, _ in lines]
    inside, nearest = tree.inside(kept), tree.nearest(holder)
    # holders around lines of the kept elements, and in these
    around = tree.summed(at, [int(inside[n]) for n in at])
    alone = set()
    for i in core:
        if not inside[at[i]]:
            near = nearest[at[i]]
            if near and not around[near]:
                kept.add(near)
            else:
                alone.add(i)
    inside = tree.inside(kept)
    return [t for i, (t, _, n) in enumerate(lines) if i in alone or inside[n]]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    return "\n\n".join(content(parser.lines, parser.tree))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches):
        for batch in pieces(batches, 2, 2 << 20):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString() if "page_id" in pages.columns else "bigint"
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")
