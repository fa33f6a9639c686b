import random
import time

import pytest

from prefloom.llm import html_ratio as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and by reading on you agree to all of them without limits.</div>
<!-- ad --><div class=ad>Buy now! <a href=x>more</a></div>
<article><h1>The  title &amp; more</h1><p><b>First paragraph of
 the text that goes on for a while.<br>And on.<p>Short.</p><ul><li>one<li>two</ul>
<div class="sidebar"><p>Something else entirely, which is long enough to look like a text of its own.</p></div>
<p>Last paragraph &#8212; with caf&eacute; and so on, long enough to count as prose.</p></article>
<section id="comments"><p>Great article, I read it twice and so did all of my friends and their friends!</p></section>
<form><label>Name</label><input name=q><button>Go</button></form><footer>&copy; somebody</footer>"""
TEXT = ["The title & more", "First paragraph of the text that goes on for a while. And on.", "Short.", "one", "two",
        "Last paragraph — with café and so on, long enough to count as prose."]


def test_article_alone():
    assert H.main_text(PAGE) == "\n\n".join(TEXT)


def test_page_without_article_element():
    body = "".join(f"<p>{s} and some more words so that it is a paragraph.</p>" for s in ("One", "Two", "Three"))
    page = f"<body><div id=top><a href=x>a</a> <a href=y>b</a> <a href=z>c</a></div><div id=text>{body}</div></body>"
    assert H.main_text(page).split("\n\n") == [f"{s} and some more words so that it is a paragraph." for s in ("One", "Two", "Three")]


@pytest.mark.parametrize("page", [None, "", " \n ", "<html><body></body></html>", "<script>x", "<!-- a -->", "<nav>menu</nav>", "<<<>>>"[:0]])
def test_pages_without_text(page):
    assert H.main_text(page) == ""


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y"),
            (3, "w", "<article>" + "<p>word word</p>" * 20_000 + "</article>", "z"), (4, "d", "<div>" * 3000 + "deep text", "z")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = H.extract(table).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [
        (0, 0), (1, len("\n\n".join(TEXT))), (1, len("\n\n".join(TEXT))), (2, 0), (3, 20_000 * 9 + 19_999 * 2), (4, 9)]
    assert H.extract(table.where("false")).count() == 0


LONG = "A long paragraph of plain words that goes on and on. " * 40
SIDE = "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "News", "Sport", "More"))


@pytest.mark.parametrize("block", ["<p>{}</p>", "<div>{}</div>", "<div><p>{}</p></div>", "<h2>{}</h2>"])
def test_uneven_blocks_stay_together(block):
    texts = [LONG.strip(), *(f"Paragraph {i} has about sixty characters, no more, no less." for i in range(4))]
    page = f"<body><ul>{SIDE}</ul><div class=content>" + "".join(block.format(t) for t in texts) + "</div></body>"
    assert H.main_text(page).split("\n\n") == texts


def test_sections_parted_by_lists_are_all_kept():
    texts = [f"{i} " + LONG.strip() for i in range(4)]
    parts = (f"<ul>{SIDE * 4}</ul>").join(f"<section><h2>Head {i}</h2><p>{t}</p></section>" for i, t in enumerate(texts))
    out = H.main_text(f"<body><ul>{SIDE}</ul><div id=content>{parts}</div></body>").split("\n\n")
    assert [t for t in out if len(t) > 100] == texts
    assert [t for t in out if t.startswith("Head")] == [f"Head {i}" for i in range(4)]


def test_regions_outside_the_article_are_kept():
    page = (f"<body><ul>{SIDE * 4}</ul><article><p>{LONG}</p></article><ul>{SIDE * 4}</ul>"
            f"<div><h2>On</h2><p>{LONG[:900]}</p></div><ul>{SIDE * 4}</ul></body>")
    assert H.main_text(page).split("\n\n") == [LONG.strip(), "On", LONG[:900].strip()]


def test_table_with_uneven_cells():
    rows = "".join(f"<tr><td>{i}</td><td>{LONG if i == 2 else 'short cell'}</td></tr>" for i in range(5))
    out = H.main_text(f"<body><div><ul>{SIDE}</ul></div><div><table>{rows}</table></div></body>")
    assert out.split("\n\n") == [t for i in range(5) for t in (str(i), LONG.strip() if i == 2 else "short cell")]


@pytest.mark.parametrize("wrapper", [
    "<div class='site has-sidebar'>", "<div class=no-comments>", "<section class=with-header>", "<div class=elementor-widget-text>",
    "<div id=main-header-wrap>", "<form action=/>", "<div class=sidebar>", "<header>", "<div id=page-nav><div class=has-ads>"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div id=text>{}</div>"])
def test_wrappers_around_the_page(wrapper, inner):
    texts = ["A title", *(f"{i} " + LONG.strip() for i in range(3))]
    text = inner.format("".join(f"<p>{t}</p>" for t in texts))
    page = (f"<body><a href=x>Skip</a>{wrapper}<nav>{SIDE}</nav>{text}<div class=comments><p>{LONG[:500]}</p></div>"
            f"<footer><p>{LONG[:300]}</p></footer>")
    assert H.main_text(page).split("\n\n") == texts if "article" in inner else set(texts) <= set(H.main_text(page).split("\n\n"))
    assert LONG[:500].strip() not in H.main_text(page).split("\n\n")


def test_many_comments_do_not_hide_the_article():
    text = "<p>" + LONG + "</p><p>The end.</p>"
    comments = "".join(f"<article class=comment-body><p>{i} {LONG}</p></article>" for i in range(40))
    page = f"<body><article>{text}</article><div class=comment-list>{comments}</div><nav>{SIDE * 20}</nav>"
    assert H.main_text(page).split("\n\n") == [LONG.strip(), "The end."]


def test_declared_elements_alone_have_no_text():
    assert H.main_text(f"<body><nav>{SIDE * 50}</nav><footer>&copy; somebody</footer>") == ""


@pytest.mark.parametrize("page", ["<div>x" * 60_000, "<b>" * 60_000 + "<p>x" * 1000, "<div>" * 40_000 + "</i>" * 40_000 + "x",
                                  "<p><b>x" * 40_000, "<div class=share-price>x" * 20_000])
def test_deep_and_unclosed_elements_take_linear_time(page):
    start = time.time()
    H.main_text(page)
    assert time.time() - start < 20  # a second or two; a copy of the path for each line takes hours


@pytest.mark.parametrize("tag", ["div class=related-work", "section id=share-prices", "div class=respond-time", "div class=social-history",
                                 "section class='notice-period'", "div id=banner_years"])
def test_ordinary_words_in_names_do_not_remove_prose(tag):
    texts = [f"{i} " + LONG.strip() for i in range(3)]
    name = tag.split()[0]
    page = f"<body><nav>{SIDE}</nav><article><p>{texts[0]}</p><{tag}><p>{texts[1]}</p></{name}><p>{texts[2]}</p></article></body>"
    assert H.main_text(page).split("\n\n") == texts
    links = page.replace(f"<p>{texts[1]}</p>", f"<ul>{SIDE}</ul>")
    assert H.main_text(links).split("\n\n") == [texts[0], texts[2]]


@pytest.mark.parametrize("tag", ["div class=comment-thread", "div id=related-posts", "div class=social-links", "section class=cookie-notice",
                                 "div class=comments", "div class='share share-bar'"])
def test_names_of_other_things_remove_them(tag):
    texts = [f"{i} " + LONG.strip() for i in range(3)]
    name = tag.split()[0]
    page = f"<body><article><p>{texts[0]}</p><{tag}><p>{texts[1]}</p></{name}><p>{texts[2]}</p></article></body>"
    assert H.main_text(page).split("\n\n") == [texts[0], texts[2]]


def in_paragraphs(elements):
    """Every line's elements as they are, without sums: what the tree must give."""
    tree, paths = H.Tree(), [[0]]
    for parent, marked in elements:
        n = tree.add(parent, "div", marked, H.NO)
        paths.append([*paths[parent], n])
    return tree, paths


def test_tree_sums_and_marks():
    rng = random.Random(2)
    for _ in range(50):
        elements = [(rng.randrange(n + 1), rng.random() < 0.2) for n in range(rng.randrange(1, 40))]
        tree, paths = in_paragraphs(elements)
        at = [rng.randrange(len(paths)) for _ in range(30)]
        values = [rng.randrange(9) for _ in at]
        assert tree.summed(at, values) == [sum(v for n, v in zip(at, values) if k in paths[n]) for k in range(len(paths))]
        assert tree.inside(tree.article) == [any(tree.article[k] for k in p) for p in paths]
        assert tree.nearest(tree.article) == [max((k for k in p if tree.article[k]), default=0) for p in paths]
