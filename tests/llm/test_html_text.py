import pytest

from wellspring.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p><p>no</p>";</script></head><body>
<header class="top"><a href="/">Home page</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site a better place for all of you.</div><!-- <p>hidden</p> -->
<article><h1>A &amp; B</h1><p>First <b>bold</b>
  text&nbsp;here &eacute;&#233;.<p>Short.<div class="ad">Buy this thing now for very little money today only.</div>
<ul><li>item <a href="/x">link</a></li></ul><form>Your name <input name="n"><button>Send</button></form><br>Last one.</article>
<aside>More to read in our sidebar about many other things.</aside><section id="comments"><p>I like this article very much, thank you for it.</p></section>
<footer>&copy; All rights reserved by the owners of this page.</footer></body></html>"""


def test_article_only():
    assert ht.extract(PAGE) == "A & B First bold text here éé. Short. item link Last one."


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a b"), ("<div>x &lt;b&gt; y</div>", "x <b> y"), ("<p>unclosed <b>bold", "unclosed bold"),
        ("</p></div>stray ends", "stray ends"), ("<script>never closed", ""), ("<article><p>a &amp;amp; b</p></article>", "a &amp; b"), ("<article>5 < 6 and 7 > 2</article>", "5 < 6 and 7 > 2"),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>", "yes"), ("<nav><p>menu words</p></nav>", ""),
        ("<article><p>" + "word " * 40_000 + "</p></article>", ("word " * 40_000).strip()),
    ],
)
def test_cases(page, want):
    assert ht.extract(page) == want


def test_the_tree_fits_its_table():
    import numpy as np

    rows = np.array(ht.BLOCKS, float)
    assert (ht.decide(ht.tree(), rows[:, :-1]) == rows[:, -1].astype(bool)).mean() > 0.95
    held = np.arange(len(rows)) % 4 == 0
    got = ht.decide(ht.grow(rows[~held, :-1], rows[~held, -1]), rows[held, :-1])
    assert (got == rows[held, -1].astype(bool)).mean() >= 0.8


def test_query(spark, small):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    got = sorted(map(tuple, ht.extract_pages(spark, df).collect()), key=str)
    assert got[0] == got[1] == (1, "u", ht.extract(PAGE), len(ht.extract(PAGE))) and got[2] == (None, None, "", 0)
    assert ht.extract_pages(spark, df.limit(0)).count() == 0
    real = ht.query(spark, small).collect()
    assert real and all("©" not in r.text and "track(" not in r.text and r.n_chars == len(r.text) for r in real)


TEXT = "<p>This is the text of a page, long enough to be told from furniture by anyone.</p>"


@pytest.mark.parametrize("page", ['<div class="content no-sidebar">{}</div>', '<div class="page nav-closed">{}</div>', '<div class="modal"><article>{}</article></div>', '<div id="header"><main>{}</main></div>', '<div class="main sidebar">{}</div>', '<div class="content has-sidebar"><article>{}</article></div>', '<div class="layout no-header"><article>{}</article></div>', '<div class="right-sidebar single-post"><article>{}</article></div>', '<form id="aspnetForm"><article>{}</article></form>', '<form id="aspnetForm"><div>{}</div></form>', '<div aria-label="main story and comments"><article>{}</article></div>', '<div class="comments-open widget-area"><main>{}</main></div>', '<div class="right-sidebar single-post">{}</div>'])
def test_words_of_a_wrapper_do_not_empty_the_page(page):
    assert ht.extract(page.format(TEXT)) == TEXT[3:-4]


@pytest.mark.parametrize("page", ['<div class="sidebar">{}</div>', '<article><div class="ad">{}</div></article>', '<aside class="content">{}</aside>', '<div id="comments"><article class="comment-body">{}</article></div>', '<div class="modal"><article></article>{}</div>'])
def test_furniture_still_goes(page):
    assert ht.extract(page.format(TEXT)) == ""


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="right-sidebar single-post">{}</div>', '<section aria-label="main story and comments">{}</section>'])
def test_furniture_inside_a_layout_still_goes(wrap):
    inner = PAGE[PAGE.index("<header") : PAGE.index("</body>")]
    assert ht.extract(PAGE.replace(inner, wrap.format(inner))) == ht.extract(PAGE)


def test_deep_nesting():
    assert ht.extract('<div class="ad">' * 20_000 + "no" + "</div>" * 20_000 + "<p>yes it is") == "yes it is"


def brute(page):
    """The main text of a page of the table, whose markup is simple: what stands in its article, by regular expressions."""
    import html
    import re

    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    inner = re.sub(r"<(/?(?:p|br|h1|ul|li|div))(?:\s[^>]*)?>", "\n", found[1] if found else "")
    lines = [html.unescape(re.sub(r"<[^>]*>", "", x)) for x in inner.split("\n")]
    return " ".join(" ".join(lines).split())


def test_pages_as_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r.page_id: r.text for r in ht.query(spark, small).collect()}
    assert len(got) == len(pages) > 20 and all(got[p.page_id] == brute(p.html) for p in pages)


def test_words_and_links_tell_text_where_nothing_is_named(spark, small):
    """Names taken away, the tree goes by word counts, link density and neighbours alone."""
    import re

    words = kept = lost = 0
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        plain = re.sub(r"<(/?)(?:nav|footer|article|header|main)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", p.html or ""))
        own, want = ht.blocks(plain), ht.extract(p.html)
        verdicts = ht.decide(ht.tree(), ht.features(own)) if own else []
        for b, keep in zip(own, verdicts):
            words += b.words
            lost += b.words * (not keep and b.text in want)
            kept += b.words * bool(keep and b.text not in want)
    assert lost < 0.01 * words and kept < 0.1 * words, (lost, kept, words)


def test_every_column_of_the_tree_is_told_from_the_table():
    """Without the furniture column, most labels still follow from words, links and neighbours."""
    import numpy as np

    rows = np.array(ht.BLOCKS, float)
    x, y = rows[:, :-1].copy(), rows[:, -1]
    x[:, ht.FEATURES.index("furniture")] = 0
    assert (ht.decide(ht.grow(x, y), x) == y.astype(bool)).mean() > 0.85
