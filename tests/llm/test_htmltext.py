import re
import time

import pytest

from cartolith.llm import htmltext

SF = "/root/testdata/sf0.01"
TREE = htmltext.train()

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a><p>The daily paper of the whole wide world and of its many neighbours, since long ago</p></header>
<nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav><div id="cookie-notice"><p>We use cookies to make this site work for you and for all others as well.</p></div>
<main><article><header><h1>A   heading&nbsp;here</h1></header><p>First <b>bold paragraph with <a href="x">a link</a> and &lt;angle&gt; brackets
in it.<p>Second, unclosed <i>paragraph<br>with a break.</p><div class="ad">Buy this wonderful thing now, it is cheap and good and new.</div><!-- a > comment -->
<ul><li>One<li>Two</ul><p>End.</p><form><label>Name</label><input name=n><p>Send us your name and your mail and all the rest</p></form>
<section class="comments"><h2>Comments</h2><article><p>I liked this article very much, it was as long as it was good, thank you.</p></article></section></article></main>
<aside><p>Sidebar text which is as long as a paragraph, to look like one to any rule of thumb.</p></aside><footer>&copy; all</footer></body></html>"""


def test_page_with_all_furniture():
    assert htmltext.main_text(PAGE, TREE).split("\n") == [
        "A heading here", "First bold paragraph with a link and <angle> brackets in it.", "Second, unclosed paragraph with a break.", "One", "Two", "End.",
    ]


def test_page_without_regions():
    body = "<div>{}</div>"
    long = "word " * 40
    page = "<body>" + "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(6)) + "<h2>Head of it</h2>" + body.format(long) * 3 + '<div><a href="/x">more</a></div>'
    assert htmltext.main_text(page, TREE).split("\n") == ["Head of it", *[long.strip()] * 3]


def test_links_tell_on_pages_without_regions():
    text = "<div>" + "plain words of the page " * 9 + "</div>"
    links = "<div>" + '<a href="/x">a link of five words</a> ' * 8 + "</div>"
    assert htmltext.main_text("<body>" + links + text * 3 + links * 2 + "</body>", TREE).split("\n") == [("plain words of the page " * 9).strip()] * 3


def test_held_out_pages_without_their_regions(spark):
    """Precision and recall of blocks on pages that gave no labelled rows, with regions withheld; with regions, all are right."""
    hits = of_chosen = of_main = wrong = 0
    for row in spark.read.parquet(f"{SF}/pages.parquet").where("page_id % 5 > 1").collect():
        for _, features in htmltext.blocks(row.html):
            main = features[6] == 1
            wrong += htmltext.judge(TREE, features) != main
            chosen = htmltext.judge(TREE, [*features[:6], 0, features[7]])
            hits, of_chosen, of_main = hits + (chosen and main), of_chosen + chosen, of_main + main
    assert wrong == 0 and hits / of_chosen > 0.99 and hits / of_main > 0.92


def test_broken_and_empty_pages():
    for page in (None, "", "<", "<p", "text", "<article><p>unclosed", "<script>never ends", "<!-- never ends", "<a title='x>y", "</p></div>", "a < b and c > d", "<p>" * 3000 + "deep"):
        htmltext.main_text(page, TREE)
    assert htmltext.main_text("<article><p>unclosed", TREE) == "unclosed"


@pytest.mark.parametrize(
    "page",
    ["<div><p>a" * 20_000, "<a '" * 20_000, "<div>" * 20_000 + "</section>" * 20_000, "<dt><div>" + "<li><option>" * 20_000 + "</dt>" * 20_000, "> " + "<!-- " * 20_000, "<svg " * 20_000 + "/>"],
    ids=["unclosed", "quotes", "never opened", "loose", "comments", "raw"],
)
def test_broken_pages_take_time_by_their_length(page):
    start = time.process_time()
    htmltext.main_text(page, TREE)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post tags-news"><p>{}</p></article>', '<div class="widget-area"><article><p>{}</p></article></div>', '<div class="entry-content share-enabled"><p>{}</p></div>',
        '<article><p class="related-work">{}</p></article>', '<div class="modal-host"><main class="content"><h2 class="banner">x</h2><p>{}</p></main></div>', '<article id="search-engines"><p>{}</p></article>',
    ],
)
def test_names_are_hints(page):
    text = "Words of an article that is long enough to be told from furniture by its words alone. " * 3
    assert text.strip() in htmltext.main_text(page.format(text), TREE)


@pytest.mark.parametrize(
    "page",
    [
        '<article><div class="post-comments"><p>{}</p></div></article>', '<section class="comments"><article class="entry"><p>{}</p></article></section>', '<article><p class="ad">{}</p></article>',
        '<div class="sidebar"><article><p>{}</p></article></div>', '<article><div class="share-bar"><p>{}</p></div></article>', '<nav class="content"><p>{}</p></nav>',
    ],
)
def test_furniture_by_name(page):
    text = "Words of furniture that is long enough to be taken for an article by its words alone. " * 3
    assert htmltext.main_text(page.format(text), TREE) == ""


def test_unclosed_at_the_end():
    p = "<article><p>text</p></article>"
    for end in ("<script>never </svg>", "<script>never > ends", "<!--> never", "<!-- never > ends", "<script>", "<style>p > a {", "<!-- never"):
        assert htmltext.main_text(p + end, TREE) == "text", end
    assert [t for t, _ in htmltext.blocks("<p>a</p><script></script >b")] == ["a", "b"]


def test_table_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = htmltext.extract(pages).collect()
    assert len(rows) == pages.count()
    html_of = {r.page_id: r.html for r in pages.collect()}
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)</article>", html_of[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 6), (2, "v", "<p>x</p>" + "<p>" + "w " * 200_000, 7), (2, "v", "<article>y</article>", 7)], "page_id long, url string, html string, text int")
    rows = htmltext.extract(pages).collect()
    assert [(r.page_id, r.url) for r in rows] == [(1, None), (None, "u"), (2, "v"), (2, "v")] and rows[3].text == "y" and rows[0].text == ""
    assert htmltext.extract(pages.where("false")).count() == 0
