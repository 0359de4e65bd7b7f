import html
import re
import time

import pytest

from tsrisk.llm import html_text as H
from tsrisk.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header class="site-header">Site</header>
<nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side</p></div>{main}<form>Name <input name=x><button>Go</button></form>
<script>if (a < b) document.write("<p>no</p>")</script><div class="ad">Buy</div><footer>&copy; end</footer></body></html>"""


def text_of(main):
    return H.main_text(PAGE.format(main=main))


def test_article_without_all_that_stands_beside_it():
    main = """<article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>
 two&nbsp;&lt;three&gt;<br>four<p>Unclosed<ul><li>a<li>b</ul><!-- <p>hidden</p> --><div class="share-buttons">Share</div>
<table><tr><td>x<td>y</table><section class="comments"><p>Nice!</p></section></article>"""
    assert text_of(main) == "Head&line\n\nOne bold two <three> four\n\nUnclosed\n\na\n\nb\n\nx\n\ny"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p", "<p"), ("plain &amp; simple", "plain & simple"), ("<p>a</p></p></div><p>b", "a\n\nb"), ("a < b", "a < b"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<script>never closed <p>x", ""), ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<p>x</p>" * 3, "x\n\nx\n\nx"), ("<nav>only menu</nav>", ""),
])
def test_edges(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a \"" * 250_000, "<a ='" * 200_000, "<a x=\"y\" " * 100_000 + "=\">\"", "</p " * 250_000, "<" * 1_000_000,
    "<x>" * 150_000 + "<li></li>" * 50_000, "<li><ul>" + "<x>" * 150_000 + "<li></li>" * 50_000, "<x>" * 150_000 + "<title>a<b>" * 50_000,
    "<table><p>" + "<x></td>" * 100_000, "<!--" * 250_000, "<script>" * 100_000, "&#" + "9" * 1_000_000 + ";", "<p class='" * 100_000, "<p id= " * 100_000 + ">",
])
def test_broken_pages_of_a_megabyte_take_linear_time(page):
    start = time.process_time()
    H.main_text(page), H.page_nodes(page)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(("page", "text"), [
    ("<p it's>one</p><p>it's two</p>", "one\n\nit's two"), ("<p title='a>b' x = \"c>d\">t</p>", "t"), ("<p title='never closed>t</p>", "t"),
    ("<p>a<b x='>c'", "ac'"), ("<p>a</p><b <i", "a\n\n<b <i"), ("x&#" + "0" * 9000 + "65;&#" + "9" * 9000 + ";y", "xA\ufffdy"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
])
def test_tag_ends_and_implied_ends(page, text):
    assert H.main_text(page) == text


STORY = " ".join("The story goes on." for _ in range(20))


@pytest.mark.parametrize("page", [
    "<html><head><meta charset=utf-8><title>t</title><body><p>{0}</p></body></html>", "<title>t</title><p>{0}", "<head><title>t</title><p>{0}",
    "<body><form id=f><nav>menu</nav><p>{0}</p><div class=ad>buy</div></form>", "<body><nav><ul><li>menu</ul><article><p>{0}</article>",
    "<div class='layout has-sidebar'><p>{0}</p></div><div class=sidebar>x</div>", "<div class='entry no-sidebar'>{0}</div><div class=ad>y</div>",
    "<div class='header-fixed wrapper'><p>{0}</p><div class=comments>Nice</div></div>", "<article class='post has-comments'>{0}</article>",
    "<article><p>{0}</p></article><div class=comments><p>{0}</p><p>{0}</p></div>", "<body style='display:none'><div>{0}</div><footer>f</footer>",
])
def test_names_never_take_most_of_a_page(page):
    assert H.main_text(page.format(STORY)) == STORY


def test_parts_of_one_name_stay_together_and_anchors_name_nothing():
    assert H.main_text("<body>" + "<div class=widget><p>part of it</p></div>" * 8) == "\n\n".join(["part of it"] * 8)
    assert H.main_text(f"<article><h2 id=related-search>Head</h2><p>{STORY}</p></article>") == f"Head\n\n{STORY}"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "h", "t", 1) for r in rows], "page_id long, url string, html string, host string, text string, low int")


def test_tree_cuts_what_all_pages_share(spark):
    """No names, no article: only the pages of the host tell the menu from the text."""
    made = [
        (i, f"http://h.example/{i}", f"<body><div><p>Home</p><p>About</p></div><section><p>Story {i} {'word ' * i}</p></section></body>") for i in range(12)
    ]
    made += [(50, "http://other.example/", made[0][2]), (51, None, made[0][2]), (52, "http://h.example/x", None), (53, "nonsense", "<p>x</p>"), (3, *made[3][1:])]
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(pages(spark, *made)).collect()}
    assert all(got[i][1] == " ".join(f"Story {i} {'word ' * i}".split()) for i in range(12))
    assert got[50][1] == got[51][1] == "Home\n\nAbout\n\nStory 0" and got[52][1:] == ("", 0) and got[53][1] == "x"
    assert H.extract(pages(spark, *made)).count() == len(made) and H.extract(pages(spark, *made).limit(0)).count() == 0


def test_teasers_do_not_replace_the_story_and_the_tree_cuts_inside_articles(spark):
    teaser = "<article><p>Read this too</p></article>"
    assert H.main_text(f"<div class=content><p>{STORY}</p></div>{teaser}") == f"{STORY}\n\nRead this too"
    assert H.main_text(f"<p>Short</p><article><p>{STORY}</p></article>") == STORY
    made = [
        (i, "http://h.example/", f"<div class=content><p>Story {i} {STORY}</p></div>{teaser}") for i in range(8)
    ] + [
        (i, "http://g.example/", f"<article><h4>By the desk</h4><p>Story {i} <b>now</b> {STORY}</p></article>") for i in range(8, 16)
    ]
    got = {r.page_id: r.text for r in H.extract(pages(spark, *made)).collect()}
    assert got == {i: f"Story {i} {STORY}" if i < 8 else f"Story {i} now {STORY}" for i in range(16)}


def test_importance_is_the_entropy_of_what_a_node_shows(spark):
    made = [(i, "http://h.example/", f"<div>same</div><section>{i % 2}</section><p>{i}</p>") for i in range(4)]
    tree = {r.path: r for r in H.site_tree(pages(spark, *made)).collect()}
    paths = {node.tag: node.path - (1 << 64 if node.path >> 63 else 0) for event, node in H.walk(made[0][2]) if event == "open"}
    content = {tag: tree[path].importance for tag, path in paths.items()}
    w = H.CONTENT_WEIGHT
    assert content == pytest.approx({"div": 0.0, "section": w * 0.5, "p": w})


def test_copies_of_one_article_keep_their_text(spark):
    made = [(i, "http://h.example/", "<div class=post><p>Same story</p><p>Told twice</p></div>") for i in range(20)]
    assert {r.text for r in H.extract(pages(spark, *made)).collect()} == {"Same story\n\nTold twice"}


def test_query(spark, folder):
    given = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op9_html_text"](spark, folder).collect()
    assert len(got) == len(given)
    for r in got:
        article = re.search(r"<article>(.*)</article>", given[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
