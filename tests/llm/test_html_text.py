import random
import re
from html import unescape

import pytest

from tablewright.llm.html_text import extract, main_text

BODY = "<p>First &amp; <b>bold</b> text that goes on for a while, as paragraphs do.</p><p>Short.</p><p>Second\n  paragraph&nbsp;with more words than the menu has.</p>"
TEXT = "First & bold text that goes on for a while, as paragraphs do. Short. Second paragraph with more words than the menu has."


@pytest.mark.parametrize("page,want", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>one<p>two<br>three", "one two three"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Head</h1>{BODY}</article><footer>f</footer>", "Head " + TEXT),
    (f"<body><header>Site</header><main>{BODY}<form><label>Name</label><input></form></main><aside>Side</aside>", TEXT),
    (f"<body><div class='cookie-notice'>We use cookies</div><div id=content>{BODY}</div><div class=comments><p>{'I disagree. ' * 30}</p></div>", TEXT),
    (f"<article><header><h1>Head</h1></header>{BODY}<div class='ad'>Buy</div><section id='comments'><p>Me too</p></section></article>", "Head " + TEXT),
    (f"<article>{BODY}<script>var t='</p><p>x';</script><!-- <p>hidden</p> --></article>", TEXT),
    ("<article><p>a<b>b<p>c</b>d</article>", "ab cd"), ("<article><ul><li>x<li>y</ul></article>", "x y"),
    ("<article>&lt;b&gt; &#233; &unknown; &copy;</article>", "<b> é &unknown; ©"), ("<article><p>open <b>never closed", "open never closed"),
    ("<article><p>in<button>Press</button>side</p></article>", "in side"), ("<nav><a>only a menu</a></nav>", ""),
    ("<div><p>" + "x" * 300000 + "</p></div>", "x" * 300000),
    (f"<body><div role='navigation'>n</div><article>{BODY}</article><article class='x'><p>{'Another long article of the same page. ' * 3}</p></article>", None),
])
def test_pages(page, want):
    got = main_text(page)
    if want is None:
        assert got == TEXT + " " + ("Another long article of the same page. " * 3).strip()
    else:
        assert got == want


def test_deep_and_broken_markup_ends():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<" * 1000 + "a" + "<p" * 50) is not None


def test_pages_against_brute_force(spark):
    r = random.Random(1)
    words = ["alpha", "b&amp;c", "<b>bold</b>", "é", "x<br>y", "long" * 4]
    rows, want = [], {}
    for i in range(80):
        body = "".join("<p>" + " ".join(r.choice(words) for _ in range(r.randrange(1, 60))) + r.choice(["</p>", ""]) for _ in range(r.randrange(1, 8)))
        rows.append((i, f"http://x/{i}", f"<html><body><nav>{'<a href=x>menu</a>' * 6}</nav><article>{body}</article><footer>end of it</footer></body></html>", "z"))
        want[i] = " ".join(unescape(re.sub("<[^>]+>", "", re.sub("<(p|/p|br)>", " ", body))).split())
    rows += [(None, None, None, "z"), (1000, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(pages).collect()
    assert len(got) == 82 and extract(pages.limit(0)).count() == 0
    for g in got:
        assert g.text == want.get(g.page_id, "") and g.n_chars == len(g.text)


@pytest.mark.parametrize("page,want", [
    (f"<body><header>Site</header><div class='wrap has-sidebar'><article>{BODY}</article><div class=sidebar>Side</div></div></body>", TEXT),
    (f"<body><form action=x><div class=menu><a>Menu</a></div><article>{BODY}</article><input></form></body>", TEXT),
    (f"<body><form><div id='has-share'><div>{BODY}</div></div><nav>n</nav></form></body>", TEXT),
    (f"<body><article>{BODY}</article><div id=comments><article><p>{'I disagree. ' * 300}</p></article></div></body>", TEXT),
])
def test_what_the_page_stands_in_is_not_dropped(page, want):
    assert main_text(page) == want


def test_wrappers_of_any_number_are_released():
    for n in (8, 9, 10, 50):
        page = "<div class='sidebar wrap'>" * n + "<article><p>The whole text of the page stands here.</p></article>" + "</div>" * n
        assert main_text(page) == "The whole text of the page stands here."


def test_headings_and_paragraphs_of_an_article_are_told_by_no_name():
    page = (
        "<article><h2 class='section-header'>Heading two</h2><p>Body text follows here.</p><p class='share-price'>Share price of the firm rose.</p>"
        "<p class='social'>Social work.</p><div class='header'>Own header</div><p id='search-results'>Results of the search.</p>"
        "<div class='share'><p>Share this</p></div><p hidden>gone</p></article>")
    assert main_text(page) == "Heading two Body text follows here. Share price of the firm rose. Social work. Own header Results of the search."
