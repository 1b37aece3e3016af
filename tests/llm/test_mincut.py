"""HTML extraction: cuts against all labellings, pages with planted parts, odd html."""

import html
import itertools
import random
import re

import pytest

from tabforge.llm import op13_mincut as M
from tabforge.llm.common import documents

NONE = M.weights({})
STORY = ["The committee met on Tuesday and talked for six long hours about the bridge over the river.",
         "Nobody had asked the people who live there, and several of them said so, loudly.",
         "It rained.", "A vote follows next week; the mayor expects a narrow result, as do most of the papers."]
PAGES = {
    "tags": "<body><header><h1>The Daily</h1></header><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><article><h2>Bridge</h2>{}"
            "</article></main><aside><p>Ten other stories that you will certainly like to read as well.</p></aside><footer>&copy; Daily</footer>",
    "names": '<body><div id="top-menu"><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div class="cookie-notice">We use cookies, as '
             'everybody does. Do you accept that?</div><div class="layout has-sidebar"><div class="entry-content"><h2>Bridge</h2>{}</div>'
             '<div class="commentlist"><p>What a great article, I read all of it twice and then again.</p></div></div><div class="site-footer">'
             '<p>All rights are reserved by the Daily and its owners, since 1901.</p></div>',
    "bare": "<body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/a>About</a></div><div><h2>Bridge</h2>{}</div><div><a href=/i>Imprint</a></div>",
    "nested": '<body><article><header><h2>Bridge</h2></header>{}<div class="ad">Buy a boat, cheaper than ever before, only today and only here.</div>'
              '<form><p>Sign up for the letter that we send every Friday evening.</p><input name=q></form><section id="comments"><p>I disagree '
              'with every single word of this, and so does my neighbour.</p></section></article>',
}


@pytest.mark.parametrize("page", sorted(PAGES))
def test_planted_parts(page):
    paragraphs = "".join(f"<p>{x}</p>" for x in STORY)
    assert M.main_text(PAGES[page].format(paragraphs), NONE) == " ".join(["Bridge", *STORY])
    advert = '<div class="advert-box"><p>The best boats of the whole wide world, half price, this week.</p></div>'
    split = "".join(f"<p>{x}</p>{advert}" for x in STORY)
    assert M.main_text(PAGES[page].format(split), NONE) == " ".join(["Bridge", *STORY])


def test_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 9)
        costs = [rng.choice([-2, -1, -.5, 0, .5, 1, 2]) * rng.random() * 2 for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < .5]

        def energy(keep):
            return sum(c for c, k in zip(costs, keep) if k) + sum(w for a, b, w in edges if keep[a] != keep[b])
        best = min(energy(x) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(M.minimum_cut(costs, edges)) - best) < 1e-9


def test_cut_of_a_long_chain():
    costs = [(-1) ** (i // 40) * (0.2 if i % 2 else 0.7) for i in range(4000)]
    edges = [(i, i + 1, 1.2) for i in range(3999)]
    keep = M.minimum_cut(costs, edges)
    # a chain's optimum by dynamic programming
    best = [0.0, costs[0]]
    for c in costs[1:]:
        best = [min(best[0], best[1] + 1.2), min(best[1], best[0] + 1.2) + c]
    assert abs(sum(c for c, k in zip(costs, keep) if k) + sum(1.2 for a, b in zip(keep, keep[1:]) if a != b) - min(best)) < 1e-9


def test_text_of_blocks():
    page = "<article><p>A&amp;B &lt;i&gt; x<b>y</b>z\n\t two&nbsp;words<br>three<script>p('<p>no</p>')</script> four &am</p stray><p>un<i>closed<p>next</article>"
    assert [b.text for b in M.blocks(page)] == ["A&B <i> xyz two words three four &am", "unclosed", "next"]


@pytest.mark.parametrize("page", ["", "<", "<p", "<p class=\"", "</p>", "<!-- x", "<script>", "<script>x", "&", "a < b > c", "<a" * 500, "<p>" * 3000,
                                  "<b>" * 20_000 + "x" + "<p>" * 2000, "<ul>" + "<li><b>x" * 3000, "<title>x", "<div style='display: none'>x</div>", "\0<p>퟿"])
def test_odd_pages(page):
    assert isinstance(M.main_text(page, NONE), str)


def test_long_page():
    paragraphs = "".join(f"<p>{STORY[i % 4]} {i}.</p>" for i in range(20_000))
    assert M.main_text(PAGES["tags"].format(paragraphs), NONE).count(" ") > 200_000


def test_pages_of_the_table(spark):
    """The tables' pages hold their story in one article of headings and paragraphs."""
    pages = documents(spark, "/root/testdata/sf0.1", "pages")
    want = {}
    for r in pages.collect():
        inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", r.html, re.S)[1])
        parts = (" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", inner))
        want[r.page_id, r.url] = " ".join(x for x in parts if x)
    got = M.extract(pages).collect()
    assert len(got) == len(want) and {(r.page_id, r.url): r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (3, "v", PAGES["tags"].format("<p>" + STORY[0]), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in M.extract(df).collect())
    assert got == [(0, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (3, "v", f"Bridge {STORY[0]}", len(STORY[0]) + 7)]
    assert M.extract(df.limit(0)).count() == 0


def test_learns_from_a_sample(spark):
    pages = documents(spark, "/root/testdata/sf0.1", "pages")
    some, all_ = M.learn(pages, 500), M.learn(pages, 10 ** 9)
    assert some != all_ and all(abs(a - b) < 0.6 for f in all_ for a, b in zip(some[f], all_[f]))
