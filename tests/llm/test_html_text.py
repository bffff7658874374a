"""Main text: pages of known truth, the linear scan against all runs, and odd markup."""

import itertools
import time

import pytest

from strandline.llm import html_text as h

WORDS = "the old house by the river was sold last week to a young family from the north".split()
MENU = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:6]) + "</ul></nav>"


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{MENU}<!-- ad --><div class="ad">buy this now</div>{body}{extra}<footer>&copy; all rights</footer></body></html>'


def test_article_without_the_rest():
    body = "<article><h1>Title  one</h1><p><b>First\n&lt;b&gt; &eacute;&nbsp;x<br>next<p>Second <a href='/q'>linked</a> end.</p><ul><li>i</li><li>ii</li></ul><p>Last.</p></article>"
    extra = '<section id="comments"><p>' + " ".join(WORDS * 30) + '</p></section><aside>side</aside><form><p>Name</p></form><div class="cookie-notice">We use</div>'
    want = "Title one\n\nFirst <b> é x next\n\nSecond linked end.\n\ni\n\nii\n\nLast."
    assert h.main_text(page(body, extra), h.DEFAULT) == want


def test_page_that_names_no_article():
    body = "<div><h1>Head</h1>" + "".join(f"<p>{' '.join(WORDS)} {k}</p>" for k in range(4)) + "</div>"
    want = "Head\n\n" + "\n\n".join(f"{' '.join(WORDS)} {k}" for k in range(4))
    assert h.main_text(page(body), h.DEFAULT) == want


def test_parts_inside_the_article_that_are_not_of_it():
    body = f"<article><p>{' '.join(WORDS)}</p><div class='related-posts'><p>{' '.join(WORDS * 20)}</p></div><p>After it.</p></article>"
    assert h.main_text(page(body), h.DEFAULT) == " ".join(WORDS) + "\n\nAfter it."


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain words & more", "plain words & more"), ("<p>a < b and c > d", "a < b and c > d"), ("<script>never closed words", ""),
    ("<p>one<p>two", "one\n\ntwo"), ("<p class='x>broken quote</p><p>then", "broken quote\n\nthen"), ("<nav>only a menu</nav>", ""), ("&am &amp &quo;", "&am & &quo;"),
    ("<P>UP</P><BR/>per", "UP\n\nper"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<", "<"), ("</p></div>x", "x"),
])
def test_odd_markup(html, text):
    assert h.main_text(html, h.DEFAULT) == text


def test_long_page():
    text = "\n\n".join(f"word {k}" for k in range(20_000))
    body = "".join(f"<p>word {k}" for k in range(20_000))
    assert h.main_text(f"<article>{body}</article>", h.DEFAULT) == text


def test_scan_finds_the_best_run():
    # Blocks of n words, tags between them; compare with all runs.
    weight = h.DEFAULT | {"p": -2.0, "/p": -1.0}
    for sizes in itertools.product((1, 2, 6), repeat=4):
        html = "".join(f"<p>{' '.join(f'w{k}' for _ in range(n))}</p>" for k, n in enumerate(sizes))
        runs = [(sum(sizes[a:b]) - 3 * (b - a - 1), -(b - a), -a, a, b) for a in range(4) for b in range(a + 1, 5)]
        best = max(r[0] for r in runs)
        got = h.main_text(html, weight).split("\n\n")
        first = int(got[0].split()[0][1:])
        assert sum(sizes[first : first + len(got)]) - 3 * (len(got) - 1) == best


def test_weights_come_from_labelled_pages(spark):
    rows = [(k, "u", page(f"<article><h1>x y</h1><p>{' '.join(WORDS)}</p></article>"), "x") for k in range(20)]
    rows += [(None, None, None, "x"), (3, "again", "", None), (99, "u", "<main><p>" + "long " * 100_000 + "</p></main>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    weight = h.learn(df)
    assert weight["li"] < -5 < -0.2 < weight["p"] < 0 < weight["#word"] and weight["#aside"] < 0
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in h.extract(df).collect()}
    assert got[3, "u"] == (f"x y\n\n{' '.join(WORDS)}", len("x y\n\n" + " ".join(WORDS)))
    assert got[None, None] == ("", 0) and got[3, "again"] == ("", 0) and got[99, "u"][1] == 499_999
    assert len(got) == 23 and h.extract(df.limit(0)).count() == 0
    assert h.learn(df.where("page_id = 99")) == h.DEFAULT


@pytest.mark.parametrize("wrap", [
    '<div class="content has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<form method="post" action="./">{}</form>', '<div id="share-widget">{}</div>',
    '<form><div class="search related">{}</div></form>', '<main><div class="widget">{}</div></main>',
])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_wrappers_named_like_what_is_not_the_article(wrap, inner):
    text = [f"{' '.join(WORDS)} {k}" for k in range(4)]
    body = inner.format("".join(f"<p>{t}</p>" for t in text) + '<div class="related"><p>other posts</p></div>')
    got = h.main_text(page(wrap.format(body), '<div id="comments"><article class="comment"><p>I agree</p></article></div>'), h.DEFAULT)
    assert got.split("\n\n") == text


def test_long_comments_beside_a_wrapped_article():
    body = f'<div class="page with-widgets widget-area"><article><p>{" ".join(WORDS)}</p></article></div>'
    extra = '<div id="comments">' + f'<article class="comment"><p>{" ".join(WORDS * 9)}</p></article>' * 3 + "</div>"
    assert h.main_text(page(body, extra), h.DEFAULT) == " ".join(WORDS)


@pytest.mark.parametrize("part", [
    "<a ", '<a x="', "<a<", "</x>", "<!", "<p>", "<div>", "<b><i></u>", "<script>", "<a '\">", '<a "', "</script ", "<li><ul><b>", "<li></li>", "<td '>",
])
def test_long_broken_markup_takes_no_longer_a_byte(part):
    # Time grows with the page: four times as much takes some four times as long, not sixteen times.
    def took(n):
        start = time.process_time()
        h.main_text("<li><ul>" + "<b>" * 1000 + part * n + ">x", h.DEFAULT)
        return time.process_time() - start

    n = 300_000 // len(part)
    assert took(n) < 6 * took(n // 4) + 1.0
