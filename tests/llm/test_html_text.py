"""Main text of pages of many layouts."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracewell.llm import html_text
from tracewell.llm.html_text import extract

A = "A first paragraph that is long enough to tell it from menus and notices around it."
B = "A second one, with &amp; and &#233; and a <a href='/x'>link</a> in its midst, is as long as that."
B_TEXT = "A second one, with & and é and a link in its midst, is as long as that."

PAGES = {
    "plain": (f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>{A}</p><p>Short.</p><p>{B}</p></article><footer>&copy; x</footer>", f"Head\n{A}\nShort.\n{B_TEXT}"),
    "unclosed": (f"<body><div class=ad>Buy now.</div><article><h1>Head</h1><p><b>{A}<br><p>{B}<p>End</article><footer>f</footer>", f"Head\n{A}\n{B_TEXT}\nEnd"),
    "all around": (
        f"<body><header><h2>Site</h2></header><aside>Side story of some length, with words and words.</aside><main><div class='cookie-notice'>We use cookies on this site, all of them.</div><article>"
        f"<header><h1>Head</h1></header><p>{A}</p><div class='ad slot'>Advert text</div><script>var x = '<p>no</p>';</script><style>p {{}}</style><form><p>Mail</p><input></form><p>{B}</p>"
        f"</article><section id=comments><p>{A} says a reader at some length.</p></section></main><footer><p>{A}</p></footer></body>",
        f"Head\n{A}\n{B_TEXT}",
    ),
    "comments as articles": (f"<body><article><p>{A}</p></article><div class='commentList'><article class='comment'><p>{A} {A} {A}</p></article></div>", A),
    "no article": (f"<body><div id=menu><a href=/>Home</a></div><div class='has-sidebar content'><h1>Head</h1><p>{A}</p><p>{B}</p><p>End.</p></div><div><a href=/1>More</a> <a href=/2>Even more</a></div>", f"Head\n{A}\n{B_TEXT}\nEnd."),
    "boxes named by class": (
        f"<body><div class='site-header'>Site name and motto</div><div id='topBanner'>Sale today</div><div class='content-with-sidebar'><div class='entry-header'><h1>Head</h1></div><p>{A}</p><p>{B}</p>"
        f"<div class='alert'>Read our new terms.</div><div class='comment-list'><p>{A} {A}</p></div></div><div class='search'>Find</div></body>",
        f"Head\n{A}\n{B_TEXT}",
    ),
    "form around": (f"<body><form id=aspnet><nav>Home</nav><article><p>{A}</p></article></form>", A),
    "menu never closed": (f"<body><nav><a href=/>Home</a><article><p>{A}</p></article>", A),
    "two teasers": (f"<body><main><article><h1>Head</h1><p>{A}</p></article><article><a href=/1>Next one</a></article></main>", f"Head\n{A}\nNext one"),
    "inline marks": ("<article><p>un<b>break</b>able &nbsp; <i>\n\t x</i></p><pre>a\n  b</pre><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "unbreakable x\na b\none\ntwo\nc1\nc2"),
    "odd marks": (f"<!DOCTYPE html><![foo]><![if x]><article><!-- no --><p>{A}&am &amp</p></p></div><p>a < b</article", f"{A}&am &\na < b"),
    "nothing": ("<html><body><nav>Home</nav></body></html>", ""),
    "text alone": ("just text", "just text"),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, want = PAGES[name]
    assert extract(html) == want


def test_long_and_deep_pages():
    body = " ".join(f"w{i}" for i in range(400_000))
    assert extract(f"<article><p>{body}</p></article>") == body
    many = "".join(f"<p>line {i}" for i in range(50_000))
    assert extract(f"<article>{many}</article>").count("\n") == 49_999
    deep = "<div>" * 5000 + A + "</div>" * 5000
    assert extract(deep) == A
    assert extract("<article><p>" + "<!--" * 50_000) == ""


def test_ratios_and_threshold():
    lines = [(0, "x" * n, tags, 0) for n, tags in ((5, 3), (200, 2), (180, 2), (10, 1), (220, 2), (6, 4), (4, 3), (4, 3))]
    smooth = html_text.ratios(lines)
    assert len(smooth) == 8 and smooth[3] > smooth[6]
    border = html_text.threshold(smooth)
    assert (smooth[1:5] >= border).all() and (smooth[6:] < border).all()
    assert html_text.threshold(np.array([3.0, 3.0])) == 3.0


def test_pages_table(spark):
    rows = [(1, "u", PAGES["plain"][0]), (1, "u", PAGES["plain"][0]), (2, None, None), (None, "u", ""), (3, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "line")})
    out = html_text.main_text(df)
    assert out.columns == ["page_id", "url", "html", "line", "text", "n_chars"]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=str)
    plain = PAGES["plain"][1]
    assert got == sorted([(1, plain, len(plain)), (1, plain, len(plain)), (2, "", 0), (None, "", 0), (3, "x", 1)], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0
