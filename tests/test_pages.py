"""Main text and dates of hand-marked pages."""

import pytest
from pyspark.sql import functions as F

from glossmill.sources import web
from glossmill.sources.blocks import page_text

LINE = "This is a paragraph of the article that goes on for long enough to be told from a menu entry."
LINKS = "".join(f"<li><a href='/{i}'>Section number {i} of this site</a></li>" for i in range(9))

#: Page, main text.
PAGES = [
    (f"<article><h1>Head</h1><p>One &amp; two</p><p>{LINE}</p><!-- c --><table><tr><td>cell</td></tr></table></article><p>{LINE}</p>", ["Head", "One & two", LINE]),
    (f"<body><ul>{LINKS}</ul><h2>Head</h2><p>{LINE}</p><p>Short.</p><p>{LINE}</p><div class='related-links'><p>{LINE}</p></div><p>© us</p></body>", ["Head", LINE, "Short.", LINE]),
    (f"<div id='cookie-banner'>{LINE}</div><div><p>{LINE}</p><p><a href='/x'>{LINE}</a></p><p>After the links</p></div>", [LINE]),
    ("<p>bare</p>", ["bare"]),
    (f"<article><p>Teaser</p></article><div><p>{LINE}</p></div>", ["Teaser", LINE]),
    (f"<main><p>{LINE} <a href='/'>A link</a> inside.<p>Not <b>ended</b><p>{LINE}</main>", [f"{LINE} A link inside.", "Not ended", LINE]),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><nav><p>no</p></nav>", []),
    (None, []), ("", []), ("no tags at all", ["no tags at all"]), ("<p>broken <b", ["broken <b"]),
]


@pytest.mark.parametrize("html, lines", PAGES)
def test_main_text(html, lines):
    assert page_text(html)[0] == ("\n".join(lines) or None)


#: Text of a page, what is read of it: references without a semicolon stay as they are.
REFERENCES = [
    ("cut &amp", "cut &amp"), ("cut &am", "cut &am"), ("a &amp;&amp;&amp", "a &&&amp"), ("&lt;p&gt; &#39;&quot;&#x41;", "<p> '\"A"), ("&ltb &copy2 &#39 x", "&ltb &copy2 &#39 x"), ("&amp;lt; &nosuch; & &", "&lt; &nosuch; & &"),
]


@pytest.mark.parametrize("said, read", REFERENCES)
def test_references_need_their_semicolon(said, read):
    assert page_text(f"<article><h1>{said}</h1><p>{LINE}</p></article>")[0] == f"{read}\n{LINE}"


META = '<meta property="article:published_time" content="2016-03-04T01:02:03Z">'
DATES = [
    (META + '<time datetime="2015-01-01">', None, "2016-03-04"), ('<time datetime="2014-01-01"></time><article><time datetime="2015-01-01"></time></article>', None, "2015-01-01"),
    ('<script type="application/ld+json">{"@graph": [{"x": 1}, {"datePublished": "2013-05-06T00:00"}]}</script><article><time datetime="2015-01-01"></article>', None, "2013-05-06"),
    ('<script type="application/ld+json">{broken</script><time datetime="2012-12-31">', "https://x/2011/10/09/story", "2011-10-09"), ('<meta name="date" content="2010-01-02">', "https://x/2011/10/09/s", "2010-01-02"),
    ('<meta name="date" content="yesterday">', None, None), ("", "https://x/2011/13/09/", None), (META.replace("03-04", "13-40"), None, None), (META + META.replace("2016", "2017"), None, "2016-03-04"),
]


@pytest.mark.parametrize("html, url, day", DATES)
def test_dates_by_rank(html, url, day):
    assert page_text(html, url)[1] == day


def test_pages_as_a_table(spark):
    rows = web.extract_pages(spark.createDataFrame([(1, PAGES[0][0], "https://x/2011/10/09/s"), (2, None, None)], "page_id int, html string, url string"), url="url")
    assert [(r.body, r.date) for r in rows.orderBy("page_id").collect()] == [("\n".join(PAGES[0][1]), "2011-10-09"), (None, None)]
    assert web.extract_pages(rows.select("page_id", "html")).where(F.col("date").isNotNull()).count() == 0
