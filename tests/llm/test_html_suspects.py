"""Elements whose names only hint, decided by the host's other pages; odd pages through the query."""

import pytest
from pyspark.sql import functions as F

from tidewater.llm import html_extract

PAGES = "page_id long, url string, html string"
BOXES = {
    "comment-list": "<ol class='comment-list'><li>reader {0}</li></ol>", "comments-area": "<div class='comments-area'>reader said {0}</div>", "cookie-banner": "<div class='cookie-banner'>we bake {0}</div>",
    "ad-slot": "<div class='ad-slot'>buy {0}</div>", "related-posts": "<div class='related-posts'>more {0}</div>", "menu": "<section id='menu'><p>soup {0}</p></section>", "promo": "<div class='promo'><p>offer {0}</p></div>",
}


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.html_extract(spark.createDataFrame(rows, PAGES)).collect()}


def page(i, box=""):
    return f"<body><article><h1>head {i}</h1><p>text {i}</p>{box}<p>end {i}</p></article></body>"


@pytest.mark.parametrize("name", BOXES)
def test_what_recurs_on_a_host_goes(spark, name):
    rows = [(i, f"http://a.com/{i}", page(i, BOXES[name].format(f"words {i}") if i < 3 else "")) for i in range(6)]
    # on a host with several pages, one that only one of them has is content
    rows += [(10 + i, f"http://b.com/{i}", page(i, BOXES[name].format("inside") if i == 2 else "")) for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"head {i}\n\ntext {i}\n\nend {i}" for i in range(6)), got
    assert "inside" in got[12] and all(got[10 + i] == f"head {i}\n\ntext {i}\n\nend {i}" for i in (0, 1, 3, 4))


def test_hosts_that_tell_nothing(spark):
    """A page alone on its host: parts of plain names count, words that articles are about don't."""
    got = texts(spark, [(i, f"http://h{i}.com/x", page(i, BOXES[n].format("inside"))) for i, n in enumerate(BOXES)])
    assert {n: "inside" in got[i] for i, n in enumerate(BOXES)} == {n: n in ("related-posts", "menu", "promo") for n in BOXES}


def test_suspects_never_hold_the_article_or_all_of_a_page(spark):
    rows = [(i, f"http://a.com/{i}", f"<div class='page has-sidebar ad-free'><nav>n</nav><article><p>text {i}</p></article></div>") for i in range(4)]
    rows += [(10 + i, f"http://b.com/{i}", f"<div class='related-wrapper'><p>all {i}</p></div>") for i in range(4)]
    rows += [(20 + i, f"http://c.com/{i}", f"<div class='no-sidebar'>kept {i}</div>") for i in range(4)]
    got = texts(spark, rows)
    assert [got[i] for i in range(4)] == [f"text {i}" for i in range(4)] and [got[10 + i] for i in range(4)] == [f"all {i}" for i in range(4)] and [got[20 + i] for i in range(4)] == [f"kept {i}" for i in range(4)]


def test_template_lines_go_without_names(spark):
    """Deletions by alignment alone, on pages whose markup says nothing."""
    rows = [(i, f"http://a.com/p{i}", f"<div>Home</div><div>Shop</div><div>story {i}</div><div>Imprint</div>") for i in range(8)]
    assert texts(spark, rows) == {i: f"story {i}" for i in range(8)}


def test_odd_pages_through_the_query(spark):
    long = "<p>" + "word " * 60_000 + "</p>"
    rows = [(1, None, None), (2, "http://a.com/1", ""), (3, "http://a.com/2", f"<article>{long}<div class='ad-box'>x</div></article>"), (3, "http://a.com/2", f"<article>{long}<div class='ad-box'>x</div></article>"), (None, "", "<p>alone</p>"), (5, "::", "<div class='related-'>y</div>")]
    frame = spark.createDataFrame(rows, PAGES)
    for c in ("key", "gone", "edges", "suspects", "host", "of", "n"):
        frame = frame.withColumn(c, F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.html_extract(frame).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert sorted(t[:5] for _, t, _ in got) == ["", "", "alone", "word ", "word ", "y"]
    # equal paths on both sides: the earlier page is the partner, in whatever order rows come
    tie = [(i, f"http://t.com/{p}", f"<div>top</div><div>{p}</div>") for i, p in enumerate(["a1", "b1", "c1"])]
    assert texts(spark, tie) == texts(spark, tie[::-1]) == {0: "a1", 1: "b1", 2: "c1"}
