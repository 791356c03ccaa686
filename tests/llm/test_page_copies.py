"""Copies of a page don't make its article template."""

from lociframe.llm import html_extraction


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_extraction.extract(df).collect()}


def page(paragraphs, nav=""):
    return f"<body><nav>{nav}</nav><div>{''.join(f'<p>{x}</p>' for x in paragraphs)}<h6>Print this page</h6></div></body>"


def test_equal_pages_keep_their_article(spark):
    got = texts(spark, [page(["One story", "and its end"])] * 10)
    assert set(got.values()) == {"One story and its end Print this page"}


def test_copies_with_other_menus_keep_their_article(spark):
    got = texts(spark, [page(["One story", "and its end"], nav=f"menu {i}") for i in range(20)] + [page(["Other story"])])
    assert got[0] == got[19] == "One story and its end Print this page"


def test_long_copies_among_short_pages(spark):
    got = texts(spark, [page(["Long", "story", "told", "at length"])] * 6 + [page([f"Story {i}"]) for i in range(12)])
    assert got[0] == got[5] == "Long story told at length" and got[6] == "Story 0"
