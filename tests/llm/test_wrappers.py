"""Wrappers decide where labels don't: pages without article or main element, with boilerplate of the site's own."""

import random

from lociframe.llm import html_extraction as H


def texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())]


def site(n):
    """Pages of one site: a constant line, a rotating offer and a block of links without telling names around the story."""
    rng = random.Random(4)
    story = lambda: " ".join(rng.choice(["river", "stone", "cloud", "night", "green", "walks", "quiet"]) + str(rng.randint(0, 999)) for _ in range(20))
    offers = ["Buy one get one", "Half price today", "Last seats left", "Win a trip"]
    bodies = [[story() for _ in range(rng.randint(1, 4))] for _ in range(n)]
    pages = []
    for i, b in enumerate(bodies):
        pages.append(f"<html><body><table><tr><td>The Daily Example, since 1901</td></tr></table><div class=q7><i>{offers[i % 4]}</i></div><div class=x1>{''.join(f'<p>{p}</p>' for p in b)}</div><div class=z9><a href=/a>Home</a> <a href=/b>World</a></div></body></html>")
    return pages, [" ".join(b) for b in bodies]


def test_boilerplate_without_labels(spark):
    pages, want = site(40)
    assert texts(spark, pages) == want
    alone = H.main_text(H.parse(pages[1]), set())  # without the alignment nothing tells it apart
    assert "since 1901" in alone and "Half price today" in alone and "World" in alone


def test_few_pages_keep_everything_unlabelled(spark):
    pages, want = site(3)
    got = texts(spark, pages)
    assert all(w in g for w, g in zip(want, got, strict=True)) and all("since 1901" in g for g in got)


def test_empty_table_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, host string, template string, node int, wrapper string, text string, n_chars int"
    assert H.extract(spark.createDataFrame([], schema)).count() == 0
    row = H.extract(spark.createDataFrame([(None, None, "<p>a b</p>", "x", "y", 1, "z", "t", 9), (2, "no host", None, None, None, None, None, None, None)], schema)).orderBy("page_id").collect()
    assert [tuple(r) for r in row] == [(None, None, "a b", 3), (2, "no host", "", 0)]


def test_long_lists_align_exactly():
    rng = random.Random(1)
    page = lambda keys: H.parse("<body><div>" + "".join(f"<{k}>x</{k}>" for k in keys) + "</div></body>")
    kinds = ["p", "ul", "h2", "div"]
    for n in (1, 7, 60):
        a, b = ([rng.choice(kinds) for _ in range(n)] for _ in "ab")
        got = []
        for small, cells in ((10**9, 10**9), (0, 10**9), (0, 50)):
            old = H.SMALL, H.CELLS
            H.SMALL, H.CELLS = small, cells
            got += [H.tree_match(page(a), page(b)), sum(1 for _ in H.aligned(page(a), page(b)))]
            H.SMALL, H.CELLS = old
        assert len(set(got)) == 1
    assert H.tree_match(page(["p", "ul"] * 4000), page(["ul", "p", "h2"] * 2000)) == 3 + 2 * 2000


def test_very_long_page(spark):
    pages, want = site(12)
    long = "<p>" + "word " * 20_000 + "</p>" + "<p>a</p><ul><li>b</ul>" * 2000
    pages.append(pages[0].replace("<div class=x1>", "<div class=x1>" + long))
    assert texts(spark, pages)[-1] == " ".join(["word"] * 20_000 + ["a", "b"] * 2000) + " " + want[0]
