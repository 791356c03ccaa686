"""Elements are closed, dropped and found at any depth."""

import pytest

from lociframe.llm import html_extraction as H


@pytest.mark.parametrize("depth", [10, 200, 3000])
def test_deep_elements(depth):
    page = f"<div><article><p>first</p>{'<div>' * depth}<p>inner</p><nav>menu <a>x</a></nav>{'</div>' * depth}<p>rest</p></article></div><p>outside</p>"
    tree = H.parse(page)
    assert H.main_text(tree, set()) == "first inner rest"
    below = H.parse("<div>" * depth + "<article><p>one</p><p>two</p></article>" + "</div>" * depth + "<p>outside</p>")
    assert H.main_text(below, set()) == "one two"
    assert sum(1 for _ in H.aligned(tree, H.parse(page))) == depth + 9
