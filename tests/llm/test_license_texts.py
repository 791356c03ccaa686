"""Whole licences and the notices of the GNU family are told apart."""

import time
from pathlib import Path

import pytest

from lociframe.llm import license_scan

TEXTS = Path(license_scan.__file__).parent / "licenses"
GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the\n * Free Software Foundation; either version {2} of the License, or (at your option) any later version."


@pytest.fixture(scope="module")
def scan():
    return license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)


@pytest.mark.parametrize("name", "apache-2.0 bsd-2-clause bsd-3-clause cc0-1.0 gpl-2.0 gpl-3.0 lgpl-2.1 lgpl-3.0 mpl-2.0 unlicense".split())
def test_whole_texts(scan, name):
    begin = time.monotonic()
    got = scan("Some code\n\n" + (TEXTS / f"{name}.txt").read_text() + "\nint main() {}\n")
    assert [x[0] for x in got if x[1] > 0.99] == [f"{name}-text"] and time.monotonic() - begin < 10


@pytest.mark.parametrize("name, words", [("gpl-2.0", ("program", "General Public License", "2")), ("gpl-3.0", ("program", "General Public License", "3")), ("lgpl-2.1", ("library", "Lesser General Public License", "2.1")), ("lgpl-3.0", ("program", "Lesser General Public License", "3")), ("agpl-3.0", ("program", "Affero General Public License", "3"))])
def test_notices(scan, name, words):
    assert [x[:2] for x in scan(GNU.format(*words))] == [(f"{name}-notice", 1.0)]


def test_notice_inside_a_line():
    """A notice of some length is found between other sentences of its line; a short one counts as a line of its own only."""
    scan = license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)
    notice = license_scan.TEMPLATES["apache-2.0-notice"].replace("\n", " ")
    assert [x[0] for x in scan(f"This tool sorts files. {notice} It was written in a week.")] == ["apache-2.0-notice"]
    assert scan("It is ours. All rights reserved. More follows here.") == []


def test_blank_lines_cost_nothing():
    import time

    scan = license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)
    text = ("All rights reserved to\n" * 50) + "\n" * 200_000 + license_scan.TEMPLATES["mit"]
    began = time.time()
    assert [x[0] for x in scan(text)] == ["mit"] and time.time() - began < 5
