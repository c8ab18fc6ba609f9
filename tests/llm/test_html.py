"""HTML extraction: hostile pages, implied ends, and the test pages against an independent reader."""

import time
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from lattica.llm import html_extraction as H

LONG = "It is the text of the page that has all of the words that we have to have in it, and more of them."


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 300_000,
        '<div class="x" ' * 100_000,
        '<a ">" ' * 100_000 + '"',
        "<div>" * 50_000 + "</p>" * 50_000,
        "<section><table><td>" + "<div>" * 50_000 + "</section>" * 50_000,
        "<svg>" * 100_000,
        "<!--" * 100_000,
        "<!" * 300_000 + ">",
        "<p" * 100_000 + ">",
        "</script" * 100_000,
        "<li>" * 100_000 + LONG,
    ],
)
def test_time_is_linear(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize(
    "page",
    [
        f'<li class="sidebar"><ul><li>one</li><li>two</li></ul><div>{LONG}</div></li>',
        f'<table><tr><td class="sidebar"><table><tr><td>x</td></tr></table><p>{LONG}</p></td></tr></table>',
        f'<div class="sidebar"><p>one</p></p><table><tr><td>x</td></div></td></tr></table><p>{LONG}</p></div>',
        f"<nav><ul><li>one<li>two</ul><p>{LONG}</nav>",
        f"<aside><h3>Side</h2><p>{LONG}</p></aside>",
    ],
)
def test_furniture_does_not_leak(page):
    assert H.main_text(page) == ""
    assert H.main_text(f"{page}<p>{LONG}</p>") == LONG


def test_implied_ends():
    assert H.main_text(f'<ul><li class="ad">{LONG}<li>{LONG}</ul>') == LONG
    assert H.main_text(f'<table><tr><td class="ad">{LONG}<td>{LONG}<tr><td>{LONG}</table>') == f"{LONG}\n{LONG}"
    assert H.main_text(f'<p class="ad">{LONG}<p>{LONG}') == LONG
    assert H.main_text(f'<dl><dt class="ad">{LONG}<dd>{LONG}</dl>') == LONG


def test_broken_markup():
    assert H.main_text(f"<p>1 < 2 and {LONG} <b") == f"1 < 2 and {LONG} <b"
    assert H.main_text(f'<p title="a > b">{LONG}</p>') == LONG
    assert H.main_text(f'<p>{LONG}</p><p title="open>{LONG}</p>') == f"{LONG}\n{LONG}"
    assert H.main_text(f"<p>{LONG}</p><svg><p>{LONG}</p>") == f"{LONG}\n{LONG}"
    assert H.main_text(f"<p>{LONG}</p><SCRIPT>var x = '</p>{LONG}") == LONG
    assert H.main_text(f"<p>{LONG} &amp;lt; &#x41;&eacute;</p><?php {LONG} ?><!doctype {LONG}>") == f"{LONG} &lt; Aé"


class _Reader(HTMLParser):
    """The paragraphs and headings inside article, by the standard library's parser: what the test pages' text is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "a", "em", "span", "strong"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "span", "strong"):
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_every_page_of_the_test_tables(scale):
    path = Path(f"/root/testdata/{scale}/pages.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    for html in pq.read_table(path).column("html").to_pylist():
        reader = _Reader()
        reader.feed(html)
        reader.close()
        assert H.main_text(html) == "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))
