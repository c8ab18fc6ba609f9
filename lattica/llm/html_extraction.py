"""Main text of web pages by two passes of block rules.

First pass, block by block: regions that pages keep for furniture, and link-heavy blocks, are boilerplate; long blocks
with many stop words are content; long blocks with few are left open like short ones. Second pass: an open block takes
the label of the nearest decided block, the article's own blocks first; headings look at what follows them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import batches, narrow

# Element names of HTML, by role.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no markup, or no text of the page; those of TO_THE_END take in the rest of a page if never closed.
RAW_TAGS = frozenset("script style noscript template textarea title svg math iframe object noframes select button canvas audio video".split())
TO_THE_END = frozenset("script style textarea title iframe noframes".split())
#: What the start of an element closes (if nearer than the barriers), and the barriers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Openers beyond which a closing tag does not look, besides these tags' own.
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
IN_TABLE = frozenset("td th tr tbody thead tfoot table".split())
CELLS = ("td", "th", "table")
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar aside rail widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot footnotes-nav colophon copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations more-stories trending comment comments commentlist reply replies respond discussion disqus pagination pager toolbar search searchform tags tagcloud skip-link".split())
#: Frequent words of the four languages that the pages are in.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this from at or an not have but which they he his her we you all been has had were their one will would there can if no when who"
    " der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch des"
    " le la les de des et est en un une du que qui dans pour par sur au avec il ne pas ce se plus sont aux ou mais son sa ses cette comme elle ont été leur nous vous à"
    " el los las del y que se por con para una su al lo como más pero sus este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos no es son".split()
)

# a tag from its name on; possessive, so that a tag without an end is given up after one look
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I) for tag in RAW_TAGS}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    """A run of text between block tags."""

    text: str
    heading: bool
    furniture: bool
    region: int
    linked: int
    keep: bool | None = field(default=None)


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for m in _NAMES.finditer(attrs) if attrs else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            if name in FURNITURE_NAMES or any(p in FURNITURE_NAMES for p in re.split(r"[-_]", name)):
                return tag not in HEADINGS and tag != "p" or name in FURNITURE_NAMES
    return False


def tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag in lower case, whether it closes, attributes) of each tag, then (text, "", False, ""): one way forward.

    Comments, declarations and the content of raw elements are left out. A < that no > follows is text. Once a tag's quotes
    do not close before the page ends, the tags from there on end at their first >. Nothing is looked at again, so the time
    is in proportion to the page whatever it holds.
    """
    tag_at, last_gt, at, done, n = _TAG, html.rfind(">"), 0, 0, len(html)
    gone: set[str] = set()  # raw elements that nothing closes from here on
    held: list[str] = []
    while m := _OPENS.search(html, at):
        start = m.start()
        if start > last_gt and not html.startswith("<!--", start):
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            held.append(html[done:start])
            at = done = n if end < 0 else end + 3
            continue
        t = tag_at.match(html, start + 1)
        if t is None and tag_at is _TAG and (html[start + 1].isalpha() or html[start + 2 : start + 3].isalpha() and html[start + 1] == "/"):
            tag_at = _PLAIN_TAG
            t = tag_at.match(html, start + 1)
        if t is None:  # a declaration or the like
            held.append(html[done:start])
            at = done = html.index(">", start) + 1
            continue
        held.append(html[done:start])
        at = done = t.end()
        tag = t[2].lower()
        if tag in RAW_TAGS:
            if not t[1] and tag not in gone and not (t[3].endswith("/") and tag not in TO_THE_END):
                end = _ENDS[tag].search(html, at)
                if end is not None:
                    at = done = end.end()
                elif tag in TO_THE_END:
                    at = done = n
                else:
                    gone.add(tag)
            continue
        yield "".join(held), tag, bool(t[1]), t[3]
        held.clear()
    held.append(html[done:])
    yield "".join(held), "", False, ""


class _Open:
    """The open block elements, each with what it passes on to its content: furniture, and the article it is in (0: none)."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int]] = []
        self.places: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        """The place of the nearest opener of these tags, -1 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def cut(self, place: int) -> None:
        """Close everything from that place on."""
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def open(self, tag: str, furniture: bool, article: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, furniture, article))

    @property
    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def start(self, tag: str) -> None:
        """Close what the start of tag ends by itself."""
        p = self.last(("p",))
        if p > self.last(CELLS):
            self.cut(p)
        if tag in IMPLIED:
            ends, barriers = IMPLIED[tag]
            place = self.last(ends)
            if place > self.last(barriers):
                self.cut(place)

    def end(self, tag: str) -> None:
        """Close the nearest opener of tag in its scope; a closing tag without one says nothing."""
        place = self.last(HEADINGS if tag in HEADINGS else (tag,))
        barriers = ("table",) if tag in IN_TABLE else (*CELLS, *SCOPES.get(tag, ()))
        if place >= 0 and (tag == "table" or place > self.last(barriers) or tag in barriers):
            self.cut(place)


def blocks(html: str) -> list[Block]:
    """The page's blocks in order. Unclosed and stray tags are tolerated, and ends that HTML implies are made."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = False
    articles = 0

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            bad, region = opened.state
            out.append(Block(text, heading, bad, region, len(" ".join(unescape("".join(linked)).split()))))
        parts.clear()
        linked.clear()

    for text, tag, closes, attrs in tokens(html):
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closes
        elif tag in BLOCK_TAGS:
            flush()
            in_link = False
            if closes:
                opened.end(tag)
            elif tag not in VOID_TAGS:
                opened.start(tag)
                if not attrs.endswith("/"):
                    furniture, article = opened.state
                    furniture |= _is_furniture(tag, attrs, article > 0)
                    if tag in ("article", "main"):
                        articles += 1
                        article = articles
                    opened.open(tag, furniture, article)
            heading = tag in HEADINGS and not closes
        # inline markup neither splits nor spaces text
    flush()
    return out


def _nearest(found: list[Block], order: Iterable[int]) -> dict[int, tuple[int, bool]]:
    """For each open block the decided block met last in order: its place and label.

    Blocks of an article look at its own blocks only, and not at furniture within it.
    """
    last: dict[int, tuple[int, bool]] = {}
    out: dict[int, tuple[int, bool]] = {}
    for i in order:
        b = found[i]
        if b.keep is not None:
            if not (b.region and b.furniture):
                last[b.region] = (i, b.keep)
        elif b.region in last:
            out[i] = last[b.region]
    return out


def classify(found: list[Block], long_chars: int = 70, stop_low: float = 0.15, link_high: float = 0.33) -> list[Block]:
    """Set keep on every block."""
    for b in found:
        if b.furniture or b.linked > link_high * len(b.text):
            b.keep = False
        elif len(b.text) >= long_chars and not b.heading:
            words = _WORD.findall(b.text.lower())
            if words and sum(w in STOP_WORDS for w in words) >= stop_low * len(words):
                b.keep = True
    before, after = _nearest(found, range(len(found))), _nearest(found, reversed(range(len(found))))
    for i, b in enumerate(found):
        if b.keep is None:
            left, right = before.get(i), after.get(i)
            if left is None and right is None:
                b.keep = b.region > 0
            elif b.heading and right is not None:
                b.keep = right[1]
            elif left is None or right is None:
                b.keep = (left or right)[1]
            else:
                near = left if i - left[0] < right[0] - i or (i - left[0] == right[0] - i and left[1]) else right
                b.keep = near[1]
    return found


def main_text(html: str | None) -> str:
    """The page's content blocks, joined by newlines; empty for no html or no content."""
    return "\n".join(b.text for b in classify(blocks(html or "")) if b.keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row: its main text and the count of its code points. No shuffle.

    Null or empty html has an empty text; repeated rows are each extracted; other columns play no part.
    """
    rows = pages.select(key, url, html)
    names = [key, url, "text", "n_chars"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << 22):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return narrow(rows).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long").select(*(F.col(n) for n in names))
