"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  Elements that never hold the article (menus, scripts,
and elements that call themselves advert, sidebar, cookie notice and so on) are left out, unless an
``article`` or ``main`` element or most of the page's paragraph text stands inside of them: then they are
wrappers.  A form or a site header is left out unless it wraps the article in this way.
Pass 1 looks at each block alone: link density, length and the density of stop words make it good,
bad, near good or short.  Pass 2 lets near good and short blocks inherit from the nearest decided
blocks before and after.  Inside an ``article`` or ``main`` element the edges count as good and a lack
of stop words does not condemn a block; outside, the edges count as bad.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tillwise.llm.common import ship, small_batches

# Frequent function words of the languages that are told apart from lists of names.
STOP_WORDS = frozenset(
    """
    a about all an and any are as at be been but by can could do for from had has have he her his how
    i if in into is it its more my no not of on one only or other our out she so some than that the
    their them then there these they this to up was we were what when which who will with would you
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer
    er es für hat ich ihr im in ist man mit nach nicht noch nur oder sich sie sind so über um und uns
    von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais me
    ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous
    al como con de del el ella en entre era es esta está este fue ha hay la las le lo los más me mi
    muy no o para pero por que se ser si sin sobre su sus también un una y ya
    che di da e gli i il non per sono del della nel alla anche
    het een van en niet met zijn voor dat op aan te
    os as um uma não mais dos das ao na no em
    """.split()
)

SKIPPED = frozenset(
    "script style noscript template textarea select option button svg canvas iframe object "
    "title head form fieldset nav aside footer menu dialog".split()
)
RAW = frozenset("script style noscript template textarea title svg iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
# Words in class, id or role by which elements say that they are not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion "
    "related replies reply search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget".split()
)
SITE_ONLY = frozenset(["header"])

MAX_LINK_DENSITY, ARTICLE_LINK_DENSITY = 0.2, 0.5
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
HEADING_DISTANCE = 200
UNKNOWN_WORDS = 12

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_LIST_PARTS = frozenset("list box block section area wrapper container inner item items form bar panel".split())
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    zone: int  # 0: outside of any article
    label: str = ""


@dataclass
class _Open:
    tag: str
    skipped: bool
    zone: int


@dataclass
class _Builder:
    pieces: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def add(self, raw: str, in_link: bool) -> None:
        self.pieces.append(raw)
        if in_link:
            self.links.append(raw)

    def close(self, heading: bool, zone: int) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(self.links)).split()))
                self.blocks.append(Block(text, linked, heading, zone))
        self.pieces, self.links = [], []


def attributes_of(text: str) -> dict[str, str]:
    """Attributes of a tag by name in lower case; one without a value is empty."""
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def names_itself(given: dict[str, str]) -> set[str]:
    """The words by which an element says what it is: whole class, id and role names.

    A name of several parts says what its first part does if the others are such words too or name a
    kind of box (cookie-notice, ad_box1); "with-sidebar" or "no-comments" says nothing.
    """
    out = set()
    for attribute in ("class", "id", "role"):
        for name in given.get(attribute, "").lower().split():
            parts = [p.rstrip("0123456789") for p in _PART.findall(name)]
            if parts and all(not p or p in _LIST_PARTS or p in BOILERPLATE for p in parts[1:]):
                out.add(parts[0])
    return out & (BOILERPLATE | SITE_ONLY)


def is_hidden(given: dict[str, str]) -> bool:
    hidden = "hidden" in given and given["hidden"].lower() not in ("false", "until-found")
    return hidden or bool(_NO_DISPLAY.search(given.get("style", "")))


def _is_skipped(tag: str, given: dict[str, str], zone: int) -> bool:
    if tag in SKIPPED or (tag == "header" and not zone):
        return True
    if not given or tag in ("html", "body"):
        return False
    if is_hidden(given):
        return True
    names = names_itself(given)
    if tag in ARTICLE:
        return bool(names & {"comment", "comments", "reply", "replies"})
    return bool(names & BOILERPLATE) or (not zone and bool(names & SITE_ONLY))


NEVER_WRAPS = RAW | frozenset("head select option button canvas object".split())
# Elements with these names may hold what looks like an article, but it is not the page's.
_MUTED = frozenset("nav footer aside menu dialog".split())
_OTHERS = frozenset("comment comments commentlist disqus reply replies related".split())


def _wrappers(page: str) -> set[int]:
    """Where elements begin that would be skipped but hold the article: see the module's text.

    An element wraps an ``article`` or ``main``, or over half of the paragraph text of the page, that of
    menus, asides and footers aside.  Hidden elements, and those that call themselves comments or the
    like, never do.
    """
    open_: list[list] = []  # tag, place, may wrap, holds an article, paragraph text, its text counts
    found: list[tuple[int, bool, int]] = []
    at, total, in_text = 0, 0, False

    def leave(element: list) -> None:
        if element[2]:
            found.append((element[1], element[3], element[4]))
        if open_:
            open_[-1][3] |= element[2] and element[3]
            open_[-1][4] += element[4]

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if in_text and open_ and open_[-1][5]:
            size = len(page[at : m.start()].strip())
            open_[-1][4] += size
            total += size
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        closing = m.group(1) or m.group(4)
        if tag == "p":
            in_text = not closing
        elif tag in BLOCKS:
            in_text = False
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in BLOCKS - {"p"} and tag not in SKIPPED:
            continue
        if closing:
            depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            while depth is not None and len(open_) > depth:
                leave(open_.pop())
        elif tag not in VOID:
            given = attributes_of(m.group(3) or m.group(6) or "")
            could = tag not in NEVER_WRAPS and not is_hidden(given) and not names_itself(given) & _OTHERS
            counts = could and tag not in _MUTED and (not open_ or open_[-1][5])
            open_.append([tag, m.start(), could, could and tag in ARTICLE, 0, counts])
    while open_:
        leave(open_.pop())
    articles = any(own for _, own, _ in found)
    return {place for place, own, size in found if own or (not articles and 2 * size > total > 0)}


def cut_blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of skipped elements."""
    wrappers = _wrappers(page)
    out, stack = _Builder(), [_Open("", False, 0)]
    at, zones, link, heading = 0, 0, False, False
    for m in iter(lambda: _TOKEN.search(page, at), None):
        top = stack[-1]
        if m.start() > at and not top.skipped:
            out.add(page[at : m.start()], link)
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing = m.group(1) or m.group(4)
        if tag in BLOCKS:
            out.close(heading, top.zone)
            link = False
            heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        elif tag == "br" and not top.skipped:
            out.add(" ", False)
        if tag == "a":
            link = not closing
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and (tag in BLOCKS - {"p"} or tag in SKIPPED or m.group(3)):
            given = attributes_of(m.group(3) or m.group(6) or "")
            if tag in ("a", "p") and not (given.keys() & {"class", "id", "role", "hidden", "style"}):
                continue
            if tag in ("p", "li", "td", "tr", "dt", "dd", "option") and top.tag == tag:
                stack.pop()  # these end where the next of their kind begins
                top = stack[-1]
            zone = top.zone
            if tag in ARTICLE and not zone:
                zones += 1
                zone = zones
            skipped = _is_skipped(tag, given, top.zone) and m.start() not in wrappers
            stack.append(_Open(tag, top.skipped or skipped, zone))
    if at < len(page) and not stack[-1].skipped:
        out.add(page[at:], link)
    out.close(heading, stack[-1].zone)
    return out.blocks


def _alone(b: Block, stop_words: frozenset[str]) -> str:
    """Pass 1: the label of a block by itself."""
    n = len(b.text)
    if b.linked > (ARTICLE_LINK_DENSITY if b.zone else MAX_LINK_DENSITY) * n:
        return "bad"
    if not b.zone and ("\N{COPYRIGHT SIGN}" in b.text or "copyright" in b.text.lower()):
        return "bad"
    if n < LENGTH_LOW:
        return "bad" if b.linked and not b.zone else "short"
    words = _WORD.findall(b.text.lower())
    density = sum(w in stop_words for w in words) / max(len(words), 1)
    if density >= STOP_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    # without a single stop word the language is not one of those listed: length has to do
    unknown = len(words) >= UNKNOWN_WORDS and density == 0
    return "near" if density >= STOP_LOW or b.zone or unknown else "bad"


def _inherit(blocks: list[Block], edge: str) -> None:
    """Pass 2 within one zone: undecided blocks take after the nearest decided ones."""
    if not any(b.label == "good" for b in blocks):  # then what is nearly good decides
        for b in blocks:
            b.label = "good" if b.label == "near" else b.label
    decided = [b.label in ("good", "bad") for b in blocks]
    first = [b.label for b in blocks]
    before, last = [], edge
    for b, known in zip(blocks, decided, strict=True):
        before.append(last)
        last = b.label if known else last
    last = edge
    for i in range(len(blocks) - 1, -1, -1):
        if not decided[i]:
            around = {before[i], last}
            if first[i] == "near":
                blocks[i].label = "bad" if around == {"bad"} else "good"
            elif len(around) == 1:
                blocks[i].label = around.pop()
            else:  # between a good and a bad one: good if what touches it on the good side nearly is
                j = i - 1 if before[i] == "good" else i + 1
                touching = first[j] if 0 <= j < len(blocks) else edge
                blocks[i].label = "good" if touching in ("near", "good") else "bad"
        else:
            last = first[i]
    ahead, distance = False, 0
    for b in reversed(blocks):  # a heading goes with the good block that follows it closely
        if b.label == "good":
            ahead, distance = True, 0
            continue
        if b.heading and ahead and distance <= HEADING_DISTANCE and not b.linked:
            b.label = "good"
        distance += len(b.text)


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> tuple[str, int, int]:
    """Text of the good blocks joined by an empty line, number of blocks, number of good ones."""
    blocks = cut_blocks(page or "")
    for b in blocks:
        b.label = _alone(b, stop_words)
    for zone in {b.zone for b in blocks}:
        _inherit([b for b in blocks if b.zone == zone], "good" if zone else "bad")
    kept = [b.text for b in blocks if b.label == "good"]
    return "\n\n".join(kept), len(blocks), len(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, column="html"):
        done = [main_text(page) for page in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("page_id"),
                b.column("url"),
                pa.array([t for t, _, _ in done], pa.string()),
                pa.array([len(t) for t, _, _ in done], pa.int64()),
                pa.array([n for _, n, _ in done], pa.int64()),
                pa.array([k for _, _, k in done], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks, n_kept.

    A page without html, without blocks or without good blocks has an empty text.  The whole page is
    read; a page that breaks off in the middle of a tag or entity is taken as far as it goes, with the
    broken end as text.  Pages are treated one by one where they lie, so repeated pages repeat.
    """
    ship(pages.sparkSession)
    schema = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint"
    slim = pages.selectExpr("cast(page_id as bigint) page_id", "url", "html")
    return slim.mapInArrow(_extract, schema)
