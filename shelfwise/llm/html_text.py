"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each paragraph has points for being one, for its
length and for its commas, and passes them to its ancestors, less with each level; elements that
hold nothing but one other don't count as levels, and an article or main element's points count
twice. A container's score is its points times the share of its text that is not in links. The
best container and those of its siblings that score like it, or read like text, are kept.

Menus, headers, footers, sidebars, forms and the like are known by their elements, roles and
classes. A class tells so only if all its words are such words or say nothing, like "cookie-box"
but unlike "cookie-history"; if that leaves a page no text, classes aren't looked at. Forms, and parts with
a name that articles' parts have too, as "legal" or "toc", are dropped only if their points are few. In the kept
containers nothing else is dropped. All steps are linear in the page's length, however deep its tree, and however its tags end.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPENING = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_TAG_PART = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Elements that hold no text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg select option datalist audio video canvas map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that are never part of the main text.
NOISE = frozenset("nav aside footer menu dialog search head button".split())
#: Elements and words that mark such a part only if little text is in it.
WEAK = frozenset("form fieldset".split())
WEAK_WORDS = frozenset("form skip legal disclaimer toc promotion widget".split())
#: The points with which a part that is marked so counts as text after all; a form must have that share of the page's points, too.
WEAK_POINTS, FORM_SHARE = 2.0, 0.5
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark a part of a page as something else than its text, and words that say nothing beside them.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus submenu header masthead topbar footer foot sidebar aside ad ads adv advert adverts advertisement banner sponsor sponsored promo promoted"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond"
    " discussion disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar search".split()
)
PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons card container content col column div global group home html id in inline inner item items js left link links list main main mobile module more"
    " note outer page panel post posts primary right row secondary section site slot small sticky text thread title top unit user view wrap wrapper x".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPES = frozenset("table ul ol dl div section article main body".split())
_HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_PARAGRAPHS = frozenset(["p", "pre", "blockquote", *_HEADINGS])
#: Of a page's tags, how many may be read to the page's end in vain, looking for an end outside of quotes.
VAIN = 8
#: Levels that points are passed up, at most, and what a level's ancestors get of them.
_SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15, 1 / 18, 1 / 21)


class _Node:
    __slots__ = ("tag", "parent", "noise", "weak", "points", "chars", "linked", "top")

    def __init__(self, tag: str, parent: _Node | None, noise: bool, weak: bool = False) -> None:
        self.tag, self.parent, self.noise, self.weak = tag, parent, noise, weak
        self.points, self.chars, self.linked = [0.0] * len(_SHARES), 0, 0
        self.top: _Node | None = None


def _names_noise(value: str) -> str:
    """What a class or id tells of its part: "noise" if it is named as something else than text of the page, "weak" if only weakly so."""
    told = ""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if all(w in NOISE_WORDS or w in WEAK_WORDS or w in PLAIN_WORDS or w.isdigit() for w in words):
            if not NOISE_WORDS.isdisjoint(words):
                return "noise"
            if not WEAK_WORDS.isdisjoint(words):
                told = "weak"
    return told


def _is_noise(tag: str, attributes: str, inside: bool, by_class: bool) -> tuple[bool, bool]:
    """Whether an element is no text of the page, and whether it is weakly marked so. inside: within an article or main element, where a header holds the headline."""
    weak = tag in WEAK
    if tag in NOISE or tag == "header" and not inside:
        return True, weak
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, weak
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if by_class and name in ("class", "id") and not (inside and tag == "header"):
            told = _names_noise(value)
            if told == "noise":
                return True, weak
            weak = weak or told == "weak"
        if name == "role" and value.lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, weak
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True, weak
    return False, weak


class _Markup:
    """The tags, comments and declarations of a page, one after another, in time linear in its length.

    A tag ends at the first > outside of quotes or, if there is none, at the first > of all; a < that no > follows is text.
    Looking for one outside of quotes in vain reads the page to its end, so that is done VAIN times at most.
    """

    def __init__(self, page: str) -> None:
        self.page, self.vain, self.last = page, 0, page.rfind(">")

    def _end(self, at: int) -> int:
        """Where the tag that has its attributes from at ends: after its >."""
        place = at
        while self.vain < VAIN:
            m = _TAG_PART.search(self.page, place)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            place = self.page.find(m[0], m.end()) + 1
            if not place:
                break
        self.vain += 1
        return self.page.index(">", at) + 1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, tag (empty for comments and declarations), whether it closes, and attributes of what comes first from at on."""
        for m in iter(lambda: _OPENING.search(self.page, at), None):
            start = m.start()
            if self.page.startswith("<!--", start):
                end = self.page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(self.page), "", False, ""
            if self.page[start + 1] in "!?":
                end = self.page.find(">", start)
                return start, end + 1 if end >= 0 else len(self.page), "", False, ""
            if start > self.last:
                return None
            name = _NAME.match(self.page, start)
            if name is not None:
                end = self._end(name.end())
                return start, end, name[2].lower(), bool(name[1]), self.page[name.end() : end - 1]
            at = start + 1
        return None


class _Open:
    """The elements that are open, each tag's places among them at hand."""

    def __init__(self) -> None:
        self.nodes, self.places = [_Node("html", None, False)], {"html": [0]}

    def last(self, tags) -> int:
        """The place of the innermost open element that has one of the tags; -1 if none has."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        """Closes the element at a place and all within; the outermost one stays open."""
        while len(self.nodes) > max(place, 1):
            self.places[self.nodes.pop().tag].pop()


def _blocks(page: str, by_class: bool) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The elements of a page, parents first, and its blocks of text in page order: the element each stands in, its text, its characters in links."""
    open_ = _Open()
    every = list(open_.nodes)
    found: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text and not open_.nodes[-1].noise:
            found.append((open_.nodes[-1], text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    markup = _Markup(page)
    while True:
        found_tag = markup.next(at)
        if found_tag is None:
            say(page[at:])
            break
        start, end_of_tag, tag, closing, attributes = found_tag
        if start > at:
            say(page[at:start])
        at = end_of_tag
        if not tag:
            continue
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCKS or tag == "button":
            flush()
            links = 0 if closing else links
            if closing:
                place = open_.last([tag])
                bounded = tag not in _SCOPES and tag not in ("tr", "tbody", "thead", "tfoot")
                if place > 0 and not (bounded and place < open_.last(("td", "th", "table"))):
                    open_.close(place)
            elif tag not in VOID:
                if open_.nodes[-1].tag == "p" or open_.nodes[-1].tag in _HEADINGS and tag in _HEADINGS:
                    open_.close(len(open_.nodes) - 1)
                elif tag in _CLOSES:
                    place = open_.last(_CLOSES[tag])
                    if place > open_.last(_SCOPES - set(_CLOSES[tag])):
                        open_.close(place)
                        while tag in ("tr", "tbody", "tfoot") and open_.nodes[-1].tag in _CLOSES[tag] and len(open_.nodes) > 1:
                            open_.close(len(open_.nodes) - 1)
                parent = open_.nodes[-1]
                inside = open_.last(("article", "main")) >= 0
                noise, weak = _is_noise(tag, attributes, inside, by_class)
                node = _Node(tag, parent, parent.noise or noise, weak)
                every.append(node)
                open_.push(node)
    flush()
    return every, _without_weak(every, found)


def _points(text: str) -> float:
    """A paragraph's points: for being one, for commas and for length."""
    return 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= 25 else 0.0


def _without_weak(every: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """The blocks that aren't in a weakly marked part with little text: one whose points, less the share in links, are few; forms must hold much of the page."""
    if not any(n.weak for n in every):
        return blocks
    sums = {id(n): [0.0, 0, 0] for n in every}
    for node, text, linked in blocks:
        own = sums[id(node)]
        own[0], own[1], own[2] = own[0] + _points(text), own[1] + len(text), own[2] + linked
    for node in reversed(every):
        if node.parent is not None:
            own, above = sums[id(node)], sums[id(node.parent)]
            above[0], above[1], above[2] = above[0] + own[0], above[1] + own[1], above[2] + own[2]
    whole = sums[id(every[0])][0]
    for node in every:  # parents first
        points, chars, linked = sums[id(node)]
        if node.weak and not node.noise:
            score = points * (1 - linked / chars) if chars else 0.0
            node.noise = score < max(WEAK_POINTS, FORM_SHARE * whole if node.tag in WEAK else 0.0)
        node.noise = node.noise or node.parent is not None and node.parent.noise
    return [b for b in blocks if not b[0].noise]


def _score(node: _Node) -> float:
    points = sum(p * s for p, s in zip(node.points, _SHARES)) * (2 if node.tag in ("article", "main") else 1)
    return points * (1 - node.linked / node.chars) if node.chars else 0.0


def _best(every: list[_Node], blocks: list[tuple[_Node, str, int]]) -> _Node | None:
    """The container with the best score; of equal ones an article, then the outermost."""
    for node, text, linked in blocks:
        node.chars, node.linked = node.chars + len(text), node.linked + linked
        node.points[0] += _points(text)
    for node in reversed(every):  # children before their parents
        above = node.parent
        if above is not None and node.chars:
            above.chars, above.linked = above.chars + node.chars, above.linked + node.linked
    for node in reversed(every):
        above = node.parent
        if above is not None and node.chars:
            down = 0 if node.tag in _PARAGRAPHS or above.chars == node.chars else 1
            for level in range(len(_SHARES) - down):
                above.points[level + down] += node.points[level]
    best = None
    for node in every:
        if node.chars and node.tag not in _PARAGRAPHS and not node.noise:
            rank = (round(_score(node), 6), node.tag in ("article", "main"))
            if best is None or rank > best[0]:
                best = (rank, node)
    return best and best[1]


def _reads_like_text(text: str, linked: int) -> bool:
    return len(text) >= 80 and linked * 4 < len(text) or not linked and text[-1] in ".!?…"


def _kept(every: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[str]:
    best = _best(every, blocks)
    if best is None:
        return []
    for node in every:  # the best container, or the sibling of it, that a node is in
        above = node.parent
        node.top = node if node is best or above is not None and above is best.parent else above.top if above is not None else None
    least = max(10.0, 0.2 * _score(best))
    kept = []
    for node, text, linked in blocks:
        side = node.top
        if side is best:
            kept.append(text)
        elif linked * 2 > len(text):
            continue
        elif side is None:
            if node is best.parent and len(text) >= 80:
                kept.append(text)
        elif _score(side) >= least or side.tag == best.tag == "article" or side.tag in _HEADINGS or side.tag in _PARAGRAPHS and _reads_like_text(text, linked):
            kept.append(text)
    return kept


def main_text(page: str) -> str:
    """The blocks of the main text, white space in each made single spaces, joined by newlines; empty if none."""
    kept = _kept(*_blocks(page, True)) or _kept(*_blocks(page, False))
    return "\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id, url if there is one, and text of each row of pages.

    A null page counts as empty and has an empty text, as has one without any main text.
    Character references are decoded; malformed markup is read as browsers would, roughly.
    Repeated rows give repeated results; other columns aren't read.
    """

    def of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x) if x else "" for x in part.column("html").to_pylist()]
                names = [n for n in part.schema.names if n != "html"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    own = [F.col(id_col).alias("page_id"), *([F.col("url")] if "url" in pages.columns else [])]
    rows = pages.select(*own, F.col(html_col).alias("html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(of, f"{schema}, text string")
