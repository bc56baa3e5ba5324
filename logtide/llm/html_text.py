"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags.  First, each block is judged alone: by link
density, length and density of stop words, and by the containers it stands in.  Then blocks
that are too short to judge take the label of the nearest decided block; headings look
ahead.  The text is the good blocks in page order.

Null and empty pages give an empty text.  Unclosed comments end with the page, and so do
unclosed scripts, styles, titles and text areas, unless the head ends or the body begins
first; other elements whose content is no text are empty if they aren't closed.

Class names and ids are hints of what a container holds.  A name counts as a whole, if all its
words are hints or say only where a box is; words for adverts and for what readers write count
at either end of a name, unless it speaks of a state (``ad-free``, ``comments-open``).  Hints
never judge the page or its article, and neither they nor forms judge what stands around the
first article, or holds most of the prose of a page without one.  If a page would have no text,
its hints are left out, then those of adverts and readers, then its elements: a page with
prose has a text, unless all of it is hidden.

Inside an article, a linked heading or a paragraph that is a link is judged by its neighbours,
unless links stand beside it.  Rows of equal key are pages of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import map_rows

#: Blocks with more of their characters in links are bad.
LINK_DENSITY = 0.33
#: Blocks of fewer characters are too short to be judged by their words.
SHORT = 140
#: A container with this share of the prose of a page without an article is no furniture, whatever its name.
MOST = 0.75
#: Shares of stop words: running text has the first at least; what has less than the second isn't prose.
STOP_HIGH, STOP_LOW = 0.12, 0.02

# Frequent words of running text in English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """
    the of and a to in is that it for on was with as be by at this from are or an not
    der die das und in den von zu mit ist im nicht ein eine auf für des dem auch sich es
    le la les de des et en un une du que qui pour dans est par sur au pas ce il avec
    el los las del y que un una por con para no se su al lo como más
    il di che e non per sono della
    o os do da em um uma não com
    het een van en te dat op voor
    """.split()
)

# Elements by their part in a page.
RAW = frozenset("script style noscript template textarea title svg iframe select button object canvas math audio video".split())
#: Of these, those that are empty where their tag ends in a slash, and those that go on to the page's end if they aren't closed.
FOREIGN = frozenset(["svg", "math"])
ENDLESS = frozenset("script style textarea title".split())
#: A new one of these ends the last.
EXCLUSIVE = frozenset(["button", "select"])
#: The page and its text: what their classes say is about the whole page.
WHOLE = frozenset("html body main article".split())
CONTAINERS = frozenset("div section article main nav footer aside header form ul ol dl table td th tr li figure blockquote body html details dialog menu fieldset center".split())
BAD_CONTAINERS = frozenset("nav footer aside form menu dialog".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr dt dd caption tbody thead tfoot figcaption address legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HINTS = frozenset(
    """
    ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice
    notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus
    share sharing social related recommended newsletter subscribe subscription popup modal login signin signup widget pagination
    pager search complementary contentinfo toolbar copyright responses respond
    """.split()
)
HEADER_HINTS = frozenset(["header", "masthead", "meta", "byline"])
#: Words of a name that only say where or what kind of a box it is.
PLACES = frozenset(
    """
    site page main top bottom left right upper lower inner outer box bar block area wrap wrapper container content section list item items
    link links post posts article articles story stories primary secondary global sticky fixed overlay form message policy icons buttons
    group row col column panel mobile desktop js the and of
    """.split()
)
#: Hints of what readers write, which no article's place overrules, and of adverts and consent: they settle a name at either end.
READERS = frozenset("comment comments commenter commenters reply replies disqus responses respond".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split())
#: What such a word may be written together with.
JOINED = re.compile(r"(?P<reader>comments?|disqus)(?:list|form|box|area|section|wrap|wrapper|thread|block|container|threads|feed)|ads?(?:bygoogle|sense|slot|box|unit|container|wrapper|wrap|banner|block|space|zone|label|holder|frame)")
#: Words of a name that say what state something is in, not what it holds.
STATES = frozenset("free no non not has have with without open opened closed enabled disabled on off is hide show allow".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>?"
    r"|<[!?][^>]*+>?",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'/=>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*+:\s*+none\b", re.I)
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*+>" + rf"|(?=<{tag}[\s>])" * (tag in EXCLUSIVE), re.I) for tag in RAW}
_BODY_BEGINS = re.compile(r"(?=</head\b|<body\b)", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")

GOOD, BAD, SHORT_BLOCK = 1, -1, 0
#: Why a container may be furniture: it isn't shown, by its element, by being a form, and by its name.
HIDDEN, ELEMENT, FORM, HINT, ADVERT, READER = range(6)


class Mark:
    """A container that may be furniture, and the one around it."""

    __slots__ = ("around", "kind", "prose", "spared")

    def __init__(self, kind: int, around: Mark | None):
        self.kind, self.around, self.prose, self.spared = kind, around, 0, False


class Block:
    __slots__ = ("heading", "inside", "linked", "mark", "parent", "text")

    def __init__(self, text: str, linked: int, mark: Mark | None, heading: bool, inside: bool, parent: int):
        self.text, self.linked, self.mark, self.heading, self.inside, self.parent = text, linked, mark, heading, inside, parent


def _is_hidden(attrs: str) -> bool:
    """By an attribute ``hidden`` (not by the word in others), or by a style without display."""
    if not _MAY_HIDE.search(attrs):
        return False
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.strip().lower() != "false" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _kinds(tag: str, attrs: str, inside: bool) -> list[int]:
    """What speaks for a container's being furniture."""
    found = []
    if attrs and tag not in ("html", "body") and _is_hidden(attrs):
        found.append(HIDDEN)
    if tag in BAD_CONTAINERS or tag == "header" and not inside:
        found.append(FORM if tag == "form" else ELEMENT)
    if attrs and tag not in WHOLE and (hint := _hint(attrs, inside)):
        found.append(hint)
    return found


def _hint(attrs: str, inside: bool) -> int:
    """The highest of HINT, ADVERT and READER that one of the container's names speaks for, or 0."""
    found = 0
    for m in _NAMED.finditer(attrs):
        for name in m[1].strip("\"'").split():
            words = _LETTERS.findall(_HUMPS.sub(" ", name).lower())
            if not words:
                continue
            if STATES.isdisjoint(words):
                for word in (words[0], words[-1]):
                    joined = JOINED.fullmatch(word)
                    if word in READERS or joined and joined["reader"]:
                        found = READER
                    elif word in ADVERTS or joined:
                        found = max(found, ADVERT)
            hints = [w for w in words if w in HINTS or not inside and w in HEADER_HINTS]
            if hints and all(w in HINTS or w in HEADER_HINTS or w in PLACES for w in words):
                found = max(found, READER if not READERS.isdisjoint(hints) else HINT)
    return found


def blocks(page: str) -> tuple[list[Block], list[Mark]]:
    """The page's blocks in order, and the marks of its containers, each behind the one around it."""
    out: list[Block] = []
    marks: list[Mark] = []
    #: Tag, number, and the innermost mark around the container.
    stack: list[tuple] = []
    parts: list[str] = []
    linked = links = articles = breaks = opened = 0
    heading = any_article = False
    mark: Mark | None = None

    def close() -> None:
        nonlocal linked, heading
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, mark, heading, articles > 0, stack[-1][1] if stack else 0))
            parts.clear()
        linked, heading = 0, False

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            parts.append(text)
            if links:
                linked += len(html.unescape(text).strip())
            if not text.isspace():
                breaks = 0

    unclosed: set[str] = set()
    #: How many elements of each tag are open.
    tags: dict[str, int] = {}

    def after(tag: str, at: int) -> int:
        """Where what follows the element begins, whose tag ends ``at``."""
        for name, end in ((tag, _RAW_ENDS[tag]), ("head", _BODY_BEGINS)):
            if name not in unclosed:
                if found := end.search(page, at):
                    return found.end()
                unclosed.add(name)
            if tag not in ENDLESS:
                return at
        return len(page)

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag, ends = tag.lower(), bool(m["end"])
        if tag in RAW:
            if not ends:
                parts.append(" ")
                if tag not in FOREIGN or not m["attrs"].endswith("/"):
                    at = after(tag, at)
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif tag == "a":
            links = 0 if ends else 1
        elif tag in BREAKS:
            close()
            links = 0
            heading = tag in HEADINGS and not ends
            if tag in CONTAINERS:
                article = tag in ("article", "main")
                if not ends:
                    if article and not any_article and mark:
                        # What holds the first article is no furniture, whatever it is called, unless readers write there.
                        around, held = mark, []
                        while around:
                            held.append(around)
                            around = around.around
                        if all(x.kind in (FORM, HINT) for x in held):
                            for x in held:
                                x.spared = True
                    any_article = any_article or article
                    outer = mark
                    for kind in _kinds(tag, m["attrs"], articles > 0):
                        mark = Mark(kind, mark)
                        marks.append(mark)
                    opened += 1
                    stack.append((tag, opened, outer))
                    articles += article
                    tags[tag] = tags.get(tag, 0) + 1
                elif tags.get(tag):
                    while True:
                        name, _, mark = stack.pop()
                        tags[name] -= 1
                        articles -= name in ("article", "main")
                        if name == tag:
                            break
    add(page[at:])
    close()
    return out, marks


def prose_share(text: str) -> float:
    """Share of stop words in a text's words."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def judged(block: Block, beside: bool = False) -> int:
    """The block's own label; SHORT_BLOCK where it is too short or neither like prose nor unlike it.  ``beside``: a link stands beside it."""
    n = len(block.text)
    if is_link(block):
        mine = block.inside and not beside and (block.heading or n >= SHORT and prose_share(block.text) >= STOP_HIGH)
        return SHORT_BLOCK if mine else BAD
    if n < SHORT:
        return SHORT_BLOCK
    density = prose_share(block.text)
    return GOOD if density >= STOP_HIGH else SHORT_BLOCK if density >= STOP_LOW or block.inside else BAD


def is_link(block: Block) -> bool:
    return block.linked > LINK_DENSITY * len(block.text)


def furniture(marks: list[Mark], spared: frozenset[int]) -> dict[Mark, bool]:
    """Whether what stands in a container is furniture, by all marks around it but those of the kinds ``spared``."""
    out: dict[Mark, bool] = {}
    for mark in marks:
        out[mark] = not (mark.spared or mark.kind in spared) or mark.around is not None and out[mark.around]
    return out


def spare_the_most(found: list[Block], alone: list[int], marks: list[Mark]) -> None:
    """Forms, and containers with a hint, that hold most of the prose of a page whose article has none are no furniture."""
    never = furniture(marks, frozenset([FORM, HINT]))
    total = 0
    for block, label in zip(found, alone, strict=True):
        if label == GOOD and not (block.mark and never[block.mark]):
            if block.inside:
                return
            total += len(block.text)
            if block.mark:
                block.mark.prose += len(block.text)
    for mark in reversed(marks):
        if mark.around:
            mark.around.prose += mark.prose
        if mark.kind in (FORM, HINT) and mark.prose > MOST * total:
            mark.spared = True


#: Kinds of marks that are left out one after the other while a page has no text.
SPARING = (frozenset(), frozenset([FORM, HINT]), frozenset([FORM, HINT, ADVERT, READER]), frozenset([FORM, HINT, ADVERT, READER, ELEMENT]))


def labels(found: list[Block], marks: list[Mark]) -> list[int]:
    links = [is_link(b) for b in found]
    alone = [judged(b, i > 0 and links[i - 1] or i + 1 < len(found) and links[i + 1]) for i, b in enumerate(found)]
    spare_the_most(found, alone, marks)
    for spared in SPARING:
        bad = furniture(marks, spared)
        first = [BAD if b.mark and bad[b.mark] else label for b, label in zip(found, alone, strict=True)]
        if GOOD in first:
            return second_pass(found, first)
    bad = furniture(marks, frozenset())
    first = [BAD if b.mark and bad[b.mark] else label for b, label in zip(found, alone, strict=True)]
    out = second_pass(found, first)
    if GOOD in out:
        return out
    # No running text at all: what stands in no container of the page's furniture is the text.
    return [BAD if b.mark and bad[b.mark] or link else GOOD for b, link in zip(found, links, strict=True)]


def second_pass(found: list[Block], first: list[int]) -> list[int]:
    """Labels after the second pass: undecided blocks take that of the nearest decided neighbour."""
    n = len(first)
    after, before = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if first[i] else last
        before[i] = last
    last = None
    for i in range(n - 1, -1, -1):
        last = i if first[i] else last
        after[i] = last
    out = list(first)
    sure = GOOD in first
    for i, block in enumerate(found):
        if first[i]:
            continue
        left, right = before[i], after[i]
        # Neighbours in another part of the page (inside the article or not) count only where there are none in the block's own.
        if block.inside:
            left = left if left is not None and found[left].inside else None
            right = right if right is not None and found[right].inside else None
            if left is None and right is None:
                out[i] = GOOD
                continue
        if left is None and right is None:
            out[i] = BAD if sure else GOOD
        elif left is None or right is None:
            out[i] = first[right if left is None else left]
        elif block.heading:
            out[i] = first[right]
        elif (found[left].parent == block.parent) != (found[right].parent == block.parent):
            # A neighbour in the same container is nearer than any in another.
            out[i] = first[left] if found[left].parent == block.parent else first[right]
        elif first[left] == first[right]:
            out[i] = first[left]
        else:
            out[i] = first[left] if i - left < right - i else first[right] if right - i < i - left else GOOD if block.inside else BAD
    return out


def main_text(page: str | None) -> str:
    found, marks = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, labels(found, marks), strict=True) if label == GOOD)


def _extract(rows: Iterator[dict]) -> Iterator[tuple]:
    for row in rows:
        text = main_text(row["html"])
        yield row["page_id"], row["url"], text, len(text)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    sent = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return map_rows(sent, _extract, "page_id long, url string, text string, n_chars long")
