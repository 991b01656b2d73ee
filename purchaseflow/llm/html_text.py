"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass labels each block by link density, length and
stop-word density: good, bad, or undecided where it is short or in between. What stands in a place without article
text (menus, footers, forms, adverts, comments) is bad. In the second pass an undecided block takes the label of the
nearest decided blocks around it. Elements for articles only say how far to look: a block within one asks the decided
blocks of its own article first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import column

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    the of and to in is was for that it he on as with his by at be this from are or an had not but have they which were a
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er war nach wird bei einer um am sind noch wie
    le la les de des et un une du en est que dans qui au pour ne pas sur ce il se par plus avec sont aux ou son sa à été
    el los las de y en que un una del por con para no es al se lo como más su sus pero este ha o fue si sobre son
    """.split()
)
#: Elements whose content is never text: raw ones run to their end tag, whatever stands between, or to the page's end.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea")
#: The others are silent from their start tag to their own end tag; without one, just the tag is left out.
SILENT = frozenset("svg math object select canvas audio video button".split())
#: Of these, ``<svg/>`` has no content.
FOREIGN = ("svg", "math")
#: Elements that hold no article text, whatever their words. A form is a mark of the same kind as a place word.
OUTSIDE = frozenset("nav footer aside menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = (
    r"ads?|advert\w*|advertisement|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|topbar|toolbar|comments?|commentlist|reply|replies|respond|disqus|cc[_-]window|(?:col|column)[_-](?:left|right)|(?:left|right)[_-](?:col|column)|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|copyright|legal|disclaimer|skip|complementary|contentinfo|form"
)
#: What may follow such a word in its token: parts of a page, or a number. ``share-price`` and ``legal-history`` name a topic.
_PARTS = (
    r"\d+|ads?|area|aside|author|avatar|banner|bar|block|body|box|btn|button|buttons|card|cards|column|container|content|count|dialog|drawer|entry|feed|field|fields|"
    r"footer|form|group|head|header|heading|holder|icon|icons|inner|input|item|items|label|layer|layout|left|link|links|list|listing|main|menu|message|meta|modal|module|nav|"
    r"navigation|notice|outer|overlay|panel|policy|popup|post|posts|primary|region|right|root|row|secondary|section|settings|sheet|sidebar|slot|stories|story|strip|text|thread|tile|"
    r"title|toggle|top|bottom|tray|unit|widget|widgets|window|wrap|wrapper|zone|articles?|news|media|signup|share|sharing|results?|tools?|rail|sticky|fixed|inline|mobile|desktop"
)
#: Words in class, id or role that mark such places: a whole token, or its leading part before parts of a page or more such
#: words, or that after a word for where it stands. What says that there is or isn't such a place (``with-sidebar``,
#: ``comments-open``) marks none.
_MARK = rf"(?:^|\s)(?:(?:site|page|main|primary|secondary|global|top|bottom|left|right|post|entry|article|blog|inner|mobile|fixed|sticky|user|reader|visitor)[_-]+)?(?:{{0}})(?:[_-]+(?:{_PARTS}|{_WORDS}))*(?=$|\s)"
PLACE = re.compile(_MARK.format(_WORDS), re.I)
HEADER = re.compile(_MARK.format("header|masthead"), re.I)
#: What marks a comment or an advert on an element for articles, as a whole token.
ARTICLE_MARK = re.compile(r"(?:^|\s)(?:comments?|reply|ads?|advert\w*|sponsor\w*)(?=$|\s)", re.I)
#: Places of prose: they may hold more of it than the article does.
TALK = re.compile(_MARK.format("comments?|reply|replies|respond|disqus"), re.I)
ARTICLE_PLACE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body)(?=$|[\s_-])", re.I)

#: Headings under which readers speak, and blocks that only say that an advert stands there.
TALK_HEADING = re.compile(r"(?:\d[\d.,]*\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?:\s*[:(]?\s*\d*\s*\)?)?", re.I)
ADVERT_LABEL = re.compile(r"(?:ads?|adverts?|advertisements?|advertising|sponsored|anzeige|werbung|publicité|publicidad)[.:]?", re.I)

_RAW = "|".join(RAW)
#: Attributes: a quote means something only as the first character of a value.
_ATTRIBUTES = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+"
#: Comments, declarations, raw elements with all they hold, titles (just the tag and its words if never closed), and tags.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<title(?=[\s/>])[^>]*>(?:.{{0,10000}}?</title\s*>|[^<]*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)",
    re.S | re.I,
)
_MAY_BE_SILENT = re.compile(rf"<(?:{'|'.join(sorted(SILENT))})[\s/>]", re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: Letters that stand for about three Latin ones: kana, ideographs, syllables.
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SPACES = re.compile(r"\s+")

LONG, SHORT = 200, 70
#: Blocks in a row that are mostly links: so many are a menu, wherever they stand.
MENU = 3
STOPS_HIGH, STOPS_LOW, LINKS = 0.25, 0.12, 0.4
GOOD, NEAR, UNSURE, BAD = "good", "near", "unsure", "bad"


class Block:
    __slots__ = ("text", "linked", "outside", "article", "heading", "size", "_stops")

    def __init__(self, text: str, linked: int, outside: bool, article: int, heading: bool) -> None:
        # article: the number of the outermost element for articles around it, 0 if there is none
        self.text, self.linked, self.outside, self.article, self.heading = text, linked, outside, article, heading
        self.size = len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))
        self._stops = -1.0

    @property
    def stops(self) -> float:
        """Share of its words that are stop words."""
        if self._stops < 0:
            words = self.text.lower().split()
            self._stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        return self._stops

    @property
    def prose(self) -> int:
        """Letters outside links; none if it is mostly links."""
        return 0 if self.linked > LINKS * len(self.text) else len(self.text) - self.linked


class Mark:
    """A form or an element with a place word: its blocks, and whether it holds a main element or a first heading."""

    __slots__ = ("begin", "end", "form", "talk", "mains")

    def __init__(self, begin: int, form: bool, talk: bool, mains: int) -> None:
        self.begin, self.end, self.form, self.talk, self.mains = begin, -1, form, talk, mains


@lru_cache(4096)
def places(marked: str, is_article: bool) -> tuple[bool, bool, bool]:
    """Whether class, id and role mark a place without article text, a page's header, a place of talk."""
    return bool((ARTICLE_MARK if is_article else PLACE).search(marked)), bool(HEADER.search(marked)), bool(TALK.search(marked))


def settle(page: list[Block], marks: list[Mark]) -> None:
    """Blocks of marks become outside. A mark that holds most of the page's prose is a wrapper and is ignored: if it is a
    form, holds the main element or a first heading, or leaves no marked article and too little prose for one beside it."""
    prose = list(accumulate((0 if b.outside else b.prose for b in page), initial=0))
    covers = [0] * (len(page) + 1)
    wide = []
    for m in marks:
        if 2 * (prose[m.end] - prose[m.begin]) > prose[-1]:
            wide.append(m)  # each of these is within the one before
        else:
            covers[m.begin] += 1
            covers[m.end] -= 1
    for block, n in zip(page, accumulate(covers)):
        block.outside |= n > 0
    if not wide:
        return
    free = list(accumulate((0 if b.outside else LONG if b.article else b.prose if b.size >= SHORT else 0 for b in page), initial=0))
    for m in wide:
        beside = free[-1] - (free[m.end] - free[m.begin])
        if not (m.form or m.mains or beside < (SHORT if m.talk else LONG)):
            for block in page[m.begin : m.end]:
                block.outside = True
            break


def hidden(attributes: str) -> bool:
    if not attributes or "hidden" not in attributes and "display" not in attributes:
        return False
    return bool(_HIDDEN.search(attributes)) or "hidden" in _QUOTED.sub("", attributes).replace("=", " ").split()


def silent_ends(tokens: list[re.Match]) -> dict[int, int]:
    """By the number of its start tag, the number of the end tag of each silent element that has one of its own: not
    one of a later element of its name, nor one that stands behind the end of the element around it."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: Counter[str] = Counter()
    for i, m in enumerate(tokens):
        name = m[3] and m[3].lower()
        if name is None or name in INLINE or name in VOID:
            continue
        if not m[2]:
            if not (m[4].endswith("/") and name not in SILENT or name in FOREIGN and m[4].endswith("/")):
                stack.append((name, i))
                depth[name] += 1
        elif depth[name]:
            while True:
                top, begin = stack.pop()
                depth[top] -= 1
                if top == name:
                    break
            if name in SILENT:
                out[begin] = i
    return out


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, character references decoded and white space joined; empty ones are left out."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, Mark | None]] = []  # element, whether it is outside, whether it is the article, its mark
    marks: list[Mark] = []
    talks: list[tuple[int, Mark]] = []  # open places of talk under a heading, with the number of elements around each
    names: Counter[str] = Counter()  # of the open elements
    outside = article = articles = links = mains = 0
    heading = False

    def close() -> None:
        nonlocal heading
        if parts:
            text = _SPACES.sub(" ", unescape("".join(parts))).strip()
            if text:
                held = _SPACES.sub(" ", unescape("".join(linked))).strip() if linked else ""
                out.append(Block(text, len(held), outside > 0, articles if article else 0, heading))
            parts.clear()
            linked.clear()

    def leave(k: int) -> None:
        nonlocal outside, article
        while talks and talks[-1][0] > k:
            mark = talks.pop()[1]
            mark.end, mark.mains = len(out), mains - mark.mains
        for name, was_outside, was_article, mark in stack[k:]:
            names[name] -= 1
            outside -= was_outside
            article -= was_article
            if mark:
                mark.end, mark.mains = len(out), mains - mark.mains
        del stack[k:]

    tokens = list(_TOKEN.finditer(html))
    ends = silent_ends(tokens) if _MAY_BE_SILENT.search(html) else {}
    at = skip = 0
    for i, m in enumerate(tokens):
        if i < skip:
            continue
        if m.start() > at:
            parts.append(said := html[at : m.start()])
            if links:
                linked.append(said)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in SILENT:
            if i in ends:
                skip = ends[i] + 1
                at = tokens[ends[i]].end()
            continue
        if name == "a":
            links = 0 if m[2] else 1
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        if name == "head":  # all that it may hold is silent; its end tag may be missing
            continue
        if m[2]:
            if names[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if name in HEADINGS and out and out[-1].heading and TALK_HEADING.fullmatch(out[-1].text):
                talks.append((len(stack), Mark(len(out) - 1, False, True, mains)))
                marks.append(talks[-1][1])
            heading, links = False, 0
            continue
        if name == "p" or name in HEADINGS or name == "li":
            # these end an open element of the same kind without a closing tag of their own
            while stack and stack[-1][0] in ("p", *HEADINGS) or stack and name == "li" and stack[-1][0] == "li":
                leave(len(stack) - 1)
            links = 0
        if name in VOID or m[4].endswith("/"):
            continue
        marked = " ".join(x for a in _ATTRIBUTE.finditer(m[4]) for x in a.groups()[1:] if x) if m[4] else ""
        is_article = name in ("article", "main") or bool(marked and ARTICLE_PLACE.search(marked))
        is_outside = name in OUTSIDE or hidden(m[4])
        is_place, is_header, is_talk = places(marked, name == "article") if marked and name not in ("body", "html", "main") else (False, False, False)
        is_marked = name == "form" or is_place
        if not article and not is_article:  # an article's own header has its title
            is_outside = is_outside or name == "header"
            is_marked = is_marked or is_header
        mark = Mark(len(out), name == "form", is_talk, mains) if is_marked else None
        if mark:
            marks.append(mark)
        mains += name in ("main", "h1")
        stack.append((name, is_outside, is_article, mark))
        names[name] += 1
        outside += is_outside
        articles += is_article and not article
        article += is_article
        heading = name in HEADINGS
    if at < len(html):
        parts.append(html[at:])
    close()
    leave(0)
    for _, mark in talks:  # with no element around
        mark.end, mark.mains = len(out), mains - mark.mains
    if marks:
        settle(out, marks)
    return out


def first_label(block: Block, readable: bool = True) -> str:
    """The label that a block gets by itself. In a language without a list of stop words, length and links decide."""
    if block.outside or block.size < SHORT and ADVERT_LABEL.fullmatch(block.text):
        return BAD
    wordy = block.size >= SHORT and (block.stops >= STOPS_LOW or not readable)
    if block.linked > LINKS * len(block.text):
        return NEAR if block.article and wordy else UNSURE if block.article else BAD
    if block.size < SHORT:
        return UNSURE
    if wordy and (block.stops >= STOPS_HIGH or not readable and block.stops < STOPS_LOW):
        return GOOD if block.size > LONG or block.article else NEAR
    if wordy:
        return GOOD if block.article else NEAR
    return UNSURE if block.article else BAD


def first_labels(page: list[Block]) -> list[str]:
    """First labels. If most of the page's prose has no stop words to speak of, it is taken for another language. Short
    blocks of links, MENU or more in a row, are bad. If no block is good, near ones with few links count as good."""
    prose = [b for b in page if not b.outside and b.prose and b.size >= SHORT]
    readable = 2 * sum(b.prose for b in prose if b.stops >= STOPS_LOW) >= sum(b.prose for b in prose)
    first = [first_label(b, readable) for b in page]
    row: list[int] = []
    for i, b in enumerate([*page, None]):
        if b and first[i] == UNSURE and b.linked > LINKS * len(b.text):
            row.append(i)
            continue
        if len(row) >= MENU:
            for k in row:
                first[k] = BAD
        row = []
    if GOOD not in first:
        first = [GOOD if f == NEAR and 2 * b.linked <= LINKS * len(b.text) else f for f, b in zip(first, page)]
    return first


def decided(page: list[Block], first: list[str], order: range) -> list[tuple[int, str] | None]:
    """For each block the nearest decided one before it in ``order``: for a block of an article, of that article, where
    places without article text say nothing; for others, of the page."""
    out: list[tuple[int, str] | None] = [None] * len(page)
    seen, within, number = None, None, 0
    for i in order:
        b = page[i]
        if b.article and b.article != number:
            within, number = None, b.article
        out[i] = within if b.article else seen
        if first[i] in (GOOD, BAD):
            seen = (i, first[i])
            if b.article and not b.outside:
                within = seen
    return out


def labels(page: list[Block]) -> list[bool]:
    """Which blocks are main text. An undecided block inherits from the nearest decided blocks before and after it:
    ``near`` is text if either is good; ``unsure`` takes the label that both have, else that of the nearer one, and
    between a good and a bad one at the same distance it is text if it ends as a sentence does, or if it is a heading
    before a good block. Beyond an article's ends there is no neighbour, and where it has none at all, its element
    decides; the page's ends count as bad."""
    first = first_labels(page)
    ahead, behind = decided(page, first, range(len(page))), decided(page, first, range(len(page) - 1, -1, -1))
    out: list[bool] = []
    for i, block in enumerate(page):
        if first[i] in (GOOD, BAD):
            out.append(first[i] == GOOD)
            continue
        if block.article:
            p, q = ahead[i] or behind[i], behind[i] or ahead[i]
            if p is None:
                out.append(True)
                continue
        else:
            p, q = ahead[i] or (-1, BAD), behind[i] or (len(page), BAD)
        if p[1] == q[1]:
            out.append(p[1] == GOOD)
        elif first[i] == NEAR:
            out.append(True)
        elif block.heading:
            out.append(q[1] == GOOD)
        elif i - p[0] != q[0] - i:
            out.append((p if i - p[0] < q[0] - i else q)[1] == GOOD)
        else:
            out.append(block.text[-1] in ".!?…\"”»)")
    return out


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in order with one space between; empty if there is none."""
    if not html:
        return ""
    page = blocks(html)
    return " ".join(b.text for b, keep in zip(page, labels(page), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, without a shuffle. Null or empty pages give empty text; ids and urls
    pass through, null or not; repeated rows come out as often as they come in. Other columns are left out, so their
    names clash with nothing. An empty table gives no rows; a page of any length is taken whole."""
    src = pages.select(column(id_col).alias("page_id"), column(url_col).alias("url"), column(html_col).cast("string").alias("html"))
    schema = StructType([src.schema["page_id"], src.schema["url"], *StructType.fromDDL("text string, n_chars long")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, schema).withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
