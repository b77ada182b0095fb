"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass judges each block by itself from its place in
the page, its link density, its share of stop words and its length: ``good``, ``bad`` or undecided. The second
pass gives undecided blocks (short ones above all) the label of the nearest decided neighbour of the same
region. Pages are independent rows, so nothing is shuffled; work and memory are linear in the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names of HTML by the way they are treated.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe label legend menu nav noscript object optgroup option "
    "search select svg template textarea title video".split()
)
OWN_KIND = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

# Words of class, id and role attributes that name side matter, and those that undo the next one.
SIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disqus dialog alert alertdialog footer gdpr header masthead menu menubar modal nav "
    "navbar navigation navigationbar newsletter notice notification overlay pagination pager popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe "
    "tagcloud toolbar widget widgets contentinfo complementary".split()
)
UNDONE = frozenset("no not has with without".split())
MAIN = frozenset("article content contents entry main post story text".split())

# Frequent function words of the four languages of the pages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to "
    "was we were which will with you "
    "al como con de del el en es esta este la las lo los más no para pero por que se sin sobre son su sus un una y "
    "au aux avec ce ces cette dans des du elle est et il ils le les leur mais ne nous on ou par pas pour qui sa ses son sur une vous "
    "als auch auf aus bei das dem den der des die ein eine einen er es für hat im ist mit nach nicht oder sich sie sind und von "
    "war wie wird zu zum zur".split()
)

SHORT_WORDS = 10  # blocks below are too short to judge by themselves
LONG_WORDS = 40  # blocks from here on are text even with few stop words
LINK_DENSITY = 0.5
STOP_HIGH, STOP_LOW = 0.15, 0.05
MAX_DEPTH = 512  # deeper elements count as their ancestor, as in browsers

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
TAG_START = re.compile("</?[A-Za-z]")
ATTRIBUTE = re.compile(r"""([A-Za-z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GOOD, BAD, OPEN = 1, -1, 0


@dataclass(slots=True)
class Region:
    """Part of a page whose blocks share a role: ``sign`` is 1 for the article, -1 for side matter, else 0."""

    sign: int = 0
    outer: Region | None = None
    weak: str = ""  # "name" or "form": side matter that is undone when it turns out to hold the article

    def role(self) -> int:
        at, sign = self, 0
        while at is not None:
            if at.sign < 0:
                return BAD
            sign, at = sign or at.sign, at.outer
        return sign


@dataclass(slots=True)
class Element:
    name: str
    region: Region
    inline: bool = False
    repeats: int = 0


@dataclass(slots=True)
class Block:
    region: Region
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    label: int = OPEN


def name_words(value: str) -> list[str]:
    return [w.lower() for w in NAME_WORD.findall(value)]


def names_side(value: str, in_article: bool) -> bool:
    """Whether a class, id or role value names side matter (``no-sidebar`` does not, nor does the header of an article)."""
    words = name_words(value)
    for before, word in zip(["", *words], words, strict=False):
        if word in SIDE and before not in UNDONE and not (word == "header" and (in_article or before in MAIN)):
            return True
    return False


class Page:
    """Blocks of one page, in page order, each with the region it lies in."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.stack: list[Element] = [Element("", Region())]
        self.open: dict[str, int] = {}
        self.link = False
        self.block = Block(self.stack[0].region)
        self._read(html)
        self._cut()

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            if start > at:
                self._text(html[at:start])
            if html.startswith("<!--", start):
                # an unclosed comment reaches to the end of the page
                stop = start + 4 if html.startswith((">", "->"), start + 4) else html.find("-->", start + 4)
                at = html.find(">", stop) + 1 if stop >= 0 else end
                continue
            if html[start + 1 : start + 2] in ("!", "?") or html.startswith("</", start) and not html[start + 2 : start + 3].isalpha():
                stop = html.find(">", start)
                at = stop + 1 if stop >= 0 else end
                continue
            if not TAG_START.match(html, start):
                self._text("<")
                at = start + 1
                continue
            tag = TAG.match(html, start)
            if tag is None:  # a page cut off inside a tag
                return
            at = tag.end()
            name = tag[2].lower()
            if tag[1]:
                self._close(name)
            elif name in RAW:
                closing = CLOSING[name].search(html, at)
                at = closing.start() if closing else end
            else:
                self._start(name, tag[3])

    def _text(self, raw: str) -> None:
        part = unescape(raw) if "&" in raw else raw
        self.block.parts.append(part)
        if self.link:
            self.block.linked.append(part)

    def _cut(self, heading: bool = False) -> None:
        """End the current block and begin the next one in the region now open."""
        block = self.block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            self.blocks.append(block)
        self.block = Block(self.stack[-1].region, heading)

    def _region(self, name: str, attributes: str) -> Region | None:
        outer = self.stack[-1].region
        in_article = outer.role() == GOOD
        sign, weak = 0, ""
        if name in LEFT_OUT:
            sign, weak = BAD, "form" if name == "form" else ""
        elif name == "header" and not in_article:
            sign, weak = BAD, "name"
        elif name in ("article", "main"):
            sign = GOOD
            self._undo("form", "name") if name == "main" else self._undo("form")
        if "=" in attributes or "hidden" in attributes:
            given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            bare = ATTRIBUTE.sub(" ", attributes).lower().split()
            if "hidden" in bare or "hidden" in given or given.get("aria-hidden") == "true" or HIDDEN.search(given.get("style", "")):
                return Region(BAD, outer)
            if name not in ("html", "body", "main") and sign != BAD:
                named = [given[a] for a in ("class", "id", "role") if a in given]
                if any(names_side(value, in_article) for value in named):
                    sign, weak = BAD, "name"
                elif name in ("div", "section", "td") and any(MAIN.intersection(name_words(value)) for value in named):
                    sign = GOOD
        return Region(sign, outer, weak) if sign else None

    def _undo(self, *kinds: str) -> None:
        """Forms around a title or an article, and anything weak around ``main``, are no side matter after all."""
        region = self.stack[-1].region
        while region is not None:
            if region.weak in kinds:
                region.sign = 0
            region = region.outer

    def _start(self, name: str, attributes: str) -> None:
        if name == "a":
            self.link = "href" in attributes.lower()
            return
        if name not in BLOCK:
            if name == "br":
                self._text(" ")
            elif name not in VOID and len(self.stack) < MAX_DEPTH:
                self._push_inline(name, attributes)
            return
        while self.stack[-1].inline or self.stack[-1].name == "p" or self.stack[-1].name in HEADING:
            self._pop()
        if name in OWN_KIND:
            self._leave_sibling(name)
        if name == "h1":
            self._undo("form")
        region = self._region(name, attributes)
        if name not in VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append(Element(name, region or self.stack[-1].region))
            self.open[name] = self.open.get(name, 0) + 1
        self.link = False
        self._cut(name in HEADING)

    def _push_inline(self, name: str, attributes: str) -> None:
        """Inline elements matter only where they open a region of their own (or lie in one of the same name)."""
        top = self.stack[-1]
        if top.inline and top.name == name:
            top.repeats += 1
            return
        region = self._region(name, attributes)
        if region is not None:
            self.stack.append(Element(name, region, inline=True))
            self.open[name] = self.open.get(name, 0) + 1
            self._cut(self.block.heading)

    def _leave_sibling(self, name: str) -> None:
        """``<li>`` ends an open ``<li>`` of the same list; likewise for cells, rows and terms."""
        kinds = {"td", "th"} if name in ("td", "th") else {"dt", "dd"} if name in ("dt", "dd") else {name}
        borders = set(OWN_KIND[name].split())
        if not any(self.open.get(k) for k in kinds):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].name in kinds:
                while len(self.stack) > depth:
                    self._pop()
                return
            if self.stack[depth].name in borders:
                return

    def _pop(self) -> None:
        gone = self.stack.pop()
        self.open[gone.name] -= 1
        if gone.inline:
            self._cut(self.block.heading)

    def _close(self, name: str) -> None:
        if name == "a":
            self.link = False
            return
        if name not in BLOCK:
            top = self.stack[-1]
            if top.inline and top.name == name:
                if top.repeats:
                    top.repeats -= 1
                else:
                    self._pop()
            return
        if self.open.get(name):
            while self.stack[-1].name != name or self.stack[-1].inline:
                self._pop()
            self._pop()
        self.link = False
        self._cut()


def first_pass(blocks: list[Block]) -> None:
    """Judge every block by itself; short and doubtful ones stay open."""
    measured = []
    for block in blocks:
        words = WORD.findall(block.text)
        stops = sum(w.lower() in STOP_WORDS for w in words)
        measured.append((len(words), stops / len(words) if words else 0.0))
    readable = any(n >= SHORT_WORDS and share >= STOP_LOW for n, share in measured)  # else: a language without a list
    for block, (n, share) in zip(blocks, measured, strict=True):
        role = block.region.role()
        linked = len("".join("".join(block.linked).split())) / len(block.text.replace(" ", ""))
        if role == BAD:
            block.label = BAD
        elif linked > LINK_DENSITY:
            block.label = OPEN if role == GOOD and share >= STOP_HIGH and n >= SHORT_WORDS else BAD
        elif n < SHORT_WORDS:
            block.label = OPEN
        elif share >= STOP_HIGH or n >= LONG_WORDS and (share >= STOP_LOW or not readable or role == GOOD):
            block.label = GOOD
        elif share < STOP_LOW and readable and role != GOOD:
            block.label = BAD
        else:
            block.label = OPEN


def _nearest(blocks: list[Block], roles: list[int], order: range) -> list[tuple[int, int]]:
    """(distance in blocks, label) of the last decided block of the same region before each one in ``order``."""
    out, last = [(0, OPEN)] * len(blocks), {}
    for i in order:
        if blocks[i].label == OPEN:
            at, label = last.get(roles[i], (i, OPEN))
            out[i] = (abs(i - at), label)
        else:
            last[roles[i]] = (i, blocks[i].label)
    return out


def second_pass(blocks: list[Block]) -> list[int]:
    """Labels of all blocks: open ones take that of the nearest decided neighbour of their region. A heading
    follows the block after it; on a tie a block without links is good. Plain text inside the article is good
    whatever is beside it. Regions without a decided block: the article's own are good, others only where the
    page has no good block at all."""
    roles = [block.region.role() for block in blocks]
    before = _nearest(blocks, roles, range(len(blocks)))
    after = _nearest(blocks, roles, range(len(blocks) - 1, -1, -1))
    none_good = not any(b.label == GOOD for b in blocks) and GOOD not in roles
    labels = []
    for block, role, (near, left), (far, right) in zip(blocks, roles, before, after, strict=True):
        if block.label != OPEN:
            label = block.label
        elif role == GOOD and not block.linked:
            label = GOOD  # inside the article only link lists are bad: plain text beside them stays
        elif left == right == OPEN:
            label = GOOD if role == GOOD or none_good else BAD
        elif left == OPEN or right == OPEN or left == right:
            label = left or right
        elif block.heading:
            label = right
        elif near != far:
            label = left if near < far else right
        else:
            label = BAD if block.linked else GOOD
        labels.append(label)
    return labels


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, number of blocks, number of kept ones) of one page; null and empty pages have none."""
    if not html:
        return "", 0, 0
    blocks = Page(html).blocks
    first_pass(blocks)
    labels = second_pass(blocks)
    kept = [b.text for b, label in zip(blocks, labels, strict=True) if label == GOOD]
    return "\n".join(kept), len(blocks), len(kept)


RESULT = "text string, n_blocks int, n_kept int"
ARROW = pa.struct([("text", pa.string()), ("n_blocks", pa.int32()), ("n_kept", pa.int32())])


def extract(html: Column | str) -> Column:
    """Struct (text, n_blocks, n_kept) of each page.

    Left out: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and
    reader comments. Character references are decoded, white space inside a block becomes one space, blocks
    are joined by one newline in page order; nothing else is dropped or capped. Null, empty and text-free
    pages give an empty text; a page cut off in the middle keeps the blocks it has; repeated pages and pages
    of any length are handled alike. Other columns of the page's table are not looked at.
    """

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("text", "n_blocks", "n_kept"), main_text(p.as_py()), strict=True)) for p in pages], type=ARROW)

    return F.arrow_udf(run, RESULT)(html)
