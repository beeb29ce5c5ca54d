"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

A page is cut into flat blocks of text at block-level tags. A block is described by numbers: its own word count and link
density, those of the blocks before and after it, whether it stands in the part of the page that holds the text
(``inside``: its article or main elements, where they have a fiftieth of the words at least, else where most words stand; ``article`` says which),
whether it stands in an element of another purpose (navigation, footers, forms, notices by name), whether it is a
heading or a list item, and whether it stands in a box of a text of paragraphs (``odd``: an advert or a reader's comment,
but an opening or a long passage too, which its words and links and those of its neighbours tell). An element that holds the text's part is never of another purpose, whatever its tag or name says. A CART tree, trained at start on the blocks of a few small labelled pages
(``PAGES``), decides which blocks are main text.

Defined results: null and empty pages give an empty text, as do pages without a block of main text; an empty table gives
no rows, repeated rows each their own; scripts, styles, comments, buttons and other raw elements hold no text; unclosed
tags end with their parent, unclosed comments with the page; in a tag whose quote never ends, quotes mean nothing from
there on; elements nested deeper than MOST_DEPTH are laid flat, as browsers do; references are decoded once; white space
within a block becomes one space; nothing is capped, and a page takes time in proportion to its length; extra columns are
kept (those named text or n_chars give way to the results).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import slices

MOST_DEPTH = 512
# Element names of HTML by what they do, and words that end the names of page parts.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = frozenset("p li dd blockquote pre".split())
BOXES = frozenset("div section".split())
CONTAINERS = frozenset("html body div section article main center table tbody tr td form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template iframe noframes noembed object svg math canvas audio video xmp noscript button select".split())
ASIDE = frozenset("nav footer aside form menu dialog head title search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset("nav navbar navigation menu masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices comment comments respond replies discussion discussions reactions feedback disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager subscribe newsletter signup login popup modal widget toolbar skip".split())
_P_ENDERS = BLOCK - frozenset("dd dt li td th tr tbody thead tfoot caption legend body html head optgroup summary title".split())
_SIBLINGS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>=]|=(?!\s*["'])|=\s*"[^"]*"|=\s*'[^']*')*+)>""")  # never tried twice: it can't give back
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
_RAW_END = {name: re.compile(f"</{name}(?![a-z0-9])", re.I | re.A) for name in RAW}


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    element: int
    heading: bool


class Element(NamedTuple):
    name: str
    attributes: str
    parent: int


def named_aside(element: Element) -> bool:
    """By the last word of a name in class or id, as in cookie-notice, or by role; with-sidebar says what stands beside it."""
    for key, value in _ATTRIBUTE.findall(element.attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "role" and value.lower() in ASIDE_ROLES) or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", token) if w]
                if parts and parts[-1] in ASIDE_WORDS and parts[0] not in ("with", "has", "no"):
                    return True
    return False


class Parser:
    """Cuts a page into blocks, in one pass."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.blocks: list[Block] = []
        self.elements: list[Element] = [Element("", "", -1)]
        self.stack: list[tuple[str, int, int, int]] = []  # name, element, and links and headings around it
        self.open: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # open inline elements since the innermost block began
        self.text: list[tuple[str, bool]] = []
        self.links = self.headings = 0
        at, size = 0, len(page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self.text.append((page[at:start], self.links > 0))
            at = self._tag(start) if start < size else size
        self._end()

    @property
    def element(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _end(self) -> None:
        if self.text:
            whole = " ".join(html.unescape("".join(t for t, _ in self.text)).split())
            if whole:
                linked = sum(len(html.unescape(t).split()) for t, a in self.text if a)
                n = whole.count(" ") + 1
                self.blocks.append(Block(whole, n, min(linked, n), self.element, self.headings > 0))
            self.text = []

    def _tag(self, start: int) -> int:
        """What stands at a "<"; gives where it ends."""
        page, size = self.page, len(self.page)
        m = _NAME.match(page, start + 1)
        if not m:
            if page.startswith("<!--", start):
                return page.find("-->", start + 4) + 3 if page.find("-->", start + 4) >= 0 else size
            if page.startswith("<![CDATA[", start):
                stop = page.find("]]>", start + 9)
                if stop >= 0:
                    self.text.append((html.escape(page[start + 9 : stop]), self.links > 0))
                    return stop + 3
            if page.startswith(("<!", "<?", "</"), start):
                return page.find(">", start) + 1 or size
            self.text.append(("<", self.links > 0))
            return start + 1
        rest = _REST.match(page, m.end()) if self.quotes else None
        if rest:
            attributes, at = rest[1], rest.end()
        else:
            self.quotes = False
            stop = page.find(">", m.end())
            if stop < 0:
                return size  # a tag that never ends
            attributes, at = page[m.end() : stop], stop + 1
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                self._end()
            if name == "br":
                self.text.append((" ", False))
            self._close(name)
        elif name == "br":
            self.text.append((" ", False))
        elif name in RAW:
            self.text.append((" ", False))
            if not attributes.endswith("/"):
                stop = _RAW_END[name].search(page, at)
                return (page.find(">", stop.end()) + 1 or size) if stop else size
        else:
            self._start(name, attributes)
        return at

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._end()
            if name in _P_ENDERS and self.open["p"]:
                self._close("p", among=8)
            if name in _SIBLINGS and self.open[name]:
                for s in reversed(self.stack):
                    if s[0] in _SIBLINGS[name]:
                        break
                    if s[0] == name:
                        self._close(name)
                        break
        if name in VOID or attributes.endswith("/") or len(self.stack) >= MOST_DEPTH:
            return
        element = self.element
        if name in BLOCK:
            self.elements.append(Element(name, attributes, element))
            element = len(self.elements) - 1
            self.open[name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1
        self.stack.append((name, element, self.links, self.headings))
        self.links += name == "a"
        self.headings += name in HEADINGS

    def _close(self, name: str, among: int = MOST_DEPTH) -> None:
        """An inline element isn't closed across the block that it stands around; an end without a start means nothing."""
        if not (self.open if name in BLOCK else self.inline[-1])[name]:
            return
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - among), -1):
            if self.stack[i][0] == name:
                for n, *_ in self.stack[i:]:
                    if n in BLOCK:
                        self.open[n] -= 1
                        self.inline.pop()
                    else:
                        self.inline[-1][n] -= 1
                _, _, self.links, self.headings = self.stack[i]
                del self.stack[i:]
                return


NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "aside", "article", "heading", "item", "odd")


def features(parsed: Parser) -> np.ndarray:
    """A row for each block: NAMES. What stands beyond the page's ends counts as empty."""
    blocks, elements = parsed.blocks, parsed.elements
    n = len(blocks)
    words = np.array([0, *(b.words for b in blocks), 0], dtype=float)
    links = np.array([0, *(b.link_words / b.words for b in blocks), 0], dtype=float)
    held, headed = [0] * len(elements), [False] * len(elements)  # words outside links, and whether a heading stands right in it
    for b in blocks:
        held[b.element] += b.words - b.link_words
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        if elements[i].name in HEADINGS and held[i]:
            headed[elements[i].parent] = True
    holds = [e.name in ("article", "main") for e in elements]  # itself or below it
    for i in range(len(elements) - 1, 0, -1):
        holds[elements[i].parent] |= holds[i]
    told, marked = [False] * len(elements), 0  # in such an element
    for i in range(1, len(elements)):
        told[i] = told[elements[i].parent] or elements[i].name in ("article", "main")
        if told[i] and not told[elements[i].parent]:
            marked += held[i]
    # Else the part with most of the words: down through containers that hold most of what their parent holds.
    at, best, parents = 0, dict[int, int](), {e.parent for e in elements}
    for i in range(1, len(elements)):
        p = elements[i].parent
        if i in parents and elements[i].name in CONTAINERS and (p not in best or held[i] > held[best[p]]):
            best[p] = i
    while at in best and 2 * held[best[at]] > held[at] and not headed[at]:
        at = best[at]
    inside, aside, told_so = [True] * len(elements), [0] * len(elements), marked > 0 and 50 * marked >= held[0]
    for i in range(1, len(elements)):
        e = elements[i]
        inside[i] = told[i] if told_so else at == 0 or i == at or (inside[e.parent] and e.parent >= at)
        whole = holds[i] if told_so else 4 * held[i] > 3 * held[0]
        aside[i] = aside[e.parent] + (not whole and (e.name in ASIDE or named_aside(e) or (e.name == "header" and not inside[e.parent])))
    inside[0] = at == 0 and not told_so
    odd = _odd(blocks, elements, inside, aside)
    flags = np.array([[inside[b.element], min(aside[b.element], 1), told_so and told[b.element], b.heading, elements[b.element].name in ("li", "td", "th", "dt"), o] for b, o in zip(blocks, odd, strict=True)], dtype=float).reshape(n, 6)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags])


def _odd(blocks: list[Block], elements: list[Element], inside: list[bool], aside: list[int]) -> list[bool]:
    """Which blocks stand right in a box (or are headings of one without paragraphs) of a text that is mostly paragraphs."""
    textual, boxed, own = [0] * len(elements), 0, 0
    for b in blocks:
        name = elements[b.element].name
        if name in TEXTUAL:
            textual[b.element] += b.words
            own += b.words * (inside[b.element] and not aside[b.element])
        elif name in BOXES and inside[b.element] and not aside[b.element]:
            boxed += b.words
    if own <= boxed:
        return [False] * len(blocks)
    for i in range(len(elements) - 1, 0, -1):
        textual[elements[i].parent] += textual[i]

    def in_box(b: Block) -> bool:
        e = elements[b.element]
        if e.name in HEADINGS:
            return elements[e.parent].name in BOXES and not textual[e.parent]
        return e.name in BOXES and (not textual[b.element] or not b.heading)

    return [in_box(b) for b in blocks]


# The labelled pages. A number in braces stands for so many words; blocks that begin with § are main text.
PAGES = [
    "<body><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div>{12}</div><article><h1>§{8}</h1><p>§{60}<p>§{120}<p>§{9}<p>§{1}<p>§{40} <a>{3}</a></article><footer>{5} <a>{2}</a> {15}</footer>",
    "<body><header><a>{2}</a> {4}</header><div class=notice>{25}</div><main><header><h1>§{6}</h1><p>§{2}</p></header><p>§{90}<aside><h3>{2}</h3><p>{40}</aside><p>§{4}<p>§{200}<blockquote>§{30} <a>{2}</a></blockquote><ul><li>§{7}<li>§{12}</ul><section class=comments><h2>{1}</h2><p>{45}<p>{80}</section></main><footer><p>{20}</footer>",
    "<body><div id=top><a>{1}</a><a>{1}</a><a>{2}</a></div><div id=wrap><h1>§{7}</h1><div>§{18}</div><div>§{75}</div><div>§{140}</div><div>§{6}</div><div>§{60}</div></div><div><a>{3}</a> <a>{4}</a> <a>{3}</a></div><div>{6}</div>",
    "<body><table><tr><td><a>{2}</a><br><a>{2}</a><br><a>{1}</a></td><td><h2>§{5}</h2><p>§{35}<p>§{50}<p>§{3}<p>§{90}</td><td>{15}</td></tr></table><p><a>{2}</a> <a>{2}</a>",
    "<body><div><div><a>{1}</a> <a>{1}</a> <a>{1}</a></div><div>{3}</div></div><p>§{80}<p>§{45}<p>§{12}<p>§{100}<div><a>{6}</a></div><div><a>{5}</a></div><div>{4}</div>",
    "<body><form id=page><div><a>{2}</a><a>{1}</a></div><div class='content with-sidebar'><h1>§{9}</h1><p>§{55}<p>§{20}<form><label>{2}</label> {6}</form><p>§{70}</div><div class=sidebar><p>{30}<p>{14}</div></form>",
    "<body><div><p>{18}</div><div><p>{30} <a>{2}</a></div><section><article><h1>§{4}</h1><p>§{2}<p>§{110}<figure><figcaption>§{9}</figcaption></figure><h2>§{3}</h2><p>§{150}<p>§<a>{3}</a><div class=related><a>{6}</a><a>{7}</a></div><p>§{26}</article></section><div><p>{12}</div><div>{2}</div>",
    "<body><h1>§{5}</h1><p>§{30}<p>§{8}<ul><li>§{5}<li>§{9} <a>{1}</a></ul><p>§{60}<p><a>{1}</a> | <a>{1}</a>",
    "<body><ul><li><a>{1}</a><li><a>{1}</a></ul><div>{2}</div><div>§{40}</div><div>§{6}</div><div>§{85}</div><ul><li><a>{4}</a><li><a>{6}</a><li><a>{5}</a></ul><div>{5}</div><ul><li><a>{2}</a></ul>",
    "<body><p><a>{2}</a><p><a>{1}</a><p>{4}<p><a>{2}</a><p>§{120}<p>§{25}<p>§{90}<p>{3} <a>{5}</a><p><a>{4}</a><p><a>{6}</a><p>{7} <a>{9}</a>",
    "<body><article><p>§{3}</article>",
    "<body><div><a>{1}</a> <a>{1}</a></div><div><h1>§{2}</h1><p>§{50}<h2>§{1}</h2><p>§{30}<h2>§{2}</h2><p>§{4}</div>",
    "<body><div><h1>§{1}</h1><p>§{90}<h3>§{2}</h3><p>§{20}</div>",
    "<article><h1>§{3}</h1><p>§{50}<p>§{20}</article>",
    "<nav><a>{2}</a></nav><article><h1>§{6}</h1><p>§{60}<p>§{4}</article>",
    "<article><p>§{10}<h2>§{2}</h2><p>§{130}<p>§{9}</article>",
    "<main><p>§{30}<p>§{1}</main>",
    "<article><p>§{30}<p>§<a>{2}</a><p>§{6}</article>",
    "<article><p>§<a>{4}</a><p>§{2}</article>",
    "<main><p>§{9}<p>§<a>{1}</a><p>§{15}</main>",
    "<article><p>§<a>{2}</a><p>§{3}<p>§{80}<p>§<a>{1}</a><p>§{12}<p>§{5}</article>",
    "<article><p>§{30}<p>§{7} <a>{1}</a></article>",
    "<nav><a>{1}</a></nav><article><h1>§{4}</h1><p>§<a>{13}</a><p>§{60}<p>§<a>{1}</a><p>§{5}<p>§<a>{1}</a><h2>§{3}</h2><p>§{80}<p>§<a>{1}</a><p>§{1}<p>§<a>{5}</a><p>§{130}<p>§<a>{1}</a><p>§{2}<p>§<a>{7}</a><p>§{25}<nav><a>{3}</a></nav></article><footer><a>{2}</a></footer>",
    "<div><a>{1}</a></div><article><h1>§{2}</h1><p>§<a>{2}</a><p>§<a>{3}</a><p>§<a>{30}</a><p>§{2}<p>§<a>{1}</a><p>§{200}<p>§<a>{1}</a></article>",
    "<body><nav><a>{1}</a> <a>{1}</a></nav><article><h1>§{2}</h1><p>§{40}<p>§<a>{2}</a><p>§{3}<p>§<a>{9}</a> {2}<p>§{4}</article><nav><a>{2}</a></nav>",
    "<body><div><a>{1}</a> <a>{1}</a></div><div><h1>§{3}</h1><p>§{50}<p>§{12}</div><div><a>{5}</a></div>",
    "<body><ul><li><a>{2}</a></ul><article><p>§{4}<p>§<a>{4}</a><ul><li>§<a>{2}</a><li>§<a>{12}</a></ul><table><tr><td>§{1}<td>§{2}</table><h3>§{4}</h3><p>§<a>{1}</a></article><div><a>{4}</a></div>",
    "<body><div><a>{3}</a></div><h2>§{4}</h2><p>§{30}<p>§{70}<p><a>{2}</a> <a>{2}</a>",
    "<body><main><h1>§{3}</h1><p>§{5} <a>{4}</a><p>§<a>{8}</a><p>§{14}<nav><a>{1}</a></nav></main><footer>{30}</footer>",
    "<p>§{12}",
    # Texts of paragraphs with boxes between them: where they stand says nothing, words and links of box and neighbours do.
    "<article><h1>§{7}</h1><p>§{60}<p>§{80}<div>{10} <a>{2}</a></div><p>§{70}<p>§{12}</article>",
    "<article><h1>§{5}</h1><div>§{24}</div><p>§{90}<p>§{50}<div>{9}</div><p>§{66}</article>",
    "<article><h1>§{6}</h1><p>§{40}<div>§{120}</div><p>§{30}<p>§{70}<div>§{95} <a>{2}</a></div></article>",
    "<article><p>§{45}<p>§{75}<div>{14} <a>{5}</a></div><div>{6} <a>{1}</a></div><p>§{55}</article>",
    "<main><h1>§{4}</h1><div>§{18}</div><p>§{60}<p>§{100}<div><a>{8}</a></div><p>§{33}<div>{12}</div></main>",
    "<article><h1>§{8}</h1><p>§{80}<p>§{110}<div><h3>{1}</h3><div>{20}</div><div>{35}</div><div>{12}</div><div>{3}</div></div></article>",
    "<nav><a>{2}</a></nav><article><h1>§{9}</h1><div>§{31}</div><p>§{140}<div>{5}</div><p>§{20}<p>§{85}<section><h2>{2}</h2><div>{28}</div><div>{44} <a>{1}</a></div></section></article><footer>{12}</footer>",
    "<article><h1>§{3}</h1><p>§{30}<div>{22}</div><p>§{64}<div>{7} <a>{4}</a></div></article><div>{18}</div>",
    "<body><div><a>{1}</a><a>{2}</a></div><div><h1>§{6}</h1><p>§{75}<div>{11} <a>{2}</a></div><p>§{90}<p>§{8}<div>{16}</div></div><div>{4}</div>",
    "<main><h1>§{5}</h1><section><h2>§{2}</h2><p>§{50}</section><section><h2>§{3}</h2><p>§{40}<p>§{6}</section><div>{13}</div></main>",
    "<article><h1>§{6}</h1><div>§{12}</div><p>§{70}<p>§{44}<div>{30} <a>{3}</a></div><p>§{52}</article>",
    "<article><h2>§{4}</h2><p>§{90}<h2>§{3}</h2><div>§{82}</div><p>§{35}<div>{40}</div></article>",
    "<article><h1>§{7}</h1><p>§{110}<div>§{90}</div><p>§{100}<p>§{60}<div>§{130}</div><p>§{120}<div>{10}</div></article>",
    "<article><p>§{70}<div>§{70}</div><p>§{80}<div>§{150} <a>{1}</a></div><p>§{64}<div>{40} <a>{2}</a></div><p>§{90}</article>",
]


class Tree:
    """A CART tree (Gini impurity) over numeric features; of equal cuts the first in NAMES."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature, self.bound, self.value, self.next = -1, 0.0, bool(y.mean() >= 0.5), None
        best = 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9
        if not depth or not 0 < y.mean() < 1:
            return
        for f in range(x.shape[1]):
            seen = np.unique(x[:, f])
            for bound in ((seen[1:] + seen[:-1]) / 2).tolist():
                side = x[:, f] > bound
                impurity = sum(2 * p * (1 - p) * k for p, k in ((y[s].mean(), s.sum()) for s in (side, ~side)))
                if impurity < best - 1e-9:
                    best, self.feature, self.bound = impurity, f, bound
        if self.feature >= 0:
            side = x[:, self.feature] > self.bound
            self.next = (Tree(x[~side], y[~side], depth - 1), Tree(x[side], y[side], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.next is None:
            return np.full(len(x), self.value)
        side = x[:, self.feature] > self.bound
        out = np.empty(len(x), dtype=bool)
        for k in (0, 1):
            out[side == k] = self.next[k].predict(x[side == k])
        return out

    def used(self) -> set[str]:
        return set() if self.next is None else {NAMES[self.feature]} | self.next[0].used() | self.next[1].used()


def table(pages: list[str] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' blocks."""
    x, y = [], []
    for page in pages:
        parsed = Parser(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        x.append(features(parsed))
        y += [b.text.startswith("§") for b in parsed.blocks]
    return np.concatenate(x), np.array(y, dtype=float)


@cache
def trained() -> Tree:
    return Tree(*table())


def main_text(page: str | None, tree: Tree) -> str:
    parsed = Parser(page or "")
    return "\n\n".join(b.text for b, k in zip(parsed.blocks, tree.predict(features(parsed)), strict=True) if k) if parsed.blocks else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages, without the html, with text and n_chars."""
    tree = trained()
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")], F.col(column).alias("__al_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__al_html"):
            text = [main_text(p, tree) for p in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op7_html_text(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
