"""A forgiving HTML reader: elements, their text blocks, and features of each element."""

from __future__ import annotations

import html
import math
import re

import numpy as np

#: HTML's own element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - set("button caption dd dt head html body legend option tbody td tfoot th thead tr li summary".split())
ALIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = set("table ul ol dl td th div article section aside nav form body html blockquote main footer header".split())

#: Attribute tokens that tell what an element is for.
AWAY = set("ad ads adv advert advertisement advertising aside banner bar breadcrumb breadcrumbs bottom byline comment comments consent contact cookie cookies copyright cta disqus dialog discussion feedback footer form gdpr head header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice pager pagination paging partner popup promo promoted promotion recommend recommended related remark replies reply respond response responses reviews search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored subscribe subscription tags teaser toolbar top topbar trending warning widget widgets".split())
MAIN = set("article articlebody body blog content copy entry main page post prose story text".split())
AWAY_TAGS = set("aside button dialog fieldset footer form header label legend menu nav option select".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "parent", "depth", "tokens", "own", "link", "kids", "mark", "tags", "blocks", "hidden", "place")

    def __init__(self, tag: str, parent: int, depth: int):
        self.tag, self.parent, self.depth = tag, parent, depth
        self.tokens: set[str] = set()
        self.own = self.link = self.tags = self.blocks = self.place = 0
        self.kids: list[int] = []
        self.mark = self.hidden = False


class Page:
    """``elements`` in page order (block elements alone; inline ones count in their block), ``texts`` as (element, text)
    runs; equal neighbouring elements with no block border between them are one block."""

    def __init__(self, source: str):
        self.elements = [Element("html", -1, 0)]
        self.texts: list[tuple[int, str]] = []
        self.borders: set[int] = {0}
        self._read(source)

    def _text(self, at: int, raw: str, in_link: bool) -> None:
        if not raw:
            return
        text = html.unescape(raw)
        self.texts.append((at, text))
        if size := len("".join(text.split())):
            element = self.elements[at]
            element.own += size
            element.link += size * in_link

    def _read(self, source: str) -> None:
        stack, links, at, place, end = [0], 0, 0, 0, len(source)
        find = _MARKUP.search
        while m := find(source, place):
            self._text(at, source[place : m.start()], links > 0)
            place = m.end()
            if m[3] is None:
                self._text(at, m[1] or "", links > 0)
                continue
            tag = m[3].lower()
            if m[2]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag == "br":
                    self.texts.append((at, " "))
                elif tag in BLOCK:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.elements[stack[k]].tag == tag:
                            del stack[k:]
                            at, links = stack[-1], 0
                            break
                    self.borders.add(len(self.texts))
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, place)
                place = close.end() if close else (end if tag in ("script", "style") else place)
                continue
            if tag not in BLOCK:
                if tag == "a":
                    links += 1
                elif tag in ("br", "wbr"):
                    self.texts.append((at, " " if tag == "br" else ""))
                self.elements[at].tags += 1
                continue
            self._imply_ends(stack, tag)
            parent = stack[-1]
            element = Element(tag, parent, self.elements[parent].depth + 1)
            for name, *values in _ATTRIBUTE.findall(m[4] or ""):
                value = next((v for v in values if v), "")
                if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                    element.tokens.update(_TOKEN.findall(_CAMEL.sub(" ", value).lower()))
                elif name.lower() == "vm-mark":
                    element.mark = True
            element.hidden = bool(re.search(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", m[4] or "", re.I))
            element.place = len(self.elements[parent].kids)
            self.elements[parent].kids.append(len(self.elements))
            self.elements.append(element)
            self.borders.add(len(self.texts))
            if tag not in VOID:
                stack.append(len(self.elements) - 1)
                at = stack[-1]
        self._text(at, source[place:], links > 0)

    def _imply_ends(self, stack: list[int], tag: str) -> None:
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                name = self.elements[stack[k]].tag
                if name == "p":
                    del stack[k:]
                    break
                if name in SCOPE:
                    break
        for k in range(len(stack) - 1, 0, -1):
            name = self.elements[stack[k]].tag
            if name in ALIKE.get(tag, ()):
                del stack[k:]
                break
            if name in SCOPE - {"td", "th"}:
                break

    def features(self) -> np.ndarray:
        """One row for each element; see FEATURES."""
        elements, n = self.elements, len(self.elements)
        text, link, tags, blocks = ([0] * n for _ in range(4))
        for i in range(n - 1, -1, -1):
            e = elements[i]
            text[i] += e.own
            link[i] += e.link
            tags[i] += e.tags + 1
            blocks[i] += e.own > 0
            if e.parent >= 0:
                for total in (text, link, tags, blocks):
                    total[e.parent] += total[i]
        all_text, before, out = max(1, text[0]), 0, np.zeros((n, len(FEATURES)))
        away, main, away_tag = [0] * n, [0] * n, [0] * n
        for i, e in enumerate(elements):
            up = e.parent
            a, g, t = len(e.tokens & AWAY) + e.hidden, len(e.tokens & MAIN), e.tag in AWAY_TAGS
            away[i], main[i], away_tag[i] = (a > 0) + (away[up] if up >= 0 else 0), (g > 0 or e.tag in ("article", "main")) + (main[up] if up >= 0 else 0), t + (away_tag[up] if up >= 0 else 0)
            kids = elements[up].kids if up >= 0 else [i]
            k = e.place
            left, right = (text[kids[k - 1]] if k else 0), (text[kids[k + 1]] if k + 1 < len(kids) else 0)
            out[i] = (
                e.depth, math.log1p(text[i]), link[i] / max(1, text[i]), tags[i] / max(1, text[i]), math.log1p(blocks[i]), text[i] / max(1, blocks[i]),
                a, away[i], g, main[i], t, away_tag[i], e.tag in ("article", "main"), e.tag[:1] == "h" and e.tag[1:].isdigit(), e.tag in ("p", "pre", "blockquote"), e.tag in ("ul", "ol", "li", "dl"), e.tag in ("div", "section"),
                before / all_text, text[i] / all_text, math.log1p(left), math.log1p(right), math.log1p(len(kids)),
            )
            before += e.own
        return out

    def main_text(self, kept: np.ndarray) -> str:
        """Blocks of the kept elements, white space inside each turned into one space, joined by line ends."""
        out: list[str] = []
        run: list[str] = []
        for i, (at, text) in enumerate(self.texts):
            if i in self.borders and run:
                out.append(" ".join("".join(run).split()))
                run = []
            if kept[at]:
                run.append(text)
        if run:
            out.append(" ".join("".join(run).split()))
        return "\n".join(x for x in out if x)


FEATURES = (
    "depth", "text", "link share", "tags per character", "blocks", "text per block",
    "away tokens", "away tokens above", "main tokens", "main tokens above", "away tag", "away tags above", "article", "heading", "paragraph", "list", "division",
    "text before", "share of page", "text left", "text right", "siblings",
)


def labels(page: Page) -> np.ndarray:
    """Training labels: inside the marked element (``vm-mark``), or else inside an article or main element; never inside
    what a tag or a token says is something else."""
    marked = any(e.mark for e in page.elements)
    inside, out = np.zeros(len(page.elements), bool), np.zeros(len(page.elements), bool)
    shut = np.zeros(len(page.elements), bool)
    for i, e in enumerate(page.elements):
        up = e.parent
        begins = e.mark if marked else e.tag in ("article", "main")
        inside[i] = begins or (up >= 0 and inside[up])
        own_shut = inside[i] and not begins and (e.tag in AWAY_TAGS or bool(e.tokens & AWAY))
        shut[i] = own_shut or (up >= 0 and shut[up] and not begins)
        out[i] = inside[i] and not shut[i]
    return out
