"""HTML cut into its leaf blocks, in one pass over the page.

A block is the text between two boundaries of block-level elements; inline markup is
taken out of it, character references are decoded, and white space becomes one space. Pages
need not be well formed: tags that HTML lets one leave out are closed as its rules say,
end tags without a start are passed over, and what cannot be a tag is text. The time is
linear in the page.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html import unescape

#: Fixed values of HTML: elements without an end tag; whose content is no markup; and those that flow within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr picture source map area br".split())
#: What is not shown, or is no text: nothing inside is a block.
HIDDEN = frozenset("head template select svg math object canvas audio video datalist".split())
#: A start tag of these closes an open p; of a key, the open elements named, up to a boundary.
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt summary".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_BOUNDS = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
_TABLE = frozenset(("table",))

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Rows of the table of tag-path features.
PATH_ROWS = 4096


@lru_cache(maxsize=1 << 14)
def features(name: str, rest: str) -> tuple[int, ...]:
    """Hashed features of a start tag: its name, and the words of class, id, role and itemprop."""
    words = [name]
    for attr, a, b, c in _ATTR.findall(rest):
        words += [f"{'role' if attr.lower() == 'role' else '.'}{p.lower()}" for p in _PART.findall(a or b or c)]
    return tuple(zlib.crc32(w.encode()) % PATH_ROWS for w in dict.fromkeys(words))


class Page:
    """Blocks of a page, and the elements above them: an element's number is its place in `parents`."""

    def __init__(self, html: str):
        self.parents: list[int] = [-1]
        self.own: list[tuple[int, ...]] = [features("html", "")]
        self.texts: list[str] = []  # of blocks
        self.at: list[int] = []  # the element that holds a block
        self.linked: list[int] = []  # code points of a block that are within links
        self._open: list[tuple[str, int]] = [("", 0)]
        self._count: dict[str, int] = {}
        self._held: list[str] = []
        self._held_at = self._link = self._hidden = 0
        self._read(html)
        self._end_block()

    def _end_block(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                self.texts.append(text)
                self.at.append(self._held_at)
                self.linked.append(min(self._link, len(text)))
            self._held, self._link = [], 0

    def _text(self, text: str) -> None:
        if self._hidden or not text:
            return
        if not self._held:
            if text.isspace():
                return
            self._held_at = self._open[-1][1]
        text = unescape(text) if "&" in text else text
        self._held.append(text)
        if self._count.get("a"):
            self._link += len(text.strip())

    def _pop(self) -> None:
        name, _ = self._open.pop()
        self._count[name] -= 1
        if name in HIDDEN:
            self._hidden -= 1

    def _close_implied(self, name: str) -> None:
        if name in _CLOSES_P and self._count.get("p"):
            k = len(self._open) - 1
            while k > 0 and self._open[k][0] in INLINE:
                k -= 1
            if k > 0 and self._open[k][0] == "p":
                while len(self._open) > k:
                    self._pop()
        closes = _CLOSES.get(name)
        if closes and any(self._count.get(c) for c in closes):
            bounds = _BOUNDS.get(name, _TABLE)
            low, k = 0, len(self._open) - 1
            while k > 0 and self._open[k][0] not in bounds and (name in ("li", "dt", "dd") or self._open[k][0] in closes or self._open[k][0] in INLINE or self._open[k][0] in ("p", "div", "ul", "ol")):
                if self._open[k][0] in closes:
                    low = k
                    if name in ("li", "dt", "dd"):
                        break
                elif name in ("li", "dt", "dd") and self._open[k][0] not in INLINE and self._open[k][0] not in ("p", "div", "address"):
                    break
                k -= 1
            while low and len(self._open) > low:
                self._pop()

    def _start(self, name: str, rest: str) -> None:
        if name not in INLINE:
            self._end_block()
            self._close_implied(name)
        elif name == "br":
            if self._held:
                self._held.append(" ")
            return
        elif name == "a" and self._count.get("a"):
            self._finish("a")
        if name in VOID:
            return
        self.parents.append(self._open[-1][1])
        self.own.append(features(name, rest))
        self._open.append((name, len(self.parents) - 1))
        self._count[name] = self._count.get(name, 0) + 1
        if name in HIDDEN:
            self._hidden += 1

    def _finish(self, name: str) -> None:
        if name not in INLINE:
            self._end_block()
        if not self._count.get(name):
            return
        k = len(self._open) - 1
        while self._open[k][0] != name:
            if name in INLINE and self._open[k][0] not in INLINE:
                return  # it was opened outside of this block
            k -= 1
        while len(self._open) > k:
            self._pop()

    def _read(self, html: str) -> None:
        at, strict, ends = 0, True, True
        while at < len(html):
            tag = html.find("<", at)
            if tag < 0:
                self._text(html[at:])
                return
            if tag > at:
                self._text(html[at:tag])
            named = _NAME.match(html, tag)
            if named is None:
                if html.startswith("<!--", tag):
                    stop = html.find("-->", tag + 2)
                    at = stop + 3 if stop >= 0 else len(html)
                elif html.startswith(("<!", "<?", "</"), tag):
                    stop = html.find(">", tag)
                    at = stop + 1 if stop >= 0 else len(html)
                else:
                    self._text("<")
                    at = tag + 1
                continue
            rest = _REST.match(html, named.end()) if strict else None
            if rest is None and strict:
                strict = False  # a quotation mark without its like: from here on the first > ends a tag
            stop = rest.end() if rest else (html.find(">", named.end()) + 1 if ends else 0)
            if not stop:
                ends = False
                self._text(html[tag : named.end()])
                at = named.end()
                continue
            name, inner = named[2].lower(), html[named.end() : stop - 1]
            at = stop
            if named[1]:
                self._finish(name)
                continue
            if name in RAW:
                if name not in ("script", "style"):  # these two may stand within a line
                    self._end_block()
                close = _closer(name).search(html, at)
                at = close.end() if close else len(html)
                continue
            self._start(name, inner)
            if inner.endswith("/") and name in ("svg", "math", "path", "circle", "rect", "g", "use"):
                self._finish(name)


@lru_cache(maxsize=64)
def _closer(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I)
