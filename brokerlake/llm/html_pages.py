"""HTML pages as text blocks with the elements around them: a forgiving scanner."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from zlib import crc32

def _tag(quoted: str) -> re.Pattern:
    """A comment, a declaration or a tag; ``[4]`` instead of ``[3]`` if a quote has no end."""
    return re.compile(
        r"<!--(?:.*?-->|.*)|<[!?][^>]*>?"
        rf"|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']*(?:{quoted})?)*+)>|([^>]*)>)",
        re.S,
    )


# a quoted attribute of any length may hold ">"; a tag with a quote without an end is read up to ">"
_TAG = _tag(r"\"[^\"]*\"|'[^']*'")
# behind such a tag quotes end before the next "<", so that no text is read once for each tag
_TAG_BROKEN = _tag(r"\"[^\"<]*\"|'[^'<]*'")
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")

#: Elements whose content is no markup, elements without content, and blocks.
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option optgroup p pre search section select summary table tbody tfoot thead tr "
    "ul video audio canvas object button svg math".split()
)
#: What an opening tag ends that is still open, up to the nearest of its bounds.
_ENDS_P = BLOCKS - {"br", "option", "optgroup", "button", "svg", "math", "object", "select", "video",
                    "audio", "canvas", "legend", "body", "head", "html"}
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("article aside blockquote body div footer form header main nav section table".split())

#: Elements and whole words of class, id or role that mark what is no main text, and
#: what is.
OFF_ELEMENTS = frozenset(
    "head nav header footer aside form button select dialog menu svg math object video audio "
    "canvas fieldset option".split()
)
OFF_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments "
    "consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices notification pagination pager popup promo "
    "related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar topbar widget widgets complementary".split()
)
#: Of these, what holds other articles than the main one where it stands behind that.
BESIDE_ELEMENTS = frozenset("nav footer aside dialog".split())
BESIDE_WORDS = frozenset("comment comments disqus related replies reply respond".split())
ON_ELEMENTS = frozenset(("article", "main"))
ON_WORDS = frozenset(("main", "article", "post-body", "entry-content", "article-body"))


@dataclass(slots=True)
class Element:
    name: str
    path: int  # of this element and all around it
    up: Element | None
    no_text: bool  # it is itself no main text
    off: bool  # it, or one around it, is no main text; final when the page is read
    on: bool  # it, or one around it, is marked as main text
    beside: bool = False  # it is no main text and may hold others' articles
    in_article: bool = False  # it, or one around it, is an article
    kept: bool = False  # it is an article or main that nothing switches off


@dataclass(slots=True)
class Block:
    text: str
    element: Element
    tag: int  # the last of the page's tags before it
    linked: int  # its characters in links, markup's white space included


_ROOT = Element("", 0, None, False, False, False)


def label(name: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's name with its class, id and role, and the whole words of these."""
    if "=" not in attributes:
        return name, frozenset()
    values = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).lower()
    # numbers in class names count pages or posts, not kinds of elements
    kind = re.sub(r"[0-9]+", "#", values)
    return f"{name}.{kind}", frozenset(values.split())


class Page:
    """``blocks``: texts in page order; ``tags``: (number of the tag, in place) in page order."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.tags: list[int] = []
        self._stack = [_ROOT]
        self._text: list[str] = []
        self._linked = 0
        self._elements: list[Element] = []
        self._article = False  # an article that is kept has begun
        self._freed = False  # an element is no longer off
        self._scan(html)
        self._break()
        if self._freed:
            for element in self._elements:  # from the outermost in
                element.off = element.no_text or element.up.off

    def _break(self) -> None:
        if self._text:
            text = "".join(self._text)
            self._text.clear()
            if text := _SPACE.sub(" ", unescape(text)).strip():
                tag = max(0, len(self.tags) - 1)
                self.blocks.append(Block(text, self._stack[-1], tag, self._linked))
        self._linked = 0

    def _add(self, text: str) -> None:
        self._text.append(text)
        if any(element.name == "a" for element in self._stack):
            self._linked += len(text)

    def _open(self, name: str, attributes: str) -> None:
        if name in _ENDS_P:
            self._end({"p"}, _SCOPE)
        if name in _SIBLINGS:
            self._end(*_SIBLINGS[name])
        kind, words = label(name, attributes)
        above = self._stack[-1]
        path = crc32(kind.encode("utf-8", "replace"), above.path)
        self.tags.append(path << 1)
        if name in VOID:
            return
        named = bool(words & OFF_WORDS) and name not in ("html", "body")
        no_text = named or name in OFF_ELEMENTS
        on = above.on or name in ON_ELEMENTS or bool(words & ON_WORDS)
        if name == "header" and above.on and not above.off:
            no_text = named  # the article's own heading
        beside = no_text and (name in BESIDE_ELEMENTS or bool(words & BESIDE_WORDS))
        in_article = above.in_article or name == "article"
        element = Element(name, path, above, no_text, above.off or no_text, on, beside, in_article)
        self._stack.append(element)
        self._elements.append(element)
        if name in ON_ELEMENTS and not above.in_article:
            self._keep(element)

    def _keep(self, element: Element) -> None:
        """Switch an article or main, and all that holds it, back on.

        Others' articles, behind one that is kept and inside of an element for such, stay off.
        """
        around = []
        for here in reversed(self._stack[1:]):
            if here.kept:  # what is around it is on
                break
            around.append(here)
        if self._article and any(here.beside for here in around):
            return
        for here in around:
            self._freed = self._freed or here.off
            here.no_text = here.off = here.beside = False
        element.kept = True
        self._article = self._article or element.name == "article"

    def _end(self, names: set[str], bounds) -> None:
        """Close the innermost open element of these names, unless a bound lies inside of it."""
        for at in range(len(self._stack) - 1, 0, -1):
            name = self._stack[at].name
            if name in names:
                self._pop(at)
                if "tr" not in names or name == "tr":
                    return
            elif name in bounds:
                return

    def _pop(self, at: int) -> None:
        for element in reversed(self._stack[at:]):
            self.tags.append(element.path << 1 | 1)
        del self._stack[at:]

    def _close(self, name: str) -> None:
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at].name == name:
                self._pop(at)
                return

    def _scan(self, html: str) -> None:
        at = 0
        # nothing beyond the last ">" is a whole tag
        search, text, limit = _TAG.search, self._text, html.rfind(">") + 1
        while found := search(html, at, limit):
            if found.start() > at:
                self._add(html[at : found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            attributes = found[3]
            if attributes is None:
                search, attributes = _TAG_BROKEN.search, found[4]
            name = name.lower()
            if name in BLOCKS:
                self._break()
            elif name in ("td", "th"):
                text.append(" ")
            if found[1]:
                self._close(name)
                continue
            if name in RAW:
                end = re.compile(rf"(?i)</{name}\b[^>]*>?").search(html, at)
                if name == "noscript" and end is None:
                    continue  # without an end it would swallow the page
                at = end.end() if end else len(html)
                path = crc32(name.encode(), self._stack[-1].path)
                self.tags += [path << 1, path << 1 | 1]
                continue
            self._open(name, attributes)
            if attributes.endswith("/") and name not in VOID and name in ("svg", "math"):
                self._close(name)
        if at < len(html):
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page ends in
            text.append(rest[: cut.start()] if cut else rest)
