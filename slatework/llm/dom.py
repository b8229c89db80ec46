"""Leaf blocks of a web page: runs of text between block boundaries, with the elements above them.

A tolerant reader in one pass, whose time is linear in the page: unclosed paragraphs and list items end where the next
begins, stray end tags are passed over, a page that is cut off keeps what is there. Comments, scripts, styles, titles and
form fields give no blocks. White space in a block becomes one space; character references are decoded.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of HTML: elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is text up to their end tag, and no part of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that hold nothing a reader reads as text.
HIDDEN = frozenset("template noscript svg math canvas video audio object map select button datalist".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that ends when one of these begins.
ENDS = {"body": ("head",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
#: Where the search for such an element stops.
SCOPES = frozenset("ul ol dl menu table".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(eq=False)
class Element:
    """An open element: its tag, the words of its class, id and role, and the one above it."""

    tag: str
    names: tuple[str, ...]
    above: Element | None
    hidden: bool = False
    depth: int = 0
    #: What users of the tree compute once per element.
    held: object = field(default=None, repr=False)


@dataclass
class Block:
    """A run of text, the element it stands in, and how many of its characters are in links."""

    text: str
    element: Element
    linked: int


def words_of(names: str) -> list[str]:
    """The lower-case words in a class or id, at marks and capitals."""
    return [w.lower() for w in _WORD.findall(names)]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; null and empty pages have none."""
    page = page or ""
    top = Element("", (), None)
    here, open_tags, out = top, {}, []
    said: list[str] = []  # pieces of the block that is being read
    linked, link_depth = 0, -1

    def flush() -> None:
        nonlocal linked
        if said:
            text = " ".join(html.unescape("".join(said)).split())
            if text:
                out.append(Block(text, here, min(linked, len(text))))
            said.clear()
        linked = 0

    def close(to: Element) -> None:
        """Ends all elements up to and with ``to``."""
        nonlocal here, link_depth
        while True:
            done, here = here, here.above
            open_tags[done.tag] -= 1
            if done is to:
                break
        if link_depth > here.depth:
            link_depth = -1

    at, end, strict = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at and not here.hidden:
            piece = page[at:start]
            said.append(piece)
            linked += len(piece) if link_depth >= 0 else 0
        if start == end:
            break
        if page.startswith("<!--", start):
            close_at = page.find("-->", start + 4)
            if page.startswith(("<!-->", "<!--->"), start):
                close_at = page.find(">", start) - 2
            at = end if close_at < 0 else close_at + 3
            continue
        found = (_TAG if strict else _PLAIN_TAG).match(page, start)
        if found is None:
            following = page[start + 1 : start + 3]
            if not (following[:1] in ("!", "?", "/") or following[:1].isascii() and following[:1].isalpha()):
                if not here.hidden:
                    said.append("<")
                at = start + 1
                continue
            if strict and following.lstrip("/")[:1].isalpha():
                at, strict = start, False  # a quote that never ends; from here on tags end at the next mark
                continue
            close_at = page.find(">", start)
            at = end if close_at < 0 else close_at + 1
            continue
        at = found.end()
        tag, attributes = found[2].lower(), found[3]
        if found[1]:
            if tag == "a":
                link_depth = -1
            if tag in BLOCKS:
                flush()
            if open_tags.get(tag):
                to = here
                while to.tag != tag:
                    to = to.above
                flush()
                close(to)
            continue
        if tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if over is None:
                break
            at = over.start()
            close_at = page.find(">", at)
            at = end if close_at < 0 else close_at + 1
            continue
        if tag == "a":
            link_depth = here.depth + 1 if "href" in attributes.lower() else -1
            continue
        if tag == "br" or tag == "wbr":
            said.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            if open_tags.get("p"):
                to = here
                while to.tag != "p" and to.tag not in ("td", "th", "li", "dd", "blockquote", "div", "section", "article"):
                    to = to.above
                if to.tag == "p":
                    close(to)
            if tag in ENDS and any(open_tags.get(t) for t in ENDS[tag]):
                to, last = here, None
                while to.tag and to.tag not in SCOPES:
                    if to.tag in ENDS[tag]:
                        last = to
                    to = to.above
                if last is not None:
                    close(last)
        if tag in VOID or tag not in BLOCKS and tag not in HIDDEN:
            continue
        if not here.hidden and tag in HIDDEN:
            flush()
        names = tuple(dict.fromkeys(w for m in _NAMES.finditer(attributes) for w in words_of(m[1] or m[2] or m[3] or ""))) if "=" in attributes else ()
        hidden = here.hidden or tag in HIDDEN or bool(attributes and _UNSEEN.search(attributes))
        if attributes.endswith("/") and tag in HIDDEN:
            continue
        here = Element(tag, names, here, hidden, here.depth + 1)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out

