"""Leaf blocks of a page: a linear scan that keeps the open elements.

A block is the text between two boundaries of block-level elements. Inline
elements do not end it, a line break is white space in it. Elements whose text
is no prose of the page (``DROPPED``) are skipped with all they hold.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of the HTML standard.
DROPPED = frozenset("script style template noscript iframe object svg math canvas select textarea title audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
#: A start tag of these closes an open element of the listed kinds, up to the nearest boundary.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody"), "option": ("option",), "body": ("head",),
}
BOUNDS = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"},
    "tfoot": {"table"}, "option": {"select"}, "body": set(),
}
P_BOUNDS = frozenset("table td th button caption html object template".split())

_SCAN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<raw>script|style|template|noscript|iframe|object|svg|math|canvas|select|textarea|title|audio|video)(?=[\s/>])(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
#: So many innermost open elements make up a block's path; texts are whole whatever the depth.
DEPTH = 48


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # names of the open elements, outermost first: tag, then class, id and role words
    linked: int  # characters of the text inside links


def _element(tag: str, attrs: str) -> tuple[str, ...]:
    names = [tag]
    if "=" in attrs or "hidden" in attrs:
        for kind, a, b, c in _NAMES.findall(attrs):
            names += [f".{w}" for w in _WORDS.split((a or b or c).lower()) if w]
        if _HIDDEN.search(attrs):
            names.append(".hidden")
    return tuple(names)


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page with text, in page order; references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[tuple[str, bool]] = []
    opened: tuple[tuple[str, ...], ...] = ()
    links = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(t) for t, in_link in parts if in_link)
                out.append(Block(text, opened, min(linked, len(text))))
            parts = []

    def close(names: tuple[str, ...], bounds) -> None:
        nonlocal links
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                links -= sum(e[0] == "a" for e in stack[at:])
                del stack[at:]
                return
            if stack[at][0] in bounds:
                return

    for m in _SCAN.finditer(page or ""):
        tag = m["tag"]
        if tag is None:
            if m["raw"] is not None:
                continue
            text = m[0]
            if text[0] != "<" or text == "<":
                if not parts and text.strip():
                    opened = tuple(stack[-DEPTH:])
                if parts or text.strip():
                    parts.append((text, links > 0))
            continue
        tag = tag.lower()
        if tag not in INLINE and tag != "br":
            flush()
        if m["end"]:
            close((tag,), ("td", "th") if tag in ("p", "b", "i", "span", "a") else ())
            continue
        if tag == "br":
            parts.append((" ", False)) if parts else None
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            close(("p",), P_BOUNDS)
            if tag in CLOSES:
                close(CLOSES[tag], BOUNDS[tag])
        if tag == "a":
            close(("a",), P_BOUNDS)
            links += 1
        stack.append(_element(tag, m["attrs"]))
    flush()
    return out
