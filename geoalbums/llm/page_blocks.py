"""Pages as sequences of blocks: the text of every leaf with the path of tags above it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: What begins or ends a block. Other tags are part of running text.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option"
    " p pre section select summary table tbody td tfoot th thead title tr ul textarea".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset(("br", "img", "input", "wbr"))
#: A start tag ends these open elements, up to the nearest container.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTAINER = frozenset(("ul", "ol", "dl", "table", "select", "menu"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>?"
    r"|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: What goes with its content, up to its end tag. Without one, scripts and styles go up to the page's end, of others the tag.
_DROPPED = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "template", "noscript", "svg", "iframe")}
_TO_THE_END = frozenset(("script", "style"))
#: Inside an svg (outside of foreignObject) these start tags say that it was never closed, as in browsers.
_NOT_SVG = re.compile(
    r"<(?P<foreign>foreignobject)\b"
    r"|<(?:article|aside|blockquote|body|center|d[dlt]|div|em|h[1-6]|head|header|hr|img|li|main|meta|nav|ol|p|pre|section|span|strong|table|ul)(?=[\s/>])",
    re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    path: tuple[str, ...]  # tags, and names of classes, ids and roles after a dot, outermost first
    text: str
    linked: int  # characters inside links


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return (tag,)
    found = [a or b or c for a, b, c in _NAMED.findall(attrs)]
    return (tag, *("." + part for value in found for part in _PARTS.findall(value.lower())))


def _after(page: str, tag: str, low: int, high: int, end_tags: dict[str, re.Match | None]) -> int:
    """Where the page goes on after a dropped element, whose tag's name ends at low and whose start
    tag ends at high. `end_tags` keeps the end tag last found, so that none is sought twice."""
    end = end_tags.get(tag)
    if tag not in end_tags or end is not None and end.start() < low:
        end = end_tags[tag] = _DROPPED[tag].search(page, low)
    if end is None:
        return len(page) if tag in _TO_THE_END else high
    if tag == "svg":
        other = _NOT_SVG.search(page, high, max(high, end.start()))
        if other is not None and not other["foreign"]:
            return high
    return end.end()


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order; scripts, styles, comments and markup are gone.

    Character references are decoded, white space is one space, ends are trimmed.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked = 0
    in_link = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            path = tuple(dict.fromkeys(name for tag, names in stack for name in names))
            out.append(Block(path, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    at_char = 0
    end_tags: dict[str, re.Match | None] = {}
    while at_char < len(page):
        token = _TOKEN.match(page, at_char)
        at_char = token.end()
        text = token["text"]
        if text is not None:
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag, attrs = tag.lower(), token["attrs"]
        if tag in _DROPPED and not token["close"] and (not attrs or attrs[0].isspace() or attrs[0] == "/"):
            if tag != "svg" or not attrs.endswith("/"):
                at_char = _after(page, tag, token.end("tag"), at_char, end_tags)
            continue
        if tag in _SPACE:
            pieces.append(" ")
        elif tag in _BLOCK:
            close_block()
        if tag in _VOID:
            continue
        if token["close"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                in_link -= sum(name == "a" for name, _ in stack[at:])
                del stack[at:]
            continue
        ends = _ENDS.get(tag, ("p",) if tag in _BLOCK else ())
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in ends:
                in_link -= sum(name == "a" for name, _ in stack[at:])
                del stack[at:]
                break
            if stack[at][0] in _CONTAINER or (ends == ("p",) and stack[at][0] in _BLOCK):
                break
        if attrs.endswith("/") and tag not in _BLOCK:
            continue
        stack.append((tag, _names(tag, attrs)))
        in_link += tag == "a"
    close_block()
    return out
