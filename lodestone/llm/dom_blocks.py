"""HTML to leaf blocks: runs of text between block-level tags, with the tags above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)|<[!?/][^>]*+(?:>|\Z)", re.S)
#: One attribute of a tag: up to the end of its name, of its unquoted value, or to behind the quote that opens its value.
_ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*+=?[^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:(?P<quote>[\"'])|[^ \t\n\f\r>]*+))?")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Fixed sets of element names, by how HTML treats them.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced mpadded mphantom semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title".split())
FOREIGN = set("svg math".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div td th body".split())


@dataclass
class Block:
    text: str
    #: Above it, outermost first: (tag, words of its class, id and role).
    above: tuple
    link_chars: int


def _end_of_raw(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[ \t\n\f\r/>]|\Z)[^>]*>?", re.I).search(page, at)
    return m.end() if m else len(page)


class _Tags:
    """Where the tags of a page end; a quote is looked for at most once from a place without one."""

    def __init__(self, page: str):
        self.page = page
        self.none_from = {'"': len(page) + 1, "'": len(page) + 1}
        #: Places between attributes from which a quoted value that never ends is met.
        self.lost: set[int] = set()

    def end(self, start: int) -> int:
        """The end of the tag whose name ends at ``start``: behind its '>' outside quoted values, or the page's end.

        A quote opens a value only after '='. A tag with a value that never ends is over at its first '>'.
        """
        page, at, seen = self.page, start, []
        while at not in self.lost:
            seen.append(at)
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if quote := m["quote"]:
                close = page.find(quote, at) if at < self.none_from[quote] else -1
                if close < 0:
                    self.none_from[quote] = min(at, self.none_from[quote])
                    break
                at = close + 1
            elif at == len(page):
                return at
            elif page[at] == ">":
                return at + 1
        self.lost.update(seen)
        return page.find(">", start) + 1 or len(page)


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks in page order; texts have references decoded, white space folded, ends trimmed.

    Scripts, styles and titles give none; all other content does, whatever its element. References
    are decoded within each stretch of text, not over tags. Broken markup is read as far as it
    goes: an element that is never closed ends with the page, and '/>' closes no script, style or
    title outside drawings and formulas.
    """
    blocks: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), linked))
        parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[i:])
        del stack[i:]

    page = page or ""
    tags = _Tags(page)
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(html.unescape(text))
            linked += len(parts[-1]) if links else 0
        if not m:
            break
        at = m.end()
        if m["tag"] is None:
            continue
        at = tags.end(m.end())
        rest = page[m.end() : at]
        tag = m["tag"].lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img"):
            parts.append(" ")
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if tag in RAW:
            if not (rest.endswith("/>") and any(x[0] in FOREIGN for x in stack)):
                at = _end_of_raw(page, tag, at)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag in SAME_ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_ENDS[tag]:
                    pop_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        if tag not in VOID and not (rest.endswith("/>") and (tag in FOREIGN or any(x[0] in FOREIGN for x in stack))):
            named = " ".join("".join(x) for x in _NAMED.findall(rest)) if "=" in rest else ""
            stack.append((tag, tuple(_WORD.findall(named.lower()))))
            links += tag == "a"
    flush()
    return blocks
