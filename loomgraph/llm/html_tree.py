"""Lenient HTML reading: a page as a flat list of events with the parents of its elements.

Nothing recurses, so nesting may be as deep as it likes; unclosed, misnested and cut-off markup is read
as browsers do in the usual cases (implied ends of p, li, dt, dd, table parts and options).
"""

from __future__ import annotations

import html
import re

# a quote opens a value only right after =, anywhere else it is a character like others; a value that is not closed ends with the tag
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Attributes whose value says what an element is.
_NAMING = frozenset("class id role itemprop".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a block of text.
BLOCK = HEADINGS | frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - frozenset("html body dd dt li option tbody td tfoot th thead tr select legend".split()) | {"p"}
#: A start of the first ends an open one of the second, but not beyond the third.
_LIST, _TABLE = frozenset({"ul", "ol", "menu", "dir"}), frozenset({"table"})
_SIBLINGS = {
    "li": (frozenset({"li"}), _LIST),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "tr": (frozenset({"tr"}), _TABLE),
    "td": (frozenset({"td", "th"}), _TABLE | {"tr"}),
    "th": (frozenset({"td", "th"}), _TABLE | {"tr"}),
    "tbody": (frozenset({"tbody", "thead", "tfoot"}), _TABLE),
    "tfoot": (frozenset({"tbody", "thead"}), _TABLE),
}
_P_SCOPE = frozenset({"table", "td", "th", "caption", "button", "object", "template"})


def _names(attributes: str) -> tuple[frozenset[str], ...]:
    """The words of each name an element has, once per attribute; with-sidebar and the like say what stands beside it."""
    out: list[frozenset[str]] = []
    seen: set[str] = set()
    for key, double, single, bare in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in _NAMING and key not in seen:  # of an attribute given twice the first holds
            seen.add(key)
            for name in (double or single or bare).split():
                words = frozenset(w.lower() for w in _WORD.findall(name))
                if words and not words & {"with", "without", "has", "no", "not"}:
                    out.append(words)
    return tuple(out)


class Page:
    """events: text (str, references decoded), i for the start and ~i for the end of element i, in page order.
    tags, parents (-1 at the top), and names (the words of each name in class, id, role and itemprop) of the elements."""

    __slots__ = ("events", "tags", "parents", "names")

    def __init__(self, source: str):
        self.events: list = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.names: list[tuple[frozenset[str], ...]] = []
        self._read(source)

    def _read(self, s: str) -> None:
        events, tags, parents, names = self.events, self.tags, self.parents, self.names
        stack: list[int] = []
        opened: dict[str, int] = {}

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                i = stack.pop()
                opened[tags[i]] -= 1
                events.append(~i)

        def close(wanted: frozenset[str], limit: frozenset[str]) -> None:
            for d in range(len(stack) - 1, -1, -1):
                t = tags[stack[d]]
                if t in wanted:
                    pop_to(d)
                    return
                if t in limit:
                    return

        at, n = 0, len(s)
        while at < n:
            m = _TAG.search(s, at)
            begin = m.start() if m else n
            if begin > at:
                text = s[at:begin]
                events.append(html.unescape(text) if "&" in text else text)
            if not m:
                break
            at = m.end()
            slash, tag, rest = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                if not opened.get(tag):
                    continue
                block = tag in BLOCK
                for d in range(len(stack) - 1, -1, -1):
                    t = tags[stack[d]]
                    if t == tag:
                        pop_to(d)
                        break
                    if not block and t in BLOCK:
                        break
                continue
            if opened.get("p") and tag in _CLOSES_P:
                close(frozenset({"p"}), _P_SCOPE)
            if tag in _SIBLINGS:
                wanted, limit = _SIBLINGS[tag]
                if any(opened.get(t) for t in wanted):
                    close(wanted, limit)
            i = len(tags)
            tags.append(tag)
            parents.append(stack[-1] if stack else -1)
            names.append(_names(rest) if rest and "=" in rest else ())
            events.append(i)
            if tag in VOID:
                events.append(~i)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(s, at)
                at = end.start() if end else n
                events.append(~i)
                if end:
                    at = s.find(">", at) + 1 or n
            else:
                stack.append(i)
                opened[tag] = opened.get(tag, 0) + 1
        pop_to(0)
