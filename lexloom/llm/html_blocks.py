"""Text blocks of an HTML page, with the tags above each; no model here."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that break a line of text into blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content, and elements whose content isn't text of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style template noscript svg math iframe object textarea canvas audio video"
#: What an opening tag closes, if it is still open.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "body": ("head",)}
CLOSES_P = BLOCK_TAGS - frozenset("body button caption dd dt head html label legend option optgroup select td th tr tbody thead tfoot title".split())
#: An open `p` or `li` is looked for up to the next of these.
FENCES = frozenset("table td th div section article ul ol dl body html form aside nav".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN.split())})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-z][^\s/>]*)([^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters within links


@dataclass(slots=True)
class _Open:
    tag: str
    marks: tuple[str, ...]


_marks: dict[tuple[str, str], tuple[str, ...]] = {}


def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What tells an element: its tag, and the words of its class, id and role."""
    key = (tag, attributes if "=" in attributes else "")
    got = _marks.get(key)
    if got is None:
        if len(_marks) > 20_000:
            _marks.clear()
        got = [f"t:{tag}"]
        for m in NAMED.finditer(key[1]):
            got += [f"c:{w.lower()}" for w in PARTS.findall(m[2] or m[3] or m[4] or "")]
        _marks[key] = got = tuple(dict.fromkeys(got))
    return got


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: text between the borders of block elements, references decoded, white space made one space.

    Inline tags part nothing, `br` is white space.  Elements that a page leaves open are closed as browsers do
    for paragraphs, list items, cells and options; an end without a start is passed over.  A block's path has each
    mark of the elements around it once, outermost first, and then what holds it itself (`l:`).
    """
    out: list[Block] = []
    stack: list[_Open] = []
    above: dict[str, int] = {}  # how often each mark is open
    parts: list[str] = []
    links = linked = at = 0

    def end_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = next((o.tag for o in reversed(stack) if o.tag in BLOCK_TAGS), "")
                out.append(Block(text, (*above, f"l:{own}"), linked))
            parts, linked = [], 0

    def pop_to(i: int):
        nonlocal links
        for o in stack[i:]:
            links -= o.tag == "a"
            for m in o.marks:
                above[m] -= 1
                if not above[m]:
                    del above[m]
        del stack[i:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end_block()
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None) if f"t:{tag}" in above else None
            if i is not None:
                pop_to(i)
            continue
        shut = ("p", *CLOSES.get(tag, ())) if tag in CLOSES_P else CLOSES.get(tag, ())
        if shut and any(f"t:{s}" in above for s in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in shut:
                    pop_to(i)
                    break
                if stack[i].tag in FENCES:
                    break
        if tag not in VOID_TAGS and not attributes.endswith("/"):
            own = marks(tag, attributes)
            stack.append(_Open(tag, own))
            links += tag == "a"
            for x in own:
                above[x] = above.get(x, 0) + 1
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * (links > 0)
    end_block()
    return out
