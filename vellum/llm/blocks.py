"""Leaf blocks of a web page: text runs between block-level tags, each with its tag path.

Broken markup costs no more than sound markup: every reader here moves forwards only. A quote that nobody closes is an
ordinary character; where the quotes after a tag's start leave it open to the end of the page, quotes no longer count
from there on. Elements more than DEPTH deep hang at that depth, as in browsers.
"""

from __future__ import annotations

import html
import re

NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template title textarea select option button svg object iframe canvas head".split())
#: Elements whose content is no markup: the end tag alone ends them.
RAW = frozenset("script style textarea title".split())
#: An opening tag ends open elements of these names, up to the nearest of the second set.
CLOSES = {"li": ("li", "ul ol menu"), "p": ("p", "td th li div article section body"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: What may stand in a head; any other opening tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template head html".split())
DEPTH = 512
MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_STOP = re.compile(r"[>\"']")
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def marks(page: str):
    """(start, end, closing, name, attributes) of each tag in order; name is None for comments and declarations."""
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    quotes = True
    while m := MARK.search(page, at):
        start, head = m.start(), m.group()
        if head == "<!--" or head == "<![CDATA[":
            end = page.find("-->" if head == "<!--" else "]]>", m.end())
            at = n if end < 0 else end + 3
            yield start, at, False, None, ""
            continue
        if start > last[">"]:
            return
        if head in ("<!", "<?"):
            at = page.index(">", start) + 1
            yield start, at, False, None, ""
            continue
        closing = head[1] == "/"
        name = TAG_NAME.match(page, m.end() - 1)
        end, x = -1, name.end()
        while quotes and (stop := TAG_STOP.search(page, x)):
            q, x = stop.group(), stop.end()
            if q == ">":
                end = x
                break
            if last[q] >= x:
                x = page.index(q, x) + 1
        if end < 0:
            quotes, end = False, page.index(">", name.end()) + 1
        at = end
        yield start, end, closing, name.group().lower(), page[name.end() : end - 1]


class Block:
    __slots__ = ("text", "path", "links", "tags")

    def __init__(self, text: str, path: tuple, links: int, tags: int):
        self.text, self.path, self.links, self.tags = text, path, links, tags


def blocks(page: str) -> list[Block]:
    """The page's blocks in order; path: (tag, class and id words) of the open block-level elements, outermost first."""
    stack: list[tuple[str, tuple]] = []
    out: list[Block] = []
    parts: list[str] = []
    links = tags = link_from = size = hidden = 0
    in_link = False
    open_: dict[str, int] = {}

    def flush() -> None:
        nonlocal links, tags, size, link_from
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                if in_link:
                    links += size - link_from
                out.append(Block(text, tuple(x for x in stack if x[0] not in INLINE), links, tags))
            parts.clear()
        links = tags = size = link_from = 0

    def pop(to: int) -> None:
        nonlocal hidden
        for name, _ in stack[to:]:
            hidden -= name in HIDDEN
            open_[name] -= 1
        del stack[to:]

    at, n = 0, len(page)
    for start, end, closing, name, attributes in marks(page):
        if start < at:  # inside an element whose content is no markup
            continue
        if start > at and not hidden:
            parts.append(page[at:start])
            size += start - at
        at = end
        if name is None:
            continue
        if name == "a":
            if closing:
                links += size - link_from if in_link else 0
            else:
                link_from = size
            in_link = not closing
        if name not in INLINE:
            flush()
            if in_link:
                link_from = 0
        else:
            tags += 1
        if closing:
            if open_.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop(k)
                        break
            continue
        if open_.get("head") and name not in IN_HEAD:
            pop(next(k for k, x in enumerate(stack) if x[0] == "head"))
        if name in VOID:
            continue
        if name in ENDS_P or name in CLOSES:
            shut, bar = CLOSES.get(name, CLOSES["p"])
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    pop(k)
                    break
                if stack[k][0] in bar:
                    break
        words = tuple(w.lower() for g in NAME.findall(attributes) for w in re.split(r"[^A-Za-z]+", "".join(g)) if w)
        if attributes.rstrip().endswith("/") and name in ("svg", "path", "iframe"):
            continue
        if len(stack) >= DEPTH and name not in HIDDEN:
            continue
        stack.append((name, words))
        open_[name] = open_.get(name, 0) + 1
        hidden += name in HIDDEN
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            pop(len(stack) - 1)
    if at < n and not hidden:
        parts.append(page[at:])
        size += n - at
    flush()
    return out
