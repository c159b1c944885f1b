"""HTML as a tree of blocks with text slots, and union-free patterns over such trees.

A page becomes nodes ``(key, children)`` of block elements; text between block borders is a slot
``Text``. Inline elements leave only their text (that of links is counted apart); scripts, styles,
comments and the head leave nothing. Missing and stray end tags are mended as browsers do. Elements nested deeper than
``MAX_DEPTH`` leave their text to the deepest one kept, in order.

A *pattern* is a tree of items. Each item says whether it is optional and whether it repeats, and is an element
(key and items), a group of items, or a text slot with counts. ``merge`` aligns two patterns
in order: what only one of them has becomes optional, what stands several times in a row becomes one
repeated item or group, and slots add up. No alternatives arise (union-free).
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<", re.S
)
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td"
    " tfoot th thead tr ul".split()
)
DROPPED = frozenset("script style noscript template title iframe object svg textarea canvas audio video".split())
_IN_HEAD = frozenset("base basefont bgsound link meta html head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: An opening key closes these open elements, up to the nearest element of the third column.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_IN_P = frozenset("button dd dt li td th tr tbody thead tfoot caption body html option".split())


#: Trees are no deeper; all walks over them are recursive.
MAX_DEPTH = 200


@dataclass
class Text:
    text: str
    link: int  # characters of it inside links


@dataclass
class Node:
    tag: str
    key: str  # tag and the names in class, id and role
    children: list = field(default_factory=list)


def _key(tag: str, attributes: str) -> str:
    names = [re.sub(r"\d+", "0", n.lower()) for m in _NAME.finditer(attributes) for n in next((g for g in m.groups() if g), "").split()]
    return " ".join([tag, *dict.fromkeys(names)])


def parse(source: str) -> Node:
    """The tree of a page. Never fails: any text has a tree."""
    root = Node("#", "#")
    stack, buffer, links, in_link, skip, in_head = [root], [], 0, 0, None, False
    open_tags: dict[str, int] = {}

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            stack[min(len(stack), MAX_DEPTH) - 1].children.append(Text(text, links))
        buffer.clear()
        links = 0

    def close(upto: int) -> None:
        flush()
        for node in stack[upto:]:
            open_tags[node.tag] -= 1
        del stack[upto:]

    at, lowered = 0, None
    while m := _TOKEN.match(source, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            text = m[0]
            if skip is None and not (text.startswith(("<!", "<?"))) and not (in_head and text.isspace()):
                in_head = False
                buffer.append(text)
                links += in_link * len(text)
            continue
        end = bool(m[1] or m[4])
        empty = tag == "svg" and m[0].endswith("/>")
        if skip is not None:  # inside a dropped element
            if tag == skip[0] and not empty:
                skip = (tag, skip[1] + (-1 if end else 1))
                if skip[1] == 0:
                    skip = None
            continue
        if tag == "head":
            in_head = not end
        elif in_head and not end and tag not in _IN_HEAD and tag not in DROPPED:
            in_head = False  # the first element that can't stand in a head ends it
        if tag in DROPPED:
            if not end and not empty:
                if tag in RAW:  # what follows is no markup up to the end tag
                    lowered = source.lower() if lowered is None else lowered
                    stop = lowered.find(f"</{tag}", at)
                    at = len(source) if stop < 0 else stop
                skip = (tag, 1)
            continue
        if tag == "a":
            in_link = 0 if end else 1
        if tag not in BLOCKS:
            if tag == "br" or tag in ("img", "input", "wbr"):
                buffer.append(" " if tag == "br" else "")
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1) if open_tags.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                flush()
            continue
        flush()
        if tag not in _IN_P:  # any other block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table", "li", "div", "section", "article", "blockquote"):
                    break
        closes, limit = _CLOSES.get(tag, ((), ()))
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in closes:
                    close(i)
                    break
        node = Node(tag, _key(tag, m[3] or m[6] or ""))
        if len(stack) < MAX_DEPTH:
            stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return root


# A pattern item is a list: [kind, optional, repeats, body]; kinds are "e" (element: [key, items]), "g" (group: items) and
# "t" (text slot: [pages, characters, link characters, fingerprint of the text or None if it varies]). The body of the root
# has the number of pages besides.


def fingerprint(text: str) -> str:
    """Length and hash of a whole text."""
    return f"{len(text)}:{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def pattern(node: Node, weight: float = 1) -> list:
    """The pattern of one page's tree, its own repeats folded; the page counts as ``weight`` pages."""
    items = []
    for child in node.children:
        if isinstance(child, Text):
            items.append(["t", 0, 0, [weight, len(child.text), child.link, fingerprint(child.text)]])
        else:
            items.append(pattern(child, weight))
    return ["e", 0, 0, [node.key, fold(items), *([weight] if node.key == "#" else [])]]


def shape(item: list) -> str:
    """What two items must share to be aligned."""
    if item[0] == "t":
        return "t"
    return "e" + item[3][0] if item[0] == "e" else "g" + "|".join(shape(i) for i in item[3])


def _joined(a: list, b: list) -> list:
    """One item for two that stand for the same thing."""
    kind, optional, repeats = a[0], a[1] | b[1], a[2] | b[2]
    if kind == "t":
        (n, c, l, t), (m, d, k, u) = a[3], b[3]
        body = [n + m, c + d, l + k, t if t == u else None]
    elif kind == "g":
        body = [_joined(x, y) for x, y in zip(a[3], b[3])]
    else:
        body = [a[3][0], align(a[3][1], b[3][1]), *(n + m for n, m in zip(a[3][2:], b[3][2:]))]
    return [kind, optional, repeats, body]


def _repeated(a: list, b: list) -> list:
    made = _joined(a, b)
    made[2] = 1
    return made


LONGEST_GROUP = 4


def fold(items: list) -> list:
    """Fold neighbours of one shape into a repeated item, and runs of up to four shapes that recur into a repeated group."""
    out: list = []
    for item in items:
        if out and shape(out[-1]) == shape(item) and item[0] != "t":
            out[-1] = _repeated(out[-1], item)
        else:
            out.append(item)
    for size in range(2, LONGEST_GROUP + 1):
        i, done = 0, []
        shapes = [shape(x) for x in out]
        while i < len(out):
            n = 1
            while shapes[i : i + size] == shapes[i + n * size : i + (n + 1) * size] and len(shapes[i : i + size]) == size and len(set(shapes[i : i + size])) > 1:
                n += 1
            if n > 1:
                group = ["g", 0, 1, out[i : i + size]]
                for k in range(1, n):
                    group = _repeated(group, ["g", 0, 1, out[i + k * size : i + (k + 1) * size]])
                done.append(group)
                i += n * size
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def align(a: list, b: list) -> list:
    """One list of items for two: a longest common subsequence of shapes is joined, the rest is optional."""
    x, y = [shape(i) for i in a], [shape(i) for i in b]
    if x == y:
        return [_joined(p, q) for p, q in zip(a, b)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0

    def alone(item: list) -> None:
        out.append([item[0], 1, item[2], item[3]])

    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append(_joined(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            alone(a[i])
            i += 1
        else:
            alone(b[j])
            j += 1
    for item in a[i:] + b[j:]:
        alone(item)
    return fold(out)


def merge(a: list, b: list) -> list:
    """The pattern of two pages or sets of pages of one site."""
    return _joined(a, b)
