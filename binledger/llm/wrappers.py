"""Main text of web pages by inferred site wrappers.

**Inference.** The block structure of every page is a pattern with its own repeats folded. Patterns of one host are
aligned one after the other; mismatches become optional or repeated items and groups, text slots count their
characters and whether they ever vary, and copies of one html count as one page. Pages of equal structure are added up before the shuffle; a host's
structures are dealt to ``SALTS`` streams, each aligned in constant memory, whose few results are aligned
again. So a host of any size is split, and every page counts.

**Choice.** In a host's wrapper, menus, headers, footers, sidebars, notices, adverts, forms and comments are marked by
element and by words in class, id and role; so are slots outside an article that never vary over
``CONSTANT_PAGES`` distinct pages and stand on a share of ``CONSTANT_SHARE`` of the host's. The main elements are all articles (or mains) that are not inside one another, a main that
has articles giving way to them if nothing else in it varies; else the deepest element beside which
no free text of the site varies.

**Extraction.** A page's tree is matched with its host's wrapper and gives the blocks under the main elements. A page that
lacks them all is read with a wrapper of its own.

Defined results: a null or empty html, or one without main text, gives an empty text; a url without host falls
in a host of its own; repeated rows are read one by one. White space is what ``str.split`` takes for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.llm.markup import Node, Text, fingerprint, merge, parse, pattern
from binledger.llm.words import map_slices
from binledger.session import cut

SALTS = 16
CONSTANT_PAGES, CONSTANT_SHARE = 5, 0.9
#: Hashes of pages that have copies are broadcast up to this many, and joined beyond.
BROADCAST_COPIES = 200_000
#: Wrappers are broadcast up to this many bytes in all, and joined by host beyond.
BROADCAST_BYTES = 16 << 20

#: Elements and words in class, id or role that mark what is no article.
_BOILER_TAGS = frozenset("nav footer aside form dialog menu select option search button".split())
_BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar topbar toolbar header masthead footer foot sidebar side rail aside ad ads adv advert adverts"
    " advertisement advertising adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb"
    " breadcrumbs crumbs pagination pager related recommended recommendations trending widget comment comments commentlist"
    " respondform reply replies disqus contentinfo complementary search toc tags legal copyright disclaimer form skip".split()
)
_ARTICLE_WORDS = frozenset("article main post entry story content body text page wrapper container row col".split())
_MAIN = frozenset("article main".split())


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _is_boiler(key: str, in_article: bool) -> bool:
    tag, *names = key.split(" ")
    if tag in _BOILER_TAGS or tag == "header" and not in_article:
        return True
    if tag in _MAIN or tag in ("body", "html"):
        return False
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in _BOILER_WORDS for w in words) and not any(w in _ARTICLE_WORDS for w in words):
            return True
        if words and words[0] in ("comment", "comments", "sidebar", "ad", "ads", "advert", "footer", "nav", "related", "share", "social", "cookie"):
            return True
    return False


def _least(wrapper: list) -> float:
    """On how many pages a slot must stand to be constant; copies add up to whole pages but for rounding."""
    return max(CONSTANT_PAGES, CONSTANT_SHARE * wrapper[3][2]) - 1e-6


def _free(item: list, in_article: bool, least: float) -> tuple[float, float]:
    """Characters outside links of the slots under an item that are no boilerplate: varying ones, and all."""
    if item[0] == "t":
        n, chars, link, text = item[3]
        free = max(0, chars - link)
        return (free if text is None or n < least else 0.0), float(free)
    if item[0] == "g":
        parts = [_free(i, in_article, least) for i in item[3]]
    else:
        key, items = item[3][:2]
        if _is_boiler(key, in_article):
            return 0.0, 0.0
        parts = [_free(i, in_article or key.split(" ")[0] in _MAIN, least) for i in items]
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def _elements(item: list) -> Iterator[list]:
    """The element items under an item, those in groups too."""
    for child in item[3][1] if item[0] == "e" else item[3]:
        if child[0] == "g":
            yield from _elements(child)
        elif child[0] == "e":
            yield child


def main_paths(wrapper: list) -> tuple[list[list[str]], bool]:
    """Keys from the root to each main element, and whether they are articles (else constant slots are dropped)."""
    least = _least(wrapper)

    def articles(item: list, path: list[str]) -> Iterator[tuple[list[str], list]]:
        """Outermost article and main elements with free text."""
        for child in _elements(item):
            key = child[3][0]
            if _is_boiler(key, False):
                continue
            if key.split(" ")[0] in _MAIN and _free(child, True, least)[1] > 0:
                yield [*path, key], child
            else:
                yield from articles(child, [*path, key])

    def narrowed(path: list[str], item: list) -> Iterator[list[str]]:
        """Articles inside an article or main instead of it, if nothing beside them varies."""
        inner = list(articles(item, path))
        held = sum(_free(i, True, least)[0] for _, i in inner)
        if held > 0 and held >= _free(item, True, least)[0] and not any(i[1] for _, i in inner):
            for found in inner:
                yield from narrowed(*found)
        else:
            yield path

    paths = [p for found in articles(wrapper, []) for p in narrowed(*found)]
    if paths:
        return paths, True
    path, item = [], wrapper
    while True:
        children = [c for c in _elements(item) if not _is_boiler(c[3][0], False) and c[3][0].split(" ")[0] not in ("p", "ul", "ol", "table")]
        top = max(children, key=lambda c: _free(c, False, least), default=None)
        if top is None or top[2] or not any(True for _ in _elements(top)):
            return [path], False
        held = _free(top, False, least)[0]
        if held <= 0 or held < _free(item, False, least)[0]:  # beside it stands text that varies
            return [path], False
        path.append(top[3][0])
        item = top


def _matched(node: Node, paths: list[list[str]]) -> Iterator[Node]:
    """The nodes at the ends of the paths, outermost only, in the order of the page."""
    if [] in paths:
        yield node
        return
    for child in node.children:
        if isinstance(child, Node):
            below = [p[1:] for p in paths if p[0] == child.key]
            if below:
                yield from _matched(child, below)


def _constants(wrapper: list) -> set[tuple[tuple[str, ...], str]]:
    """Slots of a site that never vary, as (keys down to the slot, fingerprint of the text)."""
    found: set = set()
    least = _least(wrapper)

    def walk(item: list, keys: tuple[str, ...], repeats: bool) -> None:
        if item[0] == "t":
            if item[3][3] is not None and item[3][0] >= least and not repeats:
                found.add((keys, item[3][3]))
        elif item[0] == "g":
            for i in item[3]:
                walk(i, keys, repeats or bool(item[2]))
        else:
            for i in item[3][1]:
                walk(i, (*keys, item[3][0]), repeats or bool(item[2]))

    walk(wrapper, (), False)
    return found


def extract(tree: Node, wrapper: list) -> str | None:
    """The blocks of the main elements, one a line; None if the page has no such element."""
    paths, article = main_paths(wrapper)
    nodes = list(_matched(tree, paths))
    if not nodes:
        return None
    constants = set() if article else _constants(wrapper)
    blocks: list[str] = []

    def walk(node: Node, keys: tuple[str, ...]) -> None:
        for child in node.children:
            if isinstance(child, Text):
                if not constants or (keys, fingerprint(child.text)) not in constants:
                    blocks.append(child.text)
            elif not _is_boiler(child.key, article):
                walk(child, (*keys, child.key))

    for node in nodes:
        walk(node, ("#", *(() if article else paths[0])))
    return "\n".join(blocks)


def _added(found: dict[tuple[str, str], list], host: str, made: list) -> None:
    key = (host, json.dumps(_outline(made)))
    found[key] = merge(found[key], made) if key in found else made


def _outline(item: list):
    if item[0] == "t":
        return "t"
    return [item[0], item[1], item[2], [_outline(i) for i in item[3]]] if item[0] == "g" else [item[1], item[2], item[3][0], [_outline(i) for i in item[3][1]]]


def structures(pages: DataFrame) -> DataFrame:
    """``host, outline, wrapper``: the pages of every slice, added up where host and structure agree."""

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, str], list] = {}
        for host, source, copies in zip(*(piece.column(c).to_pylist() for c in ("host", "html", "copies"))):
            _added(found, host, pattern(parse(source), 1 / copies if copies else 1))
        return pa.RecordBatch.from_pydict({
            "host": pa.array([h for h, _ in found], pa.string()),
            "outline": pa.array([o for _, o in found], pa.string()),
            "wrapper": pa.array([json.dumps(w) for w in found.values()], pa.string()),
        })

    rows = pages.select(host_of().alias("host"), "html").where("html <> ''")
    key = [F.xxhash64("host", "html").alias("h"), F.octet_length("html").alias("n")]
    copied = cut(rows.select(*key).groupBy("h", "n").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    rows = rows.select("*", *key)
    rows = rows.join(F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied, ["h", "n"], "left")
    return map_slices(rows.select("host", "html", "copies"), "html", work, "host string, outline string, wrapper string", 8 << 20)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of rows of one host and salt; holds one wrapper at a time."""
    last, wrapper = None, None

    def told():
        return pa.RecordBatch.from_pydict({"host": [last[0]], "salt": pa.array([last[1]], pa.int64()), "wrapper": [json.dumps(wrapper)]})

    for batch in batches:
        for host, salt, made in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper"))):
            if (host, salt) != last:
                if last is not None:
                    yield told()
                last, wrapper = (host, salt), json.loads(made)
            else:
                wrapper = merge(wrapper, json.loads(made))
    if last is not None:
        yield told()


def wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper for every host, written."""
    schema = "host string, salt long, wrapper string"
    parts = structures(pages).withColumn("salt", F.pmod(F.xxhash64("outline"), F.lit(SALTS)))
    parts = parts.repartition("host", "salt").sortWithinPartitions("host", "salt", "outline", "wrapper")
    parts = parts.select("host", "salt", "wrapper").mapInArrow(_aligned, schema)
    whole = parts.select("host", F.col("salt").alias("part"), "wrapper", F.lit(0).cast("long").alias("salt"))
    whole = whole.repartition("host").sortWithinPartitions("host", "part")
    return cut(whole.select("host", "salt", "wrapper").mapInArrow(_aligned, schema).select("host", "wrapper"), "wrappers")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    found = wrappers(pages)
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    last: dict[str, tuple] = {}

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for source, wrapper in zip(piece.column("html").to_pylist(), piece.column("wrapper").to_pylist()):
            tree, text = parse(source), None
            if wrapper is not None:
                if wrapper not in last:
                    if len(last) > 64:
                        last.clear()
                    last[wrapper] = json.loads(wrapper)
                text = extract(tree, last[wrapper])
            if text is None:
                text = extract(tree, pattern(tree))
            texts.append(text or "")
        return pa.RecordBatch.from_pydict({
            "page_id": piece.column("page_id"), "url": piece.column("url"),
            "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        })

    return map_slices(rows.select("page_id", "url", "html", "wrapper"), "html", work, "page_id long, url string, text string, n_chars long")
