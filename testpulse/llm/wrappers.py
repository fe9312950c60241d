"""HTML extraction by wrappers: union-free regular expressions inferred by host.

A page is a tree of elements and text.  A wrapper is a pattern over such trees, without
alternatives: a sequence of elements, text slots and repeated groups, any of them
optional.  It is inferred by aligning pages (and wrappers) of one host two by two:

* equal elements in a row, and rows of up to ``PERIOD`` elements that repeat, are folded
  into one repeated group;
* two sequences are aligned by their longest common subsequence of labels (tag, classes
  and id); what is in both is aligned inside, what is in one only becomes optional;
* texts that differ become a slot, texts that are equal stay template text.

Every pattern counts the pages and characters that it has taken in, so the wrapper also
says where a host's varying text is.  The main part is the article (or main) element that
holds most of it, else the innermost container that does; menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are left out by their elements,
roles, classes and ids, and outside an article lists of links, too.  Inside an article
(or main) element that is the main part only elements, roles, and classes and ids of block
containers that are such words as a whole count, and the host has to have them on more
pages than one (a host of one page: its classes); headings, paragraphs and inline elements
stay, whatever their ids say, and so does the text of formulas.

A first pass counts by host the pages that have each word of classes, ids and roles;
labels keep words on one page in ``SHARED`` at least (and those that say what is left
out), so ids made of titles and classes of authors are no labels.  A wrapper has at most
about two times ``WIDTH`` items: those on most pages; the rest of a sequence is one
optional text slot with summed counts.  So its size is that of the template, whatever the
pages are; a page whose main part fell into such a slot is ruled by itself.

Each map task aligns the pages that it reads and passes on one wrapper a host; wrappers
of a host are then aligned ``FAN_IN`` at a time in rounds, so a host with a third of all
pages costs no task more than others.  Pages are read a second time to be cut by their
host's rules, a few paths each, joined by host.

Defined results: a null page is an empty one and gives an empty text; pages without a url
are one host; unclosed and misnested elements are closed where browsers would; elements
nested deeper than ``DEPTH`` give their text, in its order, to the element around them
(what is left out stays so, and articles stay apart for ``DEPTH // 3`` more); equal
pages give equal rows; an empty table gives an empty result.  Columns other than page_id,
url and html are not read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.session import stage

PERIOD = 4
FAN_IN = 32
#: Levels of elements that a tree has; browsers stop at 512.
DEPTH = 150
#: Share of the varying text that the main part holds.
MOST = 0.8
#: Hosts whose wrappers a map task holds before it passes them on.
HELD = 2_000
#: Items of a wrapper that are kept apart.
WIDTH = 1_000
#: Labels keep words that one in so many pages of the host has.
SHARED = 20
#: Counts of words that a map task holds before it passes them on.
COUNTS = 200_000

# Elements of HTML by how they are parsed and laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg object select annotation annotation-xml".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr img math semantics mrow mi mo mn ms mtext mspace "
    "msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose".split()
)
SEMANTIC = ("article", "main")
CONTAINERS = set("html body div section main article center table tbody tr td span".split())
#: What a start tag closes, and what stops the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
BOUNDS = set("html body article main section div nav aside header footer form table td th li ul ol dl blockquote".split())

# Elements, and words of classes, ids and roles, of what is not main text.
LEFT_OUT = set("nav header footer aside form button dialog head".split()) | RAW
LEFT_OUT_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar "
    "comment comments commentlist discussion respond reply replies disqus cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social related recommended recommendations widget widgets pagination pager copyright "
    "contentinfo complementary skip".split()
)
#: Containers that classes and ids can leave out inside an article, and the words that
#: may stand beside one of the words above in a class or id ("comments-area").
BLOCKS = set("article div section ul ol dl table center details figure".split())
BESIDE = set("area bar block box buttons container form icons links list articles posts site wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_START = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ANY_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PARTS = re.compile(r"[a-z]+")


class Node:
    """An element (label, attributes as they stand, children: nodes and texts).

    ``flat``: its children are those of the element around it; ``shut``: deeper than
    ``DEPTH`` and left out."""

    __slots__ = ("tag", "label", "attributes", "children", "depth", "flat", "shut")

    def __init__(self, tag: str, label: str, attributes: str = "") -> None:
        self.tag, self.label, self.attributes, self.children = tag, label, attributes, []
        self.depth, self.flat, self.shut = 0, False, False


def _words(attributes: str) -> list[str]:
    words: list[str] = []
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            words.append("hidden")
        words += _PARTS.findall(value.lower())
    return words


def _label(tag: str, attributes: str, kept: set[str] | None = None) -> str:
    words = dict.fromkeys(_words(attributes)) if attributes else {}
    if kept is not None:
        words = [w for w in words if w == "hidden" or w in LEFT_OUT_WORDS or f"{tag}.{w}" in kept]
    return ".".join([tag, *words])


def page_words(page: str) -> set[str]:
    """"tag.word" for every word of classes, ids and roles."""
    return {
        f"{tag.lower()}.{word}"
        for tag, attributes in set(_START.findall(page)) if attributes
        for word in _words(attributes)
    }


def parse(page: str, kept: set[str] | None = None) -> Node:
    """The tree of a page; elements that are left open are closed where browsers would.
    Labels have all words, or only those in ``kept`` and those of what is left out."""
    root = Node("", "")
    stack = [root]
    opened: dict[str, int] = {}  # elements on the stack by tag
    end = len(page)
    at = 0
    while at < end:
        found = _TOKEN.match(page, at)
        if found is None:  # a tag that never ends
            stack[-1].children.append(page[at:])
            break
        at = found.end()
        closing, tag, attributes, text = found.groups()
        if text is not None:
            stack[-1].children.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if not opened.get(tag):
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    _cut_off(stack, depth, opened)
                    break
                if stack[depth].tag in BOUNDS and (tag in INLINE or tag == "p"):
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            _close(stack, {"p"}, BOUNDS, opened)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag], opened)
        node = Node(tag, _label(tag, attributes, kept), attributes)
        _attach(stack[-1], node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _attach(around: Node, node: Node) -> None:
    node.depth = around.depth + 1
    if node.depth > DEPTH:
        out = left_out(node.label)
        if around.shut or not (out or (node.tag in SEMANTIC and node.depth <= DEPTH + DEPTH // 3)):
            node.flat = True
            node.children, node.depth, node.shut = around.children, around.depth, around.shut
            _break(node)
            return
        node.shut = out
    around.children.append(node)


def _break(node: Node) -> None:
    """The text before and after the edge of a flat block is apart."""
    if node.tag not in INLINE:
        node.children.append(Node("br", "br"))


def _cut_off(stack: list[Node], depth: int, opened: dict[str, int]) -> None:
    """The elements of a stack from a depth on are closed."""
    for node in stack[depth:]:
        opened[node.tag] -= 1
        if node.flat:
            _break(node)
    del stack[depth:]


def _close(stack: list[Node], tags: set[str], bounds: set[str], opened: dict[str, int]) -> None:
    if not any(opened.get(tag) for tag in tags):
        return
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            _cut_off(stack, depth, opened)
            return
        if stack[depth].tag in bounds:
            return


# Patterns: [label, optional, repeated, pages, characters, linked characters, children];
# a text slot has label "#" and its template text, or None, in place of children.


def pattern(node: Node, linked: bool = False) -> list:
    children = []
    linked = linked or node.tag == "a"
    for child in node.children:
        if isinstance(child, Node):
            children.append(pattern(child, linked))
        elif text := child.strip():
            n = len(text)
            children.append(["#", False, False, 1, n, n if linked else 0, text[:64] if n <= 64 else None])
    children = fold(children)
    return [node.label, False, False, 1, sum(c[4] for c in children), sum(c[5] for c in children), children]


def align(a: list, b: list, together: bool = False) -> list:
    """The pattern of two patterns of one label; ``together``: both are of one page."""
    pages = max(a[3], b[3]) if together else a[3] + b[3]
    if a[0] == "#":
        inside = a[6] if a[6] == b[6] else None
    else:
        inside = fold(merge(a[6], b[6], together))
    return [a[0], a[1] or b[1], a[2] or b[2], pages, a[4] + b[4], a[5] + b[5], inside]


def merge(a: list, b: list, together: bool = False) -> list:
    """Two sequences aligned; what is in one only becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [align(x, y, together) for x, y in zip(a, b, strict=True)]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            if a[i][0] == b[j][0]:
                longest[i][j] = longest[i + 1][j + 1] + 1
            else:
                longest[i][j] = max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(align(a[i], b[j], together))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return out + [[x[0], True, *x[2:]] for x in a[i:] + b[j:]]


def fold(row: list) -> list:
    """Repeats in a sequence as repeated groups."""
    for period in range(1, PERIOD + 1):
        out: list = []
        for item in row:
            out.append(item)
            while len(out) >= 2 * period and all(
                out[-period - k - 1][0] == out[-k - 1][0] for k in range(period)
            ):
                if period > 1 and len({x[0] for x in out[-period:]}) == 1:
                    break
                for k in range(period):
                    first = len(out) - 2 * period + k
                    out[first] = align(out[first], out[len(out) - period + k], together=True)
                    out[first][2] = True
                del out[-period:]
        row = out
    return row


def bounded(wrapper: list) -> list:
    """A pattern with the ``WIDTH`` items that are on most pages (of equals the outer ones);
    the others of each sequence are one optional slot."""
    items, level = [], [wrapper]
    while level:
        items += level
        level = [c for x in level if x[0] != "#" for c in x[6]]
    if len(items) <= WIDTH:
        return wrapper
    # An item is on no more pages than the one around it, which comes first.
    kept = {id(x) for x in sorted(items, key=lambda x: -x[3])[:WIDTH]}

    def cut(item: list) -> list:
        if item[0] == "#":
            return item
        inside = [cut(c) for c in item[6] if id(c) in kept]
        if rare := [c for c in item[6] if id(c) not in kept]:
            n = sum(_varying(c, 1) for c in rare)
            inside.append(["#", True, True, max(c[3] for c in rare), n, 0, None])
        return [*item[:6], fold(inside)]

    return cut(wrapper)


def expression(row: list) -> str:
    """A sequence as a regular expression over labels, for people to read."""
    said = []
    for item in row:
        mark = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[int(item[1]), int(item[2])]
        if item[0] == "#":
            said.append((json.dumps(item[6]) if item[6] else "#") + mark)
        else:
            said.append(f"({item[0]} {expression(item[6])}){mark}" if item[6] else f"({item[0]}){mark}")
    return " ".join(said)


# Rules: which paths of a wrapper are main text


def left_out(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in LEFT_OUT or "hidden" in words or any(w in LEFT_OUT_WORDS for w in words)


def left_out_inside(node: Node, rule: dict) -> bool:
    """Is an element inside an article not main text?"""
    if node.tag in LEFT_OUT:
        return True
    for name, value in _ANY_ATTRIBUTE.findall(node.attributes):
        name = name.lower()
        if name == "hidden":
            return True
        if node.tag not in BLOCKS or name not in ("class", "id", "role"):
            continue
        if name == "id" and node.tag == "section":  # made of its heading
            continue
        for token in value.strip("\"'").lower().split():
            words = _PARTS.findall(token)
            said = [w for w in words if w in LEFT_OUT_WORDS]
            if not said or any(w not in LEFT_OUT_WORDS and w not in BESIDE for w in words):
                continue
            if name == "role" or (name == "class" and rule.get("pages", 1) < 2):
                return True
            if all(f"{node.tag}.{w}" in rule.get("sure", ()) for w in said):
                return True
    return False


def _varying(item: list, pages: int, inside: bool = False) -> int:
    """Characters in slots; template text counts only where there is but one page."""
    if item[0] == "#":
        return item[4] - item[5] if item[6] is None or pages < 2 else 0
    tag = item[0].split(".")[0]
    if tag in LEFT_OUT if inside else left_out(item[0]):
        return 0
    inside = inside or tag in SEMANTIC
    return sum(_varying(c, pages, inside) for c in item[6])


def rules(wrapper: list) -> dict:
    """{"main": paths of the main parts, "out": paths to leave out inside them, "article":
    are they article (or main) elements, "pages": pages of the host}."""
    pages = wrapper[3]
    total = _varying(wrapper, pages)
    if not total:  # equal pages only: all is template
        pages, total = 1, _varying(wrapper, 1)
    chosen: list[tuple[tuple[str, ...], list]] = []

    def semantic(item: list, path: tuple[str, ...], tags: tuple[str, ...]) -> None:
        if item[0] == "#" or left_out(item[0]):
            return
        here = (*path, item[0])
        if item[0].split(".")[0] in tags and _varying(item, pages):
            chosen.append((here, item))
            return
        for child in item[6]:
            semantic(child, here, tags)

    for tags in [(tag,) for tag in SEMANTIC]:
        for child in wrapper[6]:
            semantic(child, (), tags)
        if sum(_varying(x, pages) for _, x in chosen) >= MOST * total / 2 and chosen:
            break
        chosen.clear()
    semantic_main = bool(chosen)
    if not chosen:
        path, item = (), wrapper
        while True:
            inner = [
                c for c in item[6]
                if c[0] != "#" and c[0].split(".")[0] in CONTAINERS and _varying(c, pages) >= MOST * max(total, 1)
            ]
            if not inner or not total:
                break
            path, item = (*path, inner[0][0]), inner[0]
        chosen.append((path, item))
    out: list[str] = []

    def leave(item: list, path: tuple[str, ...]) -> None:
        for child in item[6]:
            if child[0] == "#":
                continue
            here = (*path, child[0])
            listed = child[2] and child[4] and child[5] > 0.8 * child[4] and child[0].split(".")[0] not in INLINE
            if left_out(child[0]) or listed:
                out.append("/".join(here))
            else:
                leave(child, here)

    if not semantic_main:
        for path, item in chosen:
            leave(item, path)
    return {
        "main": ["/".join(p) for p, _ in chosen],
        "out": sorted(set(out)),
        "article": semantic_main,
        "pages": wrapper[3],
    }


def extract(page: str, rule: dict) -> str:
    """Main text of a page by the rules of its host; a page that has none of the host's
    main parts is ruled by itself."""
    tree = parse(page, rule.get("words"))
    text = _cut(tree, rule)
    if text is None:
        of_host = {k: rule[k] for k in ("pages", "sure") if k in rule}
        text = _cut(tree, rules(pattern(tree)) | of_host)
    return text or ""


def _cut(tree: Node, rule: dict) -> str | None:
    main, out = set(rule["main"]), set(rule["out"])
    blocks: list[list[str]] = [[]]
    met = "" in main
    article = rule.get("article", False)

    def walk(node: Node, path: str, inside: bool) -> None:
        nonlocal met
        for child in node.children:
            if not isinstance(child, Node):
                if inside:
                    blocks[-1].append(child)
                continue
            here = f"{path}/{child.label}" if path else child.label
            breaks = child.tag not in INLINE
            if breaks:
                blocks.append([])
            left = left_out_inside(child, rule) if inside and article else here in out or left_out(child.label)
            if not left:
                met = met or here in main
                walk(child, here, inside or here in main)
                if breaks:
                    blocks.append([])

    walk(tree, "", met)
    if not met:
        return None
    said = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return " ".join(x for x in said if x)


# Spark


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by host and word; the word is empty for all pages of the host."""
    counts: dict[tuple[str, str], int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in counts], pa.string()),
                pa.array([k[1] for k in counts], pa.string()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["host", "word", "n"],
        )

    for batch in batches:
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for word in ("", *page_words(page.as_py() or "")):
                counts[name, word] = counts.get((name, word), 0) + 1
            if len(counts) > COUNTS:
                yield rows()
                counts.clear()
    yield rows()


def shared_words(named: DataFrame) -> DataFrame:
    """(host, words: "tag.word" that labels keep, between blanks; null for all; sure: those
    on two pages or more that say what is left out)."""
    counts = stage(
        named.mapInArrow(_counted, "host string, word string, n long").groupBy("host", "word").agg(F.sum("n").alias("n")),
        "word-counts",
    )
    pages = counts.filter("word = ''").select("host", F.col("n").alias("pages"))
    says = F.substring_index("word", ".", -1).isin(sorted(LEFT_OUT_WORDS))
    shared = (
        counts.filter("word <> '' and n > 1")
        .join(pages, "host")
        .filter(F.col("n") * SHARED >= F.col("pages"))
        .groupBy("host")
        .agg(
            F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"),
            F.array_join(F.array_sort(F.collect_list(F.when(says, F.col("word")))), " ").alias("sure"),
        )
    )
    words = F.when(F.col("pages") > SHARED, F.coalesce("words", F.lit("")))
    return stage(pages.join(shared, "host", "left").select("host", words.alias("words"), "sure"), "words")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of the pages that a task reads."""
    wrappers: dict[str, list] = {}
    kept: dict[str, set[str] | None] = {}
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)
        for name, page, words in rows:
            if name not in kept:
                kept[name] = None if (said := words.as_py()) is None else set(said.split())
            made = bounded(pattern(parse(page.as_py() or "", kept[name])))
            known = wrappers.get(name)
            wrappers[name] = made if known is None else bounded(align(known, made))
            if len(wrappers) > HELD:
                yield _rows(wrappers)
                wrappers = {}
                kept = {}
    yield _rows(wrappers)


def _rows(wrappers: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(wrappers), pa.string()), pa.array([json.dumps(w) for w in wrappers.values()], pa.string())],
        ["host", "wrapper"],
    )


def _aligned(group: pa.Table) -> pa.Table:
    """One wrapper from at most about ``FAN_IN`` of a host."""
    texts = sorted(group.column("wrapper").to_pylist())
    whole = json.loads(texts[0])
    for text in texts[1:]:
        whole = bounded(align(whole, json.loads(text)))
    return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(whole)])})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper: JSON) for every host."""
    named = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return _inferred(named, shared_words(named))


def _inferred(named: DataFrame, words: DataFrame) -> DataFrame:
    labelled = named.join(words, "host").select("host", "html", "words")
    found = stage(labelled.mapInArrow(_read, "host string, wrapper string"), "wrappers")
    while True:
        counts = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return found
        bucket = F.pmod(F.xxhash64("wrapper", F.spark_partition_id()), F.greatest(F.ceil(F.col("n") / FAN_IN), F.lit(1)))
        found = stage(
            found.join(counts, "host")
            .select("host", "wrapper", bucket.alias("bucket"))
            .groupBy("host", "bucket")
            .applyInArrow(_aligned, "host string, wrapper string"),
            "wrappers",
        )


def _ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for wrapper, words, sure in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
            of_host = {"words": None if words is None else words.split(), "sure": (sure or "").split()}
            made.append(json.dumps(rules(json.loads(wrapper)) | of_host))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["host", "rule"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, rule in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            if rule not in known:
                if len(known) >= HELD:
                    known.clear()
                known[rule] = made = json.loads(rule)
                if made["words"] is not None:
                    made["words"] = set(made["words"])
                made["sure"] = set(made["sure"])
            texts.append(extract(page.as_py() or "", known[rule]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    read = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    words = shared_words(read)
    wrappers = _inferred(read, words).join(words, "host").select("host", "wrapper", "words", "sure")
    rule = stage(wrappers.mapInArrow(_ruled, "host string, rule string"), "rules")
    named = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host(F.col(url_col)).alias("host"),
    )
    return named.join(rule, "host").select("page_id", "url", "html", "rule").mapInArrow(
        _extracted, "page_id long, url string, text string"
    )


def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
