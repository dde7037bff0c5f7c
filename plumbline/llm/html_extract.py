"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching into a template: a tree
of the elements they share. The texts at its nodes are counted over the host's
distinct pages, all of them: those that half of the pages have are template; the
varying rest is content. Nodes that a template has no room for are known by the
labels on the way to them. Tags and class names say which zones (menus, adverts,
comments ...) are never content.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col_
from plumbline.llm.common import Scratch, read_table

# A text on at least this share of a host's distinct pages, of this many at
# least, is template.
SHARE, PAGES = 0.5, 4
# A template keeps at most this many nodes; the texts at others are counted by
# the labels on the way to them.
NODES = 2000
# Hosts of more pages than a group are broadcast while there are this few.
BROADCAST_ROWS = 200_000
# Elements nested deeper than this are part of the element at this depth.
DEPTH = 150
# Pages per group when templates are applied, page trees when they are merged.
GROUP = 500
# A host's page trees are merged in up to so many groups first.
SPREAD = 64

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# What these hold is never markup: without an end tag, it is all of the rest.
_RAW = frozenset("script style textarea title iframe".split())
# These go with their content, up to the end tag that matches; without one, the tag alone goes.
_SKIPPED = frozenset("noscript template svg head select".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = frozenset("ul ol dl table article main body html section nav aside footer header form".split())
_OUT_TAGS = frozenset("nav footer aside form menu dialog fieldset button".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu menus sidebar footer ad ads advert adverts advertisement advertising banner cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe subscription signup social share sharing comment comments reply replies respond "
    "disqus related recommended recommendations promo promotion sponsor sponsored breadcrumb breadcrumbs pagination pager popup "
    "modal widget login toolbar skip form search masthead copyright complementary contentinfo search".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN_WORDS = frozenset(("main", "articlebody"))


class Node:
    """A block element: its label, its children and the texts directly in it."""

    __slots__ = ("label", "out", "main", "children", "texts", "parent", "tag", "number", "depth")

    def __init__(self, tag: str, label: str, out: bool, main: bool, parent: "Node | None"):
        self.tag, self.label, self.out, self.main, self.parent = tag, label, out, main, parent
        self.children: list[Node] = []
        self.texts: list[list] = []  # [order on the page, text]
        self.number, self.depth = -1, 0 if parent is None else parent.depth + 1


def _marks(attributes: str) -> tuple[str, set[str]]:
    if "=" not in attributes:
        return "", set()
    words, label = set(), ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "class":
            label = value
        words.update(re.split(r"[^a-z0-9]+", value))
    # "with-sidebar" and "no-ads" tell of something else on the page.
    if words & {"with", "has", "no", "without"}:
        words -= _OUT_WORDS
    return label, words - {""}


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where the content of each closed element of this tag starts, and where its end tag ends."""
    found, opened = {}, []
    marks = rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    for mark in re.compile(marks, re.S | re.I).finditer(page):
        if mark[1]:
            if opened:
                found[opened.pop()] = mark.end()
        elif mark[1] is not None and not mark[2].endswith("/"):
            opened.append(mark.end())
    return found


def parse(page: str) -> Node:
    """The block tree of a page. Broken markup is closed as browsers would."""
    root = Node("", "", False, False, None)
    here, runs, order = root, [], 0
    unopened: dict[str, int] = {}
    ends: dict[str, dict[int, int]] = {}

    def flush():
        nonlocal runs, order
        text = " ".join("".join(runs).split()) if runs else ""
        if text:
            here.texts.append([order, text])
            order += 1
        runs = []

    def add(raw: str):
        runs.append(html.unescape(raw) if "&" in raw else raw)

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            rest = page[at:]
            # A tag that never ends is markup, not text.
            cut = re.search(r"<[a-zA-Z/!][^<]*\Z", rest)
            add(rest[: cut.start()] if cut else rest)
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in _BLOCK:
                flush()
                if unopened.get(tag):
                    unopened[tag] -= 1
                    continue
                up = here
                while up is not root and up.tag != tag and not (up.tag in _HOLDS and tag not in _HOLDS):
                    up = up.parent
                if up is not root and up.tag == tag:
                    here = up.parent
            continue
        if tag in _RAW:
            if not found[3].endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in _SKIPPED:
            if not found[3].endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(at, at)
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag not in _BLOCK:
            if tag == "button":
                stop = re.compile(r"</button\s*>", re.I).search(page, at)
                at = stop.end() if stop else at
            continue
        flush()
        if tag in _VOID:
            continue
        if here.tag == "p" and tag in _ENDS_P:
            here = here.parent
        elif tag in _SIBLINGS:
            up = here
            while up is not root and up.tag not in _SIBLINGS[tag] and up.tag not in _HOLDS:
                up = up.parent
            if up.tag in _SIBLINGS[tag]:
                here = up.parent
                if tag == "tr" and here.tag in ("tr",):
                    here = here.parent
        if here.depth >= DEPTH:
            unopened[tag] = unopened.get(tag, 0) + 1
            continue
        label, words = _marks(found[3])
        main = tag in ("article", "main") or bool(words & _MAIN_WORDS)
        if tag in ("article", "main") and not words & _OUT_WORDS:
            # Content inside an advert or menu means that its end tag is missing.
            while _is_out(here):
                here = here.parent
        inside = _in_main(here)
        out = tag in _OUT_TAGS or (bool(words & _OUT_WORDS) and tag not in ("html", "body")) or (tag == "header" and not inside)
        if not out and "header" in words and not inside and tag not in ("html", "body"):
            out = True
        node = Node(tag, f"{tag}.{label}" if label else tag, out, main and not out, here)
        here.children.append(node)
        here = node
    flush()
    return root


def _is_out(node: Node | None) -> bool:
    while node is not None:
        if node.out:
            return True
        node = node.parent
    return False


def _in_main(node: Node | None) -> bool:
    while node is not None:
        if node.main:
            return True
        node = node.parent
    return False


def candidates(root: Node) -> list[tuple[Node, list]]:
    """Texts that may be content, in page order, with their nodes.

    Those in the page's articles (or main zones) where it has any; of a header
    inside one, the headings only.
    """
    nodes, stack, has_article, has_main = [], [(root, False, False, False)], False, False
    while stack:
        node, in_article, in_main, in_header = stack.pop()
        if node.out:
            continue
        in_article = in_article or (node.main and node.tag == "article")
        in_main = in_main or node.main
        in_header = in_header or node.tag == "header"
        if node.texts and not (in_header and node.tag not in _HEADINGS):
            has_article, has_main = has_article or in_article, has_main or in_main
            nodes.append((node, in_article, in_main))
        stack += [(child, in_article, in_main, in_header) for child in node.children]
    chosen = [(n, t) for n, article, main in nodes if (article if has_article else main if has_main else True) for t in n.texts]
    return sorted(chosen, key=lambda pair: pair[1][0])


# -- compact trees and templates -----------------------------------------------


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Slot:
    """A template node, or a page node with runs of equal siblings folded."""

    __slots__ = ("label", "children", "count", "number")

    def __init__(self, label: str, count: int):
        self.label, self.children, self.count = label, [], count
        self.number = -1


def fold(node: Node) -> tuple[list[Node], str]:
    """A page's nodes, which get the number of their slot, and its folded tree as JSON.

    Slots are numbered from the root, each before its children.
    """
    shapes: dict[int, str] = {}
    order, stack = [], [node]
    while stack:
        one = stack.pop()
        order.append(one)
        stack += one.children
    for one in reversed(order):
        inner = []
        for child in one.children:
            shape = shapes[id(child)]
            if not inner or inner[-1] != shape:
                inner.append(shape)
        shapes[id(one)] = f"[{json.dumps(one.label)},[{','.join(inner)}]]"
    made = 0

    def number(group: list[Node]) -> None:
        nonlocal made
        for member in group:
            member.number = made
        made += 1
        runs: list[list[list[Node]]] = []
        for member in group:
            last, at = None, -1
            for child in member.children:
                shape = shapes[id(child)]
                if shape != last:
                    at, last = at + 1, shape
                    if at == len(runs):
                        runs.append([])
                runs[at].append(child)
        for run in runs:
            number(run)

    number([node])
    return order, shapes[id(node)]


def _weights(a: Slot, b: Slot, memo: dict) -> int:
    """Simple tree matching: the most nodes that can be paired, order kept."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        table = _table(a, b, memo)
        memo[key] = 1 + table[-1][-1]
    return memo[key]


def _table(a: Slot, b: Slot, memo: dict) -> list[list[int]]:
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + _weights(x, y, memo))
    return table


def aligned(a: Slot, b: Slot, memo: dict) -> list[tuple[int, int]]:
    """The pairs of children that the best matching pairs."""
    table, pairs = _table(a, b, memo), []
    i, j = len(a.children), len(b.children)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def merge(into: Slot, other: Slot, memo: dict | None = None) -> None:
    """Add a tree (of a page or a template) to a template."""
    # Neither tree changes below the nodes that are being merged.
    memo = {} if memo is None else memo
    into.count += other.count
    pairs = aligned(into, other, memo)
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(into.children), len(other.children))]:
        children += into.children[i:p] + other.children[j:q]
        if p < len(into.children):
            merge(into.children[p], other.children[q], memo)
            children.append(into.children[p])
        i, j = p + 1, q + 1
    into.children = children


def _pruned(root: Slot) -> Slot:
    """The template without its rarest nodes, where there are over NODES."""
    every, stack = [], [root]
    while stack:
        slot = stack.pop()
        every.append(slot)
        stack += slot.children
    if len(every) > NODES:
        # Of equal counts the first stay; a parent is before its children.
        kept = {id(slot) for slot in sorted(every, key=lambda slot: -slot.count)[:NODES]}
        for slot in every:
            slot.children = [child for child in slot.children if id(child) in kept]
    return root


def dumped(slot: Slot) -> list:
    return [slot.label, [dumped(child) for child in slot.children], slot.count]


def loaded(data: list, count: int = 1) -> Slot:
    """A template, or the tree of `count` pages."""
    slot = Slot(data[0], data[2] if len(data) > 2 else count)
    slot.children = [loaded(child, count) for child in data[1]]
    return slot


def _numbered(root: Slot) -> Slot:
    made, stack = 0, [root]
    while stack:
        slot = stack.pop()
        slot.number, made = made, made + 1
        stack += slot.children[::-1]
    return root


def _paths(page: Slot, matched: Collection[int]) -> dict[int, int]:
    """A place below zero for each slot of a page but the matched ones: the labels from the root to it."""
    out: dict[int, int] = {}
    stack = [(page, "")]
    while stack:
        slot, above = stack.pop()
        path = f"{above}{json.dumps(slot.label)}"
        if slot.number not in matched:
            out[slot.number] = -1 - (_digest(path) & (1 << 63) - 1)
        stack += [(child, path) for child in slot.children]
    return out


class Wrapper:
    """A host's template and its constant texts, ready to meet its pages."""

    def __init__(self, template: str | None, fixed: Iterable[tuple[int, int]] = ()):
        self.root = None if template is None else _numbered(loaded(json.loads(template)))
        self.fixed: dict[int, set[int]] = {}
        for number, value in fixed:
            self.fixed.setdefault(number, set()).add(value)
        self.shapes: dict[str, dict[int, int]] = {}

    def places(self, shape: str) -> dict[int, int]:
        """The place of each slot of a page's folded tree.

        It is the template's slot; for one that is not in the template it is
        below zero, by the labels from the root to it.
        """
        if shape not in self.shapes:
            out: dict[int, int] = {}
            page, memo = _numbered(loaded(json.loads(shape))), {}
            stack = [(self.root, page)] if self.root is not None and self.root.label == page.label else []
            while stack:
                a, b = stack.pop()
                out[b.number] = a.number
                stack += [(a.children[i], b.children[j]) for i, j in aligned(a, b, memo)]
            out = _paths(page, out) | out
            if len(self.shapes) >= 512:
                self.shapes.clear()
            self.shapes[shape] = out
        return self.shapes[shape]

    def is_fixed(self, places: dict[int, int], number: int, text: str) -> bool:
        """Whether the text is template at this slot of the page."""
        known = self.fixed.get(places[number])
        return known is not None and _digest(text) in known


def main_text(page: str, wrapper: Wrapper) -> str:
    """The content blocks of a page, joined by line feeds."""
    root = parse(page)
    chosen = candidates(root)
    if not chosen:
        return ""
    if wrapper.fixed:
        places = wrapper.places(fold(root)[1])
        varying = [text[1] for node, text in chosen if not wrapper.is_fixed(places, node.number, text[1])]
    else:
        varying = [text[1] for _, text in chosen]
    # Where the template would take most of an article, its pages are copies
    # of one another, and nothing in them is called template.
    if 2 * sum(map(len, varying)) < sum(len(text[1]) for _, text in chosen):
        varying = [text[1] for _, text in chosen]
    return "\n".join(varying)


# -- as Spark jobs -------------------------------------------------------------


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_PAGE = "tree string, slots array<int>, digests array<bigint>"


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The article digest, the folded tree and the texts by slot of every page."""
    fields = [("tree", pa.string()), ("slots", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64()))]
    for batch in batches:
        articles, pages = [], []
        for page in batch.column("html"):
            root = parse(page.as_py() or "")
            articles.append(_digest("\n".join(text[1] for _, text in candidates(root))))
            nodes, tree = fold(root)
            values = sorted({(node.number, _digest(text[1])) for node in nodes for text in node.texts})
            pages.append({"tree": tree, "slots": [slot for slot, _ in values], "digests": [value for _, value in values]})
        columns = [batch.column("host").cast(pa.string()), pa.array(articles, pa.int64()), pa.array(pages, pa.struct(fields))]
        yield pa.RecordBatch.from_arrays(columns, ["host", "article", "page"])


def _induce(frame: pd.DataFrame) -> pd.DataFrame:
    """A template per host, from the trees of `pages` pages each, in an order of their own."""
    out = []
    for host, part in frame.groupby("host"):
        rows = sorted(zip(part["tree"], part["pages"]), key=lambda row: (-row[1], len(row[0]), row[0]))
        root = loaded(json.loads(rows[0][0]), rows[0][1])
        for tree, pages in rows[1:]:
            merge(root, loaded(json.loads(tree), pages))
        out.append((host, json.dumps(dumped(_pruned(root))), root.count))
    return pd.DataFrame(out, columns=["host", "tree", "pages"])


_COUNTED = "host string, slot long, whole boolean, digest long, n long"


def _count(articles: pd.DataFrame, templates: pd.DataFrame) -> pd.DataFrame:
    """Distinct pages by (host, place), as `whole`, and by text there."""
    wrappers = {host: (Wrapper(text), parts) for host, text, parts in zip(templates["host"], templates["template"], templates["parts"])}
    pages: Counter = Counter()
    texts: Counter = Counter()
    for host, tree, slots, digests in zip(articles["host"], articles["tree"], articles["slots"], articles["digests"]):
        places = wrappers[host][0].places(tree)
        # Slots outside the template may share a place: it counts once a page, and so does a text there.
        pages.update({(host, place) for place in places.values()})
        texts.update({(host, places[slot], int(digest)) for slot, digest in zip(slots, digests)})
    rows = [(host, slot, True, 0, n) for (host, slot), n in pages.items()]
    # The counts of a host that is in one part are final.
    rows += [
        (host, slot, False, digest, n)
        for (host, slot, digest), n in texts.items()
        if wrappers[host][1] > 1 or n >= SHARE * pages[host, slot]
    ]
    return pd.DataFrame(rows, columns=["host", "slot", "whole", "digest", "n"])


def _apply(pages: pd.DataFrame, templates: pd.DataFrame) -> pd.DataFrame:
    wrappers = {
        host: Wrapper(text, [] if fixed is None else [(row["slot"], row["digest"]) for row in fixed])
        for host, text, fixed in zip(templates["host"], templates["template"], templates["fixed"])
    }
    none = Wrapper(None)
    texts = [main_text(page or "", wrappers.get(host, none)) for host, page in zip(pages["host"], pages["html"])]
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": texts})


def _dealt(scratch: Scratch, rows: DataFrame, names: list[str], key: list[str], templates: DataFrame, size: str):
    """`rows` beside their hosts' templates, in groups of about GROUP rows.

    A host's rows (`size` in `templates` says how many) are dealt by `key` over
    parts of GROUP or so, each part with its own copy of the host's template.
    """
    total = templates.agg(F.sum(size)).first()[0] or 0
    groups = F.lit(max(1, -(-total // GROUP)))
    templates = templates.withColumn("parts", F.ceil(F.col(size) / GROUP).cast("int"))
    split = scratch.stage(templates.select("host", "parts").where("parts > 1"), f"split-by-{size}")
    if split.count() <= BROADCAST_ROWS:
        split = F.broadcast(split)
    placed = rows.join(split, "host", "left").withColumn("part", F.pmod(F.xxhash64(*key), F.coalesce("parts", F.lit(1))).cast("int"))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("host", "part"), groups)).select("bucket", "host", *names)
    copies = templates.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    copies = copies.withColumn("bucket", F.pmod(F.xxhash64("host", "part"), groups)).drop("part", "pages", "articles")
    return placed.groupBy("bucket").cogroup(copies.groupBy("bucket"))


def _templates(scratch: Scratch, articles: DataFrame) -> DataFrame:
    """One row per host: host, template, pages, articles. No split of the table changes it."""
    trees = scratch.stage(articles.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("pages")), "trees")
    groups = F.lit(max(1, -(-trees.count() // GROUP)))
    spread = F.pmod(F.xxhash64("tree"), F.lit(SPREAD))
    partial = trees.groupBy(F.pmod(F.xxhash64("host", spread), groups).alias("bucket")).applyInPandas(_induce, "host string, tree string, pages long")
    merged = partial.groupBy(F.pmod(F.xxhash64("host"), F.lit(256)).alias("bucket")).applyInPandas(_induce, "host string, tree string, pages long")
    sizes = articles.groupBy("host").agg(F.sum("copies").alias("pages"), F.count(F.lit(1)).alias("articles"))
    return merged.select("host", F.col("tree").alias("template")).join(sizes, "host")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars.

    Null and empty html give an empty text. Pages without a URL share the
    empty host. Repeated pages are extracted each, but count once in their
    host's template. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "html")
    source = pages.select(
        col_(id_col).cast("long").alias("page_id"), col_(url_col).cast("string").alias("url"), col_(html_col).cast("string").alias("html")
    ).withColumn("host", _host(F.col("url")))
    parsed = source.select("host", "html").mapInArrow(_articles, f"host string, article long, page struct<{_PAGE}>")
    # Of pages with one article the first by tree and texts stands for all.
    distinct = parsed.groupBy("host", "article").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("copies"))
    articles = scratch.stage(distinct.select("host", "article", "copies", "page.*"), "articles")
    templates = scratch.stage(_templates(scratch, articles), "templates")
    scratch.drop("trees")
    names = ["tree", "slots", "digests"]
    counted = _dealt(scratch, articles, names, ["article"], templates, "articles").applyInPandas(_count, _COUNTED)
    counted = counted.groupBy("host", "slot", "whole", "digest").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARE * PAGES)
    counted = scratch.stage(counted, "counts")
    scratch.drop("articles")
    whole = counted.where("whole").where(F.col("n") >= PAGES).select("host", "slot", F.col("n").alias("all"))
    fixed = counted.where("NOT whole").join(whole, ["host", "slot"]).where(F.col("n") >= SHARE * F.col("all"))
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("slot", "digest")).alias("fixed"))
    wrappers = scratch.stage(templates.join(fixed, "host", "left"), "wrappers")
    dealt = _dealt(scratch, source, ["page_id", "url", "html"], ["page_id", "url"], wrappers, "pages")
    done = dealt.applyInPandas(_apply, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))
