"""HTML extraction with site style trees.

The pages of a host are merged by the paths of their elements (tags with their class names). A node of that
tree gets the entropy of its presentations (the sequences of the elements below it) and of its contents over
the host's different pages, each relative to the largest possible one. Its importance weighs the two: the more
elements lie below a node, the more its presentation counts. A branch goes from a page if its node has little
importance on the host and what this page has there stands on another of its pages too: unique text is never
cut by the tree. Plain paragraphs, headings and the like only go if nearly all pages have them alike, and the
branches that hold the main text never do. A page that is left with no text keeps what its host repeats.

HTML's own elements for menus, footers, forms, scripts and the like, roles and class names made of nothing but
such words say what the tree can't know from a host with one page; they go with or without it.

A page is parsed once, in Arrow batches, without recursion, into its blocks of text, its elements and its nodes, and
these are written. Only (host, page hash, node, hashes) rows are shuffled, reduced before each shuffle, so one
host may hold a third of all pages; the nodes to cut come back to a page by the hash of its HTML. Copies of a
page count once.

Null and empty pages give an empty text; a null URL belongs to the empty host. Repeated rows are extracted
each on their own. Very long and very deep pages take time and memory in proportion. An empty table gives an
empty table; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import bounded, discard, keep
from tallowmere.llm.urls import host_of

#: Cut below these: both entropies of a node, of a plain node; or importance, where contents aren't nearly all different.
BOTH, BOTH_PLAIN, IMPORTANCE, CONTENT = 0.2, 0.1, 0.5, 0.97
#: Weight that each element below a node takes from its contents.
GAMMA = 0.9
BROADCAST_ROWS = 200_000
# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template head title nav footer aside form select option textarea input iframe object embed svg canvas audio video menu dialog map".split())
# Elements that are words of a sentence where text stands beside them, else controls.
WORDED = frozenset(["button", "label"])
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead blockquote pre figcaption".split())
WHOLE = frozenset("body html article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
# Words in class names and ids of what isn't the article, and words that may stand beside them.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar tracking".split())
BESIDE = frozenset("area bar block bottom box buttons column container content desktop fixed global icons inner item items left link links list lower main mobile outer page primary right secondary section site slot sticky top unit upper wrap wrapper".split())
# Words beside `comment` in names of what isn't comments, but says whether there are any.
STATES = frozenset("no has with without open opened closed enabled disabled allow allowed".split())
#: Words of paragraphs that make a form a part of the page and not a form to fill in.
FORM_WORDS = 50
CLOSES_P = BLOCKS - frozenset(["body", "html"])
SPACE = re.compile(r"\s+")
MASK = (1 << 64) - 1


def _hash(state: int, text: str) -> int:
    """64 bits of what came before and one more text."""
    raw = text.encode("utf-8", "surrogatepass")
    state = (state * 0x9E3779B97F4A7C15 + (zlib.crc32(raw) << 32 | zlib.adler32(raw))) & MASK
    return ((state ^ state >> 29) * 0xC2B2AE3D27D4EB4F) & MASK


def named_noise(names: str) -> bool:
    """Whether a class name or id says that this isn't the article: `site-footer` and `reader-comments` do, `post-header` doesn't."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        if not NOISE.isdisjoint(words) and all(w in NOISE or w in BESIDE for w in words):
            return True
        if any(w.startswith("comment") for w in words) and STATES.isdisjoint(words):
            return True
    return False


class Node:
    __slots__ = ("tag", "name", "children", "noise", "named", "main", "block")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.children, self.block = tag, [], tag in BLOCKS
        marks = attrs.get("class") or ""
        self.name = tag + "".join("." + re.sub(r"\d+", "", w) for w in sorted(set(marks.lower().split()))) if marks else tag
        role = (attrs.get("role") or "").lower()
        hidden = bool(attrs) and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower())
        self.named = bool(attrs) and named_noise(f"{marks} {attrs.get('id') or ''}")
        self.main = tag == "article" or tag == "main" or role in ("main", "article")
        self.noise = tag in DROPPED or role in ROLES or hidden or (self.named and tag not in ("body", "html", "main"))


class Tree(HTMLParser):
    """A lenient tree of elements; texts are strings among the children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]
        self.open: Counter = Counter()

    def close_from(self, k: int) -> None:
        for n in self.stack[k:]:
            self.open[n.tag] -= 1
        del self.stack[k:]

    def last(self, tags: tuple, until: tuple = ()) -> int:
        """Where the last open element of `tags` is, if none of `until` comes after it; else 0."""
        if any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    return k
                if self.stack[k].tag in until:
                    break
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P:
            if k := self.last(("p",), ("td", "th", "button")):
                self.close_from(k)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if k := self.last(same, ("ul", "ol", "dl", "table", "select", "menu")):
                self.close_from(k)
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        if k := self.last((tag,)):
            self.close_from(k)

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def below(node: Node):
    """The elements under one."""
    stack = [c for c in node.children if not isinstance(c, str)]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in n.children if not isinstance(c, str))


def is_page_part(form: Node) -> bool:
    """Whether a form wraps a part of the page, as some sites wrap all of it: an article, a first heading, or many words in paragraphs."""
    words = 0
    for n in below(form):
        if n.main or n.tag == "h1":
            return True
        if n.tag == "p":
            words += sum(len(c.split()) for c in n.children if isinstance(c, str))
    return words >= FORM_WORDS


def has_text(node: Node) -> bool:
    return any(isinstance(c, str) and c.strip() for c in node.children)


def main_nodes(root: Node) -> set[int]:
    """Which elements hold the main text, by identity: all articles, else main, else the same below forms and noisy names, else the whole page."""
    for deep in (False, True):
        for tags in (("article",), ("main", "div", "section")):
            found, stack = set(), [root]
            while stack:
                n = stack.pop()
                if n.main and n.tag in tags:
                    found.add(id(n))
                else:
                    wrapper = lambda c: deep and not c.main and c.tag in ("div", "section", "form", "table", "tbody", "tr", "td", "center", "span")
                    stack.extend(c for c in n.children if not isinstance(c, str) and (((not c.noise or c.main) and not c.named) or wrapper(c)))
            if found:
                return found
    return {id(root)}


class Page:
    """A page's blocks of main text, (text, element); its elements, (parent, key); and its nodes, by key."""

    def __init__(self, html: str):
        root = parse(html)
        mains = main_nodes(root)
        whole = id(root) in mains
        self.texts: list[str] = []
        self.at: list[int] = []
        self.parents, self.keys, self.tags = [0], [_hash(0, "html")], ["html"]
        holds = [False]  # the main text, in or below it
        sums: list[tuple[int, int, int, int]] = []  # element, presentation, content, elements below
        line: list[str] = []

        def flush(element: int) -> None:
            text = SPACE.sub(" ", "".join(line)).strip()
            line.clear()
            if text:
                self.texts.append(text)
                self.at.append(element)

        # node, its element or that of the block around it, children, key, in the main text, left out, presentation, content, below
        stack: list[list] = [[root, 0, iter(root.children), self.keys[0], whole, False, 0, 0, 0]]
        while stack:
            top = stack[-1]
            n, element, rest, key, inside, skipped = top[:6]
            for c in rest:
                if isinstance(c, str):
                    if inside and not skipped:
                        line.append(c)
                    if c := SPACE.sub(" ", c).strip():
                        top[7] = _hash(top[7], c)
                elif c.tag == "br":
                    if inside and not skipped:
                        line.append(" ")
                elif c.tag not in ("script", "style"):
                    entered = id(c) in mains
                    noise = c.noise and not (c.tag == "form" and not c.named and is_page_part(c)) or (c.tag in WORDED and not has_text(n))
                    out = skipped or (inside and ((noise and not c.main) or (c.main and c.named) or (whole and c.tag == "header")))
                    below = element
                    if c.block:
                        if inside:
                            flush(element)
                        below = len(self.keys)
                        self.parents.append(element)
                        self.keys.append(_hash(key, c.name))
                        self.tags.append(c.tag)
                        holds.append(entered)
                    stack.append([c, below, iter(c.children), _hash(key, c.name), inside or entered, out, 0, 0, 0])
                    break
            else:
                stack.pop()
                if n.block and inside and not skipped:
                    flush(element)
                if n.block and element:
                    sums.append((element, top[6], top[7], top[8]))
                    if holds[element]:
                        holds[self.parents[element]] = True
                if stack:
                    up = stack[-1]
                    up[6], up[7], up[8] = _hash(up[6] + top[6], n.name), _hash(up[7] + top[7], "") if top[7] else up[7], up[8] + 1 + top[8]
        flush(0)
        self.nodes: dict[int, list[int]] = {}
        for element, style, content, below in sums:
            may_cut = 0 if holds[element] or self.tags[element] in WHOLE else 1 if self.tags[element] in PLAIN else 2
            row = self.nodes.setdefault(self.keys[element], [0, 0, 2, 0])
            row[0], row[1], row[2], row[3] = _hash(row[0] + style, "s"), _hash(row[1] + content, "c"), min(row[2], may_cut), row[3] + below

    def text(self, cut: frozenset = frozenset()) -> str:
        return kept_text(self.texts, self.at, self.parents, self.keys, cut)


def kept_text(texts: list[str], at: list[int], parents: list[int], keys: list[int], cut) -> str:
    """The blocks outside cut branches, which stay if there is nothing else. Elements come after their parents."""
    if cut:
        gone = [False] * len(keys)
        for k in range(1, len(keys)):
            gone[k] = gone[parents[k]] or keys[k] in cut
        left = [t for t, k in zip(texts, at) if not gone[k]]
        texts = left or texts
    return "\n".join(texts)


def text_of(html: str, cut: frozenset = frozenset()) -> str:
    """The main text of a page; `cut`: keys of nodes that its host repeats."""
    return Page(html).text(cut)


PARSED = "texts array<string>, at array<int>, parents array<int>, keys array<long>, nodes array<struct<key: bigint, style: bigint, content: bigint, may_cut: int, below: int>>"
NODE = pa.struct([("key", pa.int64()), ("style", pa.int64()), ("content", pa.int64()), ("may_cut", pa.int32()), ("below", pa.int32())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parsed(rows: DataFrame) -> DataFrame:
    """The columns of `rows` (id, url, host, page, html), without html, and the parts of every page."""
    others = [f for f in rows.schema if f.name != "html"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                pages = [Page(h) for h in part.column("html").to_pylist()]
                nodes = [[{"key": _signed(k), "style": _signed(r[0]), "content": _signed(r[1]), "may_cut": r[2], "below": r[3]} for k, r in p.nodes.items()] for p in pages]
                columns = [pa.array([p.texts for p in pages], pa.list_(pa.string())), pa.array([p.at for p in pages], pa.list_(pa.int32())), pa.array([p.parents for p in pages], pa.list_(pa.int32())), pa.array([[*map(_signed, p.keys)] for p in pages], pa.list_(pa.int64())), pa.array(nodes, pa.list_(NODE))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *columns], [*(f.name for f in others), "texts", "at", "parents", "keys", "nodes"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", " + PARSED)


def importance(nodes: DataFrame) -> DataFrame:
    """Of every (host, key) of (host, page, key, style, content, may_cut, below) rows: pages, entropies, importance, and whether it may be cut."""

    def entropy(column: str, *more) -> DataFrame:
        counts = nodes.groupBy("host", "key", column).agg(F.count("*").alias("c"), F.sum("below").alias("b"), F.min("may_cut").alias("may_cut"))
        sums = counts.groupBy("host", "key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), *more)
        return sums.select("host", "key", "n", *[c for c in sums.columns[4:]], F.when(F.col("n") > 1, 1 - F.col("s") / (F.col("n") * F.log("n"))).otherwise(1.0).alias(f"{column}_entropy"))

    both = entropy("style", F.sum("b").alias("b"), F.min("may_cut").alias("may_cut")).join(entropy("content").drop("n"), ["host", "key"])
    weight = F.pow(F.lit(GAMMA), F.col("b") / F.col("n"))
    both = both.withColumn("importance", (1 - weight) * F.col("style_entropy") + weight * F.col("content_entropy"))
    larger = F.greatest("style_entropy", "content_entropy")
    low = (larger < BOTH_PLAIN) | ((F.col("may_cut") == 2) & ((larger < BOTH) | ((F.col("importance") < IMPORTANCE) & (F.col("content_entropy") < CONTENT))))
    return both.select("host", "key", F.col("n").alias("pages"), "style_entropy", "content_entropy", "importance", ((F.col("may_cut") > 0) & low).alias("low"))


def cuts_of(nodes: DataFrame) -> DataFrame:
    """(page, cut): the keys of the nodes to cut from each page: unimportant ones whose content on it is also that of another page of the host."""
    low = keep(importance(nodes).where("low").select("host", "key"), "low")
    some = nodes.join(bounded(low, BROADCAST_ROWS), ["host", "key"])
    again = keep(some.groupBy("host", "key", "content").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    return some.join(bounded(again, BROADCAST_ROWS), ["host", "key", "content"]).groupBy("page").agg(F.collect_set("key").alias("cut"))  # a page's own nodes at most


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = keep(parsed(rows.withColumn("page", F.xxhash64("host", "html"))), "parsed")
    nodes = keep(rows.select("host", "page", F.explode("nodes").alias("n")).select("host", "page", "n.*").distinct(), "nodes")
    cuts = keep(cuts_of(nodes), "cuts")
    discard(nodes)
    rows = rows.drop("nodes", "host").join(bounded(cuts, BROADCAST_ROWS), "page", "left")

    def texts(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                columns = [part.column(c).to_pylist() for c in ("texts", "at", "parents", "keys", "cut")]
                out = [kept_text(t, a, p, k, frozenset(c or ())) for t, a, p, k, c in zip(*columns)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    out = rows.select("id", "url", "texts", "at", "parents", "keys", "cut").mapInArrow(texts, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
