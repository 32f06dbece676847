"""Main text of web pages by wrapper induction.

Pages are parsed into DOM trees in which runs of equal siblings are one node. Trees of the same host are aligned by
simple tree matching into one template per host; a node whose text is the same on most pages is template, a node whose
text varies is a slot. The slots of the template's main region are the content.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, col, saved, without

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag of the key's element ends an open element of the value's names (up to the nearest scope element).
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()},
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
SCOPE = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tbody": frozenset(("table",)), "tfoot": frozenset(("table",))}
#: Elements that never hold article text.
NOT_CONTENT = frozenset("head nav header footer aside form script style noscript template iframe svg canvas object button select textarea input label dialog menu title".split())
#: Words of a class, id or role that name something else than the article.
NOT_CONTENT_WORDS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification alert pagination popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored sponsor subscribe subscription toolbar warning widget widgets".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
#: Words that bar a region, but name a layout beside words such as MARKS ("layout with-sidebar").
LAYOUT_WORDS = frozenset("banner footer header menu nav navbar navigation sidebar toolbar".split())
MARKS = frozenset("body container content grid has layout page site with without wrapper".split())

#: Shapes that are joined by broadcast at most.
FEW = 4096

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


def label_of(tag: str, attrs: str) -> str:
    """Tag and the words of its class, id and role (without digits), which is what nodes are compared by.

    Of more than 12 words, those that tell the region stay, and a hash stands for the whole set."""
    words: list[str] = []
    tag = re.sub(r"[(),.]", "", tag)
    if "=" in attrs:
        for _, a, b, c in _ATTR.findall(attrs):
            words += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", entities.unescape(a or b or c)).lower())
    told = sorted(set(words))
    if len(told) > 12:
        told = [w for w in told if w == "main" or w in NOT_CONTENT_WORDS] + ["~" + xxhash.xxh64_hexdigest(" ".join(told))]
    return ".".join([tag, *told])


@dataclass
class Node:
    """A node of a collapsed tree or of a template; the numbers sum up the node's own text over pages."""

    label: str
    children: list["Node"] = field(default_factory=list)
    paths: list[tuple[str, str]] = field(default_factory=list)
    pages: int = 0
    same: int = 0
    chars: int = 0
    linked: int = 0
    mass: int = 0
    lifted: bool = False

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]

    @property
    def barred(self) -> bool:
        return not self.lifted and (self.tag in NOT_CONTENT or (self.tag not in ("html", "body") and not NOT_CONTENT_WORDS.isdisjoint(self.label.split(".")[1:])))

    @property
    def layout(self) -> bool:
        """Barred, but only as a form around the page or by words that describe its layout."""
        words = set(self.label.split(".")[1:])
        told = words & NOT_CONTENT_WORDS
        return told <= LAYOUT_WORDS and (self.tag == "form" or (self.tag not in NOT_CONTENT and bool(told) and not MARKS.isdisjoint(words)))

    @property
    def fixed(self) -> bool:
        """Template text: the same on more than half of at least three different pages, whatever their shapes."""
        return self.pages >= 3 and 2 * self.same > self.pages

    @property
    def certain(self) -> bool:
        """Template text even inside an article: no heading, and the same on nine in ten of at least ten different pages."""
        return self.pages >= 10 and 10 * self.same >= 9 * self.pages and self.tag not in HEADINGS


class Page:
    """Parses one page: ``shape`` (the collapsed tree as text) and ``blocks`` in page order: (path, text, linked characters)."""

    def __init__(self, source: str):
        self.labels, self.kids, self.up = ["#"], [[]], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.run: list[str] = []
        self.run_at, self.run_linked = 0, 0
        self.parse(source)
        self.flush()
        number = [0] * len(self.labels)
        self.shape = self.write(number)
        self.out = [(str(number[k]), t, n) for k, t, n in self.blocks]
        out = self.outside()
        self.about = max((t for k, t, _ in self.blocks if not out[k]), key=lambda t: (len(t), t), default="")

    def outside(self) -> list[bool]:
        """Whether a node that can't be content holds each node, below the nearest article or main element."""
        out = [False] * len(self.labels)
        for k in range(1, len(out)):  # parents come before their children
            own = Node(self.labels[k])
            out[k] = own.barred or (own.tag not in REGIONS and out[self.up[k]])
        return out

    def write(self, number: list[int]) -> str:
        """The shape; ``number`` gets the place of each node in it, from 1 in document order, which is its path."""
        parts: list[str] = []
        stack, met = [0], 0
        while stack:
            n = stack.pop()
            if n < 0:
                parts.append(")")
                continue
            if n:
                met += 1
                number[n] = met
                parts.append(self.labels[n])
            if self.kids[n]:
                parts.append("(")
                stack += [-1, *self.kids[n][::-1]]
            elif n:
                parts.append(",")
        return "".join(parts)

    def child(self, at: int, label: str) -> int:
        kids = self.kids[at]
        if kids and self.labels[kids[-1]] == label:
            return kids[-1]
        self.labels.append(label)
        self.kids.append([])
        self.up.append(at)
        kids.append(len(self.labels) - 1)
        return kids[-1]

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            if text:
                self.blocks.append((self.run_at, text, self.run_linked))
            self.run, self.run_linked = [], 0

    def parse(self, s: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]  # open elements: tag and the block node they are in
        links = pos = 0

        def text(t: str) -> None:
            if not self.run:
                if not t or t.isspace():
                    return
                self.run_at = stack[-1][1]
            self.run.append(t)
            if links:
                self.run_linked += len(t)

        def drop(k: int) -> None:
            nonlocal links
            for (tag, at), (_, around) in zip(stack[k:], stack[k - 1 :]):
                if tag == "a":
                    links -= 1
                if at != around:  # a node of the tree ends
                    self.flush()
            del stack[k:]

        while pos < len(s):
            lt = s.find("<", pos)
            if lt < 0:
                text(s[pos:])
                break
            m = _TOKEN.match(s, lt)
            if not m:  # a bare "<"
                text(s[pos : lt + 1])
                pos = lt + 1
                continue
            if lt > pos:
                text(s[pos:lt])
            pos = m.end()
            if s.startswith("<![CDATA[", lt):
                text(entities.escape(s[lt + 9 : pos].removesuffix("]]>")))
                continue
            name = m[2] or m[5]
            if not name:
                continue
            tag, attrs, closing = name.lower(), m[3] or m[6] or "", m[1] or m[4]
            if closing:
                if tag == "br" or (tag == "p" and not any(t == "p" for t, _ in stack)):
                    self.run and text(" ")
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        drop(k)
                        break
                    if stack[k][0] in ("table", "td", "th") and tag not in BLOCK:
                        break
                continue
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if t in CLOSES.get(tag, ()):
                    drop(k)
                    if tag not in ("tr", "tbody", "tfoot", "optgroup"):
                        break
                elif t in SCOPE.get(tag, ()) or (tag not in SCOPE and t in ("td", "th", "table", "button", "li", "dd", "div", "section", "article", "body")):
                    break
            if tag == "br":
                self.run and text(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    self.flush()
                continue
            if tag in RAW:  # its content isn't markup, and never article text
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(s, pos)
                shut = s.find(">", end.start()) if end else -1
                pos = shut + 1 if shut >= 0 else len(s)
                continue
            if tag == "a":
                links += 1
            if tag in BLOCK or tag in NOT_CONTENT:
                self.flush()
                label = label_of(tag, attrs)
                if tag in ("html", "body") and any(t == tag for t, _ in stack):
                    continue
                stack.append((tag, self.child(stack[-1][1], label)))
            else:
                label = label_of(tag, attrs)
                if not NOT_CONTENT_WORDS.isdisjoint(label.split(".")[1:]):  # an inline advert or the like is a node, too
                    self.flush()
                    stack.append((tag, self.child(stack[-1][1], label)))
                else:
                    stack.append((tag, stack[-1][1]))
            if attrs.endswith("/") and tag not in BLOCK:
                drop(len(stack) - 1)


def read_shape(shape: str) -> Node:
    """The tree that Page.write wrote."""
    root = Node("#")
    stack, last, word = [], root, []

    def leaf() -> None:
        nonlocal last
        if word:
            last = Node("".join(word))
            stack[-1].children.append(last)
            word.clear()

    for ch in shape:
        if ch == "(":
            leaf()
            stack.append(last)
        elif ch == ")":
            leaf()
            last = stack.pop()
        elif ch == ",":
            leaf()
        else:
            word.append(ch)
    return root


def match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the size of the largest order-keeping match of two trees with equal root labels."""
    if a.label != b.label:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + table(a, b, memo)[-1][-1]
    return memo[key]


def table(a: Node, b: Node, memo: dict) -> list[list[int]]:
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y, memo))
    return m


def align(a: Node, b: Node, memo: dict | None = None) -> None:
    """Merge tree ``b`` into the template ``a``: matched nodes share their paths, the others are put in between."""
    memo = {} if memo is None else memo
    a.paths += b.paths
    m = table(a, b, memo)
    i, j, out = len(a.children), len(b.children), []
    while i or j:
        if i and j and (w := match(a.children[i - 1], b.children[j - 1], memo)) and m[i][j] == m[i - 1][j - 1] + w:
            align(a.children[i - 1], b.children[j - 1], memo)
            out.append(a.children[i - 1])
            i, j = i - 1, j - 1
        elif i and m[i][j] == m[i - 1][j]:
            out.append(a.children[i - 1])
            i -= 1
        else:
            out.append(b.children[j - 1])
            j -= 1
    a.children = out[::-1]


def weigh(root: Node) -> None:
    """Set each node's mass: the varying text below it that isn't mostly links, none below a barred node."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    for n in reversed(order):  # children come before their parents
        own = 0 if n.fixed or 2 * n.linked > n.chars else n.chars
        n.mass = 0 if n.barred else own + sum(c.mass for c in n.children)


def lift(root: Node) -> None:
    """Lifts bars that can't be meant for the article: of a layout or a form around it, and of the header, with a heading, inside it."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    holds: set[int] = set()  # nodes that hold an article or main element, or a heading (negative)
    for n in reversed(order):  # children come before their parents
        bar = n.barred
        if n.tag in HEADINGS or any(-id(c) in holds for c in n.children):
            holds.add(-id(n))
        if any(id(c) in holds for c in n.children):
            n.lifted = bar and n.layout
            bar = bar and not n.lifted
            if not bar:
                holds.add(id(n))
        if n.tag in REGIONS and not bar:
            holds.add(id(n))
            for c in n.children:
                if c.barred and -id(c) in holds and set(c.label.split(".")[1:]) & NOT_CONTENT_WORDS <= {"header"} and (c.tag == "header" or c.tag not in NOT_CONTENT):
                    c.lifted = True


def content_nodes(root: Node) -> list[Node]:
    """The slots of the main region: of the article or main elements, else of the deepest node with most of the varying text.

    An element that says itself that it is the article loses a slot only if that is certain to be template."""
    lift(root)
    weigh(root)
    named: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.barred:
            continue
        if n.tag in ("article", "main") or "main" in n.label.split(".")[1:]:
            if n.mass:
                named.append(n)
            continue
        stack += n.children[::-1]
    trusted = bool(named)
    if not named:
        n = root
        while root.mass and (best := max(n.children, key=lambda c: c.mass, default=None)) and 2 * best.mass > root.mass and best.children:
            n = best
        named = [n] if root.mass else []
    out: list[Node] = []
    stack = named[::-1]
    while stack:
        n = stack.pop()
        if n.barred:
            continue
        if n.chars and (not n.certain if trusted else not n.fixed and 2 * n.linked <= n.chars):
            out.append(n)
        stack += n.children[::-1]
    return out


def depth(root: Node) -> int:
    deep, level = 0, [root]
    while level:
        deep, level = deep + 1, [c for n in level for c in n.children]
    return deep


def nodes_by_path(root: Node) -> Iterator[tuple[str, Node]]:
    """Each node with its path: its place in document order."""
    stack, k = [root], 0
    while stack:
        n = stack.pop()
        yield str(k), n
        k += 1
        stack += n.children[::-1]


def host_template(shapes: list[str]) -> Node:
    """Align a host's shapes; every node has the (shape, path) pairs that met in it."""
    root, most = None, sys.getrecursionlimit()
    for shape in shapes:
        tree = read_shape(shape)
        # matching recurses by two frames of Python a level, which take no room on the machine's own stack
        most = max(most, 4 * depth(tree) + 1000)
        if most > sys.getrecursionlimit():
            sys.setrecursionlimit(most)
        for p, n in nodes_by_path(tree):
            n.paths.append((shape, p))
        if root is None:
            root = tree
        else:
            align(root, tree)
    return root


def write_shape(root: Node) -> str:
    """The text that read_shape reads."""
    parts: list[str] = []
    stack: list = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        if n is not root:
            parts.append(n.label)
        if n.children:
            parts.append("(")
            stack += [")", *n.children[::-1]]
        elif n is not root:
            parts.append(",")
    return "".join(parts)


OWN = ("host", "shape", "about", "blocks")
_BLOCKS = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("linked", T.IntegerType())]))


def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep=None) -> DataFrame:
    """Append host (lower case, empty if none), shape, about (hash of the longest block that may be content) and blocks."""
    keep = pages.columns if keep is None else keep

    def make():
        def run(texts):
            got = [Page(t or "") for t in texts]
            return {"shape": [g.shape for g in got], "about": [xxhash.xxh64_intdigest(g.about) - (1 << 63) for g in got], "blocks": [[{"path": p, "text": t, "linked": n} for p, t, n in g.out] for g in got]}

        return run

    host = F.coalesce(F.lower(F.regexp_extract(col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = without(pages, ["host"]).withColumn("host", host)
    return append_columns(named, html_col, make, [T.StructField("shape", T.StringType()), T.StructField("about", T.LongType()), T.StructField("blocks", _BLOCKS)], [*[k for k in keep if k.lower() not in OWN], "host"], most=2 << 20)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, shape, paths: which slots of a shape hold content. Pages of a host and shape that share their longest block, as
    copies and near copies do, count once.

    A host's pages never meet in one task: its distinct shapes do, to be aligned into the template, and then the sums of
    the template's slots. Texts are counted between the two, over all shapes that meet in a slot.
    """
    brief = F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("h"), F.length(b["text"]).alias("chars"), b["linked"].alias("linked")))
    one = pages.select("host", "shape", "about", brief.alias("brief"), F.xxhash64("blocks").alias("page")).groupBy("host", "shape", "about").agg(F.min(F.struct("page", "brief")).alias("p"))
    slot = one.select("host", "shape", "about", F.explode("p.brief").alias("b")).groupBy("host", "shape", "about", F.col("b.path").alias("path"))
    texts = slot.agg(F.bit_xor("b.h").alias("h"), F.sum("b.chars").alias("chars"), F.sum("b.linked").alias("linked"))
    each = saved(texts.groupBy("host", "shape", "path", "h").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "texts")
    by_path = each.groupBy("host", "shape", "path").agg(F.sum("n").alias("pages"))
    by_shape = by_path.groupBy("host", "shape").agg(F.max("pages").alias("pages"), F.collect_list("path").alias("own"))

    def induce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "shape"], ascending=[False, True])
        root = host_template(list(rows["shape"]))
        own = {s: set(p) for s, p in zip(rows["shape"], rows["own"])}
        slots: dict[str, dict[str, int]] = {s: {} for s in own}
        for k, (_, n) in enumerate(nodes_by_path(root)):
            for shape, path in n.paths:
                if path in own[shape]:
                    slots[shape][path] = k
        return pd.DataFrame({"host": rows["host"].iloc[0], "shape": list(slots), "slots": list(slots.values()), "template": [write_shape(root)] + [None] * (len(slots) - 1)})

    aligned = saved(by_shape.groupBy("host").applyInPandas(induce, "host string, shape string, slots map<string, int>, template string"), "aligned")
    at = aligned.select("host", "shape", "slots")
    placed = each.join(F.broadcast(at) if aligned.count() <= FEW else at, ["host", "shape"]).select("host", F.element_at("slots", F.col("path")).alias("slot"), "h", "n", "chars", "linked")
    counted = placed.groupBy("host", "slot", "h").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "linked")])
    stats = counted.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("same"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    by_host = stats.groupBy("host").agg(F.to_json(F.collect_list(F.struct("slot", "pages", "same", "chars", "linked"))).alias("sums"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for rows in batches:
            kept = []
            for template, sums in zip(rows["template"], rows["sums"]):
                root = read_shape(template)
                nodes = [n for _, n in nodes_by_path(root)]
                number = {id(n): k for k, n in enumerate(nodes)}
                for s in json.loads(sums):
                    n = nodes[s["slot"]]
                    n.pages, n.same, n.chars, n.linked = s["pages"], s["same"], s["chars"], s["linked"]
                kept.append([number[id(n)] for n in content_nodes(root)])
            yield pd.DataFrame({"host": rows["host"], "kept": kept})

    chosen = aligned.filter("template IS NOT NULL").select("host", "template").join(by_host, "host").mapInPandas(choose, "host string, kept array<int>")
    return at.join(chosen, "host").select("host", "shape", F.map_keys(F.map_filter("slots", lambda p, k: F.array_contains("kept", k))).alias("paths"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep=None) -> DataFrame:
    """Append text (main text, blocks joined by newlines, empty if none) and n_chars (its code points) to every page.

    Null html is empty and gives an empty text; null or odd urls share the host "". Pages of a host with fewer than
    three different pages have no fixed nodes: the element names and the region alone decide. Repeated pages give
    repeated rows; columns named text or n_chars are replaced, ones named host, shape, about or blocks are dropped. Elements
    may be nested without a bound. A bar on a form or a layout around an article or main element doesn't reach into it, and a
    header with a heading inside one is its own.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars", *OWN)]
    read = saved(parsed(pages, url_col, html_col, keep), "pages")
    rules = saved(wrappers(read), "wrappers")
    joined = read.join(F.broadcast(rules) if rules.count() <= FEW else rules, ["host", "shape"], "left")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("paths", b["path"])), lambda b: b["text"]), "\n")
    done = joined.withColumn("text", F.coalesce(F.when(F.col("paths").isNotNull(), text), F.lit("")))
    return done.select(*[col(c) for c in keep], "text", F.length("text").cast("long").alias("n_chars"))
