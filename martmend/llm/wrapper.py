"""HTML extraction by wrapper induction (operator 11): the pages of a host are aligned, what they share is template, what varies
is content.

A page is read into a tree of block elements, in which siblings of one kind (tag, class words and role, without digits) are
folded into one node; the shape of that tree is the page's outline. The distinct outlines of a host are merged into its wrapper
by simple tree matching: children are aligned in order so that as many nodes as possible match, and nodes without partner
are put in between. Every node of a page then has its slot in the wrapper. Spark counts on how many different pages of the host
a block of text stands in a slot.

* A block that stands in a slot on at least ``SHARE`` of the host's pages, and on ``PAGES``, is template, if these pages are no
  copies of each other: ``OWN`` of their text is on no more than two pages of the host. Main headings are no template.
* Of the rest, elements that say themselves what they are (navigation, header, footer, form, advert, comments, ...) go, unless
  they hold the article; so do slots outside the article that are mostly links.
* Content is what stands below ``article`` or ``main`` elements if these have a fair part of the host's varying text, otherwise
  below the deepest node that has most of it; on pages without such a node, all that is left. A heading beside it is kept.

Outlines are merged in salted parts of a host and then those parts, one by one in sorted order, so a task holds a single wrapper and
an outline however many pages a host has. The decisions for outlines are broadcast if their measured size allows it, and joined
otherwise. A host of few pages has no template; its pages are judged by the other rules.

Defined results: html that is null, empty or without text has an empty text; references are decoded, also without semicolon where
HTML allows that; markup that is not closed, or cut off, is read as far as it goes; elements nested deeper than ``DEPTH`` count as
part of the one at that depth; rows that repeat others are extracted like them; rows without url form a host of their own; an
empty table gives no rows; other columns are ignored; a page of any length is one row in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name

SHARE, PAGES, OWN = 0.5, 4, 0.3
#: Parts of a host in which outlines are merged first, depth of a tree, bytes of decisions that are broadcast.
SALTS, DEPTH, BROADCAST = 16, 200, 16 << 20
#: Part of the varying text that article elements must have, and that the deepest node must have; part of links in a menu.
FAIR, MOST, LINKS = 0.25, 0.75, 0.7
#: Marks the content of a main heading.
HEADING = 2

# Element names of HTML by role, and words of class names, ids and roles by which sites mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SKIPPED = frozenset("audio button canvas datalist dialog iframe map math noframes noscript object optgroup option script select style svg template textarea title video".split())
PLAIN = frozenset("html head body".split())
BOILERPLATE = frozenset("aside footer form header menu nav search".split())
ITEMS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
WORDS = frozenset(
    "ad ads adsense advert advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright "
    "dialog discussion disqus foot footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Elements whose text belongs with that of their siblings.
PARTS = frozenset("blockquote dd dt figure h1 h2 h3 h4 h5 h6 li ol p pre td tr ul".split())


@lru_cache(65_536)
def marked(label: str) -> bool:
    """Whether an element's name, classes, id or role say that it is no article."""
    tag, *rest = re.split(r"[^a-z]+", label)
    return tag in BOILERPLATE or any(w in WORDS for w in rest)


@lru_cache(65_536)
def _label(tag: str, kind: str | None, name: str | None, role: str | None) -> str:
    """Tag with classes and role, without digits; an id only if it says what the element is, as most ids name a single element."""
    words = [f".{w}" for w in sorted(set((kind or "").split()))] + [f"#{w}" for w in (name or "").split() if marked(f"#{w.lower()}")] + [f"@{w}" for w in (role or "").split()]
    return tag + re.sub(r"\d+", "", "".join(words).lower())


class Tree:
    """Labels and parents of nodes, children before later siblings; node 0 is the root."""

    def __init__(self) -> None:
        self.labels, self.parents, self.depths = [""], [-1], [0]

    def add(self, parent: int, label: str) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        return len(self.labels) - 1

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for i, p in enumerate(self.parents[1:], 1):
            out[p].append(i)
        return out

    def ordered(self) -> list[int]:
        """Nodes with each one's descendants right behind it."""
        kids, out, stack = self.children(), [], [0]
        while stack:
            out.append(i := stack.pop())
            stack += reversed(kids[i])
        return out

    def text(self) -> str:
        return "\n".join(f"{self.depths[i]} {self.labels[i]}" for i in self.ordered()[1:])

    @classmethod
    def of(cls, text: str) -> Tree:
        tree, path = cls(), [0]
        for line in text.split("\n") if text else ():
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            path.append(tree.add(path[-1], label))
        return tree


class Reader(HTMLParser):
    """Reads a page into its folded tree and its blocks: (node, text, characters of links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.blocks = Tree(), []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.seen: dict[tuple[int, str], int] = {}
        self.words: list[str] = []
        self.links = self.link = 0
        self.skip, self.skips = "", 0

    @classmethod
    def page(cls, html: str | None) -> tuple[str, list[tuple[int, str, int]]]:
        """The page's outline, and its blocks with nodes numbered as there."""
        reader = cls()
        reader.feed(html or "")
        reader.close()
        reader.flush()
        order = reader.tree.ordered()
        number = {old: new for new, old in enumerate(order)}
        return reader.tree.text(), [(number[n], t, links) for n, t, links in reader.blocks]

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, min(self.links, len(text))))
            self.words, self.links = [], 0

    def pop(self, size: int) -> None:
        self.flush()
        del self.stack[size:]
        if self.link > len(self.stack):
            self.link = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            self.skips += tag == self.skip
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            self.words.append(" ")
            return
        if tag in PLAIN:
            return
        has = dict(attrs)
        if tag in SKIPPED or "hidden" in has or re.search(r"display\s*:\s*none", has.get("style") or "", re.I):
            self.words.append(" ")
            self.skip, self.skips = tag, 1
            return
        if tag == "a":
            self.link = len(self.stack)
        label = _label(tag, has.get("class"), has.get("id"), has.get("role"))
        if tag in INLINE and not marked(label):
            return
        self.flush()
        if self.stack[-1][0] == "p":
            self.pop(len(self.stack) - 1)
        if tag in ITEMS:
            same, within = (x.split() for x in ITEMS[tag])
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i][0] in within:
                    break
                if self.stack[i][0] in same:
                    self.pop(i)
                    break
        above = self.stack[-1][1]
        if self.tree.depths[above] >= DEPTH:
            node = above
        elif (node := self.seen.get((above, label))) is None:
            node = self.seen[above, label] = self.tree.add(above, label)
        self.stack.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.skips -= 1
                if not self.skips:
                    self.skip = ""
                return
            if tag in INLINE or all(t != tag for t, _ in self.stack):
                return
            self.skip = ""  # left open inside an element that ends here
        if tag == "a":
            self.link = 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return
        if tag == "p":
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.words.append(data)
            if self.link:
                self.links += len(data.strip())


def aligned(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the node of a for each node of b, with as many pairs as possible, parents and order kept."""
    kids_a, kids_b = a.children(), b.children()
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(x: int, y: int) -> int:
        """The number of pairs when x and y are paired."""
        if (x, y) in known:
            return known[x, y][0]
        left, right = kids_a[x], kids_b[y]
        best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left, 1):
            for j, q in enumerate(right, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1])
                if a.labels[p] == b.labels[q]:
                    best[i][j] = max(best[i][j], best[i - 1][j - 1] + match(p, q))
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        known[x, y] = 1 + best[-1][-1], pairs
        return known[x, y][0]

    match(0, 0)
    out, stack = {}, [(0, 0)]
    while stack:
        x, y = stack.pop()
        out[y] = x
        stack += known[x, y][1]
    return out


def merged(a: Tree, b: Tree) -> Tree:
    """A tree that holds both, with what is aligned once; b's other nodes stand behind their aligned sibling on the left."""
    to = aligned(a, b)
    kids_a, kids_b = a.children(), b.children()
    partner = {x: y for y, x in to.items()}
    out = Tree()
    # Depth first, so that children stand before later siblings.
    todo: list[tuple[int, int | None, int | None]] = [(-1, 0, 0)]
    while todo:
        parent, x, y = todo.pop()
        node = 0 if parent < 0 else out.add(parent, a.labels[x] if x is not None else b.labels[y])
        left, right = kids_a[x] if x is not None else [], kids_b[y] if y is not None else []
        row: list[tuple[int, int | None, int | None]] = []
        j = 0
        for p in left:
            q = partner.get(p) if y is not None else None
            if q is not None and q in right:
                at = right.index(q)
                row += [(node, None, r) for r in right[j:at]]
                j = at + 1
            row.append((node, p, q))
        row += [(node, None, r) for r in right[j:]]
        todo += reversed(row)
    return out


def left_out(tree: Tree) -> list[bool]:
    """For each node whether it, or one above it, says that it is no article.

    Class words of what holds an article element don't count, nor does a form around one or around a main heading, nor a header
    inside an article; comments and navigation are left out whatever they hold.
    """
    own, tags = [marked(label) for label in tree.labels], [_tag(label) for label in tree.labels]
    article = [tag in ("article", "main") and not mark for tag, mark in zip(tags, own, strict=True)]
    heading = [tag == "h1" for tag in tags]
    for i in range(len(tags) - 1, 0, -1):
        article[tree.parents[i]] |= article[i]
        heading[tree.parents[i]] |= heading[i]
    out, inside = [False] * len(tags), [False] * len(tags)
    for i in range(1, len(tags)):
        up = tree.parents[i]
        inside[i] = inside[up] or (tags[i] in ("article", "main") and not own[i])
        fixed = tags[i] in ("aside", "footer", "header", "menu", "nav") or any(w in COMMENTS for w in re.split(r"[^a-z]+", tree.labels[i]))
        spared = (article[i] and not fixed) or (tags[i] == "form" and heading[i]) or (tags[i] == "header" and inside[up])
        out[i] = out[up] or (own[i] and not spared)
    return out


@lru_cache(65_536)
def _tag(label: str) -> str:
    return re.split(r"[.#@]", label, maxsplit=1)[0]


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def decided(outline: Tree, slots: list[int], wrapper: Tree, stats: dict[int, tuple[int, int, int]]) -> list[int]:
    """For each node of an outline whether its text is content (1, or HEADING), by the host's wrapper and each slot's (characters, of links, of template)."""
    gone = left_out(outline)
    varying = [0] * len(wrapper.labels)
    for n, (chars, links, same) in stats.items():
        varying[n] = max(0, chars - links - same)
    below = varying[:]
    for i in range(len(below) - 1, 0, -1):
        below[wrapper.parents[i]] += below[i]
    root = None
    for tag in ("article", "main"):
        named = [i for i, label in enumerate(wrapper.labels) if _tag(label) == tag and not marked(label)]
        top = [i for i in named if not any(_above(wrapper, j, i) for j in named)]
        if top and sum(below[i] for i in top) >= FAIR * below[0]:
            root = set(top)
            break
    semantic = root is not None
    if root is None:
        deepest = 0
        while kids := [i for i, p in enumerate(wrapper.parents) if p == deepest and below[i] >= MOST * below[0] > 0]:
            deepest = kids[0]
        while _tag(wrapper.labels[deepest]) in PARTS:
            deepest = wrapper.parents[deepest]
        root = {deepest}
    inside = [False] * len(outline.labels)
    for i, n in enumerate(slots):
        inside[i] = n in root or (i > 0 and inside[outline.parents[i]])
    menu = [(s := stats.get(n)) is not None and s[1] >= LINKS * s[0] for n in slots]
    kept = [inside[i] and not gone[i] and (semantic or not menu[i]) for i in range(len(slots))]
    if not any(kept[i] and slots[i] in stats for i in range(len(slots))):
        return [int(not gone[i] and not menu[i]) for i in range(len(slots))]
    heading = [_tag(label) == "h1" and not out for label, out in zip(outline.labels, gone, strict=True)]
    if not any(k and h for k, h in zip(kept, heading, strict=True)):
        kept = [k or h for k, h in zip(kept, heading, strict=True)]
    return [HEADING if k and h else int(k) for k, h in zip(kept, heading, strict=True)]


def _above(tree: Tree, upper: int, node: int) -> bool:
    while node > 0:
        node = tree.parents[node]
        if node == upper:
            return True
    return False


def _facts(pages: DataFrame) -> DataFrame:
    """A row for each outline of a task (outline), and one for each block outside of elements that are left out (node, block, version of the page)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, list[bool]]] = {}
        told: set[tuple[str, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, blocks = Reader.page(html)
                if text not in known:
                    if len(known) > 4096:
                        known.clear()
                        told.clear()
                    known[text] = digest(text), left_out(Tree.of(text))
                number, gone = known[text]
                if (host, number) not in told:
                    told.add((host, number))
                    out.append((host, number, text, None, None, None, None, None))
                blocks = [b for b in blocks if not gone[b[0]]]
                hashes = [digest(t) for _, t, _ in blocks]
                version = xxhash.xxh3_64_intdigest(repr((number, hashes))) - (1 << 63)
                out += [(host, number, None, n, h, version, len(t), links) for h, (n, t, links) in zip(hashes, blocks, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], ["host", "number", "outline", "node", "block", "version", "chars", "links"])

    return pages.select("host_", "html_").mapInArrow(read, "host string, number long, outline string, node int, block long, version long, chars long, links long")


def _folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, tree) with all trees of equal keys merged into one."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, Tree()
        names = [*keys, "tree"]
        for batch in batches:
            for r in batch.to_pylist():
                own = tuple(r[k] for k in keys)
                if own != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, tree.text()), strict=True))], schema=batch.schema)
                    key, tree = own, Tree.of(r["tree"])
                else:
                    tree = merged(tree, Tree.of(r["tree"]))
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, tree.text()), strict=True))], schema=batch.schema)

    rows = rows.select(*keys, "tree")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "tree").mapInArrow(fold, rows.schema)


def wrappers(outlines: DataFrame) -> DataFrame:
    """host and tree: the wrapper of each host, from its distinct outlines (host, number, outline)."""
    salted = outlines.select("host", F.pmod("number", F.lit(SALTS)).alias("salt"), F.col("outline").alias("tree"))
    return _folded(_folded(salted, ["host", "salt"]), ["host"])


def _slots(outlines: DataFrame, of: DataFrame) -> DataFrame:
    """host, number, outline, tree (the wrapper) and slots: for each node of an outline its node in the wrapper."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for outline, tree in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                to = aligned(Tree.of(tree), own := Tree.of(outline))
                out.append([to[i] for i in range(len(own.labels))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], ["host", "number", "outline", "tree", "slots"])

    return outlines.join(of, "host").select("host", "number", "outline", "tree").mapInArrow(place, "host string, number long, outline string, tree string, slots array<int>")


def rules(pages: DataFrame) -> DataFrame:
    """host, number, kept (a flag for each node of the outline) and template (hashes of blocks), of all outlines of pages (host_, html_)."""
    facts = cut(_facts(pages), "wrapper-facts")
    outlines = cut(facts.where("outline is not null").groupBy("host", "number").agg(F.min("outline").alias("outline")), "wrapper-outlines")
    slots = cut(_slots(outlines, cut(wrappers(outlines), "wrapper-trees")), "wrapper-slots")
    # One outline, and one block, may be on most pages, so what is joined to them is dealt to several tasks.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    rows = facts.where("node is not null").groupBy("host", "number", "node", "block", "version").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    rows = rows.withColumn("salt", F.pmod("version", F.lit(SALTS))).join(slots.select("host", "number", "slots", salts.alias("salt")), ["host", "number", "salt"])
    blocks = cut(rows.select("host", F.get("slots", F.col("node")).alias("slot"), "block", "version", "chars", "links", "salt"), "wrapper-blocks")
    held = blocks.select("host", "slot", "version").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("versions"))
    often = blocks.groupBy("host", "slot", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("same")).where(F.col("n") >= PAGES)
    often = cut(often.join(held, ["host", "slot"]).where(F.col("n") >= SHARE * F.col("versions")), "wrapper-often")
    # Pages that share most of their text with others are copies, and show no template.
    common = blocks.groupBy("host", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("host", "block", salts.alias("salt"), F.lit(True).alias("common"))
    own = blocks.join(common, ["host", "block", "salt"], "left").groupBy("host", "version").agg(F.sum(F.when(F.col("common"), 0).otherwise(F.col("chars"))).alias("own"), F.sum("chars").alias("all"))
    shown = blocks.join(often.select("host", "slot", "block", salts.alias("salt")), ["host", "slot", "block", "salt"]).select("host", "slot", "block", "version").join(own, ["host", "version"])
    shown = shown.groupBy("host", "slot", "block").agg(F.sum("own").alias("own"), F.sum("all").alias("all")).where(F.col("own") >= OWN * F.col("all"))
    template = cut(often.join(shown, ["host", "slot", "block"]).select("host", "slot", "block", "same"), "wrapper-template")
    figures = blocks.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    figures = figures.join(template.groupBy("host", "slot").agg(F.sum("same").alias("same")), ["host", "slot"], "left")
    stats = figures.groupBy("host").agg(F.collect_list(F.struct("slot", "chars", "links", F.coalesce("same", F.lit(0)).alias("same"))).alias("stats"))
    constants = template.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("template"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [decided(Tree.of(r["outline"]), r["slots"], Tree.of(r["tree"]), {s["slot"]: (s["chars"], s["links"], s["same"]) for s in r["stats"] or ()}) for r in batch.select(["outline", "slots", "tree", "stats"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("number"), pa.array([bytes(k) for k in kept], pa.binary()), batch.column("template")], ["host", "number", "kept", "template"])

    known = slots.join(stats, "host", "left").join(constants, "host", "left")
    return known.mapInArrow(decide, "host string, number long, kept binary, template array<long>")


def _content(html: str | None, rule) -> str:
    text, blocks = Reader.page(html)
    kept, template = rule(digest(text))
    return " ".join(t for n, t, _ in blocks if kept[n] and not (template and kept[n] != HEADING and digest(t) in template))


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with the column ``out``: the main text of each row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    given = pages.withColumn("host_", host).withColumn("html_", F.col(html))
    held = cut(rules(given), "wrapper-rules")
    size = held.agg(F.sum(F.length("host") + 8 + F.length("kept") + 8 * F.greatest(F.size("template"), F.lit(0)))).first()[0] or 0
    key = free_name(given, "key_")
    if size <= BROADCAST:
        rows = held.toArrow()
        known = {(h, n): (k, set(t or ())) for h, n, k, t in zip(*(rows[c].to_pylist() for c in ("host", "number", "kept", "template")), strict=True)}
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules = shared.value
            for batch in batches:
                rows = zip(batch.column("host_").to_pylist(), batch.column("html_").to_pylist(), strict=True)
                text = [_content(h, lambda number, host=host: rules[host, number]) for host, h in rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, out])

        source = given
    else:

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = [digest(Reader.page(h)[0]) for h in batch.column("html_").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, key])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(batch.column("html_").to_pylist(), batch.column("kept").to_pylist(), batch.column("template").to_pylist(), strict=True)
                text = [_content(h, lambda _, k=k, t=t: (k, set(t or ()))) for h, k, t in rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(text, pa.string())], [*keep, out])

        numbered = given.mapInArrow(number, T.StructType([*given.schema, T.StructField(key, T.LongType())]))
        source = numbered.join(held.withColumnsRenamed({"host": "host_", "number": key}), ["host_", key])
    keep = [c for c in pages.columns if c != out]
    return source.mapInArrow(read, T.StructType([*pages.select(*keep).schema, T.StructField(out, T.StringType())]))
