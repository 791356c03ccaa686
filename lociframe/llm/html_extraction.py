"""Main text of web pages by wrapper induction.

1. A host's first page is its wrapper: a DOM tree whose nodes are numbered.
2. Every page of the host is aligned with the wrapper by simple tree matching, exactly, however long its lists are. For each
   wrapper node, the texts of its partners are counted over all pages.
3. Nodes whose partners nearly all have one text are template, and so are, outside what a page marks as its article, those
   whose partners repeat a stock of texts, as rotating notices do. The others are slots; a slot's text is content unless the
   slot is labelled as menu, header, footer, sidebar, notice, advert, form or comment section.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import lean, materialise

MIN_PAGES, SAME_SHARE = 5, 0.9  # a node is template if it was met in so many contents, with the same text in this share
BROADCAST_BYTES = 32_000_000  # wrappers of all hosts together are broadcast up to this size, else joined by shuffling
REPEATING = 10  # a node whose partners in so many contents have half as many texts or fewer repeats a stock of them
SMALL, CELLS = 256, 4_000_000  # child pairs up to which plain Python is the faster; up to which the whole table is held
SHAPES = 100_000  # shapes and pairs of them that a worker remembers for a wrapper

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
NEVER_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video button select option textarea input datalist dialog form fieldset nav aside footer menu title noembed noframes xmp".split())
NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widgets?|search|pagination|pager|skip|toolbar|copyright|legal|disclaimer|tags|toc)(?:$|[\s_-])",
    re.I,
)
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Node:
    __slots__ = ("drop", "key", "parts", "shape", "tag", "text")

    def __init__(self, tag: str, key: str = "", drop: bool = False):
        self.tag, self.key, self.drop, self.parts, self.text, self.shape = tag, key or tag, drop, [], None, -1

    def kids(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]


def parse(page: str) -> Node:
    """DOM tree of a page; wrong nesting and missing end tags are mended the usual way."""
    root = Node("#root")
    stack, at = [root], 0
    lower = None
    n_open: Counter = Counter()

    def close(d: int) -> None:
        n_open.subtract(x.tag for x in stack[d:])
        del stack[d:]

    scan = TOKEN.search
    while at < len(page):
        m = scan(page, at)
        if not m:
            stack[-1].parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if not n_open[tag]:
                continue
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    close(d)
                    break
                if tag in INLINE and stack[d].tag not in INLINE and stack[d].tag != "p":
                    break  # an inline end tag does not end a block
            continue
        if tag in CLOSES_P:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    close(d)
                    break
                if stack[d].tag not in INLINE:
                    break
        if tag in CLOSED_BY:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in SCOPE[tag]:
                    break
                if stack[d].tag in CLOSED_BY[tag]:
                    close(d)
                    if tag in ("li", "dt", "dd", "option"):
                        break
        attrs = m["attrs"]
        key, drop = tag, tag in NEVER_TEXT
        if attrs and not attrs.isspace():
            own = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attrs)}
            name = f"{own.get('class', '')} {own.get('id', '')}"
            key = f"{tag}.{own.get('class', '')}"
            if tag not in ("html", "body", "main", "article"):
                drop = drop or bool(NOT_CONTENT.search(name)) or own.get("role", "").lower() in NOT_CONTENT_ROLES
            elif tag == "article":
                drop = bool(re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|respond)(?:$|[\s_-])", name, re.I))
            drop = drop or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I))
        node = Node(tag, key, drop)
        stack[-1].parts.append(node)
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at)
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
        elif tag not in VOID and not (attrs or "").rstrip().endswith("/"):
            stack.append(node)
            n_open[tag] += 1
    return root


def text_of(node: Node) -> str:
    """All text below a node, white space made one space."""
    if node.text is None:
        out: list[str] = []
        _text(node, out, lambda n: False)
        node.text = " ".join("".join(out).split())
    return node.text


def _text(node: Node, out: list[str], skip) -> None:
    todo: list = [node.parts[::-1]]
    while todo:
        if not todo[-1]:
            todo.pop()
            continue
        x = todo[-1].pop()
        if isinstance(x, str):
            out.append(x)
        elif not skip(x):
            parts = x.parts[::-1]
            if x.tag not in INLINE:
                out.append(" ")
                parts.insert(0, " ")
            todo.append(parts)


def _runs(kids: list[Node]) -> list[list[Node]]:
    """Neighbours of one kind as one run, so that lists and paragraphs align as a whole."""
    out: list[list[Node]] = []
    for k in kids:
        if out and out[-1][0].key == k.key:
            out[-1].append(k)
        else:
            out.append([k])
    return out


class Shapes:
    """Simple tree matching over shapes: subtrees of equal keys have one number, and each pair of shapes is matched once.

    Lists of children align as lists of runs by dynamic programming. Rows of the table are numpy arrays; of a table above
    CELLS only two rows are held, and the alignment is put together from the halves of the longer list.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.shape_ids: dict[tuple, int] = {}
        self.runs: list[tuple[int, ...]] = []  # of each shape's children
        self.keys: list[str] = []
        self.run_ids: dict[tuple, int] = {}
        self.members: list[tuple[int, ...]] = []  # shapes in a run
        self.best: dict[tuple[int, int], int] = {}  # by pairs of shapes
        self.weights: dict[tuple[int, int], int] = {}  # by pairs of runs

    def full(self) -> bool:
        return len(self.shape_ids) + len(self.best) + len(self.weights) > SHAPES

    def read(self, root: Node) -> None:
        """Number the shapes of a tree's nodes."""
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.kids()
        for node in reversed(order):
            runs, kids = [], node.kids()
            for r in _runs(kids) if kids else ():
                own = tuple(x.shape for x in r)
                if own not in self.run_ids:
                    self.run_ids[own] = len(self.members)
                    self.members.append(own)
                runs.append(self.run_ids[own])
            shape = node.key, tuple(runs)
            if shape not in self.shape_ids:
                self.shape_ids[shape] = len(self.runs)
                self.runs.append(shape[1])
                self.keys.append(node.key)
            node.shape = self.shape_ids[shape]

    def _same(self, x: int, y: int) -> bool:
        return self.keys[self.members[x][0]] == self.keys[self.members[y][0]]

    def match(self, a: int, b: int) -> int:
        """The most pairs of nodes in order-preserving, top-down agreement of two shapes."""
        if self.keys[a] != self.keys[b]:
            return 0
        todo = [(a, b)]
        while todo:  # not by recursion: pages nest as deep as they like
            p, q = todo[-1]
            if (p, q) not in self.best:
                new = [(x, y) for x in set(self.runs[p]) for y in set(self.runs[q]) if (x, y) not in self.weights and self._same(x, y)]
                need = [uv for x, y in new for uv in set(zip(self.members[x], self.members[y], strict=False)) if uv not in self.best]
                if need:
                    todo += need
                    continue
                for x, y in new:
                    self.weights[x, y] = sum(self.best[uv] for uv in zip(self.members[x], self.members[y], strict=False))
                self.best[p, q] = 1 + self._score(self.runs[p], self.runs[q])
            todo.pop()
        return self.best[a, b]

    def _rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[np.ndarray]:
        """Weights of each run of xs with all of ys."""
        kinds, place = np.unique(ys, return_inverse=True)
        known: dict[int, np.ndarray] = {}
        for x in xs:
            if x not in known:
                known[x] = np.array([self.weights.get((x, y), 0) for y in kinds.tolist()], np.int64)[place]
            yield known[x]

    def _last_row(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> np.ndarray:
        row = np.zeros(len(ys) + 1, np.int64)
        for w in self._rows(xs, ys):
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))
        return row

    def _score(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
        if not xs or not ys:
            return 0
        if len(xs) * len(ys) > SMALL:
            return int(self._last_row(xs, ys)[-1])
        return self._table(xs, ys)[-1][-1]

    def _table(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[list[int]]:
        table, get = [[0] * (len(ys) + 1)], self.weights.get
        for x in xs:
            above, row = table[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(above[j + 1], row[j], above[j] + get((x, y), 0)))
            table.append(row)
        return table

    def pairs(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the runs that a best alignment pairs."""
        if not xs or not ys:
            return []
        if len(xs) * len(ys) > CELLS and len(xs) > 1:
            half = len(xs) // 2
            at = int((self._last_row(xs[:half], ys) + self._last_row(xs[half:][::-1], ys[::-1])[::-1]).argmax())
            return self.pairs(xs[:half], ys[:at]) + [(i + half, j + at) for i, j in self.pairs(xs[half:], ys[at:])]
        if len(xs) * len(ys) > SMALL:
            table = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
            for i, w in enumerate(self._rows(xs, ys)):
                table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w))
        else:
            table = self._table(xs, ys)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]


def tree_match(a: Node, b: Node, shapes: Shapes | dict | None = None) -> int:
    """Simple tree matching: the most pairs of nodes in order-preserving, top-down agreement."""
    shapes = shapes or Shapes()
    shapes.read(a)
    shapes.read(b)
    return shapes.match(a.shape, b.shape)


def aligned(page: Node, wrapper: Node, shapes: Shapes | None = None) -> Iterator[tuple[Node, Node]]:
    """Pairs of page and wrapper nodes of the best match, the roots first. shapes, if given, have the wrapper's."""
    if shapes is None:
        shapes = Shapes()
        shapes.read(wrapper)
    shapes.read(page)
    shapes.match(page.shape, wrapper.shape)
    todo = [(page, wrapper)]
    while todo:
        a, b = todo.pop()
        yield a, b
        own, other = shapes.runs[a.shape], shapes.runs[b.shape]
        if not own or not other:
            continue
        if a.shape == b.shape:  # nothing to look for
            todo += zip(a.kids(), b.kids(), strict=True)
            continue
        xs, ys = _runs(a.kids()), _runs(b.kids())
        for i, j in shapes.pairs(own, other):
            todo += zip(xs[i], ys[j], strict=False)


def numbered(wrapper: Node) -> tuple[dict[int, int], set[int]]:
    """A wrapper's nodes by id() with their numbers in page order, and the numbers inside an article or main element."""
    out, inside, todo = {}, set(), [(wrapper, False)]
    while todo:
        node, deep = todo.pop()
        deep = deep or node.tag in ("article", "main")
        if deep:
            inside.add(len(out))
        out[id(node)] = len(out)
        todo += [(x, deep) for x in reversed(node.kids())]
    return out, inside


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_text(page: Node, template: set[int]) -> str:
    """Text of a page's content; template holds the id() of nodes whose text is the same on the host's other pages."""
    regions: list[Node] = []

    def find(node: Node, tag: str) -> None:
        todo = node.kids()[::-1]
        while todo:
            x = todo.pop()
            if x.drop or id(x) in template:
                continue
            if x.tag == tag:
                regions.append(x)
            else:
                todo += x.kids()[::-1]

    for tag in ("article", "main"):
        find(page, tag)
        if regions:
            break
    whole = not regions
    regions = regions or [page]
    out: list[str] = []
    for r in regions:
        _text(r, out, lambda n: n.drop or id(n) in template or (whole and n.tag == "header"))
        out.append(" ")
    return " ".join("".join(out).split())


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the page with the smallest id of every host. pages: host, page_id, html."""
    return materialise(pages.where("html <> ''").groupBy("host").agg(F.min_by("html", "page_id").alias("wrapper")))


class Wrappers:
    """Parsed wrappers of the hosts met last."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def __call__(self, page: str | None):
        if page is None:
            return None
        got = self.known.get(page)
        if got is None:
            if len(self.known) > 200:
                self.known.clear()
            tree = parse(page)
            got = self.known[page] = (tree, *numbered(tree), Shapes())
        if not got[3].shape_ids or got[3].full():
            got[3].forget()
            got[3].read(got[0])
        return got


def joined(pages: DataFrame, side: DataFrame, n_bytes: int) -> DataFrame:
    return pages.join(F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side, "host", "left")


def template_nodes(pages: DataFrame, hosts: DataFrame, n_bytes: int) -> DataFrame:
    """(host, node, key): wrapper nodes that are template, with the key of their text, or null for those that repeat a stock
    of texts. Counted are contents in which a node has a partner with text.

    Pages of a host whose text outside menus, headers and the like is the same are one content, whatever else differs in
    them; of these the page with the least list of partners counts.
    """

    def run(batches):
        known = Wrappers()
        for batch in batches:
            found: dict[tuple[str, bytes], list[tuple[int, int]]] = {}
            met: set[tuple[str, str]] = set()
            for host, page, ref in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper")), strict=True):
                if not page or ref is None or (host, page) in met:
                    continue
                met.add((host, page))
                wrapper, number, _, shapes = known(ref)
                tree, partners = parse(page), []
                for a, b in aligned(tree, wrapper, shapes):
                    if b.tag in ("#root", "html", "body") or a.drop:
                        continue
                    t = text_of(a)
                    if t:
                        partners.append((number[id(b)], text_key(t)))
                content = host, hashlib.blake2b(main_text(tree, set()).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                found[content] = min(found.get(content, partners), partners)
            yield pa.record_batch([pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary()), pa.array([[{"node": x, "key": y} for x, y in p] for p in found.values()], pa.list_(pa.struct([("node", pa.int32()), ("key", pa.int64())])))], names=["host", "content", "partners"])

    found = joined(pages.select("host", "html"), hosts, n_bytes).mapInArrow(lean(run), "host string, content binary, partners array<struct<node:int,key:long>>")
    one = found.groupBy("host", "content").agg(F.min("partners").alias("partners")).select("host", F.inline("partners"))
    texts = one.groupBy("host", "node", "key").agg(F.count("*").alias("n"))
    nodes = texts.groupBy("host", "node").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.max("n").alias("most"), F.max_by("key", F.struct("n", "key")).alias("key"))
    constant = (F.col("n") >= MIN_PAGES) & (F.col("most") >= SAME_SHARE * F.col("n"))
    stock = (F.col("n") >= REPEATING) & (2 * F.col("texts") <= F.col("n"))
    return nodes.where(constant | stock).select("host", "node", F.when(constant, F.col("key")).alias("key"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null, empty and content-free pages have an empty text. A null url, or one without host, counts as host ''. Of hosts with
    fewer than MIN_PAGES contents nothing is template, and content is told from the rest by where it stands in the page alone.
    Every page has its row, but pages of a host with the same content count once in telling what is template, as one article
    under many urls says nothing about the host's other pages. Columns other than page_id, url and html are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    refs = wrappers(own)
    n_bytes = refs.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    fixed = template_nodes(own, refs, n_bytes).groupBy("host").agg(F.collect_list(F.struct("node", "key")).alias("template"))
    side = materialise(refs.join(fixed, "host", "left"))

    def run(batches):
        known = Wrappers()
        for batch in batches:
            texts = []
            for page, ref, nodes in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "template")), strict=True):
                if not page:
                    texts.append("")
                    continue
                tree, template = parse(page), set()
                if nodes:
                    wrapper, number, inside, shapes = known(ref)
                    fixed = {x["node"]: x["key"] for x in nodes if x["key"] is not None or x["node"] not in inside}
                    for a, b in aligned(tree, wrapper, shapes):
                        n = number[id(b)]
                        if n in fixed and (fixed[n] is None or fixed[n] == text_key(text_of(a))):
                            template.add(id(a))
                texts.append(main_text(tree, template))
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined(own, side, n_bytes).mapInArrow(lean(run), f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
