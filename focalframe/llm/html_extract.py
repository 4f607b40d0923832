"""Main text of web pages by wrapper induction.

Learning: each host has one pivot, the page of the least hash. Simple tree matching aligns the DOM of every page of the host
with the pivot's. Two things are counted over all pages of a host: the texts at each slot (a node of the pivot), and the text under each slot. A slot
that holds one text nearly everywhere is template; what varies is content, and the innermost slot with most of the varying
text is the content region. Only slots, sizes and text hashes are moved, and no host's pages are gathered anywhere.

Extraction: a page is aligned with its pivot again; its content is the region's text without the template's. Tags and classes are a prior: what
they mark as page furniture is no content, and text in an article counts ``PRIOR`` times when the region is chosen. Where less
than half of a page's text lies in its host's region, the page's own region takes its place.
"""

from __future__ import annotations

import html
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written
from .url_filter import split_url

#: Fixed word lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul option select".split()
)
SCOPE = frozenset("html table td th caption button object template".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "thead": ()}
FURNITURE = frozenset("head script style noscript template iframe svg math textarea title nav header footer aside form button select input dialog menu object embed canvas audio video search".split())
#: Fixed words in class, id and role that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead banner footer contentinfo colophon sidebar aside complementary widget widgets "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay dialog "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar search searchbox form "
    "comment comments commentlist reply replies respond discussion disqus skip hidden".split()
)
ARTICLE = frozenset(("article", "main"))
#: Fixed value: as in browsers' parsers, elements that would be nested deeper are put beside each other. Pivots and matchings that a task remembers.
DEEPEST = 512
CACHED = 2000
MEMO = 50_000
#: Distinct pages a host needs for a template; share of them that holds a constant, anywhere and inside an article.
LEAST_PAGES = 4
CONSTANT = 0.5
CONSTANT_IN_ARTICLE = 0.9
#: Weight of text in an article, share of the text that a region holds at least, bytes of pivots that are broadcast at most.
PRIOR = 2
REGION = 2 / 3
BROADCAST_BYTES = 32_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element: label (tag and classes without digits), children (nodes and strings), whether it is page furniture, and the size of its subtree once its shape is known."""

    __slots__ = ("furniture", "kids", "label", "shape", "size", "tag")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.kids, self.shape, self.size, self.label, self.furniture = tag, [], None, 0, tag, tag in FURNITURE
        if attributes:
            for name, *values in _ATTR.findall(attributes):
                name, text = name.lower(), next((v for v in values if v), "")
                if name == "hidden":
                    self.furniture = True
                    continue
                if tag not in ("html", "body") and not MARKS.isdisjoint(p.lower() for p in _PART.findall(text)):
                    self.furniture = True
                if name == "class":
                    self.label = tag + "." + re.sub(r"\d+", "", " ".join(sorted(text.split())))


def parse(text: str) -> Node:
    """The DOM of a page: omitted end tags are implied, stray ones ignored, raw text skipped, references decoded."""
    root = Node("#", "")
    stack, at, size = [root], 0, len(text)
    # How many elements of each tag are open, so that a stray or needless end costs no walk over them.
    still: Counter[str] = Counter()

    def close(i: int) -> None:
        still.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].kids.append(html.unescape(text[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(html.unescape(text[at : m.start()]))
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if still[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK or tag == "p":
            over = ENDS.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if still["p"] or any(still[t] for t in over) else ():
                open_tag = stack[i].tag
                if open_tag == "p" or open_tag in over:
                    close(i)
                elif open_tag in SCOPE and open_tag not in over or open_tag in ("ul", "ol", "dl") and tag in ENDS:
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else size
        elif len(stack) < DEEPEST:
            stack.append(node)
            still[tag] += 1
    return root


def shape(node: Node) -> int:
    """A hash of the labels of a subtree; equal shapes align completely."""
    todo = [node]
    while node.shape is None:
        top = todo[-1]
        waiting = [k for k in top.kids if k.__class__ is Node and k.shape is None]
        if waiting:
            todo += waiting
            continue
        todo.pop()
        if top.shape is None:
            kids = [k for k in top.kids if k.__class__ is Node]
            top.shape, top.size = hash((top.label, *(k.shape for k in kids))), 1 + sum(k.size for k in kids)
    return node.shape


def _ends(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Children of two nodes: the pairs of equal shape at both ends, and what is left between them."""
    left, right = ([k for k in x.kids if k.__class__ is Node] for x in (a, b))
    low, n, m = 0, len(left), len(right)
    while low < n and low < m and left[low].shape == right[low].shape:
        low += 1
    while n > low and m > low and left[n - 1].shape == right[m - 1].shape:
        n, m = n - 1, m - 1
    return [*zip(left[:low] + left[n:], right[:low] + right[m:])], left[low:n], right[low:m]


def _rows(x: list[Node], y: list[Node], memo: dict, under: list[int], first: int, last: int) -> Iterator[list[int]]:
    """Rows ``last - 1`` down to ``first`` of the table of greatest weights of what follows in ``x`` and ``y``, from the row ``under`` them."""
    for i in range(last - 1, first - 1, -1):
        node, row = x[i], [0] * (len(y) + 1)
        for j in range(len(y) - 1, -1, -1):
            w = _known(node, y[j], memo)
            row[j] = max(under[j], row[j + 1], w and under[j + 1] + w)
        yield row
        under = row


def _known(a: Node, b: Node, memo: dict) -> int:
    """The size of the largest matching of two subtrees that have been compared before."""
    return a.size if a.shape == b.shape else memo[a.shape, b.shape] if a.label == b.label else 0


def _wanted(x: list[Node], y: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Pairs of subtrees, one of each two shapes, whose matchings are not known yet."""
    left, right = ({k.shape: k for k in nodes}.values() for nodes in (x, y))
    return [(p, q) for p in left for q in right if p.label == q.label and p.shape != q.shape and (p.shape, q.shape) not in memo]


def matched(a: Node, b: Node, memo: dict) -> int:
    """The size of the largest simple tree matching of two subtrees. Pairs wait on a stack until those of their children are known."""
    if a.label != b.label:
        return 0
    shape(a), shape(b)
    todo = [] if a.shape == b.shape or (a.shape, b.shape) in memo else [(a, b)]
    while todo:
        p, q = todo[-1]
        if (p.shape, q.shape) in memo:
            todo.pop()
            continue
        ends, x, y = _ends(p, q)
        wanted = _wanted(x, y, memo)
        if wanted:
            todo += wanted
            continue
        row = [0] * (len(y) + 1)
        for row in _rows(x, y, memo, row, 0, len(x)):
            pass
        memo[p.shape, q.shape] = 1 + sum(k.size for k, _ in ends) + row[0]
        todo.pop()
    return _known(a, b, memo)


def aligned_kids(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node, int]]:
    """Which children the largest matching pairs, with the pairs' sizes. Equal ends are paired first.

    Of the table of weights only every so many rows are kept; the rows between two of them are made again on the way back, so memory stays small for any number of children.
    """
    shape(a), shape(b)
    ends, x, y = _ends(a, b)
    out = [(p, q, p.size) for p, q in ends]
    if not x or not y:
        return out
    for p, q in _wanted(x, y, memo):
        matched(p, q, memo)
    step = max(1, int(len(x) ** 0.5))
    kept = {len(x): [0] * (len(y) + 1)}
    for i, row in zip(range(len(x) - 1, -1, -1), _rows(x, y, memo, kept[len(x)], 0, len(x))):
        if i % step == 0:
            kept[i] = row
    i = j = 0
    while i < len(x) and j < len(y):
        last = min(i - i % step + step, len(x))
        best = [*_rows(x, y, memo, kept[last], i, last)][::-1] + [kept[last]]
        first = i
        while i < last and j < len(y):
            w = _known(x[i], y[j], memo)
            here, under = best[i - first], best[i + 1 - first]
            if w and here[j] == under[j + 1] + w:
                out.append((x[i], y[j], w))
                i, j = i + 1, j + 1
            elif here[j] == under[j]:
                i += 1
            else:
                j += 1
    return out


def align(pivot: Node, page: Node, memo: dict) -> dict[int, Node]:
    """For the nodes of a page (by identity) the pivot's nodes that simple tree matching pairs with them."""
    pairs, todo = {}, [(pivot, page)]
    while todo:
        a, b = todo.pop()
        pairs[id(b)] = a
        todo += [(x, y) for x, y, _ in aligned_kids(a, b, memo)]
    return pairs


def numbered(root: Node) -> dict[int, int]:
    """The number of every node, in document order, by identity."""
    out, todo = {}, [root]
    while todo:
        node = todo.pop()
        out[id(node)] = len(out)
        todo += [k for k in reversed(node.kids) if k.__class__ is Node]
    return out


def parents(root: Node) -> dict[int, Node]:
    """The parent of every node but the root, by identity."""
    out, todo = {}, [root]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if k.__class__ is Node:
                out[id(k)] = node
                todo.append(k)
    return out


def _links(node: Node) -> tuple[int, int, int]:
    """Links, characters in links, characters."""
    links = linked = chars = 0
    todo = [(node, False)]
    while todo:
        x, inside = todo.pop()
        for k in x.kids:
            if k.__class__ is Node:
                links += k.tag == "a"
                todo.append((k, inside or k.tag == "a"))
            else:
                n = len(k.strip())
                chars += n
                linked += n if inside else 0
    return links, linked, chars


class Block:
    """A run of text in one innermost block element."""

    __slots__ = ("furniture", "in_article", "node", "text")

    def __init__(self, node: Node, text: str, furniture: bool, in_article: bool) -> None:
        self.node, self.text, self.furniture, self.in_article = node, text, furniture, in_article


def blocks(root: Node) -> list[Block]:
    """The text blocks of a page in order, white space folded; runs of inline content are cut at block elements only."""
    out, run = [], []
    # Work items: a string; or (node, its block, furniture, in an article); or the marker that a block element ends.
    todo: list = [(root, root, False, False)]
    state = (root, False, False)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(Block(*state[:1], text, *state[1:]))

    while todo:
        item = todo.pop()
        if item.__class__ is str:
            run.append(item)
            continue
        if len(item) == 3:
            flush()
            state = item
            continue
        node, block, furniture, article = item
        if node.tag == "br":
            run.append(" ")
            continue
        furniture = furniture or node.furniture
        if not furniture and node.tag in ("ul", "ol", "div", "section", "table"):
            if not article:
                links, linked, chars = _links(node)
                furniture = links >= 3 and linked >= 0.8 * chars
        is_block = node.tag in BLOCK or furniture and not state[1]
        if is_block:
            flush()
            before = state
            article = article or (node.tag in ARTICLE and not furniture)
            state = (node, furniture, article)
            todo.append(before)
            block = node
        todo += [k if k.__class__ is str else (k, block, furniture, article) for k in reversed(node.kids)]
    flush()
    return out


def text_hash(text: str) -> int:
    """A signed 64-bit hash that is equal in all processes."""
    import xxhash

    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def slot_key(slot: int, text: str) -> int:
    return text_hash(f"{slot}\x00{text}")


def containers(block: Block, above: dict[int, Node]) -> list[Node]:
    """The elements that may be the region of a block, from the root inwards: what is around it, no further in than an article."""
    chain = [block.node] if block.node.tag in ARTICLE or id(block.node) not in above else []
    node = block.node
    while id(node) in above:
        node = above[id(node)]
        chain.append(node)
    chain.reverse()
    stop = next((i for i, n in enumerate(chain) if n.tag in ARTICLE and not n.furniture), len(chain))
    return chain[: stop + 1]


def weight(block: Block) -> int:
    return len(block.text) * (PRIOR if block.in_article else 1)


_LEARNED = pa.schema([("host", pa.int64()), ("page", pa.int64()), ("kind", pa.int8()), ("slot", pa.int64()), ("depth", pa.int32()), ("chars", pa.int64())])
_LEARNED_DDL = "host long, page long, kind byte, slot long, depth int, chars long"


class Pivots:
    """Parsed pivots with their nodes' numbers and the matchings found so far; the least used ones are parsed again when they are wanted."""

    def __init__(self) -> None:
        self.kept: OrderedDict[int, tuple[Node, dict, dict]] = OrderedDict()

    def slots(self, host: int, source: str, page: Node) -> dict[int, int]:
        """The slots of a page's nodes, by identity."""
        if host not in self.kept:
            root = parse(source)
            self.kept[host] = (root, numbered(root), {})
            if len(self.kept) > CACHED:
                self.kept.popitem(last=False)
        self.kept.move_to_end(host)
        pivot, numbers, memo = self.kept[host]
        if len(memo) > MEMO:
            memo.clear()
        return {i: numbers[id(node)] for i, node in align(pivot, page, memo).items()}


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a page and its text's weight; 1 and 2: the slot and text of one of its blocks, outside and inside an article; 3: the weight of the text under a slot."""
    pivots = Pivots()
    for batch in batches:
        rows: list[tuple] = []
        for host, source, pivot in zip(*(c.to_pylist() for c in batch.columns)):
            root, page = parse(source), text_hash(source)
            slots, above, under = pivots.slots(host, pivot, root), parents(root), {}
            found = [b for b in blocks(root) if not b.furniture]
            for b in found:
                if id(b.node) in slots:
                    rows.append((host, page, 2 if b.in_article else 1, slot_key(slots[id(b.node)], b.text), 0, 0))
                for depth, node in enumerate(containers(b, above)):
                    if id(node) in slots:
                        key = slots[id(node)], depth
                        under[key] = under.get(key, 0) + weight(b)
            rows.append((host, page, 0, None, 0, sum(map(weight, found))))
            rows += [(host, page, 3, slot, depth, n) for (slot, depth), n in under.items()]
        columns = list(zip(*rows)) or [[]] * len(_LEARNED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEARNED)], schema=_LEARNED)


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """(host, region, constants, constants_in_article) from ``pages(host, html, pivot)``; host is a hash of the host's name."""
    seen = written(pages.select("host", "html", "pivot").mapInArrow(_learn, _LEARNED_DDL).distinct(), "slots")
    hosts = seen.where("kind = 0").groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("total"))
    slots = seen.where("kind in (1, 2)").groupBy("host", "kind", "slot").agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}").join(hosts, "host")
    slots = slots.where(F.col("n") >= F.when(F.col("kind") == 1, CONSTANT).otherwise(CONSTANT_IN_ARTICLE) * F.col("pages"))
    constant = slots.groupBy("host").agg(F.collect_list(F.when(F.col("kind") == 1, F.col("slot"))).alias("constants"), F.collect_list(F.when(F.col("kind") == 2, F.col("slot"))).alias("constants_in_article"))
    under = seen.where("kind = 3").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
    region = under.join(hosts, "host").where(F.col("chars") >= REGION * F.col("total")).groupBy("host").agg(F.max_by("slot", F.struct("depth", "chars", -F.col("slot"))).alias("region"))
    return hosts.select("host").join(region, "host", "left").join(constant, "host", "left")


def _inside(found: list[Block], chains: list[list[Node]], chosen: set[int]) -> list[Block]:
    return [b for b, chain in zip(found, chains) if any(id(node) in chosen for node in chain)]


def main_text(root: Node, slots: dict[int, int], region: int | None = None, constants: frozenset = frozenset(), constants_in_article: frozenset = frozenset()) -> str:
    """The main text of a parsed page whose nodes have ``slots`` in its host's wrapper."""
    above = parents(root)
    found = [b for b in blocks(root) if not b.furniture]
    if constants or constants_in_article:
        found = [b for b in found if id(b.node) not in slots or slot_key(slots[id(b.node)], b.text) not in (constants_in_article if b.in_article else constants)]
    total = sum(map(weight, found))
    chains = [containers(b, above) for b in found]
    held = _inside(found, chains, {i for i, slot in slots.items() if slot == region})
    if 2 * sum(map(weight, held)) < total or not held:
        under: dict[int, list] = {}
        for b, chain in zip(found, chains):
            for depth, node in enumerate(chain):
                under.setdefault(id(node), [0, depth])[0] += weight(b)
        own = max(((depth, n, i) for i, (n, depth) in under.items() if n >= REGION * total), default=None)
        held = _inside(found, chains, {own[2]}) if own else found
    articles = [b for b in held if b.in_article]
    if 2 * sum(map(weight, articles)) >= sum(map(weight, held)):
        held = articles
    return "\n".join(b.text for b in held)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = Pivots()
    for batch in batches:
        texts = []
        for host, source, pivot, region, constants, in_article in zip(*(c.to_pylist() for c in batch.columns[1:7])):
            root = parse(source)
            texts.append(main_text(root, pivots.slots(host, pivot, root), region, frozenset(constants or ()), frozenset(in_article or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(7), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null html reads as empty; its text is empty. Pages with a null url, or one without a host, share the wrapper of the empty
    host. Equal pages of a host count once in learning; of equal hashes the least page is the pivot. Null and repeated ids are carried along. A page without markup is
    one block of text. Pages of any length and with any number of elements are read whole; elements nested more than ``DEEPEST`` deep are read as if beside each other, as
    browsers do. Other columns are ignored; no pages give no rows.
    """
    host = split_url("url")[0]
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("host", F.xxhash64(host))
    pivots = written(plain.groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("pivot")), "pivots")
    few = (pivots.agg(F.sum(F.octet_length("pivot") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    aligned = plain.join(F.broadcast(pivots) if few else pivots, "host")
    wrappers = written(learn_wrappers(aligned), "wrappers")
    size = wrappers.agg(F.count("*"), F.sum(F.coalesce(F.array_size("constants"), F.lit(0)) + F.coalesce(F.array_size("constants_in_article"), F.lit(0)))).first()
    few = size[0] <= BROADCAST_IDS // 16 and (size[1] or 0) <= BROADCAST_IDS
    rows = aligned.join(F.broadcast(wrappers) if few else wrappers, "host", "left")
    return rows.select("page_id", "host", "html", "pivot", "region", "constants", "constants_in_article", "url").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
