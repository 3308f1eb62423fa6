"""Operator 6, HTML extraction by wrapper induction over the pages of a host.

1. Each host gets `REFERENCES` reference pages, those with the smallest hashes of their ids.
2. Every page is parsed into a tree of blocks and aligned with its host's reference pages by simple tree
   matching (the heaviest order-preserving match of children, level by level; equal texts weigh double), however long
   the child lists are.
   What was matched and what was also equal is counted per reference node over all pages of the host; each
   task adds up its own pages first, so a host with a third of all pages is no hot spot.
3. A text at its path of elements that was equal on at least `CONSTANT` of the distinct pages it was matched on, and on
   `PAGES` pages at least, is template; the same words elsewhere on a page aren't. Slots that vary are content.
4. The content of a page is what its articles and main elements (else its body) hold outside menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, less the host's template.

Reference pages and templates are broadcast only below `SENT_BYTES`; beyond it they are joined by host.
Null or empty html, or html without text, gives an empty string; pages without a host form one host. Repeated
rows give a row each, an empty table an empty result; other columns are not read. Parsing is iterative and
linear, however deep elements are nested and however many are never closed. From the first tag whose quotes never end on,
tags end at the next >. Hosts of fewer than `PAGES` pages have no template; their pages go by elements and names alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from array import array
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

REFERENCES, CONSTANT, PAGES = 2, 0.9, 8
SENT_BYTES = 32 << 20
#: Tables of more cells are made by numpy; their numbers are the same.
VECTORS = 2_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S)
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAMES = re.compile(r"[a-z0-9]+", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names of HTML, and names that page authors give to what isn't the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "legend"}
DROPPED = frozenset("aside button canvas datalist dialog footer head iframe input menu nav noscript object optgroup option script select style svg template textarea title video audio".split())
MAIN = ("article", "main")
ENDS_ITSELF = frozenset("li dd dt tr td th option".split())
#: Elements that the end of an inline element doesn't reach beyond.
BOUNDS = frozenset(("article", "main", "table", "td", "body"))
#: Elements that show that a form holds running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
BOILERPLATE = frozenset("ad adbox ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu menus nav navbar navigation newsletter notice notices pager pagination popup promo promos related replies reply share sharing sidebar sidebars social sponsor sponsored subscribe toolbar topbar widget widgets".split())
# Words that stand beside those in a name and don't change what it says; and names of articles that aren't the page's.
BESIDE = frozenset("area articles bar block bottom box container global header inner item items left links list main mobile outer page post posts primary right secondary section site slot thread top unit user wrap wrapper".split())
OTHER_ARTICLES = frozenset("ad advert comment comments promo related reply".split())


@dataclass(slots=True)
class Block:
    """An element, or a text with tag '#'. dropped: 0 no, 1 by its names, 2 by what it is, 3 a form."""

    tag: str
    text: str = ""
    kids: list[Block] = field(default_factory=list)
    dropped: int = 0


def names_it(value: str, words: frozenset) -> bool:
    """Whether one of the names in a class or id says one of words: by itself, or with words that change nothing."""
    for name in HUMP.sub("-", value).lower().split():
        parts = [x for x in NAMES.findall(name) if not x.isdigit()]
        if any(x in words for x in parts) and all(x in words or x in BESIDE or x in BOILERPLATE for x in parts):
            return True
    return False


def is_dropped(tag: str, attributes: str, inside: bool) -> int:
    if tag in DROPPED or tag == "header" and not inside:
        return 2
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        value = a or b or c
        if name.lower() == "role":
            if value.lower() in ROLES:
                return 2
        elif tag == "article" and names_it(value, OTHER_ARTICLES):
            return 2
        elif tag not in ("html", "body", "article", "main") and names_it(value, BOILERPLATE):
            return 1
    return 3 if tag == "form" else 0


def spared(root: Block) -> None:
    """Names don't drop what holds a main element or all articles of the page, nor does being a form.

    A form also stays if the page has neither outside it and it holds running text, more than half of the page's.
    """
    held: dict[int, tuple[int, int, int, int]] = {}
    order, todo = [], [root]
    while todo:
        now = todo.pop()
        order.append(now)
        if now.dropped != 2:
            todo.extend(now.kids)
    for now in reversed(order):
        mains, articles = int(now.tag == "main" and not now.dropped), int(now.tag == "article" and not now.dropped)
        size, prose = len(now.text), int(now.tag in PROSE)
        for x in now.kids if now.dropped != 2 else ():
            m, a, n, p = held[id(x)]
            mains, articles, size, prose = mains + m, articles + a, size + n, prose + p
        held[id(now)] = mains, articles, size, prose
    every_main, every, every_size, _ = held[id(root)]
    for now in order:
        mains, articles, size, prose = held[id(now)]
        if now.dropped in (1, 3) and (mains or every and articles == every):
            now.dropped = 0
        elif now.dropped == 3 and prose and not every and not every_main and 2 * size > every_size:
            now.dropped = 0


def parse(page: str) -> Block:
    """The tree of blocks; inline elements are part of their block's text."""
    root = Block("body")
    stack: list[tuple[str, Block]] = [("", root)]  # open elements, each with the block that its text goes to
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
    blocks: list[int] = []  # of open blocks but p
    bounds: list[int] = []
    run: list[str] = []
    at, inside, ends = 0, 0, page.rfind(">") + 1
    token = TOKEN

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1][1].kids.append(Block("#", text))

    def close(k: int) -> None:
        """Ends the open elements from k on."""
        nonlocal inside
        if any(x[1] is not stack[k - 1][1] for x in stack[k:]):
            flush()
        inside -= sum(x[0] in MAIN for x in stack[k:])
        for x in stack[k:]:
            places[x[0]].pop()
        del stack[k:]
        for some in (blocks, bounds):
            while some and some[-1] >= k:
                some.pop()

    def open_(tag: str, block: Block) -> None:
        k = len(stack)
        places[tag].append(k)
        if tag in BLOCKS and tag != "p":
            blocks.append(k)
        if tag in BOUNDS:
            bounds.append(k)
        stack.append((tag, block))

    while True:
        found = token.search(page, at) if at < ends else None
        if not found:
            run.append(page[at:].partition("<!--")[0])  # no tag ends here
            break
        if token is TOKEN and not found[2] and found[0][1:2] not in ("!", "?") and found[0].lstrip("</")[:1].isalpha():
            token = PLAIN  # quotes that never end
            continue
        if found.start() > at:
            run.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "p" and not places["p"]:
                flush()
            if places[tag] and (tag in BLOCKS or not bounds or places[tag][-1] >= bounds[-1]):
                close(places[tag][-1])
            continue
        if tag in ENDS_P or tag in ENDS_ITSELF:
            last = max(places["p"][-1] if tag in ENDS_P and places["p"] else 0, places[tag][-1] if tag in ENDS_ITSELF and places[tag] else 0)
            if last and (not blocks or last >= blocks[-1]):
                close(last)
        if tag == "br":
            run.append(" ")
        gone = is_dropped(tag, found[3] or "", inside > 0)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at, max(at, ends))
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS or gone:
            flush()
            block = Block(tag, dropped=gone)
            stack[-1][1].kids.append(block)
            if tag not in VOID:
                open_(tag, block)
                inside += tag in MAIN
        elif tag not in VOID:
            open_(tag, stack[-1][1])
    flush()
    spared(root)
    return root


def within(path: bytes, tag: str) -> bytes:
    """The path of an element, as a digest of those around it and its name: of one length, however deep."""
    return hashlib.blake2b(path + tag.encode(), digest_size=8).digest()


def placed_leaves(block: Block) -> Iterator[tuple[Block, bytes]]:
    """The texts of a tree, in page order, each with the elements around it."""
    todo = [(block, b"")]
    while todo:
        now, path = todo.pop()
        if now.tag == "#":
            yield now, path
        else:
            path = within(path, now.tag)
        todo.extend((x, path) for x in reversed(now.kids))


def leaves(block: Block) -> Iterator[Block]:
    return (x for x, _ in placed_leaves(block))


def placed_blocks(root: Block) -> list[tuple[str, bytes]]:
    """Texts of all articles and mains in page order, outside what is dropped; each with the elements around it.

    Without these, or if there is no main and the articles hold less than half of what isn't dropped (teasers beside a
    story), it is everything.
    """
    every: list[tuple[str, bytes]] = []
    own: list[tuple[str, bytes]] = []
    todo: list[tuple[Block, bool, bytes]] = [(root, False, b"")]
    main = False
    while todo:
        now, inside, path = todo.pop()
        if now.dropped:
            continue
        main = main or now.tag == "main"
        if now.tag == "#":
            every.append((now.text, path))
            if inside:
                own.append((now.text, path))
        else:
            path = within(path, now.tag)
        inside = inside or now.tag in MAIN
        todo.extend((x, inside, path) for x in reversed(now.kids))
    size = lambda some: sum(len(text) for text, _ in some)
    return own if main and own or 2 * size(own) >= size(every) else every


def content_blocks(root: Block) -> list[str]:
    return [text for text, _ in placed_blocks(root)]


def digest(text: str, path: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(path + text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def one_text(x: Block) -> bool:
    """Whether a block holds one text and nothing else."""
    return len(x.kids) == 1 and x.kids[0].tag == "#"


def single(x: Block, y: Block) -> bool:
    return one_text(x) and one_text(y)


class Shapes:
    """Numbers of a tree's blocks that equal blocks share, and each one's weight with its equal, which no other exceeds."""

    def __init__(self, root: Block):
        self.found: dict[tuple, int] = {}
        self.weight: list[int] = []
        self.own = self.of(root, True)

    def of(self, root: Block, new: bool = False) -> dict[int, int]:
        """Numbers of a tree's blocks by id, of those that are equal to one of the first tree."""
        order, todo = [], [root]
        while todo:
            now = todo.pop()
            order.append(now)
            todo.extend(now.kids)
        numbers: dict[int, int] = {}
        for now in reversed(order):
            key = (now.tag, now.text, tuple([numbers.get(id(x)) for x in now.kids]))
            h = self.found.get(key)
            if h is None and new:
                h = self.found[key] = len(self.weight)
                self.weight.append(1 + (now.tag == "#") + sum(self.weight[k] for k in key[2]))
            if h is not None:
                numbers[id(now)] = h
        return numbers


class Columns:
    """The child list of a block by tag and text."""

    def __init__(self, kids: list[Block]):
        self.every: defaultdict[str, list[int]] = defaultdict(list)
        self.mixed: defaultdict[str, list[int]] = defaultdict(list)  # those that hold more than one text
        self.texts: defaultdict[tuple[str, str], list[int]] = defaultdict(list)
        self.size = len(kids)
        self.plain: dict[str, np.ndarray] = {}
        for j, n in enumerate(kids):
            self.every[n.tag].append(j)
            if n.tag != "#" and not one_text(n):
                self.mixed[n.tag].append(j)
            else:
                self.texts[n.tag, n.text or n.kids[0].text].append(j)

    def unequal(self, tag: str) -> np.ndarray:
        """The weights of a text, or of an element with one, if the texts differ."""
        if tag not in self.plain:
            out = np.zeros(self.size, dtype=np.int32)
            out[self.every.get(tag, [])] = 1 if tag == "#" else 2
            out[self.mixed.get(tag, [])] = 0
            self.plain[tag] = out
        return self.plain[tag]


class Matching:
    """Simple tree matching of a reference with a page: the heaviest match, by the same rule whatever the lengths of lists.

    A pair of elements has one pair of parents, so each is weighed once. Equal subtrees have the most weight that either can
    have, which only node by node gives. What stays in memory are the weights of the pairs that texts alone don't tell,
    four bytes each; the tables of an alignment are made again on the way down, a part at a time. Time grows with the
    product of the lengths of child lists; those of more than `VECTORS` cells go row by row through numpy.
    """

    def __init__(self, a: Block, b: Block, shapes: Shapes | None = None):
        self.a, self.b = a, b
        self.shapes = shapes or Shapes(a)
        self.own, self.other = self.shapes.own, self.shapes.of(b)
        self.rows: dict[tuple[int, int], array] = {}
        self.columns: dict[int, Columns] = {}
        self.total: int | None = None

    def equal(self, x: Block, y: Block) -> bool:
        h = self.own.get(id(x))
        return h is not None and h == self.other.get(id(y))

    def known(self, x: Block, y: Block) -> int | None:
        """The weight of two blocks, if it shows without an alignment of their children, or is that of the trees."""
        if x.tag != y.tag:
            return 0
        if x.tag == "#":
            return 1 + (x.text == y.text)
        if single(x, y):
            return 2 + (x.kids[0].text == y.kids[0].text)
        if self.equal(x, y):
            return self.shapes.weight[self.own[id(x)]]
        return self.total if x is self.a and y is self.b else None

    def of(self, y: Block) -> Columns:
        if id(y) not in self.columns:
            self.columns[id(y)] = Columns(y.kids)
        return self.columns[id(y)]

    def needed(self, k: Block, y: Block, few: bool) -> list[int]:
        """The places of those children of y whose weight with k isn't told by texts alone."""
        if k.tag == "#":
            return []
        if few:
            plain = one_text(k)
            return [j for j, n in enumerate(y.kids) if n.tag == k.tag and not (plain and one_text(n))]
        columns = self.of(y)
        return (columns.mixed if one_text(k) else columns.every).get(k.tag, [])

    def weights(self, k: Block, y: Block) -> list[int]:
        """The weights of k with each child of y."""
        out, tag, stored = [], k.tag, iter(self.rows.get((id(k), id(y)), ()))
        own = k.text if tag == "#" else k.kids[0].text if one_text(k) else None
        for n in y.kids:
            if n.tag != tag:
                out.append(0)
            elif tag == "#":
                out.append(1 + (n.text == own))
            elif own is not None and one_text(n):
                out.append(2 + (n.kids[0].text == own))
            else:
                out.append(next(stored))
        return out

    def vector(self, k: Block, y: Block) -> np.ndarray:
        columns = self.of(y)
        if k.tag == "#" or one_text(k):
            out = columns.unequal(k.tag).copy()
            out[columns.texts.get((k.tag, k.text or k.kids[0].text), [])] += 1
        else:
            out = np.zeros(columns.size, dtype=np.int32)
        if (id(k), id(y)) in self.rows:
            out[self.needed(k, y, False)] = self.rows[id(k), id(y)]
        return out

    def below(self, up: list[int] | np.ndarray, k: Block, y: Block) -> list[int] | np.ndarray:
        """The row of the alignment's table after k, from the one before."""
        if isinstance(up, list):
            row, last = [0], 0
            for j, w in enumerate(self.weights(k, y)):
                over, both = up[j + 1], up[j] + w if w else 0
                last = over if over > last else last
                last = both if both > last else last
                row.append(last)
            return row
        row = up.copy()
        np.maximum(up[1:], up[:-1] + self.vector(k, y), out=row[1:])
        return np.maximum.accumulate(row)

    @staticmethod
    def first(x: Block, y: Block) -> list[int] | np.ndarray:
        n = len(y.kids) + 1
        return [0] * n if len(x.kids) * len(y.kids) <= VECTORS else np.zeros(n, dtype=np.int32)

    def weighed(self, x: Block, y: Block) -> Generator[tuple[Block, Block], int, int]:
        """Asks for the weights of pairs of children; returns that of x and y."""
        row = self.first(x, y)
        few = isinstance(row, list)
        for k in x.kids:
            if places := self.needed(k, y, few):
                found = array("i")
                for j in places:
                    n = y.kids[j]
                    found.append(self.shapes.weight[self.own[id(k)]] if self.equal(k, n) else (yield k, n))
                self.rows[id(k), id(y)] = found
            row = self.below(row, k, y)
        return 1 + int(row[-1])

    def aligned(self, x: Block, y: Block) -> list[tuple[Block, Block]]:
        """The children of x and y that are matched, from the last one on."""
        s, t = x.kids, y.kids
        row = self.first(x, y)
        part = len(s) + 1 if isinstance(row, list) else isqrt(len(s)) + 1
        starts = [row]
        for i in range(1, len(s) // part * part + 1):
            row = self.below(row, s[i - 1], y)
            if i % part == 0:
                starts.append(row)
        found, i, j = [], len(s), len(t)
        for b in reversed(range(len(starts))):
            low, table = b * part, [starts[b]]
            for k in s[low:i]:
                table.append(self.below(table[-1], k, y))
            while i > low and j:
                row, up = table[i - low], table[i - low - 1]
                if row[j] == up[j]:
                    i -= 1
                elif row[j] == row[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((s[i], t[j]))
            if not j:
                break
        return found

    def texts(self) -> list[tuple[int, bool]]:
        """The texts of the reference that were matched, by id, and whether they are equal."""
        if self.a.tag != self.b.tag:
            return []
        if self.known(self.a, self.b) is None:
            stack, value = [self.weighed(self.a, self.b)], None
            while stack:
                try:
                    stack.append(self.weighed(*stack[-1].send(value)))
                    value = None
                except StopIteration as end:
                    stack.pop()
                    value = end.value
            self.total = value
        out, walk = [], [(self.a, self.b)]
        while walk:
            x, y = walk.pop()
            if x.tag == "#":
                out.append((id(x), x.text == y.text))
            elif single(x, y) or self.equal(x, y):
                walk.extend(zip(x.kids, y.kids, strict=True))
            else:
                walk.extend(self.aligned(x, y))
        return out


def matched(a: Block, b: Block, shapes: Shapes | None = None) -> list[tuple[int, bool]]:
    return Matching(a, b, shapes).texts()


def _by_host(pages: DataFrame, small: DataFrame, how: str, bytes_of: str) -> DataFrame:
    """pages joined with a table of one row per host, which is broadcast if it was found to be small."""
    size = small.agg(F.sum(F.expr(bytes_of))).first()[0] or 0
    return pages.join(F.broadcast(small) if size <= SENT_BYTES else small, "host", how)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template: digests of the constant texts) from all pages (page, host, html)."""
    spread = pages.where(F.col("html") != "").select("host", F.xxhash64("page", "html").alias("h"))
    chosen = spread.groupBy("host").agg(*(F.min(F.xxhash64("h", F.lit(k))).alias(f"r{k}") for k in range(REFERENCES)))
    marked = pages.where(F.col("html") != "").withColumn("h", F.xxhash64("page", "html"))
    is_pick = F.lit(False)
    refs = _by_host(marked, chosen, "inner", "64")
    for k in range(REFERENCES):
        is_pick = is_pick | (F.xxhash64("h", F.lit(k)) == F.col(f"r{k}"))
    refs = written(refs.where(is_pick).groupBy("host").agg(F.sort_array(F.collect_set("html")).alias("refs")), "references")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list[tuple[Block, Shapes, dict[int, int]]]] = {}
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for host, page, refs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    trees[host] = [(t := parse(x), Shapes(t), {id(z): digest(z.text, path) for z, path in placed_leaves(t)}) for x in refs]
                tree = parse(page)
                for (ref, shapes, texts), source in zip(trees[host], refs, strict=True):
                    if source == page:
                        continue  # a copy of the reference says nothing about what varies
                    for node, equal in matched(ref, tree, shapes):
                        c = counts.setdefault((host, texts[node]), [0, 0])
                        c[0] += 1
                        c[1] += equal
            if len(counts) > 200_000:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    joined = _by_host(pages.where(F.col("html") != "").select("host", "html"), refs, "inner", "aggregate(refs, 0L, (a, x) -> a + octet_length(x))")
    found = joined.mapInArrow(align, "host string, digest long, seen long, equal long").groupBy("host", "digest").agg(F.sum("seen").alias("seen"), F.sum("equal").alias("equal"))
    constant = found.where((F.col("equal") >= PAGES) & (F.col("equal") >= CONSTANT * F.col("seen")))
    return constant.groupBy("host").agg(F.collect_list("digest").alias("template"))


def _counted(counts: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    hosts, digests = zip(*counts, strict=True)
    seen, equal = zip(*counts.values(), strict=True)
    return pa.record_batch([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(seen, pa.int64()), pa.array(equal, pa.int64())], names=["host", "digest", "seen", "equal"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_blocks, n_template) for each page."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    wrapper = written(templates(rows), "templates")
    joined = _by_host(rows, wrapper, "left", "8 * size(template)").select("page", "url", "html", "template")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, blocks, gone = [], [], []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found, constant = placed_blocks(parse(page)), set(template or ())
                kept = [x for x, path in found if not constant or digest(x, path) not in constant]
                texts.append("\n".join(kept))
                blocks.append(len(kept))
                gone.append(len(found) - len(kept))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(blocks, pa.int64()), pa.array(gone, pa.int64())], names=[id_col, url_col, "text", "n_blocks", "n_template"])

    kinds = (pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString())
    return joined.mapInArrow(extract, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_blocks long, n_template long")
