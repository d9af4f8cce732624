"""Main text of web pages by wrapper induction.

A page's DOM tree is folded to its skeleton: block elements with their classes, roles, ids and whether these name a part
that is no content, runs of like siblings merged. The most
frequent skeleton of a host is its wrapper; every page's skeleton is aligned with it by simple tree matching. Over the
host's different contents each aligned node is counted with its texts: a text that a node keeps from content to content
is template on the pages that have it there, nodes whose text varies are content slots. A page's text is that of its content slots; nodes whose role in the page is
stated by their element or class (menus, footers, adverts, forms, comments and the like) are never content, and an
article or main element, if there is one with text, holds all slots that can be; inside it template is left out too.

Only hashes of texts are shuffled, by host and salt or made distinct before, so a hot host is no hot task. Skeletons are
few, so alignments are kept in a small cache.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .hashing import by_bytes
from .urlfilter import host_of

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""[^"'>]*""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "object", "canvas")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never content.
ROLES = frozenset("nav header footer aside form button dialog menu head title".split())
#: Words of a class, id or role that name such a part.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation navlinks breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments "
    "disqus respond reply replies login signup search widget toolbar pagination pager skip complementary contentinfo".split()
)
#: Whole class names that do (inside an article a class such as post-header holds its headline).
WHOLE = frozenset(("header", "site-header", "page-header", "site-footer", "topbar"))
MAIN = frozenset(("article", "main"))
#: Elements whose names say something of the whole page, and beginnings of words that do.
PAGE = frozenset(("html", "body"))
_STATES = re.compile(r"(?:has|no|with|without)[-_]")
#: Words that name an article or main, or what holds one, as no content all the same.
ANSWERS = frozenset("comment comments disqus respond reply replies related recommended".split())
#: Elements that come in runs, which their ids do not part.
RUNS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option".split())
#: What an opening tag closes: element -> elements that end when it starts.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ID = "\t#"  # parts a label's id from the rest
SLICE_BYTES = 4_000_000
LEAST_PAGES, SAME = 3, 0.8  # of template: contents of a host that have the node, share of the most frequent text
STILL = 0.1  # what the length of a node counts whose text hardly varies on its host
MAX_CACHE = 20_000


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag, in lower case, and of comments and declarations with name ''.

    Contents of raw elements are part of their opening tag, whose end is that of their closing tag. A tag ends at the first > outside quotes; a
    quote that is never closed is a character like any other; a tag that never ends is text, as is all that follows. Every
    character is looked at a bounded number of times.
    """
    at = 0
    closed = {'"': True, "'": True}  # whether the quote may come again
    while (start := source.find("<", at)) >= 0:
        if source.startswith(("<!", "<?"), start):
            end = source.find("-->", start + 4) + 3 if source.startswith("<!--", start) else source.find(">", start) + 1
            if end < 3:  # a comment that is not closed goes on to the end
                if not source.startswith("<!--", start):
                    return
                end = len(source)
            yield start, end, "", "", ""
            at = end
            continue
        m = _NAME.match(source, start + 1)
        if m is None:
            at = start + 1
            continue
        here = m.end()
        while True:
            here = _PLAIN.match(source, here).end()
            if here == len(source):
                return
            quote = source[here]
            here += 1
            if quote == ">":
                break
            if closed[quote]:
                end = source.find(quote, here)
                closed[quote] = end >= 0
                here = end + 1 if end >= 0 else here
        name, attrs = m[2].lower(), source[m.end() : here - 1]
        if not m[1] and name in _RAW_END and not attrs.endswith("/"):
            end = _RAW_END[name].search(source, here)
            here = source.find(">", end.end()) + 1 if end else 0
            here = here or len(source)
        yield start, here, m[1], name, attrs
        at = here


def _named(attrs: str) -> tuple[str, str, str, frozenset[str]]:
    """(class as written, role, id with numbers as 0, words of the three that name a part that is no content)."""
    own, names = {"class": "", "id": "", "role": ""}, set()
    for kind, *value in _ATTR.findall(attrs):
        words = next((v for v in value if v), "").lower().split()
        own[kind.lower()] = " ".join(words)
        for w in words:
            if not _STATES.match(w):
                names |= NAMES.intersection(re.split(r"[^a-z]+", w)) | WHOLE.intersection((w,))
    return own["class"], own["role"], re.sub(r"\d+", "0", own["id"]), frozenset(names)


class Page:
    """Text segments of a page: (node, whether in a link, text or None for a break); nodes are those of the skeleton."""

    def __init__(self, source: str):
        self.segments: list[tuple[int, bool, str | None]] = []
        self.labels: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.roles: list[bool] = [False]
        self.names: list[frozenset[str]] = [frozenset()]
        self.main: list[bool] = [False]
        self.article: list[bool] = [False]
        self.children: list[dict[str, int]] = [{}]
        self.holds: set[int] = set()  # nodes that are an article or main or have one inside
        self._parse(source)
        self.off = self._off()

    def _node(self, parent: int, tag: str, attrs: str) -> int:
        """The child of parent with this tag, class, role, id and the same names of no content, made if there is none."""
        name, role, own, names = _named(attrs) if attrs else ("", "", "", frozenset())
        if tag in PAGE:
            names = frozenset()
        label = f"{tag}.{name}" if name else tag
        label += f" @{role}" * bool(role) + f" !{','.join(sorted(names))}" * bool(names)
        if own and tag not in RUNS:
            label += ID + own
        node = self.children[parent].get(label)
        if node is None:
            node = len(self.labels)
            self.children[parent][label] = node
            self.labels.append(label)
            self.parents.append(parent)
            self.roles.append(tag in ROLES)
            self.names.append(names)
            self.main.append(self.main[parent] or tag in MAIN)
            self.article.append(self.article[parent] or tag == "article")
            self.children.append({})
            if tag in MAIN:
                up = node
                while up > 0 and up not in self.holds:
                    self.holds.add(up)
                    up = self.parents[up]
        return node

    def _off(self) -> list[bool]:
        """Which nodes are never content: by their element or name or that of a node above.

        If that leaves no text in any article (or main, where no article has text), names of layout on these and on what
        holds them do not count.
        """
        filled = {n for n, _, t in self.segments if t is not None and not t.isspace()}
        own = [r or bool(x) for r, x in zip(self.roles, self.names)]
        off = self._down(own)
        inside = [n for n in filled if self.article[n]] or [n for n in filled if self.main[n]]
        if inside and all(off[n] for n in inside):
            off = self._down([r or bool(x & ANSWERS if n in self.holds else x) for n, (r, x) in enumerate(zip(self.roles, self.names))])
        return off

    def _down(self, own: list[bool]) -> list[bool]:
        out = []
        for n, parent in enumerate(self.parents):
            out.append(own[n] or (parent >= 0 and out[parent]))
        return out

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("#", 0)]
        opened: Counter[str] = Counter()  # how often an element is on the stack
        links = at = 0
        add = self.segments.append
        for start, end, slash, tag, attrs in tags(source):
            if start > at:
                add((stack[-1][1], links > 0, source[at:start]))
            at = end
            if not tag or (not slash and tag in _RAW_END):
                continue
            if not slash:
                if tag in VOID:
                    if tag in ("br", "hr"):
                        add((stack[-1][1], False, None))
                    continue
                if tag in INLINE:
                    links += tag == "a"
                    continue
                closes = CLOSES.get(tag)
                if stack[-1][0] == "p":
                    opened[stack.pop()[0]] -= 1
                if closes and stack[-1][0] in closes:
                    opened[stack.pop()[0]] -= 1
                    if tag == "tr" and stack[-1][0] == "tr":
                        opened[stack.pop()[0]] -= 1
                node = self._node(stack[-1][1], tag, attrs)
                stack.append((tag, node))
                opened[tag] += 1
                links = 0
                add((node, False, None))
            elif tag in INLINE:
                links -= links > 0 and tag == "a"
            elif opened[tag]:
                add((stack[-1][1], False, None))
                while True:
                    name = stack.pop()[0]
                    opened[name] -= 1
                    if name == tag:
                        break
                links = 0
                add((stack[-1][1], False, None))
        if at < len(source):
            add((stack[-1][1], links > 0, source[at:]))

    def skeleton(self) -> str:
        """The tree as text: parents and labels in order."""
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents, self.labels))

    def text(self, keep: list[bool]) -> str:
        """Text of the nodes to keep: references decoded, white space inside a block one space, blocks joined by one."""
        parts = [" " if t is None else t for n, _, t in self.segments if t is None or keep[n]]
        return " ".join(html.unescape("".join(parts)).split())


def _tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    labels, children = [], []
    for k, line in enumerate(skeleton.split("\n")):
        parent, _, label = line.partition(" ")
        labels.append(label)
        children.append([])
        if k:
            children[int(parent)].append(k)
    return labels, children


class _Shapes:
    """Lists of children, numbered: equal numbers are equal lists of labels and of what is below them; 0 is the empty one."""

    def __init__(self):
        self.known: dict[tuple, int] = {(): 0}
        self.labels: dict[str, int] = {}
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [tuple(np.zeros((3, 0), np.int64))]  # labels, labels without ids, shapes
        self.sizes = [0]  # nodes below

    def of(self, labels: list[str], children: list[list[int]]) -> list[int]:
        """The shape of each node's children."""
        number = lambda x: self.labels.setdefault(x, len(self.labels))
        out = [0] * len(labels)
        for n in range(len(labels) - 1, -1, -1):  # children come after their parent
            if children[n]:
                full, base = [number("+" + labels[c]) for c in children[n]], [number("-" + labels[c].partition(ID)[0]) for c in children[n]]
                own = [out[c] for c in children[n]]
                key = tuple(zip(full, own))
                if key not in self.known:
                    self.known[key] = len(self.lists)
                    self.lists.append((np.array(full), np.array(base), np.array(own)))
                    self.sizes.append(sum(1 + self.sizes[x] for x in own))
                out[n] = self.known[key]
        return out


def _ends(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[int, int]:
    """How many children two lists share at their beginning, and after it at their end.

    Siblings have different labels, so nothing is worth as much to such a child as the one that equals it.
    """
    n = min(len(x[0]), len(y[0]))
    same = (x[0][:n] == y[0][:n]) & (x[2][:n] == y[2][:n])
    head = n if same.all() else int(same.argmin())
    n -= head
    if not n:
        return head, 0
    same = (x[0][-n:] == y[0][-n:])[::-1] & (x[2][-n:] == y[2][-n:])[::-1]
    return head, n if same.all() else int(same.argmin())


def _chain(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], worth: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The best chain of pairs of like children in which both places grow: (total, pairs); of equal ones that with the first places.

    worth has what two different shapes add. Rows of totals are kept at some places and made again in between.
    """
    rows, width = len(x[0]), len(y[0])
    every = max(1, int(rows**0.5))

    def values(i: int) -> np.ndarray:
        like = x[1][i] == y[1]
        value = np.where(like, 1 + (x[0][i] == y[0]), 0)
        if x[2][i]:
            for shape in np.unique(y[2][like & (y[2] > 0)]).tolist():
                value[like & (y[2] == shape)] += worth[int(x[2][i]), shape]
        return value

    def after(total: np.ndarray, i: int) -> np.ndarray:
        value, out = values(i), total.copy()
        np.maximum(out[1:], np.where(value > 0, total[:-1] + value, 0), out=out[1:])
        return np.maximum.accumulate(out)

    kept, total = {}, np.zeros(width + 1, np.int64)
    for i in range(rows):
        if i % every == 0:
            kept[i] = total
        total = after(total, i)
    best, pairs, i, j = int(total[-1]), [], rows, width
    block: list[np.ndarray] = []
    begin = rows
    while i and j:
        if i <= begin:
            stop, begin = i, (i - 1) // every * every
            block = [kept[begin]]
            for k in range(begin, stop):
                block.append(after(block[-1], k))
        row = block[i - begin]
        if not row[j]:
            break
        j = int(np.searchsorted(row[: j + 1], row[j], "left"))  # the first place with this total
        if block[i - 1 - begin][j] == row[j]:
            i -= 1  # it was reached before
            continue
        pairs.append((i - 1, j - 1))
        i, j = i - 1, j - 1
    return best, pairs


@lru_cache(MAX_CACHE)
def align(page: str, wrapper: str) -> tuple[int, ...]:
    """For each node of the page's skeleton the node of the wrapper's that simple tree matching gives it, or -1.

    Nodes match if their labels are equal but for ids, whatever the sizes; children keep their order, and as many nodes as
    possible are matched, where those with equal ids count twice. Lists of children that are equal are matched once.
    """
    (fa, ca), (fb, cb) = _tree(page), _tree(wrapper)
    shapes = _Shapes()
    sa, sb = shapes.of(fa, ca), shapes.of(fb, cb)
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    worth: dict[tuple[int, int], int] = {}
    out = [-1] * len(fa)
    if fa[0].partition(ID)[0] != fb[0].partition(ID)[0]:
        return tuple(out)
    todo = [(sa[0], sb[0], False)]
    while todo:  # pairs of lists whose parents may match, what is below first
        a, b, ready = todo.pop()
        if (a, b) in worth:
            continue
        if a == b or not a or not b:
            worth[a, b] = 2 * shapes.sizes[a] if a == b else 0
            continue
        x, y = shapes.lists[a], shapes.lists[b]
        head, tail = _ends(x, y)
        x, y = (tuple(z[head : len(z) - tail] for z in w) for w in (x, y))
        if not ready:
            todo.append((a, b, True))
            for base in np.intersect1d(x[1], y[1]).tolist():
                below = np.unique(y[2][y[1] == base]).tolist()
                todo += [(u, v, False) for u in np.unique(x[2][x[1] == base]).tolist() for v in below]
            continue
        total, pairs = _chain(x, y, worth)
        ends = [*range(head), *range(head + len(x[0]), head + len(x[0]) + tail)]
        step = len(y[0]) - len(x[0])
        own = shapes.lists[a][2]
        worth[a, b] = total + sum(2 + 2 * shapes.sizes[own[i]] for i in ends)
        known[a, b] = worth[a, b], [(i, i if i < head else i + step) for i in ends] + [(i + head, j + head) for i, j in pairs]
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        out[a] = b
        if sa[a] == sb[b]:
            todo += zip(ca[a], cb[b])
        elif sa[a] and sb[b]:
            todo += [(ca[a][i], cb[b][j]) for i, j in known[sa[a], sb[b]][1]]
    return tuple(out)


_SUMMARY = "host string, skeleton string, nodes array<int>, texts array<bigint>, sizes array<int>"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _own(page: Page) -> dict[int, str]:
    """The text of each node that may be content and has text of its own."""
    own: dict[int, list[str]] = {}
    for n, _, t in page.segments:
        if t is not None and not page.off[n] and not t.isspace():
            own.setdefault(n, []).append(t)
    return {n: " ".join(" ".join(x).split()) for n, x in own.items()}


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's skeleton and, for its nodes with text of their own, the text's hash and length."""
    for whole in batches:
        for batch in by_bytes(whole, "html", SLICE_BYTES):
            skeletons, nodes, texts, sizes = [], [], [], []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                own = _own(page)
                skeletons.append(page.skeleton())
                nodes.append(list(own))
                texts.append([_hash(x) for x in own.values()])
                sizes.append([len(x) for x in own.values()])
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "skeleton": pa.array(skeletons, pa.string()), "nodes": pa.array(nodes, pa.list_(pa.int32())), "texts": pa.array(texts, pa.list_(pa.int64())), "sizes": pa.array(sizes, pa.list_(pa.int32()))})


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[align(s, w)[n] for n in ns] for s, w, ns in zip(batch.column("skeleton").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("nodes").to_pylist())]
        yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "salt_": batch.column("salt_"), "nodes": pa.array(out, pa.list_(pa.int32())), "texts": batch.column("texts"), "sizes": batch.column("sizes")})


def wrappers(pages: DataFrame, salt: int = 8) -> DataFrame:
    """(host, wrapper, template) of pages(host, html): the host's skeleton and, by number, its template nodes' texts.

    A node is template if one text is on SAME of the host's contents that have the node, of LEAST_PAGES at least. Pages
    are one content, however many they are, if they share the text of the host's body node, or, where they lack that
    node, all texts; so copies that differ in a date only count once. The body is the node whose different texts are
    longest on average, where nodes with fewer than LEAST_PAGES of these count for STILL of that.
    """
    seen = cut(pages.select("host", "html").mapInArrow(_summarise, _SUMMARY))
    counts = seen.groupBy("host", "skeleton").count()
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.col("count").desc(), "skeleton"))
    chosen = cut(counts.withColumn("first_", first).filter("first_ = 1").select("host", F.col("skeleton").alias("wrapper")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    rows = seen.withColumn("salt_", F.pmod(F.xxhash64("texts"), F.lit(salt)).cast("int")).join(chosen.withColumn("salt_", salts), ["host", "salt_"])
    rows = rows.select("host", "salt_", "skeleton", "wrapper", "nodes", "texts", "sizes").mapInArrow(_aligned, "host string, salt_ int, nodes array<int>, texts array<bigint>, sizes array<int>")
    rows = cut(rows.groupBy("host", "salt_", "nodes", "texts", "sizes").agg(F.lit(1).alias("one_")).drop("one_"))  # of exact copies one
    slots = rows.select("host", F.explode(F.arrays_zip("nodes", "texts", "sizes")).alias("x")).select("host", "x.*").filter("nodes >= 0")
    spread = slots.groupBy("host", "nodes", "texts").agg(F.max("sizes").alias("size_")).groupBy("host", "nodes").agg((F.avg("size_") * F.when(F.count("*") >= LEAST_PAGES, 1.0).otherwise(STILL)).alias("size_"))
    body = spread.groupBy("host").agg(F.max_by("nodes", F.struct("size_", -F.col("nodes"))).alias("body_"))
    rows = rows.join(body.withColumn("salt_", salts), ["host", "salt_"])
    content = F.coalesce(F.try_element_at("texts", F.nullif(F.array_position("nodes", F.col("body_")), F.lit(0)).cast("int")), F.xxhash64("nodes", "texts"))
    slots = rows.select("host", content.alias("content_"), F.explode(F.arrays_zip("nodes", "texts")).alias("x")).select("host", "content_", "x.*").filter("nodes >= 0").distinct()
    every = slots.select("host", "nodes", "content_").distinct().groupBy("host", "nodes").agg(F.count("*").alias("all_"))
    most = slots.groupBy("host", "nodes", "texts").agg(F.count("*").alias("n_")).groupBy("host", "nodes").agg(F.max(F.struct("n_", "texts")).alias("most_"))
    same = most.join(every, ["host", "nodes"]).filter((F.col("all_") >= LEAST_PAGES) & (F.col("most_.n_") >= SAME * F.col("all_")))
    by = same.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("nodes", "most_.texts"))).alias("template"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    return chosen.join(by, "host", "left").select("host", "wrapper", F.coalesce("template", none).alias("template"))


def main_text(page: Page, wrapper: str, template: dict[int, int]) -> str:
    """The page's text without parts that are named as no content, template, and slots that are links throughout.

    template has the constant text's hash by node of the wrapper; a node with another text is a slot like any other.
    """
    if len(page.labels) == 1:
        return page.text([True])
    to = align(page.skeleton(), wrapper)
    length, linked = [0] * len(to), [0] * len(to)
    for n, link, t in page.segments:
        if t is not None:
            size = len(t.strip())
            length[n] += size
            linked[n] += size * link
    open_ = [not off for off in page.off]
    own = _own(page) if template else {}
    fixed = [t in template and n in own and _hash(own[n]) == template[t] for n, t in enumerate(to)]
    if any(m and o and n for m, o, n in zip(page.main, open_, length)):
        return page.text([m and o and not f for m, o, f in zip(page.main, open_, fixed)])
    return page.text([o and not f and linked[n] <= 0.6 * length[n] for n, (o, f) in enumerate(zip(open_, fixed))])


def extract(pages: DataFrame, most_bytes: int = 16_000_000, salt: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html, ...).

    A null html is an empty page, whose text is empty; a null url, or one without ://, belongs to the host ''; pages
    without any markup are their own text; rows repeated in full are extracted one by one; an empty table gives an empty
    result. The hosts' wrappers are broadcast if they are measured to be within most_bytes, else joined with salt.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = cut(wrappers(pages, salt))
    n_bytes = known.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 12 * F.size("template") + 64)).first()[0] or 0
    if n_bytes <= most_bytes:
        rows = pages.join(F.broadcast(known), "host")
    else:
        spread = known.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        rows = pages.withColumn("salt_", F.pmod(F.xxhash64("page_id", "url"), F.lit(salt)).cast("int")).join(spread, ["host", "salt_"])
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "html", SLICE_BYTES):
                texts = [main_text(Page(h or ""), w, dict(t)) for h, w, t in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "template")))]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "wrapper", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
