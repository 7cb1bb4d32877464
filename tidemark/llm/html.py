"""Main text of web pages by wrapper induction over the pages of a host.

Pages become element trees. Pages of a host with the same sections (a layout)
are aligned with the layout's reference page, the one with the least page_id, by
simple tree matching: roots of equal tags match, and the children's matches are
the best order-keeping ones. The unit of text is a block: what stands in a block
element, inline elements included. Over all pages of the layout it is counted,
for each reference node, how many pages match it, how many carry its very text
there, and how much text varies in it; and each text is counted by the node
above it, so what most pages say there is known even if the reference page says
something else, or nothing.

The main slot is found by going down from the root as long as one child that
holds further blocks has most of the varying text. A page's text is what stands
in its main slot, without template blocks: those that carry, at their place, the
very text that nearly all pages that have the place, or most pages of the
layout, carry. A block whose wording or numbers vary is content. A heading that
repeats stays if what follows it stays, and a marked article keeps all that
doesn't name itself a page part. A block only counts as template on the word of
several articles (pages with different wording), so copies of a page prove nothing.

Element names, roles and classes are a tie-break: inside the main slot they drop
what names itself a page part (a menu's and an advert's slots vary too), and they
choose the text alone where a layout has too few articles for induction.

Pages never gather in one task: reference pages, one per layout, are joined to
the pages, and the counts are added up before they are shuffled.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, table
from tidemark.session import ship, written

#: Least articles that vouch for a template node, and least share of pages that carry its text.
EVIDENCE, CONSTANT = 3, 0.9
#: Share of a slot's varying text that leads on to one child.
MOST = 0.6
#: Share of a layout's pages that repeat a text under the same node.
REPEATED = 0.5
#: Share of common words from which two texts of a node say nothing about where the varying text is.
ALIKE = 0.8
#: Counts that a task holds before it hands them on.
MOST_COUNTS = 100_000
#: Words whose hashes a worker remembers.
MOST_WORDS = 200_000
#: Pairs of sibling subtrees from which their sizes are found together, the most children of those, and the cells of one such step.
TOGETHER, MOST_CHILDREN, CELLS = 64, 24, 4 << 20
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Bytes of reference pages up to which they are broadcast; beyond, pages of a layout are dealt to this many keys.
BROADCAST_BYTES, SALTS = 8 << 20, 16

# Element names of the HTML standard, and names of page parts.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "dialog", "svg", "canvas", "object", "audio", "video", "map", "menu", *RAW}
PARTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: A start tag of the key ends an open element of the values, up to the bounds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "select", "article", "body"}
SECTIONS = "body|nav|header|main|article|aside|section|footer|form|table"
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: The rest of a tag, quoted values whole; nothing is tried twice.
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[^-_]+")


class Node:
    __slots__ = ("attributes", "children", "depth", "number", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None, number: int):
        self.tag, self.attributes, self.parent, self.number = tag, attributes, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []


def parse(page: str | None) -> list[Node]:
    """The elements of a page in document order; the first is an artificial root.

    One pass: a quote that is never closed makes quotes mean nothing from its tag
    on, so no part of the page is read more than twice.
    """
    page = page or ""
    nodes = [Node("#root", "", None, 0)]
    here, at, n, quoted = nodes[0], 0, len(page), True
    open_: Counter = Counter()

    def leave(to: Node) -> Node:
        up = here
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            here.children.append(page[at:])
            break
        m = None
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = n if end < 0 else end + 3
        elif page[begin + 1 : begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            end = n if end < 0 else end + 1
        else:
            m = _NAME.match(page, begin + 1)
            if not m:  # a lone bracket is text
                here.children.append(page[at : begin + 1])
                at = begin + 1
                continue
            rest = _REST.match(page, m.end()) if quoted else None
            if rest is None:
                quoted, end = False, page.find(">", m.end()) + 1
                if not end:
                    here.children.append(page[at:])
                    break
            else:
                end = rest.end()
        if begin > at:
            here.children.append(page[at:begin])
        at = end
        if m is None:
            continue
        tag, attributes = m[0].lower(), page[m.end() : end - 1]
        if tag[0] == "/":
            if open_[tag[1:]]:
                up = here
                while up.tag != tag[1:]:
                    up = up.parent
                here = leave(up.parent)
            continue
        if tag in BLOCK and open_["p"]:  # a block ends an open paragraph
            up = here
            while up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                here = leave(up.parent)
        if tag in CLOSES and any(open_[x] for x in CLOSES[tag]):
            up = here
            while up.parent and up.tag not in CLOSES[tag] and up.tag not in BOUNDS:
                up = up.parent
            if up.tag in CLOSES[tag]:
                here = leave(up.parent)
                if tag == "tr" and here.tag == "tr":
                    here = leave(here.parent)
        node = Node(tag, attributes, here, len(nodes))
        nodes.append(node)
        here.children.append(node)
        if tag in RAW:
            stop = _ENDS[tag].search(page, at)
            at = stop.end() if stop else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            open_[tag] += 1
            here = node
    return nodes


def shape(nodes: list[Node]) -> tuple[tuple[int, str], ...]:
    """(depth, tag) of each element in order: all that matching depends on."""
    return tuple((x.depth, x.tag) for x in nodes)


def _classes(s: tuple[tuple[int, str], ...], known: dict) -> tuple[list[list[int]], list[int]]:
    """The children of each node, and a number for its subtree: the same for equal ones."""
    below, path = [[] for _ in s], []
    for i, (depth, _) in enumerate(s):
        del path[depth:]
        if path:
            below[path[-1]].append(i)
        path.append(i)
    number = [0] * len(s)
    for i in range(len(s) - 1, -1, -1):
        number[i] = known.setdefault((s[i][1], *(number[j] for j in below[i])), len(known))
    return below, number


class Sizes(dict):
    """(class, class) -> match size, with tables for many pairs at once."""

    def __init__(self):
        self.tables: list[tuple[dict[int, int], np.ndarray]] = []
        self.of: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # class -> (table, row)

    def add(self, xs: list[int], ys: list[int], table: np.ndarray) -> None:
        for i, c in enumerate(xs):
            self.of[c].append((len(self.tables), i))
        self.tables.append(({d: k for k, d in enumerate(ys)}, table))

    def between(self, xs: list[int], ys: list[int]) -> np.ndarray:
        """The sizes of all pairs; zero for pairs of different tags."""
        out = np.zeros((len(xs), len(ys)), np.int64)
        columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, c in enumerate(xs):
            covered = 0
            for table, row in self.of.get(c, ()):
                if table not in columns:
                    at = np.array([self.tables[table][0].get(d, -1) for d in ys], np.int64)
                    columns[table] = np.flatnonzero(at >= 0), at[at >= 0]
                to, at = columns[table]
                out[i, to] = self.tables[table][1][row][at]
                covered = max(covered, len(to))
            if covered < len(ys):
                for k, d in enumerate(ys):
                    if (n := self.get((c, d))) is not None:
                        out[i, k] = n
        return out


def _aligned(x: list[int], y: list[int], size: Sizes) -> tuple[int, list[tuple[int, int]]]:
    """Greatest total size and position pairs of an order-keeping match of two levels; of equal ones the earliest.

    Equal heads always match. Only every ``step``-th row is kept; those between are made again.
    """
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    pairs = [(i, i) for i in range(head)]
    total = sum(size[c, c] for c in x[:head])
    x, y = x[head:], y[head:]
    if not x or not y:
        return total, pairs
    kinds, which = np.unique(y, return_inverse=True)
    rows_of = sorted(set(x))
    weights = dict(zip(rows_of, size.between(rows_of, kinds.tolist())[:, which]))

    def following(row, c):
        new = row.copy()  # a size of zero adds nothing, as not matching does
        np.maximum(new[1:], row[:-1] + weights[c], out=new[1:])
        return np.maximum.accumulate(new)

    step = int(len(x) ** 0.5) + 1
    row, saved = np.zeros(len(y) + 1, np.int64), {0: np.zeros(len(y) + 1, np.int64)}
    for i, c in enumerate(x, 1):
        row = following(row, c)
        if i % step == 0:
            saved[i] = row
    total += int(row[-1])
    found, i, k = [], len(x), len(y)
    rows, first = [], len(x) + 1
    while i and k:
        if i - 1 < first:  # the rows from the last saved one below i
            first = (i - 1) // step * step
            rows = [saved[first]]
            for c in x[first:i]:
                rows.append(following(rows[-1], c))
        here = rows[i - first]
        k = int(np.searchsorted(here[: k + 1], here[k]))  # the earliest of equal totals
        if not k:
            break
        if here[k] == rows[i - 1 - first][k]:
            i -= 1
        else:
            found.append((head + i - 1, head + k - 1))
            i, k = i - 1, k - 1
    return total, pairs + found[::-1]


def _sizes(xs: list[int], ys: list[int], kinds: list[tuple], size: Sizes) -> None:
    """Add the match sizes of all pairs of subtrees of one tag; those of their children are known."""
    below_x, below_y = (sorted({c for a in side for c in kinds[a][1:]}) for side in (xs, ys))
    weights = np.zeros((len(below_x) + 1, len(below_y) + 1), np.int64)  # the last row and column stand for no child
    weights[:-1, :-1] = size.between(below_x, below_y)
    longest = [max(len(kinds[a]) - 1 for a in side) for side in (xs, ys)]
    weights = weights.astype(np.int16 if weights.max() * min(longest) < 1 << 14 else np.int32)
    numbers = {c: i for i, c in enumerate(below_x)}, {c: i for i, c in enumerate(below_y)}
    left, right = (np.array([[number[c] for c in kinds[a][1:]] + [len(number)] * (long - len(kinds[a]) + 1) for a in side], np.int64).reshape(len(side), long) for side, number, long in zip((xs, ys), numbers, longest))
    table = np.empty((len(xs), len(ys)), weights.dtype)
    step = max(1, CELLS // (len(ys) * (longest[1] + 1)))
    for at in range(0, len(xs), step):
        some = left[at : at + step]
        row = np.zeros((longest[1] + 1, len(some), len(ys)), weights.dtype)
        for i in range(longest[0]):
            w, new = weights[some[:, i]], np.zeros_like(row)
            for k in range(longest[1]):
                np.maximum(row[k] + w[:, right[:, k]], row[k + 1], out=new[k + 1])
                np.maximum(new[k + 1], new[k], out=new[k + 1])
            row = new
        table[at : at + step] = row[-1] + 1
    size.add(xs, ys, table)


@functools.lru_cache(2048)
def match(left: tuple[tuple[int, str], ...], right: tuple[tuple[int, str], ...]) -> tuple[int, ...]:
    """For each left node the right node it matches, or -1, by simple tree matching."""
    known: dict[tuple, int] = {}
    below_l, class_l = _classes(left, known)
    below_r, class_r = _classes(right, known)
    kinds = list(known)  # by number: tag, numbers of the children
    size = Sizes()
    for c, (_, *children) in enumerate(kinds):  # equal subtrees match as a whole
        size[c, c] = 1 + sum(size[d, d] for d in children)
    if left[0][1] != right[0][1]:
        return (-1,) * len(left)
    todo: list[tuple[tuple[int, ...], tuple[int, ...]]] = [((class_l[0],), (class_r[0],))]
    ready: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
    while todo:
        xs, ys = here = todo[-1]
        if here not in ready:  # first the pairs of their children, by tag; many pairs go as one step
            ready.add(here)
            by_tag: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
            for side, classes in enumerate(here):
                for c in {c for a in classes for c in kinds[a][1:]}:
                    by_tag[kinds[c][0]][side].add(c)
            for u, v in by_tag.values():
                wide = [tuple(sorted(c for c in w if len(kinds[c]) - 1 <= MOST_CHILDREN)) for w in (u, v)]
                if len(wide[0]) * len(wide[1]) >= TOGETHER:
                    todo += [(tuple(wide[0]), tuple(wide[1]))] * ((tuple(wide[0]), tuple(wide[1])) not in ready)
                else:
                    wide = [(), ()]
                together = set(wide[0]), set(wide[1])
                todo += [((c,), (d,)) for c in u for d in v if (c, d) not in size and not (c in together[0] and d in together[1])]
            continue
        todo.pop()
        if len(xs) * len(ys) > 1:
            _sizes(list(xs), list(ys), kinds, size)
        elif (xs[0], ys[0]) not in size:
            size[xs[0], ys[0]] = 1 + _aligned(kinds[xs[0]][1:], kinds[ys[0]][1:], size)[0]
    out = [-1] * len(left)
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    nodes = [(0, 0)]
    while nodes:
        a, b = nodes.pop()
        out[a] = b
        c = class_l[a], class_r[b]
        if c not in chosen:
            chosen[c] = [(i, i) for i in range(len(below_l[a]))] if c[0] == c[1] else _aligned(kinds[c[0]][1:], kinds[c[1]][1:], size)[1]
        nodes += [(below_l[a][i], below_r[b][k]) for i, k in chosen[c]]
    return tuple(out)


def block_texts(nodes: list[Node]) -> list[str]:
    """The text of each block element, inline elements included and further blocks not; nothing for inline ones."""
    parts: list[list[str]] = [[] for _ in nodes]
    todo: list[tuple[Node | str, int]] = [(nodes[0], 0)]
    while todo:
        x, owner = todo.pop()
        if isinstance(x, str):
            parts[owner].append(x)
        elif x.tag not in RAW:
            owner = x.number if x.tag in BLOCK else owner
            if x.tag == "br" or x.tag in BLOCK and x.parent:
                parts[owner if x.tag == "br" else x.parent.number].append(" ")
            todo += [(c, owner) for c in reversed(x.children)]
    return [" ".join(entities.unescape("".join(p)).split()) for p in parts]


_DIGITS = re.compile("[0-9]+")


def folded(text: str) -> str:
    """Lower case, numbers alike."""
    return _DIGITS.sub("0", text.lower())


def alike(a: str, b: str) -> bool:
    """Equal but for case and numbers, or nearly all words in common."""
    if a == b:
        return True
    if not a or not b or not 0.5 <= len(a) / len(b) <= 2:
        return False
    x, y = folded(a), folded(b)
    if x == y:
        return True
    u, v = set(x.split()), set(y.split())
    return len(u & v) >= ALIKE * len(u | v)


def part(value: str) -> bool:
    """Whether one whole token of a class or id names a page part (``cookie-banner``, not ``has-sidebar``)."""
    return any(names and PARTS.issuperset(names) for names in map(_WORDS.findall, value.split()))


def dropped(node: Node, kept: set[int] = frozenset()) -> bool:
    """Whether the element's tag, role, class or id says that it isn't article text; class and id don't count in ``kept``."""
    if node.tag in DROPPED:
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in ROLES or name in ("class", "id") and node.number not in kept and part(value):
            return True
    return False


def _above(x: Node | None, into: set[int]) -> None:
    while x and x.number not in into:
        into.add(x.number)
        x = x.parent


def main_text(nodes: list[Node], template: set[int] = frozenset(), main: Node | None = None) -> str:
    """The blocks of the main slot (of the page, without one), less the own text of the block elements of ``template``.

    Articles marked as such in the slot are the text if there are any, and keep
    their template blocks. No class or id drops a main or what holds it or the
    slot, nor what holds the only articles, unless more text is outside them.
    """
    top = main or nodes[0]
    inside = [False] * len(nodes)
    for x in nodes:  # parents come first
        inside[x.number] = x is top or x.parent is not None and inside[x.parent.number]
    marked = [x for x in nodes if inside[x.number] and (x.tag in ("article", "main") or x.tag == "div" and 'itemprop="articleBody"' in x.attributes)]
    kept: set[int] = set()
    _above(top, kept)
    for x in marked:
        if x.tag == "main":
            _above(x, kept)
    gone = _gone(nodes, kept, top)
    text = _blocks(nodes, marked, gone, template, top)
    if marked and all(gone[x.number] for x in marked):
        for x in marked:
            if not dropped(x):
                _above(x.parent, kept)
        other = _blocks(nodes, marked, _gone(nodes, kept, top), template, top)
        return max(text, other, key=len)
    return text


def _gone(nodes: list[Node], kept: set[int], top: Node) -> list[bool]:
    """Which elements are dropped or below a dropped one; nothing above ``top`` drops it."""
    out, held = [], []
    for x in nodes:
        up = x.parent
        held.append(x.tag in ("article", "main") or up is not None and held[up.number])
        out.append(x is not top and (up is not None and out[up.number] or x.tag == "header" and not held[-1] or dropped(x, kept)))
    return out


def _blocks(nodes: list[Node], marked: list[Node], gone: list[bool], template: set[int], top: Node) -> str:
    marked = [x for x in marked if not gone[x.number]]
    articles = {x.number for x in marked if x.tag != "main"} or {x.number for x in marked}
    under = [False] * len(nodes)
    for x in nodes:
        if x.parent:
            under[x.number] = under[x.parent.number] or x.parent.number in articles
    roots = [nodes[i] for i in sorted(articles) if not under[i]] or [top]
    if any(x.tag != "main" for x in roots) and articles:
        template = frozenset()  # the page itself says that this is the article
    blocks: list[tuple[Node, list[str]]] = []

    def walk(root: Node) -> None:
        todo: list[tuple[Node | str | None, Node]] = [(root, root)]
        while todo:
            x, owner = todo.pop()
            if x is None:
                blocks.append((owner, []))
            elif isinstance(x, str):
                blocks[-1][1].append(x)
            elif not gone[x.number]:
                edge = x.tag in BLOCK
                todo += [(None, owner)] * edge
                todo += [(c, x if edge else owner) for c in reversed(x.children)]
                todo += [(None, x)] * edge
                if x.tag == "br":
                    blocks[-1][1].append(" ")

    for root in roots:
        blocks.append((root, []))
        walk(root)
    lines, follows = [], False
    for owner, pieces in reversed(blocks):
        line = " ".join(entities.unescape("".join(pieces)).split())
        if not line:
            continue
        stays = owner.number not in template or owner.tag in HEADINGS and follows
        if owner.tag not in HEADINGS:
            follows = stays
        if stays:
            lines.append(line)
    return "\n".join(reversed(lines))


@functools.lru_cache(256)
def _reference(page: str):
    nodes = parse(page)
    return nodes, shape(nodes), block_texts(nodes)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORD_HASHES = _WordHashes()


def identity(texts: list[str]) -> int:
    """The least hashes, by two orders, of a page's runs of three words: mostly the same for pages with mostly the same text.

    Two, so that a template that all pages share seldom makes them one by giving the least hash.
    """
    words = [w for t in texts for w in t.split()]
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    odd = np.uint64(0x9E3779B97F4A7C15)
    if len(h) > 2:
        h = ((h[:-2] * odd ^ h[1:-1]) * odd ^ h[2:]) * odd
    least = []
    for _ in range(2):
        least.append(int(h.min(initial=np.uint64((1 << 64) - 1))))
        h = (h ^ h >> np.uint64(29)) * odd
    return _hash(" ".join(map(str, least)))


def _texts(nodes: list[Node], pairs: tuple[int, ...], texts: list[str], known: list[str]) -> Iterator[tuple[int, int, int, bool]]:
    """(element, reference node it matches or else stands under, that of its parent, whether it has the reference's text) of the blocks with text."""
    above = list(pairs)
    for x in nodes:
        i = x.number
        if above[i] < 0 and x.parent:
            above[i] = above[x.parent.number]
        if texts[i] and above[i] >= 0:
            yield i, above[i], above[x.parent.number] if x.parent else 0, pairs[i] >= 0 and texts[i] == known[pairs[i]]


def _counted(batches):
    """Per layout and reference node: pages that match it, that carry its text, varying characters, a few identities; and, per text in a node's children (with its hash), the pages that have it."""
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def rows(seen):
        keys, found = list(seen), list(seen.values())
        columns = [*([k[i] for k in keys] for i in range(4)), *([r[i] for r in found] for i in range(3)), [sorted(r[3]) for r in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "layout", "node", "line", "n", "same", "mass", "who"])

    seen: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, set()])
    for batch in batches:
        for host, layout, page, reference in zip(*(batch.column(i).to_pylist() for i in range(4))):
            nodes = parse(page)
            _, like, known = _reference(reference)
            pairs = match(shape(nodes), like)
            texts = block_texts(nodes)
            who = identity(texts)
            same: set[int] = set()
            lines: set[tuple[int, int]] = set()
            for i, j, up, equal in _texts(nodes, pairs, texts, known):
                lines.add((up, _hash(texts[i])))
                if equal:
                    same.add(j)
                elif pairs[i] < 0 or not alike(texts[i], known[j]):
                    seen[host, layout, j, 0][2] += len(texts[i])
            for j in pairs:
                if j >= 0:
                    entry = seen[host, layout, j, 0]
                    entry[0] += 1
                    entry[1] += j in same
                    if (j in same or j == 0) and len(entry[3]) < EVIDENCE:
                        entry[3].add(who)
            for j, line in lines:
                entry = seen[host, layout, j, line]
                entry[0] += 1
                if len(entry[3]) < EVIDENCE:
                    entry[3].add(who)
            if len(seen) >= MOST_COUNTS:
                yield rows(seen)
                seen.clear()
    yield rows(seen)


def main_slot(nodes: list[Node], mass: list[int]) -> int:
    """The reference node reached from the root through children with most of the varying text; ``mass`` is each node's own."""
    below, own = list(mass), list(mass)
    for x in reversed(nodes):
        if x.parent:
            below[x.parent.number] += below[x.number]
    here = nodes[0]
    while True:
        best = max((c for c in here.children if not isinstance(c, str)), key=lambda c: (below[c.number], -c.number), default=None)
        if best is None or below[best.number] < MOST * below[here.number] or not below[best.number]:
            return here.number
        if best.tag not in BLOCK or best.tag in ("p", "pre", "li", "td", "dd", "dt") or best.tag.startswith("h") and best.tag[1:].isdigit():
            return here.number  # text, not a slot of blocks
        here = best


def _wrapper(group, reference):
    """One row (host, layout, reference, main, template, nodes and lines) of a layout's counts."""
    node, line, n, same, mass, who = (group.column(c).to_pylist() for c in ("node", "line", "n", "same", "mass", "who"))
    page = reference.column("reference")[0].as_py()
    nodes, _, _ = _reference(page)
    vary, template, lines, articles = [0] * len(nodes), [], [], 0
    for j, h, c, s, m, w in zip(node, line, n, same, mass, who):
        if h:
            lines.append((j, h))
            continue
        vary[j] = m
        if c >= EVIDENCE and s >= CONSTANT * c and len(w) >= EVIDENCE:
            template.append(j)
        if j == 0:
            articles = len(w)
    main = main_slot(nodes, vary) if articles >= EVIDENCE and sum(vary) else -1
    columns = {"host": reference.column("host"), "layout": reference.column("layout"), "reference": reference.column("reference"), "main": pa.array([main], pa.int32())}
    lists = {"template": (sorted(template), pa.int32()), "places": ([j for j, _ in sorted(lines)], pa.int32()), "lines": ([h for _, h in sorted(lines)], pa.int64())}
    return pa.table(columns | {name: pa.array([v], pa.list_(t)) for name, (v, t) in lists.items()})


def _extracted(batches):
    for batch in batches:
        out = []
        for page, reference, main, template, places, lines in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
            nodes = parse(page)
            constant, slot = set(), None
            if reference is not None and main is not None and main >= 0:
                _, like, known = _reference(reference)
                pairs, texts = match(shape(nodes), like), block_texts(nodes)
                fixed, repeated = set(template), set(zip(places, lines))
                constant = {i for i, j, up, equal in _texts(nodes, pairs, texts, known) if equal and j in fixed or (up, _hash(texts[i])) in repeated}
                slot = next((x for x in nodes if pairs[x.number] == main), None)
            out.append((main_text(nodes, constant, slot), len(nodes), len(constant), slot is not None))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [[x[0] for x in out], [len(x[0]) for x in out], [x[1] for x in out], [x[2] for x in out], [x[3] for x in out]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types)]], ["page_id", "url", "text", "n_chars", "n_elements", "n_template", "induced"])


def layout_of(page: Column) -> Column:
    """Which sectioning elements a page has: pages that differ here are wrapped apart."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(page), F.lit(rf"<({SECTIONS})[\s>]"), F.lit(1)))), ",")


def wrappers(rows: DataFrame) -> DataFrame:
    """One row per (host, layout) of (host, layout, page_id, html): reference page, main slot (-1: none), template nodes, repeated lines and their places."""
    ship(rows.sparkSession)
    # one page per layout survives in each task before the shuffle
    references = written(rows.where("host <> ''").groupBy("host", "layout").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "html")).alias("r")).select("host", "layout", F.col("r.html").alias("reference")), "references")
    counts = arrow_map(_joined(rows, references, "inner").select("host", "layout", "html", "reference"), _counted, "host string, layout string, node int, line bigint, n bigint, same bigint, mass bigint, who array<bigint>")
    total = written(counts.groupBy("host", "layout", "node", "line").agg(F.sum("n").alias("n"), F.sum("same").alias("same"), F.sum("mass").alias("mass"), F.slice(F.array_distinct(F.flatten(F.collect_list("who"))), 1, EVIDENCE).alias("who")).where((F.col("line") == 0) | ((F.col("n") >= EVIDENCE) & (F.size("who") >= EVIDENCE))), "counts")
    # each kept line is on half of the pages, so a layout keeps at most two pages' worth of them
    pages = total.where("node = 0 and line = 0").select("host", "layout", F.col("n").alias("pages"))
    several = total.join(pages, ["host", "layout"]).where((F.col("line") == 0) | (F.col("n") >= REPEATED * F.col("pages"))).drop("pages")
    made = several.groupBy("host", "layout").cogroup(references.groupBy("host", "layout")).applyInArrow(_wrapper, "host string, layout string, reference string, main int, template array<int>, places array<int>, lines array<bigint>")
    return written(made, "wrappers")


def _joined(rows: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """Pages with their layout's row of ``small``: broadcast up to BROADCAST_BYTES, else joined with a layout's pages dealt to SALTS keys."""
    size = small.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), ["host", "layout"], how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return salted.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "layout", "salt"], how)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: its main text, how many elements it has and were template, whether its layout's main slot was found.

    Null html is empty and gives an empty text; a null or hostless url, or a
    layout with fewer than EVIDENCE articles, leaves the choice to element names;
    pages with equal or much the same html count as one article when a template
    is judged, so rows may repeat; an empty table gives no rows; further columns
    are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    rows = pages.select(F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host")).withColumn("layout", layout_of(F.col("html")))
    marked = _joined(rows, wrappers(rows), "left").select("page_id", "url", "html", "reference", "main", "template", "places", "lines")
    return arrow_map(marked, _extracted, "page_id bigint, url string, text string, n_chars bigint, n_elements bigint, n_template bigint, induced boolean")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, rules as in ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
