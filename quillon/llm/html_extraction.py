"""HTML main-text extraction by a tree-structured graphical model over the DOM.

Each structural element is a variable (content or not) with a potential of its own features (tag, words of class, id
and role, amount of text and links, where it stands) and one with its parent for its kind of tag. Sum-product messages
go up and down the tree and yield exact content marginals; the text of elements with a marginal over 1/2 is the main
text. The same messages give the gradient of the likelihood, by which the potentials are trained on labelled pages
(training_pages.py). All pages of an Arrow batch are one forest, so messages are array operations for each depth.

Blocks are runs of text between block-level tags; <br> is white space. Character references are decoded, white space
becomes one space, blocks are joined by an empty line. Scripts, styles, templates, the head, drawings and the inside of form
controls have no text; what stands in any other element, formulas and fallbacks of objects and videos included, is judged by the
model.

A null or empty html gives the empty text; text without any tag is content. Unclosed and stray tags are mended as browsers
do in the common cases; parsing takes time in proportion to the page whatever its faults. A quote that never closes ends with its
tag at the next ">". Nothing is dropped for length. Equal pages have equal texts; repeated rows stay; null ids stay null. An empty table
gives no rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, type_of
from .training_pages import NAMES

BITS = 12
OPEN = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
#: For the rest of a page that has a tag whose last quote never closes: tags end at the next ">".
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
LABEL = re.compile(r'data-y="([01])"')

# Kinds of tags of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title select svg iframe button".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav noscript ol optgroup option p plaintext pre search
    section summary table tbody td tfoot th thead tr ul xmp""".split()
)
#: Inline elements that are judged by themselves, whether or not they have a name.
JUDGED = frozenset("label output meter progress datalist object canvas audio video noscript".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table")
#: Kinds of parent-child potentials, by the child's tag.
KINDS = {t: k for k, ts in enumerate(["", "p", "h1 h2 h3 h4 h5 h6", "div section", "article main", "ul ol li dl dt dd", "table tbody thead tr td th", "nav header footer aside form", "blockquote pre figure figcaption", "body html"]) for t in ts.split()}
N_KINDS = 10


@dataclass
class Page:
    """Element i: parent[i] (-1 of the root), depth, kind, slots of its features; runs: (element, block, text)."""

    parent: list[int]
    depth: list[int]
    kind: list[int]
    own: list[tuple[int, ...]]
    text: list[int]
    linked: list[int]
    main: list[int]
    label: list[int]
    runs: list[tuple[int, int, str]]


def slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


@lru_cache(maxsize=1 << 14)  # a cache only: what it holds doesn't change results
def own_slots(tag: str, names: str, main: int) -> tuple[int, ...]:
    words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()) if w}
    known = sorted(words & NAMES)  # all other words are one, so that none is taken for another
    return tuple(slot(x) for x in (f"t:{tag}", f"m:{tag}:{main}", *(f"n:{w}" for w in known), *(("n:?",) if words and not known else ()), *(() if words else ("n:",))))


class Stack:
    """Open elements, with the places of each tag and of the blocks among them, so that no step looks through the stack."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = [("", 0)]
        self.where: dict[str, list[int]] = {}
        self.blocks = [0]

    def last(self, tag: str) -> int:
        found = self.where.get(tag)
        return found[-1] if found else -1

    def push(self, tag: str, element: int) -> None:
        self.where.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, element))

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.where[tag].pop()
            if self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def close(self, tag: str) -> None:
        """An inline element closes within its block only."""
        at = self.last(tag)
        if at > 0 and (tag in BLOCK or at > self.blocks[-1]):
            self.cut(at)

    def make_way(self, tag: str) -> None:
        """What a new tag closes before it opens: an open paragraph, the item or cell before it."""
        if tag in CLOSES_P and (at := self.last("p")) > 0 and at == self.blocks[-1]:
            self.cut(at)
        if tag in SIBLINGS:
            scope = max(map(self.last, SCOPES))
            places = [at for t in SIBLINGS[tag] if (at := self.last(t)) > scope]
            if places:
                self.cut(min(places) if tag == "tr" else max(places))  # a row closes the cell and the row before it


@lru_cache(maxsize=64)
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)


def parse(html: str) -> Page:
    page = Page([-1], [0], [0], [own_slots("root", "", 0)], [0], [0], [0], [-1], [])
    parent, depth, kind, own, text, linked, main, label = page.parent, page.depth, page.kind, page.own, page.text, page.linked, page.main, page.label
    stack, unclosed = Stack(), set()
    runs, block, link, at, head = page.runs, 0, False, 0, False
    pattern, last_end = OPEN, html.rfind(">")

    def words(chunk: str) -> None:
        if head or not chunk or (chunk.isspace() and not runs):
            return
        now = stack.open[-1][1]
        n = len(chunk)
        text[now] += n
        if link:
            linked[now] += n
        runs.append((now, block, html_lib.unescape(chunk) if "&" in chunk else chunk))

    held = 0  # where the text begins that isn't given to words() yet
    while True:
        at = html.find("<", at)
        if at < 0 or at > last_end:
            break
        after = html[at + 1 : at + 2]
        if after in ("!", "?"):
            words(html[held:at])
            comment = html.startswith("<!--", at)
            end = html.find("-->", at + 4) if comment else html.find(">", at)
            at = held = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        found = pattern.match(html, at) if after == "/" or (after.isascii() and after.isalpha()) else None
        if not found:
            if pattern is OPEN and (after == "/" or (after.isascii() and after.isalpha())):
                if LOOSE.match(html, at):  # a quote that never closes: every later one might do the same
                    pattern = LOOSE
                    continue
            at += 1
            continue
        words(html[held:at])
        at = held = found.end()
        closing, tag, attrs = found.groups()
        tag = tag.lower()
        if closing:
            if tag == "head":
                head = False
            if tag == "a":
                link = False
            block += tag in BLOCK
            stack.close(tag)
        elif tag in RAW:
            if tag != "svg" or not attrs.endswith("/"):
                end = None if tag in unclosed else end_of(tag).search(html, at)
                if end:
                    at = held = end.end()
                elif tag in ("script", "style", "template", "textarea", "title"):
                    at = held = len(html)
                else:
                    unclosed.add(tag)
        elif tag == "head":
            head = True
        elif tag == "br":
            words(" ")
        elif tag not in VOID:
            if tag == "body":
                head = False
            name = NAMED.findall(attrs) if attrs else []
            if tag == "a":
                link = True
            if tag in BLOCK:
                block += 1
                stack.make_way(tag)
            if (tag in BLOCK or tag in JUDGED or name) and not attrs.endswith("/"):
                up = stack.open[-1][1]
                stack.push(tag, len(parent))
                parent.append(up)
                depth.append(depth[up] + 1)
                kind.append(KINDS.get(tag, 0))
                main.append(1 if tag in ("article", "main") or main[up] else 0)
                own.append(own_slots(tag, " ".join(a or b or c for a, b, c in name), main[-1]))
                text.append(0)
                linked.append(0)
                y = LABEL.search(attrs) if "data-y" in attrs else None
                label.append(int(y[1]) if y else label[up])
        elif tag == "hr":
            block += 1
            stack.make_way(tag)
    words(html[held:])
    return page


class Forest:
    """The elements of many pages, by depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        self.start = np.r_[0, np.cumsum(sizes)]
        shift = np.repeat(self.start[:-1], sizes)
        flat = lambda f: np.fromiter((x for p in pages for x in getattr(p, f)), dtype=np.int64, count=int(self.start[-1]))
        self.parent, self.depth, self.kind = flat("parent"), flat("depth"), flat("kind")
        self.parent = np.where(self.parent < 0, -1, self.parent + shift)
        self.label = flat("label")
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, cuts)
        text, linked, main = flat("text"), flat("linked"), flat("main")
        below, links = text.copy(), linked.copy()
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
            np.add.at(links, self.parent[level], links[level])
        has_main = np.repeat([int(any(p.main)) for p in pages], sizes)
        size = np.digitize(below, [1, 20, 80, 300])
        share = np.digitize(links / np.maximum(below, 1), [0.05, 0.5])
        where = np.where(main > 0, 0, np.where(has_main > 0, 1, 2))
        table = np.array([[[slot(f"f:{a}:{b}:{c}") for c in range(3)] for b in range(3)] for a in range(5)])
        more = np.stack([table[size, share, where], np.array([slot(f"w:{c}") for c in range(3)])[where]], axis=1)
        own = [s for p in pages for s in p.own]
        n = np.array([len(s) for s in own])
        self.rows = np.r_[np.repeat(np.arange(len(own)), n), np.repeat(np.arange(len(own)), 2)]
        self.slots = np.r_[np.fromiter((x for s in own for x in s), dtype=np.int64, count=int(n.sum())), more.ravel()]


@dataclass
class Model:
    """unary: weight of a feature for content; pair[kind, parent, child]: log potentials."""

    unary: np.ndarray
    pair: np.ndarray


def sum_product(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of elements (n x 2) and of pairs parent-child (n x 2 x 2; a root's are 0)."""
    n = len(f.parent)
    belief = np.zeros((2, n))
    belief[1] = np.bincount(f.rows, weights=m.unary[f.slots], minlength=n)
    pair = m.pair[f.kind]
    up = np.zeros((2, n))
    for level in f.levels[:0:-1]:  # leaves to roots
        parent, low, high = f.parent[level], belief[0, level], belief[1, level]
        first = np.flatnonzero(np.r_[True, np.diff(parent) != 0])  # children of one parent stand together
        for p in (0, 1):
            up[p, level] = sent = np.logaddexp(pair[level, p, 0] + low, pair[level, p, 1] + high)
            belief[p, parent[first]] += np.add.reduceat(sent, first)
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:  # roots to leaves
        rest = [[belief[p, f.parent[level]] - up[p, level] + pair[level, p, c] for c in (0, 1)] for p in (0, 1)]
        both = [[rest[p][c] + belief[c, level] for c in (0, 1)] for p in (0, 1)]
        total = np.logaddexp(np.logaddexp(both[0][0], both[0][1]), np.logaddexp(both[1][0], both[1][1]))
        for p in (0, 1):
            for c in (0, 1):
                joint[level, p, c] = np.exp(both[p][c] - total)
        for c in (0, 1):
            belief[c, level] += np.logaddexp(rest[0][c], rest[1][c])
    return np.exp(belief - np.logaddexp(belief[0], belief[1])).T, joint


def train(pages: list[str], steps: int = 400, rate: float = 0.1, ridge: float = 0.02) -> Model:
    """Maximum likelihood of the labels that data-y gives, by exact gradients from the marginals; nothing random."""
    f = Forest([parse(p) for p in pages])
    y = np.abs(f.label)  # the root, which has no label of its own, counts as content
    child = f.parent >= 0
    seen = np.bincount(f.slots, weights=y[f.rows], minlength=1 << BITS)
    seen_pair = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_pair, (f.kind[child], y[f.parent[child]], y[child]), 1)
    model = Model(np.zeros(1 << BITS), np.zeros((N_KINDS, 2, 2)))
    state = [np.zeros_like(model.unary), np.zeros_like(model.unary), np.zeros_like(model.pair), np.zeros_like(model.pair)]
    for t in range(1, steps + 1):
        one, joint = sum_product(f, model)
        g = seen - np.bincount(f.slots, weights=one[f.rows, 1], minlength=1 << BITS) - ridge * model.unary
        h = seen_pair - ridge * model.pair
        h -= np.stack([np.bincount(f.kind[child], weights=joint[child, p, c], minlength=N_KINDS) for p in (0, 1) for c in (0, 1)], axis=1).reshape(N_KINDS, 2, 2)
        h[:, 0, 0] = h[:, 1, 1] = (h[:, 0, 0] + h[:, 1, 1]) / 2  # one potential of agreement: which side a child stands for is its unary potential's
        for p, d, k in ((model.unary, g, 0), (model.pair, h, 2)):
            state[k] = 0.9 * state[k] + 0.1 * d
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * d * d
            p += rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-8)
    return model


def texts(pages: list[Page], model: Model) -> list[str]:
    forest = Forest(pages)
    content = sum_product(forest, model)[0][:, 1] > 0.5
    out = []
    for page, start in zip(pages, forest.start.tolist()):
        blocks: list[str] = []
        now, held = -1, []
        for element, block, chunk in page.runs:
            if block != now:
                if held and (joined := " ".join("".join(held).split())):
                    blocks.append(joined)
                now, held = block, []
            if content[start + element]:
                held.append(chunk)
        if held and (joined := " ".join("".join(held).split())):
            blocks.append(joined)
        out.append("\n\n".join(blocks))
    return out


def extract(df: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the columns also, text string of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size
    names = [id_col, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                found = texts([parse(t or "") for t in part.column(len(names)).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string())], names=[*names, "text"])

    columns: list[Column] = [F.col(f"`{c}`") for c in names]
    schema = ", ".join(f"`{c}` {type_of(df, c)}" for c in names)
    return df.select(*columns, F.col(f"`{html_col}`").cast("string").alias("_html")).mapInArrow(run, f"{schema}, text string")
