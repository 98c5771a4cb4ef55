"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks, the stretches of text between block-level tags, each with the elements
around it. Features are the ancestors' tags and the words of their class and id, and properties of the text.
The field has two labels, main text and the rest; it is trained on labelled pages by Adam on the exact
likelihood and decoded by Viterbi.

Defined cases: a null or empty html gives an empty text. Unclosed and stray tags are taken as browsers take
them, roughly: a paragraph ends where the next block begins, the head at the first thing that belongs into a
body. Reading takes time and memory in proportion to the page, however deep elements nest. Scripts, styles, comments and the like are no
text. Repeated rows give repeated results. Other columns are ignored. An empty table gives an empty result.
Pages are read whole, and nothing of the main text is capped.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table
from .html_pages import labelled_pages

SCHEMA = "page_id long, url string, text string, n_chars long"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>",
    re.S,
)
COMMENT = re.compile(r"<!--.*", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements of HTML, as its standard groups them.
HIDDEN = frozenset("script style noscript template iframe object svg math canvas audio video select textarea head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img acronym".split())
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ITEM_LIMITS = frozenset("ul ol dl table tbody thead div section article body".split())


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a head may hold.
METADATA = frozenset("head base link meta title style script noscript template".split())

#: Features of the elements around a block, the nearest tag that isn't inline, and whether any has names. Elements
#: that add nothing share their parent's, so deep nesting takes no more memory.
Path = tuple[frozenset[str], str, bool]
TOP: Path = (frozenset(), "none", False)


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: Path, linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order. known: the features worth keeping; all if None."""
    blocks: list[Block] = []
    stack: list[tuple[str, Path]] = []  # tag, path up to it
    count: Counter = Counter()  # of open tags
    held: list[tuple[str, bool]] = []
    path = TOP

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(html.unescape("".join(x for x, _ in held)).split())
            if text:
                linked = sum(len(x.strip()) for x, y in held if y)
                blocks.append(Block(text, path, linked))
            held = []

    def pop_to(n: int) -> None:
        nonlocal hidden, path
        while len(stack) > n:
            tag = stack.pop()[0]
            count[tag] -= 1
            hidden -= tag in HIDDEN
        path = stack[-1][1] if stack else TOP

    def leave_head() -> None:
        """Ends the head, and what is open in it."""
        if count["head"]:
            pop_to(next(i for i, (t, _) in enumerate(stack) if t == "head"))

    at, end, hidden = 0, len(page), 0
    last = page.rfind(">")  # no tag ends after it
    while at < end:
        m = TAG.search(page, at) if at <= last else COMMENT.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            if stack and stack[-1][0] == "head" and not page[at:stop].isspace():
                leave_head()
            if not hidden:
                held.append((page[at:stop], count["a"] > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is TAG else ""
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            if count[tag]:
                found = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if not (tag in INLINE and any(t not in INLINE for t, _ in stack[found + 1 :])):
                    pop_to(found)
            continue
        if stack and stack[-1][0] == "head" and tag not in METADATA:
            leave_head()
        if tag in VOID:
            if tag in ("br", "hr") and not hidden:
                held.append((" ", False)) if tag == "br" else flush()
            continue
        if tag not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            if tag in ENDS_ITSELF:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ENDS_ITSELF[tag]:
                        pop_to(i)
                    elif stack[i][0] in ITEM_LIMITS and not (tag in ("tr", "td", "th") and stack[i][0] in ("div", "section", "article")):
                        break
        if tag == "body" and hidden:
            pop_to(0)
        if (m[3] or m[6] or "").endswith("/") and tag in INLINE:
            continue
        names = "".join(" " + (a or b or c) for a, b, c in NAMED.findall(m[3] or m[6] or ""))
        words = sorted({w for w in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names).lower())})
        if tag not in INLINE or words:
            around, near, named = path
            new = {f for f in (f"in:{tag}", *(f"name:{w}" for w in words)) if f not in around and (known is None or f in known)}
            path = (around | new if new else around, near if tag in INLINE else tag, named or bool(words))
        stack.append((tag, path))
        count[tag] += 1
        hidden += tag in HIDDEN
        if tag in RAW:
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            after = page.find(">", close.end()) if close else -1
            if after < 0:
                break
            if tag == "title" and not hidden:
                held.append((page[at : close.start()], False))
            at = after + 1
            pop_to(len(stack) - 1)
    flush()
    return blocks


def path_features(path: Path) -> tuple[str, ...]:
    """Of the elements around: every tag and name, and the nearest tag that isn't inline."""
    around, near, named = path
    return (*sorted(around), f"near:{near}", f"bare:{not named}:{near}")


def _step(x: float, ends: tuple[float, ...]) -> int:
    return sum(x > e for e in ends)


#: How lines on rights are marked.
RIGHTS = re.compile(r"©|\bcopyright\b|\(c\)|all rights reserved", re.I)


def _links(blocks: list[Block], at: int) -> int:
    """How much of a block is links, in steps; -1 beyond the page."""
    if not 0 <= at < len(blocks):
        return -1
    return _step(min(1.0, blocks[at].linked / len(blocks[at].text)), (0.05, 0.5, 0.9))


def text_features(blocks: list[Block], at: int) -> list[str]:
    """Of a block's text, and of the blocks beside it: how much of them is links, and what heading it follows."""
    block, count = blocks[at], len(blocks)
    text = block.text
    size, words = len(text), text.count(" ") + 1
    stops = text.count(".") + text.count("!") + text.count("?")
    long = _step(words, (1, 3, 6, 12, 25, 50, 120))
    link, before, after = (_links(blocks, i) for i in (at, at - 1, at + 1))
    near = block.path[1]
    out = [
        f"words:{long}",
        f"link:{link}",
        f"long and link:{min(long, 5)}:{link}",
        f"end:{text[-1] in '.!?…:»”'}:{min(long, 4)}",
        f"commas:{min(2, text.count(','))}",
        f"stops:{min(2, stops)}",
        f"digits:{_step(sum(map(text.count, '0123456789')) / size, (0.05, 0.3))}",
        f"place:{_step(at / count, (0.1, 0.3, 0.7, 0.9))}",
        f"beside:{before}:{link}:{after}",
        f"{near}:{min(long, 4)}:{link}",
        "always",
    ]
    if RIGHTS.search(text):
        out += ["rights", f"rights:{min(long, 5)}:{at == count - 1}"]
    if at and blocks[at - 1].path[1] in HEADINGS:
        out.append(f"under:{min(long, 4)}:{link}")
    if at == 0:
        out.append("first")
    if at == count - 1:
        out.append("last")
    return out


class Field:
    """Weights of features for the main text against the rest, and of label pairs."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, pair: np.ndarray):
        self.weight = {f: float(weight[i]) for f, i in index.items()}
        self.pair = pair.tolist()
        self.known = frozenset(self.weight)
        self.paths: dict[Path, float] = {}

    def _path(self, path: Path) -> float:
        if (w := self.paths.get(path)) is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            w = self.paths[path] = sum(self.weight.get(f, 0.0) for f in path_features(path))
        return w

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        (rr, rm), (mr, mm) = self.pair
        weight = self.weight
        back, rest, main = [], 0.0, 0.0
        for at, block in enumerate(blocks):
            e = self._path(block.path) + sum(weight.get(f, 0.0) for f in text_features(blocks, at))
            if at:
                from_main = (main + mr > rest + rr, main + mm > rest + rm)
                rest, main = (main + mr if from_main[0] else rest + rr), (main + mm if from_main[1] else rest + rm)
                back.append(from_main)
            main += e
        labels = [int(main > rest)] if blocks else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def aligned(page: str, truth: list[tuple[str, int]]) -> tuple[list[Block], list[int]]:
    """A labelled page's leaf blocks with their labels, matched by text in order; title blocks are the rest."""
    blocks = leaf_blocks(page)
    left = list(truth)
    labels = []
    for b in blocks:
        hit = next((i for i, (t, _) in enumerate(left) if " ".join(t.split()) == b.text), None)
        labels.append(left.pop(hit)[1] if hit is not None else 0)
    return blocks, labels


def fit(samples: list[tuple[list[Block], list[int]]], rounds: int = 27, rate: float = 0.1, decay: float = 0.002) -> Field:
    """The field of highest likelihood, less a Gaussian penalty, over labelled sequences."""
    index: dict[str, int] = {}
    pages = []
    for blocks, labels in samples:
        if blocks:
            rows = [[index.setdefault(f, len(index)) for f in (*path_features(b.path), *text_features(blocks, i))] for i, b in enumerate(blocks)]
            pages.append((rows, np.array(labels)))
    weight, pair = np.zeros(len(index)), np.zeros((2, 2))
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weight, pair)]
    rng, turn = np.random.default_rng(0), 0
    for _ in range(rounds):
        order = rng.permutation(len(pages))
        for start in range(0, len(order), 50):
            g_weight, g_pair = np.zeros_like(weight), np.zeros_like(pair)
            some = [pages[i] for i in order[start : start + 50]]
            for rows, labels in some:
                e = [float(weight[r].sum()) for r in rows]
                node, edge = marginals(e, pair)
                for r, y, p in zip(rows, labels, node, strict=True):
                    g_weight[r] += y - p
                np.add.at(g_pair, (labels[:-1], labels[1:]), 1)
                g_pair -= edge
            turn += 1
            for x, g, (m, v) in zip((weight, pair), (g_weight, g_pair), state, strict=True):
                g = g / len(some) - decay * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(index, weight, pair)


def marginals(e: list[float], pair: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Each block's probability of being main text, and the expected counts of label pairs, by forward and
    backward sums. e: score of the main text against the rest; probabilities are scaled at each step."""
    t = np.exp(pair).tolist()
    forward, scale = [], []
    a = (1.0, math.exp(min(e[0], 500.0)))
    for i in range(len(e)):
        if i:
            x = math.exp(max(-500.0, min(e[i], 500.0)))
            a = (a[0] * t[0][0] + a[1] * t[1][0], (a[0] * t[0][1] + a[1] * t[1][1]) * x)
        s = a[0] + a[1]
        a = (a[0] / s, a[1] / s)
        forward.append(a)
        scale.append(s)
    edge = np.zeros((2, 2))
    node = [0.0] * len(e)
    b = (1.0, 1.0)
    node[-1] = forward[-1][1]
    for i in range(len(e) - 1, 0, -1):
        x = math.exp(max(-500.0, min(e[i], 500.0)))
        f = forward[i - 1]
        p = [[f[y] * t[y][z] * (x if z else 1.0) * b[z] / scale[i] for z in (0, 1)] for y in (0, 1)]
        edge += p
        b = tuple((t[y][0] * b[0] + t[y][1] * x * b[1]) / scale[i] for y in (0, 1))
        node[i - 1] = p[1][0] + p[1][1]
    return node, edge


@functools.lru_cache(maxsize=4)
def trained(pages: int = 600) -> Field:
    """The field fitted on that many labelled pages; a bounded sample, so it is fitted once, on the driver."""
    return fit([aligned(p, truth) for p, truth in labelled_pages(pages)])


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page, field.known)
    return " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html). Rows are read by
    themselves: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html", 8 << 20):
            made = pa.array([main_text(x, field) if x else "" for x in batch.column("html").to_pylist()], pa.string())
            n = pc.utf8_length(made).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), made, n], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, SCHEMA)


def op4_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
