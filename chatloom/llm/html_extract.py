"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element of the page's tree is a node with a hidden state: structure, content
or furniture. A node's evidence is a handful of discrete features; a parent and its
child are tied by a potential, so that what lies in an article tends to be article
and what lies in a menu is menu. Messages are passed from the leaves to the root and
back (sum-product), which is exact on a tree and linear in its size, and give each
node's marginal. Text directly in a node that is more likely content than not is
taken, block by block.

Potentials are learned from labelled pages, where the states are known: smoothed
counts of (parent state, state) and of (state, feature value). Pages label
themselves where they have an ``article`` (else ``main``) element: what is inside it
is content, but for its menus, notes, forms and comments. Every such page is counted
a second time with that element made anonymous, so that pages without one are read
by their other features. What tags say (``nav``) is a fixed potential; what words of
class, id and role say (``class="sidebar"``) is a feature of a few nats like the
others, which an element's text, place and children can outweigh.

Defined results: a null or empty html, and a page without content, give an empty
text; broken, unclosed and truncated markup is read as far as it goes; comments,
scripts, styles and templates never give text; repeated rows give repeated results;
an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import arrow_batches

#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not read as markup.
RAW = frozenset("script style noscript template textarea title svg iframe select annotation annotation-xml".split())
#: Where such an element ends; A-Z in either case.
RAW_ENDS = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
#: Elements that stand inside a line and do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mtable mtr mtd mspace mstyle mpadded mphantom menclose mmultiscripts semantics".split())
#: What a new element of a kind closes before it opens, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
CONTAINERS = frozenset("ul ol dl table body article section main div nav aside header footer form blockquote html".split())
#: Names of page furniture, as tags and as words of class, id and role.
FURNITURE_TAGS = frozenset("nav aside header footer form button menu dialog head".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "login search share sharing social related recommended comment comments commentlist disqus respond reply replies widget toolbar pager "
    "pagination skip complementary contentinfo search form alert toast tags meta byline".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_WORDS = frozenset("article content post entry story main body text prose articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = HEADINGS | {"p"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A comment, a section, a declaration, or the begin of a tag; ``Tags`` finds where its name and the tag end.
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)(?=[a-zA-Z])", re.S)
NAME_END = re.compile(r"[\s/>]")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[a-z]+")
#: Class names that tell what is beside an element, not what it is.
STATES = re.compile(r"(?<![\w-])(?:has|with|no|without|hide|show|is)-[\w-]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
UNSEEN = re.compile(r"\shidden(?=[\s/=]|$)")
BLANK = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    mark: int  # what its name says, see NAMES
    texts: list[tuple[int, str]] = field(default_factory=list)  # (block, text) directly inside


class Tags:
    """Ends of a page's tags, found in one pass over the page even where tags and quotes are left open."""

    def __init__(self, source: str):
        self.source, self.last, self.named = source, source.rfind(">"), 0
        #: Quotes that do not come again, and where a tag that never ended was outside of quotes.
        self.gone: set[str] = set()
        self.outside: list[tuple[int, int]] = []

    def name_end(self, at: int) -> int:
        """Behind the name that begins at ``at``; -1 if no tag can end after it."""
        if at > self.last:
            return -1
        if at >= self.named:
            self.named = NAME_END.search(self.source, at).start()
        return self.named

    def end(self, at: int) -> int:
        """Behind the ``>`` of the tag whose attributes begin at ``at``; -1 if it has none."""
        if at > self.last:
            return -1
        k = bisect_right(self.outside, (at, len(self.source)))
        if k and at < self.outside[k - 1][1]:
            return -1
        spans, begun = [], at
        while (found := STOP.search(self.source, at)) is not None:
            quote = found.group()
            if quote == ">":
                return found.end()
            spans.append((begun, found.end()))
            at = -1 if quote in self.gone else self.source.find(quote, found.end())
            if at < 0:
                self.gone.add(quote)
                break
            begun = at = at + 1
        else:
            spans.append((begun, len(self.source) + 1))
        self.outside = spans
        return -1


def parse(source: str) -> list[Node]:
    """Nodes of a page, parents before children; inline elements belong to their block."""
    nodes = [Node("#root", -1, 0)]
    stack, links, block, at = [0], 0, 1, 0
    tags, opened, begin = Tags(source), Counter(), 0

    def add(text: str) -> None:
        if text:
            nodes[stack[-1]].texts.append((-block if links else block, html.unescape(text)))

    def close(depth: int) -> None:
        for i in stack[depth:]:
            opened[nodes[i].tag] -= 1
        del stack[depth:]

    length = len(source)
    while at < length:
        # A tag without an end is text: the search goes on behind its ``<``.
        found, ended, named = TOKEN.search(source, begin), -1, -1
        if found is not None and found.group(1) is not None:
            named = tags.name_end(found.end())
            ended = tags.end(named) if named >= 0 else -1
            if ended < 0:
                begin = found.start() + 1
                continue
        if found is None:
            # An unfinished tag at the end of a truncated page is no text.
            rest = source[at:]
            cut = rest.rfind("<")
            add(rest if cut < 0 or not re.match(r"</?[a-zA-Z!]", rest[cut:]) else rest[:cut])
            break
        add(source[at : found.start()])
        begin = at = found.end() if ended < 0 else ended
        if found.group(1) is None:
            if found.group().startswith("<![CDATA["):
                add(found.group()[9:-3])
            continue
        closing, tag, attributes = bool(found.group(1)), source[found.end() : named].lower(), source[named : ended - 1]
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = RAW_ENDS[tag].search(source, at)
                stop = source.find(">", end.end()) if end else -1
                begin = at = stop + 1 if stop >= 0 else length
            continue
        if tag == "br" or tag == "img":
            add(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in INLINE or tag in RAW:
            continue
        if tag in VOID:
            block += 1
            continue
        block += 1
        links = 0
        if closing:
            if opened[tag]:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
            continue
        # A block ends an open paragraph; list items and cells end their like.
        ends = CLOSES.get(tag, set()) | {"p"}
        while len(stack) > 1 and nodes[stack[-1]].tag in ends:
            close(len(stack) - 1)
        if tag in CLOSES and any(opened[name] for name in ends):
            for depth in range(len(stack) - 1, 0, -1):
                name = nodes[stack[depth]].tag
                if name in ends:
                    close(depth)
                    break
                if name in CONTAINERS:
                    break
        nodes.append(Node(tag, stack[-1], mark_of(tag, attributes)))
        if not attributes.endswith("/"):
            opened[tag] += 1
            stack.append(len(nodes) - 1)
    return nodes


def mark_of(tag: str, attributes: str) -> int:
    """What an element's tag, and its class, id or role, say of it: an index of ``NAMES``."""
    if tag in FURNITURE_TAGS:
        return 1
    words: set[str] = set()
    if "=" in attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "id":
                # Headings and sections are named after their own text: an id counts if it says nothing else.
                named = set(WORDS.findall(CAMEL.sub(r"\1 \2", value).lower()))
                if tag not in HEADINGS and (named <= FURNITURE_WORDS or named <= CONTENT_WORDS):
                    words |= named
            elif name in ("class", "role"):
                words.update(WORDS.findall(STATES.sub(" ", CAMEL.sub(r"\1 \2", value).lower())))
            elif name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value == "true":
                return 1
    if UNSEEN.search(attributes):
        return 1
    if words & FURNITURE_WORDS:
        return 3
    return 2 if tag in CONTENT_TAGS else 4 if words & CONTENT_WORDS else 0


STRUCTURE, CONTENT, FURNITURE = range(3)
#: Feature -> number of values.
FEATURES = {"kind": 7, "place": 3, "links": 4, "length": 5, "stops": 3, "name": 3}
KINDS = {t: k for k, ts in enumerate(["p", "h1 h2 h3 h4 h5 h6", "li ul ol dl dd dt", "table tr td th tbody thead caption", "pre blockquote figure figcaption", "article main section"], 1) for t in ts.split()}
#: What pages hold in general, by parent state and state, and by state and kind. Half of the learned
#: distributions, as a crawl's own pages may be alike. Furniture holds nothing else.
COMMON_EDGES = np.array([[0.4, 0.35, 0.25], [1e-9, 0.7, 0.3], [1e-9, 1e-9, 1]])
COMMON_KINDS = np.array([
    [0.50, 0.05, 0.05, 0.05, 0.05, 0.05, 0.25],
    [0.10, 0.40, 0.14, 0.20, 0.05, 0.09, 0.02],
    [0.38, 0.08, 0.07, 0.34, 0.05, 0.02, 0.06],
])
#: By state and words of the name: none, of furniture, of content.
COMMON_NAMES = np.array([[0.80, 0.04, 0.16], [0.94, 0.01, 0.05], [0.50, 0.49, 0.01]])
COMMON = {"kind": COMMON_KINDS, "name": COMMON_NAMES}
#: Log-potential of (state, mark): nothing, furniture by tag, content by tag, and words, which are a feature.
#: A tag outweighs any text. Furniture seldom begins without a name.
NAMES = np.array([[0, -4000, -8, 0, 0], [0, -4000, 0, 0, 0], [-3, 0, -1000, 0, -3]], float)


def inside(nodes: list[Node]) -> list[bool] | None:
    """Whether each node is in the page's article (else its main element); None if it has neither."""
    tag = next((t for t in ("article", "main") if any(n.tag == t and n.mark == 2 for n in nodes)), None)
    if tag is None:
        return None
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        out[i] = n.tag == tag and n.mark == 2 or i > 0 and out[n.parent]
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row of discrete values per node, from its own text and place."""
    out = np.zeros((len(nodes), len(FEATURES)), np.int64)
    within = inside(nodes)
    for i, node in enumerate(nodes):
        plain = linked = stops = 0
        for block, text in node.texts:
            size = len(text) - text.count(" ")
            if block < 0:
                linked += size
            plain += size
            stops += text.count(". ") + text.count(".\n") + text.rstrip().endswith((".", "!", "?"))
        share = linked / plain if plain else 0.0
        out[i] = (
            KINDS.get(node.tag, 0), 0 if within is None else 1 if within[i] else 2,
            0 if not plain else 1 if share < 0.2 else 2 if share < 0.6 else 3,
            0 if not plain else 1 if plain < 20 else 2 if plain < 80 else 3 if plain < 300 else 4, min(stops, 2), max(0, node.mark - 2))
    return out


def own_labels(nodes: list[Node]) -> np.ndarray | None:
    """States from a page's own markup; None for a page without an article or main element.

    A paragraph or heading in the article is content whatever its class says, so what
    such words are worth is counted.
    """
    within = inside(nodes)
    if within is None:
        return None
    state = np.zeros(len(nodes), np.int64)
    for i, n in enumerate(nodes[1:], 1):
        state[i] = FURNITURE if n.mark == 1 or n.mark == 3 and n.tag not in LINES or state[n.parent] == FURNITURE else CONTENT if within[i] else STRUCTURE
    return state


@dataclass
class Model:
    """Log-potentials: ``edge`` of (parent state, state), ``node`` per feature of (state, value). The root is structure."""

    edge: list[list[float]]
    node: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, int], int]) -> "Model":
        """Smoothed conditional frequencies. Features are mixed with a flat distribution, as the pages learned from are alike."""
        edge = np.array([[counts.get(("edge", a, b), 0) for b in range(3)] for a in range(3)]) + COMMON_EDGES
        edge = 0.5 * edge / edge.sum(axis=1, keepdims=True) + 0.5 * COMMON_EDGES
        tables = []
        for name, size in FEATURES.items():
            t = np.array([[counts.get((name, s, v), 0) + 1 for v in range(size)] for s in range(3)], float)
            if name == "place":  # of pages that have an article; elsewhere it says nothing
                t = np.log(t[:, 1:] / t[:, 1:].sum(axis=1, keepdims=True) + 1e-5)
                tables.append(np.concatenate((np.zeros((3, 1)), t), axis=1))
                continue
            t /= t.sum(axis=1, keepdims=True)
            tables.append(np.log(0.5 * t + 0.5 * COMMON[name] if name in COMMON else 0.8 * t + 0.2 / size))
        return cls(np.log(edge).tolist(), tables)

    def marginals(self, nodes: list[Node], values: np.ndarray) -> list[float]:
        """Probability of content of each node, by messages up and down the tree."""
        own = NAMES[:, [n.mark for n in nodes]] + sum(t[:, values[:, k]] for k, t in enumerate(self.node))
        up = own.T.tolist()  # own evidence and that of the subtree
        up[0] = [up[0][0], -1e9, -1e9]
        edge, sent = self.edge, [[0.0] * 3] * len(nodes)
        into = [[edge[a][b] for a in range(3)] for b in range(3)]
        for i in range(len(nodes) - 1, 0, -1):
            mine, parent = up[i], up[nodes[i].parent]
            sent[i] = message = [_sum(row, mine) for row in edge]
            for k in range(3):
                parent[k] += message[k]
        belief = [up[0]] * len(nodes)
        for i in range(1, len(nodes)):
            # What the parent knows without this child, sent down.
            above = [x - y for x, y in zip(belief[nodes[i].parent], sent[i])]
            belief[i] = [x + _sum(row, above) for x, row in zip(up[i], into)]
        return [math.exp(min(0.0, b[CONTENT] - (top := max(b)))) / sum(math.exp(x - top) for x in b) for b in belief]


def _sum(x: list[float], y: list[float]) -> float:
    """log of the sum of exp(x + y) over three states."""
    a, b, c = x[0] + y[0], x[1] + y[1], x[2] + y[2]
    top = max(a, b, c)
    return top + math.log(math.exp(a - top) + math.exp(b - top) + math.exp(c - top))


def text_of_page(source: str, model: Model) -> str:
    """Blocks of the content nodes in page order, joined by an empty line."""
    if not source:
        return ""
    nodes = parse(source)
    pieces: dict[int, list[str]] = {}
    for node, chance in zip(nodes, model.marginals(nodes, features(nodes))):
        if chance > 0.5:
            for block, text in node.texts:
                pieces.setdefault(abs(block), []).append(text)
    blocks = (BLANK.sub(" ", "".join(pieces[b])).strip() for b in sorted(pieces))
    return "\n\n".join(b for b in blocks if b)


def count_states(nodes: list[Node], state: np.ndarray) -> Counter:
    """Sufficient statistics of a labelled page, as it is and with its article made anonymous."""
    out: Counter = Counter()
    parents = np.array([n.parent for n in nodes[1:]], np.int64)
    out.update(("edge", a, b) for a, b in zip(state[parents].tolist(), state[1:].tolist()))
    seen = features(nodes)
    plain = seen.copy()
    names = list(FEATURES)
    plain[:, names.index("place")] = 0
    plain[[n.mark == 2 for n in nodes], names.index("kind")] = 0
    for k, name in enumerate(names):
        out.update((name, s, v) for table in (seen, plain) for s, v in zip(state.tolist(), table[:, k].tolist()))
    return out


def fit(pages: DataFrame, id: str = "page_id", html: str = "html", max_pages: int = 2000) -> Model:
    """Learn from pages whose markup labels them: the ``max_pages`` of smallest id hash among all."""
    chosen = pages.where(F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(id).orderBy(F.xxhash64(id), id).limit(max_pages)
    rows = pages.join(chosen.distinct(), id, "left_semi").select(html)
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                nodes = parse(source or "")
                state = own_labels(nodes)
                if state is not None:
                    total.update(count_states(nodes, state))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), *[pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)], pa.array([total[k] for k in keys], pa.int64())],
            ["name", "a", "b", "n"])

    counts = rows.mapInArrow(run, "name string, a int, b int, n bigint").groupBy("name", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model.from_counts({(r["name"], r["a"], r["b"]): r["n"] for r in counts})


def extract(pages: DataFrame, model: Model, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: id, url, ``text``, ``n_chars`` (its code points)."""
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of_page(s or "", model) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id, url, "text", "n_chars"])

    rows = pages.select(id, url, html)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.mapInArrow(run, f"{columns}, text string, n_chars bigint")
