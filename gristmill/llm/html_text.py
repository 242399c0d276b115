"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree; each is content or not. A node's own
potential comes from its tag, its class words and the shape of its text, and a
parent-child potential from the pair of labels and the child's kind. Exact
marginals come from sum-product message passing, upward from the leaves and
downward from the root; the blocks of nodes that are content with probability
``LIMIT`` or more form the text. The weights are fitted to labelled pages by
gradient steps on the likelihood, whose expectations are the same marginals.

Labelled pages: ``LABELLED`` holds small pages written for this purpose, some
by hand and some by a rule over common kinds of layout, in which ``y=1`` or
``y=0`` on an element labels it and what is inside. Pages of
one's own can be given to ``fit`` in the same form. Pages are independent of
each other: every task works on the pages it reads, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import pieces, utf8

LIMIT, ROUNDS, RATE, SHRINK = 0.5, 150, 0.5, 0.002

#: Elements that begin a block, and those whose raw content is no text.
BLOCKS = set("html body main article section nav aside header footer div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table thead tbody tfoot tr td th caption form fieldset address details summary hr center dialog menu hgroup search select option button svg template noscript object label legend".split())
RAW = set("script style title textarea iframe xmp noembed noframes".split())
VOID = {"hr"}
#: An open element of the second kind ends where one of the first begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|=|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?)*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LETTERS = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    words: list[str]
    label: int | None = None
    blocks: list[list[str]] = field(default_factory=list)
    linked: int = 0


def tree(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order, and the blocks of text as (node, text)."""
    nodes, stack, blocks, run = [Node("", -1, [])], [0], [], []
    places: dict[str, list[int]] = defaultdict(list)  # of each tag, where its open elements stand in the stack
    at, in_link = 0, False

    def flush() -> None:
        if run and (text := " ".join(html.unescape("".join(run)).split())):
            blocks.append((stack[-1], text))
        run.clear()

    def text(piece: str) -> None:
        if piece:
            run.append(piece)
            if in_link:
                nodes[stack[-1]].linked += len(piece)

    def pop() -> None:
        places[nodes[stack.pop()].tag].pop()

    def innermost(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def close(names: set[str], barrier: set[str]) -> None:
        """Ends the innermost open element of these names, unless a barrier is nearer."""
        k = innermost(names)
        if k and k >= innermost(barrier):
            while len(stack) > k:
                pop()

    for m in iter(lambda: TOKEN.search(page, at), None):
        text(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if name in RAW and not m[1]:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
        elif name == "a":
            in_link = not m[1]
        elif name == "br":
            text(" ")
        elif name in BLOCKS:
            flush()
            in_link = False
            if m[1]:
                close({name}, set())
            else:
                if nodes[stack[-1]].tag == "p":
                    pop()
                if name in CLOSES:
                    close(CLOSES[name], SCOPE[name])
                attrs = m[3] or ""
                words = [w for v in NAMED.findall(attrs) for w in LETTERS.findall("".join(v).lower())] if attrs.strip() else []
                given = re.search(r"\by=([01])", attrs)
                above = nodes[stack[-1]].label
                nodes.append(Node(name, stack[-1], words, int(given[1]) if given else above))
                if name not in VOID:
                    places[name].append(len(stack))
                    stack.append(len(nodes) - 1)
    text(page[at:])
    flush()
    return nodes, blocks


def features(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[list[str]]:
    """Names of what holds of each node: tag, class words, and size, links and end marks of its own text."""
    own: dict[int, list[str]] = defaultdict(list)
    for node, text in blocks:
        own[node].append(text)
    out = []
    for k, node in enumerate(nodes):
        found = ["any", f"tag {node.tag}", *{f"word {w}" for w in node.words}]
        if k in own:
            size = sum(map(len, own[k]))
            found.append(f"size {min(4, int(math.log(size + 1, 4)))}")
            found.append(f"link {min(2, round(2 * node.linked / size))}")
            found.append("stop" if own[k][-1][-1] in ".!?:;\"'" else "no stop")
        out.append(found)
    return out


@dataclass
class Model:
    node: dict[str, float] = field(default_factory=dict)
    pair: dict[tuple[str, int, int], float] = field(default_factory=dict)

    def potentials(self, nodes: list[Node], names: list[list[str]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Of each node: odds of content, and the factors of (parent, node) labels 00, 01, 10, 11."""
        get, pair, memo = self.node.get, self.pair.get, {}
        own = [math.exp(max(-20.0, min(20.0, sum(get(n, 0.0) for n in found)))) for found in names]
        edges = []
        for node in nodes:
            if (kind := node.tag) not in memo:
                memo[kind] = tuple(math.exp(pair(("", a, b), 0.0) + pair((kind, a, b), 0.0)) for a in (0, 1) for b in (0, 1))
            edges.append(memo[kind])
        return own, edges


def marginals(nodes: list[Node], own: list[float], edges: list[tuple[float, float, float, float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Exact probabilities: of content for each node, and of the label pairs
    (parent, node). Nodes come in page order, so a parent precedes its children."""
    n = len(nodes)
    up = [(1.0, o) for o in own]
    sent = [(1.0, 1.0)] * n
    for k in range(n - 1, 0, -1):
        (b0, b1), (e00, e01, e10, e11) = up[k], edges[k]
        m0, m1 = b0 * e00 + b1 * e01, b0 * e10 + b1 * e11
        total = m0 + m1
        sent[k] = m0, m1 = m0 / total, m1 / total
        p = nodes[k].parent
        a0, a1 = up[p][0] * m0, up[p][1] * m1
        up[p] = (a0 / (a0 + a1), a1 / (a0 + a1))
    full = [up[0]] * n
    total = sum(up[0])
    full[0] = (up[0][0] / total, up[0][1] / total)
    pairs = [(0.0, 0.0, 0.0, 0.0)] * n
    for k in range(1, n):
        p = nodes[k].parent
        q0, q1 = full[p][0] / sent[k][0], full[p][1] / sent[k][1]
        (b0, b1), (e00, e01, e10, e11) = up[k], edges[k]
        c = q0 * e00 * b0, q0 * e01 * b1, q1 * e10 * b0, q1 * e11 * b1
        total = sum(c)
        pairs[k] = c = tuple(x / total for x in c)
        full[k] = (c[0] + c[2], c[1] + c[3])
    return [x[1] for x in full], pairs


def fit(pages: Iterable[str]) -> Model:
    """Weights that make the labels of these pages likely, by gradient steps with shrinkage."""
    model, data = Model(defaultdict(float), defaultdict(float)), []
    for page in pages:
        nodes, blocks = tree(page)
        data.append((nodes, features(nodes, blocks)))
    for _ in range(ROUNDS):
        node, pair = defaultdict(float), defaultdict(float)
        for nodes, names in data:
            content, pairs = marginals(nodes, *model.potentials(nodes, names))
            gold = [n.label or 0 for n in nodes]
            for k, found in enumerate(names):
                for name in found:
                    node[name] += gold[k] - content[k]
                for j, p in enumerate(pairs[k]) if k else ():
                    hit = float((gold[nodes[k].parent], gold[k]) == divmod(j, 2)) - p
                    pair["", j // 2, j % 2] += hit
                    pair[nodes[k].tag, j // 2, j % 2] += hit
        for weights, step in ((model.node, node), (model.pair, pair)):
            for name, g in step.items():
                weights[name] += RATE * (g / len(data) - SHRINK * weights[name])
    return Model(dict(model.node), dict(model.pair))


def main_text(page: str, model: Model, limit: float = LIMIT) -> str:
    nodes, blocks = tree(page)
    if not blocks:
        return ""
    content, _ = marginals(nodes, *model.potentials(nodes, features(nodes, blocks)))
    return "\n".join(text for k, text in blocks if content[k] >= limit)


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), limit: float = LIMIT) -> DataFrame:
    """``keys`` and ``text``: the main text of every row, empty for null or
    empty pages and pages without content. Truncated and malformed pages are
    read as far as they go; repeated rows stay; other columns are ignored."""
    model = model or fit(LABELLED)
    slim = pages.select(*keys, F.col(html_col).cast("string").alias("__gm_html"))
    schema = slim.drop("__gm_html").withColumn("text", F.lit("")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [main_text((raw or b"").decode("utf-8", "replace"), model, limit) for raw in utf8(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string())], names=[*b.schema.names[:-1], "text"])

    return slim.mapInArrow(run, schema)


_LONG = "The river had risen in the night, and by morning the lower fields were under water, which nobody in the village had seen before. "
_MORE = "It took the council three weeks to agree on repairs; in the meantime, the mill stood still. "
_MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul>"

#: What stands around or holds the main text on pages of many kinds: an element with its class, id or role.
HOLDERS = ["div class=post-body", "div id=main-content", "section class='story text'", "div class='entry content'", "td class=content", "div class='markdown body'", "div role=main", "div class='page content'", "div id=article", "div class=prose", "main class=wrapper", "div class='news text body'", "div id=bodytext", "div class='blog entry'"]
AROUND = [
    "div class='nav menu'", "div class='breadcrumb'", "div class='pagination pager'", "div class='share social'", "div class='related posts'", "div class='recommended more'", "div class='promo banner'", "div class='advert ads'", "div class='sponsor'", "div class='cookie consent'",
    "div class='newsletter signup'", "div class='login form'", "form class='search'", "div id=comments", "div class='comment reply'", "div class='footer copyright legal'", "div class='sidebar widget'", "div class='archive list'", "div class='popup modal'", "div class='toolbar skip'",
    "ul class='tags'", "div role=navigation", "div role=banner", "div role=contentinfo", "div role=complementary", "section class='responses discussion'", "div class='alert notice'", "td class='menu'",
]


def _element(told: str, inside: str, y: int) -> str:
    return f"<{told} y={y}>{inside}</{told.split()[0]}>"


def layouts() -> list[str]:
    """Labelled pages by rule: each holder with four of what stands around it,
    two of them long texts; in every third page they stand inside the holder."""
    out = []
    for k, holder in enumerate(HOLDERS):
        around = [AROUND[(2 * k + 7 * j) % len(AROUND)] for j in range(4)]
        parts = [_element(a, [_MENU, f"<p>{_MORE}</p>", "<p>Sign in now</p>", f"<h3>More</h3><p>{_LONG}</p>"][j], 0) for j, a in enumerate(around)]
        text = f"<h1>The mill</h1><p>{_LONG}</p>" + [f"<p>{_MORE}</p><p>Yes.</p>", f"<ul><li>{_MORE}</li><li>New pumps</li></ul>", f"<div><p>{_LONG * 3}</p></div><h2>Costs</h2><p>{_MORE}</p>", f"<p>{_MORE}</p><pre>x = 1</pre><blockquote>{_LONG}</blockquote>"][k % 4]
        inner = _element(holder, text + parts[1] if k % 3 == 0 else text, 1)
        rest = [parts[0], inner, *([] if k % 3 == 0 else [parts[1]]), *parts[2:]]
        body = f"<table><tr>{''.join(x if x.startswith('<td') else f'<td>{x}</td>' for x in rest)}</tr></table>" if holder.startswith("td") else f"<div class=wrapper>{''.join(rest)}</div>"
        out.append(f"<html><body>{body}</body></html>")
    return out


#: Pages written to train on. y=1 is content, y=0 is not; what is inside an element takes its label.
LABELLED = [
    f"<html><body><nav>{_MENU}</nav><div class=ad>Buy two, get one free today.</div><article y=1><h1>The flood</h1><p>{_LONG}</p><p>{_MORE}</p><p>So it was.</p></article><footer>&copy; Example &middot; All rights reserved.</footer></body></html>",
    f"<html><body><header><h1>Daily Example</h1>{_MENU}</header><main y=1><h1>Repairs</h1><p>{_MORE}</p><h2>Costs</h2><p>{_LONG}</p><ul><li>Bricks for the wall.</li><li>Two new pumps, as agreed.</li></ul></main><aside><h3>Popular</h3>{_MENU}</aside><footer><p>Imprint</p></footer></body></html>",
    f"<html><body><div id=header><p>Example Times</p></div><div class='menu nav'>{_MENU}</div><div id=content y=1><div class=post><h2>Mill</h2><p>{_LONG}{_MORE}</p><blockquote><p>{_MORE}</p></blockquote></div></div><div class=sidebar><h3>Archive</h3>{_MENU}<p>Follow us everywhere.</p></div><div id=footer><p>Contact us. Terms and privacy.</p></div></body></html>",
    f"<html><body><nav class=navbar>{_MENU}</nav><article y=1><h1>Water</h1><p>{_LONG}</p><table><tr><th>Year</th><td>Level</td></tr><tr><td>1998</td><td>3.4</td></tr></table><figure><figcaption>The mill in spring.</figcaption></figure><pre>let level = 3</pre><p>{_MORE}</p></article><section class=comments y=0><h3>Comments</h3><div class=comment><p>{_MORE}</p></div><div class=comment><p>I was there and saw it, too.</p></div><form><label>Name</label><button>Send</button></form></section><footer><p>Example</p></footer></body></html>",
    f"<html><body><div class='cookie notice banner'><p>We use cookies to make this site better.</p><button>Accept</button></div><header>{_MENU}</header><article y=1><h1>Wall</h1><p>{_MORE}</p><div class=ad y=0><p>Advertisement: cheap pumps here!</p></div><p>{_LONG}</p><aside class='related' y=0><h4>Read more</h4>{_MENU}</aside><p>{_MORE}</p><div class='share social' y=0><ul><li><a href=#>Share</a></li></ul></div></article><div id=comments><ol><li><p>{_LONG}</p></li></ol></div><footer><div class=links>{_MENU}</div></footer></body></html>",
    f"<html><body><div id=wrapper><div class=breadcrumb><a href=/>Home</a> / <a href=/x>Village</a></div><div class='article body' y=1><h1>Spring</h1><p>{_LONG}</p><p>{_MORE}</p><ol><li>{_MORE}</li><li>{_LONG}</li></ol></div><div class='advert sponsored'><p>{_MORE}</p></div><form class='newsletter subscribe'><p>Get our letter every week.</p><select><option>Weekly</option></select><button>Subscribe</button></form><div class='footer copyright'>&copy; 2020 Example</div></div></body></html>",
    f"<html><body><nav>{_MENU}</nav><div class=ad>One sentence only, about shoes. {_MORE}</div><article y=1><h1>Long</h1><p>{_LONG * 4}</p><p>{_LONG}</p><p>Yes.</p><p>and so on</p></article><footer>&copy; example.com &middot; {_MORE}</footer></body></html>",
    f"<html><body><section class=content y=1><h2>Notes</h2><p>{_LONG}</p><dl><dt>Pump</dt><dd>{_MORE}</dd></dl></section><section class='discussion responses'><p>{_LONG}</p><p>{_MORE}</p></section><div class=popup><p>{_MORE}</p></div><dialog><p>{_MORE}</p></dialog><menu><li><a href=/>Start</a></li></menu><noscript>Please turn on scripts.</noscript></body></html>",
    f"<html><body><nav>{_MENU}</nav><div class=ad>{_MORE}</div><article y=1><h1>Note</h1><p>Short note</p></article><footer>&copy; example.net &middot; Home</footer></body></html>",
    f"<html><body><header>{_MENU}</header><article y=1><h1>The mill and the wall</h1><p>mill mill mill mill</p><p>wall | wall | mill</p></article><aside><p>{_MORE}</p></aside><footer><p>{_MORE}</p></footer></body></html>",
    f"<html><body><nav>{_MENU}</nav><main y=1><p>{_MORE}</p></main><div class=ad><p>Shoes</p></div><footer>Example</footer></body></html>",
    *layouts(),
]
