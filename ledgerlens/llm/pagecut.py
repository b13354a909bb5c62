"""Main text of web pages by minimum cut.

A page is read into text blocks with their open elements. A classifier turns each block's features into a log-odds score for
article text: its positive part is the capacity of an edge from the source, its negative part that of an edge to the sink.
Neighbouring blocks, more so the deeper the element they share, are tied by smoothness edges. The minimum cut, found by
maximum flow, separates content from boilerplate at least total cost. Blocks whose own score outweighs all their ties are
settled first, which leaves the cut the same and the flow small.

The pages have no labels to learn from, so the classifier's weights are fixed, stated in WEIGHTS. Two rules keep a class name
from deciding about a page's main part: a name that tells of a state (`has-ads`, `content-with-sidebar`, `no-comments`) says
nothing bad, and the class names around a page's only `main` or `article` element say nothing bad about what is in it.

Defined cases: a null or empty page has empty text; markup may be unclosed or broken; head, script, style and comments never
count; character references are decoded; white space inside a block, line breaks included, becomes one space; blocks come in
page order, joined by one newline; repeated rows are extracted each; an empty table gives an empty result. Whole pages are
read; only the html column enters the text.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Anything up to the end of a tag; a quote opens a value only after an equals sign.
ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|svg|textarea)\b" + ATTRS + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>" + ATTRS + r")>"
    r"|<[/!?a-z][^>]*(?:>|\Z)",
    re.S | re.I)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")

# fixed values: element names of HTML by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead title tr ul""".split())
CLOSES_P = BREAKS - {"button", "caption", "legend", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}
#: Elements that a self-closing search does not look beyond.
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Log-odds of article text by feature; `tag:` and `role:` of any open element, `word:` of its class or id.
WEIGHTS = {
    "bias": -1.0, "per 100 characters, up to 3": 0.8, "link share": -4.0, "sentence end": 0.7, "paragraph": 1.5, "heading": 0.5, "item": -0.5,
    "tag:article": 3.0, "tag:main": 2.5, "tag:nav": -9.0, "tag:footer": -9.0, "tag:aside": -9.0, "tag:header": -7.0, "tag:form": -9.0,
    "tag:button": -9.0, "tag:select": -9.0, "tag:menu": -9.0, "tag:dialog": -9.0, "tag:label": -4.0, "tag:search": -9.0,
    "role:navigation": -9.0, "role:banner": -9.0, "role:contentinfo": -9.0, "role:complementary": -9.0, "role:search": -9.0,
    "role:alert": -9.0, "role:dialog": -9.0, "role:alertdialog": -9.0, "role:menu": -9.0, "role:form": -9.0, "role:main": 2.5, "role:article": 3.0,
    "hidden": -9.0,
    "word:article": 1.5, "word:content": 1.0, "word:story": 1.5, "word:post": 1.0, "word:entry": 1.5, "word:main": 1.0, "word:body": 1.0, "word:text": 0.5,
    **{f"word:{w}": -9.0 for w in """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion cookie
        cookies consent gdpr notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup login sidebar side
        widget related recommended recommendations menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social comment
        comments reply replies respond discussion disqus footer foot masthead topbar toolbar form search copyright legal disclaimer tags""".split()},
    "word:header": -7.0,
}
#: Parts of a class name that make it tell of a state of the page or of what is beside the element.
STATES = frozenset("with without has no not enabled disabled factor".split())
ADJACENT, SHARED = 0.4, 1.6
MAIN = frozenset(("main", "article"))


def element(name: str, attrs: str) -> tuple[float, float, float]:
    """Weights that an element gives to all blocks inside it: good, bad by what it is, bad by its class names."""
    if name in ("html", "body"):
        return 0.0, 0.0, 0.0
    score = WEIGHTS.get(f"tag:{name}", 0.0)
    good, bad, named = max(score, 0.0), min(score, 0.0), 0.0
    for m in ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for token in value.split():
                parts = NAME_PART.findall(token)
                found = [WEIGHTS.get(f"word:{w}", 0.0) for w in parts]
                good = max(good, *found, 0.0)
                if STATES.isdisjoint(parts):
                    named = min(named, *found, 0.0)
            continue
        if key == "role":
            found = WEIGHTS.get(f"role:{value.strip()}", 0.0)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found = WEIGHTS["hidden"]
        else:
            continue
        good, bad = max(good, found, 0.0), min(bad, found, 0.0)
    return good, bad, named


class Elements:
    """All elements of a page in order: parent, name and weights."""

    def __init__(self):
        self.parent, self.names, self.weights = [-1], [""], [(0.0, 0.0, 0.0)]

    def add(self, parent: int, name: str, attrs: str) -> int:
        self.parent.append(parent)
        self.names.append(name)
        self.weights.append(element(name, attrs))
        return len(self.names) - 1

    def scores(self) -> list[float]:
        """What the open elements of each element say together: the best good and the worst bad, parents first."""
        around = self._around_main()
        good, bad = [0.0] * len(self.names), [0.0] * len(self.names)
        for k in range(1, len(self.names)):
            g, by_kind, named = self.weights[k]
            worst = min(by_kind, 0.0 if k in around else named)
            own = worst if worst < -3 else g + worst
            up = self.parent[k]
            good[k], bad[k] = max(good[up], own), min(bad[up], own)
        return [g + b for g, b in zip(good, bad)]

    def _around_main(self) -> set[int]:
        """Elements around the only main element, or else the only article, that is not marked bad itself."""
        for name in ("main", "article"):
            found = [k for k, n in enumerate(self.names) if n == name and min(self.weights[k][1:]) > -3]
            if len(found) == 1:
                out, k = set(), self.parent[found[0]]
                while k > 0:
                    out.add(k)
                    k = self.parent[k]
                return out
            if found and name == "main":
                break
        return set()


class Block:
    __slots__ = ("text", "inside", "depth", "shared", "score")

    def __init__(self, text: str, inside: int, depth: int, shared: int, score: float):
        self.text, self.inside, self.depth, self.shared, self.score = text, inside, depth, shared, score


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def blocks(page: str) -> tuple[list[Block], Elements]:
    """Text blocks in page order with their innermost element, their depth, how many open elements they share with the block
    before, and their scores."""
    out: list[Block] = []
    tree, stack = Elements(), []  # open elements as (name, number)
    open_names: dict[str, int] = {}
    pieces, linked, at, low = [], 0, 0, 0

    def close():
        nonlocal pieces, linked, low
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text and not open_names.get("head") and not open_names.get("title"):
            score = WEIGHTS["bias"] + WEIGHTS["per 100 characters, up to 3"] * min(len(text) / 100, 3)
            score += WEIGHTS["link share"] * min(1.0, linked / len(text))
            score += WEIGHTS["sentence end"] * (text[-1] in ".!?…。\"'”»")
            score += WEIGHTS["paragraph"] * bool(open_names.get("p")) + WEIGHTS["item"] * bool(open_names.get("li"))
            score += WEIGHTS["heading"] * any(open_names.get(h) for h in HEADINGS)
            out.append(Block(text, stack[-1][1] if stack else 0, len(stack), min(low, len(stack)), score))
            low = len(stack)
        pieces, linked = [], 0

    def take(raw):
        nonlocal linked
        text = htmllib.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if open_names.get("a"):
            linked += len(text.strip())

    def shut(k):
        """Close all elements from place k of the stack on."""
        nonlocal low
        for name, _ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]
        low = min(low, k)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in BREAKS:
            close()
        elif name == "br":
            pieces.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1) if open_names.get(name) else ():
                if stack[k][0] == name:
                    shut(k)
                    break
                if name not in BREAKS and stack[k][0] in BREAKS:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and open_names.get("p"):
            k = len(stack) - 1
            while stack[k][0] not in ("p", "table", "button", "object"):
                k -= 1
            if stack[k][0] == "p":
                shut(k)
        for k in range(len(stack) - 1, -1, -1) if any(open_names.get(x) for x in SELF_CLOSING.get(name, ())) else ():
            if stack[k][0] in SCOPES[name]:
                break
            if stack[k][0] in SELF_CLOSING[name]:
                shut(k)
                break
        if name == "body" and open_names.get("head"):
            shut(next(k for k, x in enumerate(stack) if x[0] == "head"))
        stack.append((name, tree.add(stack[-1][1] if stack else 0, name, m["attrs"])))
        open_names[name] = open_names.get(name, 0) + 1
    if at < len(page):
        take(page[at:])
    close()
    around = tree.scores()
    for b in out:
        b.score += around[b.inside]
    return out, tree


def ties(found: list[Block], tree: Elements) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, and with the next one under the same parent."""
    out, last = [], {}
    for k, block in enumerate(found):
        parent = tree.parent[block.inside]
        if k:
            out.append((k - 1, k, ADJACENT + SHARED * block.shared / max(found[k - 1].depth, block.depth, 1)))
            if parent in last and last[parent] != k - 1:
                out.append((last[parent], k, SHARED / 2))
        last[parent] = k
    return out


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks stay on the source's side of the minimum cut; of equal cuts the one with fewer such blocks."""
    n, score = len(scores), list(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        x = todo.popleft()
        if side[x] is None and abs(score[x]) > sum(near[x].values()):
            side[x] = score[x] > 0
            for y, w in near[x].items():
                score[y] += w if side[x] else -w
                del near[y][x]
                todo.append(y)
            near[x] = {}
    if None in side:
        rest = [x for x in range(n) if side[x] is None]
        reached = _source_side(rest, score, near)
        for x in rest:
            side[x] = x in reached
    return side


def _source_side(nodes: list[int], score: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes the source still reaches when no flow can be added (blocking flows over shortest paths)."""
    room: dict[int, dict[int, float]] = {x: dict(near[x]) for x in nodes}
    source, sink = -1, -2
    room[source], room[sink] = {}, {}
    for x in nodes:
        if score[x] > 0:
            room[source][x], room[x][source] = score[x], 0.0
        elif score[x] < 0:
            room[x][sink], room[sink][x] = -score[x], 0.0
    least = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            x = queue.popleft()
            for y, w in room[x].items():
                if w > least and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return set(level) - {source}
        edges, at, path = {x: list(room[x]) for x in level}, dict.fromkeys(level, 0), [source]
        while path:
            x = path[-1]
            if x == sink:
                steps = list(zip(path, path[1:]))
                flow = min(room[a][b] for a, b in steps)
                for a, b in steps:
                    room[a][b] -= flow
                    room[b][a] += flow
                del path[next(k for k, (a, b) in enumerate(steps) if room[a][b] <= least) + 1 :]
                continue
            while at[x] < len(edges[x]):
                y = edges[x][at[x]]
                if room[x][y] > least and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
                at[x] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def main_text(page: str | None) -> str:
    found, tree = blocks(page or "")
    keep = cut([b.score for b in found], ties(found, tree))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep` and the main text of every row."""
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text, na_action=None)

    return pages.select(*keep, run(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias(text_col))
