"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Every block element and every run of text is a node that is content or not. Node potentials come from the names of
elements and from the length, link share and ending of text; parent-child potentials tie a node to its parent. Both are
estimated from labelled pages. Sum-product messages go from the leaves to the root and back; text runs with a content marginal over one
half make up the result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text never shows or never is prose, blocks, and void elements of HTML.
HIDDEN = frozenset("head script style noscript template svg math textarea select option datalist iframe object canvas button".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()) | HIDDEN
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, if open and not beyond the named limits.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Names of what the task calls menus, headers, footers, sidebars, notices, adverts, forms, comments; and of the article.
NAMED = frozenset(f"tag={t}" for t in "nav footer aside form header menu dialog fieldset".split())
NAMED |= {f"word={w}" for w in "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer form header masthead menu modal nav navbar navigation newsletter notice overlay pagination popup promo promoted related recommended reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()}
LANDMARKS = frozenset(("article", "main"))
#: What is thought of a feature before any page is seen, as numbers of content and other nodes seen with it. A name is
#: strong evidence, worth FAITH nodes: counts given to TreeModel can overrule it, those of `train` don't, as labels_of
#: gives named parts inside an article no label. Other features are neutral.
FAITH, CAUTION = 100.0, 4.0
GROUPS = ("text", "block", "named", "landmark")
LABELLED = 500  # training pages at most
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")
WORD = re.compile(r"[a-z]+")
STOPS = frozenset(".!?:;\"'")


class Page:
    """parent, features, group (of GROUPS) per node, parents first; text per node (None for elements)."""

    __slots__ = ("parent", "features", "text", "tag", "group")

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.features: list[list[str]] = []
        self.text: list[str | None] = []
        self.tag: list[str] = []
        self.group: list[int] = []

    def add(self, parent: int, tag: str, features: list[str], text: str | None = None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.features.append(features)
        self.text.append(text)
        self.group.append(0 if text is not None else 3 if tag in LANDMARKS else 2 if not NAMED.isdisjoint(features) else 1)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    page = Page()
    root = page.add(-1, "#root", ["tag=#root"])
    stack: list[tuple[str, int, bool]] = [("#root", root, False)]  # tag, node, hidden
    run: list[str] = []
    link = [0, 0, 0]  # letters in the run, of them in links, open links

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip(" \t\n\r\f\v")
        if text:
            words = text.count(" ") + 1
            size = "1" if words <= 3 else "2" if words <= 8 else "3" if words <= 20 else "4" if words <= 60 else "5"
            share = link[1] / max(1, link[0])
            parent = stack[-1][1]
            links = "none" if not link[1] else "some" if share < 0.5 else "most"
            page.add(parent, "#text", [f"run={size},{links},{text[-1] in STOPS}"], text)
        run.clear()
        link[0] = link[1] = 0

    def pop(to: int) -> None:
        if any(t in BLOCKS for t, _, _ in stack[to:]):
            flush()
        link[2] = max(0, link[2] - sum(t == "a" for t, _, _ in stack[to:]))
        del stack[to:]

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text and not stack[-1][2]:
            text = html.unescape(text)
            run.append(text)
            link[0] += len(text)
            link[1] += len(text) * (link[2] > 0)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, block = m.group(2).lower(), m.group(2).lower() in BLOCKS
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if not block and stack[k][0] in BLOCKS:
                    break  # an inline end tag reaches no further than its block
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in VOID:
            if block:
                flush()
            continue
        if block:  # a block ends an open paragraph; list items, cells and rows end their like
            if tag not in HIDDEN:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            if tag in CLOSES:
                ends, limits = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] in limits:
                        break
            flush()
        hidden = stack[-1][2] or tag in HIDDEN
        node = stack[-1][1]
        attributes = m.group(3)
        named = [w for a in ATTRIBUTE.finditer(attributes) for w in WORD.findall((a[2] or a[3] or a[4] or "").lower())] if attributes else []
        if (block or named and f"word={named[0]}" in NAMED) and not hidden:
            if not block:
                flush()
            own = [f"word={w}" for w in sorted(set(named))]
            node = page.add(node, tag, [f"tag={tag}", *own] if f"tag={tag}" in NAMED or tag in LANDMARKS else own)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*(?:>|$)", re.I).search(source, at)
            if not hidden:
                run.append(html.unescape(source[at : end.start() if end else n]))
            at = end.end() if end else n
            continue
        if attributes.endswith("/") and not block:
            continue
        if tag == "a":
            link[2] += 1
        stack.append((tag, node, hidden))
    flush()
    return page


def labels_of(page: Page) -> list[int | None] | None:
    """States of a page whose author marked the article (one article or main element); None for other pages, which
    label nothing. That element and what is in it is content, the rest is not. Parts of the article that have a name of
    their own (a menu, reader comments) are not settled by the mark: they have no label."""
    named = [k for k, t in enumerate(page.tag) if t == "article"] or [k for k, t in enumerate(page.tag) if t == "main"]
    if len(named) != 1:
        return None
    state: list[int | None] = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        if k == named[0]:
            state[k] = 1
        elif state[page.parent[k]] != 0:
            state[k] = state[page.parent[k]] if page.group[k] != 2 else None
    return state


class TreeModel:
    """Node and parent-child potentials, as logarithms: odds[feature], and pairs[landmark on the page][group of the
    child][state of the parent][state of the child]. Counts make them, from a few nodes that are thought of before; that
    prose outside an article which the page itself marks is content, is hardly thought of."""

    def __init__(self, counts: dict[tuple[str, int], int], pairs: dict[tuple[int, int, int, int], int]):
        total = [counts.get(("node", s), 0) + 1.0 for s in (0, 1)]
        share = [t / sum(total) for t in total]
        level = math.log(share[1] / share[0])
        self.odds = {}
        for f in {f for f, _ in counts if f != "node"} | NAMED | {f"tag={t}" for t in LANDMARKS}:
            before = [FAITH, 1e-6] if f in NAMED else [1e-6, FAITH] if f[4:] in LANDMARKS else [CAUTION * share[0], CAUTION * share[1]]
            self.odds[f] = math.log((counts.get((f, 1), 0) + before[1]) / (counts.get((f, 0), 0) + before[0])) - level * (f not in NAMED and f[4:] not in LANDMARKS)
        self.pairs = []
        for seen in (0, 1):
            tables = []
            for g in range(4):
                before = [[8.0, 1e-9 if seen else 0.05], [0.05, 8.0]] if g < 2 else [[4.0, 0.05], [4.0, 4.0]] if g == 2 else [[1.0, 1.0], [1.0, 4.0]]
                rows = [[pairs.get((seen, g, p, c), 0) + before[p][c] for c in (0, 1)] for p in (0, 1)]
                tables.append([[math.log(x / sum(row)) for x in row] for row in rows])
            self.pairs.append(tables)

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node: one pass of messages up the tree, one down."""
        n, odds = len(page.parent), self.odds
        tables = self.pairs[3 in page.group]
        edge = [tables[g] for g in page.group]
        own = [sum([odds.get(f, 0.0) for f in fs]) for fs in page.features]
        up = [[0.0, 0.0] for _ in range(n)]  # what a node's children say of it
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for k in range(n - 1, 0, -1):
            a, b = up[k][0], up[k][1] + own[k]
            message, pair = [], edge[k]
            for p in (0, 1):
                x, y = a + pair[p][0], b + pair[p][1]
                top = x if x > y else y
                message.append(top + math.log1p(math.exp(-abs(x - y))))
            sent[k] = (message[0], message[1])
            above = up[page.parent[k]]
            above[0] += message[0]
            above[1] += message[1]
        belief = [(0.0, 0.0)] * n
        out = [0.0] * n
        for k in range(n):
            if k == 0:
                a, b = up[0][0], up[0][1] + own[0]
            else:
                p = page.parent[k]
                x, y = belief[p][0] - sent[k][0], belief[p][1] - sent[k][1]
                down, pair = [], edge[k]
                for s in (0, 1):
                    u, v = x + pair[0][s], y + pair[1][s]
                    top = u if u > v else v
                    down.append(top + math.log1p(math.exp(-abs(u - v))))
                a, b = up[k][0] + down[0], up[k][1] + own[k] + down[1]
            top = a if a > b else b
            belief[k] = (a - top, b - top)
            d = b - a
            out[k] = 1 / (1 + math.exp(-d)) if d > -700 else 0.0
        return out

    def extract(self, source: str) -> str:
        page = parse(source)
        p = self.marginals(page)
        return "\n\n".join(t for t, x in zip(page.text, p) if t is not None and x > 0.5)


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", labelled: int = LABELLED) -> TreeModel:
    """Potentials from at most `labelled` pages (the least by a hash of the id); ids alone are sorted, and what
    reaches the driver is one row per distinct feature and state of the sample. Equal pages count once.

    Each page's edges count twice: with its article named, and as if it were a block like others, for pages that name none.
    """
    given = pages.where(F.col(source).isNotNull()).select(F.col(page_id).cast("string").alias("i"), F.col(source).alias("x"))
    ids = given.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(labelled)
    chosen = given.join(F.broadcast(ids), "i").select("x").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                page = parse(x.as_py())
                state = labels_of(page)
                for k, s in enumerate(state or ()):
                    if s is None:
                        continue
                    total["node", s] += 1
                    for f in page.features[k]:
                        total[f, s] += 1
                    if k:
                        p, g = state[page.parent[k]], page.group[k]
                        total[f"pair=1{g}{p}", s] += 1
                        total[f"pair=0{1 if g == 3 else g}{p}", s] += 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([s for _, s in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["f", "s", "n"])

    rows = chosen.mapInArrow(count, "f string, s int, n long").groupBy("f", "s").agg(F.sum("n").alias("n")).collect()
    counts = {(r["f"], r["s"]): r["n"] for r in rows if not r["f"].startswith("pair=")}
    return TreeModel(counts, {(*map(int, r["f"][5:]), r["s"]): r["n"] for r in rows if r["f"].startswith("pair=")})


def extract_pages(pages: DataFrame, model: TreeModel, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: page_id, url, text (blocks joined by blank lines, empty if none), n_chars (code points).

    Defined cases: null and empty html give empty text; broken markup is closed as browsers do; repeated rows each
    give a row; an empty table gives an empty result; other columns are ignored. A page's tree is held one at a
    time; the model travels with the task and has one weight per feature of the bounded sample.
    """
    given = pages.select(F.col(page_id).alias("i"), F.col(url).cast("string").alias("u"), F.col(source).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return given.mapInArrow(run, f"page_id {given.schema['i'].dataType.simpleString()}, url string, text string, n_chars long")
