"""Main text of web pages: each block of text is content or boilerplate by a minimum cut.

``blocks`` reads a page's tags into text blocks (references decoded, white space
folded) with what a classifier can see: words, share of link text, ending, tag,
and votes of the enclosing elements (tag, class, id and role names). The
classifier's costs of the two labels are the capacities to the terminals; blocks
that follow each other, and neighbours in one parent element, are joined by
edges that weaken with their distance in the DOM. ``minimum_cut`` fixes blocks
whose own cost exceeds all their edges (they keep that label in every minimum
cut), passes their edges on as costs, and finds a maximum flow for the rest.

The costs of words, links, endings and tags are learned (naive Bayes) from pages
whose own elements tell: blocks in ``article`` or ``main`` against those in
``nav``, ``footer``, ``aside``, ``form`` and the like. Their counts are Spark sums
over about ``SAMPLE`` pages, drawn by the hash of the page (a documented bound:
the table of counts is small whatever it is), on top of ``PRIOR`` counts, which
decide alone where no page tells.

Pages are independent: no shuffle, a page is all that a task must hold. Defined
results: NULL or empty html, and a page without content, give the empty text;
repeated rows are each returned; unclosed, stray or cut-off tags end a block or
are left out, never an error; scripts, styles, templates, the head, comments and
the parts of forms are never text; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import documents, mapped

SAMPLE = 4000  # pages that the classifier learns from
SMOOTH, NEAR = 1.2, 0.6  # capacity of an edge between blocks, times NEAR for each step of DOM distance beyond siblings
LEARNED = 2.5  # bound of what words, links, ending and tag say together, either way

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())  # their content is no markup
HIDDEN = RAW | frozenset("head template svg math select option datalist button object audio video canvas label legend fieldset map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
                  "search head".split())
ENDS_P = BLOCK - {"body", "html", "head"}
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"}}
SCOPE = {"ul", "ol", "dl", "table", "tr", "tbody", "thead", "tfoot", "menu", "body", "div", "section", "article"}

# What elements and their names say, in nats; above zero for boilerplate.
TAG_VOTES = {"nav": 10.0, "footer": 10.0, "aside": 10.0, "form": 10.0, "menu": 10.0, "dialog": 10.0, "search": 10.0,
             "article": -3.0, "main": -2.0}
SITE_HEADER = 8.0  # header outside article and main; within them it holds the title
BAD_NAMES = frozenset("ad ads adbox adslot adunit adsense adcontainer banner nav header masthead aside widget widgets reply replies respond "
                      "discussion notice notices consent gdpr alert modal overlay signup login signin register follow trending popular "
                      "teaser toolbar search copyright legal disclaimer tags tagcloud skip toc complementary contentinfo outbrain taboola "
                      "paywall feedback rating".split())
BAD_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "menu", "navbar", "navig", "navlink", "newsletter", "pagin",
              "popup", "promo", "recommend", "related", "share", "sharing", "sidebar", "social", "sponsor", "subscri")
GOOD_NAMES = frozenset("article content main post entry story body text articlebody maincontent".split())
ABOUT = frozenset("has with without no is js".split())  # "has-sidebar" names what is elsewhere
BAD_VOTE, GOOD_VOTE = 10.0, -1.5
ENOUGH = 12.0  # votes are held within this bound

_PLAIN = r"[^<>\"']*"
#: a comment; a tag, also cut off or run into the next one; a tag with a stray quote; a declaration
TAGS = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)({_PLAIN}(?:(?:"[^"]*"|'[^']*'){_PLAIN})*)(?:>|(?=<)|\Z)"""
                  r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+", re.I)
HEADING = re.compile(r"h[1-6]\Z")
RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ENDS = frozenset(".!?…:;\"'”»。")

#: label -> feature -> pseudo-counts: what is known before any page is read
PRIOR = {
    "content": {"words": (2, 2, 4, 8, 14, 16, 12, 6), "links": (58, 4, 1, 1), "end": (12, 52), "tag": (40, 8, 4, 8, 4)},
    "boiler": {"words": (22, 16, 12, 8, 4, 1, 0.5, 0.5), "links": (20, 6, 8, 30), "end": (48, 16), "tag": (8, 4, 26, 22, 4)},
}
SIZES = {"words": 8, "links": 4, "end": 2, "tag": 5}
HEAD = 1  # the tag kind of headings


class Block:
    __slots__ = ("text", "words", "links", "end", "tag", "vote", "told", "parent", "step")

    def features(self):
        """Headings are short and end anyhow: their length and ending say nothing."""
        known = (("links", self.links), ("tag", self.tag))
        return known if self.tag == HEAD else (("words", self.words), ("end", self.end), *known)


def _vote(tag: str, attrs: str, inside: bool) -> tuple[float, bool]:
    """(vote, whether the element hides its content)."""
    vote, hide = TAG_VOTES.get(tag, 0.0), False
    if tag == "header" and not inside:
        vote = SITE_HEADER
    if attrs:
        for key, value in ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                hide = True
            elif tag not in ("body", "html") and key in ("class", "id", "role"):
                names = {n for word in value.split() for n in [NAME.findall(word)] if n and n[0] not in ABOUT for n in n}
                bad = {n for n in names if n in BAD_NAMES or n.startswith(BAD_STARTS)}
                if bad - {"header"} or bad and not inside and not names & GOOD_NAMES:
                    vote += BAD_VOTE
                elif names & GOOD_NAMES:
                    vote += GOOD_VOTE
    return vote, hide


class Open:
    """An open element; ``block`` is the nearest block element from here up, ``p`` an open paragraph in scope."""
    __slots__ = ("tag", "number", "vote", "hidden", "inside", "told", "block", "p", "up")

    def __init__(self, tag: str, number: int, up: Open | None, more: float, hide: bool):
        self.tag, self.number, self.up = tag, number, up
        self.vote = max(-ENOUGH, min(ENOUGH, (up.vote if up else 0.0) + more))
        self.hidden = hide or bool(up and up.hidden)
        self.inside = tag in ("article", "main") or bool(up and up.inside)
        self.told = more >= SITE_HEADER or bool(up and up.told)
        self.block = self if up is None or tag in BLOCK else up.block
        self.p = self if tag == "p" else None if up is None or tag in SCOPE else up.p


def _kind(tag: str) -> int:
    if tag in ("p", "blockquote", "pre"):
        return 0
    if HEADING.match(tag):
        return HEAD
    return 2 if tag in ("li", "dd", "dt") else 3 if tag in ("div", "section") else 4


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = [Open("", 0, None, 0.0, False)]
    opened: Counter = Counter()
    number = low = linked = 0
    pieces: list[str] = []

    def flush():
        nonlocal low, linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            b, frame = Block(), stack[-1].block
            b.text, b.words = text, min((text.count(" ") + 1).bit_length() - 1, 7)
            b.links, b.end, b.tag = min(3, 4 * linked // len(text)), int(text[-1] in ENDS), _kind(frame.tag)
            b.vote, b.told = frame.vote, frame.told or frame.inside
            b.parent = frame.up.number if frame.up else 0
            b.step = len(stack) - low  # from here up to what it shares with the block before
            out.append(b)
            low = len(stack)
        pieces.clear()
        linked = 0

    def close(frame: Open):
        nonlocal low
        while True:
            top = stack.pop()
            opened[top.tag] -= 1
            if top is frame:
                break
        low = min(low, len(stack))

    at, end = 0, len(page)
    while at < end:
        m = TAGS.search(page, at)
        start = m.start() if m else end
        top = stack[-1]
        if start > at and not top.hidden:
            pieces.append(page[at:start])
            if opened["a"]:
                linked += start - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        attrs = m[3] or m[6] or ""
        block = tag in BLOCK
        if block and pieces:
            flush()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            if opened[tag] > 0:
                while top.tag != tag:
                    top = top.up
                close(top)
            continue
        if tag in ENDS_P and top.p:
            close(top.p)
        if tag in SELF_ENDING:
            x = stack[-1]
            while x.tag not in SELF_ENDING[tag] and x.tag not in SCOPE and x.up:
                x = x.up
            if x.tag in SELF_ENDING[tag]:
                close(x)
        if tag == "br":
            pieces.append(" ")
        if tag in VOID or attrs.endswith("/") and not block and tag not in RAW:
            continue
        top = stack[-1]
        more, hide = _vote(tag, attrs, top.inside) if attrs or block else (0.0, False)
        number += 1
        stack.append(Open(tag, number, top, more, hide or tag in HIDDEN))
        opened[tag] += 1
        if tag in RAW:  # up to its end tag, whatever looks like markup in between
            stop = RAW_ENDS[tag].search(page, at)
            at = stop.start() if stop else end
    if pieces:
        flush()
    return out


# ------------------------------------------------------------------ classifier

def tally(found: list[Block], counts: Counter) -> None:
    """Count the features of blocks whose elements tell what they are."""
    for b in found:
        if b.told and abs(b.vote) >= -TAG_VOTES["main"]:
            label = "boiler" if b.vote > 0 else "content"
            for f in b.features():
                counts[(label, *f)] += 1


def weights(counts) -> dict[str, list[float]]:
    """Feature -> value -> log odds of boilerplate. Counts enter as shares of as many pseudo-counts again."""
    out = {}
    for f, size in SIZES.items():
        odds = []
        share = {}
        for label in PRIOR:
            seen = [counts.get((label, f, v), 0) for v in range(size)]
            total, prior = sum(seen), PRIOR[label][f]
            scale = sum(prior) / total if total else 0.0
            share[label] = [p + s * scale * min(1.0, total / 100) + 0.5 for p, s in zip(prior, seen)]
        for v in range(size):
            odds.append(math.log(share["boiler"][v] / sum(share["boiler"])) - math.log(share["content"][v] / sum(share["content"])))
        out[f] = odds
    return out


def cost(b: Block, odds: dict[str, list[float]]) -> float:
    """Cost of the label content less that of boilerplate."""
    said = sum(odds[f][v] for f, v in b.features())
    return b.vote + max(-LEARNED, min(LEARNED, said))


# ------------------------------------------------------------------ minimum cut

def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other and between neighbours in one parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH * NEAR ** max(0, b.step - 1)))
        j = last.get(b.parent)
        if j is not None and j != i - 1:
            edges.append((j, i, SMOOTH * NEAR))
        last[b.parent] = i
    return edges


def minimum_cut(costs: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content: minimises the sum of costs of content nodes and of edges between labels.

    Of several minimum cuts, the one with the least content.
    """
    n = len(costs)
    own = list(costs)
    links: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    bound = [0.0] * n
    for a, b, w in edges:
        links[a].append((b, w))
        links[b].append((a, w))
        bound[a] += w
        bound[b] += w
    label: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(own[i]) > bound[i])
    for i in queue:
        label[i] = own[i] < 0
    while queue:  # a fixed node's edges become costs of its neighbours
        i = queue.popleft()
        for j, w in links[i]:
            if label[j] is None:
                own[j] += -w if label[i] else w
                bound[j] -= w
                if abs(own[j]) > max(bound[j], 0.0) + 1e-12:
                    label[j] = own[j] < 0
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _flow(rest, own, links, label)
    return [bool(x) for x in label]


def _flow(rest: list[int], own: list[float], links, label: list) -> None:
    """Label the nodes of ``rest`` by a maximum flow (shortest augmenting paths, in levels)."""
    at = {i: k + 2 for k, i in enumerate(rest)}  # 0: source (content), 1: sink (boilerplate)
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a, b, forth, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in rest:
        if own[i] < 0:
            edge(0, at[i], -own[i], 0.0)
        elif own[i] > 0:
            edge(at[i], 1, own[i], 0.0)
        for j, w in links[i]:
            if j in at and j > i:
                edge(at[i], at[j], w, w)
    while True:
        level = [-1] * len(out)
        level[0], queue = 0, deque([0])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[1] < 0:
            break
        following = [0] * len(out)
        path: list[int] = []
        a = 0
        while True:
            if a == 1:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(out[a]):
                path.append(out[a][following[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break
    for i in rest:
        label[i] = level[at[i]] >= 0


def main_text(page: str, odds: dict[str, list[float]]) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = minimum_cut([cost(b, odds) for b in found], smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


# ------------------------------------------------------------------ on Spark

def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, list[float]]:
    """Log odds of the block features from about ``sample`` pages, drawn by hash."""
    total = pages.count()
    part = pages.select(F.col("html").cast("string").alias("html")).where("html is not null")
    if total > sample:
        part = part.where(F.pmod(F.xxhash64(F.substring("html", 1, 4096), F.length("html")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                tally(blocks(page), counts)
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]),
                                              pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
                                             names=["label", "feature", "value", "n"])

    rows = mapped(part, run, "label string, feature string, value int, n long").groupBy("label", "feature", "value").agg(F.sum("n").alias("n"))
    return weights({(r.label, r.feature, r.value): r.n for r in rows.collect()})  # at most 2 * 19 rows


def extract(pages: DataFrame, carry: Sequence[str] = ("page_id", "url"), sample: int = SAMPLE) -> DataFrame:
    """``carry`` columns, text and n_chars (code points) of each page of ``pages`` (column html)."""
    odds = learn(pages, sample)

    def run(batches):
        for b in batches:
            texts = [main_text(page or "", odds) for page in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(carry))), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())],
                                             names=[*(f"_c{j}" for j in range(len(carry))), "text", "n_chars"])

    rows = pages.select(*(F.col(f"`{c}`").alias(f"_c{j}") for j, c in enumerate(carry)), F.col("html").cast("string").alias("_html"))
    schema = T.StructType(rows.schema.fields[:-1]).add("text", "string").add("n_chars", "long")
    return mapped(rows, run, schema).withColumnsRenamed({f"_c{j}": c for j, c in enumerate(carry)})


def op13_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract(documents(spark, sf, "pages"))


QUERIES = {"op13_html_extraction": op13_html_extraction}
SQL: dict[str, str] = {}
