"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

A page is parsed into block nodes (inline markup belongs to the block around
it) with their text runs in page order. Every node with text gets features:
its tag, tokens of its class, id and role attributes and of its ancestors',
depth, the density of text, links and tags in its subtree, its place and its
share among its siblings and on the page. Gradient-boosted trees give the
log odds that the node is main matter.

Tokens (attribute words and tags) are hashed to ``TOKENS`` buckets. A bucket's
weight is its log odds of main matter over the pages learned from; a page
that the trees learn from sees the weights without its own counts, so a word
of one page alone says nothing.

Decoding is one dynamic program over the tree: a node is outside, inside or
dropped; an inside node's children are inside or dropped, a dropped node's
are all dropped, and only an outside node may hold main matter further down.
The labels with the highest sum of log odds by text win, so no kept block
lies in a dropped one.

The trees learn from a bounded sample of pages (``SAMPLE``). Pages that mark
their article give the blocks; each is seen as it is, and set anew into
layouts with other tags and class words (``LAYOUTS``, ``MAIN_WORDS``,
``OTHER_WORDS``), menus, notices, adverts, forms and comments, so that the
marks alone don't decide.

Defined results: null and empty html give an empty text; a page without main
matter too; a page of any length is read whole; unclosed and stray tags are
read as browsers do for blocks; of equally good labelings a node is kept
rather than left out; repeated rows are kept; an empty table gives no rows; without any page to
learn from, marked articles are taken; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Mapping
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, slices, texts

#: Most pages that the trees learn from.
SAMPLE = 250
#: Buckets of attribute words and tags; pseudo-blocks of either kind that a bucket's weight starts from.
TOKENS, PRIOR = 1 << 12, 1.0
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter "
                   "progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select "
                   "textarea button datalist map".split())
#: What may stand in a head, where it is silent by itself and where it has no text; anything else ends the head.
IN_HEAD, BARE_IN_HEAD = frozenset("title script style noscript template".split()), frozenset("meta link base head html".split())
#: Silent elements that an end tag of an element around them ends too (an iframe's or object's text has no such end).
ENDED_BY_PARENT = frozenset("select button datalist canvas audio video map".split())
#: Blocks that an open paragraph ends at.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the second kind ends where one of the first begins, within the third.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
          "th": (("td", "th"), ("tr", "table"))}
TAGS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu"),
        ("article", "main"), ("nav", "aside", "footer", "header"), ("form", "fieldset", "input", "legend"),
        ("section",), ("table", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"),
        ("body", "html"))
#: Attribute words of the layouts that pages are set into; a marked article leaves out what bears more of the second.
MAIN_WORDS = frozenset("article main content body text story post entry prose page copy read maincontent articlebody".split())
OTHER_WORDS = frozenset("nav menu sidebar side aside footer foot header head masthead comment comments reply replies disqus "
                "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice "
                "alert modal popup overlay share sharing social related recommended more links widget form login "
                "signup signin subscribe newsletter search breadcrumb breadcrumbs pager pagination toolbar tags meta "
                "hidden legal copyright contact feedback discussion respond responses navigation complementary "
                "contentinfo dialog rail skip teaser".split())
WORD = regex.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SPACE = regex.compile(r"\s+")
N_FEATURES = len(TAGS) + 26


@lru_cache(maxsize=1 << 16)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % TOKENS


class Page(HTMLParser):
    """Blocks of a page: tags, parents, attribute words, and text runs in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.words, self.marks = ["#"], [-1], [()], [0]
        self.runs: list[tuple[int, str, int]] = []  # block, text, characters in links
        self.open = [0]
        self.silent: list[str] = []
        self.within: list[str] = []  # elements opened in a silent one
        self.links, self.pending, self.linked = 0, [], 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if self.pending:
            body = SPACE.sub(" ", "".join(self.pending)).strip()
            if body:
                self.runs.append((self.open[-1], body, min(self.linked, len(body))))
            self.pending, self.linked = [], 0

    def shut(self, tags, until=()):
        """End the innermost open element of ``tags``, unless one of ``until`` is in between."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in tags:
                self.flush()
                del self.open[i:]
                self.links = 0
                return
            if tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if self.silent == ["head"]:
            if tag in IN_HEAD:
                self.silent.append(tag)
                return
            if tag in BARE_IN_HEAD:
                return
            self.silent.clear()
        if self.silent and tag not in VOID and tag != self.silent[0]:
            self.within.append(tag)
        elif not self.silent:
            self.within.clear()
        if tag in SILENT:
            if not self.silent or tag == self.silent[0]:
                self.silent.append(tag)
                if tag not in ("svg", "math"):
                    self.pending.append(" ")
            return
        if self.silent:
            if self.silent[0] in ("head", "title") and tag == "body":
                self.silent.clear()
            else:
                return
        if tag in INLINE:
            if tag == "a":
                self.links = 1
            elif tag == "br":
                self.pending.append(" ")
            self.marks[self.open[-1]] += 1
            return
        if tag in ENDS_P:
            self.shut(("p",), ("table", "td", "th", "button", "body"))
        if tag in CLOSES:
            self.shut(*CLOSES[tag])
        self.flush()
        if tag in VOID:
            self.marks[self.open[-1]] += 1
            return
        words = [w.lower() for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label")
                 for w in WORD.findall(v)]
        hidden = any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "")) for k, v in attrs)
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(self.open[-2])
        self.words.append((*words, "display:none") if hidden else words)
        self.marks.append(0)

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
                return
            if tag in self.within:
                while self.within.pop() != tag:
                    pass
                return
            if self.silent[0] not in ENDED_BY_PARENT or tag == "p" or all(self.tag[i] != tag for i in self.open):
                return
            self.silent.clear()
        if tag == "a":
            self.links = 0
        elif tag == "p" and not any(self.tag[i] == "p" for i in self.open):
            self.flush()
        elif tag not in INLINE:
            self.shut((tag,))

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self.silent.clear()
        if not self.silent:
            self.pending.append(data)
            if self.links:
                self.linked += len(data)


def tokens(page: Page) -> list[list[int]]:
    """Buckets of each block's attribute words and its tag (``<tag``)."""
    return [[bucket("<" + tag), *map(bucket, words)] for tag, words in zip(page.tag, page.words)]


def token_counts(page: Page, main: np.ndarray) -> tuple[Counter, Counter]:
    """Blocks with text that lie in or under each bucket: main matter, and others."""
    own, parts = tokens(page), (Counter(), Counter())
    for block in {b for b, _, _ in page.runs}:
        at, seen = block, set()
        while at > 0:
            seen.update(own[at])
            at = page.parent[at]
        parts[0 if main[block] else 1].update(seen)
        parts[0 if main[block] else 1][-1] += 1  # all blocks
    return parts


def token_weights(main: Counter, other: Counter) -> dict[int, float]:
    """Log odds of main matter of each bucket against those of all blocks; a bucket that wasn't met has none."""
    share = (main[-1] + 1) / (main[-1] + other[-1] + 2)
    yes, no = PRIOR * share, PRIOR * (1 - share)
    return {t: float(np.log((main[t] + yes) / (other[t] + no) * no / yes)) for t in main.keys() | other.keys() if t >= 0}


def features(page: Page, weights: Mapping[int, float]) -> np.ndarray:
    """One row per block of the page, under the tokens' weights."""
    n = len(page.tag)
    parent = page.parent
    size, linked, words, stops = [0] * n, [0] * n, [0] * n, [0] * n
    first, own = [0] * n, [0] * n
    seen = 0
    for block, body, in_links in page.runs:
        if not own[block]:
            first[block] = seen
        seen += len(body)
        own[block] += len(body)
        size[block] += len(body)
        linked[block] += in_links
        words[block] += body.count(" ") + 1
        stops[block] += body.count(".") + body.count(",")
    blocks, marks, children = [1] * n, list(page.marks), [0] * n
    begin = first
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        if size[i] and (not size[p] or begin[i] < begin[p]):
            begin[p] = begin[i]
        size[p] += size[i]
        linked[p] += linked[i]
        words[p] += words[i]
        stops[p] += stops[i]
        blocks[p] += blocks[i]
        marks[p] += marks[i]
        children[p] += 1
    own_weights = [[weights.get(t, 0.0) for t in block] for block in tokens(page)]
    for_it = [sum(w for w in block if w > 0) for block in own_weights]
    against = [sum(w for w in block if w < 0) for block in own_weights]
    depth, good, bad, place, group = [0] * n, [0.0] * n, [0.0] * n, [0] * n, [0] * n
    marked, counted = [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        good[i] = good[p] + (for_it[p] if p else 0)
        bad[i] = bad[p] + (against[p] if p else 0)
        group[i] = group[p] + (page.tag[p] in TAGS[6])
        marked[i] = marked[p] + (page.tag[p] in TAGS[4])
        place[i] = counted[p]
        counted[p] += 1
        key = (p, page.tag[i])
        same[key] = same.get(key, 0) + 1
    total = max(1, size[0])
    x = np.zeros((n, N_FEATURES))
    for j, tags in enumerate(TAGS):
        x[:, j] = [t in tags for t in page.tag]
    j = len(TAGS)
    size, linked, words, own = (np.array(v, float) for v in (size, linked, words, own))
    up = np.array(parent)
    up[0] = 0
    children, stops = np.array(children, float), np.array(stops, float)
    blocks, marks, begin = np.array(blocks, float), np.array(marks, float), np.array(begin, float)
    siblings = np.maximum(children[up], 1)
    full = np.maximum(size, 1)
    link_share = linked / full
    columns = [
        depth, np.log1p(size), np.log1p(own), link_share, blocks / full, marks / full, np.log1p(words),
        stops / np.maximum(words, 1), size / np.maximum(words, 1), for_it, against, good, bad, group, marked,
        size / np.maximum(size[up], 1), size / total, begin / total, (begin + size) / total, np.log1p(siblings),
        np.array(place) / siblings, [same.get((p, t), 0) for p, t in zip(parent, page.tag)] / siblings,
        np.log1p(size[up] / siblings), link_share[up], np.log1p(blocks), np.log1p(children)]
    for column in columns:
        x[:, j] = column
        j += 1
    return x


class Boosted:
    """Gradient-boosted regression trees on log loss, as arrays: feature, cut, left child, value; the tokens' weights."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: int = 20):
        self.trees_wanted, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.bias = 0.0
        self.tokens: dict[int, float] = {}

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Boosted":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, self.bins))) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        width = self.bins + 1
        margin = np.full(len(y), self.bias)
        for _ in range(self.trees_wanted):
            p = 1 / (1 + np.exp(-margin))
            g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
            feature, cut, left, value = [-1], [0.0], [0], [0.0]
            stack = [(0, np.arange(len(y)), 0)]
            while stack:
                node, rows, level = stack.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * gs / (hs + 1.0)
                margin_rows = rows
                if level < self.depth and len(rows) >= 2 * self.least:
                    best = (1e-6, 0, 0)
                    for j in range(x.shape[1]):
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, g[rows], width))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], width))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                    if best[0] > 1e-6:
                        _, j, k = best
                        feature[node], cut[node], left[node] = j, float(cuts[j][k]), len(feature)
                        low = binned[rows, j] <= k
                        for part in (rows[low], rows[~low]):
                            stack.append((len(feature), part, level + 1))
                            feature.append(-1)
                            cut.append(0.0)
                            left.append(0)
                            value.append(0.0)
                        continue
                margin[margin_rows] += value[node]
            self.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(value)))
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[at]
                inner = j >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, np.maximum(j, 0)] > cut[at]), at)
            out += value[at]
        return out


def decode(page: Page, odds: np.ndarray) -> set[int]:
    """Blocks whose runs are main matter, under the tree's rules."""
    n = len(page.tag)
    own = [0] * n
    for block, body, _ in page.runs:
        own[block] += len(body)
    # Every block speaks for its own text, and a little for itself.
    weight = [min(1.0, x / 200) + 0.1 for x in own]
    inside = [o * w for o, w in zip(odds.tolist(), weight)]
    dropped = [-x for x in inside]
    outside = list(dropped)
    for i in range(n - 1, 0, -1):
        p = parent = page.parent[i]
        dropped[p] += dropped[i]
        inside[p] += max(inside[i], dropped[i])
        outside[parent] += max(outside[i], inside[i], dropped[i])
    state, kept = [""] * n, set()
    state[0] = "outside"
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == "dropped":
            state[i] = "dropped"
        elif above == "inside":
            state[i] = "inside" if inside[i] > dropped[i] else "dropped"
        else:
            most = max(outside[i], inside[i], dropped[i])
            state[i] = "inside" if inside[i] == most else "outside" if outside[i] == most else "dropped"
        if state[i] == "inside":
            kept.add(i)
    return kept


def marked(page: Page) -> np.ndarray:
    """Whether each block is main matter by the page's own marks."""
    n = len(page.tag)
    out = np.zeros(n, bool)
    for i in range(1, n):
        tag, p, words = page.tag[i], page.parent[i], page.words[i]
        own = sum(w in MAIN_WORDS for w in words) - sum(w in OTHER_WORDS for w in words) - 2 * ("display:none" in words)
        shut_out = tag in TAGS[5] or tag in TAGS[6] or own < 0
        out[i] = not shut_out and (out[p] or tag in TAGS[4])
    return out


LAYOUTS = [
    ("<div class='{g}'>", "</div>"), ("<main id='{g}'>", "</main>"), ("<section class='{g} wrap'>", "</section>"),
    ("<div id='{g}'><div>", "</div></div>"), ("<table><tr><td class='{g}'>", "</td></tr></table>"),
    ("<div><div class='row'><div class='col {g}'>", "</div></div></div>"), ("<article>", "</article>"),
    ("<div role='main'>", "</div>"), ("<div>", "</div>"), ("<article class='{g}'><div class='{g}'>", "</div></article>"),
]


def relaid(blocks: list[tuple[str, str]], other: list[str], rng: random.Random) -> tuple[str, list[bool]]:
    """A page of the blocks (tag, text) in another layout, and whether each of its runs is main matter."""
    parts: list[str] = []
    truth: list[bool] = []
    good = rng.choice(["content", "story", "post-body", "entry", "article-text", "main", "body-copy",
                       *sorted(MAIN_WORDS)])
    others = sorted(OTHER_WORDS)
    pool = [w for t in other for w in t.split()] or ["x"]
    some = lambda a, b: " ".join(rng.choice(pool) for _ in range(rng.randint(a, b)))
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def block(tag, body, main, attrs=""):
        parts.append(f"<{tag}{attrs}>{esc(body)}</{tag}>")
        truth.append(main)

    def wrapped(tag, attrs, fill):
        parts.append(f"<{tag}{attrs}>")
        fill()
        parts.append(f"</{tag}>")

    def menu():
        def items():
            for _ in range(rng.randint(3, 9)):
                parts.append("<li>")
                parts.append(f"<a href='/x'>{esc(some(1, 3))}</a></li>")
                truth.append(False)
        wrapped(*rng.choice([("nav", ""), ("div", " class='menu'"), ("div", " id='nav'"), ("header", "")]),
                lambda: wrapped("ul", "", items))

    def paragraphs(tag, attrs, least, most, a, b):
        wrapped(tag, attrs, lambda: [block(rng.choice(["p", "div"]), some(a, b), False) for _ in range(rng.randint(least, most))])

    def noise(inside):
        kind = rng.randrange(14)
        if kind >= 7:
            paragraphs(rng.choice(["div", "section", "div"]), rng.choice([
                f" class='{rng.choice(others)}'", f" id='{rng.choice(others)}-{rng.choice(others)}'",
                f" class='{rng.choice(others)} box'", f" role='{rng.choice(others)}'", " style='display: none'"]), 1, 3, 3, 40)
        elif kind == 0:
            paragraphs("div", rng.choice([" class='ad'", " class='advert'", " id='sponsored'"]), 1, 1, 3, 30)
        elif kind == 1:
            paragraphs(*rng.choice([("aside", ""), ("div", " class='sidebar'"), ("div", " class='related-posts'")]),
                       1, 4, 3, 30)
        elif kind == 2:
            paragraphs("div", rng.choice([" class='cookie-notice'", " class='banner'", " role='alert'"]), 1, 2, 5, 30)
        elif kind == 3:
            paragraphs("form", rng.choice(["", " class='newsletter'", " id='login'"]), 1, 3, 1, 8)
        elif kind == 4:
            paragraphs("div", rng.choice([" class='share'", " class='social'", " class='tags'"]), 1, 3, 1, 4)
        elif kind == 5 and not inside:
            menu()
        else:
            parts.append(rng.choice(["<script>var a='<p>';</script>", "<style>p{}</style>", "<!-- x -->"]))

    parts.append("<html><head><title>" + esc(some(2, 6)) + "</title></head><body>")
    for fill in rng.sample([menu, lambda: noise(False), lambda: noise(False)], k=rng.randint(1, 3)):
        fill()
    opening, closing = rng.choice(LAYOUTS)
    parts.append(opening.format(g=good))
    for tag, body in blocks:
        block(tag, body, True)
        if rng.random() < 0.08:
            noise(True)
    parts.append(closing)
    for _ in range(rng.randint(0, 2)):
        noise(False)
    if rng.random() < 0.5:
        def comments():
            for _ in range(rng.randint(1, 5)):
                paragraphs(*rng.choice([("div", " class='comment'"), ("li", ""), ("article", " class='comment'")]),
                           1, 2, 5, 60)
        wrapped(*rng.choice([("section", " id='comments'"), ("div", " class='comments'"), ("ol", " class='responses'")]),
                comments)
    paragraphs(*rng.choice([("footer", ""), ("div", " class='footer'"), ("div", " id='legal'")]), 1, 2, 3, 20)
    parts.append("</body></html>")
    return "".join(parts), truth


def learn(pages: list[str], copies: int = 3, seed: int = 4) -> Boosted | None:
    """Trees from sample pages: as they are, and their articles in other layouts."""
    rng = random.Random(seed)
    seen: list[tuple[int, Page, np.ndarray]] = []  # the page learned from, one form of it, its main matter
    other: list[str] = []
    for source, html in enumerate(pages):
        page = Page(html)
        main = marked(page)
        known = main.any()
        if known:
            seen.append((source, page, main))
        # of a page that marks no article the texts still make articles for other layouts
        blocks = [(page.tag[b] if page.tag[b] in ("p", "h1", "h2", "h3", "li", "blockquote") else "p", t)
                  for b, t, _ in page.runs if main[b] or not known]
        for _ in range(copies if blocks else 0):
            k = rng.randint(1, len(blocks))
            at = rng.randint(0, len(blocks) - k)
            new, truth = relaid(blocks[at:at + min(k, 30)], other[-20:] or [blocks[0][1]], rng)
            again = Page(new)
            if len(again.runs) != len(truth):
                continue
            main_again = np.zeros(len(again.tag), bool)
            spoiled = np.zeros(len(again.tag), bool)
            for (b, _, _), yes in zip(again.runs, truth):
                while b > 0:  # a block is main matter if all text below it is
                    main_again[b] |= yes
                    spoiled[b] |= not yes
                    b = again.parent[b]
            seen.append((source, again, main_again & ~spoiled))
        other += [t for b, t, _ in page.runs if known and not main[b]] + [blocks[-1][1]] if blocks else []
    if not seen:
        return None
    total, of = (Counter(), Counter()), {source: (Counter(), Counter()) for source, _, _ in seen}
    for source, page, main in seen:
        for part, own, counts in zip(total, of[source], token_counts(page, main)):
            part.update(counts)
            own.update(counts)
    without = {source: token_weights(*(part - one for part, one in zip(total, own))) for source, own in of.items()}
    rows, labels, weights = [], [], []
    for source, page, main in seen:
        x = features(page, without[source] if len(of) > 1 else token_weights(*total))
        full = x[:, len(TAGS) + 1] > 0
        rows.append(x[full])
        labels.append(main[full])
        weights.append(0.3 + np.minimum(1, np.expm1(x[full, len(TAGS) + 2]) / 200))
    model = Boosted().fit(np.vstack(rows), np.concatenate(labels).astype(float), np.concatenate(weights))
    model.tokens = token_weights(*total)
    return model


def extract(htmls: list[str], model: Boosted | None) -> list[str]:
    """The main text of each page."""
    pages = [Page(h) for h in htmls]
    if not pages:
        return []
    if model is None:
        odds = [np.where(marked(p), 1.0, -1.0) for p in pages]
    else:
        rows = [features(p, model.tokens) for p in pages]
        odds = np.split(model(np.vstack(rows)), np.cumsum([len(r) for r in rows])[:-1])
    out = []
    for page, own in zip(pages, odds):
        kept = decode(page, own)
        out.append("\n".join(t for b, t, _ in page.runs if b in kept))
    return out


def train(pages: DataFrame, sample: int = SAMPLE) -> Boosted | None:
    """Trees from at most ``sample`` pages, by hash of the id and the page; a share of all pages is chosen first."""
    some = pages.where(F.col("html").isNotNull())
    share = min(1.0, 2.0 * sample / max(1, some.count()))
    place = F.xxhash64("page_id", F.xxhash64("html"), F.lit(2))
    rows = (some.where(F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
            .orderBy(place, "page_id").select("html").limit(sample).collect())
    return learn([r["html"] for r in rows])


def main_text(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """(page_id, url, text) of every page."""
    state = model and (model.trees, model.depth, model.bias, model.tokens)
    shared = pages.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        own = None
        if shared.value:
            own = Boosted(depth=shared.value[1])
            own.trees, own.bias, own.tokens = shared.value[0], shared.value[2], shared.value[3]
        for batch in slices(batches, "html", 2_000_000):
            found = extract(texts(batch, "html"), own)
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"),
                                   "text": pa.array(found, pa.string())})

    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return mapped(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages")
    return main_text(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
