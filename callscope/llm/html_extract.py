"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is a vector of its
hashed tag path (tags, class and id words of all ancestors), hashed words and a few shape figures. A
bidirectional LSTM in numpy reads a page's whole block sequence both ways and labels every block main
or not; the main blocks' texts, in page order, are the result.

The labeller is trained on the driver on SAMPLE pages of the input, chosen by hash, whose elements say
what they are (semantic tags and telling class names are the teacher), and on LAYOUTS pages laid out
anew at random from the sample's own texts, whose labels are known. Sample pages are whole; batches
hold pages of similar length. Nothing else is gathered.

A page is cut in time linear in its length, however broken it is, and a very long page is labelled in
parts that hand on the network's state.

Defined results: null, empty and textless html gives an empty text; unclosed and stray tags are
tolerated: an open head ends at the first element or text that belongs to the body, and an unclosed
element whose content is skipped ends at its tag, but for script and style, which take the rest as in
HTML; a quote without a partner is an ordinary character; repeated rows are each extracted; a block of
logit 0 is not main; other columns, whatever their names, stay in `row`; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm import common

SAMPLE, LAYOUTS = 150, 650
#: Share of the layouts whose boxes have names that say nothing.
UNNAMED = 0.25
PATH_BINS, WORD_BINS, SHAPE, HIDDEN = 192, 256, 6, 24
INPUT = PATH_BINS + WORD_BINS + SHAPE
EPOCHS, BATCH, RATE = 24, 100, 0.01
#: Blocks of several pages that are labelled at once.
BLOCKS_AT_ONCE = 8192

INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg title object".split())
#: Tags that stay within an open head.
HEAD = set("head html base link meta title style script noscript template".split())
#: What the teacher knows: tags, and words of class names and ids.
MAIN_TAGS, OTHER_TAGS = {"article", "main"}, set("nav header footer aside form button select dialog menu".split())
OTHER_WORDS = set(
    "ad ads advert advertisement sponsored banner promo sidebar side widget menu nav navbar navigation breadcrumb header masthead topbar footer bottom copyright legal "
    "comment comments commentlist respond reply discussion disqus cookie consent notice alert newsletter popup modal login signup search form share social related recommended tags meta".split()
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


class Block:
    """A text, its path and how many of its characters are linked.

    A path is () or (path of the parent, tag, words of class, id and role, bins of all tags and words, depth, what the teacher says).
    """

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def within(parent: tuple, tag: str, names: tuple[str, ...]) -> tuple:
    bins = parent[3] if parent else 0
    for x in ("<" + tag, *("." + w for w in names)):
        bins |= 1 << binned(x, PATH_BINS)
    says = 0.0 if tag in OTHER_TAGS or OTHER_WORDS & set(names) else 1.0 if tag in MAIN_TAGS else parent[5] if parent else 0.0
    return (parent, tag, names, bins, (parent[4] if parent else 0) + 1, says)


class Tags:
    """Finds the ends of tags, each character being looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.lone, self.quoted = page, set(), True

    def end(self, at: int) -> int:
        """The place after the tag that starts at `at`, or 0: the first > outside quotes, once there is none the first of all."""
        k = at
        while self.quoted:
            m = MARK.search(self.page, k)
            if m is None:
                self.quoted = False
                break
            if m[0] == ">":
                return m.end()
            closed = -1 if m[0] in self.lone else self.page.find(m[0], m.end())
            if closed < 0:
                self.lone.add(m[0])
            k = max(m.end(), closed + 1)
        return self.page.find(">", at) + 1


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page."""
    out: list[Block] = []
    stack: list[tuple] = []
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked = links = 0
    unclosed: set[str] = set()
    tags = Tags(page)

    def cut_stack(k: int) -> None:
        for p in stack[k:]:
            open_tags[p[1]] -= 1
        del stack[k:]

    def close_head() -> None:
        if open_tags["head"]:
            cut_stack(next(k for k, p in enumerate(stack) if p[1] == "head"))

    def flush() -> None:
        nonlocal linked
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            close_head()
            out.append(Block(text, stack[-1] if stack else (), linked))
        linked = 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            parts.append(page[at:])
            linked += links and n - at
            break
        m = NAME.match(page, lt)
        if m:
            end = tags.end(m.end())
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) + 3
            end = n if end < 3 else end
        else:
            end = page.find(">", lt) + 1 if page[lt + 1 : lt + 2] in ("!", "?") else 0
        upto = lt if end else lt + 1
        if upto > at:
            parts.append(page[at:upto])
            linked += links and upto - at
        at = end or lt + 1
        if not m or not end:
            if not end and m and not tags.quoted:
                # No > is left: the rest has no tags.
                parts.append(page[at:])
                break
            continue
        tag, inside = m[2].lower(), page[m.end() : end - 1]
        if m[1]:
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            flush()
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][1] != tag:
                    k -= 1
                cut_stack(k)
            continue
        if tag in RAW and not inside.endswith("/"):
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else n if tag in ("script", "style") else at
            if tag not in ("svg", "noscript"):
                flush()
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag not in HEAD:
            close_head()
        links = 0
        if tag in VOID or inside.endswith("/"):
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and (stack[-1][1] == tag or stack[-1][1] == "p"):
            cut_stack(len(stack) - 1)
        names = " ".join(x for t in ATTRIBUTE.findall(inside) for x in t) if inside else ""
        stack.append(within(stack[-1] if stack else (), tag, tuple(NAME_WORDS.findall(names.lower()))))
        open_tags[tag] += 1
    flush()
    return out


def binned(word: str, bins: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % bins


PATHS: dict[int, np.ndarray] = {}
BINS: dict[str, int] = {}


def path_vector(path: tuple) -> np.ndarray:
    bins = path[3] | 1 << binned("^" + path[1], PATH_BINS) if path else 0
    v = PATHS.get(bins)
    if v is None:
        v = np.unpackbits(np.frombuffer(bins.to_bytes(PATH_BINS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
        if len(PATHS) > 5000:
            PATHS.clear()
        PATHS[bins] = v
    return v


def word_bin(word: str) -> int:
    b = BINS.get(word)
    if b is None:
        if len(BINS) > 200_000:
            BINS.clear()
        b = BINS[word] = binned(word, WORD_BINS)
    return b


def vectors(blocks: list[Block], start: int = 0, total: int = 0) -> np.ndarray:
    """One row per block; `blocks` may be a part, from place `start`, of a page of `total` blocks."""
    x, total = np.zeros((len(blocks), INPUT), np.float32), total or len(blocks)
    for i, b in enumerate(blocks):
        x[i, :PATH_BINS] = path_vector(b.path)
        words = b.text.split(" ")
        x[i, PATH_BINS:-SHAPE] = np.bincount([word_bin(w) for w in words], minlength=WORD_BINS) / len(words)
        n, depth = len(b.text), b.path[4] if b.path else 0
        x[i, -SHAPE:] = (np.log1p(n) / 8, min(1, b.linked / n), b.text.count(".") / (1 + n / 50), (start + i) / total, start + i == 0, min(2, depth / 10))
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over padded batches of block sequences, with one logit a block."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        if weights is None:
            r = np.random.default_rng(3)
            weights = {}
            for d in "fb":
                weights[f"x{d}"] = r.normal(0, 0.1, (INPUT, 4 * HIDDEN))
                weights[f"h{d}"] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
                weights[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
            weights["o"], weights["ob"] = r.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.w = weights

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        b, t, _ = x.shape
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        out = np.zeros((b, t, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + h @ self.w[f"h{d}"]
            i, f, o = (sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, k, None]
            c2 = f * c + i * g
            th = np.tanh(c2)
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, k] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        hs = np.concatenate([self.run(x, mask, d, keep and keep[j]) for j, d in enumerate("fb")], axis=2)
        return hs @ self.w["o"] + self.w["ob"], hs

    def long_logits(self, blocks: list[Block]) -> np.ndarray:
        """The logits of one page of any length, in parts: only one number a block and direction is kept."""
        starts = range(0, len(blocks), BLOCKS_AT_ONCE)
        z = np.full(len(blocks), self.w["ob"][0])
        for j, d in enumerate("fb"):
            w, wh = self.w["o"][j * HIDDEN : (j + 1) * HIDDEN], self.w[f"h{d}"]
            h = c = np.zeros(HIDDEN, np.float32)
            for s in starts if d == "f" else reversed(starts):
                pre = vectors(blocks[s : s + BLOCKS_AT_ONCE], s, len(blocks)) @ self.w[f"x{d}"] + self.w[f"c{d}"]
                for k in range(len(pre)) if d == "f" else range(len(pre) - 1, -1, -1):
                    a = pre[k] + h @ wh
                    gates = sigmoid(a[: 3 * HIDDEN])
                    c = gates[HIDDEN : 2 * HIDDEN] * c + gates[:HIDDEN] * np.tanh(a[3 * HIDDEN :])
                    h = gates[2 * HIDDEN :] * np.tanh(c)
                    z[s + k] += h @ w
        return z

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: tuple[list, list] = ([], [])
        z, hs = self.logits(x, mask, keep)
        dz = (sigmoid(z) - y) * mask / mask.sum()
        g = {"o": np.einsum("bt,bth->h", dz, hs), "ob": dz.sum(keepdims=True)[0]}
        dh_all = dz[:, :, None] * self.w["o"]
        for j, d in enumerate("fb"):
            wh = self.w[f"h{d}"]
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for k, h, c, i, f, o, gg, th, m in reversed(keep[j]):
                dh = dh + dh_all[:, k, j * HIDDEN : (j + 1) * HIDDEN]
                dhm, dcm = dh * m, dc * m
                dc2 = dcm + dhm * o * (1 - th * th)
                dzk = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), dhm * th * o * (1 - o), dc2 * i * (1 - gg * gg)], axis=1)
                dpre[:, k] = dzk
                gh += h.T @ dzk
                dh, dc = dh * (1 - m) + dzk @ wh.T, dc * (1 - m) + dc2 * f
            g[f"h{d}"], g[f"c{d}"] = gh, dpre.sum((0, 1))
            g[f"x{d}"] = np.einsum("bti,btz->iz", x, dpre, optimize=True)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam on the mean cross-entropy of all blocks."""
        r, step = np.random.default_rng(4), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for epoch in range(EPOCHS):
            for some in batches([len(p[0]) for p in pages], r):
                x, mask = padded([pages[k][0] for k in some])
                y = np.zeros(mask.shape, np.float32)
                for row, k in enumerate(some):
                    y[row, : len(pages[k][1])] = pages[k][1]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.gradients(x, mask, y).items():
                    a, b = moments[k]
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    self.w[k] = (self.w[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def batches(sizes: list[int], r: np.random.Generator) -> list[list[int]]:
    """Places of `sizes`, those of similar size together, in random order: BATCH at most, padded to BLOCKS_AT_ONCE at most."""
    out: list[list[int]] = [[]]
    for k in sorted(r.permutation(len(sizes)), key=lambda k: sizes[k]):
        if len(out[-1]) == BATCH or (out[-1] and sizes[k] * (len(out[-1]) + 1) > BLOCKS_AT_ONCE):
            out.append([])
        out[-1].append(int(k))
    return [out[k] for k in r.permutation(len(out)) if out[k]]


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(1, max(map(len, xs)))
    x, mask = np.zeros((len(xs), t, INPUT), np.float32), np.zeros((len(xs), t), np.float32)
    for i, v in enumerate(xs):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
    return x, mask


def taught(b: Block) -> float:
    """The teacher's label: what a block's own ancestors say, the nearest first."""
    return b.path[5] if b.path else 0.0


MAIN_BOXES = ["article", "main", 'div class="content"', 'div class="post-content"', 'div id="main-content"', 'section class="article-body"', 'div class="entry"', 'div class="story"', 'article class="post"', 'div class="text"']
OTHER_BOXES = {
    "menu": ["nav", 'ul class="menu"', 'div class="navbar"', 'div id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"'],
    "header": ["header", 'div class="header"', 'div id="masthead"', 'div class="top-bar"', 'header class="site-header"'],
    "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="legal"'],
    "side": ["aside", 'div class="sidebar"', 'div class="widget"', 'aside class="related"', 'div class="related-posts"', 'div id="side"', 'div class="social-share"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div class="banner"', 'section class="promo"', 'div id="advertisement"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div class="consent"', 'div class="newsletter"', 'div class="popup"', 'div role="alert"'],
    "form": ["form", 'div class="login"', 'form class="search"', 'div class="signup-form"'],
    "comments": ['div class="comments"', 'section id="comments"', 'ol class="commentlist"', 'div class="comment"', 'ul class="replies"', 'div id="respond"', 'div class="discussion"'],
}


def laid_out(texts: list[str], r: random.Random) -> tuple[list[Block], list[float]]:
    """A page of a random layout and its labels; on some pages the boxes are plain, and only what is in them tells."""
    labels: list[float] = []
    plain = r.random() < UNNAMED

    def fill(main: bool, n: int, linked: bool) -> str:
        out = []
        for _ in range(n):
            t = html.escape(r.choice(texts))
            t = " ".join(t.split(" ")[: r.randint(1, 6)]) if linked else t
            tag = r.choice(["p", "p", "p", "h1", "h2", "li", "blockquote", "td", "pre", "div"] if main else ["p", "li", "div", "span", "h3"])
            t = f'<a href="/">{t}</a>' if linked else t
            out.append(f"<{tag}>{t}</{tag}>" if tag != "span" else f"<div><span>{t}</span></div>")
            labels.append(float(main))
        return "".join(out)

    def box(name: str, inside: str) -> str:
        name = r.choice(["div", 'div class="c%d"' % r.randint(1, 99), "section", 'div id="b%d"' % r.randint(1, 99)]) if plain else name
        return f"<{name}>{inside}</{name.split()[0]}>"

    def other(kind: str) -> str:
        return box(r.choice(OTHER_BOXES[kind]), fill(False, r.randint(1, 5), plain or (kind in ("menu", "side") and r.random() < 0.7)))

    page = [other(k) for k in r.sample(["menu", "header", "notice", "ad", "form"], r.randint(0, 4))]
    main = [fill(True, r.randint(1, 4), False)]
    while r.random() < 0.4:
        main.append(other(r.choice(["ad", "side", "notice", "form"])))
        main.append(fill(True, r.randint(1, 3), False))
    name = r.choice(MAIN_BOXES)
    main_box = box(name, "".join(main))
    for _ in range(r.randint(0, 2)):
        main_box = box(r.choice(['div class="container"', 'div class="wrapper"', "div", 'div id="page"', "section"]), main_box)
    page.append(main_box)
    page += [other(k) for k in r.sample(["comments", "side", "ad", "footer", "form", "notice", "comments"], r.randint(0, 5))]
    found = blocks_of("<html><body>" + "".join(page) + "</body></html>")
    return (found, labels) if len(found) == len(labels) else ([], [])


def trained(sample: list[str]) -> dict[str, np.ndarray]:
    """Weights learned from the sample pages and layouts made of their texts."""
    r = random.Random(5)
    pages = [blocks_of(p) for p in sample]
    texts = [b.text[:400] for p in pages for b in p if len(b.text) > 3] or ["text"]
    # A page beyond what is labelled at once is learned from in parts.
    parts = [(p, s) for p in pages for s in range(0, len(p), BLOCKS_AT_ONCE)]
    data = [(vectors(p[s : s + BLOCKS_AT_ONCE], s, len(p)), np.array([taught(b) for b in p[s : s + BLOCKS_AT_ONCE]], np.float32)) for p, s in parts]
    for _ in range(LAYOUTS):
        blocks, labels = laid_out(texts, r)
        if blocks:
            data.append((vectors(blocks), np.array(labels, np.float32)))
    model = Labeller()
    model.fit(data)
    return model.w


def extractor(weights) -> Callable:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        model = Labeller(weights.value)

        def label(pages: list[list[Block]]) -> list[str]:
            x, mask = padded([vectors(p) for p in pages])
            z, _ = model.logits(x, mask)
            return ["\n".join(b.text for b, v in zip(p, row) if v > 0) for p, row in zip(pages, z)]

        def work(column: pa.Array) -> list[pa.Array]:
            texts: list[str] = [""] * len(column)
            waiting: list[tuple[int, list[Block]]] = []
            size = 0

            def drain() -> None:
                nonlocal size
                waiting.sort(key=lambda w: len(w[1]))
                while waiting:
                    some = [waiting.pop()]
                    most = len(some[0][1])
                    while waiting and most * (len(some) + 1) <= BLOCKS_AT_ONCE and 2 * len(waiting[-1][1]) + 8 >= most:
                        some.append(waiting.pop())
                    for (i, _), t in zip(some, label([p for _, p in some])):
                        texts[i] = t
                size = 0

            for i, page in enumerate(common.binary_texts(column)):
                blocks = blocks_of(page.decode()) if page else []
                if len(blocks) > BLOCKS_AT_ONCE:
                    texts[i] = "\n".join(b.text for b, v in zip(blocks, model.long_logits(blocks)) if v > 0)
                elif blocks:
                    waiting.append((i, blocks))
                    size += len(blocks)
                if size > 2 * BLOCKS_AT_ONCE:
                    drain()
            drain()
            return [pa.array(texts, pa.string())]

        return work

    return make


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """Columns `row` (the page) and main_text."""
    # A few times `sample` rows by hash, whatever the input, of which the first are taken.
    k = F.xxhash64(id_col, html_col)
    some = pages.where((F.length(html_col) > 0) & (F.pmod(k, F.lit(max(1, pages.count()))) < 4 * sample))
    chosen = some.select(k.alias("k"), F.col(html_col).alias("h")).orderBy("k").limit(sample)
    weights = pages.sparkSession.sparkContext.broadcast(trained([r.h for r in chosen.collect()]))
    return common.map_text(pages, html_col, extractor(weights), [T.StructField("main_text", T.StringType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
