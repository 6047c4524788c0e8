"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks at block-level tags. A block is described by its word
count and link density, those of the blocks before and after it, and by where
it stands: in an article or beside one, in an element made for something else
(menus, forms), in a heading, in a container whose class names page furniture.
A decision tree, grown in numpy on the labelled pages below, keeps or drops
each block. A name counts only if a whole class, id or role says nothing else
("share-bar", not "share-knowledge-story"), and only on a page, or in an article,
that has other text: where nearly all words stand in named containers the names
are no hint. Names of containers around an article say nothing about it unless
the page has another article without them.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Element names of HTML by what they do to the text.
CODE = frozenset(["script", "style"])
RAW = frozenset("script style title textarea iframe noframes noscript xmp".split())
SKIPPED = frozenset("template svg math object select canvas audio video".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button".split()
)
SPACES = frozenset(["br", "wbr", "img", "input"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu button dialog".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
CONTAINERS = frozenset("article main nav header footer aside form menu button dialog div section ul ol table figure p span blockquote details".split())
# Words of class, id and role that name page furniture.
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright"
    " dialog discussion disqus footer form gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pagination pager paywall popup promo promotion"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar toc warning widget".split()
)
# Words that may stand beside them in such a name.
BESIDE = frozenset("area bar block box buttons container global group icons inner items links list media outer page panel posts section site wrapper".split())
#: Names are a hint if at least this share of the words that could be main text is not named.
UNNAMED = 0.2
PLACES = frozenset(["article", "main"])

_ATTRIBUTES = re.compile(r"""(class|id|role|style|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>"']|$)""", re.I)
_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>")
_NAME = re.compile("[a-z0-9]+")


@dataclass
class Block:
    text: str
    n_words: int
    link_words: int
    in_article: bool
    tagged: bool  # in an element made for something else than text, or hidden
    named: bool  # in a container whose name says furniture, within the article or without one
    around: bool  # in an article within such a container
    heading: bool


def _says_furniture(name: str) -> bool:
    parts = set(_NAME.findall(name))
    return not NAMES.isdisjoint(parts) and all(p in NAMES or p in BESIDE or p.isdigit() for p in parts)


@dataclass
class Place:
    """An open element and what it says about the text inside."""

    name: str = ""
    in_article: bool = False
    tagged: bool = False
    named: bool = False
    around: bool = False

    def inner(self, name: str, attributes: str) -> Place:
        tagged = self.tagged or name in FURNITURE or name == "header" and not self.in_article
        article = name in PLACES
        named = False
        for key, value in _ATTRIBUTES.findall(attributes) if attributes.strip() else ():
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
                tagged = True
            elif key in ("class", "id", "role"):
                named = named or any(_says_furniture(name) for name in value.split())
        if article:
            return Place(name, True, tagged, False, self.around or self.named or named)
        return Place(name, self.in_article, tagged, self.named or named, self.around)

    def same(self, other: Place) -> bool:
        return (self.in_article, self.tagged, self.named, self.around) == (other.in_article, other.tagged, other.named, other.around)


_BREAKOUT = re.compile(r"<(?:p|div|h[1-6]|ul|ol|li|table|section|article|main|nav|footer|header|aside|blockquote|pre|body|br|span)(?=[\s/>])", re.I)


def _after_skipped(page: str, name: str, at: int) -> int | None:
    """Where the element that is open at ``at`` ends, inner ones of its name counted; None if it never does.

    Text elements break out of an open svg or math, as in browsers.
    """
    depth = 1
    for found in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if found[1]:
            depth -= 1
        elif not found[0].endswith("/>"):
            depth += 1
        if depth == 0:
            return found.end()
    out = _BREAKOUT.search(page, at) if name in ("svg", "math") else None
    return out.start() if out else None


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order; blocks without words are left out."""
    blocks: list[Block] = []
    stack: list[Place] = []
    never: set[str] = set()  # names that are not closed any more
    parts: list[str] = []
    linked: list[str] = []
    here = Place()
    heading = in_link = 0

    def close() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                blocks.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), here.in_article, here.tagged, here.named, here.around, heading > 0))
        parts.clear()
        linked.clear()

    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            parts.append(page[at:tag])
            if in_link:
                linked.append(page[at:tag])
        if tag >= n:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        found = _TAG.match(page, tag) or _LOOSE_TAG.match(page, tag)
        if found is None:  # a bare "<"
            parts.append("<")
            at = tag + 1
            continue
        at = found.end()
        closing, name, attributes = found[1] == "/", found[2].lower(), found[3]
        if name in RAW or name in SKIPPED:
            if not closing and not attributes.endswith("/") and name not in never:
                end = _after_skipped(page, name, at) if name in SKIPPED else next((m.end() for m in re.compile(rf"</{name}\s*>", re.I).finditer(page, at)), None)
                if end is not None:
                    at = end
                elif name in CODE:
                    at = n
                else:  # never closed: the page goes on
                    never.add(name)
            continue
        if name in SPACES:
            parts.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name in BREAKS:
            close()
            in_link = 0
        if name in HEADINGS:
            heading = 0 if closing else 1
        if name not in CONTAINERS or name in VOID:
            continue
        if closing:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d].name == name), None)
            if depth is not None:
                close()
                del stack[depth:]
        elif not attributes.endswith("/"):
            if name == "p":  # an open paragraph ends where the next one begins
                if stack and stack[-1].name == "p":
                    stack.pop()
            over = stack[-1] if stack else Place()
            inner = over.inner(name, attributes)
            if name == "span":
                if inner.same(over):
                    stack.append(inner)
                    continue
                close()
            stack.append(inner)
        here = stack[-1] if stack else Place()
    close()
    return blocks


FEATURES = ("in_article", "tagged", "named", "heading", "words_before", "links_before", "words", "links", "words_after", "links_after")


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; beyond the ends of the page there are no words.

    in_article is 1 in an article, 0 on a page without any, -1 beside one. An
    article in a container named as furniture counts if the page has no other.
    named is 0 where the names are no hint.
    """
    plain = any(b.in_article and not b.around for b in blocks)
    articles = [b.in_article and not (plain and b.around) for b in blocks]
    some = any(articles)
    text = [(b.n_words - b.link_words, b.named) for a, b in zip(articles, blocks, strict=True) if a == some and not b.tagged]
    telling = sum(n for n, named in text if not named) >= UNNAMED * sum(n for n, _ in text)
    own = np.array([(a - (some and not a), b.tagged, b.named and (telling or a != some), b.heading, b.n_words, b.link_words / b.n_words) for a, b in zip(articles, blocks, strict=True)], dtype=float).reshape(-1, 6)
    around = np.vstack([np.zeros((1, 2)), own[:, 4:], np.zeros((1, 2))])
    return np.hstack([own[:, :4], around[:-2], own[:, 4:], around[2:]])


SCALES = (0.7, 1.0, 1.6, 4.0)

# The labelled pages, written for this purpose. "X40" stands for forty words of
# main text, "x40" for forty words of anything else.
LABELLED = (
    "<nav><ul><li><a>x1</a><li><a>x1</a><li><a>x2</a></ul></nav><div class=ad>x7</div><article><h1>X8</h1><p>X1</p><p>X60 <a>X4</a></p><p>X2</p><p>X35</p></article><footer>x6</footer>",
    "<nav><a>x3</a></nav><article><p><b>X9</b><br></p><p>X120</p><p>X3</p><p>X1</p></article><footer>x12 <a>x2</a></footer>",
    "<div class=ad>x25</div><article><h1>X12</h1><p>X80</p></article><div class=ad>x40</div><footer>x30</footer>",
    "<article><p>X200</p></article>",
    "<article><p>X5</p></article><footer>x3</footer>",
    "<article><h2>X3</h2><ul><li>X1<li><a>X2</a><li><a>X3</a> X1<li>X4</ul><p>X40 <a>X20</a></p></article>",
    "<header><a>x2</a><p>x9</p></header><main><h1>X6</h1><p>X45</p><p>X14 <a>X6</a></p><aside><p>x25</p></aside><p>X50</p><form><label>x2</label><button>x1</button></form></main><div>x28</div><footer>x8</footer>",
    "<article><h1>X7</h1><p>X30</p><div class=newsletter><p>x20</p></div><p>X26</p><div class='share bar'><a>x1</a><a>x1</a></div><p>X70</p><div class=related><h3>x2</h3><ul><li><a>x6</a><li><a>x7</a></ul></div></article>",
    "<article><h1>X5</h1><p>X90</p><p>X75</p><section id=comments><h3>x2</h3><p>x90</p><p>x44</p><p>x60</p></section></article>",
    "<article><h1>X6</h1><p>X64</p></article><section class=comments><article><p>x50</p></article><article class=comment><p>x33</p></article></section><footer>x4</footer>",
    "<div class='content related'><article><h1>X5</h1><p>X70</p><p>X2</p><p>X41</p></article></div>",
    "<article class=post-tags-wide><p>X40</p><p>X18 <a>X3</a></p></article><div class=tags><a>x1</a> <a>x2</a></div>",
    "<div class=cookie-notice>x22</div><article><p>X3</p><p>X55</p></article><div class=popup><p>x35</p></div>",
    "<div><a>x1</a></div><div><a>x1</a></div><div><a>x2</a></div><h1>X7</h1><div>X42</div><div>X62 <a>X3</a></div><div>X16 <a>X2</a></div><div>X33</div><div>x1 <a>x9</a></div><div><a>x4</a></div><div>x5 <a>x4</a></div>",
    "<table><tr><td><a>x1</a><td><a>x1</a></tr></table><h2>X5</h2><div>X90 <a>X3</a></div><div>X25</div><div>X110</div><div>x3</div><div><a>x2</a></div><div><a>x2</a></div>",
    "<div><a>x2</a></div><div><a>x2</a></div><div>x6 <a>x24</a></div><h1>X9</h1><p>X28</p><p>X55 <a>X6</a></p><p>X22</p><div>x3 <a>x9</a></div><div>x2 <a>x8</a></div><div>x5</div>",
    "<div>X80</div>",
    "<p>X30</p><p>X45</p>",
    "<div><a>x3</a></div><p>X35</p><p>X48</p><p>X60 <a>X3</a></p><div class=sidebar><p>x70</p></div><div class=legal>x21 <a>x9</a></div><div id=comments><p>x150</p></div>",
    "<div class=banner>x30</div><h1>X4</h1><p>X31</p><p>X8</p><p>X44</p><div class=comments><p>x90</p></div><div class=footer>x16</div>",
    "<div><a>x3</a></div><div>x1 <a>x11</a></div><div>x2</div>",
    "<div>x5</div><div><a>x2</a></div><div>x3</div>",
    "<h1>X6</h1><p>X38</p><p>X7</p><p>X52</p><p>X9</p><p>X47</p><div><a>x5</a></div><div><a>x6</a></div><div>x4</div>",
    "<div><a>x2</a> <a>x2</a></div><p>X24</p><p>X12</p><p>X39</p><div>x8 <a>x30</a></div><div><a>x6</a></div>",
    "<div><a>x3</a></div><div><a>x5</a></div><div>x9</div><div><a>x4</a></div><div>x12</div><div><a>x6</a></div><div><a>x2</a></div>",
    "<div><a>x2</a></div><div>x14</div><div><a>x7</a></div><h1>X5</h1><p>X50</p><p>X10</p><p>X36</p><div><a>x3</a></div><div>x7</div><div><a>x3</a></div>",
    "<article><p>X12</p><p><a>X4</a></p><p>X9</p></article><nav><a>x4</a></nav>",
    "<nav><a>x2</a></nav><article><h1>X9</h1><p>X150</p><p>X1</p><p>X130</p><p>X12</p><p>X2</p><p>X210</p><p>X190</p></article><footer>x9</footer>",
    "<nav><a>x2</a></nav><div class=ad>x11</div><article><h1>X9</h1><p>X9</p><p>X1</p><p>X240</p><p>X3</p></article><footer>x9</footer>",
    "<article><h1>X2</h1><p>X300</p><p>X1 <a>X9</a></p><p>X60</p></article><div>x60</div><div><a>x8</a></div>",
    "<nav><a>x2</a></nav><article><div class=share><p>X60</p><p>X40</p></div></article><footer>x5</footer>",
    "<div><a>x2</a></div><section id=search><h2>X4</h2><p>X70</p><p>X50 <a>X3</a></p></section><div>x4</div>",
    "<nav><a>x3</a></nav><div class=social><h1>X5</h1><p>X80</p><p>X45</p></div><footer>x7</footer>",
    "<article><h1>X5</h1><div class=notice><p>x12</p></div><p>X90</p><p>X33</p><div class=promo-box>x18 <a>x2</a></div></article>",
    "<main><h1>X6</h1><p>X70</p><aside><p>x30</p></aside><p>X40</p><form><label>x3</label></form><p>X55</p></main><div>x20</div><footer>x8</footer>",
    "<article><h1>X6</h1><p>X50</p><div class=related><h3>x2</h3><a>x5</a> <a>x6</a></div><p>X40</p><div class=subscribe><p>x25</p></div><p>X22</p></article>",
    "<article><h1>X6</h1><p>X80</p><p>X64</p></article><section class=comment-list><article><p>x35</p></article><article><p>x60</p></article></section><footer>x4</footer>",
)


def labelled_table(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """The features of the blocks of the labelled pages, each at several lengths of its texts, and 1 for main text."""
    rows, labels = [], []
    for page in pages:
        for scale in SCALES:
            blocks = page_blocks(re.sub(r"\b([xX])([0-9]+)", lambda m, s=scale: " ".join([m[1]] * max(1, round(int(m[2]) * s))), page))
            rows.append(block_features(blocks))
            labels += [int(b.text.startswith("X")) for b in blocks]
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 6):
    """A decision tree by Gini impurity: a share of label 1, or (feature, threshold, left, right)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        v, ones = x[order, feature], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (cost[k], feature, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return share
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


@functools.cache
def trained_tree():
    return grow(*labelled_table())


def is_main(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree=None) -> str:
    """The main text: kept blocks in page order, joined by one newline; empty if there are none."""
    blocks = page_blocks(page or "")
    if not blocks:
        return ""
    tree = trained_tree() if tree is None else tree
    return "\n".join(b.text for b, row in zip(blocks, block_features(blocks).tolist(), strict=True) if is_main(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null or empty html gives an empty text; broken markup is read as far as it
    goes and never fails; a very long page is cut and classified whole; equal
    pages have equal texts; repeated rows and null ids stay as they are; other
    columns are not read. A leaf of the tree that is tied drops its blocks.
    """
    tree = trained_tree()
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
