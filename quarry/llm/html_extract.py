"""HTML main-text extraction: boosted trees over DOM nodes, hierarchical decoding.

A page becomes a tree of block nodes; runs of text directly inside a block are
its leaves.  Features of a node: its tag; the attribute tokens of its own and of
its ancestors; depth; text, link and markup density of its subtree; and statistics
of its siblings.  Attribute tokens are hashed to TOKENS buckets, whose log-odds of
standing on main text are learned on one half of the training pages; a node has
the least and the greatest of its tokens' log-odds.  Gradient-boosted trees, grown
on the other half, give each node's probability of holding main text.  Decoding maximises the sum of
log-likelihoods over the whole tree under the rule that a node is kept only where
its parent is (a dynamic program from the leaves up), so an ancestor and a
descendant never contradict.

Scripts, styles, templates, comments, form controls and the head never hold
text; they are removed while the tree is built.  Building it is linear in the
page, however deep it nests and however broken it is: tags are read without going
back, every node knows the open elements that an opening tag may close, and end tags
without an open element are told by counters.

The trees are trained here, in numpy, on PAGES made-up pages (``made_page``)
whose main blocks are known: navigation, headers, footers, sidebars, adverts,
cookie notices, related links, forms and reader comments around articles of many
shapes, with helpful, foreign or no attributes, some of them with omitted tags.
No list of words is part of the features: what an attribute token means is
learned.

Defined results: null counts as empty; no main text: empty string and 0; a page
cut off anywhere keeps what the tree holds up to there; very long and very deep
pages are like any other; repeated rows repeat; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from functools import cache, lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_rows, blocks, table

PAGES = 1000
TREES, DEPTH, RATE, BINS = 70, 4, 0.2, 32
#: Share of the nodes that each tree sees.
SHARE = 0.5
#: Buckets of attribute tokens, and the nodes of either kind that each bucket is taken to have seen besides.
TOKENS, SMOOTH = 4096, 1.0
#: Characters of pages whose nodes are scored together.
BLOCK_CHARS = 2_000_000

SILENT = frozenset("script style template noscript head title iframe object svg math canvas audio video select button textarea datalist map".split())
#: What may stand in a head; any other opening tag ends it.
IN_HEAD = frozenset("head title base link meta style script noscript template basefont bgsound noframes html".split())
#: Silent elements that end with the block that holds them, should their end tag be missing.
LOOSE = frozenset("noscript object svg math canvas audio video select button datalist map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that an opening tag closes (the nearest one), and what hides them.
_ENDED = (
    ({"p"}, {"div", "td", "th", "li", "article", "section", "blockquote", "button", "table"}),
    ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}),
)
#: Tag -> the rule of _ENDED that it follows, besides the first, which all blocks follow.
_CLOSES = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}


class Node:
    __slots__ = ("attrs", "children", "links", "near", "parent", "tag", "tags")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        #: Block nodes, and strings: text runs directly inside this block.
        self.children: list[Node | str] = []
        self.tags = 0  # inline elements directly inside
        self.links = 0  # characters of text directly inside that stand in links
        above = parent.near if parent is not None else (None,) * len(_ENDED)
        #: For each rule of _ENDED the open element that it would close, from here.
        self.near: tuple[Node | None, ...] = tuple(None if tag in hides else self if tag in closed and parent is not None else n for (closed, hides), n in zip(_ENDED, above))


#: Elements whose content is no markup, up to their end tag.
_RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in ("script", "style")}
_NAME = re.compile(r"[a-zA-Z][^\s/>\0]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
_TAG_END = re.compile(r"[\s/]*+>")
#: More digits than ``unescape`` can read; no such character exists.
_ENDLESS = re.compile("&#[0-9]{1000,};?")


def _unescaped(text: str) -> str:
    return unescape(_ENDLESS.sub("\ufffd", text)) if "&" in text else text


class _Tree:
    """Reads a page from left to right, every character a bounded number of times."""

    def __init__(self):
        self.root = self.at = Node("html")
        self.silent: list[str] = []
        self.held: Counter[str] = Counter()  # tags in ``silent``
        self.tight = 0  # how many of them are not LOOSE
        self.inside: dict[str, int] = {}  # open blocks inside silent elements
        self.open: Counter[str] = Counter()  # tags of the open blocks
        self.links = 0
        self.run: list[str] = []  # the pieces of the text that ``at`` ends with

    def read(self, page: str):
        """Tags, texts and comments in turn; what a page that is cut off has begun, a tag or a comment, is dropped."""
        at, n = 0, len(page)
        while at < n:
            found = page.find("<", at)
            if found < 0:
                found = n
            if found > at:
                self.data(_unescaped(page[at:found]))
            at = found
            if at == n:
                break
            mark = page[at + 1 : at + 2]
            if mark.isascii() and mark.isalpha():
                at = self.start(page, at + 1)
            elif mark == "/" and (name := _NAME.match(page, at + 2)) is not None:
                end = page.find(">", name.end())
                if end >= 0:
                    self.end_tag(name[0].lower())
                at = end + 1 if end >= 0 else n
            elif mark in ("/", "!", "?") and mark:
                comment = page.startswith("<!--", at)
                close = "-->" if comment else ">"
                end = at + 4 if comment and page.startswith(">", at + 4) else page.find(close, at + 2 + 2 * comment)
                at = n if end < 0 else at + 5 if comment and end == at + 4 and page[end] == ">" else end + len(close)
            else:
                self.data("<")
                at += 1
        self.flush()

    def start(self, page: str, at: int) -> int:
        """The opening tag whose name begins at ``at``; where it ends."""
        name = _NAME.match(page, at)
        tag, at, said = name[0].lower(), name.end(), []
        while (end := _TAG_END.match(page, at)) is None:
            found = _ATTRIBUTE.match(page, at)
            if found is None or found.end() == len(page):
                return len(page)
            at = found.end()
            if found[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
                value = next((v for v in found.groups()[1:] if v is not None), None)
                if value:
                    said.append(_unescaped(value))
            elif found[0].endswith("=") and page[at : at + 1] in ('"', "'"):  # a value that is never closed
                return len(page)
        at = end.end()
        self.start_tag(tag, said)
        if "/" in end[0] and tag not in VOID:
            self.end_tag(tag)
        elif tag in _RAW:
            closing = _RAW[tag].search(page, at)
            return closing.start() if closing is not None else len(page)
        return at

    def flush(self):
        if self.run:
            self.at.children.append("".join(self.run))
            self.run = []

    def leave(self, node: Node | None):
        """Closes an open block, and the blocks inside it."""
        if node is None:
            return
        self.flush()
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.links = 0

    def nearest(self, tag: str) -> Node | None:
        """The innermost open block of that tag; looked for only where there is one."""
        if not self.open[tag]:
            return None
        node = self.at
        while node.tag != tag or node.parent is None:
            node = node.parent
        return node

    def hush(self, tag: str):
        self.silent.append(tag)
        self.held[tag] += 1
        self.tight += tag not in LOOSE

    def unhush(self):
        tag = self.silent.pop()
        self.held[tag] -= 1
        self.tight -= tag not in LOOSE

    def heard(self):
        """Nothing is silent any more."""
        self.silent.clear()
        self.held.clear()
        self.tight = 0

    def ended(self, tag: str, opens: bool):
        """Ends silent elements that ``tag`` cannot stand in, or that the block it closes holds."""
        if self.silent[0] == "head":
            inner = self.silent[-1]
            if tag == "body" or opens and tag not in IN_HEAD and (inner == "head" or inner == "noscript" and tag in BLOCKS):
                self.heard()
        elif not opens and tag in BLOCKS and not self.tight:
            # blocks opened inside the silent element close first
            if self.inside.get(tag):
                self.inside[tag] -= 1
                return
            if self.open[tag] or tag == self.root.tag:
                self.heard()
        elif opens and tag in BLOCKS and self.silent:
            self.inside[tag] = self.inside.get(tag, 0) + 1
        if not self.silent:
            self.inside.clear()

    def start_tag(self, tag: str, said: list[str]):
        if self.silent:
            self.ended(tag, True)
        if tag in SILENT:
            self.hush(tag)
        if self.silent or tag in ("html", "body") and self.at.parent is not None:
            return
        if tag in BLOCKS:
            if tag == "html":
                return
            self.leave(self.at.near[0])
            if tag in _CLOSES:
                self.leave(self.at.near[_CLOSES[tag]])
            self.flush()
            node = Node(tag, " ".join(said), self.at)
            self.at.children.append(node)
            self.at = node
            self.open[tag] += 1
            self.links = 0
        elif tag in ("br", "hr"):
            self.run.append(" ")
        else:
            self.at.tags += 1
            if tag == "a":
                self.links = 1

    def end_tag(self, tag: str):
        if self.silent:
            self.ended(tag, False)
        if self.silent:
            if self.held[tag]:
                while self.silent[-1] != tag:
                    self.unhush()
                self.unhush()
        elif tag == "a":
            self.links = 0
        elif tag in BLOCKS and tag not in ("html", "body"):
            self.leave(self.nearest(tag))

    def data(self, text: str):
        if self.silent == ["head"] and text.strip():
            self.heard()
        if not self.silent:
            self.run.append(text)
            if self.links:
                self.at.links += len(text.strip())


def parse(html: str) -> Node:
    tree = _Tree()
    tree.read(html)
    return tree.root


_TAG_GROUPS = ["p", "h1 h2 h3 h4 h5 h6 hgroup", "li ul ol menu dl dt dd", "nav", "header", "footer", "aside", "form fieldset legend", "article", "main", "section", "div center", "table tbody thead tfoot tr td th caption", "blockquote pre figure figcaption", "details summary dialog", "text"]
_GROUP_OF = {tag: i for i, tags in enumerate(_TAG_GROUPS) for tag in tags.split()}
_LETTERS = re.compile(r"[a-z]+")


@lru_cache(1 << 14)
def _tokens(attrs: str) -> tuple[int, ...]:
    """The buckets of the attribute tokens: letters between other characters or capitals, lower-cased."""
    words = _LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", attrs).lower())
    return tuple({zlib.crc32(token.encode()) % TOKENS for token in words})


_ONE_HOT = [tuple(float(i == g) for i in range(len(_TAG_GROUPS))) for g in range(len(_TAG_GROUPS))]
#: Tag groups that count as ancestors.
_HOSTS = 10


@lru_cache(1 << 14)
def _hosts(groups: int) -> tuple[float, ...]:
    return tuple(float(groups >> i & 1) for i in range(_HOSTS))


class Flat:
    """A tree as arrays in document order: parents, texts of the leaves, attribute tokens, features.

    ``odds``: each bucket's log-odds.
    """

    def __init__(self, root: Node, odds: list[float]):
        self.tokens: list[tuple[int, ...]] = []
        self.parent: list[int] = []
        self.text: list[str | None] = []
        tags: list[str] = []
        low, high, low_above, high_above, depth, own_links, own_tags, siblings = ([] for _ in range(8))
        stack: list[tuple[Node | str, int, int, int]] = [(root, -1, 0, 1)]
        while stack:
            node, parent, index, among = stack.pop()
            leaf = isinstance(node, str)
            text = " ".join(node.split()) if leaf else None
            if leaf and not text:
                continue
            k = len(self.parent)
            self.parent.append(parent)
            self.text.append(text)
            tags.append("text" if leaf else node.tag)
            own = () if leaf else _tokens(node.attrs)
            self.tokens.append(own)
            said = [odds[t] for t in own]
            low.append(min(said, default=0.0))
            high.append(max(said, default=0.0))
            low_above.append(min(low_above[parent], low[parent]) if parent >= 0 else 0.0)
            high_above.append(max(high_above[parent], high[parent]) if parent >= 0 else 0.0)
            depth.append(depth[parent] + 1 if parent >= 0 else 0)
            own_links.append(0 if leaf else node.links)
            own_tags.append(0 if leaf else node.tags)
            siblings.append((index, among))
            if not leaf:
                n = len(node.children)
                stack += [(c, k, i, n) for i, c in reversed(list(enumerate(node.children)))]
        n = len(self.parent)
        chars, links, words, nodes, inline, paragraphs, sentences = ([0] * n for _ in range(7))
        children: list[list[int]] = [[] for _ in range(n)]
        groups_above = [0] * n
        for k in range(n):
            p = self.parent[k]
            if p >= 0:
                children[p].append(k)
                groups_above[k] = groups_above[p] | 1 << _GROUP_OF.get(tags[p], 11)
        for k in range(n - 1, -1, -1):
            text = self.text[k]
            if text is not None:
                chars[k], words[k] = len(text), text.count(" ") + 1
                sentences[k] = text.count(".") + text.count("!") + text.count("?")
            links[k] += own_links[k]
            inline[k] += own_tags[k]
            nodes[k] += 1
            paragraphs[k] += tags[k] == "p"
            p = self.parent[k]
            if p >= 0:
                for total in (chars, links, words, nodes, inline, paragraphs, sentences):
                    total[p] += total[k]
        rows = []
        whole = max(1, chars[0]) if n else 1
        for k in range(n):
            p = self.parent[k]
            host = p if self.text[k] is not None and p >= 0 else k
            group = _GROUP_OF.get(tags[k], 11)
            index, among = siblings[k]
            row = [
                *_ONE_HOT[group], *_hosts(groups_above[k] & (1 << _HOSTS) - 1), low[host], high[host], low_above[host], high_above[host],
                depth[k], math.log1p(chars[k]), math.log1p(words[k]), min(1.0, links[host] / max(1, chars[host])), chars[k] / whole,
                math.log1p(chars[k] / max(1, nodes[k])), inline[k] / max(1, words[k]), paragraphs[k], sentences[k] / max(1, words[k]), chars[k] / max(1, words[k]),
                index, among, index / max(1, among), len(children[k]), chars[k] / max(1, chars[p]) if p >= 0 else 1.0, math.log1p(chars[p]) if p >= 0 else 0.0,
                links[p] / max(1, chars[p]) if p >= 0 else 0.0, paragraphs[p] if p >= 0 else 0,
            ]
            rows.append(row)
        self.x = np.array(rows, np.float32).reshape(n, -1)


# --- boosted trees -----------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss, on binned features.

    Each tree is grown on a share of the rows; the histograms of all features are one count.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        self.depth = depth
        self.cuts = []
        for column in x.T:
            values = np.unique(column)
            self.cuts.append(np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) > BINS else (values[:-1] + values[1:]) / 2)
        b = self._bins(x)
        n, width = b.shape
        sizes = np.array([len(c) + 1 for c in self.cuts])
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        feature_of = np.repeat(np.arange(width), sizes)
        last = np.zeros(total, bool)
        last[starts + sizes - 1] = True  # a cut behind the last bin parts nothing
        flat = b + starts
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        f, rng = np.full(n, self.start), np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # features and bins of the inner nodes, values of the leaves
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            seen = rng.random(n) < SHARE
            g, h, rows = np.where(seen, y - p, 0.0), np.where(seen, p * (1 - p), 0.0), np.flatnonzero(seen)
            feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, 255, np.int32)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                size = 2**level
                base = size - 1
                key = (flat[rows] + (at[rows, None] - base) * total).ravel()

                def left_and_whole(w):
                    bins = np.bincount(key, weights=np.repeat(w[rows], width), minlength=size * total).reshape(size, total)
                    left = bins.cumsum(axis=1)
                    return left - (left[:, starts] - bins[:, starts])[:, feature_of], bins[:, : sizes[0]].sum(axis=1, keepdims=True)

                (gl, gt), (hl, ht) = left_and_whole(g), left_and_whole(h)
                score = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                score = np.where((hl > 0.5) & (ht - hl > 0.5) & ~last, score, 0)
                best = score.argmax(axis=1)
                for k in np.flatnonzero(score.max(axis=1) > 1e-6).tolist():
                    feature[base + k], cut[base + k] = feature_of[best[k]], best[k] - starts[feature_of[best[k]]]
                at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**depth - 1)
            value = RATE * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        b, f, own = self._bins(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[own, feature[at]] > cut[at])
            f += value[at - (2**self.depth - 1)]
        return f


class Model(NamedTuple):
    odds: list[float]
    trees: Boosted


def decode(parent: list[int], logit: np.ndarray) -> list[bool]:
    """The likeliest labelling in which a kept node's parent is kept."""
    n = len(parent)
    # best sums of the subtree with the node dropped or kept
    gone, stay = (-np.logaddexp(0, logit)).tolist(), (-np.logaddexp(0, -logit)).tolist()
    for k in range(n - 1, 0, -1):
        gone[parent[k]] += gone[k]
        stay[parent[k]] += max(stay[k], gone[k])
    kept = [False] * n
    for k in range(n):
        kept[k] = stay[k] > gone[k] and (parent[k] < 0 or kept[parent[k]])
    return kept


# --- made-up pages to learn from -----------------------------------------------------


#: Attribute words of the made-up pages, by the part of a page that they are put on.
_SAID = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs tabs toolbar pager pagination toc sitemap links",
    "header": "header masthead topbar banner top branding logo",
    "footer": "footer copyright bottom legal colophon imprint",
    "side": "sidebar widget related recommended popular rail secondary complementary trending aside more",
    "notice": "cookie cookies consent notice newsletter popup alert subscribe gdpr modal overlay paywall disclaimer",
    "advert": "ad ads advert advertisement sponsored promo sponsor promotion adverts banner",
    "form": "form search login contact poll survey",
    "comments": "comments comment discussion responses replies thread feedback disqus",
    "social": "share social tags byline follow author meta sharing",
    "main": "article content post main body entry story text prose",
}


def made_page(rng: random.Random) -> tuple[str, list[str]]:
    """(html, main blocks): a page around an article, and the article's blocks."""
    stems = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiouéäñ") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    sentence = lambda a, b: " ".join(rng.choice(stems) for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "!", "?"])
    prose = lambda a, b: " ".join(sentence(1, 16) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{rng.choice(stems)}">{" ".join(rng.choice(stems) for _ in range(rng.randint(1, 3)))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9))) + "</ul>" if rng.random() < 0.7 else " ".join(link() for _ in range(rng.randint(3, 8)))

    def sure(kind):
        word = rng.choice(_SAID[kind].split())
        return rng.choice([f' class="{word}"', f' id="{word}"', f' class="site-{word}"', f' role="{word}"', f' class="{rng.choice(stems)} {word}"', f' id="{word}-{rng.choice(stems)}"'])

    def noise(kind):
        return rng.choice(["", sure(kind), f' class="{rng.choice(stems)}"', f' id="{rng.choice(stems)}-{rng.choice(stems)}"'])

    def boiler(kind):
        body = rng.choice([links, lambda: prose(1, 2), lambda: f"<p>{prose(1, 3)}</p>", lambda: sentence(1, 8)])
        if kind == "menu":
            return rng.choice([f"<nav{noise('menu')}>{links()}</nav>", f"<div{sure('menu')}>{links()}</div>", f"<ul{sure('menu')}>" + "".join(f"<li>{link()}" for _ in range(6)) + "</ul>"])
        if kind == "header":
            return rng.choice([f"<header{noise('header')}><p>{sentence(1, 5)}</p>{rng.choice([links(), ''])}</header>", f"<div{sure('header')}>{body()}</div>"])
        if kind == "footer":
            return rng.choice([f"<footer{noise('footer')}>&copy; {rng.choice(stems)}.com &middot; {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 2)}</p>{links()}</footer>", f"<div{sure('footer')}>{body()}</div>"])
        if kind == "side":
            return rng.choice([f"<aside{noise('side')}>{body()}</aside>", f"<div{sure('side')}><h3>{sentence(1, 3)}</h3>{body()}</div>"])
        if kind == "notice":
            return f"<div{sure('notice')}>{rng.choice([prose(1, 2), f'<p>{prose(1, 2)}</p><button>{sentence(1, 2)}</button>'])}</div>"
        if kind == "advert":
            tag = rng.choice(["div", "div", "section", "p", "ins"])
            return rng.choice(["", f"<!-- {sentence(1, 3)} -->"]) + f"<{tag}{sure('advert')}>{prose(1, 3)}</{tag}>"
        if kind == "form":
            return f"<form{noise('form')}><label>{sentence(1, 3)}</label><input type=text><p>{sentence(2, 7)}</p><select><option>{sentence(1, 2)}</select></form>"
        if kind == "comments":
            each = "".join(rng.choice(["<div{}><p>{}</p></div>", "<li{}>{}</li>", "<article{}><p>{}</p></article>"]).format(noise("comments"), prose(1, 4)) for _ in range(rng.randint(1, 6)))
            return f"<{(t := rng.choice(['section', 'div', 'ol']))}{sure('comments')}><h2>{sentence(1, 3)}</h2>{each}</{t}>"
        return f"<div{sure('social')}>{body()}</div>"

    kinds = ["menu", "header", "footer", "side", "notice", "advert", "form", "comments", "social"]
    blocks: list[str] = []

    def main_block(kind):
        if kind == "h":
            level, text = rng.choice([1, 1, 1, 2, 3, 4]), " ".join(sentence(1, 12) for _ in range(rng.choice([1, 1, 2])))
            text = rng.choice([text, text.rstrip(".!?"), text[: rng.randint(20, 80)].rstrip()])
            blocks.append(text)
            return f"<h{level}>{text}</h{level}>"
        if kind == "list":
            items = [prose(1, 2) for _ in range(rng.randint(2, 6))]
            blocks.extend(items)
            return "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
        if kind == "quote":
            blocks.append(text := prose(1, 3))
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind == "table":
            cells = [sentence(1, 3) for _ in range(4)]
            blocks.extend(cells)
            return f"<table><tr><td>{cells[0]}</td><td>{cells[1]}</td></tr><tr><td>{cells[2]}</td><td>{cells[3]}</td></tr></table>"
        if kind == "unclosed":  # omitted end tags, breaks inside
            one, two = prose(1, 3), rng.choice(["", sentence(1, 9)])
            blocks.append(f"{one} {two}".strip())
            tag = rng.choice(["b", "i", "em", "strong", "font", "span"])
            return rng.choice([f"<p>{one}<br>{two}", f"<p><{tag}>{one}<br>{two}", f"<p><{tag}>{one}</{tag}> {two}"])
        text = prose(1, 8) if rng.random() < 0.8 else sentence(1, 3)
        words = text.split()
        if rng.random() < 0.25:
            i = rng.randrange(len(words))
            marked = [*words[:i], f'<a href="#">{words[i]}</a>' if rng.random() < 0.5 else f"<em>{words[i]}</em>", *words[i + 1 :]]
        else:
            marked = words
        blocks.append(text)
        return ("<p>{}</p>" if rng.random() < 0.9 else "<div>{}</div>").format(" ".join(marked))

    parts = [main_block("h")] if rng.random() < 0.9 else []
    for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25])):
        parts.append(main_block(rng.choices(["p", "h", "list", "quote", "table", "unclosed"], [14, 1, 1, 1, 0.3, 2])[0]))
        if rng.random() < 0.06:
            parts.append(boiler(rng.choice(["advert", "side", "notice", "social"])))
    if rng.random() < 0.1:
        parts.append(boiler("comments"))
    inner = "".join(parts)
    wrap = rng.choice(["<article{}>{}</article>", "<article{}>{}</article>", "<main{}>{}</main>", "<div{}>{}</div>", "<section{}>{}</section>"])
    inner = wrap.format(sure("main") if wrap[1:4] in ("div", "sec") and rng.random() < 0.9 else noise("main"), inner)
    if rng.random() < 0.3:
        inner = rng.choice(["<main>{}</main>", '<div id="page">{}</div>', '<div class="container"><div class="row">{}</div></div>']).format(inner)
    before = "".join(boiler(k) for k in kinds if rng.random() < (0.7 if k in ("menu",) else 0.25) and k not in ("footer", "comments"))
    after = "".join(boiler(k) for k in kinds if rng.random() < (0.8 if k in ("footer",) else 0.2))
    head = f"<!DOCTYPE html><html><head><title>{sentence(1, 5)}</title><style>p{{margin:0}}</style><script>var t=1;</script></head><body>"
    return head + before + inner + after + rng.choice(["</body></html>", ""]), blocks


def _labels(flat: Flat, blocks: list[str]) -> np.ndarray:
    """1 for the leaves that hold the next main blocks in order, and for all nodes above them."""
    y, wanted = np.zeros(len(flat.parent)), [" ".join(b.split()) for b in blocks]
    at = 0
    for k, text in enumerate(flat.text):
        if text is not None and at < len(wanted) and text == wanted[at]:
            y[k] = 1
            at += 1
    for k in range(len(y) - 1, 0, -1):
        if y[k]:
            y[flat.parent[k]] = 1
    return y


def _odds(found: list[tuple[Flat, np.ndarray]]) -> list[float]:
    """Each bucket's log-odds of standing on a node of main text, against those of any node with attributes."""
    seen = np.full((2, TOKENS), SMOOTH)
    for flat, y in found:
        for own, kept in zip(flat.tokens, y):
            for t in own:
                seen[int(kept), t] += 1
    kept = seen[1].sum() / seen.sum()
    odds = np.log((seen[1] - SMOOTH + 2 * SMOOTH * kept) / (seen[0] - SMOOTH + 2 * SMOOTH * (1 - kept))) - np.log(kept / (1 - kept))
    return odds.tolist()


@cache
def model(pages: int = PAGES, seed: int = 11) -> Model:
    """Token odds and trees learned from made-up pages; the same for the same arguments."""
    rng, blank = random.Random(seed), [0.0] * TOKENS
    made = [made_page(rng) for _ in range(pages)]
    trees = [parse(html) for html, _ in made]
    half = pages // 2
    first = [Flat(t, blank) for t in trees[:half]]
    odds = _odds([(flat, _labels(flat, blocks)) for flat, (_, blocks) in zip(first, made)])
    flats = [Flat(t, odds) for t in trees[half:]]
    y = np.concatenate([_labels(flat, blocks) for flat, (_, blocks) in zip(flats, made[half:])])
    return Model(odds, Boosted(np.concatenate([f.x for f in flats]), y))


def main_texts(pages: list[str], own: Model) -> list[str]:
    """Each page's main text: its blocks in page order, joined by one space."""
    flats = [Flat(parse(html), own.odds) for html in pages]
    logits = np.split(own.trees.logit(np.concatenate([f.x for f in flats])), np.cumsum([len(f.parent) for f in flats])[:-1]) if flats else []
    out = []
    for flat, logit in zip(flats, logits):
        kept = decode(flat.parent, logit)
        out.append(" ".join(t for t, k in zip(flat.text, kept) if k and t))
    return out


def main_text(html: str, own: Model) -> str:
    return main_texts([html], own)[0]


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model())  # TREES trees of DEPTH levels, TOKENS numbers

    def run(batches):
        own = shared.value
        for batch in batches:
            found: list[str] = []
            for block in blocks([x or "" for x in batch.column(2).to_pylist()], BLOCK_CHARS):
                found += main_texts(block, own)
            yield arrow_rows(_SCHEMA, {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": [len(x) for x in found]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
