"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

A page becomes a tree of block-level nodes. Features describe each node: what its tag and its class, id and role
tokens (and those of its ancestors) stand for, depth, density of text and of links in its subtree, its place and share
among its siblings. The trees give each node a probability to be part of the article. Decoding picks, over the
whole tree, the likeliest assignment in which a node is article (then all below it is), boilerplate (then all below it
is) or mixed (its children decide), so no node contradicts an ancestor or a descendant.

The trees are trained here on page layouts that `layouts` composes with known labels.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .shared import map_texts, read

#: Elements of HTML by their role in the flow.
BLOCKS = set("address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript object ol p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, so nothing in it is a node; of the first two a missing end tag is the page's end.
RAW = set("script style title iframe noembed noframes xmp textarea".split())
UNSEEN = RAW | {"template", "svg"}
#: An open element that the start of another one ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: What the tokens of tags, classes, ids and roles stand for.
MEANINGS = {
    "article": "article content main post entry story prose articlebody maincontent bodytext",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs tabs toc pagination pager sitemap links toolbar skip",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer copyright colophon contentinfo legal bottom imprint",
    "side": "aside sidebar widget related recommended complementary trending popular rail more",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense dfp commercial",
    "comment": "comment comments reply replies disqus discussion respond commentlist feedback",
    "form": "form login signup subscribe newsletter search searchform register fieldset button input select",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog warning banner disclaimer paywall noscript",
    "share": "share social sharing follow tags tag meta byline buttons",
}
MEANS: dict[str, list[int]] = {}
for _i, _words in enumerate(MEANINGS.values()):
    for _w in _words.split():
        MEANS.setdefault(_w, []).append(_i)
KINDS = ("p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu li dt dd", "table tbody thead tfoot tr td th caption", "div section", "blockquote pre figure figcaption", "body html main article")
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}

#: A comment, a tag (slash, name, attributes: a quote counts only at the start of a value) or another declaration; what the page's end cuts off is one, too.
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")
END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in UNSEEN}


class Node:
    __slots__ = ("ancestors", "children", "depth", "links", "mark", "meaning", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.ancestors = (parent.ancestors | parent.meaning) if parent else 0
        self.parts: list[str | Node | None] = []  # texts, block nodes and breaks in page order
        self.children: list[Node] = []
        self.links = 0
        words = [tag]
        if attributes:
            for found in ATTRIBUTE.findall(attributes):
                words += TOKEN.findall("".join(found).lower())
        self.mark = attributes[-1:] if attributes.endswith((" data-y", " data-o")) else ""  # a training page's label
        self.meaning = 0
        for w in words:
            for m in MEANS.get(w, ()):
                self.meaning |= 1 << m
        if parent:
            parent.parts.append(self)
            parent.children.append(self)


def parse(source: str) -> list[Node]:
    """The block-level nodes of a page in page order; the first is the root. Never fails: stray tags are passed over.

    Linear in the page: every open tag is closed once, and a stray end tag is told by the number of its open tags.
    """
    root = Node("html", None, "")
    nodes, node, at, link = [root], root, 0, 0
    open_tags: list[tuple[str, Node]] = [("html", root)]
    open_blocks, count = [0], Counter()  # positions of block elements in open_tags; open tags by name
    missing: set[str] = set()  # elements without any further end tag

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            node.parts.append(html.unescape(piece) if "&" in piece else piece)
            if link:
                node.links += b - a

    def close(to: int) -> None:
        nonlocal node, link
        for tag, _ in open_tags[to:]:
            link -= tag == "a"
            count[tag] -= 1
        del open_tags[to:]
        while open_blocks[-1] >= to:
            open_blocks.pop()
        node = open_tags[-1][1]

    def end_of(tag: str, start: int) -> int | None:
        if tag in missing:
            return None
        if found := END_OF[tag].search(source, start):
            return found.end()
        missing.add(tag)
        return None

    while found := TAG.search(source, at):
        text(at, found.start())
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if count[tag]:
                close(next(i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i][0] == tag))
            continue
        if tag in UNSEEN:
            if tag not in RAW and found[3].endswith("/"):
                continue
            end = end_of(tag, at)
            at = end if end is not None else len(source) if tag in ("script", "style") else at
            continue
        if tag == "br":
            node.parts.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in BLOCKS:
            ended = ENDS.get(tag, ())
            while (i := open_blocks[-1]) and (open_tags[i][0] in ended or (open_tags[i][0] == "p" and tag != "button")):
                name = open_tags[i][0]
                close(i)
                if name == "p" and not ended:
                    break
            if tag == "hr":
                node.parts.append(None)
                continue
            if tag in ("html", "body") and node is root:
                continue
            node = Node(tag, node, found[3])
            nodes.append(node)
            open_blocks.append(len(open_tags))
        link += tag == "a"
        count[tag] += 1
        open_tags.append((tag, node))
    text(at, len(source))
    return nodes


MEANING_BITS, KIND_BITS = np.arange(len(MEANINGS)), np.arange(len(KINDS))


def parents(nodes: list[Node]) -> np.ndarray:
    """Each node's parent by number; the root's is itself."""
    number = {id(v): i for i, v in enumerate(nodes)}
    return np.array([number[id(v.parent)] if v.parent else 0 for v in nodes])


def features(nodes: list[Node], up: np.ndarray) -> np.ndarray:
    n, up_list = len(nodes), up.tolist()
    characters, links, words, stops, size, blocks = ([0] * n for _ in range(6))
    own, same, order = [], {}, {}
    for i, v in enumerate(nodes):
        text = " ".join([p for p in v.parts if p.__class__ is str])
        split = text.split()
        own.append(len("".join(split)))
        characters[i], links[i], words[i], size[i], blocks[i] = own[i], v.links, len(split), 1, own[i] > 0
        stops[i] = text.count(".") + text.count("!") + text.count("?")
        key = (up_list[i], v.tag)
        order[i] = key
        same[key] = same.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        j = up_list[i]
        for sums in (characters, links, words, stops, size, blocks):
            sums[j] += sums[i]
    meaning, above = np.array([v.meaning for v in nodes]), np.array([v.ancestors for v in nodes])
    kind = np.array([KIND.get(v.tag, -1) for v in nodes])
    chars, size_, before = np.array(characters, float), np.array(size, float), np.cumsum([0, *own[:-1]])
    whole, siblings = max(1.0, chars[0]), np.array([max(1, len(nodes[j].children)) for j in up_list], float)
    numbers = np.stack([
        np.array([v.depth for v in nodes]), np.log1p(chars), np.log1p(own), np.minimum(1, links / np.maximum(1, chars)), chars / size_, words / np.maximum(1, blocks), stops / np.maximum(1, words), np.log1p(size_),
        chars / whole, chars / np.maximum(1, chars[up]), siblings, np.array([same[order[i]] for i in range(n)]) / siblings, before / whole, np.maximum(0, 1 - (before + chars) / whole),
    ], axis=1)
    return np.concatenate([meaning[:, None] >> MEANING_BITS & 1, above[:, None] >> MEANING_BITS & 1, kind[:, None] == KIND_BITS, numbers], axis=1)


def decode(up: np.ndarray, p: np.ndarray) -> list[bool]:
    """Whether each node's own text is article, in the likeliest assignment without contradictions."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    parent, article, other = up.tolist(), np.log(p).tolist(), np.log(1 - p).tolist()
    # A mixed node's own text goes by its own probability; mixing has its price, but for the root.
    mixed = [max(a, o) - 1.5 * (i > 0) for i, (a, o) in enumerate(zip(article, other, strict=True))]
    for i in range(len(parent) - 1, 0, -1):
        j = parent[i]
        article[j] += article[i]
        other[j] += other[i]
        mixed[j] += max(article[i], other[i], mixed[i])
    state: list[int] = []  # 0 boilerplate, 1 article, 2 mixed
    for i, best in enumerate(zip(other, article, mixed, strict=True)):
        above = state[parent[i]] if i else 2
        state.append(above if above != 2 else best.index(max(best)))
    return [s == 1 or (s == 2 and q > 0.5) for s, q in zip(state, p.tolist(), strict=True)]


def blocks_of(node: Node, kept: dict[int, bool]) -> str:
    """The kept blocks in page order, each with single spaces, joined by two line ends."""
    found: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(buffer).split()):
            found.append(text)
        buffer.clear()

    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        v, i = stack.pop()
        take = kept[id(v)]
        while i < len(v.parts):
            part = v.parts[i]
            i += 1
            if isinstance(part, str):
                if take:
                    buffer.append(part)
            else:
                flush()
                if part is not None:
                    stack += [(v, i), (part, 0)]
                    break
        else:
            flush()
    return "\n\n".join(found)


@functools.lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 7, families: tuple[str, ...] | None = None) -> boosting.Trees:
    """Trees from `pages` composed layouts (of all families, or those named)."""
    from .layouts import examples

    x, y = [], []
    for source, labels in examples(pages, seed, families):
        nodes = parse(source)
        known = labels(nodes)
        use = [i for i, v in enumerate(known) if v is not None]
        x.append(features(nodes, parents(nodes))[use])
        y += [known[i] for i in use]
    return boosting.train(np.concatenate(x), np.array(y, float))


def main_texts(sources: list[str], trees: boosting.Trees) -> list[str]:
    """The main text of each page; the nodes of all pages are judged at once."""
    parsed = [parse(s) for s in sources]
    if not parsed:
        return []
    ups = [parents(nodes) for nodes in parsed]
    p = trees.probability(np.concatenate([features(nodes, up) for nodes, up in zip(parsed, ups, strict=True)]))
    out, at = [], 0
    for nodes, up in zip(parsed, ups, strict=True):
        kept = decode(up, p[at : at + len(nodes)])
        at += len(nodes)
        out.append(blocks_of(nodes[0], {id(v): k for v, k in zip(nodes, kept, strict=True)}))
    return out


def extract(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: boosting.Trees | None = None) -> DataFrame:
    """`keep` and text (the main text, empty if none) for every row.

    Null and empty html have an empty text; bytes that aren't UTF-8 count as U+FFFD. Repeated rows are extracted each; an empty table gives an empty result;
    a kept column named text gives way to the result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or trained())

    def start():
        trees = shared.value

        def work(found):
            out: list[str] = []
            for at in range(0, len(found), 64):
                out += main_texts([(t or b"").decode() for t in found[at : at + 64]], trees)
            return [out]

        return work

    return map_texts(pages, source, keep, T.StructType([T.StructField("text", T.StringType())]), start)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
