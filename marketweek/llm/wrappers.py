"""Main text of web pages by wrappers induced from the pages of a host."""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweek.llm.storage import ship, staged

#: Elements that make a block of their own; all others are part of their block's text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul button iframe noscript object "
    "svg template textarea canvas audio video math script style".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element ends these open ones.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}}
NEVER = set(
    "head script style noscript template nav footer aside form select button iframe svg menu dialog textarea "
    "object canvas audio video math".split()
)
#: Parts of class names and ids that mark what is not the article.
MARKS = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login search share sharing social comment comments disqus reply replies "
    "respond related recommended widget toolbar pagination pager".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
#: A slot is template when so many pages, and such a share of them, have its text; inside an
#: element that names itself the article a larger share is asked for.
PAGES, SHARE, ARTICLE_SHARE = 3, 0.5, 0.9
#: Pages that share more of their text with the reference than this are its copies: no evidence.
COPY = 0.9
#: Deeper elements hang side by side at this depth.
DEPTH = 128
#: Shapes and matches, and bytes of reference pages, that a worker remembers before it starts anew.
REMEMBERED, REFERENCE_BYTES = 400_000, 16_000_000
WORD = re.compile("[a-z0-9]+")


class Node:
    """A block element, or with ``text`` a piece of text in one."""

    __slots__ = ("label", "children", "text", "keep", "main")

    def __init__(self, label, keep=True, main=False, text=None):
        self.label, self.children, self.text, self.keep, self.main = label, [], text, keep, main


class TreeBuilder(HTMLParser):
    """Block tree of a page: inline elements vanish, white space is folded."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [("#root", self.root)]
        self.parts: list[str] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            top = self.open[-1][1]
            self.holder().children.append(Node("#text", top.keep, top.main, text))

    def holder(self) -> Node:
        """What the next node hangs on: the innermost open element, or the one at ``DEPTH``."""
        return self.open[min(len(self.open), DEPTH) - 1][1]

    def handle_starttag(self, tag, attrs):
        if tag not in BLOCKS:
            if tag == "br":
                self.parts.append(" ")
            return
        self.flush()
        names = [t for t, _ in self.open]
        closes = CLOSES.get(tag, set())
        # A paragraph ends before any block; list items, rows and cells end before the next.
        if "p" in names and tag not in ("button", "option"):
            closes = closes | {"p"}
        for k in range(len(names) - 1, 0, -1):
            if names[k] in closes:
                del self.open[k:]
                break
            if names[k] in STOPS.get(tag, ()):
                break
        above = self.open[-1][1]
        given = {k: (v or "") for k, v in attrs}
        words = set(WORD.findall((given.get("class", "") + " " + given.get("id", "")).lower()))
        role = given.get("role", "").lower()
        main = above.main or tag in ("article", "main") or role in ("main", "article")
        hidden = "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
        drop = tag in NEVER or role in ROLES or hidden or (tag == "header" and not above.main)
        if tag not in ("html", "body", "main"):
            marks = words & MARKS or (words & {"header"} and not above.main)
            drop = drop or bool(marks)
        node = Node(f"{tag}.{'.'.join(sorted(words))}", above.keep and not drop, main)
        self.holder().children.append(node)
        if tag not in VOID:
            self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in BLOCKS or tag in VOID:
            return
        self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.parts.append(data)


def parse(html: str | None) -> Node:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.root


def digest(node: Node):
    """The tree with hashes in place of texts, small enough to travel."""
    if node.text is not None:
        return ("#text", int.from_bytes(hashlib.blake2b(node.text.encode(), digest_size=8).digest(), "little"),
                len(node.text), node.main)
    return (node.label, [digest(c) for c in node.children])


class Matcher:
    """Simple tree matching: the largest order-preserving match of two trees with equal labels.

    Matches depend on the shapes of subtrees only, so each pair of shapes is matched once,
    however often it occurs on a page or on others. Equal shapes match whole.
    """

    def __init__(self):
        self.shapes: dict = {}
        self.labels: list = []
        self.inner: list = []
        self.nodes: list = []
        self.sizes: dict = {}
        self.matches: dict = {}

    def __len__(self) -> int:
        return len(self.shapes) + len(self.sizes) + sum(map(len, self.matches.values()))

    def shaped(self, tree, count=None) -> tuple:
        """``(shape, tree, number, children)``; texts are numbered in page order."""
        count = itertools.count() if count is None else count
        if tree[0] == "#text":
            children, key, number = (), ("#text", ()), next(count)
        else:
            children, number = [self.shaped(c, count) for c in tree[1]], -1
            key = (tree[0], tuple(c[0] for c in children))
        if key not in self.shapes:
            self.shapes[key] = len(self.labels)
            self.labels.append(key[0])
            self.inner.append(key[1])
            self.nodes.append(1 + sum(self.nodes[c] for c in key[1]))
        return self.shapes[key], tree, number, children

    def size(self, a: int, b: int) -> int:
        """Nodes in the largest match of two shapes."""
        if a == b:
            return self.nodes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        if (a, b) not in self.sizes:
            self.sizes[a, b] = 1 + self.best(self.inner[a], self.inner[b])
        return self.sizes[a, b]

    def best(self, x, y) -> int:
        """Nodes in the largest match of two lists; equal beginnings and ends match each other."""
        lo, total = 0, 0
        while lo < len(x) and lo < len(y) and x[lo] == y[lo]:
            total += self.nodes[x[lo]]
            lo += 1
        i, j = len(x), len(y)
        while i > lo and j > lo and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            total += self.nodes[x[i]]
        return total + (int(self.table(x[lo:i], y[lo:j])[-1, -1]) if i > lo and j > lo else 0)

    def table(self, x, y) -> np.ndarray:
        """Best matches of all beginnings of two lists of shapes."""
        best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        ys, place = np.unique(np.array(y, np.int64), return_inverse=True)
        for i, a in enumerate(x):
            weights = np.array([self.size(a, int(b)) for b in ys], np.int32)
            taken = best[i, :-1] + weights[place] if len(y) else best[i, :-1]
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], taken))
        return best

    def align(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs of matched children of two matched shapes, as indices."""
        if (a, b) in self.matches:
            return self.matches[a, b]
        x, y = self.inner[a], self.inner[b]
        i, j, pairs = len(x), len(y), []
        # Equal last children are part of a largest match; what they leave is searched.
        while i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        best = self.table(x[:i], y[:j]) if i and j else None
        while i and j:
            w = self.size(x[i - 1], y[j - 1])
            if w and best[i, j] == best[i - 1, j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
        self.matches[a, b] = pairs
        return pairs

    def slots(self, reference: tuple, tree: tuple) -> list[tuple[tuple, tuple]]:
        """Matched texts of two shaped trees, as pairs of shaped leaves."""
        out, work = [], [(reference, tree)]
        while work:
            a, b = work.pop()
            for i, j in self.align(a[0], b[0]):
                pair = a[3][i], b[3][j]
                (out if pair[0][2] >= 0 else work).append(pair)
        return out


class References:
    """A worker's matcher, and the reference pages it has read, forgotten when they grow large."""

    def __init__(self, entries: int = REMEMBERED, size: int = REFERENCE_BYTES):
        self.most, self.most_bytes = entries, size
        self.reset()

    def reset(self):
        self.matcher, self.known, self.bytes = Matcher(), {}, 0

    def get(self, packed: bytes) -> tuple:
        """What ``packed`` holds, its tree shaped: ``(shaped tree, constant slots)``."""
        if len(self.matcher) > self.most or self.bytes > self.most_bytes:
            self.reset()
        if packed not in self.known:
            tree, constant = pickle.loads(packed)
            self.known[packed] = self.matcher.shaped(tree), constant
            self.bytes += len(packed)
        return self.known[packed]


def votes(references: References, packed: bytes, tree) -> list[tuple[int, bool, bool]]:
    """``(slot, constant, in article)`` of one page; slot -1 says that the page took part."""
    reference, _ = references.get(packed)
    matcher = references.matcher
    pairs = [(a[2], a[1], b[1]) for a, b in matcher.slots(reference, matcher.shaped(tree))]
    total = sum(b[2] for _, _, b in pairs)
    same = sum(b[2] for _, a, b in pairs if a[1] == b[1])
    if total and same > COPY * total:
        return []
    return [(-1, False, False)] + [(n, True, bool(a[3])) for n, a, b in pairs if a[1] == b[1]]


def leaves(node: Node):
    if node.text is not None:
        yield node
    for c in node.children:
        yield from leaves(c)


def main_text(html: str | None, wrapper: bytes | None, references: References | None = None) -> str:
    """The page's blocks without template and without what its markup sets apart."""
    root = parse(html)
    texts = list(leaves(root))
    template = set()
    if wrapper is not None and texts:
        references = references or References()
        reference, constant = references.get(wrapper)
        if constant:
            tree = references.matcher.shaped(digest(root))
            template = {
                b[2] for a, b in references.matcher.slots(reference, tree) if a[2] in constant and a[1][1] == b[1][1]
            }
    kept = [(n, k) for k, n in enumerate(texts) if n.keep and k not in template]
    if any(n.main for n, _ in kept):
        kept = [(n, k) for n, k in kept if n.main]
    return "\n".join(n.text for n, _ in kept)


def wrapped(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: the host's reference page and its constant slots.

    The reference is the host's page with the smallest page_id. Every other page is aligned
    with it; equal texts in a slot are votes, added up per host and slot before the shuffle.
    """
    import pandas as pd

    def digests(frames):
        for frame in frames:
            yield frame[["host", "page_id"]].assign(tree=[pickle.dumps((digest(parse(h)), None)) for h in frame["html"]])

    trees = staged(
        pages.where("html is not null and host is not null").select("host", "page_id", "html")
        .mapInPandas(digests, "host string, page_id long, tree binary"), "trees",
    )
    references = staged(trees.groupBy("host").agg(F.min_by("tree", "page_id").alias("reference")), "references")

    def voted(frames):
        known = References()
        for frame in frames:
            rows = [
                (host, *vote)
                for host, tree, reference in zip(frame["host"], frame["tree"], frame["reference"])
                if tree != reference
                for vote in votes(known, reference, pickle.loads(tree)[0])
            ]
            yield pd.DataFrame(rows, columns=["host", "slot", "constant", "main"])

    counted = (
        trees.join(references, "host").select("host", "tree", "reference")
        .mapInPandas(voted, "host string, slot int, constant boolean, main boolean")
        .groupBy("host", "slot").agg(F.count("*").alias("n"), F.max("main").alias("main"))
    )
    # One row a text of the reference page: a host's list is as long as one page.
    lists = counted.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "main")).alias("slots"))

    def wrapper(frames):
        for frame in frames:
            out = []
            for reference, found in zip(frame["reference"], frame["slots"]):
                found = list(found) if found is not None else []
                pages_ = sum(s["n"] for s in found if s["slot"] < 0)
                constant = frozenset(
                    s["slot"] for s in found
                    if s["slot"] >= 0 and s["n"] >= PAGES and s["n"] >= (ARTICLE_SHARE if s["main"] else SHARE) * pages_
                )
                out.append(pickle.dumps((pickle.loads(reference)[0], constant)))
            yield frame[["host"]].assign(wrapper=out)

    return references.join(lists, "host", "left").mapInPandas(wrapper, "host string, wrapper binary")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page.

    Texts in slots that are constant over the pages of a host are template; varying ones are
    content unless their element says otherwise (menus, forms, adverts, comments and the like,
    by tag, role, class or id); where an element names itself the article, only its texts
    count. A host with too few pages to tell is judged by its elements alone.

    A null or empty html gives an empty text; pages without url have no wrapper; repeated rows
    stay; broken markup is read as it comes; an empty table gives no rows; other columns are
    ignored.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host.alias("host"),
    )
    joined = rows.join(staged(wrapped(rows), "wrappers"), "host", "left")

    def run(frames):
        known = References()
        for frame in frames:
            texts = [main_text(h, w, known) for h, w in zip(frame["html"], frame["wrapper"])]
            yield frame[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    return joined.select("page_id", "url", "html", "wrapper").mapInPandas(
        run, "page_id long, url string, text string, n_chars long"
    )
