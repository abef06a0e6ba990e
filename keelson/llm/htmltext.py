"""Main text of web pages by a site style tree.

The DOMs of a host's different pages are merged into one tree, whose nodes are
paths of tag, class and id (copies of a page count once, else they would make
its article template; digits in names, and numbers in texts, count as 0). A node that bears text holds, over
those pages,

* its presentations: the sequences of tags below it,
* its contents: the words on each page that are not links; of a page's marked
  articles, which together are one node, the whole text.

Each has an entropy-based importance to the base of the number of pages: 0 if
all pages agree, 1 if all differ; words count by the pages they are on. A
node's importance is 0.8 times that of its contents and 0.2 times that of its
presentations, so a menu, whose words are all links, has hardly any. Element
names are features of the nodes: an element named like an advert or sidebar
needs half of its host's weight to be kept, and beside a marked article (or
main element) a node must weigh more than the article does, weight being
importance times words. Nodes of low importance are removed from every page,
and so are text blocks that half of a host's pages, and ``LEAST`` at least,
carry outside articles.

Nodes on fewer than ``LEAST`` different pages of their host are judged by what
the hosts' trees say of their kind (tag and name); where no tree says anything,
as on a single page, names and marks decide. Inside a marked article no node
is judged by importance: only what elements declare themselves to be (nav,
aside, form, script, a class that is an advert's, ...) goes. Nor is anything
removed that holds a marked article.

The merged tree is never in one place: counts by (host, node, value) are
pre-aggregated, so a host with a third of all pages is no hot spot.

Defined results: null html or a page without text gives an empty text, an
empty table an empty one; a null URL counts as the host ''; repeated rows have
equal texts; columns beyond id, URL and html do not matter, whatever their
names; what ties the article's weight goes. Pages are parsed as browsers do, in
one pass: quotes in attribute names are part of them, unclosed elements and
comments end with the page, and a tag that never ends is no text.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, Workspace, table
from .urlfilter import host_path
from .words import digests, hash_words, signed

#: Trees of all hosts up to this stored size go to every worker; beyond it a host's tree precedes its pages, dealt by salts.
BROADCAST_BYTES, SALTS = 8 << 20, 64
#: A node is judged by its host's tree if so many of the host's different pages have it.
LEAST = 3
IMPORTANCE, BLOCK_SHARE, CONTENT = 0.2, 0.5, 0.8
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>\"'][^\s>]*+)?))?)")
DIGITS, NUMBER = re.compile(r"\d+"), re.compile(r"\b\d+\b")
BROKEN = re.compile(r"--!?>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never part of a page's text.
GONE_TAGS = frozenset("head form script style textarea title noscript template iframe svg button select dialog object canvas audio video".split())
#: Elements that are named by their tag; a header is, outside articles.
NAMED_TAGS = frozenset("nav footer aside menu".split())
#: Whole class or id names of adverts, which go from articles too.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising ad-banner ad-container ad-slot sponsored".split())
#: Whole names of containers that are no part of an article.
CONTAINERS = frozenset("comments comment-list comments-area respond menu navbar nav navigation sidebar side-bar cookie cookies cookie-notice cookie-banner cookie-consent notice notices disqus newsletter".split())
#: Names of lists of comments, whatever site they are made for.
COMMENTS = re.compile(r"(?:(?!has|no|with|without|show|hide)[a-z]+[-_])*(?:comments|commentlist|comment[-_](?:list|section|thread|stream|wrapper|box)|responses)(?:[-_](?:list|area|section|wrapper|container|block|thread))?")
#: Whole names that mark no article where nothing else is known.
OUTSIDE = frozenset("banner breadcrumb breadcrumbs comment consent copyright footer gdpr header login main-menu main-nav masthead modal page-footer page-header pagination paywall popup promo related reply search share sharing signup site-footer site-header site-nav social sponsor subscribe subscription toolbar topbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
HOLDERS = frozenset("div section ul ol dl table details".split())
#: What an opening tag ends, as HTML lets end tags be left out.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table article section div main body html".split())
KINDS = frozenset("html body div p section ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 header blockquote pre main article figure figcaption span".split())
OFF, FREE, NEAR, IN = range(4)
#: The node of all marked articles of a page.
ARTICLE = 1
MASK = (1 << 63) - 1


class Node:
    __slots__ = ("tag", "path", "kind", "own", "name", "gone", "children", "parent", "open", "depth", "p", "items", "holds", "link", "section", "side", "main")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.open, self.holds, self.gone, self.own, self.kind = True, False, False, "", ""
        if parent is None:
            self.path, self.depth, self.p, self.items, self.link, self.name, self.section, self.side, self.main = 0, 0, None, {}, False, "", "", False, False
            return
        self.depth = parent.depth + 1
        #: The p element that a block would close, and the open list or table items of the scope.
        self.p = self if tag == "p" else parent.p if tag in INLINE else None
        self.items = {} if tag in SCOPES else parent.items
        self.link = parent.link or tag == "a"
        self.section = tag if tag in ("article", "main", "section", "body") else parent.section
        self.side = parent.side or tag in NAMED_TAGS
        self.main = parent.main or tag == "main"
        self.path, self.name = parent.path, parent.name


def named(label: str) -> int:
    return int.from_bytes(digests([DIGITS.sub("0", label).encode("utf-8", "surrogatepass")])[0, 0].tobytes(), "little") & MASK


#: Hashes of labels and kinds.
LABELS = Cache(named, 1 << 15)


def _label(node: Node, attributes: dict[str, str]) -> None:
    """Sets path, kind and names of an element that is not inline."""
    tag, label, name = node.tag, node.tag, ""
    if attributes:
        label += "".join(f".{k}={attributes[k]}" for k in ("class", "id", "role") if k in attributes)
        words = [w.lower() for k in ("class", "id") for w in attributes.get(k, "").split()]
        name = next((w for names in (ADVERTS, CONTAINERS, OUTSIDE) for w in words if w in names), "") or ("comments" if any(map(COMMENTS.fullmatch, words)) else "") or next((r for r in attributes.get("role", "").lower().split() if r in ROLES), "")
    if tag in NAMED_TAGS or tag == "header" and node.parent.section not in ("article", "main"):
        name = tag
    node.own, node.gone = name, tag in GONE_TAGS
    # what holds a name gives it to all below, up to an article
    node.name = "" if tag in ("html", "body", "main", "article") else name or node.name
    node.kind = f"{tag if tag in KINDS else '?'}.{node.name}"
    x = (node.parent.path * 0x9E3779B97F4A7C15 ^ LABELS[label]) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    node.path = (x ^ x >> 29) & MASK


def parse(source: str | None) -> Node:
    """A DOM that is good enough for text, in one pass; never fails, closes what was left open."""
    top = at = Node("", None)
    if not source:
        return top
    pos, size, open_tags = 0, len(source), {}
    text = 0
    while (lt := source.find("<", pos)) >= 0:
        after = source[lt + 1 : lt + 2]
        closing = after == "/"
        m = NAME.match(source, lt + 1 + closing)
        if m is None:
            if after == "!" or after == "?" or closing:
                if lt > text:
                    at.children.append(source[text:lt])
                if source.startswith("<!--", lt):
                    # <!--> and <!---> are comments too
                    end = BROKEN.search(source, lt + 2)
                    pos = end.end() if end else size
                else:
                    end = source.find(">", lt)
                    pos = end + 1 if end >= 0 else size
                text = pos
            else:
                pos = lt + 1
            continue
        if lt > text:
            at.children.append(source[text:lt])
        tag, pos, attributes, slash = m[0].lower(), m.end(), {}, False
        while not (bare := source.startswith(">", pos)):
            a = ATTRIBUTE.match(source, pos)
            if a is None or a[4] == "" or a[6] == "":
                # the page ends within the tag
                return top
            pos = a.end()
            if a[1]:
                slash = source[pos - 2] == "/"
                break
            key = a[2].lower()
            if key in ("class", "id", "role") and key not in attributes:
                attributes[key] = entities.unescape(a[3] or a[5] or a[7] or "")
        if bare:
            pos += 1
        text = pos
        if closing:
            if open_tags.get(tag):
                node = at
                while node.tag != tag:
                    open_tags[node.tag] -= 1
                    node.open = False
                    node = node.parent
                open_tags[tag] -= 1
                node.open = False
                at = node.parent
            elif tag == "p":
                _label(node := Node("p", at), {})
                at.children.append(node)
            continue
        if tag in CLOSES_P and at.p is not None and at.p.open:
            at = _shut(at, at.p, open_tags)
        if ends := IMPLIED.get(tag):
            hits = [n for t in ends if (n := at.items.get(t)) is not None and n.open and n.items is at.items]
            if hits:
                at = _shut(at, min(hits, key=lambda n: n.depth), open_tags)
        node = Node(tag, at)
        if tag not in INLINE:
            _label(node, attributes)
        at.children.append(node)
        if tag in RAW and not slash:
            end = RAW_END[tag].search(source, pos)
            if end is None:
                return top
            pos = source.find(">", end.end())
            pos = pos + 1 if pos >= 0 else size
            text = pos
        elif tag not in VOID and not (slash and tag == "svg"):
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in IMPLIED:
                known = node.items.get(tag)
                if known is None or not known.open:
                    node.items[tag] = node
            at = node
    if text < size:
        at.children.append(source[text:])
    return top


def _shut(at: Node, upto: Node, open_tags: dict[str, int]) -> Node:
    while True:
        open_tags[at.tag] -= 1
        at.open = False
        if at is upto:
            return at.parent
        at = at.parent


def marks(top: Node) -> tuple[list[Node], bool]:
    """Outermost main elements, else articles, and whether there is any; marks all that hold one."""
    found: dict[str, list[Node]] = {"main": [], "article": []}
    for tag, hits in found.items():
        stack = [top]
        while stack:
            node = stack.pop()
            if node.tag == tag and (node.children or tag == "article"):
                hits.append(node)
            else:
                stack.extend(c for c in node.children if not isinstance(c, str) and (not node.gone or tag == "article"))
    roots = found["main"] or [a for a in found["article"] if not a.side]
    for node in [*roots, *(a for a in found["article"] if not found["main"] or a.main)]:
        above = node.parent
        while above is not None and not above.holds:
            above.holds = True
            above = above.parent
    return roots, bool(roots)


@dataclass(frozen=True)
class Tree:
    """What the merged trees say for the pages of a host."""

    low: frozenset[int] = frozenset()
    off: frozenset[int] = frozenset()
    spared: frozenset[int] = frozenset()
    blocks: frozenset[int] = frozenset()
    kinds_low: frozenset[str] = frozenset()
    kinds_off: frozenset[str] = frozenset()
    kinds_spared: frozenset[str] = frozenset()

    def keeps(self, node: Node, zone: int, names: bool) -> bool:
        """Whether text right below a node stays, outside marked articles."""
        if node.path in self.low or zone == OFF and node.path in self.off:
            return False
        if node.path in self.spared:
            return True
        if node.kind in self.kinds_low or zone == OFF and node.kind in self.kinds_off:
            return False
        return node.kind in self.kinds_spared or not names or not (node.name or zone == OFF)


def declared(node: Node) -> bool:
    """Whether an element within an article says that it is no part of it."""
    return node.tag in NAMED_TAGS or node.own in ADVERTS or node.tag in HOLDERS and node.own in CONTAINERS


def units(top: Node, names: bool = True):
    """(node, zone, words, link words) of each text block in page order, less what HTML says is no text."""
    roots, marked = marks(top)
    mains = {id(r) for r in roots}
    line: list[str] = []
    links = 0
    stack: list = [(iter((top,)), OFF if marked else FREE, top, top)]
    while stack:
        children, zone, owner, parent = stack[-1]
        child = next(children, None)
        if isinstance(child, str):
            line.append(child)
            if parent.link:
                links += len(entities.unescape(child).split())
            continue
        if child is None:
            stack.pop()
        elif child.tag == "br":
            line.append(" ")
            continue
        if line and (child if child is not None else parent).tag not in INLINE:
            if words := entities.unescape("".join(line)).split():
                yield owner, zone, words, links
            line, links = [], 0
        if child is None or child.gone and not child.holds:
            continue
        if id(child) in mains:
            zone = NEAR if child.tag == "main" and child.holds else IN
        elif zone == NEAR and child.tag == "article":
            zone = IN
        elif zone == IN and names and not child.holds and declared(child):
            continue
        stack.append((iter(child.children), zone, owner if child.tag in INLINE else child, child))


def main_text(source: str | None, tree: Tree = Tree(), names: bool = True) -> str:
    """The text of a page as its tree sees it; ``names`` lets names and marks decide where the tree has no say."""
    out = []
    for node, zone, words, _ in units(parse(source), names):
        block = " ".join(words)
        if zone == IN or tree.keeps(node, zone, names) and not (zone != OFF and tree.blocks and block_digest(block) in tree.blocks):
            out.append(block)
    return " ".join(out)


def block_digest(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw)


def observe(pages: list[tuple[str, str | None, float]]) -> tuple[list, ...]:
    """Columns host, node, kind, what, value, n: what some pages tell of their hosts' trees.

    ``what`` is s (presentation), w (a word's or an article's pages), v (words,
    value 1 off an article), b (a block's pages) or p (pages, value 1 if marked).
    A page has a weight, that of copies being one together.
    """
    counts: dict[tuple, float] = {}
    texts: list[str] = []
    owners: list[int] = []
    keys: dict[tuple, int] = {}
    page_of: list[int] = []

    def add(*key):
        counts[key[:-1]] = counts.get(key[:-1], 0) + key[-1]

    for number, (host, source, weight) in enumerate(pages):
        article: list[str] = []
        style: dict[tuple[int, str], list[str]] = {}
        blocks: set[int] = set()
        zones = set()
        for node, zone, words, links in units(parse(source)):
            zones.add(zone)
            inside = zone == IN
            key = (host, ARTICLE, "") if inside else (host, node.path, node.kind)
            style.setdefault(key[1:], []).append(node.tag + "".join(c.tag for c in node.children if not isinstance(c, str)))
            own = max(0, len(words) - links)
            add(*key, "v", int(zone == OFF), own * weight)
            if inside:
                article += words
            elif own:
                texts.append(NUMBER.sub("0", " ".join(words)))
                owners.append(keys.setdefault(key, len(keys)))
                page_of.append(number)
            if zone in (FREE, NEAR):
                blocks.add(block_digest(" ".join(words)))
        for (path, kind), tags in style.items():
            add(host, path, kind, "s", zlib.crc32("|".join(tags).encode()), weight)
        if article:
            add(host, ARTICLE, "", "w", block_digest(" ".join(article)), weight)
        for b in blocks:
            add(host, 0, "", "b", b, weight)
        add(host, 0, "", "p", int(OFF in zones or IN in zones), weight)
    columns = tuple(list(c) for c in zip(*counts, strict=True)) if counts else ([], [], [], [], [])
    columns = (*columns, list(counts.values()))
    if texts:
        hashed, ends = hash_words(texts)
        hashed = hashed[:, 0]
        place = np.repeat(np.arange(len(texts)), np.diff(ends))
        values, word = np.unique(hashed, return_inverse=True)
        n = len(values)
        # once for a page and node, then counted over pages
        once = np.unique((np.array(page_of)[place] * len(keys) + np.array(owners)[place]) * n + word)
        pairs, of = np.unique(once // n % len(keys) * n + once % n, return_inverse=True)
        pages_with = np.bincount(of, np.array([w for *_, w in pages])[once // n // len(keys)])
        names = list(keys)
        for i, column in enumerate(columns[:3]):
            column += [names[k][i] for k in (pairs // n).tolist()]
        columns[3].extend("w" * len(pairs))
        columns[4].extend(signed(values[pairs % n]).tolist())
        columns[5].extend(pages_with.tolist())
    return columns


def style_tree(pages: DataFrame, host_col: str, html_col: str, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """(host, low, off, spared, blocks) of every host, and (kind, low, off, spared) over all hosts."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(observe(rows[lo : lo + 256]), kinds, strict=True)], ["host", "node", "kind", "what", "value", "n"])

    # copies of a page count as one page; only those that have any are looked up
    digest = F.unhex(F.md5(F.coalesce(F.col(html_col), F.lit(""))))
    copies = space.keep(pages.groupBy(F.col(host_col).alias("_h"), digest.alias("_d")).agg(F.count("*").alias("_copies")).filter("_copies > 1"), "copies")
    if space.stored_bytes("copies") <= BROADCAST_BYTES:
        # checked size: no page is shuffled
        copies = F.broadcast(copies)
    weighted = pages.join(copies, (F.col(host_col) == F.col("_h")) & (digest == F.col("_d")), "left").select(host_col, html_col, (1 / F.coalesce("_copies", F.lit(1))).alias("weight"))
    counted = weighted.mapInArrow(run, "host string, node long, kind string, what string, value long, n double").groupBy("host", "node", "kind", "what", "value").agg(F.round(F.sum("n"), 6).alias("n"))
    counted = space.keep(counted, "counted")
    n, what = F.col("n"), F.col("what")
    only = lambda w, x: F.coalesce(F.sum(F.when(what == w, x)), F.lit(0.0))
    sums = {"pages": only("s", n), "_sln": only("s", n * F.ln(n)), "_words": only("w", n), "_wln": only("w", n * F.ln(n)), "volume": only("v", n), "off_volume": only("v", n * F.col("value"))}
    merged = counted.filter(what.isin("s", "w", "v")).groupBy("host", "node", "kind").agg(*(e.alias(c) for c, e in sums.items())).filter(F.col("pages") > LEAST - 0.5)
    content = F.when(F.col("_words") > 0, 1 - F.col("_wln") / (F.col("_words") * F.ln("pages"))).otherwise(0.0)
    style = 1 - F.col("_sln") / (F.col("pages") * F.ln("pages"))
    judged = merged.select("host", "node", "kind", "volume", "off_volume", (CONTENT * content + (1 - CONTENT) * style).alias("importance"), (~F.col("kind").endswith(".")).alias("named"))
    weight = F.col("importance") * F.col("volume")
    judged = space.keep(judged.withColumn("weight", weight), "judged")
    totals = judged.groupBy("host").agg(F.sum("weight").alias("_all"), F.sum(F.when(F.col("node") == ARTICLE, F.col("weight"))).alias("_article"))
    verdict = judged.filter(F.col("node") != ARTICLE).join(totals, "host").withColumns({"low": (F.col("importance") < IMPORTANCE) | F.col("named") & (F.col("weight") < 0.5 * F.col("_all")), "off": (F.col("off_volume") > 0) & (F.col("weight") <= F.coalesce("_article", F.lit(0.0)))})
    # of kinds the trees of all hosts together decide: there are few, whatever the hosts
    pool_all = judged.agg(F.sum("weight").alias("_all"), F.sum(F.when(F.col("node") == ARTICLE, F.col("weight"))).alias("_article"))
    kinds = judged.filter(F.col("node") != ARTICLE).groupBy("kind", "named").agg(F.sum("weight").alias("weight"), F.sum("volume").alias("volume"), F.sum("off_volume").alias("off_volume")).crossJoin(F.broadcast(pool_all))
    share = F.coalesce(F.try_divide("weight", "volume"), F.lit(0.0))
    kinds = kinds.select("kind", (F.col("named") & ((share < IMPORTANCE) | (F.col("weight") < 0.5 * F.col("_all")))).alias("low"), ((F.col("off_volume") > 0) & (F.col("weight") <= F.coalesce("_article", F.lit(0.0)))).alias("off"), "named", "off_volume").withColumn("spared", (F.col("named") | (F.col("off_volume") > 0)) & ~F.col("low") & ~F.col("off"))
    nodes = verdict.groupBy("host").agg(*(F.collect_set(F.when(c, F.col("node"))).alias(name) for name, c in (("low", F.col("low")), ("off", F.col("off") & ~F.col("low")), ("spared", (F.col("named") | (F.col("off_volume") > 0)) & ~F.col("low") & ~F.col("off")))))
    carried = counted.filter(what == "b").select("host", "value", n.alias("_n"))
    size = counted.filter(what == "p").groupBy("host").agg(F.sum(n).alias("_pages"))
    common = carried.join(size, "host").filter((F.col("_pages") > LEAST - 0.5) & (F.col("_n") > LEAST - 0.5) & (F.col("_n") >= BLOCK_SHARE * F.col("_pages"))).groupBy("host").agg(F.collect_set("value").alias("blocks"))
    return nodes.join(common, "host", "full"), kinds


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of each page."""
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    source = source.withColumn("_host", host_path(F.col("_url"))[0])
    space = Workspace(pages.sparkSession, "styletree")
    tree, kinds = style_tree(source, "_host", "_html", space)
    # kinds are HTML's tags times the names above
    kinds = kinds.collect()
    shared = {f"kinds_{x}": frozenset(r["kind"] for r in kinds if r[x]) for x in ("low", "off", "spared")}
    tree = space.keep(tree.withColumnRenamed("host", "_host"), "tree")
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), T.StructField(url_col, source.schema["_url"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    sets = ("low", "off", "spared", "blocks")

    def told(ids, urls, out):
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    if space.stored_bytes("tree") <= BROADCAST_BYTES:
        # checked size: each worker gets the trees once, and no page is shuffled
        trees = pages.sparkSession.sparkContext.broadcast({r["_host"]: tuple(np.array(r[c] or (), np.int64) for c in sets) for r in tree.collect()})

        def beside(batches):
            known = Cache(lambda host: Tree(*(frozenset(x.tolist()) for x in trees.value.get(host, ())), **shared), 1 << 12)
            for batch in batches:
                yield told(batch.column(0), batch.column(1), [main_text(html, known[host], names) for html, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])

        return source.select("_id", "_url", "_html", "_host").mapInArrow(beside, schema)

    def following(batches):
        host, own = None, Tree(**shared)
        for batch in batches:
            out, pages_at = [], []
            hosts, is_page, htmls = (batch.column(i).to_pylist() for i in (3, 4, 2))
            for i, (name, page, html) in enumerate(zip(hosts, is_page, htmls, strict=True)):
                if not page:
                    host, own = name, Tree(*(frozenset(batch.column(k)[i].as_py() or ()) for k in range(5, 9)), **shared)
                    continue
                if name != host:
                    host, own = name, Tree(**shared)
                out.append(main_text(html, own, names))
                pages_at.append(i)
            if out:
                at = pa.array(pages_at)
                yield told(batch.column(0).take(at), batch.column(1).take(at), out)

    # a host's pages are dealt over SALTS tasks, each of which reads the tree in one row before them
    salted = source.select("_id", "_url", "_html", "_host", F.pmod(F.xxhash64("_html", "_id"), F.lit(SALTS)).cast("int").alias("_salt"), F.lit(1).alias("_page"))
    copies = tree.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_page", F.lit(0))
    both = salted.unionByName(copies, allowMissingColumns=True).repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_page")
    return both.select("_id", "_url", "_html", "_host", "_page", *sets).mapInArrow(following, schema)


def op10_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
