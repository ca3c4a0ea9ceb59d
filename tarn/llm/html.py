"""Main text of web pages: site templates are found by hashing element subtrees and counting them per host, and removed together with what markup names as menus, adverts and the like.

A subtree is deleted if it recurs, with equal tags, classes and words, in at least RECURS bodies and a share SHARE of the bodies of its host. A body is a
page's text as markup alone gives it, so copies of a page count once. Near copies differ in their bodies, but they share most of their text: where deletion would
take more than half of a page's text, only what recurs in a share WIDE of the host's bodies goes, and nothing if that leaves no text.
Inside an <article> or <main> counts decide over containers (PARTS) and over blocks with a class, id or role. A bare paragraph, heading or list item there is prose: authors repeat headings and lines,
and near copies share them, so it goes only with a container that recurs. Pages without such an element are compared as a whole.

Blocks are the text between block-level tags. Defined results: null or empty html gives an empty text; unclosed, truncated and stray tags are repaired as browsers roughly do; repeated rows and null ids give a row each; a null url is a host of its own without templates.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, releasing, save

RECURS, SHARE, WIDE = 5, 0.05, 0.5
BROADCAST_ROWS = 50_000
#: Elements of HTML by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROP = frozenset("head script style noscript template svg canvas iframe object form button select option textarea input nav header footer aside menu dialog audio video map title".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARTS = frozenset("div section ul ol dl table figure details center fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
LIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
STOPS = frozenset("ul ol dl table article main body section div nav aside footer header form".split())
#: Elements that only their own end tags close.
ROOTS = frozenset("article main body".split())
#: Words of a class, id or role that name what isn't the article.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentary cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget widgets alert gdpr complementary contentinfo search".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "noise")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts = tag, attrs, []
        self.noise = tag in DROP or bool(attrs) and not NOISE.isdisjoint(_WORDS.findall(attrs)) and tag not in ("html", "body", "article", "main")


class _Path:
    """The open elements. It knows where each tag, and each kind of element that stops a search, is open last, so that no tag walks over the others."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.stops, self.roots = [root], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in STOPS:
            self.stops.append(k)
        if node.tag in ROOTS:
            self.roots.append(k)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, k: int) -> None:
        """Closes the k-th element and those in it."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().tag].pop()
        for places in (self.stops, self.roots):
            while places and places[-1] >= k:
                places.pop()

    def close(self, tags, barriers: list[int]) -> None:
        """Closes the last open element of tags, unless a barrier is open in it."""
        if k := self.last(tags):
            if not barriers or k > barriers[-1]:
                self.cut(k)


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("")
    path, at, n = _Path(root), 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            path.nodes[-1].parts.append(source[at:])
            break
        if m.start() > at:
            path.nodes[-1].parts.append(source[at : m.start()])
        at, s = m.end(), m[0]
        if s[1] in "!?":
            continue
        tag = _NAME.match(s)[1].lower()
        if s[1] == "/":
            path.close((tag,), [] if tag in ROOTS or tag == "html" else path.roots)
            if tag in ("br", "p"):
                path.nodes[-1].parts.append(Node("br"))
            continue
        if tag in CLOSES_P:
            path.close(("p",), path.stops)
        if tag in LIKE:
            path.close(LIKE[tag].split(), path.stops)
        if tag == "body" and path.nodes[-1].tag == "head":
            path.cut(len(path.nodes) - 1)
        attrs = " ".join((a or b or c).lower() for _, a, b, c in _ATTR.findall(s)) if "=" in s else ""
        node = Node(tag, attrs)
        path.nodes[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not s.endswith("/>"):
            path.push(node)
    return root


def _own(node: Node) -> list[Node]:
    """The outermost articles outside noise, or else the outermost mains."""
    for tag in ("article", "main"):
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            for part in x.parts:
                if isinstance(part, Node) and not part.noise:
                    (out if part.tag == tag and NOISE.isdisjoint(_WORDS.findall(part.attrs)) else todo).append(part)
        if out:
            return out[::-1]
    return []


def subtree_hashes(root: Node, inside: list[Node]) -> dict[int, int]:
    """Hash by id() of each element that holds text, but for those that hold, or are, one of inside, and for noise, which is no text of the page. In inside only PARTS and blocks with a class, id or role count."""
    import xxhash

    out, keep = {}, {id(x) for x in inside}
    done: dict[int, tuple[int, bool, bool]] = {}
    todo = [(root, False, False)]
    while todo:
        x, ready, within = todo.pop()
        if x.noise and x.tag:
            done[id(x)] = (0, False, False)
        elif not ready:
            todo.append((x, True, within))
            todo += [(p, False, within or id(x) in keep) for p in x.parts if isinstance(p, Node)]
        else:
            h, text, own = xxhash.xxh3_64(f"{x.tag} {x.attrs}"), False, id(x) in keep
            for p in x.parts:
                if isinstance(p, Node):
                    a, b, c = done[id(p)]
                    h.update(a.to_bytes(8, "little"))
                    text, own = text or b, own or c
                elif s := _SPACE.sub(" ", p).strip():
                    h.update(s.encode("utf-8", "surrogatepass"))
                    text = True
            done[id(x)] = (h.intdigest(), text, own)
            if text and not own and x.tag and (not within or x.tag in PARTS or x.attrs and x.tag in BLOCK):
                out[id(x)] = h.intdigest()
    return out


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def text_of(source: str, drop: frozenset[int] = frozenset(), wide: frozenset[int] = frozenset()) -> str:
    """Main text of a page; drop: signed hashes of its host's template subtrees, wide: those of them that most of the host has."""
    if not source:
        return ""
    root = parse(source)
    own = _own(root)
    whole = _emit(own or [root], set())
    if not drop:
        return whole
    hashes = {k: _signed(h) for k, h in subtree_hashes(root, own).items()}
    for some in (drop, wide):
        gone = {k for k, h in hashes.items() if h in some}
        text = _emit(own or [root], gone) if gone else whole
        if 2 * len(text) >= len(whole) or some is wide and text and not own:
            return text
    return whole


def _emit(nodes: list[Node], gone: set[int]) -> str:
    """The blocks of nodes without noise and what is gone by id()."""
    blocks: list[str] = []
    line: list[str] = []

    def end():
        if line:
            s = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
            if s:
                blocks.append(s)
            line.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif id(x) not in gone and not (x.noise and x.tag):
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.parts)
    end()
    return "\n".join(blocks)


def _templates(batches):
    """(host, body, subtree) of each subtree of a page, and one row with a null subtree."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        hosts, bodies, hashes = [], [], []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if host is not None and source:
                root = parse(source)
                own = _own(root)
                body = _signed(xxhash.xxh3_64_intdigest(_emit(own or [root], set()).encode("utf-8", "surrogatepass")))
                for h in (None, *set(subtree_hashes(root, own).values())):
                    hosts.append(host)
                    bodies.append(body)
                    hashes.append(h if h is None else _signed(h))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "body", "subtree"])


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts, last, drop, most = [], None, frozenset(), frozenset()
        for source, gone, wide in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if (gone, wide) != last:
                last, drop, most = (gone, wide), frozenset(gone or ()), frozenset(wide or ())
            texts.append(text_of(source or "", drop, most))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = base.withColumn("host", F.nullif(host, F.lit("")))
    seen = base.select("host", "html").mapInArrow(releasing(_templates), "host string, body long, subtree long").groupBy("host", "subtree").agg(F.count_distinct("body").alias("n"))
    seen = save(seen.where((F.col("n") >= RECURS) | F.col("subtree").isNull()))
    sizes = seen.where("subtree is null").select("host", F.col("n").alias("bodies"))
    common = seen.where("subtree is not null").join(sizes, "host").where(F.col("n") >= F.col("bodies") * SHARE)
    common = common.groupBy("host").agg(F.array_sort(F.collect_list("subtree")).alias("gone"), F.array_sort(F.collect_list(F.when(F.col("n") >= F.col("bodies") * WIDE, F.col("subtree")))).alias("wide"))
    common = save(common)
    return base.join(broadcast_if(common, BROADCAST_ROWS), "host", "left").select("page_id", "url", "html", "gone", "wide").mapInArrow(releasing(_extract), "page_id long, url string, text string, n_chars long")
