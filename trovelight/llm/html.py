"""Main-text extraction by consensus host paths.

Each page proposes the container that holds its article; the proposals are
generalised to paths of tags and classes without digits and counted per host;
every page is then read again with the paths that won on its host, where they hold most of its text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common

#: Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
DROPPED = frozenset("nav footer aside form button select option menu dialog object canvas audio video map label fieldset applet head title".split())
CONTAINERS = frozenset("html body main article section div td center".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role that mark parts that are not the article.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted "
    "related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?:[a-zA-Z/!?])[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words that stand beside those in names of such parts, as in site-footer or cookie-banner.
STRUCTURE = frozenset(
    "area bar block bottom box btn button buttons container content float form global header icons inner item items left link links list main mobile module outer page panel "
    "policy post reader right row section site slot sticky text top unit user widgets wrap wrapper".split()
)
#: A container is left for its largest child while what lies beside that child is at most this share of the text.
BESIDE_SHARE = 0.1
#: A path that won on the host serves for a page where it holds this share of what the page's own path holds.
SERVES_SHARE = 0.5
#: Paths of a host with this share of its votes take part, so at most twenty a host.
VOTE_SHARE = 0.05


class Node:
    """A container: ``key`` stands for its path of tags and classes; ``own`` and ``weight`` are its text outside links, without and with the containers in it."""

    __slots__ = ("tag", "key", "dropped", "parent", "own", "weight", "linked", "children", "in_article", "headed")

    def __init__(self, tag: str, key: str, dropped: bool, parent: Node | None, in_article: bool):
        self.tag, self.key, self.dropped, self.parent, self.in_article = tag, key, dropped, parent, in_article
        self.own, self.weight, self.linked, self.children, self.headed = 0, 0, 0, [], False


def path_key(parent: str, tag: str, classes: str) -> str:
    """A path as a short hash of its parent's and its last step, so that deep pages cost no more than flat ones."""
    return hashlib.blake2b(f"{parent}/{tag}.{classes}".encode("utf-8", "replace"), digest_size=9).hexdigest()


def marked(attrs: dict[str, str], in_article: bool) -> bool:
    """Whether class, id or role name a part that isn't the article: within an article by whole names only, else also by names such as site-footer."""
    for name in (n for v in attrs.values() for n in v.split()):
        if name.lower() in PARTS:
            return True
        words = [w.lower() for w in WORD.findall(name)]
        if not in_article and any(w in PARTS for w in words) and all(w in PARTS or w in STRUCTURE for w in words):
            return True
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """(containers, each after its parent and the root first, text blocks in page order with the innermost container around each).

    Time and memory grow with the length of the page, however deep it is nested.
    """
    root = Node("", "", False, None, False)
    nodes = [root]
    stack: list[tuple[str, Node]] = [("", root)]
    open_tags: Counter[str] = Counter()
    blocks: list[tuple[Node, str]] = []
    words: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        node = stack[-1][1]
        if text and not node.dropped:
            blocks.append((node, text))
            node.own += max(0, len(text) - 2 * links)
            node.linked += min(links, len(text))
            node.headed |= stack[-1][0] in ("h1", "h2", "h3")
        links = 0

    def pop_to(k: int) -> None:
        for tag, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() > at:
            words.append(page[at : m.start()])
            if open_tags["a"]:
                links += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                words.append(" ")
            continue
        tag = tag.lower()
        if m[2]:
            if tag not in INLINE:
                flush()
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag not in INLINE:
            flush()
            closed = CLOSES.get(tag) or ({"p"} if tag in CLOSES_P else ())
            if any(open_tags[c] for c in closed):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closed:
                        pop_to(k)
                        break
                    if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "dl", "table"):
                        break
        if tag in VOID:
            continue
        node = stack[-1][1]
        if tag in CONTAINERS or tag in DROPPED or tag == "header" or (m[4] and tag not in INLINE):
            attrs = {a.lower(): x or y or z for a, x, y, z in ATTR.findall(m[4])} if m[4] else {}
            whole = tag in ("html", "body", "article", "main")
            head = tag == "header" or "header" in attrs.get("class", "").lower().split() or "header" in (attrs.get("id", "").lower(), attrs.get("role", "").lower())
            dropped = node.dropped or tag in DROPPED or (head and not node.in_article) or (not whole and marked(attrs, node.in_article))
            if dropped or tag in CONTAINERS:
                classes = ".".join(sorted(re.sub(r"\d+", "", attrs.get("class", "")).split()))
                parent = node
                node = Node(tag, path_key(parent.key, tag, classes), dropped, parent, node.in_article or tag in ("article", "main"))
                nodes.append(node)
                if not dropped:
                    parent.children.append(node)
        open_tags[tag] += 1
        stack.append((tag, node))
    words.append(page[at:])
    flush()
    for node in reversed(nodes):
        node.weight += node.own
        if node.parent is not None:
            node.parent.weight += node.weight
    return nodes, blocks


def vote(root: Node) -> str:
    """The path of the page's best container, '' if there is no text.

    From the root on, the largest child takes a container's place until that is an article, or holds a heading of its own beside the child (a title), or more text
    beside it than BESIDE_SHARE, such as the other half of an article.
    """
    node = root
    while node.weight and node.tag != "article":
        best = max(node.children, key=lambda c: c.weight, default=None)
        if best is None or not best.weight or (node.tag == "main" and best.tag != "article"):
            break
        if node.weight - best.weight > BESIDE_SHARE * node.weight or (node.headed and node.tag not in ("", "html", "body") and best.tag not in ("article", "main")):
            break
        node = best
    return node.key if root.weight else ""


def extract(page: str | None, paths: list[str] | None) -> str:
    """The article's blocks joined by blank lines: by the first of ``paths`` that is an article, or else holds most of what the page's own vote holds; without one by that vote."""
    nodes, blocks = parse(page or "")
    held: Counter[str] = Counter()
    named = set()
    for node in nodes:
        held[node.key] += node.weight
        if node.tag in ("article", "main"):
            named.add(node.key)
    own = vote(nodes[0])
    path = next((p for p in paths or [] if held[p] and (p in named or held[p] >= SERVES_SHARE * held[own])), own)
    inside: dict[int, bool] = {}
    for node in nodes:
        above = node.parent is not None and inside[id(node.parent)]
        # Beside an article, a container of links alone is a menu.
        menu = not node.in_article and not node.weight and node.linked and held[path]
        inside[id(node)] = (above or node.key == path) and not menu
    return "\n\n".join(text for node, text in blocks if inside[id(node)])


def host(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """Vote in Spark: host, paths (most votes first, ties to the smaller path)."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter((h, vote(parse(x or "")[0][0])) for h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            n = {k: v for k, v in n.items() if k[1]}
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in n], pa.string()), "path": pa.array([k[1] for k in n], pa.string()), "votes": pa.array(list(n.values()), pa.int64())})

    counted = common.materialize(
        pages.select(host("url").alias("host"), "html").mapInArrow(votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes")), "path-votes"
    )
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = counted.join(total, "host").filter(F.col("votes") >= VOTE_SHARE * F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
    return kept.groupBy("host").agg(F.transform(ranked, lambda s: s["path"]).alias("paths"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to page_id, url, text, n_chars.

    A null or empty page, or one without an article, has the empty text; a null or unreadable url counts as
    host ''. Repeated rows are kept. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    paths = common.materialize(host_paths(rows), "host-paths")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, p) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = common.join_hot(rows.withColumn("host", host("url")), paths, ["host"], "left", F.col("page_id"), 200_000)
    id_type = dict(rows.dtypes)["page_id"]
    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, f"page_id {id_type}, url string, text string, n_chars long")
