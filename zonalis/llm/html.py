"""HTML extraction by consensus host paths.

First pass: every page's containers are scored by the paragraphs that stand in them, and the page
votes for the generalised tag-class path of its best container. Spark adds the votes per host and
path. Second pass: each page is extracted at its host's winning path, where the page has such a
container that holds enough of its text, or else at its own best container.
"""

from __future__ import annotations

import hashlib
import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Hosts whose winning paths are broadcast; beyond, they are joined through a salted shuffle.
BROADCAST_HOSTS = 50_000
SALTS = 32
#: A path of more characters votes by the digest of the whole.
PATH_CHARS = 300
#: An element whose class says noise stays if it holds an article or more than this share of the text.
MOST_TEXT = 0.5
#: Siblings like the chosen container are parts of one story from this share of its score.
SIBLING = 0.2
#: A page follows its host where the winning container scores this share of its best one.
FOLLOW = 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|</?\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?|[\"'][^\"']*[\"']?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article main section div td body blockquote center".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td figcaption".split())
#: Elements that never hold article text.
_DROPPED = frozenset("nav footer aside form script style noscript iframe template svg math button select option textarea object embed canvas audio video head title menu dialog input label datalist map".split())
#: Words of classes and ids that mark noise wherever they stand.
_NOISE = frozenset(
    "ad ads advert advertisement advertising adslot breadcrumb breadcrumbs cookie cookies consent footer gdpr hidden menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted promotion related recommended share sharing sidebar signup skip skiplink social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Such words that an article's own parts may have.
_HEADS = frozenset("header masthead banner topbar".split())
#: Readers' words: noise even where they hold most of the text, or articles.
_READERS = frozenset("comment comments disqus replies respond".split())
#: Words that say what an element stands beside, not what it is.
_BESIDE = frozenset("with has no without toggle open closed layout page wrapper".split())
_PARTS = re.compile(r"[^\W_]+")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_GOOD = frozenset("article content entry main post story text body".split())
#: What a new element closes, and the elements at which the search for it stops.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html article section main div".split())
_ARTICLE = frozenset("article main".split())


def attributes_of(source: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of repeated names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def marks(names: str) -> tuple[bool, bool, bool, bool]:
    """Whether a class or id among names says noise, a head, readers' words, or article. Words are the parts
    of one class or id; a word that stands beside ``with`` and the like says nothing."""
    noise = head = readers = good = False
    for token in names.lower().split():
        words = [w.rstrip("0123456789") for w in _PARTS.findall(token)]
        good |= not _GOOD.isdisjoint(words)
        if _BESIDE.isdisjoint(words):
            noise |= not _NOISE.isdisjoint(words)
            head |= not _HEADS.isdisjoint(words)
            readers |= not _READERS.isdisjoint(words)
    return noise, head, readers, good


class Node:
    """An element. noise: it and all it holds are left out; soft: only its class or id says so."""

    __slots__ = ("tag", "label", "parent", "parts", "noise", "soft", "score", "links", "good", "within")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.parts, self.score, self.links = tag, parent, [], 0.0, 0
        self.label, self.noise, self.soft, self.good = tag, tag in _DROPPED, False, False
        self.within = tag in _ARTICLE or parent is not None and parent.within
        if attributes:
            found = attributes_of(attributes)
            classes = sorted({re.sub(r"\d+", "", c.lower()).strip("-_") for c in found.get("class", "").split()} - {""})
            self.label = ".".join([tag, *classes])
            noise, head, readers, self.good = marks(f"{found.get('class', '')} {found.get('id', '')}")
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if tag not in ("html", "body", "main"):
                self.noise |= readers
            if tag not in ("html", "body", "article", "main"):
                self.noise |= hidden or found.get("role", "").lower() in _ROLES
                self.soft = not self.noise and (noise or head and not self.within)
        self.noise |= tag == "header" and not self.within  # an article's own header holds its title

    def path(self) -> str:
        labels, node = [], self
        while node is not None:
            labels.append(node.label)
            node = node.parent
        whole = "/".join(reversed(labels))
        return whole if len(whole) <= PATH_CHARS else hashlib.sha256(whole.encode()).hexdigest()


def settle(root: Node) -> None:
    """Make soft noise noise, but where it holds an article or most of the page's text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.noise:
            order.append(node)
            stack.extend(p for p in node.parts if not isinstance(p, str))
    if not any(n.soft for n in order):
        return
    held: dict[int, tuple[int, bool]] = {}
    for node in reversed(order):
        size, article = 0, False
        for p in node.parts:
            if isinstance(p, str):
                size += len(p) - p.count(" ") - p.count("\n")
            else:
                n, inside = held.get(id(p), (0, False))
                size, article = size + n, article or inside
        held[id(node)] = size, article or node.tag in _ARTICLE
    whole = held[id(root)][0]
    for node in order:
        size, article = held[id(node)]
        node.noise = node.soft and not article and size <= MOST_TEXT * whole


def parse(page: str) -> Node:
    """A lenient tree: unclosed elements end with their parent, stray end tags are skipped, a
    truncated tag or comment ends the page."""
    root = node = Node("", None)
    seen: set[str] = set()
    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in seen:
                continue
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            else:
                seen.discard(tag)  # none is open: later ones are not looked for
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or size
            continue
        if tag in _BLOCK:
            up = node
            while up is not None and up.tag != "p" and (up.tag not in _BLOCK):
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in _CLOSES:
            up = node
            while up is not None and up.tag not in _CLOSES[tag] and up.tag not in _SCOPE:
                up = up.parent
            if up is not None and up.tag in _CLOSES[tag]:
                node = up.parent
                if tag == "tr" and up.tag != "tr" and node is not None and node.tag == "tr":
                    node = node.parent
        if tag in ("html", "body") and node.tag != tag:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None:
                continue
        child = Node(tag, node, m[3] or "")
        node.parts.append(child)
        if tag not in _VOID and not (m[3] or "").rstrip().endswith("/"):
            node = child
            seen.add(tag)
    settle(root)
    return root


def scored(root: Node) -> tuple[Node | None, list[Node]]:
    """The best container, and all containers outside noise. A paragraph's characters outside links
    count for its container, and half as much for each further one."""
    containers: list[Node] = []
    stack: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    order: list[tuple[Node, Node | None]] = []
    while stack:
        node, holder, link = stack.pop()
        if node.noise:
            continue
        if node.tag in _CONTAINERS:
            containers.append(node)
            order.append((node, holder))
            holder = node
        link = link or node.tag == "a"
        for part in node.parts:
            if isinstance(part, str):
                n = len(part) - part.count(" ") - part.count("\n")
                if holder is not None and n:
                    if link:
                        holder.links += n
                    else:
                        holder.score += n
            else:
                stack.append((part, holder, link))
    for node, holder in reversed(order):
        node.score = max(0.0, node.score - node.links)
    for node, holder in reversed(order):
        if holder is not None:
            holder.score += node.score * (0.9 if node.tag == "blockquote" else 0.5)
    best = None
    for node in containers:
        weight = (2.0 if node.tag in _ARTICLE else 1.25 if node.good else 1.0) * (0.8 if node.tag == "body" else 1.0)
        node.score *= weight
        if best is None or node.score > best.score:
            best = node
    return (best if best is not None and best.score > 0 else None), containers


def text_of(node: Node) -> str:
    """The node's blocks in page order, without noise; white space inside a block is one space."""
    blocks: list[str] = []
    words: list[str] = []

    def close() -> None:
        block = " ".join(references.unescape("".join(words)).split())
        if block:
            blocks.append(block)
        words.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            words.append(x)
        elif x.tag == "br":
            words.append(" ")
        elif not x.noise or x is node:
            block = x.tag in _BLOCK
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(x.parts))
    close()
    return "\n".join(blocks)


def story(best: Node, containers: list[Node]) -> list[Node]:
    """The container and those beside it, in page order, that are like it and hold enough: one story may be
    split over siblings."""
    alike = {id(c) for c in containers if c.parent is best.parent and c.label == best.label and c.score >= SIBLING * best.score}
    return [p for p in best.parent.parts if id(p) in alike] if best.parent is not None else [best]


def host_of(url: str | None) -> str:
    """The lower-case host of a URL, without user and port; empty where there is none."""
    rest = (url or "").partition("://")[2] or (url or "").removeprefix("//")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def vote(page: str | None) -> tuple[str, int]:
    """The path of the page's best container, and the weight of its vote; ('', 0) without one."""
    best, _ = scored(parse(page or ""))
    return (best.path(), 1 + round(math.log2(1 + best.score))) if best is not None else ("", 0)


def extract(page: str | None, path: str | None = None) -> str:
    """The main text, at the path if the page has enough there, else at its best container, else of
    the whole page without noise."""
    root = parse(page or "")
    best, containers = scored(root)
    if best is None:
        return text_of(root)
    if path:
        agreed = [c for c in containers if c.score >= FOLLOW * best.score and (len(path) == 64 or path.endswith(c.label)) and c.path() == path]
        if agreed:
            best = max(agreed, key=lambda c: c.score)
    return "\n".join(filter(None, map(text_of, story(best, containers))))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts = [host_of(u) for u in b.column(0).to_pylist()]
        cast = [vote(h) for h in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([p for p, _ in cast], pa.string()), pa.array([n for _, n in cast], pa.int64())], ["host", "path", "weight"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(3)], ["page_id", "url", "text", "path"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host; ties go to the least path."""
    votes = pages.select("url", "html").where("html is not null").mapInArrow(_votes, "host string, path string, weight bigint").where("weight > 0")
    added = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return added.groupBy("host").agg(F.min(F.struct((-F.col("weight")).alias("w"), "path")).alias("first")).select("host", "first.path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, path (what the host agreed on) for each row.

    A null or empty page gives an empty text; a page without a container gives its text without
    noise; a null url is the host ''. Repeated rows vote and are extracted each for itself. An empty
    table gives an empty table; other columns are not read. Whole pages are parsed, without limits; a path
    of more than ``PATH_CHARS`` characters is returned as its SHA-256.
    """
    winners = checkpoint(host_paths(pages))
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), "^(?s:.*?)://|^//", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "(?s)[/?#].*$", ""), "(?s)^.*@", ""), "(?s):.*$", ""))
    keyed = own.withColumn("host", host)
    if winners.count() <= BROADCAST_HOSTS:
        both = keyed.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "path").mapInArrow(_texts, "page_id bigint, url string, text string, path string")
