"""Main text of web pages: page structure, and removal of subtrees that recur over a host's pages."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_function, cut, lookup

#: A subtree is a template of its host if it stands on at least this many pages (inside an article: the second number), and on no fewer
#: than the square root of the host's pages: a part that falls as a host grows.
LEAST_PAGES = 3
LEAST_PAGES_INSIDE = 8
#: A shape is a template if it stands on at least this part of the host's pages and has, on average, no more than this part of a page's text.
SHAPE_PART = 0.5
SHAPE_TEXT = 0.2
#: Templates of all hosts together, of 8 bytes each, are broadcast up to this number, and up to BROADCAST_ROWS hosts.
BROADCAST_TEMPLATES = 1_000_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?=<)|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|(?<=[\s/"']))([^\s=/>"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"[a-z]+")

#: Fixed lists of HTML elements.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul""".split())
CONTAINER = frozenset("div section ul ol dl table aside nav header footer form figure details fieldset menu".split())
DROPPED = frozenset("""nav footer aside form script style noscript template iframe svg math button select input textarea head title object canvas dialog menu
    audio video map label datalist xmp noembed noframes""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: What is never shown.
HIDDEN = frozenset("head title script style noscript template iframe noembed noframes".split())
#: What stands around containers.
AROUND = frozenset("html body main article center".split())
#: Elements whose shape may be a template also without class, id or role.
FURNITURE = frozenset("nav footer header aside form menu".split())
#: Words in class or id that mark something beside the article.
MARKS = frozenset("""ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    newsletter subscribe subscription signup sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies
    respond disqus discussion related recommended share sharing social popup modal overlay paywall pagination pager toolbar widget skip copyright disclaimer""".split())
#: Beginnings of such words, as sites join them: commentlist, adverts, cookiebar.
BEGINNINGS = tuple("comment advert sponsor cookie newsletter sidebar breadcrumb subscri promo disqus related recommend popup paywall".split())
#: A class of an article that makes it a reader's or another page's.
OTHERS = frozenset("comment reply teaser related promo ad card sponsored".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPE = frozenset("article body div section main ul ol dl table td th tr nav aside header footer form blockquote figure html details fieldset".split())


class Node:
    __slots__ = ("tag", "marks", "role", "children", "has_article", "up", "inside", "core", "key", "shape")

    def __init__(self, tag: str, up: int = 0, inside: bool = False, marks: frozenset[str] = frozenset(), role: str = ""):
        self.tag, self.marks, self.role = tag, marks, role
        self.children: list[Node | str] = []
        self.has_article = False
        self.up = up  # the parent's number
        self.inside = inside  # in an article or main
        self.core = False  # in the container that has half of the page's text
        self.key = self.shape = 0


class _Open:
    """The open elements. Those opened since the last element of _SCOPE are counted by tag, so whether an end tag closes anything
    is known without a search, and time is linear however deep elements nest."""

    def __init__(self, root: Node):
        self.nodes: list[tuple[Node, int]] = [(root, 0)]
        self.all: Counter[str] = Counter()
        self.scopes: list[tuple[str, Counter[str]]] = [("", Counter())]

    def push(self, node: Node, number: int) -> None:
        self.nodes.append((node, number))
        self.all[node.tag] += 1
        if node.tag in _SCOPE:
            self.scopes.append((node.tag, Counter()))
        else:
            self.scopes[-1][1][node.tag] += 1

    def pop(self, tags: tuple[str, ...]) -> None:
        """Close the innermost element with one of ``tags``, and all in it."""
        while True:
            tag = self.nodes.pop()[0].tag
            self.all[tag] -= 1
            if tag in _SCOPE:
                self.scopes.pop()
            else:
                self.scopes[-1][1][tag] -= 1
            if tag in tags:
                return

    def reaches(self, tag: str) -> bool:
        """Whether an element with this tag is open and not outside the innermost element of _SCOPE."""
        scope, inner = self.scopes[-1]
        return scope == tag or inner[tag] > 0

    def end(self, tag: str) -> None:
        if self.all[tag] if tag in BLOCK else self.reaches(tag):  # an inline end tag closes nothing outside its block
            self.pop((tag,))


def parse(html: str) -> list[Node]:
    """The elements in the order in which they start, the root first; their children are elements and raw text. Unclosed and stray tags are
    repaired as far as blocks need it."""
    root = Node("#root")
    nodes = [root]
    open_ = _Open(root)
    unclosed: set[str] = set()
    at, end = 0, len(html)
    for m in iter(lambda: _TOKEN.search(html, at), None):
        start = m.start()
        if start > at:
            open_.nodes[-1][0].children.append(html[at:start])
        at = max(m.end(), start + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if close is None:
                unclosed.add(tag)
            if tag == "title" or tag == "textarea" or close:
                at = close.end() if close else end
            if close or at >= end:
                continue
        if tag in BLOCK or tag in _CLOSES:
            shut = _CLOSES.get(tag, ()) + (("p",) if tag in BLOCK else ())
            while any(map(open_.reaches, shut)):
                open_.pop(shut)
        attrs = m[3]
        marks, role = frozenset(), ""
        if "=" in attrs:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            named = f"{found.get('class', '')} {found.get('id', '')}"
            if len(named) > 1:
                marks = frozenset(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
            role = found.get("role", "").lower()
        parent, up = open_.nodes[-1]
        node = Node(tag, up, parent.inside or tag == "article" or tag == "main", marks, role)
        parent.children.append(node)
        if tag == "article" or tag == "main":
            for x, _ in reversed(open_.nodes):
                if x.has_article:
                    break  # and so has all around it
                x.has_article = True
        if tag not in VOID and not attrs.endswith("/"):
            open_.push(node, len(nodes))
        nodes.append(node)
    if at < end:
        open_.nodes[-1][0].children.append(html[at:])
    return nodes


def _beside(node: Node, inside: bool) -> bool:
    """Whether structure alone says that an element does not belong to the article."""
    tag = node.tag
    if tag in DROPPED or node.role in ROLES:
        return True
    if tag in ("html", "body", "main", "#root"):
        return False
    if tag == "article":
        return bool(node.marks & OTHERS)
    if tag == "header" and not inside:
        return True
    if node.has_article:
        return False
    return bool(node.marks) and (bool(node.marks & MARKS) or any(m.startswith(BEGINNINGS) for m in node.marks) or not inside and "header" in node.marks)


#: Shapes that a Python worker remembers, as most elements have one of few.
_SHAPES: dict[tuple, int] = {}
MOST_SHAPES = 20_000


def keys(nodes: list[Node]) -> list[int]:
    """Set on all nodes: ``key``, a hash of the subtree with its tags and text; ``shape``, a hash of its
    tags, classes, ids and roles without text, in which equal children count once. Gives each node's letters of shown text, and marks
    what is in the innermost container with half of them."""
    size = [0] * len(nodes)
    digest = xxhash.xxh64_intdigest
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[i]
        parts, shapes = [node.tag], set()
        shown = node.tag not in HIDDEN
        for c in node.children:
            if isinstance(c, str):
                t = c.strip()
                if t:
                    parts.append(t)
                    size[i] += len(t) if shown else 0
            else:
                parts.append("\0%x" % c.key)
                shapes.add(c.shape)
        node.key = digest("\1".join(parts)) - (1 << 63)
        kind = (node.tag, node.marks, node.role, frozenset(shapes))
        shape = _SHAPES.get(kind)
        if shape is None:
            if len(_SHAPES) > MOST_SHAPES:
                _SHAPES.clear()
            shape = _SHAPES[kind] = digest("\1".join((node.tag, *sorted(node.marks), "", node.role, *(f"{x:x}" for x in sorted(shapes)))), 1) - (1 << 63)
        node.shape = shape
        if i and shown:
            size[node.up] += size[i]
    top = 0
    for i in range(1, len(nodes)):  # down to the innermost container with half of the text
        if nodes[i].up == top and 2 * size[i] >= size[0] > 0 and (nodes[i].tag in CONTAINER or nodes[i].tag in AROUND):
            top = i
    if nodes[top].tag not in ("#root", "html", "body"):
        for node in nodes[top + 1 :]:
            node.core = node.up == top or nodes[node.up].core
    return size


def _by_text(node: Node, article: bool) -> bool:
    """Whether a subtree may be a template by its text: all blocks beside the article; inside it, containers only, never its paragraphs."""
    if node.tag in ("html", "body", "head", "article", "main", "#root") or article and node.has_article:
        return False
    return node.tag in CONTAINER or node.tag in BLOCK and not (article and node.inside)


def _by_shape(node: Node, article: bool) -> bool:
    """Whether a subtree may be a template by its shape: containers beside the article that say what they are; without an article, beside the
    container that has half of the page's text, as in it a lead or a box may have the same shape on all pages too."""
    if node.tag not in CONTAINER or node.core or article and (node.has_article or node.inside):
        return False
    return node.tag in FURNITURE or bool(node.marks) or bool(node.role)


def subtrees(html: str | None, article: bool = True) -> dict[int, int]:
    """What a page counts for: the hashes of its subtrees that may be templates. The number beside one is -1 for a text, -2 for one inside an
    article, and for a shape the part of the page's text that all subtrees of this shape have, in thousandths."""
    if not html:
        return {}
    nodes = parse(html)
    size = keys(nodes)
    texts: dict[int, int] = {}
    shapes: dict[int, int] = {}
    for node, n in zip(nodes, size):
        if _by_text(node, article):
            texts[node.key] = max(-2 if article and node.inside else -1, texts.get(node.key, -2))
        if _by_shape(node, article):
            shapes[node.shape] = shapes.get(node.shape, 0) + n
    whole = max(1, size[0])
    return texts | {k: min(1000, 1000 * n // whole) for k, n in shapes.items()}


def _articles(root: Node) -> list[Node]:
    """The outermost articles that are no comments or teasers."""
    found, rest = [], [root]
    while rest:
        node = rest.pop()
        if node.tag == "article":
            found.append(node)
        elif node is root or node.has_article or node.tag in ("html", "body", "div", "section", "main"):
            rest += [c for c in reversed(node.children) if not isinstance(c, str) and not _beside(c, False)]
    return found


def _main(root: Node) -> list[Node]:
    rest = [root]
    while rest:
        node = rest.pop()
        if node.tag == "main":
            return [node]
        rest += [c for c in reversed(node.children) if not isinstance(c, str) and not _beside(c, False)]
    return []


def _blocks(top: Node, inside: bool, templates: frozenset[int], structure: bool) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = "".join(line)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            line.clear()

    stack = [(iter(top.children), True, inside)]
    while stack:
        children, block, inside = stack[-1]
        for c in children:
            if isinstance(c, str):
                line.append(c)
                continue
            tag = c.tag
            if tag == "br" or tag == "td" or tag == "th":
                line.append(" ")
            gone = c.key in templates and _by_text(c, structure) or c.shape in templates and _by_shape(c, structure)
            if gone or (_beside(c, inside) if structure else tag in HIDDEN):
                if tag in BLOCK:
                    flush()
            elif tag in BLOCK:
                flush()
                stack.append((iter(c.children), True, inside or tag == "article" or tag == "main"))
                break
            elif c.children:
                stack.append((iter(c.children), False, inside))
                break
        else:
            stack.pop()
            if block:
                flush()
    return out


def extract(html: str | None, templates: frozenset[int] = frozenset(), structure: bool = True) -> str:
    """The article's blocks, joined by two line feeds. ``templates`` are hashes of subtrees to delete, by text or by shape.

    Article elements that are no comments or teasers are the article; without any, main, else everything that structure
    and templates leave over. Without ``structure`` templates alone decide: articles, elements such as nav, and names of classes mean nothing.
    """
    if not html:
        return ""
    nodes = parse(html)
    if templates:
        keys(nodes)
    found = (_articles(nodes[0]) or _main(nodes[0])) if structure else []
    return "\n\n".join(x for node in found or nodes[:1] for x in _blocks(node, bool(found), templates, structure))


def host_of(url: str):
    """Column: the host in a URL, in lower case; the empty string if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", structure: bool = True) -> DataFrame:
    """(__host, k): the hashes of the subtrees that are templates of a host.

    Each page counts a subtree once. Counts are built before the shuffle, and the narrow rows of all hosts are dealt out by host and hash, so a hot
    host costs nothing extra.
    """
    kind = pa.list_(pa.struct([("k", pa.int64()), ("s", pa.int32())]))
    found = arrow_function(pages, lambda x: pa.array([[{"k": k, "s": s} for k, s in subtrees(h, structure).items()] for h in x.to_pylist()], kind), "array<struct<k:bigint,s:int>>")
    page = F.array(F.struct(F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("int").alias("s")))
    seen = pages.select(host_of(url_col).alias("__host"), F.explode(F.concat(page, found(html_col))).alias("x")).select("__host", "x.*")
    counts = cut(seen.groupBy("__host", "k").agg(F.count("*").alias("n"), F.min("s").alias("least"), F.max("s").alias("most"), F.sum("s").alias("parts")))
    of_host = counts.where("k is null").select("__host", F.col("n").alias("pages"))  # the null hash counts pages
    often = lookup(counts.where("k is not null"), of_host, ["__host"])
    by_text = (F.col("most") < 0) & (F.col("n") >= F.when(F.col("most") == -1, LEAST_PAGES).otherwise(LEAST_PAGES_INSIDE)) & (F.col("n") * F.col("n") >= F.col("pages"))
    by_shape = (F.col("least") >= 0) & (F.col("n") >= LEAST_PAGES) & (F.col("n") >= SHAPE_PART * F.col("pages")) & (F.col("parts") <= 1000 * SHAPE_TEXT * F.col("n"))
    return cut(often.where(by_text | by_shape).select("__host", "k"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True) -> DataFrame:
    """A row for each row of ``pages``: id, url, text, n_chars (long: its code points).

    Null or empty html gives an empty text. Pages without a host share the empty host. Repeated rows give repeated rows, empty
    input none; other columns are ignored. Elements may nest to any depth. Html enters no shuffle unless templates or their hosts outnumber the limits of
    the broadcast; then it is shuffled once by host, and adaptive execution splits hot hosts.
    """
    own = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    rows = own.withColumn("__host", host_of("__url"))
    all_ = templates(own, "__url", "__html", structure)
    most = BROADCAST_ROWS if all_.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES else 0
    rows = lookup(rows, cut(all_.groupBy("__host").agg(F.collect_list("k").alias("__templates"))), ["__host"], most=most)
    memo: dict[tuple, frozenset[int]] = {}

    def texts(html: pa.Array, keys_: pa.Array) -> pa.Array:
        out = []
        for h, k in zip(html.to_pylist(), keys_.to_pylist(), strict=True):
            t = tuple(k or ())
            if t not in memo:
                if len(memo) > 1000:
                    memo.clear()
                memo[t] = frozenset(t)
            out.append(extract(h, memo[t], structure))
        return pa.array(out, pa.string())

    text = arrow_function(pages, texts, "string")
    return rows.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), text("__html", "__templates").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
