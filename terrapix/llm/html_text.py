"""HTML main text by composite text density.

Each page becomes a small tree. For every node: characters for each tag in its subtree, adjusted by how much of them
is link text and by the links' own density. Names that hint at boilerplate weigh a subtree's density down, and article
elements weigh it up. The subtree whose children's densities sum to the most (the deepest of nearly equal ones) is the
content; the lowest density on the path from body down to the densest node is the threshold. Beside the content, under
the largest ancestor that reaches the threshold, stay all blocks that reach it too and, within an article or on pages
whose text isn't in one, all text that isn't mostly links, with the headings of what stays. Menus, footers, forms and
their like go by their element, and what a name hints at goes where the densest subtree isn't in it; but nothing goes
that holds most of a page's text.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Fixed values of HTML: elements without content, with raw text, inside a line of text, and what closes what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SECTIONS = "article aside blockquote body details dialog fieldset figure footer form header main nav section table td th"
CLOSES = {"li": ("li", f"ul ol menu {SECTIONS}"), "dt": ("dt dd", f"dl {SECTIONS}"), "dd": ("dt dd", f"dl {SECTIONS}"), "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "thead": ("tbody tr td th caption colgroup", "table"), "tfoot": ("thead tbody tr td th caption colgroup", "table"), "colgroup": ("caption colgroup", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements without text for readers; elements, roles and names of boilerplate; words that turn a name's sense round.
MUTE = frozenset("script style noscript template head title select textarea input iframe object embed svg canvas audio video map".split())
CHROME = frozenset("nav aside footer form button dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar "
    "notice notices cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay social share sharing related recommended pagination pager widget toolbar comment comments disqus replies respond hidden".split()
)
TURNED = frozenset("no not non has have with without enabled disabled off".split())
#: What a name takes from a density, what an article gives, how near to the largest sum a deeper node's must come, and
#: the depth past which elements are siblings, not children.
NAMED, ARTICLE, NEARLY, DEEP = 0.02, 10.0, 0.8, 500
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "hint", "depth", "chars", "tags", "link_chars", "link_tags", "density", "total", "texts")

    def __init__(self, tag: str, parent: Node | None, hint: str = ""):
        self.tag, self.parent, self.items, self.hint = tag, parent, [], hint
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.tags = self.link_chars = self.link_tags = self.texts = 0
        self.density = self.total = 0.0


def named(token: str) -> bool:
    """Whether a class or id is a name of boilerplate, as a whole or by its parts; "no-sidebar" isn't."""
    if token in DROP_NAMES:
        return True
    parts = re.split(r"[-_]+", token)
    return len(parts) > 1 and TURNED.isdisjoint(parts) and not DROP_NAMES.isdisjoint(parts)


def hint_of(tag: str, attrs: str, inside_article: bool) -> str:
    """"mute": never text; "chrome": boilerplate by its element, its role or as hidden; "name": by its class or id."""
    if tag in MUTE:
        return "mute"
    if tag in CHROME or (tag == "header" and not inside_article):  # a header within an article isn't the page's
        return "chrome"
    if not attrs or tag in ("html", "body", "article", "main"):
        return ""
    found = ""
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN_STYLE.search(value)) or (key == "role" and value in DROP_ROLES):
            return "chrome"
        if key in ("class", "id") and any(map(named, value.split())):
            found = "name"
    return found


class Scanner:
    """The tags of a page from left to right, in time that grows with its length alone."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        """As str.find; what isn't found once is never looked for again."""
        if what in self.gone:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.gone.add(what)
        return k

    def end_of_tag(self, at: int) -> int:
        """Where a tag's > is, quoted ones passed over; the next > where a quote never ends; -1 where there is none."""
        if (plain := self.find(">", at)) < 0:
            return -1
        k = at
        while m := STOP.search(self.page, k):
            if m[0] == ">":
                return m.start()
            if (k := self.find(m[0], m.end()) + 1) == 0:
                return plain
        return plain

    def tags(self):
        """(start, end, name, closing, attributes) of every tag; name is empty for comments and their like."""
        page, n, pos = self.page, len(self.page), 0
        while (at := page.find("<", pos)) >= 0:
            if m := TAG.match(page, at):
                end = self.end_of_tag(m.end())
                if end < 0:  # the page ends within a tag
                    yield at, n, "", False, ""
                    return
                pos = yield at, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
                pos = pos or end + 1
                continue
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at) and (end := self.find("]]>", at)) >= 0:
                end += 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = self.find(">", at)
                end = n if end < 0 else end + 1
            else:
                pos = at + 1
                continue
            yield at, end, "", False, ""
            pos = end


def parse(page: str) -> Node:
    """The page's tree; text runs and nodes are each node's items, in page order. Mute elements are nodes without items
    in the tree. An element that is too deep stands beside its parent's children, so none is lost."""
    root = node = Node("html", None)
    at, n, articles = 0, len(page), 0
    open_tags: dict[str, int] = {}
    scanner = Scanner(page)
    tags = scanner.tags()

    def leave(x: Node) -> Node:
        """x's parent, when x and all within it end."""
        nonlocal articles
        k = node
        while k is not x.parent:
            open_tags[k.tag] -= 1
            articles -= k.tag in ("article", "main")
            k = k.parent
        return k

    skip: int | None = None
    while True:
        try:
            start, end, tag, closing, attrs = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            if node.tag == "head" and not page[at:start].isspace():
                node = leave(node)
            node.items.append(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if open_tags.get(tag):
                x = node
                while x.tag != tag:
                    x = x.parent
                node = leave(x)
            continue
        if node.tag == "head" and tag not in IN_HEAD:
            node = leave(node)
        if tag in BLOCK_CLOSES_P:
            x = node
            while open_tags.get("p") and x is not root and x.tag in INLINE:
                x = x.parent
            if x.tag == "p":
                node = leave(x)
        elif tag in CLOSES:
            ends, stops = CLOSES[tag]
            x, last = node, None
            while x is not root and x.tag not in stops and any(open_tags.get(t) for t in ends):
                if x.tag in ends:
                    last = x
                x = x.parent
            if last is not None:
                node = leave(last)
        hint = hint_of(tag, attrs, articles > 0)
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, end)
            if hint != "mute":
                node.items.append(page[end : m.start() if m else n])
            at = skip = m.end() if m else n
            continue
        if tag in VOID or attrs.endswith("/"):
            if tag in ("br", "wbr"):
                node.items.append(" " if tag == "br" else "")
            if hint != "mute":
                node.items.append(Node(tag, node, hint))
            continue
        made = Node(tag, node, hint)
        if hint != "mute":
            node.items.append(made)
        if made.depth < DEEP or hint:
            node = made
            open_tags[tag] = open_tags.get(tag, 0) + 1
            articles += tag in ("article", "main")
    if n > at:
        if node.tag == "head" and not page[at:].isspace():
            node = leave(node)
        node.items.append(page[at:])
    return root


def postorder(root: Node) -> list[Node]:
    """Every node after its children."""
    stack, out = [root], []
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(k for k in x.items if isinstance(k, Node))
    return out[::-1]


def counted(root: Node) -> list[Node]:
    """Characters, tags and those of links in each subtree; texts: of its nodes, those with text of their own."""
    nodes = postorder(root)
    for x in nodes:
        x.chars = x.tags = x.link_chars = x.link_tags = x.texts = 0
        for k in x.items:
            if isinstance(k, str):
                x.chars += len("".join(k.split()))
            else:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a")
                x.texts += k.texts + (k.tag in ("p", "article", "main") and k.chars > 0)
        if x.tag == "a":
            x.link_chars = x.chars
    return nodes


def without_chrome(root: Node) -> None:
    """Take out what goes by its element; a hint is forgotten where most of the page's text, in several blocks, is."""
    nodes = counted(root)
    for x in nodes:
        if x.hint and 2 * x.chars > root.chars and x.texts > 1:
            x.hint = ""
    for x in nodes:
        x.items = [k for k in x.items if isinstance(k, str) or k.hint != "chrome"]


def measure(root: Node) -> list[Node]:
    """Densities of every node, weighed by hints, and the sums of its children's."""
    nodes = counted(root)
    body_share = root.link_chars / max(root.chars, 1)
    weight: dict[int, float] = {}
    for x in reversed(nodes):
        above = weight[id(x.parent)] if x.parent is not None else 1.0
        own = NAMED if x.hint else ARTICLE if x.tag in ("article", "main") else 1.0
        weight[id(x)] = min(above, own) if NAMED in (above, own) else max(above, own)
        if x.chars:
            c, t, lc, lt = x.chars, max(x.tags, 1), max(x.link_chars, 1), max(x.link_tags, 1)
            base = math.log(c / max(c - x.link_chars, 1) * x.link_chars + body_share * c + math.e)
            adjusted = max(c / lc * t / lt, 1.0 + 1e-9)
            x.density = weight[id(x)] * c / t * max(math.log(adjusted) / max(base, 1e-9), 0.0)
    for x in nodes:
        x.total = sum(k.density for k in x.items if isinstance(k, Node))
    return nodes


def mostly_links(items: list) -> bool:
    """Whether more than half of the characters are link text."""
    chars = sum(len("".join(k.split())) if isinstance(k, str) else k.chars for k in items)
    return 2 * sum(k.link_chars for k in items if isinstance(k, Node)) > chars


def densest_subtree(nodes: list[Node]) -> Node:
    """The largest sum of children's densities, or the deepest descendant that comes near; a line stands for its block."""
    x = max(reversed(nodes), key=lambda x: x.total)
    least = NEARLY * x.total
    while deeper := [k for k in x.items if isinstance(k, Node) and k.total >= least and k.total > 0]:
        x = deeper[0]
    while x.parent is not None and (x.tag in INLINE or x.tag == "p"):
        x = x.parent
    return x


def above(x: Node | None) -> list[Node]:
    """A node and its ancestors."""
    out = []
    while x is not None:
        out.append(x)
        x = x.parent
    return out


def content(root: Node) -> set[int]:
    """ids of the nodes whose whole subtrees are the main text; what doesn't belong there is taken out of the tree."""
    without_chrome(root)
    nodes = measure(root)
    if not root.chars:
        return set()
    densest = max(nodes, key=lambda x: x.density)
    threshold = min(x.density for x in above(densest) if x.density or x is densest)
    kept = up = densest_subtree(nodes)
    around = {id(x) for x in above(kept)}
    for x in nodes:  # a name is right where the densest subtree isn't within
        x.items = [k for k in x.items if isinstance(k, str) or k.hint != "name" or id(k) in around]
    counted(root)
    path: set[int] = set()
    while up.parent is not None and up.parent.density >= threshold:
        up = up.parent
        path.add(id(up))
    # Around the winner each block is kept or not by itself. Outside the article, where there is one, others must be as
    # dense as the path; elsewhere, what isn't mostly links belongs to the text, however short.
    articles = {id(x) for x in above(kept) if x.tag in ("article", "main")}
    inside = lambda x: any(id(y) in articles for y in above(x))
    stack = [(up, bool(articles) and not inside(up))] if path else []
    while stack:
        x, strict = stack.pop()
        items: list[Node | str] = []
        heads: list[Node] = []  # headings go with the block after them
        run: list[Node | str] = []
        for k in [*x.items, None]:
            if isinstance(k, str) or (k is not None and k.tag in INLINE and id(k) not in path and k is not kept):
                run.append(k)
                continue
            if any(not isinstance(i, str) or i.strip() for i in run) and not strict and not mostly_links(run):
                items += [*heads, *run]
                heads.clear()
            run.clear()
            if k is None:
                items += [h for h in heads if h.tag == "h1" or not (strict or mostly_links([h]))]
            elif k.tag in HEADINGS:
                heads.append(k)
            elif not k.chars:
                items.append(k)
            else:
                good = id(k) in path or k is kept or k.density >= threshold or ((not strict or k.tag in ("article", "main")) and not mostly_links([k]))
                items += [h for h in heads if good or h.tag == "h1"]
                heads.clear()
                items.append(k)
                if id(k) in path or not good:
                    stack.append((k, (strict and id(k) not in articles) or not good))
        x.items = items
    return {id(up)}


def main_text(page: str) -> str:
    """The main text, its blocks joined by a line feed."""
    root = parse(page)
    chosen = content(root)
    if not chosen:
        return ""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        x, inside = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                line.append(x)
        else:
            inside = inside or id(x) in chosen
            if x.tag not in INLINE:
                end()
                stack.append((None, inside))
            stack.extend((k, inside) for k in reversed(x.items))
    end()
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def html_text(df: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; pages are independent, so nothing is shuffled.

    Null, empty and unreadable html gives the empty text; repeated rows give a row each. Nothing is cut off or capped.
    An empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
