"""Main text of web pages by composite text density.

Every node of the page's tree has a density: its characters per tag, raised
where little of it is link text and lowered where much is,

    C/T * log(C/L * T/K, base ln(max(1, C/(C-L) * L + B/A * C) + e))

with C characters, T tags, L link characters and K link tags of the node (1 at
least), B and A the link characters and characters of the whole body, with its
navigation. The 1 keeps the density of nodes without links finite. A node's
density sum adds up its children's densities, its text outside of blocks counting
as a child. The node with the largest sum holds the main text; the smallest
density on its way up to the body is the threshold. In every other branch that
reaches it, the node with the largest sum holds main text as well.

Before that only elements, roles and hidden regions are taken away. What classes
and ids are called is a hint that counts against a minor part of a text: a name
that is on most of an article, or around it, says nothing on that page.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced

# ── The page's tree ──────────────────────────────────────────────────

#: Fixed values of HTML: elements without content, elements whose content is no
#: markup, elements that stand inside a line, and those that an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr output q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}),
    "thead": ("tbody thead tfoot tr td th", {"table"}), "tbody": ("tbody thead tfoot tr td th", {"table"}),
    "tfoot": ("tbody thead tfoot tr td th", {"table"}), "option": ("option", {"select"}),
}
#: Elements that are part of a text, not all of it; elements that are part of those.
PARTS = frozenset("section p h1 h2 h3 h4 h5 h6 hgroup ul ol dl table blockquote pre figure details".split())
ITEMS = frozenset("li dt dd tr thead tbody tfoot caption figcaption summary".split())
#: Elements and roles that say what a region is for.
ASIDE = frozenset(
    "nav footer aside form script style noscript iframe template button select textarea input head menu dialog object"
    " svg canvas video audio".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Part of a class of any region, or of an id outside the article.
STRONG = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|sponsor\w*|promo\w*|breadcrumbs?|sidebar\w*|newsletter|subscri\w*|comments|commentlist"
    r"|reader-(?:comments|responses|replies|opinions)|disqus|pagination|pager|widget\w*|cookies?[-_](?:notice|consent|banner|bar|policy|popup|message))(?=$|[-_]|\d)", re.I)
#: Whole class in the article; whole class or id outside of it.
WHOLE = re.compile(r"(?:social|share|sharing|related|comments?|nav|navbar|navigation|menu|toolbar|popup)(?:[-_](?:bar|box"
                   r"|list|links|menu|items?|posts|buttons|container|wrapper|area|block))?\d*", re.I)
#: Whole class or id outside the article. In it, headings, notices and the like are called the same.
OUTSIDE = re.compile(
    r"(?:(?:site|top|global)[-_])?(?:header|masthead|banner)\d*|(?:(?:site|page|main|top|bottom|global|left|right)[-_])?"
    r"(?:footer|foot|nav\w*|menu\w*|side|search|login|cookies?|consent|notices?|alert|modal|recommend\w*|respond|replies"
    r"|copyright|legal)(?:[-_](?:bar|box|list|links|menu|form|items?|container|wrapper|area|block|notice))?\d*", re.I)
#: What a name never takes away: text inside a line, headings, paragraphs and the article itself.
NAMELESS = INLINE | frozenset("html body article main h1 h2 h3 h4 h5 h6 hgroup p blockquote pre".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")


class Node:
    """An element: children are nodes and strings in page order."""

    __slots__ = ("tag", "children", "aside", "names", "chars", "tags", "link_chars", "link_tags", "density", "total", "own", "peak")

    def __init__(self, tag: str, aside: bool = False):
        self.tag, self.aside, self.children = tag, aside, []
        self.names: tuple[str, ...] = ()
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = self.own = 0.0
        self.peak: Node | None = None


def _judged(tag: str, attributes: str, inside: set[str]) -> tuple[bool, tuple[str, ...]]:
    """Whether an element, its role or being hidden says that a region is not part
    of the article, and the names it has that hint at that."""
    if tag in ASIDE or tag == "header" and "article" not in inside and "main" not in inside:
        return True, ()
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, ()
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), entities.unescape("".join(values)))
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True, ()
    if found.get("role", "").strip().lower() in ROLES:
        return True, ()
    if tag in NAMELESS:
        return False, ()
    classes, ids = found.get("class", "").split(), found.get("id", "").split()
    if "article" in inside or "main" in inside:
        # An id in the article is often that of its heading: only a whole one tells.
        tries = [(STRONG.search, classes), (WHOLE.fullmatch, classes), (STRONG.fullmatch, ids)]
    else:
        tries = [(test, classes + ids) for test in (STRONG.search, WHOLE.fullmatch, OUTSIDE.fullmatch)]
    hits = [m[0].strip("-_").lower() for test, words in tries for m in map(test, words) if m]
    return False, tuple(dict.fromkeys(hits))


def settle_names(root: Node) -> None:
    """Make asides of the named regions that are a minor part of a text.

    A text is an article or main element, or else the page. A name counts there
    unless the regions called so hold more than half of its characters; beside an
    article, a name that is not around it always counts. A region around an
    article is never taken away.
    """
    order: list[tuple[Node, Node, Node | None]] = []  # node, its text, its parent
    todo: list = [(root, root, None)]
    while todo:
        node, text, parent = todo.pop()
        order.append((node, text, parent))
        inner = node if node.tag in ("article", "main") else text
        todo += [(c, inner, node) for c in node.children if isinstance(c, Node) and not c.aside and c.tag not in RAW]
    size: dict[int, int] = {}
    around: set[int] = set()  # nodes with an article below them
    for node, _, parent in reversed(order):
        size[id(node)] = size.get(id(node), 0) + sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if parent is not None:
            size[id(parent)] = size.get(id(parent), 0) + size[id(node)]
            if size[id(node)] and (node.tag in ("article", "main") or id(node) in around):
                around.add(id(parent))
    held: dict[tuple[int, str], int] = {}
    under: dict[int, frozenset[str]] = {}  # names of the regions a node lies in
    for node, text, parent in order:
        above = under[id(parent)] if parent is not None else frozenset()
        for name in node.names:
            if name not in above:
                held[id(text), name] = held.get((id(text), name), 0) + size[id(node)]
        under[id(node)] = above.union(node.names) if node.names else above
    for node, text, _ in order:
        if node.names and id(node) not in around:
            elsewhere = text is root and id(root) in around
            node.aside = any(elsewhere or 2 * held[id(text), n] <= size[id(text)] for n in node.names)


def parse(text: str) -> Node:
    """The page's tree. Open elements are ended as browsers do it, roughly: a
    block ends a paragraph, an item its neighbour, a closing tag all it holds;
    a closing tag without its element is dropped."""
    root = Node("html")
    stack = [root]

    def close_to(names, stops) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    at, end = 0, len(text)
    while at < end:
        m = TOKEN.search(text, at)
        start = m.start() if m else end
        if start > at:
            stack[-1].children.append(entities.unescape(text[at:start]))
        if not m:
            break
        at = max(m.end(), start + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                # A closing inline tag does not reach out of the block it is in.
                close_to((tag,), ENDS_PARAGRAPH if tag in INLINE else ("table",) if tag not in ("table",) else ())
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_PARAGRAPH:
            close_to(("p",), {"button", "table", "td", "th"})
        if tag in SIBLINGS:
            names, stops = SIBLINGS[tag]
            close_to(names.split(), stops)
        if tag == "a":
            close_to(("a",), ENDS_PARAGRAPH)
        aside, names = _judged(tag, m[3], {n.tag for n in stack})
        node = Node(tag, aside)
        node.names = names
        stack[-1].children.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            if tag == "noscript" or tag == "template" or not closing:
                at = closing.end() if closing else end
                continue
            node.children.append(text[at:closing.start()])
            at = closing.end()
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    settle_names(root)
    return root


# ── Density ──────────────────────────────────────────────────────────


def _in_order(root: Node) -> list[Node]:
    """Parents before children, without recursion and without asides."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.aside and c.tag not in RAW]
    return out


def _link_share(root: Node) -> float:
    """Share of link text in the characters of the whole page, asides included."""
    chars = links = 0
    todo = [(root, False)]
    while todo:
        node, linked = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                size = len("".join(child.split()))
                chars += size
                links += size * linked
            elif child.tag not in RAW:
                todo.append((child, linked or child.tag == "a"))
    return links / max(1, chars)


def _density(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    tags = max(1, tags)
    inner = chars / max(1, links) * (tags / max(1, link_tags))
    base = math.log(max(1.0, chars / max(1, chars - links) * links + share * chars) + math.e)
    return chars / tags * math.log(inner, base) if inner > 1 else 0.0


def measure(root: Node) -> list[Node]:
    """Fill in densities, density sums and the node of the largest sum in each
    subtree (``peak``; none without a block that holds text); returns the nodes,
    parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.aside and child.tag not in RAW:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = _link_share(root)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in reversed(nodes):
        within = [c for c in node.children if isinstance(c, Node) and not c.aside and c.tag not in RAW]
        # What stands in the node itself, outside its blocks, is a block of its own.
        loose = [c for c in within if c.tag in INLINE or c.tag in VOID]
        chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.own = _density(
            chars + sum(c.chars for c in loose), sum(c.tags + 1 for c in loose), sum(c.link_chars for c in loose),
            sum(c.link_tags + (c.tag == "a") for c in loose), share)
        node.total = sum(c.density for c in within if c.tag not in INLINE) + (node.own if node.tag not in INLINE else 0.0)
        peaks = [c.peak for c in within if c.peak is not None]
        if node.chars and (peaks or node.tag not in INLINE):
            node.peak = max([node, *peaks], key=lambda n: n.total)
    return nodes


def main_nodes(root: Node) -> tuple[set[int], set[int], float]:
    """The ids of the nodes that hold the main text, those of all nodes above
    them, and the least density on the way from the first one up to the body.

    The first is the node with the largest density sum (the outermost, then first
    of equals). The others are the nodes with the largest density sum in every
    other branch that reaches the threshold.
    """
    nodes = measure(root)
    parents = {id(c): n for n in nodes for c in n.children if isinstance(c, Node)}
    taken: set[int] = set()
    above: set[int] = set()

    def take(node: Node) -> None:
        taken.add(id(node))
        while id(node) in parents and id(parents[id(node)]) not in above:
            node = parents[id(node)]
            above.add(id(node))

    best = node = max(nodes, key=lambda n: n.total)
    # An item is part of its list, and a row of its table.
    while best.tag in ITEMS and id(best) in parents:
        best = parents[id(best)]
    # An article that the largest node lies in is the article as a whole.
    while id(node) in parents:
        node = parents[id(node)]
        if node.tag == "article":
            best = node
    if best is root:
        # The body as a whole says nothing; the markup may.
        for tag in ("main", "article"):
            if some := [n for n in nodes if n.tag == tag and n.chars]:
                best = max(some, key=lambda n: n.chars)
                break
    take(best)
    # Parts of a text stay together: those beside a section, list, table or quotation.
    if best.tag in PARTS and id(best) in parents:
        for node in parents[id(best)].children:
            if isinstance(node, Node) and not node.aside and node.tag in PARTS and 2 * node.link_chars <= node.chars:
                take(node)
    least, node = best, best
    while id(node) in parents:
        node = parents[id(node)]
        least = node if node.chars and node.density < least.density else least
    per_tag = least.chars / max(1, least.tags)
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in taken:
            continue
        if id(node) not in above:
            # Without links the log tells size only, so the characters per tag decide.
            if node.density < least.density and (node.link_chars or node.chars / max(1, node.tags) < per_tag):
                continue
            take(node.peak)
        todo += [c for c in node.children if isinstance(c, Node) and not c.aside and c.peak is not None]
    return taken, above, least.density


def blocks(root: Node, taken: set[int], above: set[int], threshold: float) -> list[str]:
    """The texts of the blocks of all taken nodes in page order, without asides.
    What stands beside taken nodes outside any block stays if it reaches the
    threshold."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list = [(root, False)]
    while todo:
        at, keep = todo.pop()
        if at is None:
            end()
        elif isinstance(at, str):
            if keep:
                line.append(at)
        elif at.tag == "br":
            line.append(" ")
        elif not (at.aside or at.tag in RAW):
            block = at.tag not in INLINE and at.tag not in VOID
            inside = id(at) in taken
            if not inside and id(at) in above:
                if block:
                    end()
                    todo.append((None, False))
                loose = at.own >= threshold if block else keep
                todo += reversed([(c, loose and (isinstance(c, str) or c.tag in INLINE)) for c in at.children])
                continue
            if not inside and not keep:
                continue
            if block:
                end()
                todo.append((None, False))
            todo += reversed([(c, True) for c in at.children])
    end()
    return out


def extract(page: str | None) -> str:
    """Main text of a page: its blocks, each with white space as single spaces,
    joined by one space."""
    if not page:
        return ""
    root = parse(page)
    return " ".join(blocks(root, *main_nodes(root)))


# ── Job ──────────────────────────────────────────────────────────────


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page's whole html.

    Null, empty and textless pages have the text "" of 0 code points. Ids and
    urls are passed through, null or repeated as they are. An empty table gives no
    rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [extract(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = picked(pages, page_id=page_id, url=url, html=html)
    return rows.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
