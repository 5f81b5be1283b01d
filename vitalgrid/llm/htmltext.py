"""HTML extraction (operator 1) by composite text density."""

from __future__ import annotations

import bisect
import html
import re
from array import array
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched

#: Elements whose text never shows or never belongs to an article.
DROPPED = frozenset("script style noscript template head title svg math canvas iframe object embed audio video map form button select textarea input option label fieldset nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag closes by itself, within the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
_SCOPE = BLOCKS - {"p"} | {"td", "th"}
_P, _A = frozenset("p"), frozenset("a")
CLOSES = {tag: (frozenset(what), frozenset(bounds)) for tag, (what, bounds) in CLOSES.items()}

#: Words of class, id and role that mark what stands around an article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|breadcrumbs?|cookies?|consent|gdpr|notice|alert|newsletter|subscri\w*|popup|modal|overlay|paywall|"
    r"nav\w*|menu\w*|sidebar\w*|side|widget\w*|footer|foot|header|masthead|topbar|toolbar|pagination|pager|related|recommend\w*|share|sharing|social\w*|"
    r"comments?|commentlist|respond|reply|replies|disqus|discussion|login|signup|search\w*|complementary|contentinfo|navigation|skip\w*|copyright|legal|disclaimer|tags?|taglist|hidden)(?:$|[\s_-])",
    re.I,
)
#: Marks of what readers wrote; it is no wrapper of an article even where it is most of a page.
ANSWERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|reply|replies|disqus)(?:$|[\s_-])", re.I)
#: Words of a layout that say what stands beside, such as no-sidebar.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without)[_-]\w+", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OTHER = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
#: A tag whose quotes are all closed; once one is not, the page is read by ``Markup``'s own tables.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME, _SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    noise: bool = False
    answers: bool = False
    hidden: bool = False
    parts: list = field(default_factory=list)  # texts and child nodes in page order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


class Markup:
    """Where the tags of a page are; every part of the page is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.specials: array | None = None  # brackets and quotes, from the first tag on that is not well formed
        self.ends: dict[int, int] = {}  # a bracket or quote outside of quotes -> where its tag ends, -1 if in a quote that is never closed
        self.name = (0, -1)  # from, to: the next end of a name for all places between

    def _after_name(self, at: int) -> int:
        if not self.name[0] <= at <= self.name[1]:
            m = _NAME.search(self.page, at)
            self.name = (at, m.start() if m else len(self.page))
        return self.name[1]

    def _end(self, at: int) -> int:
        """The end of a tag whose attributes begin at ``at``: behind the next bracket outside of quotes, or the page's end."""
        page, passed, end = self.page, [], None
        while end is None:
            k = bisect.bisect_left(self.specials, at)
            if k == len(self.specials):
                end = len(page)
            elif (at := self.specials[k]) in self.ends:
                end = self.ends[at]
            elif page[at] == ">":
                end = at + 1
            else:
                passed.append(at)
                close = page.find(page[at], at + 1)
                if close < 0:
                    end = -1
                at = close + 1
        for x in passed:
            self.ends[x] = end
        return end

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """(begin, end, name, closing, attributes) of the next tag from ``at``; other markup has no name, the page's end begins where it ends."""
        page, n = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            if page[at + 1 : at + 2] in ("!", "?"):
                m = _OTHER.match(page, at)
                return at, m.end(), None, False, ""
            if self.specials is None and (m := _TAG.match(page, at)):
                return at, m.end(), m[2].lower(), bool(m[1]), m[3]
            begin = at + 1 + (page[at + 1 : at + 2] == "/")
            if page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha():
                if self.specials is None:
                    self.specials = array("q", (m.start() for m in _SPECIAL.finditer(page)))
                to = self._after_name(begin + 1)
                end = self._end(to)
                if end >= 0:
                    return at, end, page[begin:to].lower(), begin > at + 1, page[to : end - (page[end - 1] == ">")]
            at += 1
        return n, n, None, False, ""


class Open:
    """The open elements of a page, outermost first, with the depths of each kind."""

    def __init__(self, root: Node):
        self.path, self.depths = [root], {}
        self.groups: dict[frozenset[str], list[int]] = {BLOCKS: [], _SCOPE: []}  # depths of the large kinds together

    @property
    def node(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        depth = len(self.path)
        self.depths.setdefault(node.tag, []).append(depth)
        for tags, depths in self.groups.items():
            if node.tag in tags:
                depths.append(depth)
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Close all from ``depth`` on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            for tags, depths in self.groups.items():
                if tag in tags:
                    depths.pop()

    def deepest(self, tags) -> int:
        if tags in self.groups:
            return self.groups[tags][-1] if self.groups[tags] else 0
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def end(self, what: frozenset[str], bounds: frozenset[str]) -> None:
        """Close from the outermost of ``what`` that is open below the nearest bound (of paragraphs: the innermost)."""
        last = self.deepest(what)
        if not last or (bound := self.deepest(bounds)) > last:
            return
        if "p" in what:
            return self.cut(last)
        first = [d[i] for t in what if (d := self.depths.get(t)) and (i := bisect.bisect_right(d, bound)) < len(d)]
        self.cut(min(first))

    def close(self, tag: str) -> None:
        """An end tag: the innermost such element; one of formatting does not close blocks, a stray one nothing."""
        depth = d[-1] if (d := self.depths.get(tag)) else 0
        if depth and not (tag in FORMATTING and self.deepest(BLOCKS) > depth):
            self.cut(depth)


def parse(page: str) -> Node:
    """The tree of a page, with omitted end tags closed as browsers do for paragraphs, items and cells."""
    root = Node("html", None)
    marks, here, body = Markup(page), Open(root), False
    at, n = 0, len(page)
    while at < n:
        begin, end, tag, closing, attributes = marks.next(at)
        if begin > at:
            here.node.parts.append(page[at:begin])
        at = end
        if tag is None:
            if page.startswith("<![CDATA[", begin):
                here.node.parts.append(html.escape(page[begin + 9 : end].removesuffix("]]>"), False))
            continue
        if closing:
            here.close(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body:
                here.cut(1)
                here.push(_open(root, tag, ""))
                body = True
            continue
        if tag in BLOCKS:
            here.end(_P, _SCOPE)
        if tag in CLOSES:
            here.end(*CLOSES[tag])
        elif tag == "a":
            here.end(_A, BLOCKS)
        child = _open(here.node, tag, attributes)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>|</{re.escape(tag)}$", re.I).search(page, at)
            child.parts.append(page[at : stop.start() if stop else n])
            at = stop.end() if stop else n
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCKS or tag in FORMATTING:
            here.push(child)
    return root


def _open(parent: Node, tag: str, attributes: str) -> Node:
    child = Node(tag, parent)
    if attributes.strip(" /"):
        for k, *v in _ATTR.findall(attributes):
            k, value = k.lower(), html.unescape("".join(v))
            if k in ("class", "id", "role") and NOISE.search(value := _LAYOUT.sub("", value.replace(":", " "))):
                child.noise = True
                child.answers = child.answers or bool(ANSWERS.search(value))
            elif k == "hidden" or (k == "aria-hidden" and value.lower() == "true"):
                child.hidden = True
            elif k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                child.hidden = True
    parent.parts.append(child)
    return child


def _walk(root: Node) -> list[Node]:
    """Nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _without(nodes: list[Node], gone) -> None:
    for node in nodes:
        node.parts = [x for x in node.parts if not isinstance(x, Node) or not gone(x, node)]


def prune(root: Node) -> None:
    """Take out what cannot be article text: by element, and by marks where little of the page's unlinked text goes.

    A header stays inside article or main. A marked subtree or a form stays if it wraps most of the text (of comments: nearly all,
    of a form: a quarter), if it is a heading, or if it is a titled section of an article that is not mostly
    links. If marks would leave no text, none of them counts.
    """
    story: dict[int, bool] = {}
    nodes = _walk(root)
    for node in nodes:
        story[id(node)] = node.tag in ("article", "main") or (node.parent is not None and story[id(node.parent)])
    _without(nodes, lambda x, node: x.hidden or (x.tag in DROPPED and x.tag != "form") or (x.tag == "header" and not story[id(node)]))
    nodes = _count(root)
    whole = root.chars - root.link_chars
    titled: dict[int, int] = {}  # the highest rank of a heading below a node
    for node in reversed(nodes):
        titled[id(node)] = min((int(x.tag[1]) if x.tag in HEADINGS else titled[id(x)] for x in node.parts if isinstance(x, Node)), default=9)

    def gone(x: Node, node: Node) -> bool:
        if not (x.noise or x.tag == "form") or x.tag in HEADINGS or x.tag in ("html", "body", "main", "article"):
            return False
        plain = x.chars - x.link_chars
        if x.answers:
            return 10 * plain < 9 * whole
        if 2 * plain > whole or (x.tag == "form" and not x.noise and 4 * plain >= whole):
            return False
        own = story[id(node)] and 2 * x.link_chars < x.chars and (titled[id(x)] == 1 or (x.tag == "section" and titled[id(x)] < 9))
        return not own

    out = {id(x) for node in nodes for x in node.parts if isinstance(x, Node) and gone(x, node)}
    left, stack = 0, [root]
    while stack:
        node = stack.pop()
        left += sum(len(x.split()) for x in node.parts if isinstance(x, str))
        stack.extend(x for x in node.parts if isinstance(x, Node) and id(x) not in out)
    if left:
        _without(nodes, lambda x, node: id(x) in out)


def _count(root: Node) -> list[Node]:
    """Characters and tags of every node, in all and in links; the nodes, parents first."""
    nodes = _walk(root)
    for node in reversed(nodes):
        own = sum(sum(map(len, (html.unescape(x) if "&" in x else x).split())) for x in node.parts if isinstance(x, str))
        children = [x for x in node.parts if isinstance(x, Node)]
        node.chars = own + sum(x.chars for x in children)
        node.tags = sum(x.tags + 1 for x in children)
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        else:
            node.link_chars = sum(x.link_chars for x in children)
            node.link_tags = sum(x.link_tags + (x.tag == "a") for x in children)
    return nodes


def score(root: Node) -> list[Node]:
    """Composite text density of every node, and the sum over its children.

    With C characters, T tags, C_l and T_l of them in links, the density of a node is the number of
    characters a tag, weighed down by a logarithm whose argument grows with C/C_l · T/T_l and whose
    base grows with the page's share of link text.
    """
    from math import e, log

    nodes = _count(root)
    body_c, body_l = max(1, root.chars), root.link_chars
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        if c:
            plain = max(c - lc, 0)
            base = log(c / max(1, plain) * lc + body_l / body_c * c + e)
            node.density = c / t * log(max(1.0, c / max(1, lc) * (t / max(1, lt)))) / max(base, 1e-9)
        node.density_sum = sum(x.density for x in node.parts if isinstance(x, Node))
    return nodes


def _above(node: Node) -> list[Node]:
    out = []
    while (node := node.parent) is not None:
        out.append(node)
    return out


def _within(node: Node, tags: tuple[str, ...]) -> bool:
    return any(x.tag in tags for x in _above(node))


def _teaser(node: Node) -> bool:
    """Whether the first heading is a link: the text goes on elsewhere."""
    head = next((x for x in _walk(node) if x.tag in HEADINGS and x.chars), None)
    return head is not None and (head.link_chars == head.chars or any(x.tag == "a" for x in _above(head)))


def main_node(root: Node) -> list[Node]:
    """The subtrees that hold the article.

    Where outermost article and main elements hold half of the unlinked text or more, the largest is taken, with those others
    that are as dense as the path to it and neither mostly links nor, beside a full article, teasers under a linked
    title. Otherwise the node with the largest density sum is taken. The threshold is the smallest density on the path
    from the body to it: siblings of the path that reach it and hold plain text belong too,
    which keeps an article together that is split over several containers.
    """
    nodes = score(root)
    plain = lambda x: x.chars - x.link_chars
    marked = [x for x in nodes if x.tag in ("article", "main") and x.chars and not _within(x, ("article", "main"))]
    if marked and 2 * sum(map(plain, marked)) >= plain(root):
        top = max(marked, key=lambda x: (plain(x), x.density_sum))
        least = min(x.density for x in (top, *_above(top)) if x.tag != "html" or x is root)
        return [x for x in marked if x is top or (x.density >= least and 2 * x.link_chars <= x.chars and (_teaser(top) or not _teaser(x)))]
    best = max(nodes, key=lambda x: x.density_sum)
    path, at = [], best
    while at is not None:
        path.append(at)
        at = at.parent
    threshold = min((x.density for x in path if x.tag not in ("html",)), default=0.0)
    # The highest node of the path that adds only dense content.
    top = best
    for up in path[1:]:
        others = [x for x in up.parts if isinstance(x, Node) and x is not top and x.chars]
        loose = sum(len(x.strip()) for x in up.parts if isinstance(x, str))
        if up.tag in ("html",) or any(x.density < threshold or 2 * x.link_chars > x.chars for x in others if x.tag not in ("h1", "h2", "h3", "br", "hr")):
            break
        if not others and not loose and up.tag == "body":
            break
        top = up
    return [top]


def blocks(node: Node) -> list[str]:
    """The texts of a subtree's blocks in page order: references decoded, white space made single, trimmed."""
    out: list[list[str]] = [[]]
    stack: list = [(node, False)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            out[-1].append(html.unescape(x) if "&" in x else x)
        elif done:
            out.append([])
        else:
            block = x.tag in BLOCKS
            if block:
                out.append([])
                stack.append((x, True))
            elif x.tag == "br":
                out[-1].append(" ")
            stack.extend((y, False) for y in reversed(x.parts))
    lines = (" ".join("".join(x).split()) for x in out)
    return [x for x in lines if x]


def main_text(page: str | None) -> str:
    """The article of a page as lines; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(line for node in main_node(root) for line in blocks(node))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null, empty or textless page has an empty text. Broken markup is read as browsers do for
    the common cases; character references are decoded once. Rows are independent: repeated rows
    and null ids give a row each, other columns are ignored, nothing is moved or cut.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return batched(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
