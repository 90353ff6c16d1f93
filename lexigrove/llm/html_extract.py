"""Main text of web pages by tree scoring.

The page is read into a light element tree.  Boilerplate elements (by tag, role, or
class and id words) leave the tree first.  Each text block then gives points for its
length and commas to its parent and, halved and so on, to further ancestors; a
container's points are discounted by its link density.  The best container is kept, or
the whole article or main element around it, with those siblings that score enough or
read like prose, and its blocks are emitted in page order.

Defined results for odd input: null or empty html gives empty text; markup that never
closes is closed at the end; a page with no scoring container falls back to the whole
body; repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, table

#: Quantifiers are possessive: a tag that never closes fails at once instead of being tried in every length.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^<>])*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
_SPACE = re.compile(r"\s+")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
SKIP = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math head nav footer aside form button select option datalist object audio video canvas dialog menu map embed input".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr header footer nav aside form fieldset details summary center hgroup search".split())
CLOSES_P = BLOCK - {"html", "body"}
CELLS = frozenset({"td", "th", "table"})
#: End tags that reach out of a table's parts.
LEAVES_CELL = frozenset("table tr tbody thead tfoot body html article main div section".split())
KEEP_ROOT = frozenset({"html", "body", "article", "main"})
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar advertisement".split())
BAD_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adbox|adslot|banner|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|sidebar|footer|"
    r"comments?|commentlist|disqus|discussion|replies|reply|respond|related|recommended|newsletter|subscribe|signup|login)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words that also name parts of a layout: what they mark stays if it holds most of the page's text.
WEAK_WORD = re.compile(r"(?:^|[\s_-])(?:notice|aside|side|foot|share|sharing|social|follow|widget|skip)(?:$|[\s_-]|\d)", re.I)
#: Classes of an article element that make it a reader's comment.
COMMENT = frozenset({"comment", "comments", "reply", "replies"})
#: Words that mark a page's head, but inside an article its own heading.
HEAD_WORD = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|head|brand|logo)(?:$|[\s_-]|\d)", re.I)
#: A container named like boilerplate stays if it holds the article, or nearly all of the text; one with a weak name if it holds most.
NEARLY_ALL = 0.8
MOST = 0.5


class _Node:
    __slots__ = ("tag", "parent", "children", "score", "hidden", "suspect", "chars", "link_chars", "commas", "holds_main", "depth", "block", "cell")

    def __init__(self, tag: str, parent: "_Node | None", hidden: bool):
        self.tag, self.parent, self.hidden = tag, parent, hidden
        self.children: list = []
        self.score = 0.0
        self.chars = self.link_chars = self.commas = 0
        self.suspect = 0.0
        self.holds_main = False
        self.depth = parent.depth + 1 if parent is not None else 0
        #: Nearest block element and nearest part of a table, the element itself included.
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.cell = self if tag in CELLS else parent.cell if parent is not None else None


def _found(attrs: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs else {}


def _is_boilerplate(tag: str, attrs: str, found: dict[str, str], inside_main: bool) -> bool:
    """Elements that never hold main text, by tag, role or visibility."""
    if tag in SKIP:
        return True
    if tag == "header":  # an article may head its own text; a page header may not
        return not inside_main
    if not attrs or tag in KEEP_ROOT:
        return False
    if found.get("role", "").strip().lower() in BAD_ROLE or found.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", attrs) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def _suspicion(tag: str, found: dict[str, str], inside_main: bool) -> float:
    """Share of the page's text from which an element stays although it is named like boilerplate; 0 if it is not."""
    if not found or tag in KEEP_ROOT and tag != "article":
        return 0.0
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if tag == "article":
        return NEARLY_ALL if not COMMENT.isdisjoint(names.lower().split()) else 0.0
    if BAD_WORD.search(names):
        return NEARLY_ALL
    return MOST if WEAK_WORD.search(names) or (not inside_main and HEAD_WORD.search(names)) else 0.0


def _drop_suspects(root: _Node) -> bool:
    """Takes suspects out of the tree unless they hold the article or enough of the text; tells whether any went."""
    went, stack, whole = False, [root], root.chars
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, _Node):
                if child.suspect and (not child.holds_main or child.tag == "article") and child.chars < child.suspect * whole:
                    went = True
                    if child.tag in BLOCK:
                        kept.append(_Node("hr", node, False))
                    continue
                stack.append(child)
            kept.append(child)
        node.children = kept
    return went


#: What ends with the start of each element, if it is the nearest open block.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _closes_itself(tag: str, attrs: str) -> bool:
    """A slash at the end counts unless it belongs to a value without quotes."""
    return tag in VOID or (attrs.endswith("/") and not re.search(r"=\s*+[^\s\"'>][^\s>]*$", attrs[-300:]))


def _parse(source: str) -> _Node:
    """Element tree; children are nodes or decoded strings."""
    root = node = _Node("#root", None, False)
    at, end, main_depth = 0, len(source), 0
    opened: dict[str, list[_Node]] = {}

    def leave(to: _Node) -> None:
        """Closes everything that is open below ``to``."""
        nonlocal node, main_depth
        while node is not to:
            opened[node.tag].pop()
            main_depth -= node.tag in ("article", "main")
            node = node.parent

    while at < end:
        match = _TAG.search(source, at)
        if match is None:
            rest = source[at:]
            closed = rest.rfind(">") + 1
            cut = re.search(r"<[a-zA-Z/!]", rest[closed:])  # a tag that the end of the page cuts short is no text
            if not node.hidden:
                node.children.append(_html.unescape(rest[: closed + cut.start()] if cut else rest))
            break
        if match.start() > at and not node.hidden:
            node.children.append(_html.unescape(source[at : match.start()]))
        at = match.end()
        if match[3] is None:
            if match[1] is not None and not node.hidden:
                node.children.append(match[1])
            continue
        tag = match[3].lower()
        if match[2]:  # an end tag closes the nearest open element of its name, if there is one
            same = opened.get(tag)
            if same and (tag in LEAVES_CELL or tag in CELLS or node.cell is None or node.cell.depth <= same[-1].depth):
                leave(same[-1].parent)
            elif tag == "p" and not node.hidden:
                node.children.append(_Node("p", node, False))
            continue
        if tag in CLOSES_P:  # an open paragraph, with its unclosed inline elements, ends where a block begins
            up = node.block
            if up.tag == "p" or up.tag in _ENDS.get(tag, ()):
                leave(up.parent)
            elif tag == "tr" and up.tag in ("td", "th"):
                leave(up.parent.parent if up.parent.tag == "tr" else up.parent)
        if tag == "br":
            if not node.hidden:
                node.children.append(" ")
            continue
        found = _found(match[4]) if not node.hidden else {}
        hidden = node.hidden or _is_boilerplate(tag, match[4], found, main_depth > 0)
        if tag in RAW:
            if _closes_itself(tag, match[4]) and tag not in ("script", "style"):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        child = _Node(tag, node, hidden)
        if not hidden:
            child.suspect = _suspicion(tag, found, main_depth > 0)
            node.children.append(child)
        if _closes_itself(tag, match[4]):
            continue
        main_depth += tag in ("article", "main")
        opened.setdefault(tag, []).append(child)
        node = child
    return root


def _measure(root: _Node) -> None:
    """Characters, characters in links and commas below each node, without recursion."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, _Node))
    for node in reversed(order):
        node.chars = node.link_chars = node.commas = 0
        node.holds_main = node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, _Node):
                node.holds_main |= child.holds_main
                node.chars += child.chars
                node.link_chars += child.link_chars
                node.commas += child.commas
            else:
                text = child.strip()
                node.chars += len(text)
                node.commas += text.count(",") + text.count("，") + text.count("、")
        if node.tag == "a":
            node.link_chars = node.chars


def _density(node: _Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _score(root: _Node) -> dict[int, _Node]:
    """Paragraphs pass points to their ancestors: whole to the parent, half to the next, then a third of it by depth."""
    scored: dict[int, _Node] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        inner = [c for c in node.children if isinstance(c, _Node)]
        stack.extend(inner)
        own = sum(len(c.strip()) for c in node.children if not isinstance(c, _Node))
        own += sum(c.chars for c in inner if c.tag not in BLOCK)
        if node.tag not in BLOCK or node.tag in ("html", "body") or own < 1:
            continue
        points = 1.0 + node.commas + min(own / 100.0, 3.0)
        points *= 1.0 - _density(node)
        if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "th"):
            points *= 0.5
        if node.tag in ("li", "dd", "dt"):
            points *= 0.5
        up, share = node.parent if node.tag not in ("article", "main", "section", "div") else node, 1.0
        for level in range(1, 6):
            if up is None or up.tag == "#root":
                break
            up.score += points * share
            scored[id(up)] = up
            share = 0.5 if level == 1 else share / 1.5
            up = up.parent
    for node in scored.values():
        if node.tag in ("article", "main"):
            node.score = node.score * 1.5 + 25
        elif node.tag in ("html", "body"):
            node.score *= 0.6
        node.score *= 1.0 - _density(node)
    return scored


def _blocks(node: _Node, out: list[str]) -> None:
    """Texts of the blocks below ``node`` in page order; one block ends where a block element starts or ends."""
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [(node, iter(node.children))]
    while stack:
        current, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if current.tag in BLOCK:
                flush()
        elif isinstance(child, _Node):
            if child.tag in BLOCK:
                flush()
            stack.append((child, iter(child.children)))
        else:
            run.append(child)
    flush()


def _whole(best: _Node) -> _Node:
    """The outermost article around ``best``, else the outermost main, else ``best``: a part never stands for its article."""
    found = {}
    up: _Node | None = best
    while up is not None:
        found[up.tag] = up
        up = up.parent
    return found.get("article") or found.get("main") or best


def _peaks(root: _Node) -> dict[int, float]:
    """The best score in each element's subtree."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, _Node))
    found: dict[int, float] = {}
    for node in reversed(order):
        found[id(node)] = max([node.score, *(found[id(c)] for c in node.children if isinstance(c, _Node))])
    return found


def _neighbours(best: _Node, root: _Node) -> list[_Node]:
    """``best`` and what belongs to it beside it and beside its ancestors, in page order."""
    peaks, floor = _peaks(root), best.score * 0.2
    keep, node = [best], best
    while node.parent is not None and node.tag not in ("body", "html"):
        before, after, seen = [], [], False
        for sibling in node.parent.children:
            if sibling is node:
                seen = True
                continue
            if not isinstance(sibling, _Node) or not sibling.chars:
                continue
            density = _density(sibling)
            prose = sibling.tag == "p" and sibling.chars > 80 and density < 0.25
            heading = sibling.tag in ("h1", "h2") and density < 0.3
            if (peaks[id(sibling)] >= floor and density < 0.5) or prose or heading:
                (after if seen else before).append(sibling)
        keep = [*before, *keep, *after]
        node = node.parent
    return keep


def extract_text(source: str | None) -> str:
    """Main text of one page; blocks joined by an empty line."""
    if not source:
        return ""
    root = _parse(source)
    _measure(root)
    if _drop_suspects(root):
        _measure(root)
    scored = _score(root)
    parts: list[str] = []
    if not scored:
        _blocks(root, parts)
        return "\n\n".join(parts)
    for node in _neighbours(_whole(max(scored.values(), key=lambda n: n.score)), root):
        _blocks(node, parts)
    return "\n\n".join(parts)


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``; n_chars counts code points.  No shuffle."""

    def run(batch):
        texts = [extract_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), run, SCHEMA)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
