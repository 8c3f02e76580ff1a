"""Operator 5: main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, which
keep less of them the farther away they are and the more of their text stands in
links. The container with most points is the article, or the <article> or <main> around
it, which is kept whole; siblings that score well or are plain prose are kept with it. Menus, adverts, comments and the like are
taken out of the tree before, by their elements and by words in their names. Of a
header inside an article only the headings stay; a form that the whole page or
its article stands in is a wrapper and stays.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements of HTML by what they mean for the text.
SKIPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object embed svg math canvas audio video dialog menu".split())
IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: These end an open paragraph and are what points come from.
PARAGRAPHS = frozenset("p pre blockquote li td dd".split())
#: These are kept beside the best container whatever their length.
PROSE = frozenset("p pre blockquote ul ol dl table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in a class, an id or a role that mark what isn't the article.
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adbox|adslot|sponsor(?:ed|s)?|promos?|banners?|cookies?|cookiebar|consent|notices?|alerts?|popups?|modal|newsletter|subscribe|"
    r"share|sharing|social|nav|navbar|navigation|sidenav|menus?|breadcrumbs?|pagination|pager|sidebars?|side|aside|widgets?|related|recommended|footer|foot|copyright|masthead|topbar|header|"
    r"comments?|commentlist|disqus|replies|reply|respond|login|signup|search|skip|toolbar|tags|complementary|contentinfo|forms?)(?:$|[\s_-]|\d)",
    re.I,
)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?:$|[\s_-]|\d)", re.I)
SPACE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ELEMENTS = SKIPPED | IN_HEAD | VOID | BLOCKS | INLINE | frozenset("body fieldset legend optgroup option picture frame frameset slot".split())
#: What the page's end cuts off: a tag or comment, or a text with a less-than sign.
CUT = re.compile(r"<(?:[!?/][^<>]*|([a-zA-Z][a-zA-Z0-9-]*)[^<>]*)?\Z")
#: An end tag inside one of these doesn't close what is open outside of it, unless it is of a block.
BARRIERS = frozenset("td table article nav footer aside main form".split())
#: Ancestors that a paragraph passes points to.
LEVELS = 4


class Node:
    __slots__ = ("children", "hidden", "links", "name", "names", "parent", "points", "size")

    def __init__(self, name, names="", parent=None, hidden=False):
        self.name, self.names, self.parent, self.hidden = name, names, parent, hidden
        self.children, self.points, self.size, self.links = [], 0.0, 0, 0


class _Tree(HTMLParser):
    """A tree of elements and strings in page order; end tags that are left out are put in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")
        #: How many elements are open, by name: in all, and since each open barrier.
        self.open, self.inner = Counter(), [Counter()]

    def _enter(self, node):
        self.at = node
        self.open[node.name] += 1
        if node.name in BARRIERS:
            self.inner.append(Counter())
        self.inner[-1][node.name] += 1

    def _leave(self, upto):
        """Close elements up to and with the given one."""
        while True:
            node = self.at
            self.at = node.parent
            self.open[node.name] -= 1
            self.inner[-1][node.name] -= 1
            if node.name in BARRIERS:
                self.inner.pop()
            if node is upto:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._close_head()
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            self._close_upto({"p"}, {"article", "section", "div", "td", "th", "li", "main", "blockquote", "body"})
        if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
            same = {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}
            self._close_upto(same, {"ul", "ol", "dl", "table", "tbody", "thead"} | ({"tr"} if tag in ("td", "th") else set()))
        held = dict(attrs)
        names = " ".join(held.get(k) or "" for k in ("class", "id", "role"))
        node = Node(tag, names, self.at, self._unwanted(tag, names, held))
        self.at.children.append(node)
        if tag not in VOID:
            self._enter(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _unwanted(self, tag, names, held):
        if tag in SKIPPED or "hidden" in held or (held.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", held.get("style") or "", re.I):
            return True
        if tag == "header":
            return not (self.open["article"] or self.open["main"])
        return tag not in ("article", "main", "body", "p") and tag not in HEADINGS and bool(UNWANTED.search(names)) or tag == "p" and bool(UNWANTED.search(names))

    def _open(self):
        node = self.at
        while node is not None:
            yield node
            node = node.parent

    def _close_upto(self, names, stop):
        if not any(self.open[n] for n in names):
            return
        for node in self._open():
            if node.name in names:
                self._leave(node)
                return
            if node.name in stop or node.parent is None:
                return

    def _close_head(self):
        """A head ends where something comes that can't stand in it; templates and the like can hold anything."""
        if not self.open["head"]:
            return
        for node in self._open():
            if node.name in ("template", "noscript"):
                return
            if node.name == "head":
                self._leave(node)
                return

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        if tag not in BLOCKS and tag not in SKIPPED and not self.inner[-1][tag]:
            return
        for node in self._open():
            if node.name == tag:
                self._leave(node)
                return

    def handle_data(self, data):
        if self.at.name == "head" and not data.isspace():
            self._close_head()
        self.at.children.append(data)


def parse(page: str) -> Node:
    tree = _Tree()
    cut = CUT.search(page, max(0, page.rfind("<")))
    if cut and cut[1] and cut[1].lower() not in ELEMENTS:
        page, cut = f"{page[: cut.start()]}&lt;{page[cut.start() + 1 :]}", None  # no tag: a less-than sign in the text
    tree.feed(page[: cut.start()] if cut else page)
    tree.close()
    _unhide(tree.root)
    return tree.root


def _unhide(root: Node) -> None:
    """A wrapper of the whole article is kept, whatever its names say.

    So is a form or a header that most of the page's prose stands in; of other headers only the headings stay.
    """
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    holds, prose, wraps = set(), {}, {}
    for node in reversed(order):
        if node.name in ("article", "main") or node in holds:
            if node in holds and node.hidden and node.name in ("div", "section", "span", "form", "header"):
                node.hidden = False
            if node.parent is not None and not node.hidden:
                holds.add(node.parent)
        # characters of paragraphs, those in forms too
        inner = sum(prose.pop(id(c), 0) for c in node.children if isinstance(c, Node))
        inner += sum(len(c) for c in node.children if isinstance(c, str)) if node.name in PARAGRAPHS else 0
        prose[id(node)] = 0 if node.hidden and node.name != "form" or node.name == "a" else inner
        if node.name in ("form", "header"):
            wraps[node] = inner
    for node in reversed(wraps):
        wrapper = 2 * wraps[node] > prose[id(root)]
        if node.name == "form" and node.hidden and wrapper and root not in holds:
            node.hidden = False
        if node.name == "header" and not node.hidden and not wrapper:
            _headings_only(node)


def _headings_only(header: Node) -> None:
    stack = [header]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, Node)]
        stack.extend(c for c in node.children if c.name not in HEADINGS)


def _walk(root: Node):
    """Nodes that aren't hidden, children after their parents."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.hidden)


def score(root: Node) -> None:
    """Sizes, characters in links, and points of all nodes."""
    nodes = list(_walk(root))
    commas = {}
    for node in reversed(nodes):
        texts = [SPACE.sub(" ", c).strip() for c in node.children if isinstance(c, str)]
        inner = [c for c in node.children if isinstance(c, Node) and not c.hidden]
        node.size = sum(map(len, texts)) + sum(c.size for c in inner)
        node.links = node.size if node.name == "a" else sum(c.links for c in inner)
        commas[id(node)] = sum(len(re.findall("[,،、，]", t)) for t in texts) + sum(commas[id(c)] for c in inner)
    for node in nodes:
        loose = node.name in BLOCKS and node.name not in HEADINGS and any(isinstance(c, str) and not c.isspace() for c in node.children)
        if node.size and (node.name in PARAGRAPHS or loose) and not any(isinstance(c, Node) and c.name in PARAGRAPHS for c in node.children):
            given = (1 + commas[id(node)] + min(node.size / 100, 3)) * (1 - node.links / node.size)
            at = node if loose and node.name not in PARAGRAPHS else node.parent
            for level in range(LEVELS):
                if at is None:
                    break
                at.points += given / (level + 1)
                at = at.parent
    for node in nodes:
        if node.size:
            node.points *= 1 - node.links / node.size
        if node.points and (node.name in ("article", "main") or WANTED.search(node.names)):
            node.points *= 1.5
        if node.parent is None:
            node.points *= 0.5


def _whole(best: Node) -> Node:
    """The outermost <article> or <main> around the best container, else the parents named as an article that have most of their prose from it."""
    above, node = [], best
    while node is not None:
        above.append(node)
        node = node.parent
    marked = [n for n in above if n.name in ("article", "main")]
    if marked:
        return marked[-1]
    for node in above[1:-1]:
        if not WANTED.search(node.names) or 2 * (best.size - best.links) < node.size - node.links:
            break
        best = node
    return best


def kept(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    score(root)
    best = max(_walk(root), key=lambda n: n.points)
    if not best.points:
        return [root]
    least = max(10.0, 0.2 * best.points)
    best = _whole(best)
    if best.parent is None or best.name == "main":
        return [best]
    out = []
    for node in best.parent.children:
        if not isinstance(node, Node) or node.hidden or not node.size:
            continue
        density = node.links / node.size
        prose = node.name in PROSE and density < 0.25
        article = node.name == best.name == "article" and density < 0.25
        if node is best or prose or article or node.points >= least or node.name in HEADINGS and density < 0.25:
            out.append(node)
    return out


def blocks(node: Node) -> list[str]:
    """The texts of the blocks in page order, white space made one space."""
    out, run = [], []

    def flush():
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name == "br":
            run.append(" ")
        elif not x.hidden:
            block = x.name in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty where there is none."""
    if not page:
        return ""
    return "\n".join(b for n in kept(parse(page)) for b in blocks(n))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    Null and empty pages, and pages without text, have an empty text. Pages that
    end in the middle of a tag lose that tag only. Repeated rows give equal rows,
    an empty table none. Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def run(batches):
        for batch in batches:
            for keys, urls, pages_ in common.small_parts(batch, 2):
                texts = [main_text(p.decode("utf-8", "replace")) if p else "" for p in pages_]
                yield pa.RecordBatch.from_arrays([keys, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
