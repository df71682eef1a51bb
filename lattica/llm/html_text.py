"""Main text of web pages by tree scoring.

A scanner reads the page once and builds a tree of its elements; its time is linear in the page whatever the markup.
Paragraphs pass points for their length and commas to their ancestors; a container's points are discounted by the share
of its text that is link text. The best container is kept, up to an article or main element around it, with its title and
those siblings that score well beside it or are built like it.

Tags, roles and unmistakable names (navigation, adverts, reader comments, ...) take a part out. Names that prose uses as
well (discussion, notice, related, ...) only demote it: it goes if it is short or mostly links and stays if it reads like
the article. Headings are never judged by their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Tags and names.
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "select"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
_SCOPE = frozenset(("ul", "ol", "menu", "dl", "table", "article", "section", "div", "body", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_LISTS = frozenset(("ul", "ol", "dir"))
_NOT_ARTICLE = frozenset(("nav", "footer", "aside", "button", "menu", "dialog", "audio", "video", "map"))
_NOT_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"))
#: Any part of a name that is one of these marks something else than the article.
_NOT_NAMES = frozenset(("adbox", "ads", "adsense", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "commentarea", "commentlist", "comments", "cookie", "cookiebanner", "cookiebar", "cookienotice", "cookies", "disqus", "gdpr", "mainmenu", "masthead", "modal", "nav", "navbar", "navmenu", "newsletter", "outbrain", "pagefooter", "pageheader", "pager", "pagination", "popup", "promo", "respond", "sidebar", "sidenav", "signup", "sitefooter", "siteheader", "submenu", "subnav", "subscribe", "subscribebox", "taboola", "topbar", "topnav"))
#: These mark it if the name's other parts are of either list or structural, and then only what is short or mostly links.
_DOUBTFUL_NAMES = frozenset(("ad", "adv", "advertising", "alert", "announcement", "banner", "consent", "disclaimer", "discussion", "feedback", "footer", "header", "login", "menu", "navigation", "notice", "notices", "notification", "overlay", "promoted", "promotion", "reactions", "recommended", "related", "replies", "responses", "reviews", "share", "sharing", "skip", "social", "sponsor", "sponsored", "sponsors", "subscription", "toolbar", "widget"))
_STRUCTURAL = frozenset(("area", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "content", "fixed", "group", "holder", "icons", "inner", "item", "items", "left", "links", "list", "main", "media", "outer", "page", "panel", "posts", "right", "row", "section", "site", "slot", "stories", "sticky", "text", "top", "unit", "wrap", "wrapper", "zone"))
_OF_PAGE = frozenset(("has", "with", "no", "without", "layout", "page", "container", "wrapper", "template", "theme"))
_KEPT = frozenset(("html", "body", "article", "main"))
_SCORES = {"article": 25.0, "main": 15.0, "section": 4.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "form": -3.0, "th": -5.0}
_PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "div", "section", "article", "main", "li", "dd", "body"))
#: A paragraph of fewer characters gives no points.
LEAST_CHARS = 25
#: A doubtful part with a heading stays from so many characters on, one without from so many.
LEAST_HEADED, LEAST_BARE = 80, 400
#: Ancestors that a paragraph's points reach.
_LEVELS = 12

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_NEXT = re.compile(r"""=\s*["']|>""")
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I) for tag in _RAW}
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_STAYS, _GOES, _DOUBTFUL = 0, 1, 2


class _Node:
    __slots__ = ("tag", "parent", "depth", "block", "mark", "gone", "articles", "in_link", "list", "name", "chars", "linked", "headed", "holds", "prose", "points", "kept")

    def __init__(self, tag: str, parent: _Node | None, depth: int, mark: int, name: str):
        self.tag, self.parent, self.depth, self.mark, self.name = tag, parent, depth, mark, name
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.gone = mark == _GOES or (parent is not None and parent.gone)
        self.articles = (parent.articles if parent else 0) + (tag in ("article", "main"))
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.list = self if tag in _LISTS else parent.list if parent else None
        self.chars = self.linked = self.prose = 0
        self.headed = self.holds = self.kept = False
        self.points = 0.0


def _name_mark(word: str) -> int:
    """What a class name or id says; has-sidebar and sidebar-layout speak of the page."""
    parts = [x.lower() for x in _NAME.findall(word)]
    for k, part in enumerate(parts):
        if part in _NOT_NAMES and not (k and parts[k - 1] in _OF_PAGE) and not (k + 1 < len(parts) and parts[k + 1] in _OF_PAGE):
            return _GOES
    if any(p in _DOUBTFUL_NAMES for p in parts) and all(p in _DOUBTFUL_NAMES or p in _STRUCTURAL for p in parts):
        return _DOUBTFUL
    return _STAYS


def _judge(tag: str, attrs: str, inside_article: bool) -> tuple[int, str]:
    """What tag, role and names say of an element, and its class."""
    if tag in _NOT_ARTICLE:
        return _GOES, ""
    mark, name = _DOUBTFUL if tag == "form" or tag == "header" and not inside_article else _STAYS, ""
    if not attrs:
        return mark, name
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "class":
            name = value
        if tag in _KEPT:
            continue
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return _GOES, name
        if key == "role" and value.lower() in _NOT_ROLES:
            return _GOES, name
        if key in ("class", "id") and tag not in _HEADINGS:
            for word in value.split():
                found = _name_mark(word)
                if found == _GOES:
                    return _GOES, name
                mark = max(mark, found)
    return mark, name


class _Page:
    """The tree of a page: nodes in the order in which they open, blocks (innermost block element, text, link characters) in page order."""

    def __init__(self, page: str):
        self.nodes = [_Node("html", None, 0, _STAYS, "")]
        self.blocks: list[tuple[_Node, str, int]] = []
        self._stack, self._seen = [self.nodes[0]], set()
        self._open: list[dict[str, int]] = [{}]  # how many of each tag are open above the last element of _KEPT
        self._kept: list[str] = []  # the open elements of _KEPT
        self._held: list[str] = []
        self._linked = 0
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        at, last, quotes, dead = 0, page.rfind(">"), True, set()
        while (start := page.find("<", at)) >= 0:
            if start > last:
                break
            follows = page[start + 1 : start + 2]
            if follows == "!" or follows == "?":
                self._text(page[at:start])
                if page.startswith("<!--", start):
                    at = page.find("-->", start + 4) + 3 if "-->" not in dead else 2
                    if page.startswith("<!-->", start):
                        at = start + 5
                    elif at == 2:
                        return  # an open comment takes the rest
                elif page.startswith("<![CDATA[", start) and "]]>" not in dead:
                    end = page.find("]]>", start)
                    if end < 0:
                        dead.add("]]>")
                        at = page.find(">", start) + 1
                    else:
                        self._text(page[start + 9 : end])
                        at = end + 3
                else:
                    at = page.find(">", start) + 1
                continue
            ends = follows == "/"
            named = _OPEN.match(page, start + 1 + ends)
            if named is None:  # an ordinary character
                self._text(page[at : start + 1])
                at = start + 1
                continue
            self._text(page[at:start])
            stop = page.find(">", named.end())
            if not ends and quotes:
                seek = named.end()
                while (found := _NEXT.search(page, seek)) is not None and found[0] != ">":
                    seek = page.find(found[0][-1], found.end()) + 1
                    if not seek:
                        found = None
                        break
                if found is None:
                    quotes = False  # quotes do not pair from here on: tags end at the next >
                else:
                    stop = found.start()
            at, tag = stop + 1, named[0].lower()
            if ends:
                self._close_tag(tag)
                continue
            attrs = page[named.end() : stop]
            if tag in _RAW:
                if not attrs.endswith("/") or tag != "svg":
                    end = _RAW_ENDS[tag].search(page, at)
                    at = len(page) if end is None else page.find(">", end.end()) + 1 or len(page)
                continue
            self._open_tag(tag, attrs)
        self._text(page[at:])

    def _text(self, part: str) -> None:
        top = self._stack[-1]
        if part and not top.gone:
            part = html.unescape(part) if "&" in part else part
            self._held.append(part)
            if top.in_link:
                self._linked += len(part.strip())

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                self.blocks.append((self._stack[-1].block, text, min(self._linked, len(text))))
            self._held.clear()
        self._linked = 0

    def _close(self, depth: int) -> None:
        """Closes the element at that depth and all that are open in it."""
        if any(x.tag in _BLOCK for x in self._stack[depth:]):
            self._flush()
        for x in reversed(self._stack[depth:]):
            if x.tag in _KEPT:
                self._open.pop()
                self._kept.pop()
            else:
                self._open[-1][x.tag] -= 1
        del self._stack[depth:]

    def _close_tag(self, tag: str) -> None:
        stack = self._stack
        if tag in _KEPT:
            if self._kept.count(tag) if len(self._kept) < 100 else self._kept[-1] == tag:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                self._close(k)
        elif self._open[-1].get(tag):
            k = len(stack) - 1
            while stack[k].tag != tag:
                k -= 1
            self._close(k)
        elif tag in _BLOCK:
            self._flush()

    def _open_tag(self, tag: str, attrs: str) -> None:
        stack = self._stack
        if tag == "br" or tag == "hr":
            if not stack[-1].gone:
                self._held.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in _BLOCK:
            self._flush()
            block = stack[-1].block
            if block.tag == "p":  # a block ends an open paragraph
                self._close(block.depth)
        if tag in _SAME:
            node, seen = stack[-1].block, 0
            while node.parent is not None and seen < 64:
                if node.tag in _SAME[tag]:
                    self._close(node.depth)
                    break
                if node.tag in _SCOPE:
                    break
                node, seen = node.parent.block, seen + 1
        if tag in _VOID or tag == "html" or tag in ("head", "body") and tag in self._seen:
            return
        if tag in ("head", "body"):
            self._seen.add(tag)
            if len(stack) > 1 and tag == "body":
                self._close(1)
        parent = stack[-1]
        mark, name = _judge(tag, attrs, parent.articles > 0)
        node = _Node(tag, parent, len(stack), mark, name)
        self.nodes.append(node)
        if attrs.endswith("/") and tag in ("a", "p", "div", "span"):
            return
        stack.append(node)
        if tag in _KEPT:
            self._open.append({})
            self._kept.append(tag)
        else:
            self._open[-1][tag] = self._open[-1].get(tag, 0) + 1


def _totals(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Characters, link characters, prose paragraphs and headings of each element, its descendants included."""
    for n in nodes:
        n.chars = n.linked = n.prose = 0
        n.headed, n.holds = False, n.tag in ("article", "main")
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        node.prose += len(text) >= LEAST_HEADED and linked * 2 < len(text)
        node.headed = node.headed or node.tag in _HEADINGS
    for n in reversed(nodes):
        up = n.parent
        if up is not None:
            up.chars += n.chars
            up.linked += n.linked
            up.prose += n.prose
            up.headed = up.headed or n.headed
            up.holds = up.holds or n.holds


def _demoted(n: _Node, page_chars: int) -> bool:
    """Whether a doubtful element goes."""
    if n.tag == "form":  # some pages are one form
        return not (n.holds or n.prose >= 2 and 2 * n.chars >= page_chars)
    if n.tag == "header":  # a page's header goes, a text's stays
        return not (n.headed and n.parent.tag not in ("body", "html") and 2 * n.linked < n.chars)
    if n.holds or n.headed and n.chars >= LEAST_HEADED and 2 * n.linked < n.chars:
        return False
    return not (n.chars >= LEAST_BARE and 4 * n.linked < n.chars)


def _without(nodes: list[_Node], blocks: list) -> list:
    """Blocks that no gone element holds."""
    for n in nodes:
        n.gone = n.gone or (n.parent is not None and n.parent.gone)
    return [b for b in blocks if not b[0].gone]


def extract(page: str | None) -> str:
    """The main text: blocks joined by an empty line; an empty string if there is none."""
    if not page:
        return ""
    tree = _Page(page)
    nodes, blocks = tree.nodes, tree.blocks
    _totals(nodes, blocks)
    if any(n.mark == _DOUBTFUL for n in nodes):
        total = nodes[0].chars
        for n in nodes:
            if n.mark == _DOUBTFUL and not n.gone and _demoted(n, total):
                n.gone = True
        blocks = _without(nodes, blocks)
        _totals(nodes, blocks)
    before = None
    for node, text, linked in blocks:  # menus without a mark: lists of links outside articles that nothing introduces
        listed = node.list
        if listed is None:
            before = node if linked * 2 < len(text) else None
        elif not listed.articles and listed.linked * 3 > 2 * listed.chars and listed.mark == _STAYS:
            listed.mark = _DOUBTFUL if before is not None and before.parent is listed.parent else _GOES
            listed.gone = listed.mark == _GOES
    blocks = _without(nodes, blocks)
    _totals(nodes, blocks)
    for n in nodes:
        n.points = _SCORES.get(n.tag, 0.0)
    for node, text, linked in blocks:
        if len(text) < LEAST_CHARS or node.tag not in _PARAGRAPHS:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up = node
        for level in range(_LEVELS):
            if up is None:
                break
            if level or node.tag not in ("p", "li", "dd", "pre"):
                up.points += points / (1 if level <= 1 else 2 if level == 2 else 3 * level)
            up = up.parent
    held = [n for n in nodes if n.chars and not n.gone and n.tag in _BLOCK and n.tag not in ("p", "li", "head", "html") and n.tag not in _HEADINGS]
    if not held:
        return "\n\n".join(text for _, text, _ in blocks)
    score = {n: n.points * (1 - n.linked / n.chars) for n in held}
    best = max(held, key=score.__getitem__)  # the first of the best
    around = best
    while around.parent is not None and around.articles:
        around = around.parent
        if around.tag in ("article", "main") and around.chars > best.chars and around in score:
            best = around  # the whole article that the best part belongs to
    least = max(10.0, 0.2 * score[best])
    best.kept = True
    for n in held:
        if n.parent is best.parent and n is not best and n.tag not in ("header", "form") and n.list is None:
            alike = n.tag == best.tag and (n.tag == "section" or n.name and n.name == best.name) and 2 * n.linked < n.chars
            n.kept = alike or score[n] >= least
    for n in nodes:
        n.kept = n.kept or (n.parent is not None and n.parent.kept)
    chosen = [n.kept or _beside(n, text, linked, best) for n, text, linked in blocks]
    first = next((k for k, c in enumerate(chosen) if c), len(chosen))
    if not any(c and b[0].tag == "h1" for c, b in zip(chosen, blocks)):  # its title may stand before it
        for k in range(first - 1, -1, -1):
            if blocks[k][0].tag == "h1" and 2 * blocks[k][2] < len(blocks[k][1]):
                chosen[k] = True
                break
    return "\n\n".join(text for c, (_, text, _) in zip(chosen, blocks) if c)


def _beside(n: _Node, text: str, linked: int, best: _Node) -> bool:
    """Whether a block is a paragraph beside the container."""
    return n.tag == "p" and n.parent is best.parent and best.parent is not None and len(text) >= LEAST_HEADED and linked * 4 < len(text)


def _run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = [extract(p) for p in frame.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points), one row per row of pages.

    A null or empty page, or one without an article, gives an empty text and 0; null ids and URLs stay null; repeated
    rows give repeated results; only page_id, url and html are read, so other columns may have any name. Broken markup
    never raises and takes time in proportion to its length: what is not a tag is text, an open comment or script takes
    the rest of the page.
    """
    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
