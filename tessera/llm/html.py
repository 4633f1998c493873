"""HTML extraction by wrapper induction.

Pages of one host are dealt into groups of about ``group`` pages by a hash of their id, so a host of any size is read by
many tasks. In a group, pages of like layout (equal paths of tags) are clustered, and each cluster is merged into one template:
every page's DOM is aligned to the tree of all pages before it by simple tree matching, and what it adds becomes part of the
tree. A spot of the template then knows its text on every page, and that decides, before any name is looked at:

* a spot with the same text on all pages that have it, three that are no copies at least, is template;
* a list whose text is mostly links, over all pages, is a menu;
* the smallest part of the tree that holds nine tenths of the text that varies is where content stands; outside it stay
  headings of the first level, and headings of any level that lead to it, beside one of the elements it stands in; other
  text outside it goes.

Beside that, elements that HTML or their names mark as menus, headers, footers, sidebars, notices, adverts, forms, scripts or
comments are left out, and where a page marks its article (``article`` or ``main``), only that is read. Inside a marked
article whose layout has a template, the template decides first: what is constant goes, and of what varies a name takes away
only what is an advert, a list of comments, a menu or the like and nothing else (NEVER); an "alert", a "header" or another
article that varies stays. Without these
elements, all outermost ones with a like class or id are read if they hold most of the page's text that names do not
exclude, else the whole page. Pages that agree in most of their varying text are copies, of which one votes, so a copied
article is not taken for template.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined cases: a null or empty page, and one without text, give an empty text; a null url is a host of its own; rows with
equal or null ids are pages of their own, and rows without an id are dealt by their page; broken markup is repaired like
browsers do it (unclosed paragraphs, stray end tags, files cut off, also inside a tag); any depth and length are read, in
time that grows with the length; a page alone on its host, or with fewer than three like it, keeps all that names do not
exclude; an empty table gives no rows; extra columns, also of clashing names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import store

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option textarea iframe object svg canvas dialog menu title audio video".split())
#: Start tags that close an open element of the second set, unless one of the third stands between.
_CLOSES = {t: frozenset(["p"]) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_CLOSES |= {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
_BLOCKS = frozenset("article aside body button div dl fieldset footer form header main nav ol section table td th ul".split())
#: Words in a class, id or role that mark what is no article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promotion promoted recommended related respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar toc topbar widget".split()
)
#: Words that, beside none but these and _PARTS, name what is no text of an article wherever it stands and however it varies.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus menu nav navbar navigation newsletter pager pagination promo promoted promotion recommended related respond share sharing sidebar sidenav social sponsor sponsored subscribe subscription".split()
)
_PARTS = frozenset("area bar block bottom box button buttons container form inner item items left link links list outer posts right section slot thread top unit widget wrapper".split())
#: Words by which an ``article`` element itself is something else.
NO_ARTICLE = frozenset("comment comments related recommended promo promoted promotion sponsored advert advertisement ad ads teaser".split())
ARTICLE = frozenset("main article post entry story".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the end of their tag. Quotes count where a value begins; one that is not closed is a letter.
_ATTRIBUTES = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+|[\"'])*+")
_NAME = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class Node:
    """An element: ``children`` are nodes and texts, ``kids`` those that are not blank, ``shape`` is equal for trees of equal tags, ``size`` counts nodes.

    chars, linked and links: length of the texts below, of those in links, and how many links there are.
    """

    __slots__ = ("tag", "words", "never", "hidden", "children", "kids", "shape", "size", "chars", "linked", "links")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.words, self.never, self.hidden, self.children, self.kids = tag, (), False, False, [], []
        self.shape, self.size, self.chars, self.linked, self.links = None, 1, 0, 0, 0
        if attributes and attributes.strip("/ "):
            found = []
            for name, *values in _NAME.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True
                elif name in ("class", "id", "role"):
                    for given in value.split():
                        own = [x.lower() for x in _WORD.findall(given)]
                        found.extend(own)
                        self.never = self.never or any(x in NEVER for x in own) and all(x in NEVER or x in _PARTS for x in own)
            self.words = tuple(found)


class Slot:
    """A text of a page, at its place in the tree."""

    __slots__ = ("text", "content", "template", "chars")
    tag, size, shape, kids, linked, links = "#text", 1, "#text", (), 0, 0

    def __init__(self, text: str):
        self.text, self.content, self.template, self.chars = text, False, False, len(text.strip())


def in_order(root: Node) -> list[Node]:
    """The elements of a tree, parents before their children."""
    order, k = [root], 0
    while k < len(order):
        order.extend(c for c in order[k].children if type(c) is not Slot)
        k += 1
    return order


def parse(html: str) -> Node:
    root = Node("#root")
    stack, at, end = [root], 0, len(html)
    open_tags: Counter[str] = Counter()

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(Slot(unescape(piece) if "&" in piece else piece))

    def pop(k: int) -> None:
        for node in stack[k:]:
            open_tags[node.tag] -= 1
        del stack[k:]

    while at < end:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        m = _TAG.match(html, start)
        if m is None and html[start + 1 : start + 2] not in ("!", "?", "/"):
            more = html.find("<", start + 1)  # a bare sign is text
            text(html[at : more if more >= 0 else end])
            at = more if more >= 0 else end
            continue
        text(html[at:start])
        if m is None:
            mark = "-->" if html.startswith("<!--", start) else ">"
            close = html.find(mark, start + (4 if mark == "-->" else 1))
            at = close + len(mark) if close >= 0 else end
            continue
        close = _ATTRIBUTES.match(html, m.end()).end()
        if close == end:  # the file is cut off inside a tag
            break
        at, tag, attributes = close + 1, m[2].lower(), html[m.end() : close]
        if m[1]:
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop(k)
                        break
                    if tag in INLINE and stack[k].tag in _BLOCKS:
                        break
            continue
        if tag in _CLOSES and any(open_tags[t] > 0 for t in _CLOSES[tag]):
            closed, scopes = _CLOSES[tag], _SCOPES.get(tag, _BLOCKS)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scopes:
                    break
                if stack[k].tag in closed:
                    pop(k)
                    break
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = ends.end() if ends else end
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    shaped(root)
    return root


def shaped(root: Node) -> None:
    """Set what an element knows of those below it, children first."""
    for node in reversed(in_order(root)):
        node.kids = [c for c in node.children if type(c) is not Slot or c.chars]
        node.chars = sum(c.chars for c in node.kids)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in node.kids)
        node.links = sum(c.links + (c.tag == "a") for c in node.kids)
        node.size = 1 + sum(c.size for c in node.kids)
        node.shape = hash((node.tag, *(c.shape for c in node.kids)))


def _excluded(node: Node, inside: bool, judged: bool = False) -> bool:
    """Whether an element is left out. judged: a template has said what is constant there, so that names only tell what is never text."""
    if node.hidden or node.tag in DROPPED:
        return True
    if judged and inside:
        return node.never
    if node.tag in ("html", "body", "main"):
        return False
    if not inside and node.tag == "article":
        return any(w in NO_ARTICLE for w in node.words)
    if inside and node.tag == "article":  # an article in an article is a comment
        return True
    return any(w in BOILERPLATE for w in node.words)


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.tag in ("div", "section", "td") and (any(w in ARTICLE for w in node.words) or node.words == ("content",))


def _articles(root: Node) -> tuple[list[Node], bool]:
    """The outermost marked articles, and whether their element says so; those come before all named by a class or id."""
    strong, weak, stack = [], [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag == "main" or node.tag == "article" and not _excluded(node, False):
            strong.append(node)
            continue
        if not inside and _is_article(node):
            weak.append(node)
            inside = True
        stack.extend((c, inside) for c in reversed(node.children) if type(c) is Node and not _excluded(c, False))
    if strong:
        inner = []
        for node in strong:  # a main element may hold the article beside other things
            found = _articles_in(node) if node.tag == "main" else []
            inner.extend(found or [node])
        return inner, True
    return weak, False


def _articles_in(main: Node) -> list[Node]:
    found, stack = [], list(reversed(main.children))
    while stack:
        node = stack.pop()
        if type(node) is not Node or _excluded(node, False):
            continue
        if node.tag == "article":
            found.append(node)
        else:
            stack.extend(reversed(node.children))
    return found


def _link_list(node: Node) -> bool:
    """Whether most of a list's or table's text is in links."""
    return node.tag in ("ul", "ol", "table", "div", "p") and node.links >= 3 and node.linked > 0.6 * node.chars


class Page:
    def __init__(self, html: str):
        self.root = parse(html)
        self.judged = False  # whether a template has been found for it

    def judge(self) -> None:
        """Mark the content among the slots that are no template, by marks of articles and by names."""
        marked, strong = _articles(self.root)
        slots = self._read(marked, True) if marked else []
        if not strong:
            whole = self._read([self.root], False)
            if 2 * sum(len(x.text.strip()) for x in slots) <= sum(len(x.text.strip()) for x in whole):
                slots = whole
        for x in slots:
            x.content = True

    @property
    def marked(self) -> bool:
        return _articles(self.root)[1]

    def _read(self, roots: list[Node], marked: bool) -> list[Slot]:
        slots, stack = [], [(r, False) for r in roots]
        while stack:
            node, heading_only = stack.pop()
            for c in node.children:
                if type(c) is Slot:
                    if not heading_only and not c.template and c.text.strip():
                        slots.append(c)
                elif heading_only:
                    stack.append((c, c.tag not in _HEADINGS))
                elif not _excluded(c, marked, self.judged):
                    if marked or not _link_list(c):
                        stack.append((c, False))
                elif marked and not c.hidden and (c.tag == "header" or "header" in c.words):
                    stack.append((c, True))
        return slots

    def text(self) -> str:
        self.judge()
        return self._joined(lambda x: x.content)

    def induced(self) -> str:
        """The text that induction alone leaves, whatever elements are named."""
        return self._joined(lambda x: not x.template)

    def _joined(self, wanted) -> str:
        out, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x is None:
                out.append(" ")
            elif type(x) is Slot:
                out.append(x.text if wanted(x) else " ")
            elif x.tag != "head":
                if x.tag not in INLINE:
                    out.append(" ")
                    stack.append(None)
                stack.extend(reversed(x.children))
        return " ".join("".join(out).split())


_CELLS = 1 << 22  # of a table that is kept whole; beyond it is worked out again, half by half


def _last_row(p: np.ndarray, q: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Best totals of all of p with each beginning of q. p, q: classes of children; gain: of each pair of classes."""
    line, by_class = np.zeros(len(q) + 1, np.int64), gain[:, q]
    for c in p:
        np.maximum.accumulate(np.maximum(line[1:], line[:-1] + by_class[c]), out=line[1:])
    return line


def _common(p: np.ndarray, q: np.ndarray, gain: np.ndarray) -> list[tuple[int, int]]:
    """Places in p and q of an order-keeping matching of the largest total gain."""
    out, stack = [], [(0, len(p), 0, len(q))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > _CELLS and b - a > 1:
            mid = (a + b) // 2
            ahead, back = _last_row(p[a:mid], q[c:d], gain), _last_row(p[mid:b][::-1], q[c:d][::-1], gain)[::-1]
            cut = c + int(np.argmax(ahead + back))
            stack += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        rows, by_class = [np.zeros(d - c + 1, np.int64)], gain[:, q[c:d]]
        for k in p[a:b]:
            line = rows[-1].copy()
            np.maximum.accumulate(np.maximum(line[1:], line[:-1] + by_class[k]), out=line[1:])
            rows.append(line)
        i, j = b - a, d - c
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return out


class Matching:
    """Largest matchings of trees (simple tree matching: order and parents are kept), remembered by the trees' shapes."""

    def __init__(self):
        self.sizes: dict[tuple, int] = {}

    def size(self, x, y) -> int:
        """Nodes in a largest matching of x and y with their roots matched; 0 if the tags differ. Without recursion."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if (x.shape, y.shape) in self.sizes:
                todo.pop()
                continue
            if x.tag != y.tag or x.shape == y.shape:
                self.sizes[x.shape, y.shape] = x.size if x.tag == y.tag else 0
                continue
            ends, p, q = _middle(x.kids, y.kids)
            first, second = {k.shape: k for k in p}, {k.shape: k for k in q}
            missing = [(u, v) for s, u in first.items() for t, v in second.items() if (s, t) not in self.sizes]
            if missing:
                todo += missing
                continue
            total = 1 + sum(u.size for u, _ in ends)
            if p and q:
                total += self._best(p, q)
            self.sizes[x.shape, y.shape] = total
        return self.sizes[x.shape, y.shape]

    def _best(self, p: list, q: list) -> int:
        """The largest total gain of an order-keeping matching of two lists of children."""
        if len(p) * len(q) > 256:
            return int(_last_row(*self._classes(p, q))[-1])
        sizes, line = self.sizes, [0] * (len(q) + 1)
        for u in p:
            left = above = 0
            for k, v in enumerate(q, 1):
                best = max(above + sizes[u.shape, v.shape], left, line[k])
                above, line[k] = line[k], best
                left = best
        return line[-1]

    def _classes(self, p: list, q: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of shape of each child, and the gain of each pair of classes."""
        first, second = ({s: k for k, s in enumerate(dict.fromkeys(c.shape for c in side))} for side in (p, q))
        gain = np.array([[self.sizes[s, t] for t in second] for s in first], np.int64).reshape(len(first), len(second))
        return np.array([first[c.shape] for c in p]), np.array([second[c.shape] for c in q]), gain

    def children(self, x, y) -> list[tuple]:
        """The matched children of two matched elements, in order."""
        if x.shape == y.shape:
            return list(zip(x.kids, y.kids, strict=True))
        ends, p, q = _middle(x.kids, y.kids)
        if p and q:
            for u in {c.shape: c for c in p}.values():
                for v in {c.shape: c for c in q}.values():
                    self.size(u, v)
            ends = ends + [(p[i], q[j]) for i, j in _common(*self._classes(p, q))]
        return ends


def _middle(p: list, q: list) -> tuple[list[tuple], list, list]:
    """Pairs of equal trees at both ends, which belong together in some largest matching, and the rest between."""
    lo, hi, least = 0, 0, min(len(p), len(q))
    while lo < least and p[lo].shape == q[lo].shape:
        lo += 1
    while hi < least - lo and p[-1 - hi].shape == q[-1 - hi].shape:
        hi += 1
    ends = [*zip(p[:lo], q[:lo], strict=True), *zip(p[len(p) - hi :], q[len(q) - hi :], strict=True)]
    return ends, p[lo : len(p) - hi], q[lo : len(q) - hi]


def align(a: Node, b: Node, matching: Matching | None = None) -> list[tuple[Slot, Slot]]:
    """Pairs of slots in a largest matching of two trees."""
    matching = matching or Matching()
    out, stack = [], [(a, b)] if a.tag == b.tag else []
    while stack:
        x, y = stack.pop()
        if type(x) is Slot:
            out.append((x, y))
        else:
            stack += matching.children(x, y)
    return out


class Spot:
    """A node of a template: ``seen`` has the node or slot of each page (by number) that has it."""

    __slots__ = ("tag", "kids", "shape", "size", "seen", "constant", "varying", "linked")

    def __init__(self, tag: str):
        self.tag, self.kids, self.seen = tag, [], {}
        self.shape, self.size = "#text", 1
        self.constant, self.varying, self.linked = False, 0, 0


class Template:
    """The merged tree of pages of one layout."""

    def __init__(self):
        self.root, self.matching = Spot("#root"), Matching()

    def spots(self) -> list[Spot]:
        """All spots, parents before their children."""
        order, k = [self.root], 0
        while k < len(order):
            order.extend(order[k].kids)
            k += 1
        return order

    def add(self, number: int, root: Node) -> None:
        """Align a page to the tree; what has no place in it yet becomes a spot behind its neighbour's."""
        todo = [(self.root, root)]
        while todo:
            spot, node = todo.pop()
            spot.seen[number] = node
            if spot.tag == "#text":
                continue
            pairs = {id(y): x for x, y in self.matching.children(spot, node)}
            kids, old = [], iter(spot.kids)
            for child in node.kids:
                own = pairs.get(id(child))
                if own is None:
                    own = Spot(child.tag)
                    kids.append(own)
                else:
                    for between in old:
                        kids.append(between)
                        if between is own:
                            break
                todo.append((own, child))
            spot.kids = [*kids, *old]
        for spot in reversed(self.spots()):
            if spot.tag != "#text":
                spot.size = 1 + sum(k.size for k in spot.kids)
                spot.shape = hash((spot.tag, *(k.shape for k in spot.kids)))


def _paths(root: Node) -> frozenset[int]:
    """The paths of tags that lead to a page's texts, by hash."""
    out, stack = set(), [(root, 0)]
    while stack:
        node, path = stack.pop()
        for c in node.kids:
            if type(c) is Node:
                if c.tag != "head":
                    stack.append((c, hash((path, c.tag))))
            else:
                out.add(path)
    return frozenset(out)


def _clusters(pages: list[Page], alike: float) -> list[list[Page]]:
    """Pages with text by layout, those with most paths first: each with the first page with which it shares most, ``alike`` of all paths at least."""
    found: list[tuple[frozenset, list[Page]]] = []
    known = [(paths, page) for page in pages if (paths := _paths(page.root))]
    for paths, page in sorted(known, key=lambda x: (-len(x[0]), -x[1].root.size)):
        share, best = max(((len(paths & p) / len(paths | p), -k) for k, (p, _) in enumerate(found)), default=(0, 0))
        if share >= alike:
            found[-best][1].append(page)
        else:
            found.append((paths, [page]))
    return [own for _, own in found]


def induce(pages: list[Page], votes: int = 3, marked_votes: int = 8, copies: float = 0.7, passage: int = 200, alike: float = 0.5, main: float = 0.9) -> None:
    """Mark the template slots of pages of one host.

    alike: share of paths of tags that pages of one layout have in common. copies: pages that agree in this share of their
    varying text are copies, unless at least ``passage`` characters agree or differ less; of copies one votes.
    votes, marked_votes: so many pages that are no copies must have a text, all the same one, without and with a marked
    article. main: share of the varying text that the part with the content holds.
    """
    for own in _clusters(pages, alike):
        if len(own) >= votes:
            _induce(own, votes, marked_votes, copies, passage, main)


def _voters(texts: list[dict[int, str]], copies: float, passage: int) -> list[int]:
    """Pages of which none is a copy of an earlier one, by their texts at the varying spots."""
    out: list[int] = []
    for k, own in enumerate(texts):
        for other in (texts[j] for j in out):
            shared = own.keys() & other.keys()
            agree = sum(len(own[s]) for s in shared if own[s] == other[s])
            total = max(sum(map(len, own.values())), sum(map(len, other.values())))
            if agree >= copies * total:
                break
        else:
            out.append(k)
    return out


def _induce(pages: list[Page], votes: int, marked_votes: int, copies: float, passage: int, main: float) -> None:
    template = Template()
    for k, page in enumerate(pages):
        template.add(k, page.root)
    spots = template.spots()
    slots = [s for s in spots if s.tag == "#text"]
    varying = [s for s in slots if len({x.text for x in s.seen.values()}) > 1]
    texts: list[dict[int, str]] = [{} for _ in pages]
    for n, spot in enumerate(varying):
        for k, x in spot.seen.items():
            texts[k][n] = x.text
    voters = set(_voters(texts, copies, passage))
    if len(voters) < votes:
        return
    least = marked_votes if sum(page.marked for page in pages) * 2 > len(pages) else votes
    if len(voters) >= least:
        for page in pages:
            page.judged = True
    for spot in slots:
        found = Counter(x.text for k, x in spot.seen.items() if k in voters)
        text, n = found.most_common(1)[0] if found else ("", 0)
        # a text that stops where another goes on may be cut off
        spot.constant = n >= least and all(t == text or text.startswith(t.rstrip()) for t in found)
    _measured(template.root, spots, voters)
    path = _region(template.root, main)
    inside = {id(s) for s in _below(path[-1])}
    for spot in spots:
        if spot.tag == "#text":
            out = spot.constant and {x.text for x in spot.seen.values()} or None
            for x in spot.seen.values():
                x.template = bool(out) and (x.text == max(out, key=len) or len(out) == 1)
    _outside(path, inside)


def _measured(root: Spot, spots: list[Spot], voters: set[int]) -> None:
    """Of every spot: the length of its texts that vary, and of those in links, over all voters; children first."""
    linked = {id(root): False}
    for spot in spots:
        for kid in spot.kids:
            linked[id(kid)] = linked[id(spot)] or spot.tag == "a"
    for spot in reversed(spots):
        if spot.tag == "#text":
            n = 0 if spot.constant else sum(x.chars for k, x in spot.seen.items() if k in voters)
            spot.varying, spot.linked = n, n if linked[id(spot)] else 0
        elif spot.tag not in DROPPED - {"nav", "header", "footer", "aside"}:
            spot.varying, spot.linked = sum(k.varying for k in spot.kids), sum(k.linked for k in spot.kids)


def _region(root: Spot, main: float) -> list[Spot]:
    """The way to the smallest part of the tree with so much of the varying text that stands in no link; a marked article is not cut."""
    own = lambda s: s.varying - s.linked
    path, total = [root], own(root)
    while path[-1].tag not in ("article", "main") and total > 0:
        best = max((k for k in path[-1].kids if k.tag != "#text"), key=own, default=None)
        if best is None or best.tag in INLINE or own(best) < main * total:
            break
        path.append(best)
    return path


def _leads(path: list[Spot]) -> set[int]:
    """Headings of any level, not mostly links, that stand on the way to the region and before it: the title of what follows."""
    out = set()
    for spot, below in zip(path, path[1:]):
        for kid in spot.kids:
            if kid is below:
                break
            if kid.tag in _HEADINGS and 2 * kid.linked <= kid.varying:
                out.add(id(kid))
    return out


def _below(spot: Spot) -> list[Spot]:
    order, k = [spot], 0
    while k < len(order):
        order.extend(order[k].kids)
        k += 1
    return order


def _outside(path: list[Spot], inside: set[int]) -> None:
    """Mark what stands outside the region, but for its headings, on the pages that have text in it; and lists of links."""
    have, leads = {k for k, node in path[-1].seen.items() if node.chars}, _leads(path)
    todo = [(path[0], False)]
    while todo:
        spot, heading = todo.pop()
        if id(spot) not in inside and spot.tag == "#text" and not heading:
            for k, x in spot.seen.items():
                if k in have:
                    x.template = True
        menu = spot.tag in ("ul", "ol", "table", "div", "p", "nav") and spot.varying > 0 and spot.linked > 0.6 * spot.varying
        if menu and sum(node.links for node in spot.seen.values()) >= 3 * len(spot.seen):
            for node in spot.seen.values():
                for x in _slots(node):
                    x.template = True
            continue
        todo += [(k, heading or k.tag == "h1" or id(k) in leads) for k in spot.kids]


def _slots(node) -> list[Slot]:
    return [node] if type(node) is Slot else [c for n in in_order(node) for c in n.children if type(c) is Slot]


def _extract(batches):
    names = ["page_id", "url", "text", "n_chars"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    key, rows, out = None, [], []

    def finish():
        known: dict[str, Page] = {}
        for _, _, html in rows:
            if html not in known:
                known[html] = Page(html)
        induce(list(known.values()))
        for page_id, url, html in rows:
            text = known[html].text()
            out.append((page_id, url, text, len(text)))

    def flush():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names)

    for batch in batches:
        for host, bucket, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "page_id", "url", "html")), strict=True):
            if rows and (host, bucket) != key:
                finish()
                rows = []
                if len(out) >= 256:
                    yield flush()
                    out.clear()
            key = (host, bucket)
            rows.append((page_id, url, html))
    if rows:
        finish()
    yield flush()


def extract(pages: DataFrame, group: int = 48) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html). group: pages that are aligned with one another, on average."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.expr("coalesce(html, '')").alias("html"))
    own = own.withColumn("place", F.expr("coalesce(page_id, xxhash64(html, url))"))  # rows without an id are dealt too
    own = own.withColumn("host", F.expr(r"lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ''))"))
    buckets = own.groupBy("host").agg(F.ceil(F.count("*") / group).alias("buckets"))
    # written first, so that the join reads both sides from shuffles that AQE can split at a hot host
    buckets = store(buckets, "hosts").df
    dealt = own.join(buckets, "host").withColumn("bucket", F.expr("pmod(xxhash64(place), buckets)"))
    dealt = dealt.select("host", "bucket", "page_id", "url", "html").repartition("host", "bucket")
    return dealt.sortWithinPartitions("host", "bucket", "page_id", "html").mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
