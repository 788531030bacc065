"""Main text of pages through wrappers inferred for each host.

A page is a stream of tokens: tags that nest, and text. A wrapper is a union-free regular
expression over such streams: a list of items, each a tag with the list inside it or a
text slot, that may be optional or repeated. A page is itself such an expression, with
every text fixed; two are aligned item by item, and mismatches are resolved:

* texts that differ become a slot;
* a run of like items, or of like short squares of items, folds into one repeated group;
* items that only one side has become optional.

Every page of a host counts, and neither the order nor the partitions of the table do: pages
of one shape, which is the page without its texts, add up; the shapes of a host are aligned
in the order of their bytes, first those of one hash bucket, then the buckets. A second pass
parses every page against its host's wrapper and counts on how many pages each string
stands at each of its texts.

What a wrapper is used for:

* The content is where its slots hold most text outside links: the article or main element
  if it holds a fair share of that, else the deepest element with most of it. Strings that
  half the pages of the host have at the same place are the template's and do not weigh.
* Each page is parsed against the wrapper of its host. Its content is what the content
  item matches, without the template's strings, as long as these are a small part of it (a
  page that is mostly such strings is a copy). What matches nothing is kept.
* Names of classes and ids are the tie-break for what a page alone cannot show: boxes of
  other kinds of text, such as adverts and comments, vary from page to page as well.

Defined cases: null html counts as empty and has no text; null and odd URLs share the
empty host; broken markup (open tags, cut pages, stray ends) is read as browsers do;
nesting of any depth and very long pages are read whole; repeated rows are kept, and
copies of a page are one witness for a template's string; hosts of few pages have no
template; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Generator, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, partitions

#: Elements whose content is no text of the page.
_RAW = "script|style|noscript|template|svg|textarea|iframe|object|canvas|math|title|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Parts of a page that serve the site, by tag and by word in class, id or role.
_SITE_TAGS = frozenset("nav footer aside form button select dialog menu input fieldset head".split())
_SITE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar side sidenav nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login search share sharing social "
    "related recommended comment comments reply replies respond disqus widget toolbar pagination pager skip complementary contentinfo dialog".split()
)
_CONTENT_TAGS = ("article", "main")
_CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Words beside which a site word still names a part of the site.
_NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box boxes button buttons card cards center col column container content contents entry fixed float global group icon icons inline inner item items "
    "label left link links list lists message messages mobile module outer page pages panel post posts primary right row secondary section sections site slot small sticky story "
    "text thread title top unit wrap wrapper zone article articles".split()
)
#: Elements that hold a block of running text; their names do not decide.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr table tbody ul ol dl blockquote pre figure figcaption".split())
_TEXT = "#"
_MOST_SQUARE = 3
#: A template's string stands on half the pages of its host, on as many different ones at least,
#: and all such strings are at most this part of a page's content.
LEAST, MOST_FIXED = 5, 1 / 3
#: Cells of a full alignment, beyond which it is greedy; buckets of a host's shapes; counts that a task holds.
_CELLS, _BUCKETS, _HELD = 1 << 20, 256, 200_000


def run(call: Generator):
    """The value of a recursive generator function, whose inner calls are yielded, on a stack of its own."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Node:
    """An item: its key, the items inside, and as a text its words.

    ``pages`` have it. ``counts`` of a text: digest of a string to [pages, its length,
    digests of up to ``LEAST`` different pages].
    """

    __slots__ = ("key", "kids", "opt", "rep", "text", "chars", "linked", "pages", "counts")

    def __init__(self, key: str, kids: list | None = None, text: str | None = None) -> None:
        self.key, self.kids, self.text = key, kids if kids is not None else [], text
        self.opt = self.rep = False
        self.chars = len(text) if text else 0
        self.linked, self.pages = 0, 1
        self.counts: dict[int, list] = {}

    def walk(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.kids))

    def dump(self) -> list:
        """A flat list in page order, so depth is no limit."""
        return [[n.key, int(n.opt) + 2 * int(n.rep), n.chars, n.linked, n.text, n.pages, [[k, *v] for k, v in n.counts.items()], len(n.kids)] for n in self.walk()]

    @classmethod
    def load(cls, rows: list) -> Node:
        root = None
        waiting: list[list] = []  # (node, children to come)
        for key, flags, chars, linked, text, pages, counts, kids in rows:
            node = cls(key, [], text)
            node.opt, node.rep, node.chars, node.linked, node.pages = bool(flags & 1), bool(flags & 2), chars, linked, pages
            node.counts = {k: list(v) for k, *v in counts}
            while waiting and not waiting[-1][1]:
                waiting.pop()
            if waiting:
                waiting[-1][0].kids.append(node)
                waiting[-1][1] -= 1
            else:
                root = node
            waiting.append([node, kids])
        return root


def _tag(key: str) -> str:
    return key.split(".", 1)[0]


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def _site_name(name: str) -> bool:
    """Whether a class or id names a part of the site: by site words and neutral ones alone."""
    parts = _parts(name)
    return any(w in _SITE_WORDS for w in parts) and all(w in _SITE_WORDS or w in _NEUTRAL_WORDS for w in parts)


@lru_cache(maxsize=1 << 16)
def _key(tag: str, rest: str) -> str:
    """Tag with the names of class and role, digits aside, and telling ones of the id."""
    names: set[str] = set()
    if rest and ("=" in rest or "hidden" in rest.lower()):
        for m in _ATTR.finditer(rest):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                names.add("hidden")
            elif name == "id":  # most ids are of one page only
                names.update("-".join(_parts(w)) for w in value.split() if _site_name(w) or _parts(w) and all(p in _CONTENT_WORDS for p in _parts(w)))
            elif name != "aria-hidden":
                names.update("-".join(_parts(w)) for w in value.split() if _parts(w))
    return ".".join([tag, *sorted(names)])


def page_tree(page: str) -> Node:
    """The page as nested items; plain inline tags vanish, links keep their text apart."""
    root = Node("")
    path = [root]
    tags = [""]  # of the path
    pos = links = 0

    def leave(tag: str) -> None:
        """Close the nearest open ``tag``, if any."""
        if tag in tags:
            at = len(tags) - 1 - tags[::-1].index(tag)
            del path[at:], tags[at:]

    def say(raw: str) -> None:
        top = path[-1]
        last = top.kids[-1] if top.kids and top.kids[-1].key == _TEXT else None
        if last is None:
            if not raw.strip():
                return
            last = Node(_TEXT, text="")
            top.kids.append(last)
        last.text += raw
        if links:
            last.linked += len(raw)

    for m in _TOKEN.finditer(page):
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            leave(tag)
            continue
        if tag in _VOID:
            if tag in ("br", "wbr", "img"):
                if tag != "wbr":
                    say(" ")
            elif tag == "hr":
                path[-1].kids.append(Node("hr"))
            continue
        if tag == "a":
            links += 1
        key = _key(tag, m["rest"])
        if tag in _INLINE and key == tag:
            continue
        if tag in _CLOSES_P:
            for i in range(len(path) - 1, 0, -1):
                if tags[i] == "p":
                    del path[i:], tags[i:]
                    links = 0
                    break
                if tags[i] not in _INLINE:
                    break
        if tag in _SIBLINGS:
            for i in range(len(path) - 1, 0, -1):
                if tags[i] in _SIBLINGS[tag]:
                    del path[i:], tags[i:]
                    break
                if tags[i] in _SCOPE.get(tag, ()):
                    break
        node = Node(key)
        path[-1].kids.append(node)
        if not m["rest"].rstrip().endswith("/") or tag not in ("svg", "path"):
            path.append(node)
            tags.append(tag)
    if pos < len(page):
        say(page[pos:])
    return root


def _added(a: Node, b: Node, across: bool) -> dict[int, list]:
    """String counts of a text that two pages, or two items of one page, have in common."""
    if not b.counts:
        return a.counts
    out = {k: v for k, v in a.counts.items()}
    for k, (n, length, seen) in b.counts.items():
        if k in out:
            m, _, also = out[k]
            out[k] = [m + n if across else max(m, n), length, sorted({*seen, *also})[:LEAST]]
        else:
            out[k] = [n, length, seen]
    return out


def _joined(a: Node, b: Node, across: bool) -> Generator:
    """What both match: like keys, aligned insides, a slot where texts differ."""
    kids = (yield _align(a.kids, b.kids, across)) if a.kids or b.kids else []
    out = Node(a.key, kids, a.text if a.text == b.text else None)
    out.opt, out.rep = a.opt or b.opt, a.rep or b.rep
    out.chars, out.linked = a.chars + b.chars, a.linked + b.linked
    out.counts = _added(a, b, across) if a.key == _TEXT else {}
    out.pages = a.pages + b.pages if across else max(a.pages, b.pages)
    return out


def _optional(a: Node) -> Node:
    a.opt = True
    return a


def _matched(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places of like keys in both, in order: a longest common sequence, or a greedy one of very long lists."""
    n, m, at = len(a), len(b), 0
    while at < min(n, m) and a[at].key == b[at].key:
        at += 1
    end = 0
    while end < min(n, m) - at and a[n - 1 - end].key == b[m - 1 - end].key:
        end += 1
    pairs = [(i, i) for i in range(at)]
    x, y = [k.key for k in a[at : n - end]], [k.key for k in b[at : m - end]]
    if len(x) * len(y) > _CELLS:
        j = 0
        for i, key in enumerate(x):
            if key in y[j : j + 64]:
                j = y.index(key, j) + 1
                pairs.append((at + i, at + j - 1))
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((at + i, at + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(n - k, m - k) for k in range(end, 0, -1)]


def _align(a: list[Node], b: list[Node], across: bool) -> Generator:
    """The union-free expression that covers two folded lists."""
    out, i, j = [], 0, 0
    for x, y in [*_matched(a, b), (len(a), len(b))]:
        out += [_optional(k) for k in a[i:x]] + [_optional(k) for k in b[j:y]]
        if x < len(a):
            out.append((yield _joined(a[x], b[y], across)))
        i, j = x + 1, y + 1
    if len(out) > max(len(a), len(b)):
        out = yield _fold(out)
    return out


def _fold(items: list[Node]) -> Generator:
    """Repeated squares, of up to a few items, as one repeated group each."""
    for size in range(1, _MOST_SQUARE + 1):
        out: list[Node] = []
        for x in items:
            out.append(x)
            if len(out) >= 2 * size and [y.key for y in out[-size:]] == [y.key for y in out[-2 * size : -size]]:
                for k in range(size):
                    merged = yield _joined(out[-2 * size + k], out[-size + k], False)
                    merged.rep = True
                    out[-2 * size + k] = merged
                del out[-size:]
        items = out
    return items


def align(a: list[Node], b: list[Node]) -> list[Node]:
    return run(_align(a, b, True))


def merged(a: Node, b: Node) -> Node:
    """The wrapper of all pages of two."""
    return run(_joined(a, b, True))


def _digest(text: str) -> int:
    """Of a string, white space aside."""
    return xxhash.xxh64_intdigest(" ".join(text.split()), 1)


def _page_digest(root: Node) -> int:
    """Of all texts of a page."""
    return _digest("\n".join(n.text for n in root.walk() if n.text is not None))


def page_wrapper(page: str, counted: bool = True) -> Node:
    """A page as an expression: every run of like items folded, inner lists first; with its strings, if they are to be counted."""
    root = page_tree(page)
    nodes = list(root.walk())
    seen = _page_digest(root) if counted else 0
    for n in nodes:
        if n.text is not None:
            n.chars = len(n.text)
            n.counts = {_digest(n.text): [1, n.chars, [seen]]} if counted else {}
    for n in reversed(nodes):
        if len(n.kids) > 1:
            n.kids = run(_fold(n.kids))
    return root


@lru_cache(maxsize=1 << 16)
def _serves_site(key: str, inside: bool) -> bool:
    tag, *names = key.split(".")
    if tag in _SITE_TAGS or "hidden" in names:
        return True
    if tag == "header":
        return not inside
    if tag in ("body", "html", "main") or tag in _RUNNING:
        return False
    parts = {w for n in names if _site_name(n) for w in n.split("-")} & _SITE_WORDS
    if tag == "article":
        return inside and bool(parts & {"comment", "comments", "reply", "replies"})
    if inside:
        parts -= {"header", "masthead"}  # of the article itself
    return bool(parts)


class Plan:
    """A wrapper made ready for pages: its content items and its template's strings."""

    def __init__(self, wrapper: Node, content: set[int] | None = None) -> None:
        self.root, self.pages = wrapper, wrapper.pages
        if content is not None:
            self.content = content
            return
        self.weights: dict[int, int] = {}
        for node in reversed(list(wrapper.walk())):
            own = node.chars - 2 * node.linked - sum(v[0] * v[1] for k, v in node.counts.items() if self.fixed(node, k)) if node.key == _TEXT else 0
            self.weights[id(node)] = own + sum(self.weights[id(k)] for k in node.kids if not _serves_site(k.key, True))
        self.content = {id(n) for n in self._content()}

    def dump(self) -> str:
        """What :func:`extract` needs: the content, the way to it with what stands beside, template strings."""
        nodes = list(self.root.walk())
        leads: set[int] = set()  # items that are, hold or lie in content
        for n in nodes:
            if id(n) in self.content or id(n) in leads:
                leads.update([id(n), *map(id, n.kids)])
        for n in reversed(nodes):
            if any(id(k) in leads for k in n.kids):
                leads.add(id(n))
        rows = []
        waiting = [self.root]
        while waiting:
            n = waiting.pop()
            kids = n.kids if id(n) in leads else []
            counts = [[k, *v] for k, v in n.counts.items() if self.fixed(n, k)] if id(n) in leads else []
            rows.append([n.key, int(n.opt) + 2 * int(n.rep) + 4 * int(id(n) in self.content), 0, 0, None, n.pages, counts, len(kids)])
            waiting.extend(reversed(kids))
        return json.dumps(rows)

    @classmethod
    def load(cls, text: str) -> Plan:
        rows = json.loads(text)
        root = Node.load(rows)
        return cls(root, {id(n) for n, row in zip(root.walk(), rows, strict=True) if row[1] & 4})

    def fixed(self, node: Node, digest: int) -> bool:
        """Whether a text's string is the template's."""
        n, _, seen = node.counts.get(digest, (0, 0, ()))
        return 2 * n >= self.pages and len(seen) >= LEAST

    def weight(self, node: Node) -> int:
        return self.weights[id(node)]

    def _content(self) -> list[Node]:
        found: list[tuple[Node, Node]] = []  # with the parent
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            for kid in reversed(node.kids):
                if not _serves_site(kid.key, False) or _tag(kid.key) in _CONTENT_TAGS:
                    found.append((node, kid))
                    waiting.append(kid)
        all_weight = self.weight(self.root)
        for tag in _CONTENT_TAGS:
            named = [x for x in found if _tag(x[1].key) == tag or tag == "main" and "main" in x[1].key.split(".")[1:]]
            if named:
                parent, best = max(named, key=lambda x: self.weight(x[1]))
                if 4 * self.weight(best) >= all_weight:
                    return [k for p, k in named if p is parent and 10 * self.weight(k) >= self.weight(best)]
        # The deepest element that still holds most of the text outside links.
        here = self.root
        while True:
            kids = [k for k in here.kids if k.key != _TEXT and not _serves_site(k.key, False)]
            top = max(kids, key=self.weight, default=None)
            if top is None or self.weight(top) < 0.7 * self.weight(here) or top.rep:
                return [here]
            here = top


def content_of(wrapper: Node) -> Plan:
    return Plan(wrapper)


def _places(kids: list[Node], items: list[Node]) -> list[Node | None]:
    """Which item of an expression each of a page's items matches; repeated groups match runs."""
    n, m = len(kids), len(items)
    out: list[Node | None] = [None] * n
    i = j = 0
    while i < n and j < m and kids[i].key == items[j].key and not items[j].rep:
        out[i] = items[j]
        i, j = i + 1, j + 1
    if i == n or j == m and not (j and items[j - 1].rep):
        return out
    if (n - i) * (m - j) > _CELLS:
        by = {x.key: x for x in reversed(items)}
        return [*out[:i], *(by.get(k.key) for k in kids[i:])]
    # best[k]: matches of kids[row:] with items[k:]; a repeated item may match again, alone or with those just before it.
    width = m - j
    back = [[k] for k in range(width)]
    for k in range(width):
        for step in range(_MOST_SQUARE):
            if k - step < 0 or not items[j + k - step].rep:
                break
            if step:
                back[k].append(k - step)
    again = [[b for b in back[k] if items[j + k].rep] for k in range(width)]
    rows = [[0] * (width + 1)]
    for row in range(n - 1, i - 1, -1):
        after, now = rows[-1], [0] * (width + 1)
        for k in range(width - 1, -1, -1):
            best = max(now[k + 1], after[k])
            if kids[row].key == items[j + k].key:
                best = max(best, 1 + max([after[k + 1], *(after[b] for b in again[k])]))
            now[k] = best
        rows.append(now)
    rows.reverse()
    k = 0
    for row in range(i, n):
        now, after = rows[row - i], rows[row - i + 1]
        while k < width and now[k] == now[k + 1]:
            k += 1
        if k == width:
            break
        if kids[row].key == items[j + k].key and now[k] == 1 + (top := max([after[k + 1], *(after[b] for b in again[k])])):
            out[row] = items[j + k]
            k = next(x for x in (*again[k], k + 1) if after[x] == top)
    return out


def _parsed(page: Node, plan: Plan) -> tuple[list[Node], set[int]]:
    """The page's content elements, and those of its texts that are the template's."""
    roots, fixed = [], set()
    waiting: list[tuple[Node, Node, bool]] = [(page, plan.root, False)]
    while waiting:
        node, item, inside = waiting.pop()
        if not inside and id(item) in plan.content:
            roots.append(node)
            inside = True
        if node.key == _TEXT:
            if inside and item.counts and plan.fixed(item, _digest(node.text)):
                fixed.add(id(node))
        elif node.kids:
            waiting += [(k, x, inside) for k, x in reversed(list(zip(node.kids, _places(node.kids, item.kids), strict=True))) if x is not None]
    return roots, fixed


def extract(page: str, plan: Plan | None) -> str:
    """Text of the page's content: what the wrapper's content items match, site parts and template strings left out.

    A page of the host in which they match nothing has a content of its own.
    """
    tree = page_tree(page)
    roots, fixed = _parsed(tree, plan) if plan is not None else ([], set())
    if not roots:
        roots, fixed = _parsed(tree, content_of(page_wrapper(page)))
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join(html_lib.unescape("".join(now)).split())
        if text:
            blocks.append(text)
        now.clear()

    if fixed:
        texts = [n for r in roots for n in r.walk() if n.key == _TEXT]
        if sum(len(n.text) for n in texts if id(n) in fixed) > MOST_FIXED * sum(len(n.text) for n in texts):
            fixed = set()
    for root in roots:
        waiting: list[Node | None] = [root]  # None ends a block
        while waiting:
            node = waiting.pop()
            if node is None:
                close()
            elif node.key == _TEXT:
                if id(node) not in fixed:
                    now.append(node.text)
            elif node is root or not _serves_site(node.key, True):
                if _tag(node.key) not in _INLINE:
                    close()
                    waiting.append(None)
                waiting.extend(reversed(node.kids))
            elif _tag(node.key) not in _INLINE:
                close()
        close()
    return "\n".join(blocks)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _shape(wrapper: Node) -> tuple[str, list[int], list[int]]:
    """An expression without its texts, and the characters of its items, all and those in links."""
    nodes = list(wrapper.walk())
    return json.dumps([[n.key, int(n.opt) + 2 * int(n.rep), len(n.kids)] for n in nodes]), [n.chars for n in nodes], [n.linked for n in nodes]


def _of_shape(shape: str, pages: int, chars: list[int], linked: list[int]) -> Node:
    return Node.load([[key, flags, c, x, None, pages, [], kids] for (key, flags, kids), c, x in zip(json.loads(shape), chars, linked, strict=True)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], k) for k in schema.types], schema=schema)


_SHAPES = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("shape", pa.string()), ("pages", pa.int64()), ("chars", pa.list_(pa.int64())), ("linked", pa.list_(pa.int64()))])
_WRAPPERS = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("wrapper", pa.string())])
_STRINGS = pa.schema([("host", pa.string()), ("pages", pa.int64()), ("place", pa.int32()), ("digest", pa.int64()), ("n", pa.int64()), ("length", pa.int64()), ("seen", pa.list_(pa.int64()))])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of one host and shape added up, in a task first."""
    held: dict[tuple[str, str], list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(h, xxhash.xxh64_intdigest(s, 2) % _BUCKETS, s, n, c.tolist(), x.tolist()) for (h, s), (n, c, x) in held.items()]
        held.clear()
        return _batch(rows, _SHAPES)

    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            shape, chars, linked = _shape(page_wrapper(page or "", counted=False))
            if (found := held.get((host, shape))) is not None:
                found[0] += 1
                found[1] += np.array(chars)
                found[2] += np.array(linked)
            else:
                held[host, shape] = [1, np.array(chars), np.array(linked)]
                size += len(shape)
            if size > 16 << 20:
                yield flush()
                size = 0
    if held:
        yield flush()


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, bucket and shape: like shapes add up, the others are aligned in this order."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True))
    for (host, bucket), of in groupby(rows, key=lambda r: r[:2]):
        whole = None
        for shape, same in groupby(of, key=lambda r: r[2]):
            parts = list(same)
            one = _of_shape(shape, sum(r[3] for r in parts), *([sum(c) for c in zip(*(r[k] for r in parts), strict=True)] for k in (4, 5)))
            whole = one if whole is None else merged(whole, one)
        yield _batch([(host, bucket, json.dumps(whole.dump()))], _WRAPPERS)


def _by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
    for host, of in groupby(rows, key=lambda r: r[0]):
        whole = None
        for _, _, text in of:
            one = Node.load(json.loads(text))
            whole = one if whole is None else merged(whole, one)
        yield _batch([(host, 0, json.dumps(whole.dump()))], _WRAPPERS)


def infer_structures(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of ``pages (host, html)``: the expression of all pages of each host, without their strings."""
    n = partitions(pages.sparkSession)
    shapes = pages.select("host", "html").mapInArrow(_shapes, "host string, bucket int, shape string, pages long, chars array<bigint>, linked array<bigint>")
    parts = shapes.repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket", "shape").mapInArrow(_by_bucket, "host string, bucket int, wrapper string")
    return parts.repartition(n, "host").sortWithinPartitions("host", "bucket").mapInArrow(_by_host, "host string, bucket int, wrapper string").drop("bucket")


def _texts(page: Node, root: Node) -> Iterator[tuple[Node, str]]:
    """A page's texts with the items that they match."""
    waiting = [(page, root)]
    while waiting:
        node, item = waiting.pop()
        if node.key == _TEXT:
            yield item, node.text
        elif node.kids:
            waiting += [(k, x) for k, x in reversed(list(zip(node.kids, _places(node.kids, item.kids), strict=True))) if x is not None]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages have a string at a place of their host's wrapper, with the least digests of such pages."""
    loaded: dict[str, tuple[Node, dict[int, int]]] = {}
    held: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(host, pages, place, string - (1 << 64) if string >> 63 else string, n, length, sorted(seen)) for (host, pages, place, string), (n, length, seen) in held.items()]
        held.clear()
        return _batch(rows, _STRINGS)

    for b in batches:
        for host, page, wrapper in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if host not in loaded:
                if len(loaded) >= 1000:
                    loaded.clear()
                root = Node.load(json.loads(wrapper))
                loaded[host] = root, {id(n): i for i, n in enumerate(root.walk())}
            root, places = loaded[host]
            tree = page_tree(page or "")
            digest = _page_digest(tree) & (1 << 63) - 1
            for place, string, length in {(places[id(item)], _digest(x), len(x)) for item, x in _texts(tree, root)}:
                found = held.setdefault((host, root.pages, place, string), [0, 0, set()])
                found[0] += 1
                found[1] = max(found[1], length)
                if digest not in found[2]:
                    found[2] = {*sorted({*found[2], digest})[:LEAST]}
            if len(held) > _HELD:
                yield flush()
    if held:
        yield flush()


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers with the template's strings at their places, made ready for pages."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])
    for b in batches:
        rows = []
        for host, wrapper, strings in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            root = Node.load(json.loads(wrapper))
            nodes = list(root.walk())
            for s in strings or []:
                nodes[s["place"]].counts[s["digest"] & (1 << 64) - 1] = [s["n"], s["length"], s["seen"]]
            rows.append((host, content_of(root).dump()))
        yield _batch(rows, schema)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` of ``pages (host, html)``, the wrapper as a plan, the same for any order and partitions of the pages."""
    structures = materialize(infer_structures(pages), "structures")
    counted = pages.join(structures, "host").select("host", "html", "wrapper").mapInArrow(_strings, "host string, pages long, place int, digest long, n long, length long, seen array<bigint>")
    seen = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, LEAST)
    found = counted.groupBy("host", "place", "digest").agg(F.max("pages").alias("pages"), F.sum("n").alias("n"), F.max("length").alias("length"), seen.alias("seen"))
    template = found.where((2 * F.col("n") >= F.col("pages")) & (F.size("seen") >= LEAST))
    by_host = template.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n", "length", "seen"))).alias("strings"))
    return structures.join(by_host, "host", "left").select("host", "wrapper", "strings").mapInArrow(_planned, "host string, wrapper string")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of every page by the wrapper of its host."""
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    wrappers = materialize(infer_wrappers(pages), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[str, Plan] = {}
        for b in batches:
            texts = []
            for page, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in plans:
                    if len(plans) >= 1000:
                        plans.clear()
                    plans[wrapper] = Plan.load(wrapper)
                texts.append(extract(page or "", plans.get(wrapper)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return pages.join(wrappers, "host", "left").select("id", "url", "html", "wrapper").mapInArrow(read, f"id {kind}, url string, text string")
