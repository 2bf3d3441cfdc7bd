"""Main text of HTML pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a tree of blocks and texts in which implied ends are written out. The trees
of a few pages of one host are aligned one after another, level by level: texts that differ
become slots, blocks that some pages lack become optional, blocks whose kind comes again
among its neighbours become repeated groups. The result is a regular expression without
unions, the wrapper, and it accepts each page that it was inferred from.

The wrapper says what each of its parts is:

* the main region: the ``article`` or ``main`` with the most text in slots, and the articles
  beside it that aren't mostly links; of a ``main`` that is nearly all articles, these and its
  headings; else the deepest region with nearly all text in slots that isn't a link. Where the
  pages are copies, so that most of their text is alike, all text counts as if it were
  in slots;
* constant parts of a region without ``article``: a text that all pages have alike at one
  place, where the pages' own texts differ, goes (headings stay; nothing goes if it is half of
  the text);
* parts that stand aside: by their tag (navigation, footers, forms and the like), or by the
  words of class, id and role. Words decide only if structure agrees: a part that holds the
  article, the page's first heading or nearly all text isn't aside, and words of two minds
  (``related``, ``search``, ``discussion``) need a part that is mostly links or controls, or a
  run of like boxes.

Every page is then aligned with its host's wrapper from the top, and each block does what
its place in the wrapper says. A block that the wrapper doesn't know is judged by the same
rules on its own; a page without the wrapper's region is read by a wrapper of itself.

A wrapper is fitted on all pages of its host: tasks align the pages they read, and what they
have found for a host is aligned once more. Copies that one task reads count once. Whether
constant parts go is decided by a second reading of all pages of the hosts that have any.

Text of a page: blocks in page order joined by a line feed; character references
decoded, white space inside a block one space, ends trimmed, empty blocks left out. A
line break counts as white space; a block of nothing but buttons and labels is left out. A
null, empty or textless page gives an empty text, a null url the host ''. Unclosed and
deeply nested elements are read like any others. Repeated rows give equal results, an empty
table no row. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import arrowkit
from weftgraph.llm.url_lm import parse as parse_url
from weftgraph.session import materialize

#: Hosts whose wrappers a task holds at once, before it hands them on.
HELD_HOSTS = 2048
NEARLY_ALL = 0.9
#: Pages with texts of their own that a host must show before constant parts go.
CONSTANT_PAGES = 3

# a quote opens a value only behind an equals sign
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z|([^<]++|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Tags that start and end a block.
BLOCKS = frozenset(
    "html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption pre blockquote figure figcaption header footer nav aside form fieldset legend address details summary hr "
    "center menu dialog".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("hr".split())
#: Text up to the end tag, or to the end of the page.
_RAW = frozenset("script style textarea".split())
#: Elements that are left out whole; one without an end tag, or that blocks break open, is not.
_SKIPPED = frozenset("noscript template iframe svg select object canvas audio video".split())
_BROKEN_OPEN = re.compile(r"<(?:p|div|h[1-6]|article|section|main|ul|ol|li|table|blockquote|pre)[\s>]", re.I)
_NEXT_BLOCK = re.compile(_BROKEN_OPEN.pattern.replace("<", "</?", 1), re.I)
_MAY_HOLD_BLOCKS = frozenset("noscript template iframe object audio video".split())
_CONTROLS = frozenset("input button select textarea label".split())
#: An open element that the start of another one ends.
_ENDS = {
    **{k: frozenset("p") for k in BLOCKS},
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
}
#: Where such ends stop.
_SCOPE = frozenset("ul ol dl table div section article main body html nav aside header footer form blockquote".split())
#: Elements outside of the main text.
ASIDE_TAGS = frozenset("head title nav header footer aside form fieldset legend menu dialog".split())
#: Words of class, id and role of parts that stand aside unless they hold the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sidebar menu nav navigation navbar footer header cookie cookies consent notice notices "
    "alert comment comments replies promo sponsor sponsored breadcrumb breadcrumbs complementary contentinfo".split()
)
#: The same for parts that are also mostly links or controls, or a run of like boxes.
DOUBTFUL_WORDS = frozenset("related search share social login banner newsletter subscribe popup modal widget discuss discussion".split())
_NOT = frozenset("no not has have with without is hide js".split())
#: What comments, cards and other entries of a list are made of.
_BOXES = frozenset("div li article section dl dd blockquote".split())
_REGIONS = frozenset("article main section div td body blockquote".split())


class Part:
    """A part of a page or of a wrapper: a block, a text (``#``) or a repeated group (``+``)."""

    __slots__ = ("key", "tag", "words", "kids", "text", "mass", "slot", "links", "control", "core", "optional", "repeated", "seen", "state", "run")

    def __init__(self, key: str, tag: str = "", words: int = 0):
        self.key, self.tag, self.words = key, tag, words
        self.kids: list[Part] = []
        self.text: str | None = None  # None: a slot
        self.mass = self.slot = self.links = 0
        self.control = self.core = self.optional = self.repeated = self.run = False
        self.seen = 1
        self.state = ""


def _words(attributes: str) -> tuple[str, int]:
    """What tells a block from others of its tag, and what its words say: 2 aside, 1 doubtful, 0 nothing."""
    kind, says = [], 0
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for token in (m[2] or m[3] or m[4] or "").lower().split():
                parts = re.split(r"[-_]+", token)
                if m[1].lower() != "id" and not any(c.isdigit() for c in token):
                    kind.append(token)
                if parts[0] not in _NOT:
                    if not ASIDE_WORDS.isdisjoint(parts):
                        says = 2
                    elif says == 0 and not DOUBTFUL_WORDS.isdisjoint(parts):
                        says = 1
    return " ".join(sorted(kind)), says


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``<`` and ``>`` with a tag's name and attributes, ``#`` with text; what is left out whole is gone."""
    at, n = 0, len(page)
    lower = None
    endless: set[str] = set()
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if m[4]:
            yield "#", m[4], ""
        elif m[2]:
            name = m[2].lower()
            if m[1]:
                yield ">", name, ""
                continue
            if name in _RAW or name in _SKIPPED and name not in endless and not m[3].endswith("/"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                end = lower.find("</" + name, at)
                if end < 0 and name in _SKIPPED:
                    endless.add(name)
                    if name not in _MAY_HOLD_BLOCKS and (broken := _NEXT_BLOCK.search(page, at)):
                        at = broken.start()
                    continue
                if end >= 0 and name in _SKIPPED and name not in _MAY_HOLD_BLOCKS and (broken := _BROKEN_OPEN.search(page, at, end)):
                    at = broken.start()
                    continue
                at = n if end < 0 else (page.find(">", end) + 1 or n)
                if name in _CONTROLS:
                    yield "<", name, m[3]
                    yield ">", name, ""
            else:
                yield "<", name, m[3]


def clean(raw: str) -> str:
    return " ".join((entities.unescape(raw) if "&" in raw else raw).split())


def tree(page: str) -> Part:
    """The blocks and texts of a page, with sums from the bottom up."""
    root = Part("")
    stack = [root]
    open_: Counter[str] = Counter()
    texts: list[str] = []
    link = control = 0  # open links and controls
    in_link = in_control = 0  # characters of the text at hand within them

    def flush() -> None:
        nonlocal texts, in_link, in_control
        if texts and (text := clean("".join(texts))) and in_control < sum(len(x.strip()) for x in texts):
            node = Part("#")
            node.text, node.mass, node.slot = text, len(text), len(text)
            node.links = min(len(text), in_link)
            stack[-1].kids.append(node)
        texts, in_link, in_control = [], 0, 0

    def close() -> None:
        done = stack.pop()
        open_[done.tag] -= 1
        _sum(done)

    for kind, name, attributes in tokens(page):
        if kind == "#":
            texts.append(name)
            if link:
                in_link += len(name.strip())
            if control:
                in_control += len(name.strip())
            continue
        if name not in BLOCKS:
            if name == "br":
                texts.append(" ")
            elif name == "a":
                link = kind == "<"
            elif name in _CONTROLS:
                stack[-1].control = True
                if name in ("button", "label"):
                    control = kind == "<"
            continue
        if kind == ">":
            if open_[name]:
                flush()
                while stack[-1].tag != name:
                    close()
                close()
                link = control = 0
            continue
        flush()
        link = control = 0
        if name in ("html", "body") and open_[name]:
            continue
        at = None
        ends = _ENDS[name]
        if any(open_[x] for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    at = i
                elif stack[i].tag in _SCOPE:
                    break
        if name == "body" and open_["head"]:
            at = next(i for i in range(1, len(stack)) if stack[i].tag == "head")
        while at is not None and len(stack) > at:
            close()
        kinds, says = _words(attributes)
        node = Part(name if name in ("html", "body", "main") or not kinds else f"{name} {kinds}", name, says)
        node.control = name == "form"
        stack[-1].kids.append(node)
        if name not in _VOID:
            stack.append(node)
            open_[name] += 1
    flush()
    while len(stack) > 1:
        close()
    _sum(root)
    return root


def _sum(node: Part) -> None:
    """Mass, links and flags of a node whose parts have theirs."""
    if node.key == "#":
        return
    node.mass, node.slot, node.links = (sum(getattr(x, k) for x in node.kids) for k in ("mass", "slot", "links"))
    node.control = node.control or any(x.control for x in node.kids)
    kinds = Counter(k.key for x in node.kids for k in (x.kids * 2 if x.key == "+" else [x]) if k.tag in _BOXES)
    node.run = any(n > 1 for n in kinds.values())
    node.core = node.tag in ("main", "h1") or node.tag == "article" and node.words < 2 or any(x.core for x in node.kids)


def below(root: Part) -> list[Part]:
    """The nodes of a tree, each before its parts."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


# --- wrappers -----------------------------------------------------------------


def _keys(x: Part) -> dict[str, Part]:
    return {k.key: k for k in x.kids} if x.key == "+" else {x.key: x}


class Alignment:
    """Merges trees; pairs that wait are merged in the order in which they were met."""

    def __init__(self) -> None:
        self.todo: deque[tuple[Part, Part]] = deque()

    def merge(self, a: Part, b: Part) -> None:
        """Take ``b`` into ``a``."""
        a.mass += b.mass
        a.links += b.links
        a.seen += b.seen
        a.words = max(a.words, b.words)
        a.control |= b.control
        a.optional |= b.optional
        a.repeated |= b.repeated
        if a.key == "#":
            a.text = a.text if a.text == b.text else None
        else:
            self.todo.append((a, b))

    def group(self, parts: list[Part]) -> Part:
        """A repeated group of the kinds of some parts."""
        out = Part("+")
        out.repeated = True
        known: dict[str, Part] = {}
        for x in parts:
            for k in x.kids if x.key == "+" else [x]:
                if k.key in known:
                    self.merge(known[k.key], k)
                else:
                    known[k.key] = k
                    k.optional = k.repeated = True
                    out.kids.append(k)
        out.seen = max(x.seen for x in parts)
        return out

    @staticmethod
    def _last(parts: list[Part], end: int, own: dict[str, Part]) -> int | None:
        """Where one of these kinds stands among the last few parts before ``end``."""
        return next((i for i in range(end - 1, max(end - 4, -1), -1) if not own.keys().isdisjoint(_keys(parts[i]))), None)

    def fold(self, kids: list[Part]) -> list[Part]:
        """Blocks whose kind comes three times among the last few become repeated groups."""
        out: list[Part] = []
        for x in kids:
            own = _keys(x)
            if own.keys() == {"#"}:
                out.append(x)
                continue
            at = self._last(out, len(out), own)
            if at is not None and out[at].key != "+":
                at = self._last(out, at, own)  # a kind that comes for the third time
            if at is None:
                out.append(x)
            else:
                out[at:] = [self.group([*out[at:], x])]
        return out

    def align(self, left: list[Part], right: list[Part]) -> list[Part]:
        """Match two lists of parts; what only one of them has becomes optional."""
        out: list[Part] = []
        i = j = 0

        def only(nodes: list[Part]) -> None:
            for x in nodes:
                x.optional = True
                out.append(x)

        ls, rs = [_keys(x).keys() for x in left], [_keys(x).keys() for x in right]
        while i < len(left) and j < len(right):
            if not ls[i].isdisjoint(rs[j]):
                if left[i].key == right[j].key != "+":
                    self.merge(left[i], right[j])
                    out.append(left[i])
                else:
                    optional = left[i].optional or right[j].optional
                    out.append(self.group([left[i], right[j]]))
                    out[-1].optional = optional
                i, j = i + 1, j + 1
                continue
            # the nearer way to agree again
            a = next((k for k in range(i, len(left)) if not ls[k].isdisjoint(rs[j])), None)
            b = next((k for k in range(j, len(right)) if not rs[k].isdisjoint(ls[i])), None)
            if a is not None and (b is None or a - i <= b - j):
                only(left[i:a])
                i = a
            elif b is not None:
                only(right[j:b])
                j = b
            else:
                only([left[i], right[j]])
                i, j = i + 1, j + 1
        only(left[i:])
        only(right[j:])
        return self.fold(out)

    def run(self) -> None:
        while self.todo:
            a, b = self.todo.popleft()
            a.kids = self.align(a.kids, b.kids)


def wrapper_of(page: Part) -> Part:
    """The wrapper of one page: its tree with repeated blocks folded from the bottom up."""
    work = Alignment()
    for node in reversed(below(page)):
        node.kids = work.fold(node.kids)
        work.run()
    return page


def infer(pages: list[str]) -> Part:
    """The wrapper of some pages of one host, judged."""
    wrapper = aligned(wrapper_of(tree(x)) for x in pages)
    judge(wrapper, len(pages) == 1)
    if found := _constants(wrapper):
        texts = [read(tree(x), Reader(wrapper)) for x in pages]
        if None not in texts and len(set(texts)) >= CONSTANT_PAGES and 2 * sum(x.mass for x in found) < sum(map(len, texts)):
            _drop(found)
    return wrapper


def aligned(wrappers: Iterable[Part]) -> Part:
    """One wrapper of several, each of a page or of some pages."""
    wrapper, *others = wrappers
    for x in others:
        align_into(wrapper, x)
    return wrapper


def align_into(wrapper: Part, other: Part) -> None:
    work = Alignment()
    work.merge(wrapper, other)
    work.run()


def expression(wrapper: Part) -> str:
    """The wrapper as a regular expression over ``<key>``, ``</>`` and ``#``."""
    out: list[str] = []
    todo: list[Part | str] = [wrapper]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = "*" if x.repeated and x.optional else "+" if x.repeated else "?" if x.optional else ""
        if x.key == "#":
            todo += [f"(?:#){mark}"]
        else:
            start, end = ("", "") if x.key in ("+", "") else (re.escape(f"<{x.key}>"), "</>")
            todo += [f"{end}){mark}", *reversed(x.kids), f"(?:{start}"]
    return "".join(out)


def stream(page: Part) -> str:
    """A page's tree in the alphabet of ``expression``."""
    out: list[str] = []
    todo: list[Part | str] = [page]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.key == "#":
            out.append("#")
        else:
            start, end = ("", "") if x.key == "" else (f"<{x.key}>", "</>")
            todo += [end, *reversed(x.kids), start]
    return "".join(out)


# --- what parts are -------------------------------------------------------------


def is_aside(node: Part, total: int, core: bool) -> bool:
    """Does a part stand outside of the main text? ``total`` is the page's mass, ``core``: it has an article or heading."""
    if node.tag in ASIDE_TAGS:
        return True
    if not node.words or node.tag in ("html", "body", "main") or node.core or not core and 2 * node.mass > total:
        return False
    return node.words == 2 or node.control or node.run or 2 * node.links >= node.mass


def judge(wrapper: Part, single: bool) -> None:
    """Set ``state``: ``main`` for the region, ``aside`` for what goes."""
    nodes = below(wrapper)
    for x in reversed(nodes):
        x.state = ""
        if x.key == "#":
            x.slot = x.mass if single or x.text is None or x.repeated else 0
        else:
            _sum(x)
    core = any(x.core for x in nodes)
    for x in reversed(nodes):
        if x.key not in ("#", "+") and is_aside(x, wrapper.mass, core):
            x.state = "aside"
        if x.key != "#":
            x.slot = 0 if x.state else sum(k.slot if k.key != "#" else max(k.slot - k.links, 0) for k in x.kids)
    if not single:
        plain, todo = 0, [wrapper]
        while todo:
            for x in todo.pop().kids:
                if x.key == "#":
                    plain += max(x.mass - x.links, 0)
                elif not x.state:
                    todo.append(x)
        if 4 * wrapper.slot < plain:  # the pages are copies
            return judge(wrapper, True)
    top, todo = [], [wrapper]
    while todo:  # articles and main elements that no other of them holds
        for x in todo.pop().kids:
            if x.state:
                continue
            if x.tag in ("article", "main") and x.mass:
                top.append(x)
            else:
                todo.append(x)
    if top:
        best = max(top, key=lambda x: (x.slot, x.mass))
        # articles beside it say as much; a main element beside an article doesn't
        for x in top if best.tag == "article" else [best]:
            if x.tag == best.tag and (x is best or _is_text(x)):
                _mark_articles(x)
        return
    best, at = None, wrapper
    while at is not None and wrapper.slot:
        if at.tag in _REGIONS:
            best = at
        at = max((x for x in at.kids if x.key != "#" and not x.state), default=None, key=lambda x: x.slot)
        if at is None or at.slot < NEARLY_ALL * wrapper.slot:
            break
    (best or wrapper).state = "main"


def _is_text(x: Part) -> bool:
    """Not a teaser: less than half of it is links."""
    return 2 * x.links < x.mass


def _mark_articles(region: Part) -> None:
    """The region is ``main``; where its articles are nearly all of it, they and its headings are, and the rest isn't."""
    inner, heads, todo = [], [], [region]
    while todo:
        for x in todo.pop().kids:
            if x.state:
                continue
            if x.tag == "article" and x.mass:
                inner.append(x)
            elif x.tag in _HEADINGS:
                heads.append(x)
            elif x.key != "#":
                todo.append(x)
    if region.tag != "main" or sum(x.slot for x in inner) < NEARLY_ALL * (region.slot - sum(x.slot for x in heads)):
        region.state = "main"
        return
    for x in [*filter(_is_text, inner), *heads]:
        x.state = "main"
    if not any(map(_is_text, inner)):
        region.state = "main"


def _constants(wrapper: Part) -> list[Part]:
    """Texts of the region that all pages have alike; they go if the pages' own texts differ and are most of it."""
    found: list[Part] = []
    if wrapper.seen < CONSTANT_PAGES:
        return found
    # what an article has alike on all pages is its own
    todo = [x for x in below(wrapper) if x.state == "main" and x.tag not in ("article", *_HEADINGS)]
    while todo:
        for x in todo.pop().kids:
            if x.key == "#":
                if x.text is not None and x.seen == wrapper.seen and not x.optional and not x.repeated:
                    found.append(x)
            elif not (x.state or x.optional or x.repeated or x.tag in ("article", *_HEADINGS) or x.key == "+"):
                todo.append(x)
    return found


def _drop(found: list[Part]) -> None:
    for x in found:
        x.state = "constant"


_KEPT = ("key", "tag", "words", "text", "mass", "links", "control", "core", "optional", "repeated", "seen", "run")


def packed(wrapper: Part) -> str:
    """A wrapper that isn't judged yet as a list of its nodes, each before its parts."""
    return json.dumps([[len(x.kids), *(getattr(x, k) for k in _KEPT)] for x in below(wrapper)], separators=(",", ":"))


def unpacked(text: str) -> Part:
    root = Part("")
    open_ = [[root, 1]]
    for n, *values in json.loads(text):
        while not open_[-1][1]:
            open_.pop()
        node = Part("")
        for k, v in zip(_KEPT, values, strict=True):
            setattr(node, k, v)
        open_[-1][0].kids.append(node)
        open_[-1][1] -= 1
        open_.append([node, n])
    return root.kids[0]


class Reader:
    """A judged wrapper as a page is read by it: for each place the states of the parts by key."""

    def __init__(self, wrapper: Part | None = None):
        self.kids: list[dict[str, list[int]]] = [{}]
        self.state: list[str] = [""]
        if wrapper is not None:
            self._keep(wrapper)

    def _keep(self, wrapper: Part) -> None:
        """Only parts with a state, and those above them, are needed."""
        nodes = below(wrapper)
        needed: dict[int, bool] = {}
        for x in reversed(nodes):
            needed[id(x)] = bool(x.state) or any(needed[id(k)] for k in x.kids)
        self.state[0] = "main" if wrapper.state == "main" else ""
        todo: list[tuple[Part, int]] = [(wrapper, 0)]
        while todo:
            node, at = todo.pop()
            for x in (k for x in node.kids for k in (x.kids if x.key == "+" else [x])):
                places = self.kids[at].setdefault(x.key, [])
                places.append(len(self.state))
                self.kids.append({})
                self.state.append("constant " + _hash(x.text or "") if x.state == "constant" else x.state)
                if needed[id(x)]:
                    todo.append((x, places[-1]))

    def dump(self) -> str:
        return json.dumps([self.kids, self.state], ensure_ascii=False, separators=(",", ":"))


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


@lru_cache(maxsize=512)
def load(dumped: str) -> Reader:
    out = Reader()
    out.kids, out.state = json.loads(dumped)
    return out


def read(page: Part, by: Reader) -> str | None:
    """The page's text, each block by its place in the wrapper; None if the page lacks the region."""
    blocks: list[str] = []
    found = by.state[0] == "main"
    core = page.core
    # a node, its place in the wrapper (-1: none), and whether it is within the region
    todo: list[tuple[Part, int, bool]] = [(page, 0, found)]
    while todo:
        node, at, inside = todo.pop()
        if node.key == "#":
            if inside and not (at >= 0 and by.state[at].startswith("constant") and by.state[at][9:] == _hash(node.text)):
                blocks.append(node.text)
            continue
        known = by.kids[at] if at >= 0 else {}
        met: Counter[str] = Counter()
        below_: list[tuple[Part, int, bool]] = []
        for x in node.kids:
            places = known.get(x.key)
            place = places[min(met[x.key], len(places) - 1)] if places else -1
            met[x.key] += 1
            state = by.state[place] if place >= 0 else ""
            if x.key != "#" and (state == "aside" if place >= 0 else is_aside(x, page.mass, core)):
                continue
            found |= state == "main"
            below_.append((x, place, inside or state == "main"))
        todo += reversed(below_)
    return "\n".join(blocks) if found else None


def main_text(page: str, by: Reader | None) -> str:
    """Read a page by its host's wrapper, or by a wrapper of its own if it lacks the region."""
    if not page:
        return ""
    own = tree(page)
    text = read(own, by) if by is not None else None
    if text is None:
        text = read(own, Reader(infer([page])))
    return text or ""


# --- on tables ----------------------------------------------------------------


_PARTIAL = pa.schema([("host", pa.string()), ("page", pa.string()), ("wrapper", pa.string())])
_JUDGED = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("without", pa.string()), ("constant", pa.float64())])


def _align_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of a task's pages of each host; ``page`` is the digest of the only one, empty if there are more."""
    held: dict[str, tuple[Part, set[bytes]]] = {}

    def rows() -> pa.RecordBatch:
        out = [(h, next(iter(met)).hex() if len(met) == 1 else "", packed(w)) for h, (w, met) in held.items()]
        return arrowkit.emit({k: [r[i] for r in out] for i, k in enumerate(_PARTIAL.names)}, _PARTIAL)

    for batch in batches:
        for host, page in zip(arrowkit.strings(batch, "host"), arrowkit.strings(batch, "html"), strict=True):
            digest = hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if not page or host in held and digest in held[host][1]:
                continue
            own = wrapper_of(tree(page))
            if host in held:
                align_into(held[host][0], own)
                held[host][1].add(digest)
            else:
                if len(held) >= HELD_HOSTS:
                    yield rows()
                    held.clear()
                held[host] = (own, {digest})
    if held:
        yield rows()


def _judge_host(rows: pa.Table) -> pa.Table:
    """A host's wrapper; where constant parts may go also the one ``without`` them, and how long they are on a page."""
    found = rows.sort_by("wrapper")
    wrapper = aligned(map(unpacked, found.column("wrapper").to_pylist()))
    pages = set(found.column("page").to_pylist())
    judge(wrapper, len(pages) == 1 and pages != {""})
    out = {"host": [found.column("host")[0].as_py()], "wrapper": [Reader(wrapper).dump()], "without": [None], "constant": [None]}
    if constants := _constants(wrapper):
        out["constant"] = [sum(x.mass for x in constants) / wrapper.seen]
        _drop(constants)
        out["without"] = [Reader(wrapper).dump()]
    return pa.table(out, schema=_JUDGED)


_READ = pa.schema([("host", pa.string()), ("missing", pa.bool_()), ("text", pa.int64()), ("n", pa.int64())])


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 64):
        texts = [read(tree(p), load(by)) for p, by in zip(arrowkit.strings(batch, "html"), arrowkit.strings(batch, "wrapper"), strict=True)]
        rows = {"host": arrowkit.strings(batch, "host"), "missing": [x is None for x in texts], "n": [len(x or "") for x in texts]}
        yield arrowkit.emit(rows | {"text": [int.from_bytes(bytes.fromhex(_hash(x or "")), "big", signed=True) for x in texts]}, _READ)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (what a page is read by) of each host, of all its pages."""
    host, _ = parse_url(F.col("url"))
    rows = pages.select(host.alias("host"), "html").filter("html != ''")
    parts = rows.mapInArrow(_align_task, "host string, page string, wrapper string")
    judged = materialize(parts.groupBy("host").applyInArrow(_judge_host, "host string, wrapper string, without string, constant double"), "judged")
    open_ = judged.filter("without is not null")
    if open_.isEmpty():
        return judged.select("host", "wrapper")
    own = rows.join(F.broadcast(open_.select("host", "wrapper")), "host").mapInArrow(_read_task, "host string, missing boolean, text long, n long")
    # pages with the same text count once for each text, but a mean needs all
    told = own.groupBy("host", "text").agg(F.max("missing").alias("missing"), F.sum("n").alias("n"), F.count("*").alias("pages"))
    told = told.groupBy("host").agg(F.max("missing").alias("missing"), F.count("*").alias("texts"), (F.sum("n") / F.sum("pages")).alias("mean"))
    goes = ~F.col("missing") & (F.col("texts") >= CONSTANT_PAGES) & (2 * F.col("constant") < F.col("mean"))
    return judged.join(told, "host", "left").select("host", F.when(goes, F.col("without")).otherwise(F.col("wrapper")).alias("wrapper"))


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrowkit.sliced(batches, 64):
        readers = [load(x) if x else None for x in arrowkit.strings(batch, "wrapper")]
        texts = [main_text(p, by) for p, by in zip(arrowkit.strings(batch, "html"), readers, strict=True)]
        rows = {k: arrowkit.strings(batch, k) for k in ("page_id", "url")}
        yield arrowkit.emit(rows | {"text": texts, "n_chars": [len(x) for x in texts]}, _TEXTS)


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    arrowkit.small_batches(pages.sparkSession)
    known = materialize(wrappers(pages), "wrappers")
    host, _ = parse_url(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    return rows.join(known, "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
