"""Main text of web pages by tree scoring.

A page becomes a tree.  Every paragraph-like element with some text gives points
to its ancestors: one, one for each comma, and up to three for length; all of
them to its parent, half to the next, a third and less further up.  An
element's points are discounted by the share of its text that is inside links.
The element with the most points is the container; siblings with enough points
of their own, and paragraphs of prose beside it, are kept too.

Names only lower a score or confirm what the scores say.  A class, id or role
names boilerplate if one of its names says so as a whole: "cookie-notice" and
"site-footer" do, "no-sidebar", "menu-open" or "market-share" do not.  An element
with such a name, and a form, is dropped if it holds no more than half of the
page's prose.  One that holds more is the wrapper of what it holds: it stays, with
fewer points.  It goes all the same where an article, a heading of the page or the
like stands outside with paragraphs, so long comments don't displace a short
article.  If nothing is found, the page is read again without regard to names.

Defined cases: a null or empty page has no text; markup that is never closed is
closed where its parent ends; elements nested deeper than DEEPEST become siblings,
with their text, so that work grows with the page alone, however long it is; a
page without a scoring paragraph gives the text of its whole body without
boilerplate; of containers with equal points the first counts; rows that repeat
give the same text; other columns are not read, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the main text.
DROPPED = frozenset(
    "head script style noscript template nav footer header aside button select option textarea input label fieldset iframe "
    "object embed applet svg canvas audio video map dialog menu search noframes noembed title".split()
)
#: Words in a class, id or role that mark boilerplate, and those that mark content.
BOILERPLATE = frozenset(
    "ad adbox ads adsbygoogle adsense adslot adunit advert advertisement advertising adverts alert banner breadcrumb breadcrumbs combx comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright cta discussion discussions disqus disclaimer feedback footer gdpr header hidden masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related remark replies reply respond responses rss search share "
    "sharing shoutbox sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription taboola tags talkback toolbar topbar widget widgets".split()
)
CONTENT = frozenset("article body content entry hentry main page post story text blog".split())
#: Words that stand beside a boilerplate word in a name and leave it one.
BESIDE = CONTENT | frozenset(
    "area articles bar block bottom box button buttons center col column container counter footer form global group header icons inline inner item items js left link links list module "
    "panel posts primary reader readers right row secondary section site stories strip td the top unit user users wp wrap wrapper zone".split()
)
#: Names of these with "header" are an article's own heading.
HEADED = frozenset("article entry story post".split())
#: Most elements within each other, as browsers have it.
DEEPEST = 512
PARAGRAPHS = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 div section article main".split())
SCOPE_ENDS = frozenset("html body table td th caption button object article section main div aside nav header footer form li ul ol dl blockquote fieldset figure".split())
#: An element that starts closes these, up to the given ancestors.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "option", "optgroup", "legend"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("boiler", "children", "depth", "dropped", "links", "name", "parent", "points", "prose", "words")

    def __init__(self, name: str, parent: Node | None, words: frozenset[str] = frozenset(), dropped: bool = False, boiler: bool = False):
        self.name, self.parent, self.words, self.dropped, self.boiler = name, parent, words, dropped, boiler
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.points: float | None = None
        self.prose = self.links = 0.0


def _is_boilerplate(words: set[str]) -> bool:
    """Whether the words of one name say boilerplate as a whole."""
    said = words & BOILERPLATE
    return bool(said) and words <= BOILERPLATE | BESIDE and not (said == {"header"} and words & HEADED)


def _names(attributes: str) -> tuple[frozenset[str], bool, bool]:
    """The words of class, id and role; whether a name of them is boilerplate's; whether the element is hidden."""
    words: set[str] = set()
    hidden = boiler = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        else:
            for one in value.split():
                own = {w for w in _WORD.findall(_HUMP.sub(" ", one).lower()) if len(w) > 1}
                boiler = boiler or _is_boilerplate(own)
                words |= own
    return frozenset(words), boiler, hidden


def parse(page: str) -> Node:
    root = Node("#root", None)
    at, place = root, 0
    size = len(page)
    while place < size:
        match = _TOKEN.search(page, place)
        if match is None:
            at.children.append(page[place:])
            break
        if match.start() > place:
            at.children.append(page[place : match.start()])
        place = match.end()
        if match[2] is None:
            continue
        name = match[2].lower()
        if match[1]:
            at = _close(at, name)
            continue
        if name in ENDS_PARAGRAPH:
            at = _end_paragraph(at)
        if name in CLOSES:
            at = _close_open(at, *CLOSES[name])
        words, boiler, hidden = _names(match[3]) if match[3] else (frozenset(), False, False)
        boiler = name == "form" or boiler and name not in ("html", "body", "article", "main")
        if at.depth >= DEEPEST:
            at = at.parent
        node = Node(name, at, words, hidden or name in DROPPED, boiler)
        at.children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, place)
            if name in ("textarea", "title"):
                node.children.append(page[place : end.start() if end else size])
            place = end.end() if end else size
            continue
        if match[3].endswith("/") and name not in BLOCK and name in ("svg", "path", "use"):
            continue
        at = node
    return root


def _close(at: Node, name: str) -> Node:
    """The element open after an end tag; one that closes nothing is passed over."""
    node = at
    while node.parent is not None and node.name != name:
        if name not in BLOCK and node.name in BLOCK:
            return at  # an inline end tag doesn't close blocks
        node = node.parent
    return node.parent if node.parent is not None else at


def _end_paragraph(at: Node) -> Node:
    node = at
    while node.parent is not None and node.name not in SCOPE_ENDS:
        if node.name == "p":
            return node.parent
        node = node.parent
    return at


def _close_open(at: Node, names: set[str], until: set[str]) -> Node:
    node, found = at, at
    while node.parent is not None and node.name not in until:
        if node.name in names:
            found = node.parent
        node = node.parent
    return found


def _walk(root: Node) -> list[Node]:
    """Elements that aren't dropped, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
    return out


def _drop_boilerplate(root: Node) -> bool:
    """Drop forms and the elements named as boilerplate, but for wrappers; whether any were dropped."""
    nodes = _walk(root)
    named = [n for n in nodes if n.boiler]
    if not named:
        return False
    own = {n: length for n in nodes if n.name in PARAGRAPHS and (length := len("".join(_inline(n)).strip())) >= 25}
    held: dict[Node, int] = {}  # length of the paragraphs of an element
    for node in reversed(nodes):  # children first
        held[node] = own.get(node, 0) + sum(held[c] for c in node.children if not isinstance(c, str) and not c.dropped)
    wrappers = [n for n in named if 2 * held[n] > held[root]]
    for node in named:
        node.dropped = True
    if wrappers:
        clear = _walk(root)
        left = {n: 0 for n in clear}
        for node in reversed(clear):
            left[node] = own.get(node, 0) + sum(left[c] for c in node.children if not isinstance(c, str) and not c.dropped)
        headed = left[root] > 0 and any(n.name == "h1" or left[n] and (n.name in ("article", "main") or n.words & CONTENT and n.name not in ("html", "body")) for n in clear)
        for node in wrappers:
            node.dropped = headed and node.name != "form"
    return any(n.dropped for n in named)


def _squeeze(text: str) -> str:
    return " ".join(html.unescape(text).split())


def score(root: Node) -> list[Node]:
    """Points for all elements; those that got any."""
    nodes = _walk(root)
    for node in reversed(nodes):  # children first
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if not isinstance(c, str) and not c.dropped]
        node.prose = own + sum(c.prose for c in inner)
        node.links = node.prose if node.name == "a" else sum(c.links for c in inner)
    scored = []
    for node in nodes:
        if node.name not in PARAGRAPHS:
            continue
        text = "".join(_inline(node))
        if len(text.strip()) < 25:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        level, up = 0, node.parent
        while up is not None and level < 5:
            if up.points is None:
                up.points = _start(up)
                scored.append(up)
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level, up = level + 1, up.parent
    for node in scored:
        node.points *= 1 - (node.links / node.prose if node.prose else 0)
    return scored


def _start(node: Node) -> float:
    base = {"article": 25, "main": 25, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "#root": -50, "html": -50, "body": -5}.get(node.name, 0)
    return base + (25 if node.words & CONTENT and node.name not in ("html", "body") else 0) - (25 if node.boiler else 0)


def _inline(node: Node) -> Iterator[str]:
    """A block's own text, without that of the blocks inside."""
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            yield c
        elif c.name == "br":
            yield " "
        elif not c.dropped and c.name not in BLOCK:
            todo.extend(reversed(c.children))


def blocks(node: Node) -> list[str]:
    """The texts of all blocks below an element, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = _squeeze("".join(line))
            line.clear()
            if text:
                out.append(text)

    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        c, done = todo.pop()
        if isinstance(c, str):
            line.append(c)
        elif done:
            end()
        elif c.dropped:
            if c.name in BLOCK:
                end()
        elif c.name == "br":
            line.append(" ")
        else:
            if c.name in BLOCK:
                end()
                todo.append((c, True))
            todo.extend((x, False) for x in reversed(c.children))
    end()
    return out


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    dropped = _drop_boilerplate(root)
    text = _main(root)
    return _main(parse(page)) if dropped and not text else text


def _main(root: Node) -> str:
    scored = score(root)
    if not scored:
        return " ".join(blocks(root))
    best = max(scored, key=lambda n: n.points)
    up = best
    while up.parent is not None:  # an article around the container is the container
        if up.name in ("article", "main") and up.points is not None:
            best = up
            break
        up = up.parent
    if best.parent is None:
        return " ".join(blocks(best))
    peers = [n for n in scored if n is not best and _alike(n, best)]
    return " ".join(_kept(best, peers))


def _alike(node: Node, best: Node) -> bool:
    """Whether a container is another part of the best one's article: the same box at the same depth, with enough points and few links."""
    same = node.name == best.name and node.depth == best.depth and node.words == best.words and not node.dropped
    return same and node.points >= best.points * 0.2 and node.links < node.prose * 0.25


def _kept(best: Node, peers: list[Node]) -> list[str]:
    """The texts of the best container, its like siblings, and its peers that other boxes hold, in page order."""
    holders: set[int] = set()  # ancestors of the peers
    for n in peers:
        while n is not None and id(n) not in holders:
            holders.add(id(n))
            n = n.parent
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    # the lowest box around all of them, the best one's parent at least
    top = path[1]
    if peers:
        ancestors = {id(n): k for k, n in enumerate(path)}
        highest = 1
        for n in peers:
            while id(n) not in ancestors:
                n = n.parent
            highest = max(highest, ancestors[id(n)])
        top = path[highest]
    ours = {id(n) for n in path}
    kept: list[str] = []

    def collect(box: Node) -> None:
        for c in box.children:
            if isinstance(c, str) or c.dropped:
                continue
            if c is best:
                kept.extend(blocks(c))
                continue
            density = c.links / c.prose if c.prose else 0.0
            enough = c.points is not None and c.points >= max(10.0, best.points * 0.2)
            prose = c.name == "p" and (c.prose > 80 and density < 0.25 or 0 < c.prose <= 80 and density == 0 and "." in "".join(_inline(c)))
            beside = box is path[1] and (enough or prose)
            if beside or id(c) in peer_ids:
                kept.extend(blocks(c))
            elif id(c) in ours or id(c) in holders:
                collect(c)

    peer_ids = {id(n) for n in peers}
    collect(top)
    return kept


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.decode("utf-8", "replace")) if page else "" for page in common.values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
