"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and its commas on to its ancestors, fewer to the farther ones; an
element's points are cut by the share of its text that stands in links. The best element is the article, together
with those of its siblings that score well or are plain paragraphs. Page furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts, styles) is left out before the scoring, by tag, role, class and id.

Classes and ids may mislead. Words that name furniture and wrappers alike (widget, social, related) only cut the points
of what stands in the element. So do the other words if the element has a good name too, holds an article, or holds
most of the page's text. Inside the article, such elements stay if they score as well as a sibling must. A form is left out
unless it holds an article, or most of the text of a page without one: some servers wrap whole pages into a form.

All work is in proportion to the page: what an element needs to know of those around it is handed down when it opens,
and sums are handed up once, in reverse order.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm import blocks

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SLASH_VALUE = re.compile(r"""=\s*[^\s"'=]*/$""")  # the slash belongs to a value without quotes
_PARTS = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][a-z-]+")  # "has-sidebar" says what stands beside the element

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
# A start tag of the first kind ends an open element of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("ul ol dl table article section div main body td th".split())
FURNITURE_TAGS = frozenset(
    "head script style noscript template iframe object embed svg canvas nav footer aside button select textarea input dialog menu audio video title".split()
)
FURNITURE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
AMBIGUOUS_NAMES = frozenset("header promo promoted related share sharing social widget".split())
_REPLIES = frozenset("comment comments consent cookie cookies disqus respond".split())  # often longer than the article
_LEAST = 250  # letters that furniture by name must have to be brought back for being most of a page
GOOD_NAMES = frozenset("article body content entry main post story text".split())
_PARAGRAPH = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption summary".split())


# For every tag, the elements that a start tag may end (of its group) and that it hides from tags inside it.
_GROUPS = {"p": ({"p"}, _BARRIER)} | {tag: (closed, _BARRIER - closed) for tag, closed in _CLOSES.items()}
_OPENS = {tag: [g for g, (closed, _) in _GROUPS.items() if tag in closed] for tag in _BARRIER | {"p"} | set().union(*_CLOSES.values())}
_HIDES = {tag: [g for g, (_, barrier) in _GROUPS.items() if tag in barrier] for tag in _BARRIER}


class Node:
    __slots__ = (
        "tag", "parent", "names", "skip", "marks", "good", "prose", "holds", "most", "doubt", "gone", "factor", "known", "points", "chars", "linked",
        "owner", "below_link", "in_article", "near", "side", "chosen", "stays",
    )

    def __init__(self, tag: str, parent: Node | None, names: frozenset = frozenset(), skip: bool = False, marks: frozenset = frozenset(), good: bool = False):
        self.tag, self.parent, self.names, self.skip, self.marks, self.good = tag, parent, names, skip, marks, good
        self.prose = self.chars = self.linked = 0
        self.holds = self.most = self.doubt = self.gone = False
        self.factor, self.known = 1.0, frozenset()
        self.points = 0.0
        self.side, self.chosen, self.stays = None, False, True
        # The block that holds its text; whether a link or an article is around it; open elements that a start tag may end.
        self.owner = self if tag in BLOCK or parent is None else parent.owner
        self.below_link = parent is not None and (parent.below_link or parent.tag == "a")
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.near = {} if parent is None else parent.near
        if tag in _OPENS or tag in _HIDES:
            self.near = self.near | dict.fromkeys(_HIDES.get(tag, ())) | dict.fromkeys(_OPENS.get(tag, ()), self)


def _furniture(tag: str, attributes: str, parent: Node) -> tuple[frozenset, bool, frozenset, bool]:
    """Names, whether it is furniture for sure, its names that furniture has, and whether it has a good name as well."""
    names: set[str] = set()
    clean: set[str] = set()  # of classes without names of furniture
    skip = parent.skip or tag in FURNITURE_TAGS
    if attributes and not skip:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for one in _LAYOUT.sub(" ", value).split():
                    parts = set(_PARTS.findall(one))
                    names |= parts
                    if not parts & FURNITURE_NAMES:
                        clean |= parts
            elif key == "role":
                skip |= value in FURNITURE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                skip = True
            elif key == "style":
                skip |= "display:none" in value.replace(" ", "")
    whole = tag in ("html", "body", "article", "main")  # an article's own names do not make it furniture
    marks = frozenset() if skip or whole else frozenset(names & FURNITURE_NAMES | ({"form"} if tag == "form" else set()))
    good = bool(GOOD_NAMES & (names if marks <= AMBIGUOUS_NAMES else clean))
    if marks == {"header"} and good:  # an entry's header belongs to it
        marks = frozenset()
    if not skip and tag == "header":  # a page's header; an article's own heading belongs to it
        skip = not (parent.tag in ("article", "main") or parent.in_article)
    return frozenset(names), skip, marks, good


def parse(page: str) -> tuple[list[tuple[Node, list]], list[Node]]:
    """The blocks of a page in order, each with the element that holds it and its pieces (text, whether in a link, element);
    and all elements, the root first and each before what it holds. Broken markup is read as far as it goes."""
    root = Node("html", None)
    node, found, text, nodes = root, [], [], [root]
    opened: dict[str, int] = {}  # open elements of each tag, without the root

    def end_block() -> None:
        if text:
            found.append((node.owner, text.copy()))
            text.clear()

    def add(piece: str) -> None:
        if piece and not node.skip:
            text.append((piece, node.tag == "a" or (node.tag not in BLOCK and node.below_link), node))

    def close(upto: Node) -> Node:
        """End ``upto``, an open element, and all open ones inside it."""
        n = node
        while True:
            opened[n.tag] -= 1
            if n is upto:
                return n.parent
            n = n.parent

    at = 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        closing, tag = match.group(1), match.group(2)
        if tag is None or match.group(4) == "":  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if tag in BLOCK:
            end_block()
        if closing:
            if opened.get(tag):
                n = node
                while n.tag != tag:
                    n = n.parent
                node = close(n)
            continue
        if tag in VOID or tag == "html":  # the root is there already
            continue
        if tag in BLOCK and node.near.get("p") is not None:  # an open paragraph ends here
            node = close(node.near["p"])
        if tag in _CLOSES and node.near.get(tag) is not None:
            node = close(node.near[tag])
        child = Node(tag, node, *_furniture(tag, match.group(3) or "", node))
        nodes.append(child)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = len(page) if end is None else end.end()
            continue
        if not (match.group(3) or "").endswith("/") or _SLASH_VALUE.search(match.group(3)):
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return found, nodes


def _measure(found: list[tuple[Node, list]], nodes: list[Node]) -> None:
    """The text outside links that every element holds, and whether it holds an article."""
    for _, pieces in found:
        for piece, inside, n in pieces:
            if not inside:
                n.prose += len("".join(piece.split()))
    for n in reversed(nodes[1:]):
        n.parent.prose += n.prose
        n.parent.holds |= n.holds or (n.tag in ("article", "main") and not n.skip and not n.names & (FURNITURE_NAMES - AMBIGUOUS_NAMES))


def _judge(nodes: list[Node], spare: bool) -> None:
    """Which elements go for their names, and by how much points are cut in those that may be furniture."""
    total = nodes[0].prose
    for n in nodes[1:]:
        up = n.parent
        n.gone, n.doubt, n.factor, n.known = up.gone, False, up.factor, up.known
        marks = n.marks - up.known  # a wrapper that only repeats the words of a good element around it is no worse
        if n.gone or not marks:
            continue
        n.most = n.prose >= _LEAST and n.prose > (0.9 if marks & _REPLIES else 0.5) * total
        if marks == {"form"} and (n.holds or (n.most and not nodes[0].holds)):  # a form around the page
            continue
        vague = marks <= AMBIGUOUS_NAMES
        if not (vague or n.good or n.holds or n.most or spare):
            n.gone = True
            continue
        n.doubt, n.factor = True, min(up.factor, 0.5 if n.good else 0.25 if vague else 0.1)
        if n.good:
            n.known = up.known | marks


def _blocks(found: list[tuple[Node, list]], nodes: list[Node]) -> list[tuple[Node, str, float]]:
    """The blocks' words without what is gone, and their share in links; counts words for the elements around."""
    left = []
    for n in nodes:
        n.chars = n.linked = 0
    for owner, pieces in found:
        pieces = [(t, inside) for t, inside, n in pieces if not n.gone]
        words = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
        if words:
            linked = min(sum(len(t) for t, inside in pieces if inside), len(words))
            left.append((owner, words, linked / len(words)))
            owner.chars += len(words)
            owner.linked += linked
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    return left


def _link_share(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def article(page: str) -> str:
    """The main text: blocks of the best element and of its good siblings, in page order, parted by one blank."""
    read, nodes = parse(page)
    _measure(read, nodes)
    _judge(nodes, spare=False)
    found = _blocks(read, nodes)
    if not found and nodes[0].prose >= _LEAST:
        _judge(nodes, spare=True)
        found = _blocks(read, nodes)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for owner, words, _ in found:
        points = (1 + words.count(",") + min(len(words) / 100, 3)) * owner.factor
        holder = owner.parent if owner.tag in _PARAGRAPH and owner.parent is not None else owner
        level = 0
        while holder is not None and level < 4:
            if id(holder) not in scored:
                scored[id(holder)] = holder
                holder.points += 25 * holder.factor if holder.tag in ("article", "main") or holder.names & GOOD_NAMES else 0
            holder.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            holder, level = holder.parent, level + 1
    final = {key: n.points * (1 - _link_share(n)) for key, n in scored.items()}
    best = scored[max(final, key=final.get)]
    around = {id(best)}
    n = best.parent
    while n is not None:
        around.add(id(n))
        n = n.parent

    def scores(n: Node) -> bool:
        return final.get(id(n), 0.0) >= max(10 * max(n.factor, best.factor), 0.2 * final[id(best)])

    def stays(n: Node) -> bool:
        """Whether an element that may be furniture belongs to the article."""
        if not n.doubt or n.most or id(n) in around:
            return True
        return n.chars >= 80 and _link_share(n) < 0.33 if n.good else scores(n)

    for n in nodes[1:]:  # siblings: children of best's parent, handed down to what they hold
        n.side = n if n.parent is best.parent else n.parent.side
        n.stays = n.parent.stays and stays(n)
    best.chosen = True
    verdicts: dict[int, bool] = {}
    for owner, words, _ in found:
        side = owner.side
        if side is None or side is best:
            continue
        if id(side) not in verdicts:
            verdicts[id(side)] = scores(side)
        plain = side.tag == "p" and _link_share(side) < 0.25 and (side.chars > 80 or words.endswith((".", "!", "?")))
        side.chosen |= verdicts[id(side)] or plain
    for n in nodes[1:]:
        n.chosen |= n.parent.chosen
    text = [(i, owner, words) for i, (owner, words, _) in enumerate(found) if owner.chosen and owner.stays]
    if text and all(owner.tag != "h1" for _, owner, _ in text):  # a title that stands before the article's container
        titles = (words for owner, words, linked in reversed(found[: text[0][0]]) if owner.tag == "h1" and owner.stays and linked < 0.5)
        return " ".join([*(w for w in [next(titles, "")] if w), *(words for _, _, words in text)])
    return " ".join(words for _, _, words in text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text beside their furniture, give an empty text. Pages are read one by
    one: repeated rows give equal rows, no rows give none, other columns are not read.
    """

    def work(rows: pa.RecordBatch, texts: pa.LargeStringArray) -> dict:
        found = [article(t) for t in texts.to_pylist()]
        return {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return blocks.mapped(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", work, text="html")
