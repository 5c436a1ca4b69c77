"""Main text of web pages by scoring the element tree.

Every paragraph gets points for its length and commas and passes them to its ancestors, in full to the parent, by half to
the grandparent, and so on. An element's score is discounted by the share of its text that stands in links. The best
container is kept, with those of its siblings that score well or are plain paragraphs or headings, and those with few links
that are next to or between kept ones, however short.

Words in a class, id or role name what isn't main text. Reader comments, adverts, side text and the like go at any size,
unless the element holds the article or h1. Words that only tell a layout ("has-sidebar", "no-comments") or may mean anything
("widget") make a block suspect: it is left out if it holds little of the page's text, and scores less otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwright.llm.common import text_or_empty

#: Elements without main text.
SKIPPED = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object embed svg canvas dialog menu audio video map".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What ends an open paragraph or list item.
ENDED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"])}
#: Elements that end with their parent if they have no end tag.
OPEN_ENDED = frozenset(["p", *ENDED_BY])
#: Words in class, id, role or label that name reader comments, and other text beside the article.
COMMENTS = frozenset("comment comments commentlist replies respond disqus".split())
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer masthead menu modal nav navbar navigation newsletter "
    "notice pager pagination popup promo recommended related share sharing sidebar social sponsor sponsored subscribe toolbar".split()
)
#: Words that may mean anything.
LOOSE = frozenset(["foot", "header", "search", "widget"])
#: With one of these beside it a word only tells of a layout or a state; beside the second ones too, but for comments.
LAYOUT = frozenset("with has have no not without open opened closed enabled disabled show hide count".split())
CENTRE = frozenset("content main article body text wrap wrapper layout page".split())
NAME = re.compile(r"[^\s]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: White space as in HTML, with the no-break space.
SPACE = re.compile(r"[\s\xa0]+")
CONTAINERS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: A block that is only suspect is left out with a smaller share of the text outside links; but such blocks leave a page at least the share LEFT.
LITTLE, LEFT = 0.3, 0.1
#: What the points of text in suspect blocks count.
DISCOUNT = 0.5
SCHEMA = "page_id long, url string, text string, n_chars long"


def signs_of(attrs: list[tuple[str, str | None]]) -> tuple[frozenset[str], frozenset[str]]:
    """Unwanted words of an element, and those of them that name the element as such."""
    words, firm = set(), set()
    for key, value in attrs:
        if not value or key not in ("class", "id", "role", "aria-label"):
            continue
        for name in NAME.findall(value):
            parts = {w.lower() for w in PART.findall(name)}
            found = parts & (COMMENTS | BESIDE | LOOSE)
            words |= found
            if found and not parts & LAYOUT:
                firm |= found & (COMMENTS if parts & CENTRE else COMMENTS | BESIDE)
    return frozenset(words), frozenset(firm)


class Element:
    __slots__ = ("cut", "firm", "group", "holds", "in_comments", "length", "linked", "parent", "score", "signs", "suspect", "tag", "title", "under_sign")

    def __init__(self, tag: str, parent: Element | None, signs: frozenset[str] = frozenset(), firm: frozenset[str] = frozenset()):
        self.tag, self.parent, self.signs, self.firm = tag, parent, signs, firm
        self.suspect: Element | None = self if signs else parent and parent.suspect  # the innermost element with signs that holds it
        self.in_comments = bool(firm & COMMENTS) or parent is not None and parent.in_comments
        self.title = tag == "header" or parent is not None and parent.title and tag not in HEADINGS  # in an article's header only headings count
        self.score, self.length, self.linked, self.holds, self.under_sign, self.cut = 0.0, 0, 0, False, False, False
        self.group: Element | None = None


class Tree(HTMLParser):
    """Builds block elements and the blocks of text between their edges. Inline markup leaves no element.

    What is not closed at the end of the page, a comment or a tag, is no text. Open elements are counted by name, so an end tag without a
    start takes no search, and the time is linear in the page, however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("#root", None)
        self.elements = [self.root]  # outer ones first
        self.blocks: list[tuple[Element, str, int]] = []
        self.suspects: list[Element] = []  # outer ones first
        self.centres: list[Element] = []  # articles, main elements and h1
        self.text: list[str] = []
        self.links, self.in_link = 0, 0
        self.open: Counter[str] = Counter()
        self.hidden: list[str] = []  # open elements from the outermost skipped one on, inline ones too
        self.hidden_open: Counter[str] = Counter()
        self.hidden_blocks = 0  # within the outermost skipped one

    def parse_comment(self, i: int, report: int = 1) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return len(self.rawdata) if end < 0 else end

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return len(self.rawdata) if end < 0 else end

    def end_block(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text and not self.top.title:
                self.blocks.append((self.top, text, min(self.links, len(text))))
            self.text, self.links = [], 0

    def hide(self, tag: str) -> None:
        self.hidden_blocks += bool(self.hidden) and tag in BLOCKS
        self.hidden.append(tag)
        self.hidden_open[tag] += 1

    def unhide(self) -> str:
        tag = self.hidden.pop()
        self.hidden_open[tag] -= 1
        self.hidden_blocks -= bool(self.hidden) and tag in BLOCKS
        return tag

    def ends_hidden(self, by: frozenset[str]) -> bool:
        """Whether the skipped element is one of ``by`` and no block is open in it, so that it may end without an end tag."""
        return bool(self.hidden) and self.hidden[0] in by and not self.hidden_blocks

    def show(self) -> None:
        while self.hidden:
            self.unhide()

    def leave(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and self.ends_hidden(ENDED_BY.get(tag, frozenset()) | {"p"}):
            self.show()
        if tag in VOID:
            if not self.hidden:
                if tag == "br":
                    self.text.append(" ")
                elif tag == "hr":
                    self.end_block()
            return
        if self.hidden:
            self.hide(tag)
            return
        own_header = tag == "header" and any(self.open[t] for t in CONTAINERS)
        if tag in SKIPPED and not own_header or any(k == "hidden" or k == "style" and v and UNSEEN.search(v) for k, v in attrs):
            if tag in BLOCKS or tag in SKIPPED:
                self.end_block()
            self.hide(tag)
        elif tag in BLOCKS:
            self.end_block()
            if self.top.tag == "p":  # a paragraph holds no blocks
                self.leave()
            if self.top.tag in ENDED_BY.get(tag, ()):
                self.leave()
            signs, firm = signs_of(attrs) if tag not in HEADINGS and tag not in ("html", "body", "main", "header") else (frozenset(), frozenset())
            if tag == "article":  # only as a comment, or an advert, is it none
                signs = firm
            if LOOSE >= signs and any(self.open[t] for t in CONTAINERS):
                signs = frozenset()
            self.top = Element(tag, self.top, signs, firm)
            self.open[tag] += 1
            self.elements.append(self.top)
            if signs:
                self.suspects.append(self.top)
            if (tag in CONTAINERS or tag == "h1") and not firm:
                self.centres.append(self.top)
        elif tag == "a":
            self.in_link += 1

    def handle_endtag(self, tag: str) -> None:
        if self.hidden_open[tag]:
            while self.unhide() != tag:
                pass
            return
        if self.hidden:
            if not (tag in BLOCKS and self.ends_hidden(OPEN_ENDED) and self.open[tag]):
                return
            self.show()
        if tag in BLOCKS:
            self.end_block()
            if self.open[tag]:
                while self.top.tag != tag:
                    self.leave()
                self.leave()
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)
        elif tag == "br":
            self.text.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.in_link:
                self.links += len(data)


def read_tree(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    tree.end_block()
    return tree


def mark_holders(tree: Tree) -> None:
    """Mark the elements that hold the article: an article, main element or h1 outside reader comments, or any where all text is in comments."""
    outside = any(not element.in_comments for element, _, _ in tree.blocks)
    for centre in tree.centres:
        at = None if outside and centre.in_comments else centre.parent
        while at and not at.holds:
            at.holds, at = True, at.parent


def leave_out(tree: Tree) -> None:
    """Drop the blocks in elements that are named as something else, and in suspect ones with little of the page's text outside links.

    Where suspect ones leave little, the word that most of their text has is no sign on this page, and so on. Where nothing at all is
    left, the same goes for the words of what stands beside articles; comments never come back.
    """
    if not tree.suspects:
        return
    mark_holders(tree)
    own: Counter[int] = Counter()
    for element, text, linked in tree.blocks:
        own[id(element.suspect)] += len(text) - linked
    total, signs = own.total(), frozenset().union(*(e.signs for e in tree.suspects))
    while True:
        size, dropped, loose, firm = own.copy(), set(), Counter(), Counter()
        for e in reversed(tree.suspects):
            named = e.firm & signs
            if e.signs & signs and not e.holds and (named or size[id(e)] < LITTLE * total):
                dropped.add(id(e))
                (firm if named else loose).update(dict.fromkeys((named or e.signs & signs) - COMMENTS, size[id(e)]))
            else:
                size[id(e.parent.suspect)] += size[id(e)]
        left = size[id(None)]
        words = loose if loose and left < LEFT * total else firm if not left else None
        if not words:
            break
        signs -= {max(sorted(words), key=words.__getitem__)}
    for e in tree.suspects:
        e.signs &= signs
        if id(e.parent.suspect) in dropped:
            dropped.add(id(e))
    tree.blocks = [b for b in tree.blocks if id(b[0].suspect) not in dropped]


def score(tree: Tree) -> list[Element]:
    """Give points to the ancestors of every block; returns the elements that got any, in page order.

    An ancestor gets half of what its child got, so each element passes its sums to its parent once, inner ones first.
    """
    for e in tree.elements[1:]:
        e.under_sign = bool(e.signs) or e.parent.under_sign
    for element, text, linked in tree.blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        if element.under_sign:
            points *= DISCOUNT
        holder = element.parent if element.tag in ("p", "pre", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt") and element.parent else element
        holder.score += points
        element.length += len(text)
        element.linked += linked
    for e in reversed(tree.elements[1:]):
        e.parent.score += e.score / 2
        e.parent.length += e.length
        e.parent.linked += e.linked
    return [e for e in tree.elements if e.score]


def worth(element: Element) -> float:
    return element.score * (1 - element.linked / max(1, element.length))


def main_blocks(tree: Tree) -> list[str]:
    """Blocks of the best container and of the siblings that go with it, in page order."""
    leave_out(tree)
    scored = score(tree)
    if not scored:
        return []
    best = max(scored, key=worth)  # of equals the first
    at = best
    while at:  # sections of one article belong together
        if at.tag in CONTAINERS:
            best = at
            break
        at = at.parent
    while best.tag not in CONTAINERS and best.parent and best.parent.tag not in ("body", "html", "#root") and best.parent.length == best.length:
        best = best.parent  # a wrapper of the same text
    around = best.parent if best.tag != "main" else None
    for e in tree.elements:  # the best container, and the children of its parent
        e.group = e if e is best or around is not None and e.parent is around or e is around else e.parent.group if e.parent else None
    # the children of the parent in page order, its own text between them too, with their blocks
    siblings: list[tuple[Element, list[str], int]] = []
    for element, text, linked in tree.blocks:
        at = element.group
        if not at:
            continue
        if siblings and siblings[-1][0] is at:
            siblings[-1][1].append(text)
            siblings[-1] = (at, siblings[-1][1], siblings[-1][2] + linked)
        else:
            siblings.append((at, [text], linked))
    keep = kept_articles(siblings, best) if best.tag == "article" else kept_siblings(siblings, best, around)
    return [text for k in keep for text in siblings[k][1]]


def kept_articles(siblings: list[tuple[Element, list[str], int]], best: Element) -> list[int]:
    """Places of the articles of one parent that aren't mostly links, and of the headings right before them."""

    def few_links(k: int) -> bool:
        return siblings[k][2] <= sum(map(len, siblings[k][1])) / 2

    keep: list[int] = []
    for k, (sibling, _, _) in enumerate(siblings):
        if sibling is best or sibling.tag == "article" and not sibling.signs and few_links(k):
            above = k - 1
            while above >= 0 and siblings[above][0].tag in HEADINGS and few_links(above):
                above -= 1
            keep += range(above + 1, k + 1)
    return keep


def kept_siblings(siblings: list[tuple[Element, list[str], int]], best: Element, around: Element | None) -> list[int]:
    """Places of the siblings to keep: those that score well or are plain paragraphs or headings, and next to or between kept ones all with few links."""
    least = max(2.0, 0.2 * worth(best))

    def by_itself(sibling: Element, links: float) -> bool:
        if sibling is best:
            return True
        if sibling is around or sibling.signs:
            return False
        if sibling.tag in ("p", "blockquote", "pre") or sibling.tag in HEADINGS:
            return links <= 1 / 4
        return worth(sibling) >= least and links <= 1 / 2

    links = [linked / max(1, sum(map(len, texts))) if s is around or not s.signs else 1.0 for s, texts, linked in siblings]  # suspect ones stay away
    keep = {k for k, s in enumerate(siblings) if by_itself(s[0], links[k])}
    first, last = min(keep), max(keep)
    keep |= {k for k in range(first, last) if links[k] <= 1 / 2}
    for step in (1, -1):
        for k in sorted(keep, reverse=step < 0):
            k += step
            while 0 <= k < len(siblings) and k not in keep and links[k] <= 1 / 4:
                keep.add(k)
                k += step
    return sorted(keep)


def extract(html: str) -> str:
    return "\n".join(main_blocks(read_tree(html)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text and its code points for every page; no shuffle.

    Null html counts as empty; an empty page, or one without main text, gives an empty text. Of equally good containers the
    first in the page wins. Null ids and urls and repeated rows stay as they are. Empty tables give empty results;
    other columns aren't read. Memory is bounded by Arrow's batch size and the longest page.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(_extracted, SCHEMA)
