"""Main text of web pages by tree scoring.

The page is read into a tree with the usual repairs (void elements, implied ends,
unclosed and stray tags, raw text of scripts and styles). Paragraphs pass points for
length and commas to their ancestors, full points to the parent and ever smaller shares
further up; a container's points are discounted by the share of its text that stands in
links. The best container, those of its siblings that score alike, and headings and short
blocks among them are kept; menus, headers, footers, sidebars, notices, adverts, forms and
comments inside them are not. What an element is shows in its tag, or in the words of its
class, id and role; a wrapper with such a word that holds the page's article stays.

Every element is looked at a fixed number of times, however deep the page is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .store import read_table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?|<[!?][^>]*+>?", re.S)
_LABEL = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head script style nav footer header aside form button select option input textarea iframe noscript template svg canvas object embed dialog menu title xmp noembed noframes".split())
# Ends that an opening tag implies: the open element on the left ends when one of those on the right begins.
_ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body", "article", "main", "div", "p", "nav", "section"]),
}
# An implied end stops at these.
_SCOPE = frozenset("html body table td th article section div ul ol dl nav aside".split())
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|disqus|dialog|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|paywall|pop-?up|promo\w*|recommend\w*|related|replies|share|sharing|sidebar|side-bar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
_WANTED = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
_BONUS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": 0.0}


# Words of a class, id or role that an element around a whole article may have as well.
_AMBIGUOUS = re.compile(r"complementary|contentinfo|dialog|footer|header|masthead|related|side-?bar|social|toolbar|widget", re.I)
#: How many times the points of all that stays an element of such a name, or a form, must have to stay itself.
_OUTWEIGHS = 4.0

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Share of its points that an element hands on to the one above.
_HANDED_ON = 0.45


class _Node:
    __slots__ = ("vague", "weight", "tag", "parent", "place", "inline", "holder", "opened", "hard", "soft", "wanted", "points", "chars", "linked", "plain", "articles", "titles", "dropped", "branch")

    def __init__(self, tag: str, parent: _Node | None, place: int, hard: bool, soft: int, wanted: float):
        self.tag, self.parent, self.place, self.hard, self.soft, self.wanted = tag, parent, place, hard, soft, wanted
        self.inline = tag in _INLINE
        #: The nearest element here or above that is no inline one, and the inline tags that are open right in it.
        self.holder: _Node = parent.holder if self.inline and parent is not None else self
        self.opened: dict[str, int] = {}
        #: Whether an article's wrapper may be called like this; the points of the text in it.
        self.vague = False
        self.weight = 0.0
        self.points = 0.0
        self.chars = self.linked = self.plain = self.articles = self.titles = 0
        self.dropped = False
        self.branch: _Node | None = None


# Names such as has-sidebar or sidebar-layout may be those of a wrapper around the article.
_WRAPPER = re.compile(r"(?:has|no|with|without)[_-]|.*[_-](?:container|enabled|layout|open|page|site|wrap|wrapper)\Z", re.I)


def _unwanted(labels: str) -> int:
    """2 if a name says that an element is no part of an article, 1 if it may as well be a wrapper, else 0."""
    return max((1 if _WRAPPER.match(name) else 2 for name in labels.split() if _UNWANTED.search(name)), default=0)


def _blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements, parents first, and (element, text, characters in links) of each run of text between block borders, in page order."""
    root = _Node("#root", None, 0, False, 0, 0.0)
    open_, nodes, at = [root], [root], 0
    out: list[tuple[_Node, str, int]] = []
    buffer: list[tuple[str, bool]] = []
    links = 0
    count: dict[str, int] = {}

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(t for t, _ in buffer)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, inside in buffer if inside)
                out.append((open_[-1].holder, text, min(linked, len(text))))
            buffer.clear()

    def close(k: int) -> None:
        nonlocal links
        for n in open_[k:]:
            links -= n.tag == "a"
            count[n.tag] -= 1
            if n.inline:
                n.holder.opened[n.tag] -= 1
        del open_[k:]

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            buffer.append((page[at:], links > 0))
            break
        if m.start() > at:
            buffer.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                buffer.append((" ", False))
            k = len(open_) - 1
            if tag in _INLINE:
                # an inline element ends only inside the block that it began in
                if open_[-1].holder.opened.get(tag):
                    while open_[k].tag != tag:
                        k -= 1
                    close(k)
            elif count.get(tag):
                while open_[k].tag != tag:
                    k -= 1
                flush()
                close(k)
            continue
        if tag == "br" or tag == "wbr":
            buffer.append((" " if tag == "br" else "", False))
            continue
        if tag not in _INLINE:
            flush()
            node = open_[-1].holder
            while node.parent is not None:
                if tag in _ENDS.get(node.tag, ()):
                    k = len(open_) - 1
                    while open_[k] is not node:
                        k -= 1
                    close(k)
                    if node.tag not in ("td", "th"):
                        break
                elif node.tag in _SCOPE:
                    break
                node = node.parent.holder
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if end is None else max(end.start(), at)
            if end is not None:
                stop = page.find(">", at)
                at = n if stop < 0 else stop + 1
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _INLINE:
            continue
        labels = " ".join(a or b or c for a, b, c in _LABEL.findall(m[3])) if "=" in m[3] else ""
        parent = open_[-1]
        soft = _unwanted(labels) if labels and tag not in ("html", "body", "main") else 0
        hard = parent.hard or tag in _DROPPED and tag != "form"
        node = _Node(tag, parent, len(nodes), hard, soft or 2 * (tag == "form"), _BONUS.get(tag, -5.0 if tag in _HEADINGS else 0.0) + (10.0 if labels and _WANTED.search(labels) else 0.0))
        node.vague = tag == "form" and not soft or bool(soft) and all(_AMBIGUOUS.search(name) for name in labels.split() if _UNWANTED.search(name))
        open_.append(node)
        nodes.append(node)
        count[tag] = count.get(tag, 0) + 1
        if node.inline:
            node.holder.opened[tag] = node.holder.opened.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return nodes, out


_PARAGRAPHS = frozenset("p pre blockquote td li dd div article section main body figcaption #root".split())
_CONTAINERS = frozenset("div article section main body #root".split())


def _drop(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Settle which elements are no part of the article.

    An element that only its labels speak against stays if it holds every article or main
    element of the page, or, where its name may be a wrapper's, a heading and most of the
    page's text that isn't linked or certainly unwanted. A form, or an element whose name an
    article's wrapper may have, also stays if its text outweighs all that would be left.
    """
    for node, text, linked in blocks:
        if not node.hard:
            node.plain += len(text) - linked
    for node in reversed(nodes):
        # an article with such a label is a comment or an advert
        node.articles += node.tag in ("article", "main") and not node.soft and not node.hard
        node.titles += node.tag in ("h1", "h2", "h3") and not node.hard
        if node.parent is not None:
            node.parent.plain += node.plain if node.soft < 2 else 0
            node.parent.articles += node.articles
            node.parent.titles += node.titles
    root = nodes[0]
    for node in nodes[1:]:
        stays = not node.soft or node.articles and node.articles == root.articles or node.soft == 1 and node.titles and 2 * node.plain > root.plain
        node.dropped = node.parent.dropped or node.hard or not stays
    # what the text in each unwanted element is worth by itself, and all that stays
    left = 0.0
    for node, text, linked in blocks:
        if not node.hard:
            points = _points(text, linked)
            left += 0.0 if node.dropped else points
            node.weight += points
    for node in reversed(nodes):
        if node.parent is not None and not (node.soft and node.dropped and not node.vague):
            node.parent.weight += node.weight
    # the outermost of those whose text outweighs the rest of the page stays whatever its name
    chosen = next((n for n in nodes[1:] if n.vague and n.dropped and not n.hard and n.weight >= 2.0 and n.weight > _OUTWEIGHS * left), None)
    if chosen is not None:
        chosen.dropped = False
        inside = {chosen.place}
        for node in nodes[chosen.place + 1 :]:
            if node.parent is not None and node.parent.place in inside:
                inside.add(node.place)
                heavy = node.vague and 2 * node.weight > chosen.weight
                node.dropped = node.parent.dropped or node.hard or bool(node.soft) and not heavy and not (node.articles and node.articles == root.articles)


def _points(text: str, linked: int) -> float:
    """Points of a paragraph, for length and commas, less what is linked."""
    return (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1.0 - linked / len(text))


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by a line feed; empty for null, empty or text-free pages."""
    if not page:
        return ""
    nodes, blocks = _blocks(page)
    _drop(nodes, blocks)
    blocks = [b for b in blocks if not b[0].dropped]
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if node.tag in _PARAGRAPHS:
            # a bare container's own text counts for itself, a paragraph's for what holds it
            gets = node if node.tag in _CONTAINERS else node.parent.holder
            gets.points += _points(text, linked)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            if node.inline:
                node.parent.points += node.points
            else:
                node.parent.points += _HANDED_ON * node.points
    scored = [n for n in nodes if n.points > 0 and not n.inline]
    if not scored:
        return ""
    worth = lambda n: (n.points + n.wanted) * (1.0 - n.linked / max(n.chars, 1))
    best = max(scored, key=worth)
    least = max(10.0, 0.2 * worth(best))
    # the article element around the best container, unless it is mostly something else
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None and 2 * best.chars >= around.chars and 2 * around.linked < around.chars:
        best = around
    kept = {best.place}
    above = best.parent
    if above is not None and best.tag not in ("body", "html"):
        kept |= {n.place for n in scored if n.parent is above and worth(n) >= least and 2 * n.linked < n.chars}
        for node, text, linked in blocks:
            if node.parent is above and node.tag == "p" and (len(text) > 80 and linked < 0.25 * len(text) or linked == 0 and text[-1] in ".!?"):
                kept.add(node.place)
        beside = [n for n in nodes if n.parent is above and n.chars and not n.dropped and 2 * n.linked < n.chars]
        first, last = min(kept), max(kept)
        kept |= {n.place for n in beside if first < n.place < last}
        # headings right before the first
        for n in reversed([n for n in beside if n.place < first]):
            if n.tag not in _HEADINGS:
                break
            kept.add(n.place)
    for n in nodes:
        n.branch = n if n.place in kept else n.parent and n.parent.branch
    return "\n".join(text for node, text, _ in blocks if node.branch is not None)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html gives empty text, null page_id and url stay null. Pages are read whole,
    however long; bytes that aren't UTF-8 count as U+FFFD. Rows are independent: ties and
    repeated rows give equal rows, an empty table none; further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "make_valid_utf8(html) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``: see extract, also for the odd cases."""
    return extract(read_table(spark, sf_dir, "pages"))
