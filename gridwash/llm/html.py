"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. What stands in elements for menus, headers, footers, sidebars, notices,
adverts, forms or reader comments is out by its markup. The rest is judged by rules: pass one calls a block good or bad by
its density of stop words, its length and the share of its characters inside links, where neighbouring paragraphs of middling
length are judged together, and leaves others undecided; in pass two these inherit the label of the nearest decided block,
first of the same container, then of the page. Figures, names or lists have no stop words, which says nothing against them.
Where the text of a page has hardly any stop word of the listed languages, its language is none of them, and length and links
alone decide.

Pages are independent rows: no shuffle, one page at a time in memory, time linear in its length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from gridwash.llm.common import bounded_batches, text_of

LONG = 200  # characters from which a block can be good by itself
SHORT = 70  # characters below which a block says nothing about itself
DENSE = 0.3  # share of stop words of running text
SPARSE = 0.05  # share below which a block is no running text
FOREIGN = 0.15  # share below which the words of a page are of another language than the listed ones
LINKED = 0.5  # share of characters inside links from which a block is a menu

# Frequent function words of some languages.
STOP_WORDS = frozenset((
    "a an and are as at be by for from has have he her his in is it its not of on or she that the their they this to was "
    "were which will with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine einer es für im ist mit nicht sich sie sind und "
    "von war wie zu zur "
    "au aux avec ce cette dans des du elle est et il la le les mais ne ou par pas plus pour que qui se son sur un une "
    "al como con de del el en esta las lo los más no para pero por se su una y "
    "che con da di gli il nel non per sono della "
    "o os as um uma não em do dos ao").split())
BLOCKS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead title tr ul").split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas noframes".split())
OUT = frozenset("head nav header footer aside form fieldset button select dialog menu option search".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class names, ids and roles that name what is not the article.
OUT_NAMES = re.compile(
    r"^(?:ads?\d*|ad(?:box|slot|unit|wrap\w*|sense|sbygoogle)\d*|advert\w*|sponsor\w*|promo\w*|teasers?|banner\w*|"
    r"taboola|outbrain|cookie\w*|consent\w*|gdpr|privacy|notices?|announcements?|alerts?|toast|paywall|popup|modal|"
    r"overlay|newsletter\w*|subscri\w*|signup|login|nav\w*|menus?|breadcrumbs?|sidebar\w*|side|widgets?|header|masthead|"
    r"topbar|footer|foot|comments?|commentlist|commentary|disqus\w*|replies|reply|respond|responses|discussion|share|sharing|social|"
    r"related|recommended|pagination|pager|toolbar|search|complementary|contentinfo|navigation|tags|copyright|disclaimer|"
    r"hidden)$")
COMMENTS = re.compile(r"^(?:comments?|commentlist|disqus\w*|replies|reply|respond|responses|discussion)$")
ARTICLE_NAMES = frozenset("article story post entry".split())
SPOKEN_OF = re.compile(r"(?:has|with|without|no)[-_]")  # a name that says what else the page has, such as with-sidebar
ARTICLE = frozenset("article main".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    container: int
    article: bool
    out: bool
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


@dataclass
class Element:
    tag: str
    number: int
    out: bool
    article: bool
    comments: bool = False
    soft: bool = False  # out by a name only


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, whatever its markup is like."""
    found, numbers = [], 1
    stack = [Element("", 0, False, False)]
    block, links = Block(0, False, False), 0

    def cut() -> None:
        nonlocal block
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            block.text = text
            found.append(block)
        top = stack[-1]
        block = Block(top.number, top.article, top.out)

    def words(text: str) -> None:
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        here = page.find("<", at)
        if here < 0:
            words(page[at:])
            break
        if here > at:
            words(page[at:here])
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), here):
            end = page.find(">", here)
            at = n if end < 0 else end + 1
            continue
        tag = TAG.match(page, here)
        if tag is None:
            end = page.find(">", here)
            if end > 0 and re.match(r"</?[a-zA-Z]", page[here:here + 3]):  # a quote that is never closed
                tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>").match(page, here)
            if tag is None:
                words("<")
                at = here + 1
                continue
        at = tag.end()
        closing, name, rest = tag[1] == "/", tag[2].lower(), tag[3]
        if name in RAW and not closing:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    at = n
                else:
                    stop = page.find(">", end.end())
                    at = n if stop < 0 else stop + 1
            if name in BLOCKS:
                cut()
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            words(" ")
            continue
        if name not in BLOCKS and name not in OUT:
            continue
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            cut()
            continue
        if name in EMPTY:
            cut()
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == name:
            stack.pop()  # such an element ends where the next one begins
        elif stack[-1].tag == "p":
            stack.pop()  # a paragraph holds no blocks
        above = stack[-1]
        named = {part for m in ATTRIBUTE.finditer(rest) for v in (m[2] or m[3] or m[4] or "").lower().split()
                 if not SPOKEN_OF.match(v) for part in re.split("[_-]+", v)}
        if above.article:
            named.discard("header")  # an article's own header holds its title
        soft = any(map(OUT_NAMES.match, named)) or bool(HIDDEN.search(rest))
        article = name in ARTICLE or not soft and bool(ARTICLE_NAMES & named)
        comments = above.comments or any(map(COMMENTS.match, named))
        held = above.out
        if article and not soft and above.soft and not comments:
            held = False  # an advert or notice that was never closed does not hold the article
        hard = name in OUT and not (name == "header" and above.article)
        container = above.number if name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote") else numbers
        numbers += 1
        if name in ("body", "html"):
            soft = article = False
        stack.append(Element(name, container, held or hard or soft, above.article or article, comments,
                             soft and not hard or above.soft and held))
        cut()
    cut()
    return found


def first_labels(blocks: list[Block]) -> None:
    """Pass one: good, bad, or nothing where a block and its neighbours do not tell."""
    open_ = []  # blocks that say something about themselves: number, words, stop words
    for i, b in enumerate(blocks):
        if b.out or b.linked > LINKED * len(b.text):
            b.label = "bad"
        elif not b.article and "\N{COPYRIGHT SIGN}" in b.text and len(b.text) < LONG:
            b.label = "bad" if len(b.text) >= SHORT else ""
        elif len(b.text) >= SHORT:
            words = LETTERS.findall(b.text.lower())
            open_.append((i, len(words), sum(w in STOP_WORDS for w in words)))
    if sum(stops for _, _, stops in open_) < FOREIGN * sum(words for _, words, _ in open_):
        for i, words, _ in open_:  # bytes, as a character of some scripts says as much as a syllable
            if words and len(blocks[i].text.encode("utf-8", "surrogatepass")) >= LONG:
                blocks[i].label = "good"
    run: list[tuple[int, int, int]] = []
    for item in [*open_, None]:
        if run and (item is None or item[0] != run[-1][0] + 1 or blocks[item[0]].container != blocks[run[-1][0]].container):
            words, stops = sum(w for _, w, _ in run), sum(s for _, _, s in run)
            if sum(len(blocks[i].text) for i, _, _ in run) >= LONG and stops >= DENSE * words:
                for i, _, _ in run:
                    blocks[i].label = "good"
            run = []
        if item is None:
            break
        i, words, stops = item
        if stops >= DENSE * max(1, words) and len(blocks[i].text) >= LONG:
            blocks[i].label = "good"
        if stops >= SPARSE * max(1, words):  # a sparse block neither joins the paragraphs around it nor speaks against them
            run.append(item)


def nearest_labels(blocks: list[Block]) -> list[str]:
    """Pass two: undecided blocks take the label of the nearest decided one; of two as near, the good one."""
    labels = [b.label for b in blocks]
    some_article = any(b.article and not b.out for b in blocks)

    def spread(members: list[int]) -> None:
        """Fill the undecided among ``members`` from both sides, by distance in the page."""
        before, last = {}, None
        for i in members:
            if blocks[i].label:
                last = i
            before[i] = last
        after, last = {}, None
        for i in reversed(members):
            if blocks[i].label:
                last = i
            after[i] = last
        for i in members:
            if not labels[i]:
                sides = [(abs(i - j), blocks[j].label != "good", blocks[j].label)
                         for j in (before[i], after[i]) if j is not None]
                if sides:
                    labels[i] = min(sides)[2]

    groups: dict[tuple, list[int]] = {}
    for i, b in enumerate(blocks):
        if not b.out:
            groups.setdefault((b.container, b.article), []).append(i)
    for members in groups.values():
        spread(members)
    for i, b in enumerate(blocks):
        if not labels[i] and b.article:
            labels[i] = "good"  # inside an article that no block speaks against
    if not some_article:
        spread([i for i, b in enumerate(blocks) if not b.out])
    return [label or ("bad" if some_article else "good") for label in labels]


def main_text(page: str | None) -> str:
    """Main text of one page: its good blocks in order, one per line; empty for NULL, empty or article-free pages."""
    blocks = blocks_of(page or "")
    first_labels(blocks)
    return "\n".join(b.text for b, label in zip(blocks, nearest_labels(blocks)) if label == "good")


@pandas_udf(StringType())
def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(p) for p in batch], dtype=object)


def extract_text(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without the HTML column, with the main text under ``name``; one row per row, in any number.

    Other columns stay as they are; ``name`` must not be one of them.
    """
    others = [c for c in pages.columns if c != html_column]
    if name.lower() in [c.lower() for c in others]:
        raise ValueError(f"column {name} exists")
    bounded_batches(pages.sparkSession)
    return pages.select(*[F.col(f"`{c}`") for c in others], extract(text_of(html_column)).alias(name))
