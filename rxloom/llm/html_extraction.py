"""The main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides those that speak
for themselves: blocks in menus, footers, adverts and the like, or mostly of links, go;
long blocks with the density of stop words that running text has stay. Short blocks, and
longer ones without clear density, are ambiguous: in the second pass they inherit the
label of the nearest decided neighbour in their section, whose edges count as decided
too: an article is good up to its edges, and the rest of a page is not.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words by language, all lower case; a page is measured by the list that it uses most.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist man mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur über",
    "fr": "à au aux avec ce ces cette comme dans de des du elle elles en est et être eux il ils je la le les leur leurs lui mais me même mes moi ne nos notre nous on ont ou où par pas plus pour que qui sa sans se ses si son sont sur tout un une vous",
    "es": "a al algo ante como con cuando de del desde donde dos el ella ellos en entre era es esta este esto ha hasta hay la las le les lo los me mi muy más ni no nos o para pero por porque que qué se ser si sin sobre son su sus también tan te todo un una uno y ya yo",
}
_STOPS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}

#: First pass: characters of a block that can speak for itself, and its share of stop words from which it is good.
LONG, DENSE = 70, 0.25
#: Share of characters in links beyond which a block is bad: in an article, and elsewhere.
LINKS, FEW_LINKS = 0.5, 0.25

#: Text in these is read as it is up to the end tag, and dropped.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Nothing in these is article text.
DROPPED = frozenset("head nav footer aside form menu dialog noscript template fieldset".split())
#: Nor in these, which may stand within a block without ending it.
QUIET = frozenset("button select option optgroup datalist label svg canvas audio video object applet".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that end a block; all others are markup inside of one.
BLOCKS = (
    frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
    | HEADINGS
    | DROPPED
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Tags that end an open paragraph, or an open one of their own kind.
ENDS_ITSELF = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

#: Words in class, id or role that mark what is no article, as parts between separators.
_MARKS = (
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright disqus footer gdpr "
    "masthead menu menus modal nav navbar navi navigation newsletter notice notices notification notifications offcanvas overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing shares sidebar sidenav "
    "signup skip skiplink social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar trackback search complementary alert alertdialog dialog"
)
MARKED = frozenset(_MARKS.split())
#: The same, as whole names only.
MARKED_WHOLE = frozenset("hidden d-none sr-only visually-hidden screen-reader-text widget widgets teaser teasers toc".split())
#: Of a page's layout, which such words describe but don't mark.
LAYOUT = frozenset(("has", "with", "without", "no"))
#: Marks that even an article element has only as a comment, an advert or a link to another page.
NO_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement related recommended sponsored promo promoted".split())
#: Marks of article text, unless one of the others stands beside them.
ARTICLE_MARKS = frozenset("article post entry story content main maincontent articlebody postcontent".split())
#: A header is none of an article's, but the article's own heading may stand in one.
HEADER_MARKS = frozenset(("header", "hd", "pageheader", "siteheader"))

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    links: int  # characters within links
    dropped: bool  # stands in something that is no article
    section: int  # number of the section that it stands in
    article: bool  # that section is an article
    heading: bool


@dataclass
class _Open:
    tag: str
    dropped: str  # the tag that makes this no article text; empty if none does
    section: int
    article: bool


@dataclass
class _Reader:
    """Blocks of a page; tags needn't be closed or nested rightly. One pass, linear in the page."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", "", 0, False)])
    open: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    link_depth: int = 0  # depth of the stack where a link was opened; 0 outside of links
    breaks: int = 0
    sections: int = 0
    quiet: int = 0

    def text(self, raw: str) -> None:
        if self.quiet:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if not text.isspace():
            self.breaks = 0
            if self.link_depth:
                self.links += len("".join(text.split()))

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            top = self.stack[-1]
            heading = any(o.tag in HEADINGS for o in self.stack[-2:])
            self.blocks.append(Block(text, self.links, bool(top.dropped), top.section, top.article, heading))
        self.pieces, self.links, self.breaks = [], 0, 0

    def pop(self) -> None:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        self.quiet -= tag in QUIET
        if len(self.stack) < self.link_depth:
            self.link_depth = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.pieces.append(" ")
            if self.breaks > 1:
                self.flush()
            return
        if tag == "a":
            self.link_depth = len(self.stack)
            return
        if tag in QUIET:
            self.quiet += 1
            self.push(_Open(tag, tag, self.stack[-1].section, self.stack[-1].article))
            return
        if tag not in BLOCKS:
            return
        self.flush()
        if tag in VOID:
            return
        self.close_open(tag)
        top = self.stack[-1]
        article, dropped = _marks(tag, attributes, top)
        section, inside = top.section, top.article
        if not dropped and article and not inside:
            self.sections += 1
            section, inside = self.sections, True
        elif dropped and not top.dropped and tag != "p" and tag not in HEADINGS:
            self.sections += 1
            section = self.sections
        self.push(_Open(tag, dropped, section, inside))

    def push(self, o: _Open) -> None:
        self.stack.append(o)
        self.open[o.tag] = self.open.get(o.tag, 0) + 1

    def close_open(self, tag: str) -> None:
        """Ends what ``tag`` ends by beginning: a paragraph or heading, the list item or cell before."""
        if self.stack[-1].tag == "p" or self.stack[-1].tag in HEADINGS and tag in HEADINGS:
            self.pop()
        for own in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
            if own in ENDS_ITSELF and self.open.get(own):
                around = ENDS_ITSELF[own]
                at = len(self.stack) - 1
                while at and self.stack[at].tag != own and self.stack[at].tag not in around and self.stack[at].tag in ("p", *HEADINGS):
                    at -= 1
                if self.stack[at].tag == own:
                    while len(self.stack) > at:
                        self.pop()

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        elif tag == "br":
            self.start("br", "")
        elif tag in BLOCKS or tag in QUIET:
            if tag in BLOCKS:
                self.flush()
            if self.open.get(tag):
                while self.stack[-1].tag != tag:
                    self.pop()
                self.pop()


def _marks(tag: str, attributes: str, top: _Open) -> tuple[bool, str]:
    """Whether an element begins an article, and what makes it no article text."""
    article, dropped = tag in ARTICLES, top.dropped
    # an application's form may hold the whole page
    if dropped and dropped != "form":
        return False, dropped
    dropped = dropped or (tag if tag in DROPPED or tag == "header" and not top.article else "")
    words, whole = set(), set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            dropped = dropped or "hidden"
        elif name in ("class", "id", "role"):
            words.update(_PARTS.split(_CAMEL.sub("-", value).lower()))
            whole.update(value.lower().split())
    if tag in ("html", "body"):
        return False, dropped
    if words & MARKED and not words & LAYOUT or whole & MARKED_WHOLE or words & HEADER_MARKS and not top.article:
        # a page's article keeps its place, whatever its layout is called
        if not article or words & NO_ARTICLE or whole & MARKED_WHOLE:
            dropped = "marked"
    elif words & ARTICLE_MARKS:
        article = True
    if article and top.dropped == "form" and dropped == "form":
        dropped = ""
    return article, dropped


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; comments, scripts and styles are none."""
    reader, at, size, quoted = _Reader(), 0, len(page), True
    low = None
    while at < size:
        tag_at = page.find("<", at)
        if tag_at < 0:
            reader.text(page[at:])
            break
        if tag_at > at:
            reader.text(page[at:tag_at])
        if page.startswith("<!--", tag_at):
            end = page.find("-->", tag_at + 2)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag_at):
            end = page.find(">", tag_at)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, tag_at)
        if not found:
            if page.startswith("</", tag_at):
                end = page.find(">", tag_at)
                at = size if end < 0 else end + 1
            else:
                reader.text("<")
                at = tag_at + 1
            continue
        rest = _REST.match(page, found.end()) if quoted else None
        if rest:
            end = rest.end() - 1
        else:
            # a quotation mark without its second: from here on tags end at the first bracket
            quoted, end = False, page.find(">", found.end())
            if end < 0:
                break  # a page that was cut off within a tag
        name, at = found[2].lower(), end + 1
        if found[1]:
            reader.end(name)
        elif name in RAW:
            low = page.lower() if low is None else low
            if len(low) != size:  # lowering some letters makes two of one
                low = re.sub(r"[A-Z]+", lambda m: m[0].lower(), page)
            end = low.find(f"</{name}", at)
            at = size if end < 0 else end
        else:
            reader.start(name, page[found.end() : end])
    reader.flush()
    return reader.blocks


def decided(found: list[Block]) -> list[bool | None]:
    """The first pass: whether each block is good, None where its neighbours have to say."""
    labels: list[bool | None] = []
    words: dict[int, list[str]] = {}
    for k, b in enumerate(found):
        size = len(b.text) - b.text.count(" ")
        bad = b.dropped or b.links > (LINKS if b.article else FEW_LINKS) * size
        labels.append(False if bad else None)
        if not bad and len(b.text) >= LONG and not b.heading:
            words[k] = _WORD.findall(b.text.lower())
    counts = Counter(chain.from_iterable(words.values()))
    stops = max(_STOPS.values(), key=lambda s: sum(counts[w] for w in s))
    for k, own in words.items():
        if own and sum(map(stops.__contains__, own)) >= DENSE * len(own):
            labels[k] = True
    return labels


def labelled(found: list[Block]) -> list[bool]:
    """Both passes: whether each block is article text.

    An ambiguous block takes the label of the nearest decided block of its section (of
    two as near and unlike, the bad one's); the edges of a section are decided, good
    those of an article. In an article, where a list of links says little of what stands
    beside it, both sides must be bad. A heading looks to what follows it.
    """
    labels = decided(found)
    # a page that names no article and has no good block is one as far as it isn't bad
    whole = not any(b.article or label for b, label in zip(found, labels, strict=True))
    ends = lambda k: (0, (found[k].article or whole) and not found[k].dropped)

    def nearest(order: range) -> list[tuple[int, bool]]:
        """Steps to, and label of, the next decided neighbour against ``order``."""
        out: list[tuple[int, bool]] = [(0, False)] * len(found)
        last: dict[int, tuple[int, bool]] = {}
        seen: dict[int, int] = {}
        for k in order:
            section = found[k].section
            n = seen[section] = seen.get(section, 0) + 1
            if section not in last:
                last[section] = ends(k)
            at, label = last[section]
            out[k] = (n - at, label)
            if labels[k] is not None:
                last[section] = (n, labels[k])
        return out

    ahead, behind = nearest(range(len(found) - 1, -1, -1)), nearest(range(len(found)))
    out = []
    for k, label in enumerate(labels):
        if label is None:
            (after, one), (before, other) = ahead[k], behind[k]
            if ends(k)[1]:
                label = one or other
            else:
                label = one if found[k].heading or after < before else other if before < after else one and other
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labelled(found), strict=True) if good)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id and text, which is empty for null, empty and articleless pages.

    Pages of any length are read whole; repeated rows and null ids stay; no other
    column is read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("h"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def op11_html_extraction(spark, sf_dir) -> DataFrame:
    """page_id, url, text, n_chars of all of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.struct("page_id", "url").alias("key"), "html")
    found = extracted(pages, "key")
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))
