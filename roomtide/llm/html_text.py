"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering, content regions.

The standard library's parser streams events. Text between block tags is a block, with the element that holds it, its number
of tags and its linked characters. The ratio of text to tags over the blocks is smoothed with a Gaussian, and what
lies above the standard deviation of the smoothed ratios is the content cluster.

The cluster judges what markup says. Elements that by tag, role, class or id are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments are left out, unless they hold most of the cluster: a form or a `layout-sidebar` around
the page is not beside its text (see `Page.left_out`). Inline elements are never left out for a name.

The content region is the article or main element with the most text of the cluster, with the article or main elements around
it. Its blocks are the text, so a short paragraph between long ones stays. Without such an element the region is the
smallest container that holds nearly all of the cluster, widened to what else adjoins it: while the next block before or
after it is no menu or list of links, to the smallest container that holds that block too. Outside an article, blocks
below the threshold that are mostly links are left out too.

An element knows its parent only, and elements are numbered in order, so every sum over elements is one pass: time grows
with the page, however deep it is nested.

Defined cases: null html, or a page without text, has an empty text. Character references are decoded, white space in
a block is one space, blocks are joined by an empty line. Broken markup never fails: an end tag closes what is open
inside its element, omitted end tags are understood as in HTML, an unfinished tag at the end is dropped. Repeated rows are
extracted each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as text of the page.
NO_TEXT = frozenset(
    "audio button canvas datalist embed head iframe input label legend map math noscript object option script select style svg "
    "template textarea title video".split()
)
BESIDE = frozenset("aside dialog footer header menu nav".split())
FORMS = frozenset("fieldset form".split())
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split()
)
#: Words of class and id names that tell what is not the article.
NAMES = frozenset(
    "ad ads adbox adsense adslot adunit advert adverts advertisement advertising advertorial alert alerts announcement "
    "banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus foot footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promotion recommended related replies respond share sharing sidebar signup skip social "
    "sponsor sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: First words of names that tell what is around an element, such as has-sidebar.
AROUND = frozenset("has have no not with without is show hide".split())
#: Names of reader comments, and first words of names that are parts of an article, such as post-header.
REPLIES = frozenset("comment comments discussion disqus replies respond".split())
OF_ARTICLE = frozenset("article blog content entry news page post story text".split())
#: Elements that no name leaves out, and such that only a name of one word does.
NEVER_BY_NAME = frozenset(
    "html body main a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var".split()
)
BY_WHOLE_NAME = frozenset("article h1 h2 h3 h4 h5 h6 p".split())
#: Elements that can be a content region: those that hold paragraphs and headings.
CONTAINERS = frozenset(
    "article blockquote body center dd details div dl figure html li main ol section table tbody td tr ul".split()
)
#: Open elements that a start tag ends, as their end tags may be omitted, and the elements in which this stops.
_CELLS, _ROWS = ("td", "th"), ("td", "th", "tr")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (_CELLS, ("table", "tr")),
    "th": (_CELLS, ("table", "tr")),
    "tr": (_ROWS, ("table",)),
    "thead": ((*_ROWS, "thead", "tbody", "tfoot"), ("table",)),
    "tbody": ((*_ROWS, "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": ((*_ROWS, "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
SIGMA = 1.0
#: The region holds at least this part of the content cluster's characters.
NEARLY_ALL = 0.9


#: What markup says of an element.
SHOWN, PART, BOILERPLATE, COMMENTS, NEVER = range(5)


def said(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """NEVER: no text. BOILERPLATE, COMMENTS: named to be beside the text. PART: a form, a hidden element, or a name that says
    so of something else or of a part (layout-sidebar-right, social-science). Else SHOWN."""
    if tag in NO_TEXT:
        return NEVER
    found = SHOWN
    if tag in BESIDE and not (tag == "header" and in_article):
        found = BOILERPLATE
    elif tag in FORMS:
        found = PART
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found = max(found, PART)
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            found = max(found, PART if value.strip().lower() == "form" else BOILERPLATE)
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            found = max(found, PART)
        if name in ("class", "id") and tag not in NEVER_BY_NAME:
            found = max([found, *(named(n, tag in BY_WHOLE_NAME, in_article) for n in value.split())])
    return found


def named(name: str, whole: bool, in_article: bool) -> int:
    """What a class or id name says; with `whole` only a single word counts."""
    parts = [w.lower() for w in WORDS.findall(name)]
    if not parts or parts[0] in AROUND or whole and len(parts) > 1:
        return SHOWN
    heads = "header" in parts and (in_article or parts[0] in OF_ARTICLE)  # the title of the article itself
    known = [w for w in parts if w in NAMES and not (heads and w == "header")]
    if not known:
        return SHOWN
    if parts[-1] not in known and not (len(parts) > 1 and parts[-1].isdigit()):
        return PART
    return COMMENTS if parts[-1] in REPLIES else BOILERPLATE


class Page(HTMLParser):
    """The elements of a page (tag, parent, what is said of it), numbered in order, and its blocks (text, tags, linked
    characters, element)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags_of, self.parent, self.said = ["html"], [-1], [SHOWN]  # 0: the page
        self.blocks: list[tuple[str, int, int, int]] = []
        self.open: list[int] = [0]
        self.opened: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.tags, self.linked, self.open[-1]))
            self.text = []
        self.tags = self.linked = 0

    def close_to(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.opened[self.tags_of[n]] -= 1
        del self.open[depth:]

    def end_omitted(self, tag: str) -> None:
        """Ends what a start tag ends without an end tag."""
        if tag in BLOCK and self.tags_of[self.open[-1]] == "p":
            self.close_to(len(self.open) - 1)
        ended, inside = ENDS.get(tag, ((), ()))
        if any(self.opened[t] for t in ended):
            lowest = None
            for depth in range(len(self.open) - 1, 0, -1):
                here = self.tags_of[self.open[depth]]
                if here in inside:
                    break
                if here in ended:
                    lowest = depth
                    if here == tag or tag in ("li", "dt", "dd", "td", "th", "option"):
                        break
            if lowest is not None:
                self.close_to(lowest)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            self.end_omitted(tag)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        what = said(tag, attrs, bool(self.opened["article"] or self.opened["main"]))
        if what != SHOWN:
            self.flush()
        self.tags_of.append(tag)
        self.parent.append(self.open[-1])
        self.said.append(what)
        self.open.append(len(self.parent) - 1)
        self.opened[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if not self.opened[tag]:
            return
        depth = len(self.open) - 1
        while self.tags_of[self.open[depth]] != tag:
            depth -= 1
        if any(self.said[n] != SHOWN for n in self.open[depth:]):
            self.flush()
        self.close_to(depth)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.opened["a"]:
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass

    # After the last event: one pass over the elements each.

    def under(self, marks: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out = []
        for n, up in enumerate(self.parent):
            out.append(marks[n] or up >= 0 and out[up])
        return out

    def summed(self, amounts: np.ndarray, of: np.ndarray) -> list[float]:
        """The amounts of blocks by element, with all elements inside."""
        out = np.bincount(of, amounts, len(self.parent)).tolist()
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def left_out(self, held: list[float], total: float) -> list[bool]:
        """Elements that are left out with all inside, from the characters of the content cluster that each holds.

        What is a PART stays if it holds half of the cluster. What is BOILERPLATE stays if it holds nearly all of it and a
        title or main element; COMMENTS go. If nothing of the cluster were left, all but NEVER stay.
        """
        whole = [False] * len(held)
        for n in range(len(held) - 1, 0, -1):
            whole[n] |= self.tags_of[n] in ("h1", "main", "article")
            whole[self.parent[n]] |= whole[n]
        marks = []
        for n, what in enumerate(self.said):
            most = what == PART and held[n] >= total / 2 or what == BOILERPLATE and whole[n] and held[n] >= NEARLY_ALL * total
            marks.append(what != SHOWN and not most)
        return marks


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over the neighbours; at the ends over those there are."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    mass = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / mass


def content_cluster(ratios: np.ndarray) -> np.ndarray:
    """The blocks above the standard deviation of the smoothed ratios; all if there is none."""
    found = ratios > ratios.std()
    return found if found.any() else np.ones(len(ratios), bool)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(UNFINISHED.sub("", html))
    page.close()
    page.flush()
    never = page.under([x == NEVER for x in page.said])
    blocks = [b for b in page.blocks if not never[b[3]]]
    if not blocks:
        return ""
    of = np.array([b[3] for b in blocks])
    sizes = np.array([len(b[0]) for b in blocks], float)
    density = sizes / np.array([max(1, b[1]) for b in blocks])
    # What markup alone calls boilerplate counts for nothing in the second look, unless the first one kept it.
    content = content_cluster(smoothed(density))
    out = page.under(page.left_out(page.summed(sizes * content, of), sizes[content].sum()))
    shown = np.array([not out[n] for n in of.tolist()])
    if not shown.any():
        shown[:] = True
        out = never
    ratios = smoothed(np.where(shown, density, 0.0))
    content = content_cluster(ratios) & shown
    if not content.any():
        content = shown
    held, total = page.summed(sizes * content, of), sizes[content].sum()
    threshold = ratios.std()
    # Links outside an article, such as lists of them, are no text of the page.
    links = [ratios[i] <= threshold and linked > 0.5 * len(text) for i, (text, _, linked, _) in enumerate(blocks)]
    articles = [n for n, x in enumerate(held) if x > 0 and page.tags_of[n] in ("article", "main")]
    core = region = None
    if articles:
        # The element with the most content; the inner one if it has nearly all of the outer.
        most = max(held[n] for n in articles)
        core = max(n for n in articles if held[n] >= NEARLY_ALL * most)
        # Several articles side by side, none of which is the page's: all that hold content.
        if held[core] < total / 2 and len(articles) > 1:
            core = None
        else:
            n = core
            while n >= 0:
                region = n if page.tags_of[n] in ("article", "main") else region
                n = page.parent[n]
    else:
        region = max((n for n, x in enumerate(held) if page.tags_of[n] in CONTAINERS and x >= NEARLY_ALL * total), default=None)
        region = widened(region, page, of, shown, links)
    in_core = page.under([n == core for n in range(len(held))])
    in_region = page.under([region is None or n == region for n in range(len(held))])
    return "\n\n".join(
        text for i, (text, _, _, n) in enumerate(blocks) if shown[i] and in_region[n] and (not links[i] or core is not None and in_core[n])
    )


def widened(region: int | None, page: Page, of: np.ndarray, shown: np.ndarray, links: list[bool]) -> int | None:
    """The smallest container around the region whose neighbours on both sides, if any, are links; None for the page."""
    seen = np.flatnonzero(shown)
    first, last = [len(seen)] * len(page.parent), [-1] * len(page.parent)
    for k, n in enumerate(of[seen].tolist()):
        first[n], last[n] = min(first[n], k), k
    for n in range(len(first) - 1, 0, -1):  # blocks inside an element follow each other
        up = page.parent[n]
        first[up], last[up] = min(first[up], first[n]), max(last[up], last[n])
    while region is not None and region > 0:
        beside = [k for k in (first[region] - 1, last[region] + 1) if 0 <= k < len(seen) and not links[seen[k]]]
        if not beside:
            return region
        region = page.parent[region]
        while region > 0 and not (page.tags_of[region] in CONTAINERS and any(first[region] <= k <= last[region] for k in beside)):
            region = page.parent[region]
    return None


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark, folder: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
