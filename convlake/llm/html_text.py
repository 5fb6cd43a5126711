"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser reports tags and text. Blocks (the
page's lines) collect text up to the next block tag; each gets the ratio of its
text to its tags, the ratios are smoothed over neighbouring blocks with a
Gaussian, and blocks above one standard deviation are content. Ratios are capped
before, so that one long paragraph does not raise the bound for all.

Content blocks choose regions. An article or main element is a region for which
the page's author speaks: its bound is PRIOR times lower, and text outside wins
only if there is more than PRIOR times as much of it. A chosen region gives all
its text, in order; main goes with its articles, and an article inside another
counts only where the outer one has no content of its own (else it is a comment).
Outside, the region runs from the first to the last content block and takes all
blocks in the same parent elements as content.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments are recognised by element, class, id and role, and never count. Names
that only contain such a word ("share-price") are no proof: the ratio of
their blocks decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
#: A ratio counts as at most this, or as MEDIANS times the page's median if that is more.
CAP, MEDIANS = 1000.0, 10.0
#: How much more an article or main element counts than the rest of the page.
PRIOR = 10.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody "
                   "td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style noscript template head title nav aside footer form menu button select textarea option iframe "
                    "object svg math canvas dialog audio video".split())
#: Parts of class, id or role values that mark boilerplate.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment "
                  "comments commentlist consent contentinfo cookie cookies copyright discussion discussions disqus footer gdpr menu menubar modal "
                  "nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related "
                  "replies reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
                  "toolbar widget widgets complementary".split())
#: Marks that also have other meanings: with a further word of another kind the ratio decides.
AMBIGUOUS = frozenset("banner copyright discussion discussions menu notice notices promotion related replies reply respond search "
                      "share sharing social sponsor toolbar widget".split())
#: Words that add nothing to a mark.
NEUTRAL = frozenset("area bar block body bottom box button buttons component container content count counts cta element fixed footer "
                    "form group header holder icon icons inner input item items js left link links list main mobile module outer page "
                    "panel post posts region right row section site sticky tool tools top wrap wrapper".split())
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a block's elements say of it: nothing, perhaps boilerplate, header of main, heading in such a header.
PLAIN, DOUBTFUL, SITE, SITE_HEADING = range(4)
_PART = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(4096)
def marked(value: str) -> int:
    """Whether a class, id or role value names boilerplate: 2 yes, 1 perhaps, 0 no."""
    worst = 0
    for name in value.split():
        parts = [p for p in _PART.split(_CAMEL.sub(" ", name).lower()) if p]
        marks = [p for p in parts if p in MARKS]
        if marks:
            sure = any(m not in AMBIGUOUS for m in marks) or all(p in MARKS or p in NEUTRAL or p.isdigit() for p in parts)
            worst = max(worst, 2 if sure else 1)
    return worst


class Blocks(HTMLParser):
    """Collects (text, tags, container number or -1, linked characters, number of
    the parent element or -1, what its elements say) of every block outside
    boilerplate, in page order, and (tag, number of the one around or -1) of the
    containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, boilerplate, container, number, what it says
        self.blocks: list[tuple[str, int, int, int, int, int]] = []
        self.seen = 0
        self.kinds: list[tuple[str, int]] = []
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.links = 0

    def _state(self) -> tuple[bool, int, int]:
        return (self.open[-1][1], self.open[-1][2], self.open[-1][4]) if self.open else (False, -1, PLAIN)

    def _parent(self) -> int:
        """The element around the innermost open block."""
        around = [(t, i) for t, _, _, i, _ in self.open if t in BLOCKS or t == "body"]
        if around and around[-1][0] != "body":
            around.pop()
        return around[-1][1] if around else -1

    def flush_block(self) -> None:
        skip, container, says = self._state()
        text = " ".join("".join(self.text).split())
        if text and not skip:
            self.blocks.append((text, self.tags, container, self.linked, self._parent(), says))
        if text or skip:
            self.tags = 0
        self.text, self.linked = [], 0

    def _boilerplate(self, tag: str, attrs, container: int) -> int:
        """2 for boilerplate, 1 where the name leaves it open, else 0."""
        if tag in SKIPPED or (tag == "header" and container < 0):
            return 2
        worst = 0
        for name, value in attrs:
            if name == "hidden":
                return 2
            if not value:
                continue
            if name in ("class", "id", "role"):
                worst = max(worst, marked(value))
            elif name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return 2
        if tag in ("html", "body") or tag in CONTAINERS and container < 0 and not any(
                k == "class" and v and "comment" in v for k, v in attrs):
            return 0
        return worst

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush_block()
            self._close_implied(tag)
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        skip, container, says = self._state()
        if not skip:
            how = self._boilerplate(tag, attrs, container)
            # an inline piece of boilerplate inside a block is left out, and the block goes on
            skip = how == 2 or how == 1 and tag == "a"
            if how == 1 and tag in BLOCKS and says == PLAIN:
                says = DOUBTFUL
            if not skip and tag == "header" and self.kinds[container][0] == "main":
                says = SITE
            elif says == SITE and tag in HEADINGS:
                says = SITE_HEADING
        if not skip and (tag == "article" or container < 0 and (tag == "main" or ("role", "main") in attrs)):
            self.kinds.append(("article" if tag == "article" else "main", container))
            container = len(self.kinds) - 1
            says = PLAIN if says in (SITE, SITE_HEADING) else says
        self.links += tag == "a"
        self.seen += 1
        self.open.append((tag, skip, container, self.seen, says))

    def _close_implied(self, tag: str) -> None:
        """A block tag ends an open paragraph; a list or table item its like."""
        same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        fence = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
                 "th": ("tr", "table")}.get(tag, ())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p" or name in same:
                self._pop_to(i)
                if not same:
                    return
            elif name in fence or (name in BLOCKS and not same) or name in ("article", "main", "body", "section", "div", "td", "th"):
                return

    def _pop_to(self, i: int) -> None:
        self.links -= sum(1 for t, *_ in self.open[i:] if t == "a")
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or any(t in BLOCKS for t, *_ in self.open[i:]):
                    self.flush_block()
                self._pop_to(i)
                return
            # an inline end tag closes nothing outside its block
            if tag not in BLOCKS and tag not in SKIPPED and self.open[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.text.append(data)
        if self.links > 0:
            self.linked += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the blocks; the ends repeat."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), "valid")


def content(blocks: list[tuple], kinds: list[tuple[str, int]]) -> np.ndarray:
    """Which blocks are the main text."""
    size = np.array([len(b[0]) for b in blocks])
    ratio = size / np.maximum(1, [b[1] for b in blocks])
    ratio = np.minimum(ratio, max(CAP, MEDIANS * float(np.median(ratio))))
    smooth = smoothed(ratio)
    bound = min(smooth.std(), smooth.max())
    region = np.array([b[2] for b in blocks])
    linked = 2 * np.array([b[3] for b in blocks]) > size
    says = np.array([b[5] for b in blocks])
    content_like = (smooth >= bound) & (ratio >= bound) & ~linked
    doubtful = (says == DOUBTFUL) | (says == SITE)

    # containers: PRIOR times the ratio; main goes with its articles
    passes = (PRIOR * np.minimum(smooth, ratio) >= bound) & ~linked & (says == PLAIN)
    strong = {int(r) for r in region[passes & (region >= 0)]}
    strong = {r for r in strong if kinds[r][0] == "main" or not any(o in strong and kinds[o][0] == "article" for o in around(r, kinds))}
    articles = {r for r in strong if kinds[r][0] == "article"}
    mains = {o for r in strong for o in (r, *around(r, kinds)) if kinds[o][0] == "main"}
    # an outer article whose own text is short still gives its title to the inner ones
    outer = {o for r in articles for o in around(r, kinds) if kinds[o][0] == "article"}
    inside = np.isin(region, list(articles | outer | mains)) & (~doubtful | content_like)
    if articles:  # around articles, main has its own header and menus
        inside &= ~(np.isin(region, list(mains)) & (linked | (says >= SITE)))

    solid = (region < 0) & (smooth >= bound) & ~linked & ~doubtful
    if PRIOR * size[inside].sum() >= size[solid].sum() and inside.any():
        return inside
    if not solid.any():  # nothing but links: the containers as they are
        return (region >= 0) & ~doubtful
    # parents of blocks that pass by themselves and not by a neighbour's ratio
    parent = np.array([b[4] for b in blocks])
    outside = np.isin(parent, parent[solid & (ratio >= bound)])
    first, last = np.flatnonzero(solid)[[0, -1]]
    outside[first: last + 1] = True
    return outside & (region < 0) & ~linked & (~doubtful | content_like)


def around(r: int, kinds: list[tuple[str, int]]) -> list[int]:
    """The containers around a container."""
    out = []
    while (r := kinds[r][1]) >= 0:
        out.append(r)
    return out


def main_text(html: str | None) -> str:
    """The page's main text: blocks joined by a blank line; empty if none."""
    if not html:
        return ""
    p = Blocks()
    p.feed(html)
    p.close()
    p.flush_block()
    if not p.blocks:
        return ""
    return "\n\n".join(b[0] for b, ok in zip(p.blocks, content(p.blocks, p.kinds)) if ok)


_OUT = pa.schema([("_text", pa.string())])


def _extract(schema: pa.Schema, keep: list[str], html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h.as_py()) for h in part.column(html_col)]
                cols = [part.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], schema=schema)
    return run


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep``, text and n_chars (code points) of every page.

    Null, empty and text-free pages give the empty string. Every page is judged
    by itself, so repeated rows agree and order does not matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    names = [f"_k{i}" for i in range(len(keep))]
    base = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, names)), F.col(html_col).alias("_html"))
    schema = StructType([base.schema[k] for k in names] + [StructField("text", StringType())])
    out = base.mapInArrow(_extract(to_arrow_schema(schema), names, "_html"), schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names)), "text", F.length("text").cast("long").alias("n_chars"))
