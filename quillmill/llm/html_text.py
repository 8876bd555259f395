"""Main text of web pages: parser events, text-to-tag ratios of lines, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text never is the article's.
NEVER = set("script style template noscript head title nav footer aside form button select option textarea datalist dialog iframe object svg canvas audio video map menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
#: Names of classes and ids, or their beginnings, that mark what stands around an article, unless an article or main element is in it.
AROUND = re.compile(r"(?:^|\s)(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|widgets?|toolbar|pagination|pager|skip|tags|taxonomy|masthead|topbar|site-header|page-header)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|\s)(?:site-|page-)?header(?:$|[\s_-])", re.I)
WHOLE = set("html body article main".split())
SIGMA, RADIUS = 1.0, 3
#: Elements that a new one of the kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body article main div section".split())


class Page(HTMLParser):
    """Lines of a page. A line is a block's text with the tags in it, the element it stands in, and whether it may be article
    text. Elements are numbered as they open, so a parent's number is less than its children's; what is asked of the elements
    about another is kept with each, so that the work grows with the page's length however deep it is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[int] = [0]  # the elements open now; 0 stands for the page
        self.n_open: Counter = Counter()  # open elements of each kind
        self.kinds, self.parents = [""], [-1]
        self.may = [True]  # the element's text may be the article's
        self.inside = [False]  # in an article or main element, or one itself
        self.apart = [False]  # the element's text isn't the text of the block it stands in
        self.named: set[int] = set()  # elements whose names alone say that they stand around an article
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1], self.may[self.open[-1]]))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if self.n_open["p"] and tag not in ("caption", "td", "th", "tr", "tbody"):
                self.close_to("p")
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if any(self.n_open[t] for t in CLOSES.get(tag, ())):
            for i in range(len(self.open) - 1, 0, -1):
                kind = self.kinds[self.open[i]]
                if kind in CLOSES[tag]:
                    self.shut(i)
                    break
                if kind in SCOPES:
                    break
        up, attrs = self.open[-1], dict(attrs)
        at = len(self.kinds)
        self.kinds.append(tag)
        self.parents.append(up)
        if self.by_name(tag, attrs, up):
            self.named.add(at)
        self.may.append(self.may[up] and not self.around(tag, attrs, up))
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self.apart.append(tag not in BLOCKS and (self.apart[up] or at in self.named or self.may[up] and not self.may[at]))
        self.open.append(at)
        self.n_open[tag] += 1

    def around(self, tag, attrs, up):
        if tag in NEVER or tag == "header" and not self.inside[up]:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return True
        return (attrs.get("role") or "").lower() in ROLES

    def by_name(self, tag, attrs, up):
        if tag in WHOLE:
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return bool(AROUND.search(names)) or not self.inside[up] and bool(HEADER.search(names))

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        self.close_to(tag)

    def shut(self, i):
        """Close the elements from the i-th open one on."""
        for n in self.open[i:]:
            self.n_open[self.kinds[n]] -= 1
        del self.open[i:]

    def close_to(self, tag):
        if not self.n_open[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            kind = self.kinds[self.open[i]]
            if kind == tag:
                self.shut(i)
                return
            if tag not in BLOCKS and kind in BLOCKS or tag == "p" and kind in WHOLE:
                return

    def handle_data(self, data):
        if not self.apart[self.open[-1]]:
            self.text.append(data)

    def about(self, found: set[int]) -> list[bool]:
        """Of each element, whether it or one about it is among those found."""
        out: list[bool] = []
        for n, up in enumerate(self.parents):
            out.append(n in found or up >= 0 and out[up])
        return out

    def weights(self, chosen: list[bool]) -> list[int]:
        """Of each element, the characters of chosen lines in it."""
        out = [0] * len(self.kinds)
        for (text, _, n, _), yes in zip(self.lines, chosen, strict=True):
            if yes:
                out[n] += len(text)
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out


def smoothed(ratios: list[float]) -> list[float]:
    """Each value and its neighbours, weighed by a Gaussian kernel."""
    kernel = [math.exp(-(d * d) / (2 * SIGMA**2)) for d in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(kernel[d + RADIUS], ratios[i + d]) for d in range(-RADIUS, RADIUS + 1) if 0 <= i + d < len(ratios)]
        out.append(sum(k * r for k, r in near) / sum(k for k, _ in near))
    return out


def judged(page: Page, high: list[bool]) -> list[bool]:
    """Whether each line may be article text, where it is refused in an element of a refused name, too; high: lines over the
    ratio bound.

    Where no article or main element elsewhere has high lines, an element that holds one and half of the high text, or nine
    tenths of it without one, is not refused for its name.
    """
    refused = page.about(page.named)
    ok = [may and not refused[n] for _, _, n, may in page.lines]
    if any(h and yes and page.inside[n] for h, yes, (_, _, n, _) in zip(high, ok, page.lines, strict=True)):
        return ok
    held = page.weights([h and may for h, (_, _, _, may) in zip(high, page.lines, strict=True)])
    whole = {n for n, kind in enumerate(page.kinds) if kind in ("article", "main") and held[n]}
    for n in range(len(page.kinds) - 1, 0, -1):
        if n in whole:
            whole.add(page.parents[n])
    refused = page.about({n for n in page.named if not (2 * held[n] >= held[0] > 0 if n in whole else 10 * held[n] >= 9 * held[0] > 0)})
    return [may and not refused[n] for _, _, n, may in page.lines]


def blocks(html: str) -> list[str]:
    """The article's blocks in page order."""
    page = Page()
    end = html.rfind(">") + 1
    if cut := re.compile("<[A-Za-z/!?]").search(html, end):  # nor is a tag that is cut off, which the parser would look at again and again
        html = html[: cut.start()]
    at = html.rfind("<!--")
    page.feed(html[:at] if at >= 0 and "-->" not in html[at:] and "</" not in html[at:] else html)  # a comment cut off isn't text
    page.close()
    page.flush()
    if not page.lines:
        return []
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _, _ in page.lines])
    mean = sum(ratios) / len(ratios)
    bound = min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    ok = judged(page, [r >= bound for r in ratios])
    content = [yes and r >= bound for r, yes in zip(ratios, ok, strict=True)]
    if not any(content):
        content = ok
    weight = page.weights(content)
    named = [n for n, kind in enumerate(page.kinds) if kind in ("article", "main") and weight[n] and 2 * weight[n] >= weight[0]]
    if named:
        top = min(named, key=lambda n: (page.kinds[n] != "article", -weight[n], n))
    else:
        top = max((n for n, w in enumerate(weight) if w and 10 * w >= 9 * weight[0]), default=0)
    within = page.about({top})
    return [text for (text, _, n, _), yes in zip(page.lines, ok, strict=True) if yes and within[n]]


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(html)) if html else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the main text of the whole html of each row: blocks of the region whose lines have much text for their tags.

    Lines are block elements. Their ratios of characters to tags are smoothed over neighbouring lines, and lines at or above
    the ratios' standard deviation, or their mean where that is lower, are content. The article is the article or main element
    with at least half of the content's characters, else the innermost element with nine tenths; all its
    lines count but those of menus, headers, footers, sidebars, notices, adverts, forms and comments.
    Null, empty and textless pages give an empty text. Very long and deep pages take time in proportion to their length.
    Repeated rows stay repeated; a column of pages named out_col gives way, other columns pass. No rows give none.
    """

    def run(html):
        import pyarrow as pa

        return pa.array([main_text(h.as_py()) for h in html], pa.string())

    return pages.withColumn(out_col, F.arrow_udf(run, T.StringType())(F.col(html_col)))
