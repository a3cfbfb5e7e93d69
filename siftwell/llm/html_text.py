"""Main text of web pages by text-to-tag ratios.

The standard library's parser sends events; block elements end a line, and a line keeps its text, the
tags within it and the element it stands in. A line's text-to-tag ratio is smoothed over its neighbours
with a Gaussian, and two clusters of the smoothed ratios give the threshold between content and the
rest. The content region is the innermost container that holds nearly all text of the content lines,
widened to containers that add little (its heading) and to the article it is part of. Its lines are the
page's text, short ones too; only lines of nothing but links at its ends, below the threshold, are left.

What an element is for is no more than evidence. Elements of HTML's own furniture (nav, footer, aside,
form, script, ...) are never text. Class words speak for furniture outright only where a whole class name
consists of them ("cookie-notice", "comments"); a name in which one occurs ("category-social") is
believed only if the ratios agree, that is, if what lies outside still holds some of the content. An
article or main element is never furniture by its class, unless that is a comment's.

Memory and time follow the page's length: elements are kept by their parents' numbers, list items, cells and
paragraphs that are never closed are ended by the next one, and sums go up the tree once.

Cases: null, empty and text-free pages give an empty text; a page without content lines (all ratios
alike) counts all its lines as content; broken and unclosed markup is read as the parser does, an unended
tag at the page's end is dropped if it looks like one, and text with a stray < is kept; very long pages
are read whole; repeated rows are read alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: Fixed values of HTML: elements without an end tag; elements that don't end a line; those without readable text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("applet audio button canvas datalist dialog form head iframe math menu nav noscript object footer aside option script select style svg template textarea title video".split())
#: Elements that a next one of the same kind ends, and the elements within which it does.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table thead tbody tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table"), "option": ("option", "select")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Page furniture by words in class, id and role.
FURNITURE = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs captcha comment comments complementary consent contentinfo cookie cookies dialog disqus feedback footer form gdpr login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
HEADERS = frozenset("header masthead topbar".split())
COMMENT = frozenset("comment comments reply replies".split())
BODY = frozenset("article main".split())
#: Elements that can be the content region.
CONTAINERS = frozenset("article blockquote body center div main section table td".split())
#: Lines on either side that a ratio is smoothed over, and how much of the content the region must hold.
SIGMA, SHARE = 1.5, 0.9
#: A container is widened to the one around it if that adds at most this part of its text.
HEADING = 0.25
#: Furniture by a word within a class name is believed if this part of the content lies outside.
OUTSIDE = 0.2
_SPLIT, _NAMES = re.compile(r"[^a-z0-9]+"), re.compile(r"[^a-z0-9_-]+")
_CUT_TAG = re.compile(r"""<(?:!--(?:(?!-->)[\s\S])*|/?[a-zA-Z][a-zA-Z0-9-]*(?:\s+[\w:-]+=(?:"[^"]*"?|'[^']*'?|[^\s"'<>]*))*\s*(?:[\w:-]+=?)?\s*/?)\Z""")
PLAIN, MAYBE, SURE = 0, 1, 2


def furniture(attrs: list, names: frozenset[str] = FURNITURE) -> int:
    """SURE if a whole name of class, id or role consists of furniture words, MAYBE if one occurs in a name."""
    found = PLAIN
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for name in _NAMES.split(value.lower()):
                parts = {p for p in _SPLIT.split(name) if p}
                if parts and parts <= names:
                    return SURE
                if not parts.isdisjoint(names):
                    found = MAYBE
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return SURE
    return found


class Lines(HTMLParser):
    """Lines of a page as (text, tags, element, whether all of it is links); elements by number with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.names, self.parents = [""], [0]  # by an element's number; 0 is the page
        self.doubtful: list[int] = []  # elements that may be furniture
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number, silent, in the article
        self.blocks: list[int] = []  # places in open of what isn't inline
        self.count: Counter[str] = Counter()  # open elements by tag
        self.parts: list[str] = []
        self.tags = self.plain = 0

    def end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, self._block(), not self.plain))
                self.tags = 0
            self.parts.clear()
            self.plain = 0

    def _block(self) -> int:
        return self.open[self.blocks[-1]][1] if self.blocks else 0

    def _close(self, at: int) -> None:
        """Close the elements from this place on."""
        while len(self.open) > at:
            self.count[self.open.pop()[0]] -= 1
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            if self.blocks and self.open[self.blocks[-1]][0] == "p":  # a block ends an open paragraph
                self._close(self.blocks[-1])
            if tag in IMPLIED:
                ended, within = IMPLIED[tag]
                while self.blocks and self.open[self.blocks[-1]][0] in ended:
                    self._close(self.blocks[-1])
                if self.blocks and self.open[self.blocks[-1]][0] not in within and any(self.count[t] for t in ended):
                    k = next((k for k in reversed(self.blocks[-16:]) if self.open[k][0] in ended | within), None)
                    if k is not None and self.open[k][0] in ended and tag != "li":
                        self._close(k)
        silent, within = self.open[-1][2:] if self.open else (False, False)
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(self.open[-1][1] if self.open else 0)
        if not silent and tag not in ("html", "body"):
            sure = furniture(attrs, COMMENT if tag in BODY else FURNITURE)
            if not within and tag not in BODY:
                heads = furniture(attrs, HEADERS)
                sure = max(sure, heads)
            silent = tag in SILENT or tag == "header" and not within or sure == SURE
            if sure == MAYBE and not silent and tag not in BODY:
                self.doubtful.append(number)
        within |= tag in BODY or any(k == "role" and v == "main" for k, v in attrs)
        self.open.append((tag, number, silent, within))
        self.count[tag] += 1
        if tag not in INLINE:
            self.blocks.append(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        if not self.count[tag]:
            return
        least = self.blocks[-1] if self.blocks else -1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return
            if tag in INLINE and i <= least:
                return  # an inline element ends within its block

    def handle_data(self, data: str) -> None:
        if not self.open or not self.open[-1][2]:
            self.parts.append(data)
            if not self.count["a"] and not data.isspace():
                self.plain += 1


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters, found by moving it to their middle until it rests."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(high) or not len(low):
            return float(values.min()) - 1
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = float(new)
    return cut


def content_lines(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    """Which lines the two clusters of smoothed ratios call content."""
    ratios = smooth(np.array([len(t) / (1 + tags) for t, tags, _, _ in lines]))
    return ratios > threshold(ratios)


def _sums(parents: list[int], of: list[int], amounts: list[int]) -> list[int]:
    """What each element holds with all below it; children have larger numbers than their parents."""
    out = [0] * len(parents)
    for element, n in zip(of, amounts, strict=True):
        out[element] += n
    for k in range(len(parents) - 1, 0, -1):
        out[parents[k]] += out[k]
    return out


def _inside(parents: list[int], marked: set[int]) -> list[bool]:
    """Whether an element is a marked one or below one."""
    out = [False] * len(parents)
    for k in range(len(parents)):
        out[k] = k in marked or k > 0 and out[parents[k]]
    return out


def region_of(names: list[str], parents: list[int], lines: list[tuple[str, int, int, bool]], content: np.ndarray) -> int:
    """The element that is the content region."""
    of = [e for _, _, e, _ in lines]
    whole = _sums(parents, of, [len(t) for t, *_ in lines])
    held = _sums(parents, of, [len(t) * bool(c) for (t, *_), c in zip(lines, content, strict=True)])
    region = max(k for k in range(len(parents)) if (k == 0 or names[k] in CONTAINERS) and held[k] >= SHARE * held[0])
    above = [region]
    while above[-1]:
        above.append(parents[above[-1]])
    around = [e for e in above if names[e] in BODY]
    if around:
        return next((e for e in reversed(around) if names[e] == "article"), around[-1])
    for e in above[1:]:
        if names[e] in CONTAINERS and names[e] != "body" and whole[e] - whole[region] <= HEADING * whole[region]:
            region = e
        elif names[e] in CONTAINERS or e == 0:
            break
    return region


def main_text(html: str | None) -> str:
    if not html:
        return ""
    cut = html.rfind("<")
    if cut >= 0 and cut > html.rfind(">") and _CUT_TAG.match(html, cut):
        html = html[:cut]  # a tag that the page's end cuts off
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    if parser.doubtful:
        content = content_lines(lines)
        total = sum(len(t) for (t, *_), good in zip(lines, content, strict=True) if good)
        below = _inside(parents, set(parser.doubtful))
        rest = [(line, good) for line, good in zip(lines, content, strict=True) if not below[line[2]]]
        if sum(len(line[0]) for line, good in rest if good) >= OUTSIDE * total:
            lines = [line for line, _ in rest]
    content = content_lines(lines)
    region = region_of(parser.names, parents, lines, content)
    below = _inside(parents, {region})
    chosen = [(line, good) for line, good in zip(lines, content, strict=True) if below[line[2]]]
    if parser.names[region] not in BODY:
        first = next((k for k, (line, good) in enumerate(chosen) if good or not line[3]), 0)
        last = next((k for k in range(len(chosen) - 1, -1, -1) if chosen[k][1] or not chosen[k][0][3]), len(chosen) - 1)
        chosen = chosen[first : last + 1]
    return " ".join(line[0] for line, _ in chosen)


def _extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.single_threaded()
    for rb in words.batches(rows, "html", 4 << 20):
        texts = [main_text(h) for h in rb.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
