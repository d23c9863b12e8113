"""HTML extraction: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters, content regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their part in a page, and words in class, id or role that mark what isn't main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
REGION = {"article", "body", "div", "main", "section", "td"}
NEVER = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object",
    "script", "select", "style", "svg", "template", "textarea", "video",
}
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Marks that an article below doesn't lift: it is a teaser, an advert or a comment. A main element lifts all but comments.
FIRM = {
    "ad", "ads", "advert", "advertisement", "adverts", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo",
    "disqus", "footer", "menu", "nav", "navbar", "navigation", "promo", "promotion", "related", "replies", "respond", "sidebar", "sponsor",
    "sponsored",
}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
#: Inside an article a name counts only if it has marks and words such as these alone: ``share-buttons`` does, ``market-share`` doesn't.
FILLERS = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "footer", "form", "icon", "icons", "inline", "inner",
    "item", "items", "left", "link", "links", "list", "main", "more", "outer", "page", "panel", "post", "posts", "right", "row", "section", "signup", "site", "slot", "stories",
    "story", "thread", "tools", "top", "unit", "wrap", "wrapper",
}
#: Names with one of these words say how a page is laid out, not what the element is.
MODIFIERS = {"has", "have", "hide", "hides", "no", "not", "show", "shows", "with", "without"}
CLOSES_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li", "summary", "figcaption"}
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

#: Where a search for an open paragraph, and for an open item or cell, ends.
FENCES = (REGION | NEVER, {"ul", "ol", "dl", "menu", "table"} | NEVER)

#: Why an element is left out: by a form or a mark, a firm mark, or for good.
SOFT, NAMED, GONE = 1, 2, 3

SIGMA, RADIUS = 1.0, 3
#: A line belongs to a cluster if its smoothed ratio is over this share of the mean.
SHARE = 0.5
#: An article is a teaser if the regions outside articles have more than this times its text.
TEASER = 3
SPACE = re.compile(r"\s+")
WORDY = re.compile(r"[^\W_]")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Name, attributes and end of a start tag; none of them goes back on what it took, so each character is read once.
NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*+")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
TAIL = re.compile(r"([\s/]*+)>")


def names(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
    """Words of each name in class, id and role, without names that have a modifier (``with-sidebar``, ``no-sidebar``)."""
    split = [{w.lower() for w in PARTS.findall(name)} for k, v in attrs if k in ("class", "id", "role") and v for name in v.split()]
    return [words for words in split if not words & MODIFIERS]


def marks(attrs: list[tuple[str, str | None]], whole: bool) -> set[str]:
    """Marks in the names of an element; with ``whole``, in those that are nothing but marks and fillers."""
    return {w for words in names(attrs) if not whole or words <= MARKS | FILLERS for w in words & MARKS}


class Lines(HTMLParser):
    """Parser events as they stream in, to lines of text: (text, tags, linked characters, region, main).

    ``spare`` has the lines of forms and of elements that are left out for a name that isn't firm. Each event takes the same time however many
    elements are open: places of open tags are kept by tag.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.spare: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int, int, bool]] = []  # tag, left out, region, main
        self.places: dict[str, list[int]] = {}
        self.fences: tuple[list[int], list[int]] = ([-1], [-1])
        self.text: list[str] = []
        self.tags = self.linked = self.regions = self.at = 0
        self.plain = self.loose = self.open_comment = False
        self.last_end: tuple[str, int] = ("", -1)

    # tags that don't end, in time in proportion to the page

    def no_end(self, i: int) -> bool:
        """Whether no tag ends after a place."""
        if self.last_end[0] is not self.rawdata:
            self.last_end = (self.rawdata, self.rawdata.rfind(">"))
        return i > self.last_end[1]

    def rest(self, i: int) -> int:
        """All that follows is text, as no tag ends any more."""
        self.handle_data(unescape(self.rawdata[i:]))
        return len(self.rawdata)

    def attributes(self, at: int, end: int) -> tuple[list[tuple[str, str | None]], int]:
        found = []
        while m := ATTRIBUTE.match(self.rawdata, at, end):
            value = next((v for v in m.group(2, 3, 4) if v is not None), None)
            found.append((m[1].lower(), unescape(value) if value else value))
            at = m.end()
        return found, at

    def parse_starttag(self, i: int) -> int:
        """A tag ends at the first ``>`` outside quotes. Once a page ends inside one, quotes don't count any more."""
        if self.no_end(i):
            return self.rest(i)
        raw, self.at = self.rawdata, i
        name = NAME.match(raw, i + 1)
        attrs, at = self.attributes(name.end(), len(raw)) if not self.loose else ([], i)
        if not (tail := TAIL.match(raw, at)):
            self.loose = True
            end = raw.find(">", i)
            attrs, at = self.attributes(name.end(), end)
            tail = TAIL.match(raw, at)
        tag = self.lasttag = name[0].lower()
        if tail[1].endswith("/"):
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return tail.end()

    def parse_endtag(self, i: int) -> int:
        return self.rest(i) if self.no_end(i) else super().parse_endtag(i)

    def parse_pi(self, i: int) -> int:
        return self.rest(i) if self.no_end(i) else super().parse_pi(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment; one that isn't closed ends at the next ``>``."""
        if self.no_end(i):
            return self.rest(i)
        end = -1 if self.open_comment else super().parse_comment(i, report)
        self.open_comment = end < 0
        return end if end >= 0 else self.rawdata.find(">", i) + 1

    def parse_html_declaration(self, i: int) -> int:
        if self.no_end(i):
            return self.rest(i)
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.rawdata.find(">", i) + 1

    # lines

    def end_line(self) -> None:
        if line := SPACE.sub(" ", "".join(self.text)).strip():
            _, out, region, main = self.open[-1] if self.open else ("", 0, 0, False)
            linked = self.linked if self.plain or not self.linked else len(line)  # blanks and bars between links are no text
            (self.spare if out else self.lines).append((line, self.tags, linked, region, main))
        self.text, self.tags, self.linked, self.plain = [], 0, 0, False

    def push(self, tag: str, out: int, region: int, main: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        for fence, kinds in zip(self.fences, FENCES, strict=True):
            if tag in kinds:
                fence.append(len(self.open))
        self.open.append((tag, out, region, main))

    def pop(self, tag: str) -> None:
        """Close the innermost element of a tag that is open, and all inside it."""
        end = self.places[tag][-1]
        while len(self.open) > end:
            self.places[self.open.pop()[0]].pop()
        for fence in self.fences:
            while fence[-1] >= end:
                fence.pop()

    def has(self, tag: str, fence: int) -> bool:
        """Whether an element of a tag is open inside the innermost one that ends the search."""
        return bool(places := self.places.get(tag)) and places[-1] >= self.fences[fence][-1]

    def unclosed(self, tag: str) -> bool:
        """Whether an element of a tag is open that no end tag after here closes."""
        return bool(self.places.get(tag)) and not re.compile(f"</{tag}\\b", re.I).search(self.rawdata, self.at)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            if tag in ("article", "main") and self.unclosed("nav"):  # its author meant it to end before
                while self.places.get("nav"):
                    self.pop("nav")
            if tag in CLOSES_P and self.has("p", 0):
                self.pop("p")
            for other in SIBLINGS.get(tag, ()):
                if self.has(other, 1):
                    self.pop(other)
        self.tags += 1
        if tag in VOID:
            return
        _, out, region, main = self.open[-1] if self.open else ("", 0, 0, False)
        if tag == "form":  # one inside an article is part of it, and no article inside that lifts it
            out = max(out, GONE if main else SOFT)
        elif tag in NEVER or (tag == "header" and not main):
            out = GONE
        elif tag in ("article", "main"):
            if marks(attrs, True) & COMMENTS:
                out = GONE
            elif not main and out <= (NAMED if tag == "main" else SOFT):
                out = 0
        elif out < GONE and tag not in ("html", "body"):
            if named := marks(attrs, main):
                firm = GONE if main or named & COMMENTS or tag not in ("div", "section") else NAMED if named & FIRM else SOFT
                out = max(out, firm)
            if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
                out = GONE
        if tag in REGION and not main:  # an article is one region, whatever is inside
            self.regions += 1
            region = self.regions
        self.push(tag, out, region, main or tag in ("article", "main"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.places.get(tag):
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1] > SOFT:
            return
        self.text.append(data)
        if self.places.get("a"):
            self.linked += len(data)
        elif not self.plain:
            self.plain = bool(WORDY.search(data))

    def finish(self) -> list[tuple[str, int, int, int, bool]]:
        """All lines; the spare ones instead if they have so much more text that the others are what is around them."""
        self.close()
        self.end_line()
        text = lambda lines: sum(max(len(t) - linked, 0) for t, _, linked, _, _ in lines)
        inside = any(main for *_, main in self.lines)
        return self.spare if self.spare and not inside and text(self.spare) > TEASER * text(self.lines) else self.lines


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios after a Gaussian filter; there is nothing before the first line and after the last."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratios, RADIUS), kernel / kernel.sum(), "valid")


def clusters(lines: list[tuple[str, int, int, int, bool]], use: list[bool]) -> set[int]:
    """Regions that hold a line whose smoothed text-to-tag ratio is over the threshold; of lines to use only."""
    ratio = np.array([max(len(t) - linked, 0) / max(tags, 1) * ok for (t, tags, linked, _, _), ok in zip(lines, use, strict=True)])
    smooth = smoothed(ratio)
    over = (smooth > SHARE * smooth.mean()) & (ratio > 0)
    return {lines[i][3] for i in np.flatnonzero(over if over.any() else np.array(use))}


def content(lines: list[tuple[str, int, int, int, bool]]) -> list[str]:
    """Lines of the content regions, whole.

    A line's ratio is its characters outside links over its tags. Where a page has articles or a main element, only their
    lines count, and each is one region with all that it holds; unless what other regions have is so much more that the
    articles are teasers.
    """
    if not lines:
        return []
    inside = [main for *_, main in lines]
    if any(inside):
        others = [not main for main in inside]
        regions = clusters(lines, others) if any(others) else set()
        outside = sum(len(t) for t, _, _, region, main in lines if region in regions and not main)
        if outside <= TEASER * sum(len(t) for t, *_, main in lines if main):
            regions = clusters(lines, inside)
            return [t for t, _, _, region, main in lines if region in regions and main]
        return [t for t, _, _, region, main in lines if region in regions or main]
    regions = clusters(lines, [True] * len(lines))
    return [t for t, _, _, region, _ in lines if region in regions]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    return " ".join(content(parser.finish()))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, text): each row of ``pages`` as a struct without its html, and the main text of its whole page.

    Elements of navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and comments
    never give lines. A form, or a div or section that is marked by name, doesn't hide an article below it unless its name
    is one of navigation, sidebars, footers, adverts or comments; a main element is only hidden by comments, or by tag. What
    a form or another such name hides is the text where the rest of the page has less than a third of it and no article.
    Inside an article a name has to be a mark as a whole; an article that is a comment by name is one. A ``nav`` that is
    never closed ends where an article begins. Of the other lines, the regions around clusters of high text-to-tag ratio
    are the main text, whole; words of links don't count, and blanks and bars between them neither. Markup that is nested
    or unclosed however deep, and tags, quotes and comments that don't end, take time in proportion. A null or empty page
    gives an empty text; text without any markup is one line and stays. Unclosed and stray tags
    close as browsers would for paragraphs, list items and cells. Repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    rest = F.struct(*[F.col(c) for c in pages.columns if c != html], F.lit(0).alias("_"))
    rows = pages.select(rest.alias("row"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
