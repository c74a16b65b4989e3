"""Main text of web pages by composite text density.

Every element gets its link-adjusted characters per tag (Sun, Song, Liao: "DOM Based Content Extraction
via Text Density", 2011). The element whose children's densities have the largest sum heads the main
text; the smallest density on the path from it to the body is the threshold from which other subtrees
count as well. Everything under the lowest common parent of what was selected is the article.

Elements that are no text by their tag (scripts, menus, fields) count nothing. Words in class, id and role
values that speak of menus, adverts, notices or comments give an element a level, which all that it holds has too. The
lowest level at which there is text to read (an article or main element with any, or a sentence) is that of the article, and
whatever stands above it is left out, however long it is. Reader comments are never taken while there is other text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/"']+)""")
_GAP = re.compile(r"\s+")
# HTML element classes (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math button meter mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mstyle semantics output q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img picture nobr".split()
)
_DROPPED = frozenset("script style noscript template iframe object svg canvas annotation annotation-xml head title select option textarea input nav aside menu dialog video audio map applet datalist".split())
_RAW = frozenset("script style noscript template iframe textarea title svg xmp noembed noframes".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head",)}
_SCOPE = frozenset("ul ol dl table td th div article section main body html aside nav".split())
_SEMANTIC = frozenset("html body article main".split())
# Words in class, id and role values that mark what is not the article (fixed values).
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner adsense "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar "
    "sidebar widget widgets complementary related recommended recommendations trending popular "
    "footer contentinfo copyright masthead topbar "
    "cookie cookies consent gdpr notice notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup login search "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social hidden".split()
)
_HEADER_WORDS = frozenset(("header", "siteheader"))


# Words before a marked word that deny it (fixed values).
_DENIED = frozenset("with has no without non not".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Levels of elements that a part of a class name marks, a whole one, or one of reader comments.
WEAK, SURE, OF_READERS = 1, 2, 3
#: Text that is read rather than a label: it ends as a sentence does, or has so many characters.
_SENTENCE_END = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")
READ_CHARS = 25
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements inside each other at most; what is nested deeper counts for the element at that depth.
MAX_DEPTH = 512


def _level(tag: str, attributes: str, in_article: bool) -> float:
    """Level of an element: 0 for an unmarked one, infinite for what is no text."""
    if tag in _DROPPED or (tag == "header" and not in_article) or tag == "footer":
        return math.inf
    needed = SURE if tag == "form" else 0
    if not attributes.strip() or tag in _SEMANTIC:
        return needed
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5] or "").lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")) or (name == "aria-hidden" and value == "true"):
            return math.inf
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            marked = [w for w in words if w in _MARKED or (w in _HEADER_WORDS and not in_article and tag in ("div", "section", "table"))]
            if marked and not _DENIED.intersection(words):
                of_readers = _COMMENTS.intersection(marked)
                needed = max(needed, WEAK if len(marked) < len(words) and not of_readers else OF_READERS if of_readers else SURE)
    return needed


class _Page:
    """Elements of a page in document order, and its text blocks as pieces with the element each stands in."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.tag, self.parent, self.level = ["#root"], [0], [0]
        self.own, self.own_links, self.own_tags = [0], [0], [0]
        self.linked = [False]
        self.blocks: list[tuple[int, list[tuple[int, str]]]] = []
        self.body = 0
        self._quotes = True  # until a quote turns out not to be closed
        self._read()
        self._count()

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: the next ``>`` outside quotes. If quotes are broken somewhere
        behind, those count no more, so that the page is passed over once."""
        first = self.source.find(">", at)
        if first < 0 or not self._quotes:
            return first
        while m := _MARK_END.search(self.source, at):
            if m[0] == ">":
                return m.start()
            at = self.source.find(m[0], m.end()) + 1
            if not at:
                break
        self._quotes = False
        return first

    def _read(self) -> None:
        source, stack, piece, in_button = self.source, [0], [], [False]
        in_link, in_article, at, text_from = 0, 0, 0, 0

        def flush() -> None:
            if piece and all(in_button[own] or not raw.strip() for own, raw in piece):  # a button is text only within a sentence
                for own, raw in piece:
                    n = len(_GAP.sub(" ", raw).strip())
                    self.own[own] -= n
                    self.own_links[own] -= n if self.linked[own] else 0
                piece.clear()
            if piece:
                holder = next(n for n in reversed(stack) if self.tag[n] not in _INLINE)
                self.blocks.append((holder, piece.copy()))
                piece.clear()

        def add(raw: str) -> None:
            own = stack[-1]
            if raw and self.level[own] < math.inf:
                piece.append((own, raw))
                n = len(_GAP.sub(" ", raw).strip())
                self.own[own] += n
                if self.linked[own]:
                    self.own_links[own] += n

        def close(depth: int) -> None:
            nonlocal in_link, in_article
            while len(stack) > depth:
                if self.tag[stack[-1]] not in _INLINE:
                    flush()
                n = stack.pop()
                in_link -= self.tag[n] == "a"
                in_article -= self.tag[n] in ("article", "main")

        def close_nearest(names: tuple[str, ...]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in names:
                    close(k)
                    return
                if self.tag[stack[k]] in _SCOPE:
                    return

        while (at := source.find("<", at)) >= 0:
            mark = source[at + 1 : at + 2]
            if mark and mark in "!?":
                end = source.find("-->", at + 2) + 2 if source.startswith("<!--", at) else source.find(">", at)
                end = end if end > at + 1 else len(source) - 1
                add(source[text_from:at])
                at = text_from = end + 1
                continue
            name = _NAME.match(source, at + 1 + (mark == "/"))
            end = self._tag_end(name.end()) if name else -1
            if end < 0:
                if name:
                    break  # no tag ends from here on
                at += 1
                continue
            add(source[text_from:at])
            tag, attributes = name[0].lower(), source[name.end() : end]
            at = text_from = end + 1
            if mark == "/":
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        close(k)
                        break
                    if tag in _INLINE and self.tag[stack[k]] not in _INLINE:
                        break  # an inline end tag closes nothing beyond its block
                continue
            if tag in _CLOSES_P:
                close_nearest(("p",))
            if tag in _CLOSED_BY:
                close_nearest(_CLOSED_BY[tag])
            if tag not in _INLINE:
                flush()
            if tag in _VOID:
                self.own_tags[stack[-1]] += tag not in ("br", "wbr")
                continue
            level = math.inf if self.level[stack[-1]] == math.inf else max(self.level[stack[-1]], _level(tag, attributes, in_article > 0))
            n = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.level.append(level)
            self.linked.append(tag == "a" or in_link > 0)
            in_button.append(tag == "button" or in_button[stack[-1]])
            for counts in (self.own, self.own_links, self.own_tags):
                counts.append(0)
            if tag == "body" and not self.body:
                self.body = n
            if tag in _RAW:
                closed = re.compile(f"</{re.escape(tag)}", re.IGNORECASE | re.ASCII).search(source, at)
                end = closed.start() if closed else len(source)
                stack.append(n)
                add(source[at:end])
                close(len(stack) - 1)
                at = text_from = source.find(">", end) + 1 or len(source)
                continue
            if (attributes.rstrip().endswith("/") and tag not in _CLOSES_P and tag not in _INLINE) or (len(stack) >= MAX_DEPTH and not (level == math.inf and self.level[stack[-1]] < math.inf)):
                continue
            stack.append(n)
            in_link += tag == "a"
            in_article += tag in ("article", "main")
        add(source[text_from:])
        close(1)
        flush()

    def _totals(self, values: list[int]) -> list[int]:
        """Of each element with all that it holds, less what is left out."""
        total = list(values)
        for n in range(len(total) - 1, 0, -1):
            if not self.skip[n]:
                total[self.parent[n]] += total[n]
            else:
                total[n] = 0
        return total

    def _count(self) -> None:
        size = len(self.tag)
        lowest = self._lowest()
        self.skip = [x > lowest for x in self.level]
        self.chars, self.links = self._totals(self.own), self._totals(self.own_links)
        below = [0] * size
        link_below = [0] * size
        for n in range(1, size):
            below[self.parent[n]] += not self.skip[n]
            link_below[self.parent[n]] += not self.skip[n] and self.tag[n] == "a"
        self.tags = self._totals([a + b for a, b in zip(self.own_tags, below, strict=True)])
        self.link_tags = self._totals(link_below)

    def _lowest(self) -> float:
        """The level of the article: the lowest with text to read; else the lowest with any text."""
        if not any(0 < x < math.inf for x in self.level):
            return 0
        article = [t in ("article", "main") for t in self.tag]
        for n in range(1, len(article)):
            article[n] = article[n] or article[self.parent[n]]
        read, held = {math.inf}, {math.inf}
        for holder, pieces in self.blocks:
            text = _GAP.sub(" ", html.unescape("".join(raw for n, raw in pieces if not self.linked[n]))).strip()
            if text:
                held.add(self.level[holder])
                if self.tag[holder] not in _HEADINGS and (article[holder] or len(text) >= READ_CHARS or _SENTENCE_END.search(text)):
                    read.add(self.level[holder])
        return min(read) if min(read) < OF_READERS else min(held)

    def density(self, n: int) -> float:
        """Composite text density of an element."""
        c, t, lc, lt = self.chars[n], max(1, self.tags[n]), max(1, self.links[n]), max(1, self.link_tags[n])
        if not c:
            return 0.0
        body_c, body_lc = max(1, self.chars[self.body]), self.links[self.body]
        base = math.log(c / max(1, c - self.links[n]) * self.links[n] + body_lc / body_c * c + math.e)
        return max(0.0, c / t * math.log(max(1.0, c / lc * (t / lt))) / max(base, 1e-9))

    def _text_of(self, pieces: list[tuple[int, str]]) -> str:
        return _GAP.sub(" ", html.unescape("".join(" " if self.skip[n] else raw for n, raw in pieces))).strip()

    def main_text(self) -> str:
        size = len(self.tag)
        if not self.blocks:
            return ""
        density = [0.0 if self.skip[n] or self.tag[n] in _INLINE else self.density(n) for n in range(size)]
        total = [float(self.own[n]) if not self.skip[n] and self.tag[n] not in _INLINE else 0.0 for n in range(size)]
        for n in range(1, size):
            total[self.parent[n]] += density[n]
        best = list(range(size))  # element of each subtree with the largest sum, the outermost of equals
        for n in range(size - 1, 0, -1):
            up = self.parent[n]
            if total[best[n]] > total[best[up]]:
                best[up] = best[n]
        head = best[self.body]
        path, n = [], head
        while n != self.body and n:
            path.append(density[n])
            n = self.parent[n]
        threshold = min([*path, density[self.body]])
        chosen, is_open = {head}, [False] * size
        for n in range(self.body, size):
            is_open[n] = density[n] >= threshold > 0 and (n == self.body or is_open[self.parent[n]])
            if is_open[n]:
                chosen.add(best[n])
        top = head
        for n in chosen:
            while self.chars[n] and n != top:
                n, top = (self.parent[n], top) if n > top else (n, self.parent[top])
        # the text of an article is whole: from a part of it to the nearest article that the threshold leaves open
        n = top
        while n and not (self.tag[n] in ("article", "main") and is_open[n]):
            n = self.parent[n]
        top = n or top
        inside = [False] * size
        for n in range(size):
            inside[n] = n == top or (n > 0 and inside[self.parent[n]])
        kept = [(n, text) for n, pieces in self.blocks if not self.skip[n] and (text := self._text_of(pieces))]
        first = next((k for k, (n, _) in enumerate(kept) if inside[n]), 0)
        # a headline stands right before the text, beside it or beside what holds it, where the text has none itself
        above, n = set(), top
        while n:
            n = self.parent[n]
            above.add(n)
        if first and self.tag[kept[first - 1][0]] == "h1" and self.parent[kept[first - 1][0]] in above and not any(self.tag[n] == "h1" for n in range(size) if inside[n]):
            inside[kept[first - 1][0]] = True
        return " ".join(text for n, text in kept if inside[n])


def main_text(source: str | None) -> str:
    """Main text of one whole page; empty for null, blank or textless pages."""
    return _Page(source).main_text() if source and source.strip() else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    White space in a block is one space and blocks are joined by one space in page order. A null or blank
    page, and one without text, gives an empty text of 0 code points. Repeated rows are all returned, and
    null ids and urls are kept; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
