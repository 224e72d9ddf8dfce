"""Operator 5: main text of HTML pages by composite text density.

A page becomes a tree of elements (tags are read one after the other; ends of paragraphs, list items
and table parts that are not marked are filled in). Elements that never hold an article's text
(scripts, menus, forms, notices, adverts, comments ...) are left out. Of every other element the
density is its characters per tag, adjusted by how many of them are links; its density sum
adds up the densities of its children. The threshold is the least density on the path from the
element of the greatest sum up to the body; the text is, from the body down, the subtree of the
greatest sum in every element that reaches it, and the whole of an article or main element around the
greatest. An element whose class, id or role has a mark's word among others (has-sidebar) is left out only if
it is small beside the page's text, mostly links, or a list of comments by its parts. Reading takes time
in proportion to the page, whatever its tags and quotes."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from optrace.llm.common import slices

NAME, SPECIAL = re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), re.compile("[\"'>]")
#: Fixed values of HTML: elements without content, with raw content, and that make a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {x: re.compile(f"</{x}(?=[\\s/>])", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements and words of class, id or role that mark what is no article text.
DROPPED = set("head script style title noscript template iframe object svg canvas nav aside footer form button select textarea input dialog menu audio video".split())
MARKS = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup comment comments "
    "respond discussion disqus reply replies social share sharing related recommended widget toolbar pagination complementary contentinfo".split()
)
#: Words of a list of reader comments, and words that say nothing beside them.
COMMENTS = set("comment comments respond discussion disqus reply replies".split())
PLAIN = set("user users reader readers list lists section area container wrapper block box thread threads form post posts page item items region root wrap count".split())
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Fixed value: the share of text, and of links, that decides on elements marked by a word among others.
SHARE = 1 / 3
CONTAINERS = set("div section ul ol dl table header center".split())
SPACE = re.compile(r"\s+")


def _marked(attributes: str) -> tuple[bool, bool, str]:
    """Whether a name in class, id or role is all marks, or comments with plain words beside them;
    whether one has a mark's word among others; and all names."""
    partly, names = False, []
    for found in ATTRIBUTE.finditer(attributes):
        for name in (found[2] or found[3] or found[4] or "").split():
            words = [w.lower() for w in WORD.findall(name)]
            names.append(name)
            if words and (all(w in MARKS for w in words) or (any(w in COMMENTS for w in words) and all(w in COMMENTS or w in PLAIN for w in words))):
                return True, True, name
            partly |= any(w in MARKS for w in words)
    return re.search(r"(?:^|\s)(hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)", attributes, re.I) is not None, partly, " ".join(names)


class _Tags:
    """The tags of a page from left to right, in time that grows with its length: what a scan that
    failed has seen is not looked at again."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.failed: set[int] = set()  # quotes from which no tag ends
        self.next = (0, -1)  # from the first place on, the second is the next quote or end

    def _special(self, at: int) -> int:
        if not self.next[0] <= at <= self.next[1]:
            found = SPECIAL.search(self.source, at)
            self.next = at, found.start() if found else len(self.source)
        return self.next[1]

    def _end(self, at: int) -> int:
        """Place of the > that ends the tag, quoted ones not counted; else of the first >."""
        place, seen = at, []
        while True:
            place = self._special(place)
            if place == len(self.source) or place in self.failed:
                break
            if self.source[place] == ">":
                return place
            close = self.source.find(self.source[place], place + 1)
            seen.append(place)
            if close < 0:
                break
            place = close + 1
        self.failed.update(seen)
        return self.source.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, int, str, str]]:
        """(text before, place behind the tag, its name with / in front of an end tag, attributes); the
        place may be moved by send()."""
        source, at, size, begin = self.source, 0, len(self.source), 0
        while True:
            start = source.find("<", at)
            if start < 0:
                yield source[begin:], size, "", ""
                return
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                name, attributes, end = "", "", size if end < 0 else end + 3
            elif source.startswith(("<!", "<?"), start) and start < self.last:
                name, attributes, end = "", "", source.find(">", start) + 1
            else:
                found = NAME.match(source, start + 1) if start < self.last else None
                if not found:
                    at = start + 1
                    continue
                end = self._end(found.end())
                name, attributes, end = found[1] + found[2].lower(), source[found.end() : end], end + 1
            moved = yield source[begin:start], end, name, attributes
            at = begin = end if moved is None else moved


class _Page:
    """Elements in document order, and the text between their tags."""

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped, self.doubtful = ["body"], [-1], [False], [False]
        self.begins, self.ends = [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) between blocks
        self.names = [""]
        self.stack, self.open = [0], defaultdict(list)  # by tag the places of its open elements in the stack
        self._read(source)
        while self.stack:
            self._close()

    def _close(self) -> None:
        node = self.stack.pop()
        if self.stack:
            self.open[self.tags[node]].pop()
        self.ends[node] = len(self.events) if self.stack or node == 0 else self.ends[node]

    def _text(self, text: str) -> None:
        node = self.stack[-1]
        if text and not self.dropped[node]:
            self.events.append((node, html.unescape(text)))

    def _break(self) -> None:
        self.events.append((self.stack[-1], None))

    def _close_to(self, names: set[str], borders: set[str]) -> None:
        """Close the outermost open element of these names above the nearest border."""
        border = max((self.open[x][-1] for x in borders if self.open[x]), default=0)
        places = [self.open[x] for x in names if self.open[x] and self.open[x][-1] > border]
        at = min((x[bisect_right(x, border)] for x in places), default=None)
        if at is not None:
            while len(self.stack) > at:
                self._close()
            self._break()

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag != "body" and tag != "html":
                self._close_to({"p"}, {"button", "td", "th", "table", "caption"})
            self._break()
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        node = len(self.tags)
        drop = tag in DROPPED or (tag == "header" and not (self.open["article"] or self.open["main"]))
        marked, doubtful, names = _marked(attributes) if attributes and tag not in ("html", "body", "article", "main") else (False, False, "")
        drop = drop or marked
        self.names.append(names)
        self.doubtful.append(doubtful)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.dropped.append(drop or self.dropped[self.stack[-1]])
        self.begins.append(len(self.events))
        self.ends.append(len(self.events))
        self.open[tag].append(len(self.stack))
        self.stack.append(node)

    def _read(self, source: str) -> None:
        tags, moved = iter(_Tags(source)), None
        while True:
            try:
                text, at, tag, attributes = tags.send(moved)
            except StopIteration:
                return
            moved = None
            self._text(text)
            if not tag:
                continue
            if tag[0] == "/":
                self._end(tag[1:])
            elif tag in ("html", "body"):
                continue
            elif tag in VOID:
                if tag == "hr":
                    self._break()
                elif tag == "br":
                    self._text(" ")
            elif tag in RAW:
                found = RAW[tag].search(source, at)
                end = source.find(">", found.end()) if found else -1
                moved = end + 1 if end >= 0 else len(source)
            else:
                self._open(tag, attributes)
                if attributes.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
                    self._close()

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            at = self.open[tag][-1]
            while len(self.stack) > at:
                self._close()
            if tag in BLOCK:
                self._break()
        elif tag == "p":
            self._break()


def _repeated(page: _Page) -> set[int]:
    """Elements with comments among their names that hold several parts of one kind (tag and names)."""
    kinds: dict[tuple, int] = defaultdict(int)
    out = set()
    for i in range(1, len(page.tags)):
        parent = page.parents[i]
        if page.tags[i] not in CONTAINERS and page.tags[i] not in ("li", "article"):
            continue
        while page.tags[parent] in ("ul", "ol", "dl") and not page.names[parent]:
            parent = page.parents[parent]
        if page.doubtful[parent] and any(w.lower() in COMMENTS for w in WORD.findall(page.names[parent])):
            kinds[parent, page.tags[i], page.names[i]] += 1
            if kinds[parent, page.tags[i], page.names[i]] > 1:
                out.add(parent)
    return out


def _drop_doubtful(page: _Page) -> None:
    """Leave out doubtful elements around no article or main that hold less than a SHARE of the
    page's text, or more than a SHARE of whose text is links; and all below an element left out."""
    n = len(page.tags)
    chars, links, whole, in_link = [0] * n, [0] * n, [x in ("article", "main") for x in page.tags], [x == "a" for x in page.tags]
    for i in range(1, n):
        in_link[i] |= in_link[page.parents[i]]
    for node, text in page.events:
        size = len(text.strip()) if text and not page.dropped[node] else 0
        chars[node] += size
        links[node] += size if in_link[node] else 0
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += links[i]
        whole[page.parents[i]] |= whole[i] and not page.dropped[i]
    repeated = _repeated(page)
    for i in range(1, n):
        few = i in repeated or chars[i] < SHARE * chars[0] or links[i] > SHARE * chars[i]
        page.dropped[i] |= page.dropped[page.parents[i]] or (page.doubtful[i] and not whole[i] and few)


def _best(page: _Page) -> list[int]:
    """The elements whose text is the article, in page order; none is inside another."""
    if any(page.doubtful):
        _drop_doubtful(page)
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
    for node, text in page.events:
        if text and not page.dropped[node]:
            size = len(text.strip())
            chars[node] += size
            link_chars[node] += size if in_link[node] else 0
    # Elements without text of their own around a container of links are no article: its parts are.
    mixed, own = [False] * n, chars[:]
    for i in range(n - 1, 0, -1):
        if page.dropped[i]:
            continue
        parent = page.parents[i]
        mixed[parent] |= not own[parent] and page.tags[i] in CONTAINERS and link_chars[i] > chars[i] / 2
        chars[parent] += chars[i]
        tags[parent] += tags[i] + 1
        link_chars[parent] += link_chars[i]
        link_tags[parent] += link_tags[i] + (page.tags[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if page.dropped[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        base = math.log(math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e) + math.e)
        density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / base
        sums[i] = sums[i] or density[i]
        if i:
            sums[page.parents[i]] += density[i]
    worth = [0.0 if mixed[i] else sums[i] for i in range(n)]
    worth = worth if any(worth) else sums
    top = max(range(n), key=lambda i: (worth[i], -i))
    threshold, i = density[top], top
    while i > 0:
        i = page.parents[i]
        threshold = min(threshold, density[i])
    # An article or main element around the greatest sum belongs to the text whatever its density.
    i = top
    while i > 0 and page.tags[i] not in ("article", "main"):
        i = page.parents[i]
    whole = {top, i} if i > 0 else {top}
    # The element of the greatest sum below each element, the element itself among them.
    greatest = list(range(n))
    for i in range(n - 1, 0, -1):
        parent = page.parents[i]
        greatest[parent] = min(greatest[parent], greatest[i], key=lambda x: (-worth[x], x))
    chosen = whole | {greatest[i] for i in range(n) if chars[i] and not page.dropped[i] and density[i] > 0 and density[i] >= threshold}
    inside, out = [False] * n, []
    for i in range(n):
        inside[i] = i > 0 and inside[page.parents[i]]
        if i in chosen and not inside[i]:
            inside[i] = True
            out.append(i)
    return out


def main_text(source: str | None) -> str:
    """The article of a whole page: blocks in page order, white space in them as single spaces,
    joined by two line feeds; empty where there is no text."""
    if not source:
        return ""
    page = _Page(source)
    blocks, now = [], []
    found = [x for node in _best(page) for x in [*page.events[page.begins[node] : page.ends[node]], (0, None)]]
    for owner, text in found:
        if text is not None and page.dropped[owner]:
            continue
        if text is not None:
            now.append(text)
        elif now:
            block = SPACE.sub(" ", "".join(now)).strip()
            if block:
                blocks.append(block)
            now = []
    return "\n\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html). A null html counts as
    empty; repeated rows each give a row; other columns are left out."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
