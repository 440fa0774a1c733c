"""Main text of web pages by line-block distribution.

The page is stripped of comments, scripts, styles and other unseen elements, and of what names itself a menu, header,
footer, sidebar, notice, advert, form or reader comment; each block of what stays is a line.  Stripped elements, links
only, and the edges of an article leave WINDOW empty lines.  Text lengths are summed over sliding windows of WINDOW
lines: the distribution surges where a window's sum leaves zero and dives where it returns there.  The heaviest
stretch between surge and dive decides: if most of it is marked as an article, the text is that of all articles; else it
names the main container, the innermost element around it, whose stretches are all taken, short ones too, with others of at
least NEAR times its peak and what lies between them.  The container is widened to the outermost element around it that
names itself content (exact class or id of WHOLE), or else by siblings of the same element and class.  Lines of links only are
kept between the first and last stretch if they lie in the container; headings count as text though they are links.

Inside a marked article only whole parts are stripped: those with a class or id that is a word of PARTS, or a role; elsewhere
one word of a longer name is enough.  A link ends with its anchor: at its end tag, at the next anchor or with the block that
it began in; an anchor without href is none.

Pages are read by one forward pass, of a length in proportion to theirs; elements deeper than DEEPEST count as not nested.
White space, no-break spaces too, becomes one space inside a block; blocks are joined by one line feed.  A null or
empty page, or one without text, gives the empty string.  Markup may be unclosed, nested wrongly or cut off anywhere.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from voxelith.llm.store import arrow_map

WINDOW = 3
NEAR = 0.3

# Element names of the HTML standard, and words that pages use in class and id for their parts.
RAW = frozenset("script style noscript template title textarea iframe object svg canvas select button audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
STRIPPED = frozenset("nav footer aside form menu dialog search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy "
    "promo promotion promoted recommended related reply replies respond responses share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets".split()
)
WHOLE = frozenset("content article post entry main story".split())
#: Blocks that hold one paragraph: the container of a line is the element around them.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DEEPEST = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)")
_PLAIN = re.compile(r"""[^'">]*""")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Tags:
    """The tags of a page from left to right: (start, end, name, is it an end tag, attributes); comments, declarations and
    raw elements with all they hold have no name."""

    def __init__(self, page: str):
        self.page, self._open = page, set()  # places outside quotes from which no tag ends

    def _end(self, at: int) -> int:
        """Behind the > that ends a tag whose attributes begin at a place; -1 if none does.  No place is looked at twice in vain."""
        page, seen = self.page, []
        while at not in self._open:
            seen.append(at)
            stop = _PLAIN.match(page, at).end()
            if stop < len(page) and page[stop] == ">":
                return stop + 1
            quote = page.find(page[stop], stop + 1) if stop < len(page) else -1
            at = page.find("<", at, stop)
            while at >= 0:  # a tag that would begin here has no end either
                seen.append(at)
                at = page.find("<", at + 1, stop)
            if quote < 0:
                break
            at = quote + 1
        self._open.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, "", False, ""
                continue
            m = _NAME.match(page, start)
            if m is None:
                if page[at : at + 1] in ("!", "?", "/"):
                    end = page.find(">", at)
                    at = end + 1 if end >= 0 else len(page)
                    yield start, at, "", False, ""
                continue
            end = -1 if start in self._open else self._end(m.end())
            if end < 0:
                if page.find("<", at) < 0 and page.find(">", at) < 0:  # cut off
                    yield start, len(page), "", False, ""
                    return
                continue
            at, name = end, m[2].lower()
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, end)
                at = close.end() if close else len(page)
                yield start, at, "", False, ""
            else:
                yield start, end, name, bool(m[1]), page[m.end() : end - 1]


def _strips(name: str, attrs: str, in_article: bool) -> bool:
    """Does this element hold a part of the page that is not its article?"""
    if name in STRIPPED or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        inner = name == "article" and "comment" in attrs
        if not inner:
            return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id"):
            whole = set(value.lower().split())
            if in_article:
                if whole & PARTS:
                    return True
                continue
            words = {w.lower() for w in _PART.findall(value)}
            if words & PARTS and (not words & WHOLE or words & {"comment", "comments", "related", "sidebar", "footer", "ad", "ads"}):
                return True
            if "header" in words and not in_article and not words & WHOLE:
                return True
    return False


def lines_of(page: str) -> tuple[list[tuple[str, int, bool, tuple[int, ...]]], frozenset[int], dict[int, tuple[str, str]]]:
    """(text, number of the article it is in or 0, is it links only, elements around it) of each block; stripped parts are
    ("", ...) lines.  With it, the elements that name themselves content, and element and class of all containers."""
    out: list[tuple[str, int, bool, tuple[int, ...]]] = []
    buf: list[str] = []
    stack: list[str] = []
    ids: list[int] = []  # of the stack's elements
    elements = 0
    strip_at = 0  # depth of the stripped element, plus one
    article_at = number = link_at = linked = total = 0
    heading = False
    whole: list[int] = []  # elements that name themselves content
    shapes: dict[int, tuple[str, str]] = {}  # element and class, of containers

    def around() -> tuple[int, ...]:
        n = len(stack)
        while n and (stack[n - 1] not in BLOCKS or stack[n - 1] in SINGLE):
            n -= 1
        return tuple(ids[:n])

    def close() -> None:
        nonlocal linked, total, heading
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text:
                out.append((text, number if article_at else 0, total > 0 and linked >= 0.9 * total and not heading, around()))
            buf.clear()
        linked = total = 0
        heading = False

    def fall(depth: int) -> None:
        """Take elements off the stack, down to a depth."""
        nonlocal strip_at, article_at, link_at
        while len(stack) > depth:
            stack.pop(), ids.pop()
            if strip_at > len(stack):
                strip_at = 0
            if link_at > len(stack):
                link_at = 0
            if article_at > len(stack):
                close()
                article_at = 0
                gap()

    def gap() -> None:
        close()
        if not article_at:
            out.extend([("", 0, False, ())] * WINDOW)

    at = 0
    for start, end, name, is_end, attrs in Tags(page):
        if not strip_at and start > at:
            piece = page[at:start]
            buf.append(piece)
            size = len(piece.strip())
            total += size
            linked += size if link_at else 0
            heading |= bool(size) and any(n in HEADINGS for n in stack[-4:])
        at = end
        if not name:
            continue
        if is_end:
            if name in BLOCKS and not strip_at:
                close()
            if name in stack:
                fall(len(stack) - 1 - stack[::-1].index(name))
            if name in BLOCKS and not strip_at:
                close()
            continue
        if name == "br":
            if not strip_at:
                buf.append(" ")
            continue
        if name in VOID:
            if name == "hr" and not strip_at:
                close()
            continue
        if name in BLOCKS:
            if not strip_at:
                close()
            depth = len(stack)
            while depth and stack[depth - 1] not in BLOCKS:
                depth -= 1
            if depth and stack[depth - 1] == "p":  # a block ends an open paragraph, and what is open in it
                fall(depth - 1)
            if name in ("li", "option", "td", "th", "tr", "dd", "dt") and stack and stack[-1] == name:
                fall(len(stack) - 1)
        elif name == "a":
            if "a" in stack[-8:]:  # anchors are not nested
                fall(len(stack) - 1 - stack[::-1].index("a"))
        if attrs.endswith("/") and name not in BLOCKS or len(stack) >= DEEPEST:
            continue
        elements += 1
        if not strip_at and name in ("article", "main") and not article_at and not _strips(name, attrs, False):
            gap()
            number += 1
            stack.append(name), ids.append(elements)
            article_at = len(stack)
            continue
        stack.append(name), ids.append(elements)
        if name == "a" and not strip_at and not link_at and any(m[1].lower() == "href" for m in _ATTR.finditer(attrs)):
            link_at = len(stack)
        if name in BLOCKS and name not in SINGLE:
            named = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)} if attrs else {}
            shapes[elements] = (name, named.get("class", ""))
            if {*named.get("class", "").lower().split(), *named.get("id", "").lower().split()} & WHOLE:
                whole.append(elements)
        if not strip_at and _strips(name, attrs, bool(article_at)):
            gap()
            strip_at = len(stack)
    if not strip_at and at < len(page):
        buf.append(page[at:])
    close()
    return out, frozenset(whole), shapes


def stretches(sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, peak): lines surge..dive-1 over which the sliding sums stay above zero, and their greatest sum."""
    out, surge, peak = [], None, 0
    n = len(sizes)
    for i in range(n + 1):
        total = sum(sizes[i : i + window])
        if i < n and sizes[i] and surge is None:
            surge, peak = i, 0
        if surge is not None:
            peak = max(peak, total)
            if not total:
                out.append((surge, i, peak))
                surge = None
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, whole, shapes = lines_of(page)
    sizes = [0 if only_links else len(text) for text, _, only_links, _ in lines]
    found = stretches(sizes)
    marked = "\n".join(t for t, art, _, _ in lines if t and art)
    if not found:
        return marked
    best = max(found, key=lambda s: (sum(sizes[s[0] : s[1]]), -s[0]))
    weight = [0, 0]
    for i in range(best[0], best[1]):
        weight[lines[i][1] > 0] += sizes[i]
    if weight[1] > weight[0]:
        return marked
    paths = [lines[i][3] for i in range(best[0], best[1]) if sizes[i]]
    main = os.path.commonprefix(paths)
    named = next((i for i, e in enumerate(main) if e in whole), None)
    main = main if named is None else main[: named + 1]

    def inside(i: int) -> bool:
        path = lines[i][3]
        if path[: len(main)] == main:
            return True
        alike = len(main) > 1 and len(path) >= len(main) and path[: len(main) - 1] == main[:-1]
        return alike and named is None and not lines[i][2] and shapes.get(path[len(main) - 1]) == shapes.get(main[-1])

    kept = [s for s in found if s[2] >= NEAR * best[2] or any(sizes[i] and inside(i) for i in range(s[0], s[1]))]
    return "\n".join(lines[i][0] for i in range(kept[0][0], kept[-1][1]) if sizes[i] or lines[i][0] and inside(i))


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per row: keys, text, n_chars."""
    kept = pages.select(*keys, html_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keys))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"]
            )

    return arrow_map(kept, run, f"{fields}, text string, n_chars bigint")
