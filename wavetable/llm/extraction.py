"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block of the page in its order; a line is as long as its text. Lines of parts that are not text of
the page (menus, headers, footers, sidebars, adverts, notices, forms, reader comments: by element, role, class or id) have no length.
Where the page marks its article, only lines of it have a length; elsewhere linked words add none. Lengths are summed over sliding
windows of ``window`` lines. The sum surges where it first reaches ``surge`` (one character in a marked article) with text in the
window behind, and dives where it falls to zero; the lines between are the text. If no window of an unmarked page reaches
``surge``, the stretch with the largest sum is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .packing import slices

WINDOW, SURGE = 3, 80

# fixed values: names of the HTML standard
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong "
             "sub sup time tt u var label button select svg object audio video canvas map datalist noscript template input".split())
RAW = set("script style xmp iframe noembed noframes title textarea".split())
GONE = set("nav aside footer noscript template svg select button option optgroup datalist dialog object audio video canvas map menu fieldset "
           "legend label input frameset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
# fixed values: words of class and id that name parts beside the text
PARTS = set("ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion banner sidebar sidenav nav "
            "navbar navigation menu submenu topnav breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notification "
            "alert newsletter subscribe subscription signup login share sharing social popup modal overlay search widget pagination pager toolbar "
            "skip related recommended recommendations paywall".split())
TALK = set("comment comments commentlist disqus replies respond discussion feedback guestbook".split())
BODY = set("articlebody article-body article-content article-text post-content post-body entry-content entry-body story-body story-content "
           "main-content page-content maincontent".split())
FRAME = {"html", "body", "main"}

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_RIGHTS = re.compile(r"^(©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SEEN: dict = {}


def _kind(name: str, attributes: str) -> tuple[str, bool]:
    """('' text, 'gone', 'part', 'talk' or 'header'; whether the element marks the article's text)."""
    key = (name, attributes)
    known = _SEEN.get(key)
    if known is None:
        if len(_SEEN) > 20_000:
            _SEEN.clear()
        known = _SEEN[key] = _judge(name, attributes)
    return known


def _judge(name: str, attributes: str) -> tuple[str, bool]:
    given = {}
    for k, v in _ATTRIBUTE.findall(attributes):
        given.setdefault(k.lower(), unescape(v.strip("\"'")))
    style = given.get("style", "").replace(" ", "").lower()
    if name in GONE or "hidden" in given or "display:none" in style or given.get("aria-hidden", "").lower() == "true":
        return "gone", False
    if name in FRAME:
        return "", False
    role = given.get("role", "").lower()
    whole = [w.lower() for w in (given.get("class", "") + " " + given.get("id", "")).split()]
    words = {w.lower() for w in _WORD.findall(given.get("class", "") + " " + given.get("id", ""))} | set(whole)
    if name == "article":
        return ("talk" if words & {"comment", "reply"} else "part" if words & {"ad", "advert", "sponsored", "promo", "teaser", "related"} else ""), False
    if words & TALK:
        return "talk", False
    marked = given.get("itemprop", "").lower() == "articlebody" or role == "main" or bool(BODY & set(whole))
    if marked:
        return "", True
    if name == "header":
        return "header", False
    if role in ROLES or name == "form" or words & PARTS:
        return "part", False
    if "header" in words and not words & {"article", "entry", "post", "story", "content"}:
        return "part", False
    return "", False


class _Page:
    """The lines of a page: text, linked characters, parts they lie in, scope, heading."""

    def __init__(self, html: str):
        self.lines: list[tuple] = []
        self.stack: list[list] = []          # [name, part id, scope id, gone, mute, link]
        self.open: dict[str, int] = {}
        self.parts: tuple = ()               # ids of parts open now
        self.held: set = set()               # ids of parts that hold the article after all
        self.titled: set = set()             # ids of parts that hold a first heading
        self.kinds: dict[int, str] = {}
        self.scopes: list[tuple] = []        # (article, main or body, parts around)
        self.scope: tuple = ()
        self.gone = self.mute = self.links = 0
        self.pieces: list[str] = []
        self.linked = self.breaks = 0
        self.heading = False
        self._read(html)
        self._flush()
        self._hold()

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append((text, min(self.linked, len(text)), self.parts, self.scope, self.gone > 0, self.heading))
            self.pieces = []
        self.linked = self.breaks = 0

    def _text(self, raw: str) -> None:
        if raw and not self.mute:
            raw = unescape(raw)
            if raw.strip():
                self.breaks = 0
            self.pieces.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def _pop(self, i: int) -> None:
        """Close the element at place ``i`` and all within it."""
        self._flush()
        for entry in reversed(self.stack[i:]):
            self._left(*entry)
        del self.stack[i:]

    def _left(self, name: str, part: int | None, scope: int | None, gone: int, mute: int, link: int) -> None:
        self.open[name] -= 1
        self.gone -= gone
        self.mute -= mute
        self.links -= link
        if part is not None:
            self.parts = self.parts[:-1]
        if scope is not None:
            self.scope = self.scope[:-1]
        if name in ("h1", "h2"):
            self.heading = False

    def _last(self, *names: str) -> int | None:
        if not any(self.open.get(n) for n in names):
            return None
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in names)

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self._flush()
            else:
                self.pieces.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        kind, marked = _kind(name, attributes)
        if name not in INLINE:
            self._flush()
            at = self._last("p")
            if at is not None and not any(e[3] or e[4] or e[0] in ("td", "th", "table") for e in self.stack[at:]):
                self._pop(at)
            for group in (("li",), ("dt", "dd"), ("td", "th"), ("tr",)):
                if name in group:
                    at, edge = self._last(*group), self._last("ul", "ol", "dl", "table")
                    if at is not None and (edge is None or edge < at):
                        self._pop(at)
        if name in ("main", "article") and kind == "":
            at = self._last("nav", "header")      # a menu or header left open ends where the article begins
            if at is not None and not self.scope:
                self._pop(at)
        if name == "h1" and kind == "":
            self.titled.update(self.parts)
        if kind == "header":
            kind = "" if self.scope else "part"   # the head of an article belongs to it
        part = scope = None
        if name in INLINE and kind:
            kind = "mute"                         # within a line only its own words go
        if kind in ("part", "talk"):
            part = len(self.kinds)
            self.kinds[part] = "form" if name == "form" else kind
            self.parts += (part,)
        if kind == "" and (name in ("article", "main") or marked):
            scope = len(self.scopes)
            self.scopes.append(("body" if marked else name, self.parts))
            self.scope += (scope,)
        entry = [name, part, scope, int(kind == "gone"), int(kind == "mute"), int(name == "a")]
        self.gone += entry[3]
        self.mute += entry[4]
        self.links += entry[5]
        self.open[name] = self.open.get(name, 0) + 1
        self.heading = self.heading or name in ("h1", "h2")
        self.stack.append(entry)

    def _hold(self) -> None:
        """Parts that turn out to be wrappers: a form around the article, or another part if no article lies outside of parts."""
        own = [parts for name, parts in self.scopes if name != "body"] or [parts for _, parts in self.scopes]
        free = [parts for parts in own if all(self.kinds[p] == "form" for p in parts)]
        for parts in free or [x for x in own if not any(self.kinds[p] == "talk" for p in x)]:
            self.held.update(parts)
        if not own and self.titled:
            size = dict.fromkeys(self.titled, 0)
            whole = 0
            for text, linked, parts, _, gone, _ in self.lines:
                if not gone:
                    whole += len(text) - linked
                    for p in size.keys() & set(parts):
                        size[p] += len(text) - linked
            self.held.update(p for p, n in size.items() if 2 * n >= whole and self.kinds[p] != "talk")

    def _end(self, name: str) -> None:
        if name in ("br", "p") and not self.open.get(name):
            self._flush()
            return
        at = self._last(name)
        if at is None:
            return
        if name in INLINE:
            if len(self.stack) - at > 1 and any(e[0] not in INLINE for e in self.stack[at + 1:]):
                self._left(*self.stack.pop(at))      # closed out of order: its own effect ends, blocks within stay open
                return
            for entry in reversed(self.stack[at:]):
                self._left(*entry)
            del self.stack[at:]
            return
        self._pop(at)

    def _read(self, html: str) -> None:
        at, n, broken = 0, len(html), False
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            self._text(html[at:lt])
            after = html[lt + 1:lt + 2]
            if after == "!" or after == "?":
                if html.startswith("<!--", lt):
                    if html.startswith((">", "->"), lt + 4):
                        at = html.find(">", lt) + 1
                        continue
                    end = html.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            found = None if broken else _OPEN.match(html, lt)
            if found:
                closing, name, attributes = found[1], found[2].lower(), found[3]
                at = found.end()
            else:
                bare = _BARE.match(html, lt)
                if not bare:
                    if after == "/":                       # </ that names nothing
                        end = html.find(">", lt)
                        at = n if end < 0 else end + 1
                    else:
                        self._text("<")
                        at = lt + 1
                    continue
                broken = True                              # a quote is never closed: from here on a tag ends at the next >
                end = html.find(">", lt)
                if end < 0:
                    return
                closing, name, attributes, at = bare[1], bare[2].lower(), html[bare.end():end], end + 1
            if closing:
                self._end(name)
            elif name in RAW:
                end = _CLOSE[name].search(html, at)
                if end:
                    close = html.find(">", end.start())
                    at = n if close < 0 else close + 1
                elif name in ("script", "style"):
                    return
            else:
                self._start(name, attributes)


def lines(html: str) -> tuple[list[str], np.ndarray, np.ndarray, bool]:
    """(texts, lengths that count, lines that may be kept, whether the page marks its article)."""
    page = _Page(html)
    keep = [not gone and not any(p not in page.held for p in parts) for _, _, parts, _, gone, _ in page.lines]
    chosen = _scopes(page, keep)
    length = np.zeros(len(page.lines), np.int64)
    for i, (text, linked, _, scope, _, _) in enumerate(page.lines):
        if not keep[i]:
            continue
        if chosen is not None:
            keep[i] = any(s in chosen for s in scope)
            length[i] = len(text) * keep[i]
        elif 2 * linked <= len(text) and not _RIGHTS.search(text):
            length[i] = len(text) - linked
    if chosen is not None:
        # a headline right before the article, outside of it
        inside = np.flatnonzero(length)
        if len(inside):
            i = int(inside[0]) - 1
            while i >= 0 and page.lines[i][5] and not page.lines[i][4] and not any(p not in page.held for p in page.lines[i][2]):
                keep[i], length[i] = True, len(page.lines[i][0])
                i -= 1
    return [x[0] for x in page.lines], length, np.array(keep, bool), chosen is not None


def _scopes(page: _Page, keep: list[bool]) -> set | None:
    """Ids of the elements that hold the text: articles, else main, else a block named as the text; None if nothing is marked."""
    size: dict[int, int] = dict.fromkeys(range(len(page.scopes)), 0)
    reach = set()
    for (text, linked, parts, scope, _, _), ok in zip(page.lines, keep):
        if ok:
            for s in scope:
                size[s] += len(text) - linked
                reach.add(s)
    for name in ("article", "main", "body"):
        own = [s for s in size if page.scopes[s][0] == name]
        if not own:
            continue
        good = [s for s in own if s in reach]
        if not good:
            if name == "article" and any(x[0] != "article" for x in page.scopes):
                continue
            return set(own)
        top = max(size[s] for s in good)
        # of several articles the longest, and what is not small beside it
        return {s for s in good if size[s] == top or (size[s] >= SURGE and 4 * size[s] >= top)}
    return None


def stretches(length: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge and the dive behind it."""
    n = len(length)
    if not n or not length.any():
        return []
    total = np.concatenate([[0], np.cumsum(length), np.full(window, length.sum())])
    sums = total[window:window + n] - total[:n]
    dives = np.flatnonzero(sums == 0)
    out, at = [], 0
    while at < n:
        up = np.flatnonzero(sums[at:] >= surge)
        if not len(up):
            break
        begin = at + int(up[0])
        # lines without length before the first text of the window are not part of it
        while length[begin] == 0:
            begin += 1
        later = np.searchsorted(dives, begin)
        end = int(dives[later]) if later < len(dives) else n
        out.append((begin, end))
        at = end
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str, int, int]:
    """(text, blocks of the page, blocks kept)."""
    if not html:
        return "", 0, 0
    texts, length, keep, marked = lines(html)
    found = stretches(length, window, 1 if marked else surge)
    if not found and not marked:
        some = stretches(length, window, 1)
        found = [max(some, key=lambda s: int(length[s[0]:s[1]].sum()))] if some else []
    kept = []
    for a, b in found:
        last = a + int(np.flatnonzero(length[a:b])[-1])
        kept += [texts[i] for i in range(a, last + 1) if keep[i]]
    return "\n".join(kept), len(texts), len(kept)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept: one row per page.

    Character references are decoded, white space within a block is one space, blocks are joined by a line feed. A null or empty page, one
    without text and one whose article is empty have an empty text. ``<br>`` is white space, two in a row begin a new block. Pages
    of any length are read whole, in time that grows with their length. Ids and addresses are only carried: nulls and repeats are rows
    of their own. An empty table gives no rows. Other columns are ignored.
    """
    ship_package(pages.sparkSession)
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    types = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = [main_text(h, window, surge) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return source.mapInArrow(work, f"page_id {types[0]}, url {types[1]}, text string, n_chars long, n_blocks int, n_kept int")
