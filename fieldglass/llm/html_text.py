"""Main text of web pages by site template removal.

One lenient pass over a page's tags keeps a stack of open elements.  Every
closed container (division, list, section, table, menu, header, footer,
sidebar, form, ...) has a hash of its tag, class and contents.  Spark counts,
for each host, on how many different main texts' pages each hash occurs;
containers that recur are the host's template, and the second pass deletes
them.  The count needed does not grow with the host: a section's menu or a
rare notice is on few of a large host's pages.  Containers inside an article
are content until they are on a share of all the host's main texts' pages too.
Each page is joined to its own template hashes, so no list grows with the host.

Recurrence decides wherever a container is on pages enough.  What it cannot
know, containers of small hosts and those that vary from page to page, is
judged by hints: tags, roles, classes and ids of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments.  A class or id is a hint
if all its words name such things or mere places (``cookie-notice`` and
``top-menu``, not ``ad-hoc`` or ``social-science``).  ``hints=False`` leaves
it all to recurrence.  Scripts and styles are never text.

The main text is that of all top-level articles but comments and teasers, with
the headings of the main element before them; without an article it is that of
the longest main element, else of the body.  A teaser is an article marked so by class or id,
or one whose first heading is a link only; where all are teasers, all stay.
An element around an article or main element is never template.
Of a header inside an article or main element the headings stay.

Blocks (paragraphs, headings, list items, table rows, lines ended by a line
break) are joined by one line feed; white space within one becomes a blank.
Character references are decoded once.  A tag cut off by the page's end is
markup; a cut reference stays as it is.

Defined results: a null or empty page has an empty text; a null address is no
host, and its pages have no template; repeated pages count once; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm._shared import heavy, mapped, split_join, stage

#: A container is template if at least so many of a host's different main
#: texts have it on their pages; inside an article, at least this share of them too.
LEAST_PAGES, LEAST_SHARE = 3, 0.2

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
#: What is left of an element's attributes without these are names.
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDES = re.compile(r"(?:^|[\s=/])hidden(?:[\s=/]|$)", re.I)
#: Elements that a slash ends at once although others of their kind hold raw text.
FOREIGN = frozenset(("svg", "math"))

#: Elements by their role in a page.
RAW = frozenset("script style template iframe svg textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head select option canvas audio video".split())
NEVER = frozenset("nav footer aside form button dialog menu".split())
CONTAINER = frozenset("div ul ol section table dl figure details header article main center fieldset".split()) | NEVER
BLOCK = CONTAINER - {"button"} | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre blockquote address figcaption hr br body html hgroup summary caption".split())
ENDS_P = BLOCK - {"br", "html", "body", "caption"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = frozenset("ul ol dl table div section article main body td th blockquote".split())
#: Words of a class, id or role that mark what is not main text.
AROUND = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar footer footnav masthead banner topbar toolbar "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert disclaimer comment comments commentlist disqus replies respond share sharing social related recommended newsletter subscribe "
    "subscription signup login search searchbox popup modal overlay pagination pager skip widget complementary contentinfo".split()
)
PLACE = frozenset("box bar block wrapper wrap container area section panel inner outer top bottom left right main site page global primary secondary header slot unit zone item content list link links post article entry user reader group row col column small large mini mobile desktop sticky fixed".split())
TEASER = frozenset("teaser teasers card preview".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if "=" in text else {}


def _names(text: str) -> bool:
    """Whether one of the names stands for what is beside the main text."""
    for name in text.lower().split():
        words = _WORD.findall(name)
        if not AROUND.isdisjoint(words) and all(w in AROUND or w in PLACE for w in words):
            return True
    return False


def _aside(tag: str, raw: str) -> tuple[bool, str]:
    """(whether the element is by its looks beside the main text, its class)."""
    if not raw or raw.isspace():
        return tag in NEVER, ""
    a = _attributes(raw)
    cls, names = a.get("class", ""), f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
    out = tag in NEVER or tag not in ("body", "html", "article", "main") and _names(names) or tag == "article" and "comment" in names.lower()
    out = out or bool(_HIDDEN.search(a.get("style", ""))) or a.get("aria-hidden") == "true" or "hidden" in raw.lower() and _HIDES.search(_VALUE.sub("=", raw)) is not None
    return out, cls


#: Elements whose places on the stack matter to elements that end others by themselves.
MARKED = STOP | frozenset(SAME) | frozenset().union(*SAME.values())


class _Frame:
    __slots__ = ("tag", "out", "cls", "at", "parts", "holds", "last", "teaser")

    def __init__(self, tag: str, out: bool, cls: str, at: int):
        self.tag, self.out, self.cls, self.at = tag, out, cls, at
        self.parts: list[str] = []
        self.holds = False
        self.last = ""  # the last element closed in it
        self.teaser: bool | None = None  # of an article, as soon as it is known


def parse(html: str, template: frozenset[int] = frozenset(), hints: bool = True, shortcut: bool = True) -> tuple[str, set[int]]:
    """(main text, hashes of all containers; odd ones are inside an article).

    ``shortcut``: of a page with articles or main elements, these alone.
    """
    blocks: list[str] = []
    line: list[str] = []
    stack = [_Frame("#", False, "", 0)]
    hashes: set[int] = set()
    spans: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
    teasers: set[tuple[int, int]] = set()
    headings: list[tuple[int, int]] = []  # of main elements, outside their articles
    titles: list[tuple[int, int]] = []  # all headings
    inside = 0  # articles and main elements that are open
    articles = 0  # articles that are open
    opened: Counter[str] = Counter()  # open elements by tag
    # places on the stack of open paragraphs, of what bounds them, of marked elements and of articles
    paragraphs: list[int] = []
    bounds: list[int] = []
    marks: list[int] = []
    within: list[int] = []
    skipped: list[int] = []
    out = 0  # elements beside the main text that are open

    def flush() -> None:
        if line:
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                blocks.append(text)

    def cut(at: int, keep: list[str]) -> None:
        """Only ``keep`` is left of the blocks from ``at`` on."""
        blocks[at:] = keep
        for spans_ in (headings, titles):
            while spans_ and spans_[-1][0] >= at:
                spans_.pop()

    def since(spans_: list[tuple[int, int]], at: int) -> list[tuple[int, int]]:
        """The spans from ``at`` on: the last ones."""
        k = len(spans_)
        while k and spans_[k - 1][0] >= at:
            k -= 1
        return spans_[k:]

    def close() -> None:
        nonlocal inside, articles, out
        f = stack.pop()
        tag = f.tag
        opened[tag] -= 1
        for places in (paragraphs, bounds, marks, within):
            if places and places[-1] == len(stack):
                places.pop()
        if tag in BLOCK and not out:
            flush()
        digest = hashlib.blake2b(f"{tag}\0{f.cls}\0{'\0'.join(f.parts)}".encode("utf-8", "replace"), digest_size=8).digest()
        if f.out:
            out -= 1
            line.clear()
        if out or f.out:
            if f.out and f.parts and tag in CONTAINER:
                hashes.add(int.from_bytes(digest, "big", signed=True) & ~1 | (articles > 0))
            if out:
                stack[-1].parts.append(digest.hex())
            return
        stack[-1].parts.append(digest.hex())
        stack[-1].last = tag
        if tag in HEADING and f.at < len(blocks):
            titles.append((f.at, len(blocks)))
        if tag == "header" and inside:
            kept = [b for lo, hi in since(titles, f.at) for b in blocks[lo:hi]]
            if len(kept) < len(blocks) - f.at:
                own = since(headings, f.at)
                cut(f.at, kept)
                titles.extend((f.at + i, f.at + i + 1) for i in range(len(kept)))
                if own:
                    headings.append((f.at, len(blocks)))
        if tag in HEADING and inside:
            if not articles:
                headings.append((f.at, len(blocks)))
            elif f.parts:
                around = stack[within[-1]]
                if around.teaser is None:
                    around.teaser = len(f.parts) == 1 and f.last == "a"
        if tag in spans:
            inside -= 1
            articles -= tag == "article"
            if tag == "main" or not articles:
                spans[tag].append((f.at, len(blocks)))
                if f.teaser:
                    teasers.add(spans[tag][-1])
            f.holds = True
        if f.holds:
            stack[-1].holds = True
        elif tag in CONTAINER and len(blocks) > f.at:
            h = int.from_bytes(digest, "big", signed=True) & ~1 | (articles > 0)
            hashes.add(h)
            if h in template:
                cut(f.at, [])

    def text(piece: str) -> None:
        if piece:
            if not out:
                if "&" in piece:
                    piece = unescape(piece)
                line.append(piece)
            piece = " ".join(piece.split())
            if piece:
                stack[-1].parts.append(piece)

    pos, end = 0, len(html)
    while pos < end:
        m = _TAG.search(html, pos)
        if m is None:
            text(html[pos:])
            break
        text(html[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                flush()
            continue
        raw = m[3] if m[2] else m[6]
        if tag in FOREIGN and raw.endswith("/"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            pos = stop.end() if stop else end
            continue
        if tag == "xmp" or tag == "noscript" and not inside:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if tag == "xmp" and not out:
                flush()
                line.append(html[pos : stop.start() if stop else end])
                flush()
            pos = stop.end() if stop else end
            continue
        if tag in ENDS_P and paragraphs and paragraphs[-1] >= (bounds[-1] if bounds else 0):
            while len(stack) > paragraphs[-1] + 1:
                close()
            close()
        if tag in SAME:
            while marks:
                k = marks[-1]
                if stack[k].tag in SAME[tag]:
                    while len(stack) > k:
                        close()
                    if tag != "tr":
                        break
                elif stack[k].tag in STOP or k < len(stack) - 1 and stack[k].tag == "tr" and tag != "tr":
                    break
                else:
                    skipped.append(marks.pop())
            while skipped:
                if (k := skipped.pop()) < len(stack):  # not closed meanwhile
                    marks.append(k)
        if tag in BLOCK and not out:
            flush()
        elif tag in ("td", "th") and not out:
            line.append(" ")
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            continue
        beside, cls = _aside(tag, raw)
        beside = tag in UNSEEN or hints and (beside or tag == "header" and not inside)
        if beside and not out:
            flush()
        for places, own in ((paragraphs, tag == "p"), (bounds, beside or tag in STOP), (marks, tag in MARKED), (within, tag == "article")):
            if own:
                places.append(len(stack))
        opened[tag] += 1
        stack.append(_Frame(tag, beside, cls, len(blocks)))
        out += beside
        if tag in spans and not out:
            inside += 1
            if tag == "article":
                articles += 1
                if raw and not raw.isspace() and not TEASER.isdisjoint(_WORD.findall(f"{cls} {_attributes(raw).get('id', '')}".lower())):
                    stack[-1].teaser = True
    while len(stack) > 1:
        close()
    flush()
    if spans["article"] and shortcut:
        kept = [x for x in spans["article"] if x not in teasers and x[0] < x[1]] or spans["article"]
        kept = [x for x in headings if x[1] <= kept[0][0] and any(lo <= x[0] and kept[0][1] <= hi for lo, hi in spans["main"])] + kept
        return "\n".join(b for lo, hi in kept for b in blocks[lo:hi]), hashes
    if spans["main"] and shortcut:
        lo, hi = max(spans["main"], key=lambda s: (sum(map(len, blocks[s[0] : s[1]])), -s[0]))
        return "\n".join(blocks[lo:hi]), hashes
    return "\n".join(blocks), hashes


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


def _scan(hints: bool):
    return lambda batches: _scanned(batches, hints)


def _scanned(batches, hints):
    for b in batches:
        hosts, mains, pieces = [], [], []
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            host = host_of(url) if html else None
            main, hashes = parse(html, hints=hints) if host is not None else ("", set())
            hosts.append(host)
            mains.append(int.from_bytes(hashlib.blake2b(main.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True))
            pieces.append(sorted(hashes))
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(hosts, pa.string()), pa.array(mains, pa.int64()), pa.array(pieces, pa.list_(pa.int64()))], ["row", "host", "main", "pieces"])


def _extract(hints: bool):
    return lambda batches: _extracted(batches, hints)


def _extracted(batches, hints):
    for b in batches:
        texts = [parse(html, frozenset(pieces or ()), hints)[0] if html else "" for html, pieces in zip(b.column("html").to_pylist(), b.column("pieces").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, hints: bool = True) -> DataFrame:
    """page_id, url, text for every row."""
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    slim = slim.withColumn("row", F.xxhash64("page_id", "url", "html"))
    seen = stage(mapped(slim.select("row", "url", "html"), _scan(hints), "row long, host string, main long, pieces array<long>"), "containers").where("host is not null")
    single = seen.select("row", "host", "main", F.explode("pieces").alias("piece"))
    pairs = F.struct("host", "piece").alias("k")
    counts = single.groupBy("host", "piece", "main").agg(F.count("*").alias("rows")).groupBy("host", "piece").agg(F.count("*").alias("mains"), F.sum("rows").alias("n")).where(f"mains >= {int(least_pages)}")
    totals = seen.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("all"))
    in_article = F.col("piece").bitwiseAND(F.lit(1)) == 1
    template = counts.join(totals, "host").where(~in_article | (F.col("mains") >= F.col("all") * least_share)).select(pairs, F.lit(True).alias("v"), "n")
    # a page's own template hashes: as long as the page, whatever the host's size
    total = int(seen.agg(F.sum(F.size("pieces"))).first()[0] or 0)
    own = split_join(single.select("row", pairs), template, heavy(total)).where("v").groupBy("row").agg(F.collect_set("k.piece").alias("pieces"))
    return mapped(slim.join(own, "row", "left").select("page_id", "url", "html", "pieces"), _extract(hints), "page_id long, url string, text string")
