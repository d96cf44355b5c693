"""Main text of web pages: nearest-URL page differencing, and structure for what it leaves."""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_UNTIL = re.compile(r"[>\"']")
#: How many open inline elements an end tag looks through for its own.
_DEPTH = 64
#: Attributes one after the other, so that words inside a value are none.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?|"[^"]*"|'[^']*'""")

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template iframe object svg canvas textarea select".split())
#: Elements that never hold the article's own text.
_APART = frozenset("head nav header footer aside form menu dialog button".split())
#: Elements within a line of text; all others end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark menus, adverts, notices, forms and reader comments.
_MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marked(rest: str) -> str:
    """What a tag's attributes say: "hidden", "marked" (a class, id or role all of whose words are marks) or nothing."""
    out, seen = "", set()
    for m in _ATTRIBUTE.finditer(rest):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name in seen:
            continue  # of repeated attributes the first counts
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return "hidden"
        if name in ("class", "id", "role") and any(_is_mark(t) for t in value.split()):
            out = "marked"
    return out


def _is_mark(token: str) -> bool:
    words = _WORDS.findall(token)
    return token.lower() in _MARKS or bool(words) and all(w.lower() in _MARKS for w in words)


class _Tags:
    """The tags of a page, one after the other, in time linear in its length whatever it holds."""

    def __init__(self, page: str):
        self.page, self.quotes, self.torn = page, {q: page.rfind(q) for q in "\"'"}, 0

    def _close(self, at: int) -> int:
        """The place of the > that ends a tag, past quoted values; -1 if there is none. A quote that nothing closes is a character like others, and where quotes swallow the page's end the first > counts; after a few such tags, quotes no longer do."""
        page, first = self.page, self.page.find(">", at)
        if first < 0 or self.torn > 8:
            return first
        while m := _UNTIL.search(page, at):
            at = m.end()
            if m.group() == ">":
                return m.start()
            if m.start() < self.quotes[m.group()]:
                at = page.find(m.group(), at) + 1
        self.torn += 1
        return first

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether an end tag, attributes) of the next tag from a place on; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            m = _NAME.match(page, start + 1)
            if m or page[start + 1 : start + 2] in ("!", "?", "/"):
                end = self._close(m.end()) if m else page.find(">", start)
                if end < 0:
                    return None  # nothing is closed from here on
                return (start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]) if m else (start, end + 1, "", False, "")
            at = start + 1
        return None


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's blocks of text in order, each with its zone: "article" or "main" (inside such an element), "apart" (menus and the like) or "open" (nothing says).

    An article or main element in a marked wrapper (or a form) counts if none stands outside of such wrappers; what is hidden never does. Character references are decoded, white space inside a block is one space. Unclosed elements end with the element that holds them; tags that nothing closes are text.
    """
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str, str]] = []  # name, why apart ("marked" can be lifted by an article, "fixed" can't), the article or main around
    count: Counter = Counter()  # of the names on the stack
    tags, at, n = _Tags(page), 0, len(page)

    def flush() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            apart, inside = (stack[-1][1], stack[-1][2]) if stack else ("", "")
            out.append((line, "apart" if apart else inside or "open"))

    def pop() -> str:
        name = stack.pop()[0]
        count[name] -= 1
        return name

    while at < n:
        tag = tags.next(at)
        if not tag:
            text.append(page[at:])
            break
        start, end, name, closes, rest = tag
        text.append(page[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            text.append(" ")
        if closes:
            if name not in _INLINE:
                flush()
                if count[name]:
                    while pop() != name:
                        pass
            elif count[name]:
                for i in range(len(stack) - 1, max(-1, len(stack) - 1 - _DEPTH), -1):
                    if stack[i][0] == name:
                        if stack[i][1] and not (i and stack[i - 1][1]):
                            flush()
                        del stack[i]
                        count[name] -= 1
                        break
                    if stack[i][0] not in _INLINE:
                        break
            continue
        if name in _RAW or name == "title":
            ended = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name not in _INLINE:
                flush()
            at = ended.end() if ended else n
            continue
        apart, inside = (stack[-1][1], stack[-1][2]) if stack else ("", "")
        said = _marked(rest)
        own = name in _APART or bool(said)
        if name not in _INLINE or own:
            flush()
        if name in ("p", "li") and stack and stack[-1][0] == name:
            pop()
        if name not in _VOID and not rest.rstrip().endswith("/"):
            if name in ("article", "main") and not own:
                if apart == "marked" and not inside:
                    apart, inside = "", "wrapped " + name
                else:
                    inside = inside if inside in ("main", "wrapped main") else "wrapped " * inside.startswith("wrapped") + name
            if said == "hidden" and name not in ("html", "body") or name in _APART and name != "form":
                apart = "fixed"
            elif own and name not in ("html", "body", "article", "main"):
                apart = apart or "marked"
            stack.append((name, apart, inside))
            count[name] += 1
    flush()
    outside = any(z in ("article", "main") for _, z in out)
    return [(t, ("apart" if outside else z[8:]) if z.startswith("wrapped") else z) for t, z in out]


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of x with each prefix of y, by bits: one addition of long integers for each of x."""
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        if both := row & places.get(v, 0):
            row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little", count=len(y))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matched(x: list[int], y: list[int], at: int, out: set[int]) -> None:
    """Adds the places (from `at`) in x of a longest common subsequence with y: halves of x are matched with the two parts of y that are best for both, so the space is linear."""
    if not x or not y:
        return
    if len(x) == 1:
        if x[0] in y:
            out.add(at)
        return
    half = len(x) // 2
    split = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
    _matched(x[:half], y[:split], at, out)
    _matched(x[half:], y[split:], at + half, out)


def common_lines(a: list, b: list) -> set[int]:
    """Places in a on a longest common subsequence of both lists."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = {*range(low), *range(len(a) - high, len(a))}
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    shared = set(x) & set(y)  # a line on one side only is never on the subsequence
    kept = [i for i, v in enumerate(x) if v in shared]
    found: set[int] = set()
    _matched([x[i] for i in kept], [v for v in y if v in shared], 0, found)
    return out | {low + kept[i] for i in found}


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _place(url: str | None) -> tuple[str, str]:
    """Host and path."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return ((m[1] if m else "").lower(), m[2] if m else url or "")


def _rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of 1000 rows or some 4 MB of the column `weight` at most."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[weight])
        if len(out) >= 1000 or size > 1 << 22:
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out, size = [], 0
    yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


_ORDER = ["host", "path", "page_id", "digest"]
_LINES = pa.schema([("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("digest", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's place and the hashes of its lines."""

    def rows():
        for page, url, html in _rows(batches):
            yield (*_place(url), page, _hash(html or ""), [_hash(t) for t, _ in blocks(html or "")])

    yield from _batches(rows(), _LINES, 4)


_KEY = "struct<host: string, path: string, page_id: bigint, digest: bigint>"
_RUN = "struct<host: string, hashes: array<bigint>>"
_EDGE = pa.schema([("first_key", pa.struct([*_LINES][:4])), ("runs", pa.list_(pa.struct([_LINES.field("host"), _LINES.field("hashes")])))])


def _border_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's first page, and its first and last two runs of pages with equal lines (all, if no more than three), as one row."""
    key, first, last = None, [], []
    for host, path, page, digest, hashes in _rows(batches):
        key = key or {"host": host, "path": path, "page_id": page, "digest": digest}
        run = {"host": host, "hashes": hashes}
        if last and last[-1] == run:
            continue
        if len(first) < 2:
            first.append(run)
        last = [*last[-1:], run] if len(first) == 2 else [run]
    if key is not None:
        runs = first if len(first) < 2 or last == first else [*first, *(last if last[0] != first[1] else last[1:])]
        yield pa.record_batch([pa.array([key], _EDGE.field(0).type), pa.array([runs], _EDGE.field(1).type)], schema=_EDGE)


def _sorts(host: str, path: str, page: int | None, digest: int) -> tuple:
    return host, path, page is not None, page or 0, digest  # as Spark sorts, null first


#: Letters of the zones in which lines are stored.
_ZONES = {"apart": "a", "open": "o", "article": "i", "main": "m"}


def chosen(lines: list[str], zones: str, shared: set[int]) -> tuple[str, int]:
    """The text of a page, and how many of its lines differencing deletes.

    Lines shared with a neighbour are deleted, but for those of an article or main element, as articles may quote the same words. Of what is left, structure takes away the lines of menus and the like, and open lines beside a main element. If no line would be left (copies of a page), all that structure allows stay.
    """
    gone = {i for i in shared if zones[i] in "ao"}
    stays = [i for i, z in enumerate(zones) if z in "im" or z == "o" and "m" not in zones]
    return " ".join(lines[i] for i in ([i for i in stays if i not in gone] or stays)), len(gone)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_shared) of every page; null html is empty.

    All pages are dealt and sorted by host, URL path and page_id, in ranges, so a hot host spreads over tasks. Each is held against the pages next to it on the same host, on each side the nearest whose lines differ: lines on a longest common subsequence with a neighbour are shared furniture and are deleted, n_shared of them. Structure settles what that leaves (see chosen). Neighbours across the borders of ranges are taken from the borders' own pages, so the driver sees up to four pages' line hashes a partition.

    Pages are parsed twice: for the hashes of their lines, which give ranges and borders, and for the lines themselves, which are shuffled once, packed.
    """
    rows = pages.select("page_id", "url", "html")
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cut(rows.mapInArrow(_page_lines, "host string, path string, page_id long, digest long, hashes array<long>"))
    edges = near.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_border_runs, f"first_key {_KEY}, runs array<{_RUN}>").collect()
    edges = sorted(((_sorts(*e.first_key), [(r.host, r.hashes) for r in e.runs]) for e in edges), key=lambda e: e[0])
    bounds, runs = [k for k, _ in edges], [r for _, r in edges]
    # the nearest run that differs; only a partition of one run is looked past
    before = [next((r for other in reversed(runs[:i]) for r in reversed(other) if r != own[0]), None) for i, own in enumerate(runs)]
    after = [next((r for other in islice(runs, i + 1, None) for r in other if r != own[-1]), None) for i, own in enumerate(runs)]
    whole = pa.schema([("part", pa.int32()), *[*_LINES][:4], ("url", pa.string()), ("packed", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            for page, url, html in _rows(batches):
                found = blocks(html or "")
                key = (*_place(url), page, _hash(html or ""))
                lines = "\n".join(["".join(_ZONES[z] for _, z in found), *(t for t, _ in found)])
                yield (max(0, bisect_right(bounds, _sorts(*key)) - 1), *key, url, zlib.compress(lines.encode(errors="surrogatepass"), 1))

        yield from _batches(out(), whole, 6)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(run, held, last, coming):
            done: dict[str, tuple[str, int]] = {}  # equal lines may lie in different zones
            shared: set[int] = set()
            for other in (last, coming):
                if other and other[0] == run[0]:
                    shared |= common_lines(run[1], other[1])
            for page, url, zones, lines in held:
                if zones not in done:
                    done[zones] = chosen(lines, zones, shared)
                yield page, url, *done[zones]

        def out():
            last, run, held, at = None, None, [], -1
            for part, host, _, page, _, url, packed in _rows(batches):
                zones, *lines = zlib.decompress(packed).decode(errors="surrogatepass").split("\n")
                new = host, [_hash(t) for t in lines]
                if part != at:
                    if run:
                        yield from told(run, held, last, after[at])
                    last, run, held, at = before[part], new, [], part
                elif run != new:
                    yield from told(run, held, last, new)
                    last, run, held = run, new, []
                same = held[-1] if held and held[-1][2] == zones else None  # copies share their lines
                held.append((page, url, *(same[2:] if same else (zones, lines))))
            if run:
                yield from told(run, held, last, after[at])

        yield from _batches(out(), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64())]), 2)

    dealt = rows.mapInArrow(pack, "part int, host string, path string, page_id long, digest long, url string, packed binary")
    return dealt.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", *_ORDER).mapInArrow(differ, "page_id long, url string, text string, n_shared long")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = main_texts(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
