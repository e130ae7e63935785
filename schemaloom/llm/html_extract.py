"""HTML extraction with nearest-URL page differencing.

Every page is read into lines (one per block). Pages of a host are ordered by URL path; a page's partner is the neighbour
with the longest common path. The lines of both outside article and main elements are aligned by longest common
subsequence, and the shared ones, which belong to the site and not to the page, are deleted. Two things decide beside
that: what is left of elements that are never article text (navigation, footers, forms, asides, notices, adverts,
comments; by element or by class, id or role) goes too, and lines inside an article or main element are kept, so that a
mirrored article isn't taken for site furniture.

Neighbours with the same lines throughout (repeated rows, mirrors) tell nothing about the site: runs of them count as one
page, and the partner is the nearest page that differs.

Only hashes of lines travel to the neighbour search. It sorts by (host, path, page_id) in ranges and looks one run back
and ahead inside each range; the two outer runs of both ends of each range, four rows whatever the input, are joined up
afterwards. So a host with a third of all pages is spread over many tasks. Pages then get their partner's hashes by a
hash of the row.

Null html gives an empty text and a page without lines is '' too. Rows with a null url have no partner; a null page_id is
kept. Pages of one path are ordered by page_id, then by content; rows that are equal in all three columns get equal
results, and every row gives one row. Whole pages are read, whatever their length, in time that grows with it (the
alignment: with the product of the lines that both pages have in different places; its memory with their sum). An empty
table gives none. Other columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from schemaloom.llm.common import materialise, table

# Elements whose content is never text, or never article text, and elements that end a line.
RAW = "script style template noscript svg math iframe object canvas textarea title".split()
FURNITURE = "nav header footer aside form button select dialog menu".split()
BLOCKS = """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul""".split()
# Classes, ids and roles that mark furniture; in compounds the last part counts (site-footer), or the first
# beside one of PARTS (comment-list), unless the compound begins with one of ABOUT (has-sidebar).
MARKS = """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer
header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar
social sponsor sponsored subscribe toolbar widget complementary contentinfo search""".split()
PARTS = "area bar block box button buttons column container form icons item items links list panel section signup slot thread unit wrapper".split()
ABOUT = "has no with without is not".split()

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW, _FURNITURE, _BLOCKS, _MARKS, _PARTS, _ABOUT = map(frozenset, (RAW, FURNITURE, BLOCKS, MARKS, PARTS, ABOUT))
_MARKUP = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)|(?P<comment>!--)|[!?])")
_TAG_END = re.compile(r"(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
# An open element of these ends where the next one begins, unless one of the others lies between.
_IMPLIED = frozenset("p li tr td th dt dd option".split())
_BARRIERS = frozenset("div ul ol table dl section article main aside nav td".split())


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the markup in order; comments, declarations and what elements like
    script hold are one piece without a name, or named title. Linear in the text: a tag that never ends is text, and once
    quotes in a tag don't close, quotes count no more."""
    at, last, quotes = 0, html.rfind(">"), True
    while (m := _MARKUP.search(html, at)) and (m.start() < last or m["comment"]):
        if m["comment"]:
            end = html.find("-->", m.start() + 2)
            at = end + 3 if end >= 0 else len(html)
            yield m.start(), at, "", False, ""
            continue
        if not m["name"]:
            at = html.find(">", m.end()) + 1
            yield m.start(), at, "", False, ""
            continue
        end = _TAG_END.match(html, m.end()) if quotes else None
        if end is None:
            quotes = False
            at = html.find(">", m.end()) + 1
            if not at:
                return
        else:
            at = end.end()
        name, rest = m["name"].lower(), html[m.end() : at - 1]
        if name in _RAW and not m["close"] and not (rest.endswith("/") and name in ("svg", "math")):
            close = _RAW_END[name].search(html, at)
            at = close.end() if close else len(html)
            yield m.start(), at, "title" if name == "title" else "", False, ""
        else:
            yield m.start(), at, name, bool(m["close"]), rest


def _is_mark(word: str) -> bool:
    if word in _MARKS:
        return True
    parts = re.split(r"[-_]+", word)
    return len(parts) > 1 and parts[0] not in _ABOUT and (parts[-1] in _MARKS or (parts[0] in _MARKS and parts[-1] in _PARTS))


def _marked(rest: str) -> bool:
    """A class, id or role marks furniture, or the element is hidden."""
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name in ("class", "id", "role") and any(map(_is_mark, value.split())):
            return True
    return False


class _Open:
    """The open elements: what a tag opens or closes, with the elements that end by it."""

    def __init__(self):
        self.stack: list[tuple] = []
        self.count: Counter = Counter()

    def push(self, name, *what):
        self.stack.append((name, *what))
        self.count[name] += 1

    def close(self, name: str, implied: bool = False) -> list[tuple]:
        if not self.count[name]:
            return []
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                gone = self.stack[k:]
                del self.stack[k:]
                self.count.subtract(x[0] for x in gone)
                return gone
            if implied and self.stack[k][0] in _BARRIERS:
                return []
        return []


def _elements(found: list[tuple]) -> Iterator[tuple[int, list[tuple], bool]]:
    """(place in ``found``, elements that end there, whether one opens), with those elements as (name, place)."""
    tree = _Open()
    for k, (_, _, name, closing, rest) in enumerate(found):
        if closing:
            yield k, tree.close(name), False
        elif name and name not in _VOID and name != "title" and not (rest.endswith("/") and name not in _BLOCKS):
            ended = tree.close(name, implied=True) if name in _IMPLIED else []
            tree.push(name, k)
            yield k, ended, True
        else:
            yield k, [], False


def lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main element, furniture) of the page's blocks in order."""
    found = list(tags(html))
    events = list(_elements(found))
    by_name = lambda name: name in _FURNITURE and name != "form"
    marks = {k: name == "form" or _marked(rest) for k, (_, _, name, closing, rest) in enumerate(found) if name and not closing and name not in ("html", "body", "article", "main") and (rest or name == "form")}
    # Marks around all articles of a page (a form or a "sidebar" around everything) say nothing.
    free, around, inside, hidden, open_marks = False, set(), 0, 0, []
    for k, ended, opens in events:
        for name, at in ended:
            inside -= bool(marks.get(at))
            hidden -= by_name(name)
            if marks.get(at):
                open_marks.pop()
        if opens:
            name = found[k][2]
            if name in ("article", "main") and not hidden:
                free |= not inside
                around.update(open_marks[-1:])
            inside += bool(marks.get(k))
            hidden += by_name(name)
            if marks.get(k):
                open_marks.append(k)
    if not free and around:
        marks = _without_ancestors(events, marks, around)

    out: list[tuple[str, bool, bool]] = []
    parts: tuple[list[str], list[str]] = ([], [])  # text of the block; furniture within it
    dropped = main = at = 0
    weight: dict[int, tuple[int, int]] = {}

    def flush():
        for furniture, part in enumerate(parts):
            text = " ".join(unescape("".join(part)).split())
            if text:
                out.append((text, main > 0 and not furniture, bool(furniture)))
            part.clear()

    for k, ended, opens in events:
        start, end, name, _, _ = found[k]
        if start > at:
            parts[dropped > 0].append(html[at:start])
        at = end
        if name == "br":
            parts[dropped > 0].append(" ")
        if name in _BLOCKS or name == "title":
            flush()
        for _, j in ended:
            f, a = weight.pop(j)
            dropped, main = dropped - f, main - a
        if opens:
            weight[k] = (int(bool(marks.get(k)) or (by_name(name) and not (name == "header" and main))), int(name in ("article", "main")))
            dropped, main = dropped + weight[k][0], main + weight[k][1]
    if at < len(html):
        parts[dropped > 0].append(html[at:])
    flush()
    return out


def _without_ancestors(events, marks: dict[int, bool], innermost: set[int]) -> dict[int, bool]:
    """``marks`` without those of ``innermost`` and of the marked elements around them."""
    gone, stack = set(), []
    for k, ended, opens in events:
        for _, at in ended:
            if stack and stack[-1] == at:
                stack.pop()
        if opens and marks.get(k):
            stack.append(k)
            if k in innermost:
                for x in reversed(stack):
                    if x in gone:
                        break
                    gone.add(x)
    return {k: m and k not in gone for k, m in marks.items()}


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each beginning of y: the zeros of a bit vector over y."""
    n, places, common = len(y), {}, {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    full = bits = (1 << n) - 1
    for v in x.tolist():
        mask = common.get(v)
        if mask is None:
            mask = 0
            for j in places.get(v, ()):
                mask |= 1 << j
            if len(places.get(v, ())) > 8:
                common[v] = mask
        hit = bits & mask
        bits = ((bits + hit) | (bits - hit)) & full
    ones = np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(1 - ones.astype(np.int64))]


def _lcs(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence. Halves x until the table is small, so memory is linear."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > 1 << 20:
        half = len(x) // 2
        k = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
        return _lcs(x[:half], y[:k]) + [half + i for i in _lcs(x[half:], y[k:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        step = np.maximum(best[i + 1, :-1], np.where(y == x[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    found, j = [], 0
    for i in range(len(x)):
        if j < len(y) and best[i, j] != best[i + 1, j]:
            j += int(np.argmax(y[j:] == x[i])) + 1
            found.append(i)
    return found


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Boolean per element of a: in the longest common subsequence of a and b. Common ends are matched first."""
    n, m = len(a), len(b)
    keep = np.zeros(n, bool)
    k = min(n, m)
    head = int(np.argmin(np.r_[a[:k] == b[:k], False]))
    tail = int(np.argmin(np.r_[a[n - k + head :][::-1] == b[m - k + head :][::-1], False]))
    keep[:head], keep[n - tail :] = True, True
    x, y = a[head : n - tail], b[head : m - tail]
    x, at = x[np.isin(x, y)], head + np.flatnonzero(np.isin(x, y))
    keep[at[_lcs(x, y[np.isin(y, x)])]] = True
    return keep


def _hashes(found) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x[0]) for x in found], np.uint64).view(np.int64)


_HOST, _PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def neighbours(pages: DataFrame) -> DataFrame:
    """pages(row, page_id, url, html) -> (row, prev, next): structs of path and line hashes of the nearest different pages
    before and after by (host, path)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lines(h or "") for h in b.column(2).to_pylist()]
            digests = [xxhash.xxh3_64_intdigest(_hashes(f).tobytes()) - (1 << 63) for f in found]
            outside = [_hashes(x for x in f if not x[1]) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), pa.array(digests, pa.int64()), pa.array(outside, pa.list_(pa.int64()))], names=["row", "page_id", "host", "path", "digest", "lines"])

    kind = pages.schema["page_id"].dataType.simpleString()
    light = pages.where("url is not null").select("row", "page_id", "html", F.lower(F.regexp_extract("url", _HOST, 1)).alias("host"), F.regexp_extract("url", _PATH, 1).alias("path"))
    light = materialise(light.mapInArrow(read, f"row long, page_id {kind}, host string, path string, digest long, lines array<long>"))
    order = ["host", "path", "page_id", "digest"]
    ranged = light.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order)
    new = F.coalesce((F.lag("digest").over(inside) != F.col("digest")) | (F.lag("host").over(inside) != F.col("host")), F.lit(True))
    ranged = ranged.withColumn("new", new.cast("long"))
    ranged = materialise(ranged.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    # Rows of a run have equal lines; its first stands for it.
    runs = ranged.where("new = 1").select("part", "run", "digest", F.struct("host", "path", "lines").alias("page"))
    beside = Window.partitionBy("part").orderBy("run")
    runs = runs.withColumn("prev", F.lag("page").over(beside)).withColumn("next", F.lead("page").over(beside))
    runs = materialise(runs.withColumn("last", F.max("run").over(Window.partitionBy("part"))))
    # The outer two runs of both ends of every range, in order; neighbours with equal lines are one run again.
    ends = runs.where("run <= 2 or run >= last - 1").select("part", "run", "digest", "page")
    over = Window.orderBy("part", "run")
    fresh = F.coalesce((F.lag("digest").over(over) != F.col("digest")) | (F.lag("page.host").over(over) != F.col("page.host")), F.lit(True))
    ends = ends.withColumn("new", fresh.cast("long")).withColumn("id", F.sum("new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    once = ends.where("new = 1").select("id", F.lag("page").over(Window.orderBy("id")).alias("before"), F.lead("page").over(Window.orderBy("id")).alias("after"))
    ends = ends.join(once, "id").select("part", "run", "before", "after")
    met = runs.join(ends, ["part", "run"], "left").select("part", "run", "page.host", *[F.when((F.col("run") == F.when(F.lit(first), F.lit(1)).otherwise(F.col("last"))), F.col(far)).otherwise(F.col(near)).alias(near) for near, far, first in (("prev", "before", True), ("next", "after", False))])
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.struct(F.col(f"{c}.path").alias("path"), F.col(f"{c}.lines").alias("lines"))).alias(c)
    met = met.select("part", "run", same("prev"), same("next"))
    return ranged.select("part", "run", "row").join(met, ["part", "run"]).groupBy("row").agg(F.min(F.struct("prev", "next")).alias("x")).select("row", "x.prev", "x.next")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_furniture) for every row; n_shared: lines deleted because the partner has
    them, n_furniture: others deleted by element, class, id or role."""
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html")
    near = neighbours(rows).withColumnRenamed("row", "near_row")
    joined = rows.join(near, F.col("row") == F.col("near_row"), "left").select("page_id", "url", "html", "prev", "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, gone, other = [], [], []
            for url, html, *beside in zip(*(c.to_pylist() for c in b.columns[1:])):
                found = lines(html or "")
                m = re.match(_PATH, url or "")
                partner = max((x for x in beside if x is not None), key=lambda x: _common(m[1] if m else "", x["path"]), default=None)
                outside = [k for k, x in enumerate(found) if not x[1]]
                drop = set()
                if partner and outside:
                    hit = shared(_hashes([found[k] for k in outside]), np.array(partner["lines"], np.int64))
                    drop = {outside[k] for k in np.flatnonzero(hit)}
                furniture = {k for k, x in enumerate(found) if x[2]} - drop
                texts.append("\n".join(x[0] for k, x in enumerate(found) if k not in drop and k not in furniture))
                gone.append(len(drop))
                other.append(len(furniture))
            n = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (n, gone, other))], names=["page_id", "url", "text", "n_chars", "n_shared", "n_furniture"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_shared long, n_furniture long")


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
