"""Main text of web pages by differencing each page with its nearest page.

A page becomes text lines (blocks) with the part of the page each stands in. Pages of a host are ordered by URL path; each
is paired with the nearest page, before or after it, whose lines are not all the same; of the two, with the one whose path
shares the longer beginning. Pages of equal path and lines have one partner. Lines of both are aligned by longest common
subsequence, and shared lines are deleted: all of a page without an article; of an article those that stand in the same kind
of element on both pages (or in a menu or the like on the other), unless they are paragraphs or headings, which quotations
are, too. Where most lines of two articles are shared, the pages are copies of one article, and what they share isn't their
template.

Beyond that, only what the markup says plainly decides: elements that hold navigation, forms or code, landmark roles, hidden
elements, whole class names of adverts, comments and the like, and articles inside articles, which are comments. On pages with
an article, what stands outside it is no main text.

Names that only hint, parts of hyphenated ones (`cookie-banner`, `comment-list`) and words that articles are about as well
(`menu`, `promo`), make an element a suspect, and the host's other pages decide: an element of that name and class that
several of them have belongs to the template and goes; one that no other page of a host with several has is content and stays.
On hosts of one or two pages, which tell nothing, parts of plain names count and the others don't. A suspect never holds an
article, and suspects stay on a page that would have no text without them.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import join_groups, partitions, slices, written

# Elements by their role, and words in class, id and role that name parts other than the main text.
RAW = "script style noscript template svg math textarea select iframe object canvas head title audio video"
BOILER = "nav footer aside form button menu dialog input"
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
)
PARAGRAPHS = "p h1 h2 h3 h4 h5 h6 blockquote pre"
VOID = "area base br col embed hr img input link meta param source track wbr"
NAMES = (
    "ad ads advert adverts advertisement adsense sponsored sidebar nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "comment comments disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe share sharing pagination pager toolbar"
)
HINTS = "promo banner menu related recommended teaser trending widget"
NEGATIONS = "no not has with without is hide show"
ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar"

_RAW, _BOILER, _BLOCKS, _PARAGRAPHS, _VOID, _NAMES, _HINTS, _NEGATIONS, _ROLES = (frozenset(x.split()) for x in (RAW, BOILER, BLOCKS, PARAGRAPHS, VOID, NAMES, HINTS, NEGATIONS, ROLES))
_tag = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>", re.S)
_attribute = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: Parts of a page: outside all others, inside an article, inside menus and so on.
PLAIN, CORE, EDGE = 0, 1, 2
#: Pages of a host from which on it tells about suspects, and pages with one of a name that make it the template's.
TELLING_PAGES, RECURS = 3, 2
#: Bits of memory for one alignment table; larger ones are split in halves.
ALIGN_BITS = 1 << 28


def _named(attributes: str) -> bool:
    """Is the element hidden, or do its role or a whole name of its class, id or property name a part other than the main text?"""
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if not (_ROLES if key == "role" else _NAMES).isdisjoint(value.split()) and key != "aria-hidden":
            return True
    return False


def _suspect(name: str, attributes: str) -> int:
    """0 for elements whose names hint at nothing; else a number for the element with its names, odd if a part is a plain name."""
    parts, value = set(), ""
    for m in _attribute.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            value += f" {m[2] or m[3] or m[4] or ''}"
    for token in value.lower().split():
        of = re.split(r"[-_]+", token)
        if of[0] not in _NEGATIONS:
            parts.update(of)
    if parts.isdisjoint(_NAMES) and parts.isdisjoint(_HINTS):
        return 0
    return (zlib.crc32(f"{name}{value}".encode("utf-8", "surrogatepass")) << 1 | (not parts.isdisjoint(_NAMES))) + 2


def _kind(name: str, attributes: str) -> int:
    """1 .. 255: stands for an element with its class."""
    of = [m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes) if m[1].lower() == "class"] if attributes else []
    return zlib.crc32(f"{name} {of}".encode("utf-8", "surrogatepass")) % 255 + 1


def blocks_of(page: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Blocks of a page: text, part, kind (0: a paragraph or heading, else see _kind) and suspect (0: in none, else see _suspect).
    White space is one space; empty blocks go."""
    texts: list[str] = []
    parts: list[int] = []
    kinds: list[int] = []
    suspects: list[int] = []
    stack: list[tuple[str, int, list[str] | None, int, int, int]] = []
    part, kind, suspect, pieces, at, end = PLAIN, 1, 0, [], 0, len(page)

    def close() -> None:
        if pieces:
            if text := " ".join(html.unescape("".join(pieces)).split()):
                texts.append(text)
                parts.append(part)
                kinds.append(kind)
                suspects.append(suspect)
            pieces.clear()

    while at < end:
        m = _tag.search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCKS:
                close()
                kind = stack[-1][4] if stack and not kind else kind
            if name not in _PARAGRAPHS and any(x[0] == name for x in stack):
                if name in _BLOCKS or any(x[0] == name and x[2] is not None for x in stack):
                    close()
                while stack:
                    top, part, outer, kind, _, suspect = stack.pop()
                    if outer is not None:  # what an advert or the like interrupted goes on
                        pieces += outer
                    if top == name:
                        break
                    if outer is not None:
                        close()
            continue
        above = kind
        if name in _BLOCKS:
            close()
            kind = 0 if name in _PARAGRAPHS else _kind(name, m[3])
        elif name == "br":
            pieces.append(" ")
        if name in _RAW and not m[3].endswith("/"):
            over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = over.end() if over else end if name in ("script", "style") else at
            continue
        if name in _VOID or name in _PARAGRAPHS and not m[3] or m[3].endswith("/"):
            continue
        now = part
        if part != EDGE:
            nested = name == "article" and any(x[0] == "article" for x in stack)
            if name in _BOILER or nested or name == "header" and part != CORE or name not in ("body", "html", "main") and m[3] and _named(m[3]):
                now = EDGE
            elif name in ("article", "main") or m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I):
                now = CORE
        doubt = suspect
        if now == CORE != part:
            doubt = 0  # what holds an article is no menu
        elif now != EDGE and not doubt and m[3] and name in _BLOCKS and name not in _PARAGRAPHS and name not in ("article", "body", "html", "main"):
            doubt = _suspect(name, m[3])
        outer = None
        if now != part and name not in _BLOCKS:
            outer = pieces.copy()
            pieces.clear()
        elif now != part:
            close()
        if name in _PARAGRAPHS:
            if now != part and (over := re.compile(rf"</{name}\s*>", re.I).search(page, at)):
                # a paragraph that is a notice or the like ends with its tag
                for x in lines_of(page[at : over.start()])[0]:
                    texts.append(x)
                    parts.append(now)
                    kinds.append(0)
                    suspects.append(0)
                at = over.end()
            continue
        if now == part and name not in _BLOCKS:
            continue
        stack.append((name, part, outer, above, kind, suspect))
        part, suspect = now, doubt
    close()
    return texts, parts, kinds, suspects


def lines_of(page: str) -> tuple[list[str], list[int], list[int]]:
    """Blocks of a page without what only the host can tell: text, part and kind."""
    return blocks_of(page)[:3]


def settled(parts: list[int], suspects: list[int], edges: set[int]) -> list[int]:
    """Parts of lines once suspects are decided: those in edges go with menus and the like, unless the page would be empty."""
    if not any(suspects):
        return parts
    new = [EDGE if s and s in edges else p for p, s in zip(parts, suspects, strict=True)]
    kept = CORE if CORE in parts else PLAIN
    return new if kept in new else parts


def _bits(a: list[int], b: list[int]) -> list[int]:
    """Rows of the LCS of a with each beginning of b: bit i of row j is 0 where a[: i + 1] has a longer LCS than a[:i]."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for x in b:
        m = where.get(x, 0)
        row = (row + (row & m) | row & ~m) & full
        rows.append(row)
    return rows


def shared_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of a longest common subsequence of two lists, in order. Exact; by bits of whole rows at a time."""
    low, n, m = 0, len(a), len(b)
    while low < min(n, m) and a[low] == b[low]:
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    head = [(i, i) for i in range(low)]
    tail = [(n + k, m + k) for k in range(len(a) - n)]
    both = set(a[low:n]) & set(b[low:m])
    ia, ib = [i for i in range(low, n) if a[i] in both], [j for j in range(low, m) if b[j] in both]
    return head + [(ia[i], ib[j]) for i, j in _align([a[i] for i in ia], [b[j] for j in ib])] + tail


def _align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > ALIGN_BITS and len(b) > 1:
        mid = len(b) // 2
        steps = lambda row: np.r_[0, np.cumsum(1 - np.unpackbits(np.frombuffer(row.to_bytes(-(-len(a) // 8), "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64))]
        first, second = _last(a, b[:mid]), _last(a[::-1], b[mid:][::-1])
        cut = int(np.argmax(steps(first) + steps(second)[::-1]))
        return _align(a[:cut], b[:mid]) + [(i + cut, j + mid) for i, j in _align(a[cut:], b[mid:])]
    rows, out, i, j = _bits(a, b), [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _last(a: list[int], b: list[int]) -> int:
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        m = where.get(x, 0)
        row = (row + (row & m) | row & ~m) & full
    return row


def deletions(parts: list[int], kinds: list[int], marks: list[int], other: tuple[list[int], list[int], list[int]]) -> list[int]:
    """Numbers of the lines of a page that go because the other page (marks, parts and kinds of its lines) has them too, and
    that would be main text otherwise."""
    kept = CORE if CORE in parts else PLAIN
    both = [(i, j) for i, j in shared_lines(marks, other[0]) if parts[i] == kept]
    if kept == PLAIN:
        return [i for i, _ in both]
    copies = 2 * sum(other[1][j] == CORE for _, j in both) > parts.count(CORE)
    return [i for i, j in both if kinds[i] and (other[1][j] == EDGE or not copies and kinds[i] == other[2][j])]


def main_text(lines: list[str], parts: list[int], gone: set[int] | list[int] = ()) -> str:
    """Text of a page without the lines that go: of the article if there is one, else of what stands in no named part."""
    kept = CORE if CORE in parts else PLAIN
    return "\n\n".join(x for i, x in enumerate(lines) if parts[i] == kept and i not in gone)


def _mark(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _to_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, url, html) -> (key, url, marks, parts, suspects); parts holds two bytes a line, its part and kind; suspects is null
    for pages without any."""
    for batch in batches:
        pages = [x or "" for x in batch.column(2).to_pylist()]
        for a, b in slices(pages):
            found = [blocks_of(x) for x in pages[a:b]]
            parts = [bytes(x for both in zip(ps, ks, strict=True) for x in both) for _, ps, ks, _ in found]
            marks = [[_mark(x) for x in xs] for xs, _, _, _ in found]
            suspects = [xs if any(xs) else None for _, _, _, xs in found]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.list_(pa.int64())), pa.array(parts, pa.binary()), pa.array(suspects, pa.list_(pa.int64()))], ["key", "url", "marks", "parts", "suspects"])


def _to_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, copies, marks, parts, near_marks, near_parts) -> (pair, copies, gone), pairs without deletions left out."""
    for batch in batches:
        pairs, counts, out = [], [], []
        for pair, copies, marks, parts, near_marks, near_parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gone := deletions(list(parts[0::2]), list(parts[1::2]), marks, (near_marks, list(near_parts[0::2]), list(near_parts[1::2]))):
                pairs.append(pair)
                counts.append(copies)
                out.append(gone)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["pair", "copies", "gone"])


def _to_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, gone, edges) -> (page_id, url, text, n_chars)."""
    for batch in batches:
        pages = [x or "" for x in batch.column(2).to_pylist()]
        gone, edges = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for a, b in slices(pages):
            texts = []
            for page, out, edge in zip(pages[a:b], gone[a:b], edges[a:b], strict=True):
                lines, parts, _, suspects = blocks_of(page)
                texts.append(main_text(lines, settled(parts, suspects, set(edge or ())), set(out or ())))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _SCHEME + r"([^/?#]*)", 1))


def _resettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, url, marks, parts, suspects, edges) -> (key, url, marks, parts), suspects decided."""
    for batch in batches:
        out = []
        for parts, suspects, edges in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            if suspects and edges:
                new = settled(list(parts[0::2]), suspects, set(edges))
                parts = bytes(x for both in zip(new, parts[1::2], strict=True) for x in both)
            out.append(parts)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.binary())], ["key", "url", "marks", "parts"])


def edges_of(marks: DataFrame) -> DataFrame | None:
    """(key, edges): the suspects that go, of pages where any do; None if no page has suspects. marks: a written table of
    key, url, marks, parts, suspects, a row for each different page.

    Pages with a suspect and pages in all are counted by host; both are sums that combine before they are shuffled.
    """
    each = written(marks.where("suspects IS NOT NULL").select("key", host_of(F.col("url")).alias("host"), F.explode(F.array_distinct(F.array_remove("suspects", 0))).alias("suspect")), "page-suspects")
    if each.isEmpty():
        return None
    hosts = marks.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    found = each.groupBy("host", "suspect").agg(F.count("*").alias("n")).join(hosts, "host")
    plain = F.pmod("suspect", F.lit(2)) == 1
    found = written(found.where((F.col("n") >= RECURS) | ((F.col("pages") < TELLING_PAGES) & plain)).select(F.struct("host", "suspect").alias("of"), "n"), "page-edges")
    met = join_groups(each.select("key", F.struct("host", "suspect").alias("of")), found, "of", "n", each.count())
    # a page has as many as it has elements
    return written(met.groupBy("key").agg(F.collect_list("of.suspect").alias("edges")), "page-edged")


def places(marks: DataFrame) -> DataFrame:
    """(key, host, path, same, content): same stands for a page's lines, content for lines and parts."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_of(F.col("url")), F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)
    return marks.select("key", host.alias("host"), path.alias("path"), F.xxhash64("marks").alias("same"), F.xxhash64("marks", "parts").alias("content"))


def neighbours(pages: DataFrame) -> DataFrame:
    """(host, path, same, near) from rows with host, path, same and key: the page that pages of this path and these lines are
    compared with; those without one are left out.

    The rows, one for each (host, path, same), are sorted by host and path over all partitions. The candidates of a row are
    the last row before and the first row after it with other lines on the same host, so a run of equal lines of any length is
    passed over. Of the two, the one with the longer common path wins (the earlier on a tie). Only a few rows of each
    partition reach the driver, which carries candidates over the partitions' ends.
    """
    spark = pages.sparkSession
    ordered = pages.select("host", "path", "same", "key").repartitionByRange(partitions(spark), "host", "path", "key").sortWithinPartitions("host", "path", "key").withColumn("id", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("p", F.shiftright("id", 33)), "page-order")
    up, down = Window.partitionBy("p").orderBy("id"), Window.partitionBy("p").orderBy(F.desc("id"))
    row = F.struct("host", "path", "key", "same")
    differs = (F.col("prev.host") != F.col("host")) | (F.col("prev.same") != F.col("same"))
    runs = ordered.withColumn("row", row).withColumn("prev", F.lag("row").over(up)).withColumn("starts", F.coalesce(differs, F.lit(False)))
    runs = runs.withColumn("before", F.last(F.when(F.col("starts"), F.col("prev")), True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("after", F.last(F.when(F.col("starts"), F.col("row")), True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
    runs = written(runs.select("id", "p", "row", "before", "after"), "page-runs")
    ends = sorted(runs.groupBy("p").agg(F.min_by("row", "id").alias("first"), F.max_by("row", "id").alias("last"), F.min_by("after", "id").alias("change"), F.max_by("before", "id").alias("before")).collect(), key=lambda r: r["p"])
    alike = lambda x, y: x is not None and (x["host"], x["same"]) == (y["host"], y["same"])
    befores, afters, last, before, first, after = {}, {}, None, None, None, None
    for r in ends:
        befores[r["p"]] = before if alike(last, r["first"]) else last
        last, before = r["last"], r["before"] or befores[r["p"]]
    for r in reversed(ends):
        afters[r["p"]] = after if alike(first, r["last"]) else first
        first, after = r["first"], r["change"] or afters[r["p"]]
    kind = runs.schema["row"].dataType.simpleString()
    carried = spark.createDataFrame([(p, befores[p], afters[p]) for p in befores], f"p long, carried_before {kind}, carried_after {kind}")  # one row a partition
    both = runs.join(F.broadcast(carried), "p").select("row.*", F.coalesce("before", "carried_before").alias("before"), F.coalesce("after", "carried_after").alias("after"))

    def common(x: str) -> Column:
        size = F.length("path") - F.length(F.regexp_extract(F.concat_ws("\x00", F.col("path"), F.col(f"{x}.path")), r"^(.*)([^\x00]*)\x00\1", 2))
        return F.when(F.col(f"{x}.host") == F.col("host"), size)

    before_, after_ = F.coalesce(common("before"), F.lit(-1)), F.coalesce(common("after"), F.lit(-1))
    near = F.when((before_ >= after_) & (before_ >= 0), F.col("before.key")).when(after_ >= 0, F.col("after.key"))
    return both.select("host", "path", "same", near.alias("near")).where("near IS NOT NULL")


def deleted(marks: DataFrame) -> DataFrame:
    """(key, gone): the lines that go, of the pages where any do. marks: a written table of key, url, marks, parts.

    One page of each path and lines is paired, its partner holds for all of them, and pages of equal lines, parts and partner
    are aligned once, so groups of copies of any size cost one alignment and meet in no task.
    """
    pages = written(places(marks), "page-places")
    place = lambda df: df.withColumn("place", F.xxhash64("host", "path", "same"))
    groups = written(pages.groupBy("host", "path", "same").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "page-groups")
    near = written(place(groups.drop("key").join(neighbours(groups), ["host", "path", "same"])).select("place", "near", "copies"), "page-near")
    n = pages.count()
    paired = written(join_groups(place(pages).select("key", "content", "place"), near, "place", "copies", n).select("key", F.xxhash64("content", "near").alias("pair"), "near"), "page-pairs")
    pairs = paired.groupBy("pair").agg(F.min(F.struct("key", "near")).alias("x"), F.count("*").alias("copies")).select("pair", "copies", "x.*")
    other = marks.select(F.col("key").alias("near"), F.col("marks").alias("near_marks"), F.col("parts").alias("near_parts"))
    aligned = marks.join(pairs, "key").join(other, "near").select("pair", "copies", "marks", "parts", "near_marks", "near_parts")
    gone = written(aligned.mapInArrow(_to_gone, "pair long, copies long, gone array<int>"), "pair-gone")
    return join_groups(paired.select("key", "pair"), gone, "pair", "copies", n).select("key", "gone")


#: Pages with deletions that are broadcast (a key and a few numbers each); more are joined by sort-merge.
MOST_BROADCAST = 50_000


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Blocks are joined by two line ends. A null or empty page, or one without main text, gives an empty text. A null url is a
    host of its own. Pages of equal path and lines have one partner; a page whose host has no other lines is not compared;
    of partners that share as much of the path, the earlier wins. Very long pages are read whole, and aligned in halves where
    a table would not fit. Repeated rows give repeated rows. An empty table gives no rows; other columns play no part.

    Pages are read twice: once for hashes of their lines, which are all that is paired and aligned, and once for their texts,
    so pages themselves are neither written nor shuffled (unless very many have deletions).
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    text = F.concat_ws("\x00", F.coalesce(F.col("page_id").cast("string"), F.lit("\x01")), F.coalesce("url", F.lit("\x01")), F.coalesce("html", F.lit("")))
    keyed = source.withColumn("key", F.unhex(F.md5(text.cast("binary"))))
    marks = keyed.select("key", "url", "html").mapInArrow(_to_marks, "key binary, url string, marks array<long>, parts binary, suspects array<long>")
    marks = written(marks.dropDuplicates(["key"]), "page-marks")
    edges = edges_of(marks)
    if edges is not None:
        marks = written(marks.join(edges, "key", "left").mapInArrow(_resettled, "key binary, url string, marks array<long>, parts binary"), "page-settled")
    gone = written(deleted(marks.drop("suspects")), "page-gone")
    small = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df.hint("merge")
    out = keyed.join(small(gone), "key", "left")
    out = out.withColumn("edges", F.lit(None).cast("array<long>")) if edges is None else out.join(small(edges), "key", "left")
    out = out.select("page_id", "url", "html", "gone", "edges")
    return out.mapInArrow(_to_text, "page_id long, url string, text string, n_chars long")
