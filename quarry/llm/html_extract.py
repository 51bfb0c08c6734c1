"""Main text of web pages: structure of the page, and differencing against the page with the nearest URL.

Pages are ordered by host and path and cut into ranges, so a large host is spread over many tasks; each range also gets
the page before its first and the page behind its last, so that the cuts change no text. Each page is paired with the
neighbour of its host whose path shares the longest prefix, or the other one if that is a near copy; their text lines are aligned by longest
common subsequence, and shared lines outside an <article> are deleted, those of a <main> too, as it may wrap the whole
page. Lines inside <article> stay even if shared, since articles quote passages of each other; navigation, adverts
and the like go by their elements. Where a page has an <article> or <main>, lines outside of both are left out.

Nulls and ties: a null page is empty and gives an empty text; pages without a host pair among themselves; of equally
near neighbours the earlier counts; a page that shares most of its content (by _weight) with a neighbour is a near copy
of it, and one with the same url another version of it: with such neighbours alone it keeps all lines. Rows with one url and html are one page to its neighbours;
each gives a row, and all have the same text. Parts that are hidden by attribute or style, and reader comments, are no
text. Unclosed and stray tags, cut-off pages and unknown references are taken as a browser would. Pages
of any length are used whole. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import bounded, map_arrow, materialize

#: Elements that end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are not text of the page's article.
DROPPED = frozenset("aside button dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
#: The same, by class, id or role. A name counts if its words are these and STRUCTURE alone: comment-thread and menu-main-container do, has-sidebar and ad-free do not.
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent contentinfo cookie cookies disqus login menu modal nav navbar navigation newsletter notice popup promo promoted related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
STRUCTURE = frozenset(
    "area articles aside bar block body bottom box buttons column container content form group header footer headline holder icons inner item items left lg links list main md menu mobile nav outer page panel posts primary right row secondary section side site slot sm stories thread title top unit user wrap wrapper".split()
)
#: Elements that hold the text and so go by no name.
KEPT = frozenset("article body html main".split())
#: Names and elements that drop what stands outside an article only.
OUTER_NAMES = frozenset("footer header masthead".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_CLOSED = frozenset("p li dt dd option".split())
IN_MAIN, IN_ARTICLE = 1, 2
PLACES = {"main": IN_MAIN, "article": IN_ARTICLE}
ROWS = 200
#: What pages are ordered by; copies of a row are alike in all of it.
ORDER = ["host", "path", "page_id", "hash"]
#: Keys that are sampled for each range, and bytes of pages that a range has about.
SAMPLED, RANGE_BYTES = 100, 64 << 20


_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names(attributes: list) -> list[set[str]]:
    """The words of each name that an element goes by."""
    found = " ".join(v or "" for k, v in attributes if k in ("class", "id", "role"))
    return [set(filter(None, re.split(r"[-_]+", _CAMEL.sub("-", name).lower()))) for name in found.split()]


def _goes_by(names: list[set[str]], wanted: frozenset[str]) -> bool:
    return any(words & wanted and words <= wanted | STRUCTURE for words in names)


def _hidden(attributes: list) -> bool:
    return any(k == "hidden" or k == "style" and _HIDDEN_STYLE.search(v or "") for k, v in attributes)


class Page(HTMLParser):
    """lines: (text, place, dropped) in page order; place: IN_ARTICLE, IN_MAIN outside an article, or 0."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool]] = []
        self._stack: list[tuple[str, int, bool]] = []  # (element, place, dropped)
        self._text: list[str] = []
        self.feed(html)
        self.close()
        self._end_line()

    def _state(self) -> tuple[int, bool]:
        return self._stack[-1][1:] if self._stack else (0, False)

    def _end_line(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.lines.append((text, *self._state()))
            self._text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            if tag != "br" and self._stack and self._stack[-1][0] in INLINE_CLOSED and (tag in INLINE_CLOSED or self._stack[-1][0] == "p"):
                self._stack.pop()
        if tag in VOID:
            return
        place, dropped = self._state()
        names = [] if tag in KEPT else _names(attrs)
        drop = tag in DROPPED or _goes_by(names, DROPPED_NAMES) or not place and (tag == "header" or _goes_by(names, OUTER_NAMES))
        drop = drop or tag not in ("body", "html") and _hidden(attrs)
        inside = max(place, PLACES.get(tag, 0))
        # only what changes the state, or can nest in it, needs to be remembered
        if drop or inside != place or tag in BLOCKS:
            if tag not in BLOCKS:
                self._end_line()
            self._stack.append((tag, inside, dropped or drop))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                self._end_line()
                del self._stack[k:]
                break

    def handle_data(self, data: str) -> None:
        self._text.append(data)


#: Bits of a table of alignment that are kept at once, 64 MB; a larger one is halved.
TABLE_BITS = 1 << 29


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    back = 0
    while back < end - start and a[-1 - back] == b[-1 - back]:
        back += 1
    found = {*range(start), *range(len(a) - back, len(a))}
    theirs, mine = set(b[start : len(b) - back]), set(a[start : len(a) - back])
    left = [i for i in range(start, len(a) - back) if a[i] in theirs]
    return found.union(left[k] for k in _aligned([a[i] for i in left], [x for x in b[start : len(b) - back] if x in mine]))


def _rows(a: list[str], b: list[str], keep: bool) -> list[int]:
    """Rows of the table of alignment lengths, as bits: bit j is 0 where b[: j + 1] has a longer alignment than b[:j]."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    row, whole, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for line in a:
        met = row & places.get(line, 0)
        row = (row + met | row - met) & whole
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest alignments of a with b[:0], b[:1] and so on."""
    row = _rows(a, b, False)[0]
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence with b: each line of a costs len(b) / 64 steps, however lines recur."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        at = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _aligned(a[:half], b[:at]) + [half + k for k in _aligned(a[half:], b[at:])]
    rows, i, j, found = _rows(a, b, True), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                found.append(i)
                j -= 1
    return found[::-1]


def _weight(lines: list[tuple[str, int, bool]]) -> int:
    """Squares of lengths, so that paragraphs count and the many short lines around them hardly do."""
    return sum(len(text) ** 2 for text, _, _ in lines)


def _content(lines: list[tuple[str, int, bool]]) -> list[tuple[int, tuple[str, int, bool]]]:
    """Lines with their places: those of <article> and <main> if there are any, without dropped ones."""
    content = [(k, line) for k, line in enumerate(lines) if not line[2]]
    return [(k, line) for k, line in content if line[1]] if any(line[1] for _, line in content) else content


def main_text(lines: list[tuple[str, int, bool]], *neighbours: list[tuple[str, int, bool]]) -> str:
    """Text without the lines shared with the first neighbour that is no near copy."""
    content = _content(lines)
    for neighbour in neighbours:
        shared = shared_lines([t for t, _, _ in lines], [t for t, _, _ in neighbour])
        if 2 * _weight([line for k, line in content if k in shared]) <= _weight([line for _, line in content]):
            return " ".join(line[0] for k, line in content if k not in shared or line[1] == IN_ARTICLE)
    return " ".join(line[0] for _, line in content)


def _ranged(pages: DataFrame) -> DataFrame:
    """pages with `range`, `own`: ordered by ORDER, each range has besides its own pages those next to it."""
    spark = pages.sparkSession
    keys = pages.select(F.struct(*ORDER).alias("key"))
    rows, size = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    share = SAMPLED * n / max(1, rows)
    sample = sorted({tuple(r["key"]) for r in (keys.sample(share, seed=1) if share < 1 else keys).collect()}, key=lambda k: [(x is not None, x) for x in k])
    cuts = [sample[len(sample) * k // n] for k in range(1, n)] if len(sample) >= n else sample[1:]
    kinds = [pages.schema[c].dataType for c in ORDER]
    rows = F.array(*[F.struct(*[F.lit(x).cast(t).alias(c) for x, t, c in zip(cut, kinds, ORDER, strict=True)]) for cut in cuts])
    at = F.size(F.filter(rows, lambda cut: cut <= F.struct(*ORDER))) if cuts else F.lit(0)
    dealt = pages.withColumn("range", at)
    ends = dealt.groupBy("range").agg(F.min(F.struct(*ORDER)).alias("first"), F.max(F.struct(*ORDER)).alias("last")).orderBy("range").collect()
    next_to = [(*a["last"], b["range"]) for a, b in zip(ends, ends[1:], strict=False)] + [(*b["first"], a["range"]) for a, b in zip(ends, ends[1:], strict=False)]
    if not next_to:
        return dealt.withColumn("own", F.lit(True))
    schema = T.StructType([*[T.StructField(f"_{c}", t) for c, t in zip(ORDER, kinds, strict=True)], T.StructField("_range", T.IntegerType())])
    wanted = F.broadcast(spark.createDataFrame(next_to, schema))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ORDER]
    guests = pages.join(wanted, same).withColumn("range", F.col("_range")).select(*pages.columns, "range").dropDuplicates([*ORDER, "range"])
    return dealt.withColumn("own", F.lit(True)).unionByName(guests.withColumn("own", F.lit(False)))


def _texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, hash, text) of pages with ORDER's columns and grouped, under one id for each url and html.

    Rows that are alike in everything follow each other and are one page; it gives one row if it is grouped, else as
    many as there were.
    """
    ordered = _ranged(pages).repartitionByRange("range").sortWithinPartitions("range", *ORDER, "own")
    columns = ["page_id", "url", "hash", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None
        times = 0

        def near(a: tuple | None, b: tuple | None) -> int:
            return -1 if a is None or b is None or a[3:5] != b[3:5] or a[1] == b[1] else len(commonprefix((a[5], b[5])))

        def told(before: tuple | None, now: tuple, after: tuple | None) -> tuple:
            with_before, with_after = near(before, now), near(now, after)
            beside = [(with_before, before), (with_after, after)] if with_before >= with_after else [(with_after, after), (with_before, before)]
            return *now[:3], main_text(now[6], *(other[6] for n, other in beside if n >= 0))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.string(), pa.int64(), pa.string()), strict=True)], columns)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("page_id").type
            for at in range(0, batch.num_rows, ROWS):
                out = []
                for page_id, url, html, hash_, own_host, own_path, at_range, own, grouped in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    if now and (page_id, url, hash_, at_range) == now[:4] and own == now[7]:
                        times += not grouped
                        continue
                    after = (page_id, url, hash_, at_range, own_host, own_path, Page(html or "").lines, own)
                    if now and now[7]:
                        text = told(before, now, after)
                        out += [text] * min(times, ROWS)
                        while (times := times - ROWS) > 0:
                            yield batch_of([text] * min(times, ROWS))
                    before, now, times = now, after, 1
                if out:
                    yield batch_of(out)
        if now and now[7]:
            text = told(before, now, None)
            for done in range(0, times, ROWS):
                yield batch_of([text] * min(ROWS, times - done))

    return map_arrow(ordered.select("page_id", "url", "html", "hash", "host", "path", "range", "own", "grouped"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, hash long, text string")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page.

    Rows with one url and html are one page to its neighbours, that with the least id, and all have its text.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.xxhash64("url", "html").alias("hash"))
    # the ids of pages that stand under several ids; equal rows under one id are counted where they meet
    groups = keyed.groupBy("url", "hash").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count("page_id").alias("named"), F.count("*").alias("rows"))
    several = materialize(groups.where("first_id < last_id OR named BETWEEN 1 AND rows - 1").select(F.col("url").alias("_url"), F.col("hash").alias("_hash"), "first_id"), "page-groups")
    if several.isEmpty():
        return _texts(keyed.withColumn("grouped", F.lit(False))).select("page_id", "url", "text")
    here = F.col("url").eqNullSafe(F.col("_url")) & (F.col("hash") == F.col("_hash"))
    marked = keyed.join(bounded(several), here, "left").withColumn("grouped", F.col("_hash").isNotNull())
    ids = materialize(marked.where("grouped").select("_url", "_hash", F.col("page_id").alias("_page_id")), "page-ids")
    texts = _texts(marked.where(~F.col("grouped") | (F.col("page_id") == F.col("first_id"))).select(*keyed.columns, "grouped"))
    found = texts.join(bounded(ids), here, "left")
    return found.select(F.when(F.col("_hash").isNotNull(), F.col("_page_id")).otherwise(F.col("page_id")).alias("page_id"), "url", "text")
