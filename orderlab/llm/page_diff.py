"""HTML extraction by nearest-URL page differencing.

1. Every page becomes text lines, one per block element, with character references
   decoded and white space collapsed.  A line knows whether it lies in chrome (menus,
   page headers, footers, sidebars, adverts, notices, forms, comments, by element
   name or class) and whether it lies in the page's declared content (``article``, or
   ``main`` without one).
2. Pages are ordered by (host, path, id); each is compared with the pages before and
   after it on its host, the host's first and last page with their two nearest.  The
   order comes from a range sort of light rows (id, URL, line hashes) and global ranks,
   so a host with a third of all pages is spread over tasks, and the neighbours are
   found by equality joins on the rank.
3. The line hashes of a page and a neighbour are aligned by longest common subsequence
   (bit-parallel, halved where the table would be large).  A neighbour is evidence only
   if its content differs: both pages have content lines (declared content, else lines
   outside chrome) that the other lacks; a mirrored copy is none, however much text it
   shares.  Lines shared with every such neighbour are the host's template and deleted;
   what only one of two neighbours shares (a copy with another date) stays.
4. Inside declared content more is asked, since articles share sentences too: the
   neighbour's article must be another one (at most half of the lines of the smaller
   are shared), the line must stand at the same place, counted from the content's start
   or end, on the page and on every such neighbour, and no page of another host may have
   it as content.
5. The page's text is what remains of its declared content, or of all lines outside
   chrome if it declares none.

Only line hashes are differenced; a page's html is read twice and moves only if the
pages with deletions outgrow a broadcast.

Markup: a tag ends at the first ``>`` outside quotes.  After a tag whose quote never
closes, every tag of that page ends at its next ``>``; a ``<`` with no ``>`` after it is
text, as is a ``<`` before anything but a name, ``/``, ``!`` or ``?``.  Comments and
raw-text elements that never close run to the end.  So every page takes linear time to
read.  Character references are decoded between two tags, never across one.

Edge cases: null or empty html gives empty text; a null or unparsable URL has the
empty host and path and is compared like any other; a host with one page has no
neighbour and nothing is deleted; unclosed elements end with the page or at the next
``article`` or ``main``; repeated rows stand once in the order and get the same text,
rows with one id but another URL or html are pages of their own; extra columns are left
alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlab.llm.common import materialize, rows, steps

TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")    # of a tag: attributes and its end
RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in """script style noscript template iframe svg head textarea
    select button object audio video canvas""".split()}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody
    tfoot thead title tr ul""".split())
SPACE = {"br", "td", "th", "option", "img", "wbr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "area", "base", "embed", "source", "track", "param"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "title"}
CHROME_WORDS = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie
    cookies consent notice notices alert gdpr popup modal overlay sidebar navigation nav navbar menu menubar breadcrumb
    breadcrumbs footer masthead toolbar search login signup subscribe newsletter social share sharing related recommended
    comment comments reply replies disqus widget complementary contentinfo skip pagination pager""".split())
CONTAINER = {"div", "section", "ul", "ol", "p", "span", "table", "aside", "article", "li", "details", "figure", "dl"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
TABLE_BITS = 1 << 26      # of one table of an alignment; a larger one is halved
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _chrome(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    if name not in CONTAINER or "=" not in attributes:
        return False
    words = {w for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return not words.isdisjoint(CHROME_WORDS)


def tags(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before it, closing, name, attributes) of each tag; comments, declarations and
    raw-text elements have no name; the last row is the text after all tags."""
    run = pos = 0
    quoted = True
    while (pos := html.find("<", pos)) >= 0:
        if html.startswith("<!--", pos):
            end = html.find("-->", pos + 2)
            yield html[run:pos], False, "", ""
            run = pos = end + 3 if end >= 0 else len(html)
            continue
        tag = TAG.match(html, pos)
        if not tag and html[pos + 1:pos + 2] not in ("!", "?"):
            pos += 1
            continue
        rest = REST.match(html, tag.end()) if tag and quoted else None
        if rest:
            attributes, end = rest[1], rest.end()
        else:
            end = html.find(">", pos) + 1
            if not end:
                break
            quoted = quoted and not tag
            attributes = html[tag.end():end - 1] if tag else ""
        name = tag[2].lower() if tag else ""
        before = html[run:pos]
        if name in RAW and not tag[1]:
            if not (name == "svg" and attributes.endswith("/")):
                close = RAW[name].search(html, end)
                end = close.end() if close else len(html)
            name = ""
        yield before, bool(tag and tag[1]), name, attributes
        run = pos = end
    yield html[run:], False, "", ""


def lines(html: str | None) -> list[tuple[str, bool, bool, bool]]:
    """(text, in chrome, in article, in main) of each block with text, in page order."""
    out, part = [], []
    skip, depth = None, 0            # open chrome element and how often its name is open
    inside = {"article": 0, "main": 0}

    def flush():
        text = " ".join("".join(part).split()) if part else ""
        if text:
            out.append((text, skip is not None, inside["article"] > 0, inside["main"] > 0))
        part.clear()

    for before, closing, name, attributes in tags(html or ""):
        if before:
            part.append(unescape(before))
        if not name:
            continue
        if name in SPACE:
            part.append(" ")
            continue
        if name in BLOCK:
            flush()
        if skip:
            if name in inside and not closing and name != skip and not _chrome(name, attributes):
                skip = None            # content begins: the chrome element was left open
            elif name == skip:
                depth += -1 if closing else 1
                if not depth:
                    flush()
                    skip = None
                continue
            else:
                continue
        if name in inside:
            if closing:
                inside[name] = max(0, inside[name] - 1)
            elif not _chrome(name, attributes):
                inside[name] += 1
                continue
        if not closing and name not in VOID and not attributes.rstrip().endswith("/") and _chrome(name, attributes):
            flush()
            skip, depth = name, 1
    flush()
    return out


def declared(found: list[tuple[str, bool, bool, bool]]) -> int | None:
    """Which column of the lines marks the page's declared content, if it declares any."""
    return 2 if any(x[2] and not x[1] for x in found) else 3 if any(x[3] and not x[1] for x in found) else None


def content(found: list[tuple[str, bool, bool, bool]]) -> list[bool]:
    """Which lines are the page's content: declared, else all outside chrome."""
    column = declared(found)
    return [not x[1] and (column is None or x[column]) for x in found]


def line_hashes(found: list[tuple[str, bool, bool, bool]]) -> list[int]:
    """Hash of each line; the lowest bit tells content."""
    return [xxhash.xxh3_64_intdigest(x[0].encode("utf-8", "replace")) >> 2 << 1 | c
            for x, c in zip(found, content(found), strict=True)]


def _row(a: list[int], places: dict[int, list[int]], size: int, keep: list | None = None) -> int:
    """Last row of the dynamic programme of ``a`` against ``size`` lines, as a bit set; a
    clear bit j: the subsequence grows with line j."""
    full = row = (1 << size) - 1
    for x in a:
        if at := places.get(x):
            bits = sum(1 << j for j in at) if len(at) < 8 else int.from_bytes(
                np.packbits(np.bincount(at, minlength=size).astype(bool), bitorder="little").tobytes(), "little")
            u = row & bits
            row = ((row + u) | (row - u)) & full
        if keep is not None:
            keep.append(row)
    return row


def _places(b: list[int]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    return places


def _lengths(row: int, size: int) -> np.ndarray:
    """Length of the subsequence with each prefix of the ``size`` lines."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")[:size]
    out = np.zeros(size + 1, np.int64)
    np.cumsum(1 - bits.astype(np.int64), out=out[1:])
    return out


def _align(a: list[int], b: list[int], table_bits: int) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) == 1 or len(a) * len(b) <= table_bits:
        table: list[int] = []
        _row(a, _places(b), len(b), table)
        out, i, j = [], len(a), len(b)
        while i and j:
            if table[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not table[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]
    # the halves of ``a`` meet where the lengths before and after add up to most
    half, size = len(a) // 2, len(b)
    left = _lengths(_row(a[:half], _places(b), size), size)
    right = _lengths(_row(a[half:][::-1], _places(b[::-1]), size), size)[::-1]
    at = int(np.argmax(left + right))
    return _align(a[:half], b[:at], table_bits) + [
        (half + i, at + j) for i, j in _align(a[half:], b[at:], table_bits)]


def common_lines(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> np.ndarray:
    """For each position of ``a`` its partner in ``b`` in one longest common subsequence, or
    -1.  Lines that the other lacks and equal ends are set aside first."""
    out = np.full(len(a), -1, np.int64)
    in_a, in_b = set(a), set(b)
    own, other = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    lo, hi, end = 0, len(own), len(other)
    while lo < min(hi, end) and a[own[lo]] == b[other[lo]]:
        out[own[lo]] = other[lo]
        lo += 1
    while hi > lo and end > lo and a[own[hi - 1]] == b[other[end - 1]]:
        hi, end = hi - 1, end - 1
        out[own[hi]] = other[end]
    for i, j in _align([a[i] for i in own[lo:hi]], [b[j] for j in other[lo:end]], table_bits):
        out[own[lo + i]] = other[lo + j]
    return out


def template_lines(lines_: list[int], inside: bool, *neighbours: list[int] | None) -> list[int]:
    """Positions of the content lines that the page's neighbours show to be template;
    ``inside``: the page declares its content."""
    own, hashes = np.array([x & 1 for x in lines_], bool), [x >> 1 for x in lines_]
    found = []
    for other in neighbours:
        if not other or not lines_:
            continue
        there, partner = np.array([x & 1 for x in other], bool), common_lines(hashes, [x >> 1 for x in other])
        shared = partner >= 0
        lacking = there.copy()
        lacking[partner[shared]] = False
        if not (own & ~shared).any() or not lacking.any():
            continue
        if inside:
            shared &= own
            shared[shared] = there[partner[shared]]
            if 2 * shared.sum() > min(own.sum(), there.sum()):
                continue                       # a version of the same article
            found.append((shared & (np.cumsum(own) == np.cumsum(there)[partner]), shared & (_after(own) == _after(there)[partner])))
        else:
            found.append((shared & own,) * 2)
    if not found:
        return []
    first, last = (np.logical_and.reduce(x) for x in zip(*found, strict=True))
    return np.flatnonzero(first | last).tolist()


def _after(mask: np.ndarray) -> np.ndarray:
    """How many set positions follow each one."""
    return mask.sum() - np.cumsum(mask)


def main_text(html: str | None, template: list[int] | None = None) -> tuple[str, int]:
    """(text, lines of the page): content lines but those at the ``template`` positions."""
    found, gone = lines(html), set(template or ())
    return "\n".join(x[0] for i, (x, c) in enumerate(zip(found, content(found), strict=True)) if c and i not in gone), len(found)


def _placed(pages: DataFrame) -> DataFrame:
    """(rank, host, page_id, key, declared, hashes): pages by (host, path, id), ranked globally."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("key", pa.int64()), ("declared", pa.bool_()),
                     ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in steps(batches, "html"):
            found = [lines(h) for h in batch.column("html").to_pylist()]
            yield rows(out, *[batch.column(c) for c in ("page_id", "url", "key")], [declared(x) is not None for x in found],
                       [line_hashes(x) for x in found])

    light = pages.mapInArrow(run, "page_id bigint, url string, key bigint, declared boolean, hashes array<bigint>").select(
        F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")).alias("path"), "page_id", "key", "declared", "hashes")
    order = ["host", "path", "page_id", "key"]
    # repeated rows stand once in the order
    light = light.groupBy(*order).agg(F.min("declared").alias("declared"), F.min("hashes").alias("hashes"))
    placed = materialize(light.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()), "pages")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = dict(placed.groupBy(part.alias("p")).count().collect())  # one row per task of the sort
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = placed.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "part bigint, before bigint")
    return placed.withColumn("part", part).join(F.broadcast(offset), "part").select(
        (F.col("before") + place).alias("rank"), "host", "page_id", "key", "declared", "hashes")


def templates(pages: DataFrame) -> DataFrame:
    """(page_id, key, template): positions of the content lines to delete, for the pages that
    have any; ``pages``: page_id, url, key, html."""
    ranked = _placed(pages)
    at = ranked.select("rank", "host", F.explode(F.array(*map(F.lit, (-2, -1, 0, 1, 2)))).alias("d"))
    near = at.groupBy((F.col("rank") - F.col("d")).alias("rank")).agg(
        F.max(F.col("d") == 0).alias("real"),
        *[F.max(F.when(F.col("d") == d, F.col("host"))).alias(f"h{d + 2}") for d in (-2, -1, 0, 1, 2)]).where("real")
    # h2 is the page's own host; a row without a neighbour gets a rank that no page has
    near = near.selectExpr("rank", """coalesce(CASE WHEN h3 = h2 THEN rank + 1 WHEN h1 = h2 THEN rank - 1 END, -3 - rank) AS n1""",
                           """coalesce(CASE WHEN h3 = h2 AND h1 = h2 THEN rank - 1 WHEN h4 = h2 THEN rank + 2
                              WHEN h0 = h2 THEN rank - 2 END, -3 - rank) AS n2""")
    joined = (ranked.join(near, "rank").join(ranked.select(F.col("rank").alias("n1"), F.col("hashes").alias("first")), "n1", "left")
              .join(ranked.select(F.col("rank").alias("n2"), F.col("hashes").alias("second")), "n2", "left"))
    out = pa.schema([("page_id", pa.int64()), ("key", pa.int64()), ("host", pa.string()), ("declared", pa.bool_()),
                     ("at", pa.int32()), ("line", pa.int64())])

    def differ(batches):
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                own = part.column("hashes").to_pylist()
                found = [template_lines(*x) for x in zip(own, *(part.column(c).to_pylist() for c in ("declared", "first", "second")),
                                                         strict=True)]
                i = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield rows(out, *[part.column(c).take(i) for c in ("page_id", "key", "host", "declared")],
                           [p for x in found for p in x], [own[i][p] for i, x in enumerate(found) for p in x])

    gone = materialize(joined.select("page_id", "key", "host", "declared", "hashes", "first", "second").mapInArrow(
        differ, "page_id bigint, key bigint, host string, declared boolean, at int, line bigint"), "template-lines")
    # content of another host too: a common sentence, not the host's template
    suspects = gone.where("declared").select("line").distinct()
    content_ = ranked.select("host", F.explode(F.filter("hashes", lambda x: x.bitwiseAND(1) == 1)).alias("line"))
    common = content_.join(suspects, "line", "left_semi").groupBy("line").agg(
        F.min("host").alias("low"), F.max("host").alias("top")).where("low <> top").select("line", F.lit(True).alias("common"))
    return materialize(gone.join(common, "line", "left").where("not (declared and coalesce(common, false))")
                       .groupBy("page_id", "key").agg(F.collect_list("at").alias("template")), "templates")  # a page's own lines


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_template (content lines deleted) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn(
        "key", F.xxhash64("url", "html"))
    found = templates(pages).select(F.col("page_id").alias("p"), F.col("key").alias("k"), "template")
    joined = pages.join(found, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()),
                     ("n_lines", pa.int64()), ("n_template", pa.int64())])

    def run(batches):
        for batch in steps(batches, "html"):
            gone = batch.column("template").to_pylist()
            got = [main_text(*x) for x in zip(batch.column("html").to_pylist(), gone, strict=True)]
            yield rows(out, batch.column("page_id"), batch.column("url"), [g[0] for g in got], [len(g[0]) for g in got],
                       [g[1] for g in got], [len(t or ()) for t in gone])

    return joined.select("page_id", "url", "html", "template").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_template bigint")
