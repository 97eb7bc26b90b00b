"""Main text of web pages: differencing of pages against their nearest URL on the same host; markup settles what that can't."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minhash import spread
from .storage import bounded, tidied, write_table
from .text import slices

#: A comment, a declaration, or a tag with its attributes; an unfinished one at the end of a page is none of its text.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
#: Elements whose content is no markup; what ends each.
_RAW = {t: re.compile(rf"</{t}\s*>|</{t}\s[^>]*>|\Z", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp", "noembed", "noframes", "select", "object", "canvas", "audio", "video")}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements within a block.
_INLINE = set("math mi mn mo mrow ms msub msup msubsup mfrac msqrt mtext semantics annotation a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROP = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset"}
_MAIN = {"article", "main"}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|subscribe|newsletter|signup|login|"
    r"share|sharing|social|related|recommend\w*|trending|popular|widget\w*|comments?|commentlist|discussion|disqus|replies|respond|pagination|pager|tags?|toolbar|skip|hidden|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Class and id names, one of which must be the whole of it or stand at its head or end, that mark an element as none of the text within an article.
_WITHIN = re.compile(
    r"^(?:ads?|advert\w*|ad-(?:box|slot|unit|banner|container)|banner-?ads?|sponsor(?:ed)?(?:-(?:box|content|links?|post))?|promo(?:-?box)?|(?:site|main|top|article|page)-?(?:nav|menu)\w*|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|cookie(?:s|-?(?:notice|banner|consent|bar))?|(?:site|legal)-?notice|notice|alert|popup|modal|"
    r"(?:newsletter|subscribe|sign-?up|login)(?:-?(?:box|form|signup|block))?|(?:social|share)(?:-?(?:share|bar|buttons?|links?|icons?))?|sharing|related(?:-?(?:articles?|posts?|links?|content|stories|reading))?|recommended?(?:-\w+)?|trending|most-?popular|"
    r"comments?(?:-?(?:list|section|area|thread|form|body|box))?|commentlist|disqus(?:_thread|-thread)?|replies|respond|pagination|pager|tags?(?:-?(?:list|links|cloud))?|toolbar|copyright|disclaimer-box|hidden|skip(?:-?link)?|widget\w*)$",
    re.I,
)
#: Names with which even an article isn't the page's own.
_SIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|promo\w*|sponsor\w*|related|teaser\w*|comment|reply)(?=$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body)(?:[\s_-]?(?:body|content|text|main))?(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

MAIN, OPEN, SIDE = 1, 0, -1


def _kind(tag: str, attributes: str, inside: bool = False) -> int | None:
    """Whether an element is dropped (-1), holds the article (1) or tells nothing (None); inside an article a class or id drops it only as a whole name."""
    if tag in _DROP:
        return -1
    good = tag in _MAIN
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return -1
        if name == "role":
            if value.lower() in _ROLES:
                return -1
            good |= value.lower() in ("main", "article")
        if name in ("class", "id"):
            if inside and tag not in _MAIN:
                if any(_WITHIN.match(v) for v in value.split()):
                    return -1
            elif tag not in ("html", "body") and (_SIDE if tag in _MAIN else _BAD).search(value):
                return -1
            good |= bool(tag not in _INLINE and _GOOD.search(value))
        if name == "itemprop" and value.lower() == "articlebody":
            good = True
    return 1 if good and tag not in ("html", "body") else None


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block, in page order: SIDE within elements that markup names as none of the text, else MAIN within an article, else OPEN.

    Only the outermost article, or one that stands beside others, counts; a closing tag closes what was opened
    after its element; the end of the page closes all.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int | None]] = []
    dropped = main = 0
    at = 0

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((SIDE if dropped else MAIN if main else OPEN, line))

    def close(n: int) -> None:
        nonlocal dropped, main
        while len(stack) > n:
            tag, kind = stack.pop()
            if tag not in _INLINE:
                flush()
            if kind == -1:
                flush()
                dropped -= 1
            elif kind == 1:
                flush()
                main -= 1

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/") or tag != "svg":
                at = _RAW[tag].search(page, at).end()
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
            stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody"), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in stop or (not stop and stack[i][0] not in _INLINE):
                    break
        kind = _kind(tag, m[3], main > 0)
        if kind == -1:
            if tag not in _INLINE:
                flush()
            elif text and not dropped:
                # an inline element is dropped without the text before it
                held = "".join(text)
                text.clear()
                close_inline = _end_of(page, at, tag)
                text.append(held)
                at = close_inline
                continue
            dropped += 1
        elif kind == 1:
            main += 1
        stack.append((tag, kind))
    close(0)
    flush()
    return out


def _end_of(page: str, at: int, tag: str) -> int:
    """The place behind the end of an element that begins at at, nested ones of its name counted."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(page)


#: Rows of a longest common subsequence that are kept at once; those between are made again.
_KEPT_ROWS = 256


def common(a: list, b: list) -> set[int]:
    """Places of a that lie on a longest common subsequence of a and b.

    Equal ends come first. A row of the table of lengths is one integer, a bit for each place of b that is 0 where the
    length grows; rows are followed in words of the machine, and only some are kept, so long pages need
    neither their product in memory nor a step for each of its cells.
    """
    out, lo = set(), 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out.add(lo)
        lo += 1
    x, y = len(a), len(b)
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
        out.add(x)
    shared = set(a[lo:x]) & set(b[lo:y])
    ia = [i for i in range(lo, x) if a[i] in shared]
    ib = [s for s in b[lo:y] if s in shared]
    if not ib:
        return out
    masks: dict = {}
    for j, s in enumerate(ib):
        masks[s] = masks.get(s, 0) | 1 << j
    full = (1 << len(ib)) - 1

    def after(row: int, i: int) -> int:
        m = masks[a[ia[i]]]
        u = row & m
        return ((row + u) | (row - u)) & full

    marks, row = [], full
    for i in range(len(ia)):
        if i % _KEPT_ROWS == 0:
            marks.append(row)
        row = after(row, i)
    j = len(ib) - 1
    for block in range(len(marks) - 1, -1, -1):
        base = block * _KEPT_ROWS
        rows = [marks[block]]
        for i in range(base, min(base + _KEPT_ROWS, len(ia))):
            rows.append(after(rows[-1], i))
        i = len(rows) - 1
        size = (len(ib) + 7) // 8
        rows = [r.to_bytes(size, "little") for r in rows]
        while i and j >= 0:
            if rows[i][j >> 3] >> (j & 7) & 1:
                j -= 1
            elif not rows[i - 1][j >> 3] >> (j & 7) & 1:
                i -= 1
            else:
                out.add(ia[base + i - 1])
                i, j = i - 1, j - 1
    return out


PARSED = "key long, twin long, page_id long, host string, path string, lines array<long>"


def _hashes(found: list[tuple[int, str]]) -> list[int]:
    return [int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for _, t in found]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all blocks of a page, by which pages are compared."""
    for whole in batches:
        for batch in slices(whole, "html"):
            lines = [_hashes(blocks(page.as_py() or "")) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "twin", "page_id", "host", "path")), pa.array(lines, pa.list_(pa.int64()))], names=[c.split()[0] for c in PARSED.split(", ")])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of each page's lines that the nearest page shares; none where it shares all, which tells nothing."""
    for batch in batches:
        gone = []
        for own, other in zip(batch.column("lines").to_pylist(), batch.column("other").to_pylist()):
            shared = common(own, other)
            gone.append([] if len(shared) == len(own) else sorted(shared))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("twin"), pa.array(gone, pa.list_(pa.int32()))], names=["key", "twin", "gone"])


def kept_lines(found: list[tuple[int, str]], gone: list[int] | None) -> list[str]:
    """The lines of the text: those that the nearest page of the host lacks, unless markup says that they are beside the text; of those it has, the ones within an article.

    A page with no other page on its host (gone is None) is left to markup: its article, or without one all that isn't beside the text.
    """
    if gone is None:
        article = any(k == MAIN for k, _ in found)
        return [t for k, t in found if k == MAIN or (k == OPEN and not article)]
    shared = set(gone)
    return [t for i, (k, t) in enumerate(found) if k == MAIN or (k == OPEN and i not in shared)]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = ["\n".join(kept_lines(blocks(page.as_py() or ""), gone)) for page, gone in zip(batch.column("html"), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


KEPT = "page_id long, url string, text string"


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def _path() -> Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^#]*)", 1)


def _nearest(pages: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """key, twin and lines of each page that has one, with other: the lines of whichever page with other lines before or after it, by path on its host, shares the longer start of the path.

    Pages are sorted into range partitions, so a host of any size is spread. Neighbours with the same lines form
    one run; runs get consecutive numbers, and what lies beside a run is found by joins on those numbers.
    """
    keyed = pages.withColumn("same", F.struct("host", F.size("lines").alias("n"), F.xxhash64("lines").alias("a"), F.xxhash64(F.reverse("lines"), F.lit(3)).alias("b")))
    run = keyed.repartitionByRange("host", "path", "page_id", "key").sortWithinPartitions("host", "path", "page_id", "key")
    run = write_table(run.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "lines")
    within, parts = Window.partitionBy("part").orderBy("at"), Window.orderBy("part")
    edge = run.groupBy("part").agg(F.max_by("same", "at").alias("tail")).select("part", F.lag("tail").over(parts).alias("tail"))
    begun = run.join(F.broadcast(edge), "part").withColumn("begins", (~F.coalesce(F.lag("same").over(within), F.col("tail")).eqNullSafe(F.col("same"))).cast("long")).drop("tail", "same")
    before = begun.groupBy("part").agg(F.sum("begins").alias("begins")).select("part", F.coalesce(F.sum("begins").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = begun.join(F.broadcast(before), "part").withColumn("n", F.col("base") + F.sum("begins").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    run = write_table(run.select("key", "twin", "host", "path", "lines", "n"), "runs")
    # all pages of a run have its lines, and its paths are in order
    side = run.groupBy("n").agg(F.any_value("host").alias("h"), F.min("path").alias("first"), F.max("path").alias("last"), F.any_value("lines").alias("l"), F.count("*").alias("copies"))
    side = write_table(side, "sides")
    beside = side.select("n", "h", "copies")
    for step, name, p in ((1, "prev", "last"), (-1, "next", "first")):
        s = side.select((F.col("n") + step).alias("n"), F.struct("h", F.col(p).alias("p"), "l").alias(name))
        beside = beside.join(s, "n", "left").withColumn(name, F.when(F.col(f"{name}.h") == F.col("h"), F.col(name)))
    beside = write_table(beside.where("prev is not null or next is not null").drop("h"), "beside")
    out = spread(run, beside, ["n"], hot_rows).where("prev is not null or next is not null")

    def start(name: str):
        return F.expr(f"case when {name} is null then -1 else aggregate(sequence(1, least(length(path), length({name}.p)) + 1), 0, (a, i) -> if(a = i - 1 and i <= length(path) and substring(path, 1, i) = substring({name}.p, 1, i), i, a)) end")

    return out.select("key", "twin", "lines", F.when(start("next") > start("prev"), F.col("next.l")).otherwise(F.coalesce(F.col("prev.l"), F.col("next.l"))).alias("other"))


def main_text(pages: DataFrame, broadcast_rows: int = 100_000, hot_rows: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id long, url string, html string; others aren't read).

    A page's blocks are aligned, line by line, with those of the page of its host that is nearest by URL path, of
    the pages with other lines, and lines on the longest common subsequence are deleted. Markup settles what that
    can't: lines within an article or main element stay though the other page has them, and lines go that only this
    page has in navigation, headers, footers, asides, forms, hidden elements, or those whose class, id or role names an
    advert, notice, menu, sidebar, comments and the like (within an article: only where that is a whole name). Scripts,
    styles and other elements without prose are no lines. A page with no other on its host, or without a host, is left to markup.
    Null and empty html give an empty text; a null url has the empty host. Rows with equal page_id are separate; equal rows have equal texts.

    Pages are compared by hashes of their lines, and parsed again for their text; what is deleted comes to them by
    broadcast where it is at most broadcast_rows rows, else by a join.
    """
    own = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("key", F.xxhash64("page_id", "url", "html")).withColumn("twin", F.xxhash64("html", F.lit(11), "url"))
    parsed = own.select("key", "twin", "page_id", _host().alias("host"), _path().alias("path"), "html").mapInArrow(tidied(_parse), PARSED)
    gone = _nearest(parsed, hot_rows).mapInArrow(tidied(_difference), "key long, twin long, gone array<int>")
    gone = write_table(gone.groupBy("key", "twin").agg(F.any_value("gone").alias("gone"), F.count("*").alias("copies")), "gone")
    if gone.count() <= broadcast_rows:
        settled = own.join(F.broadcast(gone.drop("copies")), ["key", "twin"], "left")
    else:
        settled = spread(own, gone, ["key", "twin"], hot_rows)
    done = settled.select("page_id", "url", "html", "gone").mapInArrow(tidied(_settle), KEPT)
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
