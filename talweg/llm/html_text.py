"""Main text of web pages: page differencing against the pages of the nearest URLs.

A page's markup is read into lines, one for each paragraph, heading, list item and so on, wherever they are. Within
each host the pages are ordered by URL path, and each is compared with up to two pages before it and two after it:
the two pages' lines are aligned by a longest common subsequence, whatever the markup around them. A line that at
least two of those pages share (or the only one there is) and that four pages and at least half of the host's carry
belongs to the site and is deleted; one that is rarer on the host is a quotation or a copy and stays. A page that differs in less
than a tenth of its characters is a copy of this one, says nothing about the site, and is passed over.

Differencing finds what pages of a site have in common. It cannot see menus, adverts and footers that differ from
page to page, nor may it delete an article's own words because a neighbour quotes them. So what the page itself names
comes second: lines inside the element of the article stay, and lines in elements that are named as something else
(menu, header, footer, sidebar, notice, advert, form, reader comments) or hidden are left out. Inside an article that
takes a tag, or an unmistakable word in a class or role; an article's own header and headings stay.

The order of the pages is found on narrow rows, by range partitions of equal size, whose first and last rows are put
in order on their own, four for each partition; a host of any size is spread over many tasks. Pages are read once.

Defined cases: a null or empty html has an empty text; a page without a URL, or alone on its host, is not compared;
repeated rows are extracted each on its own; a tag or comment that the end of a page cuts off is dropped. Other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.session import cut, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOWHERE = ("", False, False, False)
OPEN, ARTICLE, NAMED = range(3)  # where a line is: unnamed, in the article, in what is named as something else
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "option": ("option", ("select",))}
#: Words in a class, id or role that say an element is not the article, where no element of the article is around it.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " notices alert newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs"
    " masthead footer comment comments commentlist reply replies respond disqus share sharing social related recommended widget widgets"
    " popup modal overlay toolbar pagination pager login search complementary contentinfo skip tags header head topbar top".split()
)
#: The same for a class or role inside the article: only words that name what an article never is.
INNER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo cookie cookies consent gdpr notice newsletter sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer comments commentlist replies disqus".split()
)
#: Words that name the element of the article, where no article or main element does.
MAIN_WORDS = frozenset("article post entry story content main articlebody".split())


def _words(attributes: dict[str, str], keys: tuple[str, ...]) -> set[str]:
    return {w.lower() for w in NAME.findall(" ".join(attributes.get(k, "") for k in keys))}


def _attributes(text: str) -> dict[str, str]:
    if "=" not in text and "hidden" not in text:
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, ``OPEN``, ``ARTICLE`` or ``NAMED``) of all lines in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, named as something else, inside the article, dropped from its line
    parts: list[str] = []
    linked = plain = 0
    in_link = 0
    seen_main = False

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, named, main, _ = stack[-1] if stack else NOWHERE
                menu = linked > 0 and plain == 0 and not main  # outside the article, nothing but links
                out.append((text, NAMED if named or menu else ARTICLE if main else OPEN))
            parts.clear()
        linked = plain = 0

    def close(k: int) -> None:
        nonlocal in_link
        in_link -= sum(t == "a" for t, *_ in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and not (stack and stack[-1][3]):
            text = page[at:stop]
            parts.append(text)
            if n := len(text.strip()):
                linked, plain = (linked + n, plain) if in_link else (linked, plain + n)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        end = bool(m[1] or m[4])
        if tag in RAW and not end:
            closing = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("td", "th"):
            parts.append(" ")
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in BLOCKS or k == len(stack) - 1:
                        close(k)
                    else:  # an inline element's end does not end the blocks inside it
                        in_link -= tag == "a"
                        del stack[k]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:  # an open paragraph ends where a block begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in CLOSES:
            what, scope = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in scope:
                    break
                if stack[k][0] == what:
                    close(k)
                    break
        if tag in VOID or (m[3] or m[6] or "").rstrip().endswith("/") and tag not in BLOCKS:
            continue
        attributes = _attributes(m[3] or m[6] or "")
        _, named, main, muted = stack[-1] if stack else NOWHERE
        was_named = named
        words = _words(attributes, ("class", "role") if main else ("class", "id", "role", "itemprop")) if attributes else set()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDING.search(attributes.get("style", ""))
        inner = main and (tag in LEFT_OUT or bool(words & INNER_WORDS) and tag not in HEADINGS)
        if tag in ("html", "body"):
            pass
        elif tag in ("article", "main"):
            if words & OTHER_WORDS:
                named = True
            elif not main:
                named = named and (seen_main or any(t in LEFT_OUT for t, *_ in stack))
                main = seen_main = not named
        elif main:
            named = named or bool(hidden) or inner
        else:
            named = named or bool(hidden) or tag in LEFT_OUT or tag == "header" or bool(words & OTHER_WORDS)
            main = not named and bool(words & MAIN_WORDS) and tag in ("div", "section", "td")
        in_link += tag == "a"
        stack.append((tag, named, main, muted or named and not was_named and tag not in BLOCKS))
    flush()
    return out


# --- alignment -------------------------------------------------------------------------------------------------


def _columns(rows: list[int], n: int, b: list[int]) -> np.ndarray:
    """lengths[j]: of the longest common subsequence of ``rows`` and the first j of ``b``; bit-parallel."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << n) - 1
    v = full
    for x in rows:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((~v & full).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(bits)])


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """The places in ``a`` of one longest common subsequence of ``a`` and ``b``, in space linear in both."""
    both = set(a) & set(b)
    left = [(i, x) for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    found: set[int] = set()
    work = [(left, right)]
    while work:
        one, two = work.pop()
        while one and two and one[0][1] == two[0]:
            found.add(one[0][0])
            one, two = one[1:], two[1:]
        while one and two and one[-1][1] == two[-1]:
            found.add(one[-1][0])
            one, two = one[:-1], two[:-1]
        if not one or not two:
            continue
        if len(one) == 1:
            if one[0][1] in two:
                found.add(one[0][0])
            continue
        half, n = len(one) // 2, len(two)
        before = _columns([x for _, x in one[:half]], n, two)
        after = _columns([x for _, x in reversed(one[half:])], n, two[::-1])[::-1]
        k = int((before + after).argmax())
        work += [(one[:half], two[:k]), (one[half:], two[k:])]
    return found


def site_lines(hashes: list[int], sizes: list[int], others: list[list[int]]) -> list[int]:
    """The places of the lines (hash, characters) that belong to the site, going by the nearest pages' hashes."""
    seen = np.zeros(len(hashes), np.int64)
    told = 0
    for other in others:
        shared = common_lines(hashes, other)
        if 10 * sum(sizes[i] for i in shared) <= 9 * sum(sizes):
            told += 1
            seen[list(shared)] += 1
    return np.flatnonzero(seen >= min(2, told)).tolist() if told else []


# --- Spark -----------------------------------------------------------------------------------------------------

NEAR = 2  # pages on either side
LEAST = 4  # pages that carry a line of the site


def neighbours(keys: DataFrame) -> DataFrame:
    """(uid, others): for each page (uid, host, path, value) the values of the nearest ones by path on its host.

    Up to ``NEAR`` before it, the nearest first, then as many after it; uid tells the pages apart.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["host", "path", "uid"]
    dealt = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    page = F.struct("host", "value")
    inside, across = Window.partitionBy("part").orderBy(*order), Window.orderBy(*order)
    steps = [(f"{side}{k}", shift, k) for side, shift in (("a", F.lag), ("b", F.lead)) for k in range(1, NEAR + 1)]
    near = lambda window: [shift(page, k).over(window).alias(name) for name, shift, k in steps]
    first, last = F.row_number().over(inside), F.row_number().over(Window.partitionBy("part").orderBy(*[F.desc(c) for c in order]))
    ends = cut(dealt.withColumns({"first": first, "last": last}).filter((F.col("first") <= NEAR) | (F.col("last") <= NEAR)))
    over = ends.select(F.col("uid").alias("end_uid"), *[c.alias(f"over_{name}") for c, (name, _, _) in zip(near(across), steps, strict=True)])  # four rows for each partition
    rows = dealt.select("uid", "host", *near(inside))
    both = rows.join(over, F.col("uid") == F.col("end_uid"), "left")
    found = [F.coalesce(name, f"over_{name}") for name, _, _ in steps]
    own = [F.when(f["host"] == F.col("host"), f["value"]) for f in found]
    return both.select("uid", F.array_compact(F.array(*own)).alias("others")).filter(F.size("others") > 0)


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    """An article's own lines are aligned among themselves."""
    return [xxhash.xxh3_64_intdigest(text, seed=where == ARTICLE) - (1 << 63) for text, where in lines]


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, hashes, sizes and body (places and texts, packed) of every row of ``pages``.

    ``host`` is empty without an address. The packed body holds the lines that may be the article's.
    """
    address = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    given = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.lower(F.regexp_extract(url, address, 1)).alias("host"), F.regexp_extract(url, address, 2).alias("path"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    kept = ["page_id", "url", "host", "path"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hashes, sizes, places, bodies = [], [], [], []
            for i in range(batch.num_rows):
                lines = lines_of(batch.column(4)[i].as_py())
                hashes.append(line_hashes(lines))
                sizes.append([len(text) for text, _ in lines])
                own = [k for k, (_, where) in enumerate(lines) if where != NAMED]
                places.append([k << 1 | (lines[k][1] == ARTICLE) for k in own])
                bodies.append(packer.compress("\n".join(lines[k][0] for k in own).encode("utf-8", "replace")))
            columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], [*kept, "hashes", "sizes", "places", "body"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return given.mapInArrow(read, f"page_id {kind}, url string, host string, path string, hashes array<long>, sizes array<int>, places array<int>, body binary")


def shared_lines(known: DataFrame) -> DataFrame:
    """(uid, gone): the places of the lines of pages (uid, host, path, hashes, sizes) that belong to their sites."""
    narrow = known.filter("host <> ''").select("uid", "host", "path", "hashes", "sizes")
    others = neighbours(narrow.select("uid", "host", "path", F.col("hashes").alias("value")))
    met = narrow.select("uid", "hashes", "sizes").join(others.withColumnRenamed("uid", "o_uid"), F.col("uid") == F.col("o_uid")).select("uid", "hashes", "sizes", "others")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [site_lines(*(batch.column(k)[i].as_py() for k in (1, 2, 3))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["uid", "gone"])

    aligned = stored(met.mapInArrow(compare, "uid long, gone array<int>").filter(F.size("gone") > 0))
    return frequent_lines(narrow, aligned)


def frequent_lines(narrow: DataFrame, aligned: DataFrame) -> DataFrame:
    """``aligned`` (uid, gone) with only those lines that ``LEAST`` and half of the pages (uid, host, hashes) of their host carry.

    Pages are counted for each host and line, but only for lines that alignment has found somewhere on the host.
    """
    own = narrow.select(F.col("uid").alias("n_uid"), "host", "hashes").join(aligned, F.col("n_uid") == F.col("uid"))
    each = own.select("uid", F.xxhash64("host").alias("h"), F.explode("gone").alias("place"), "hashes").select("uid", "h", "place", F.get("hashes", F.col("place")).alias("line"))
    each = stored(each)
    asked = each.select(F.col("h").alias("a_h"), F.col("line").alias("a_line")).distinct()
    carried = narrow.select(F.xxhash64("host").alias("h"), F.explode(F.array_distinct("hashes")).alias("line"))
    counts = carried.join(asked, (F.col("h") == F.col("a_h")) & (F.col("line") == F.col("a_line")), "left_semi").groupBy(F.col("h").alias("c_h"), F.col("line").alias("c_line")).agg(F.count(F.lit(1)).alias("carriers"))
    hosts = narrow.groupBy(F.xxhash64("host").alias("p_h")).agg(F.count(F.lit(1)).alias("pages"))
    met = each.join(counts, (F.col("h") == F.col("c_h")) & (F.col("line") == F.col("c_line"))).join(hosts, F.col("h") == F.col("p_h"))
    return met.filter((F.col("carriers") >= LEAST) & (2 * F.col("carriers") >= F.col("pages"))).groupBy("uid").agg(F.sort_array(F.collect_list("place")).alias("gone"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_lines, n_shared and n_named of every row of ``pages`` (page_id, url, html).

    ``n_shared`` counts the lines that differencing finds to be the site's, ``n_named`` those that only the names of
    their elements leave out.
    """
    known = stored(page_lines(pages).withColumn("uid", F.monotonically_increasing_id()))  # written, so the numbers stay
    gone = stored(shared_lines(known)).withColumnRenamed("uid", "g_uid")
    joined = known.join(gone, F.col("uid") == F.col("g_uid"), "left").select("page_id", "url", F.size("hashes").alias("n"), "places", "body", "gone")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                n, places, body, site = (batch.column(k)[i].as_py() for k in (2, 3, 4, 5))
                texts = unpacker.decompress(body).decode().split("\n") if places else []
                away = set(site or ())
                left = [t for p, t in zip(places, texts, strict=True) if p & 1 or p >> 1 not in away]
                own = {p >> 1 for p in places}
                out.append(("\n".join(left), n, n - len(left) - (n - len(own | away)), n - len(own | away)))
            text, n_lines, shared, named = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array(text, pa.string()), *(pa.array(c, pa.int64()) for c in (n_lines, shared, named))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "text", "n_lines", "n_shared", "n_named"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(finish, f"page_id {kind}, url string, text string, n_lines long, n_shared long, n_named long")
