"""Removal of repeated substrings by interval expansion on Burrows-Wheeler transforms.

Each byte that is covered by a ``LENGTH``-byte string which also starts earlier (in a document of smaller doc_id,
or in the same document before) is removed. Strings never cross documents and are judged on the input.

No transform can hold a whole corpus, so equal strings are first brought together. Every string has an anchor, the
smallest hash among its short grams; equal strings have equal anchors. Neighbouring strings with one anchor form a
segment, and a segment whose anchor occurs once is dropped at once. Segments with equal anchors (64 bits) and equal
contents (64 bits more) are then merged to the first of them, the others being repeats as a whole. What is left,
different segments with one anchor, is dealt by anchor into texts of bounded size. Over each text a suffix order of
bounded depth gives the Burrows-Wheeler transform, and a breadth-first backward extension, starting from the strings
of ``SEED`` bytes, finds where neighbouring suffixes have a common prefix of ``SEED``, one more, ... bytes, until the
length reaches ``LENGTH``. Suffixes not parted by then begin with the same string; all but the first of them are
repeats. An anchor with more than ``HOT`` different segments, such as that of a line which a third of all documents
have, is not gathered but split by longer anchors: its segments are cut into pieces of at most ``FINE`` strings, and
what all strings of a piece have in common is the longer anchor. The pieces go the same way once more; where even
such an anchor has more than ``HOT`` different pieces, the anchors are the whole strings.

Defined cases: a null text is empty; texts under ``LENGTH`` bytes are left whole; documents without an id come after
all others, in the order of a hash, and are known by 86 bits of their texts' hash (ids are taken to be under
``NO_ID``); rows that repeat a doc_id with the same text count as one document and are all cut alike, different texts
under one doc_id are told apart by 24 bits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.session import Scratch, cut, stored

LENGTH = 100
GRAM = 16
SEED = 7
HOT = 2_000
FINE = 8
TEXT_BYTES = 128 << 10
CHUNK_BYTES = 64 << 10
#: From here on up are the numbers of documents without an id.
NO_ID = 1 << 62
# A segment's place is one number: 24 bits of its text's hash, its start, and its number of strings less one.
START_SHIFT, TEXT_SHIFT = 7, 38
START_MASK, RUN_MASK = (1 << 31) - 1, (1 << START_SHIFT) - 1

ODD1, ODD2, ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# --- segments --------------------------------------------------------------------------------------------------


def gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes (8, 16, 32, ...) from every position; what lies beyond the end is zero."""
    padded = np.zeros(len(flat) + 16, np.uint8)
    padded[: len(flat)] = flat
    h = np.empty(len(flat), np.uint64)
    for k in range(8):
        part = h[k::8]
        part[:] = padded[k : k + 8 * len(part)].view(np.uint64)
    h *= ODD1
    h ^= h >> np.uint64(29)
    step = 8
    while step < gram:
        after = np.zeros_like(h)
        after[: max(0, len(h) - step)] = h[step:]
        after ^= after >> np.uint64(31)
        h = h * ODD2 + after * ODD3
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def segments_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's number, start, run, anchor) of all segments: ``run`` strings from ``start`` on have the anchor."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(flat) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = gram_hashes(flat, gram)
    bits = np.uint64(max(1, len(flat)).bit_length())
    keys = ((hashes * ODD3) >> bits << bits) | np.arange(len(flat), dtype=np.uint64)  # ties go to the first
    reach, want = 1, length - gram + 1
    while 2 * reach <= want:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if reach < want:
        keys = np.minimum(keys[: len(keys) - (want - reach)], keys[want - reach :])
    at = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[: len(flat) - length + 1]
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= ends[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    firsts = np.flatnonzero(new & inside)
    # a run ends where the next begins or where its text has no more room for a string
    stops = np.append(np.flatnonzero(new), len(at))
    nexts = stops[np.searchsorted(stops, firsts, "right")]
    runs = np.minimum(nexts, ends[owner[firsts]] - length + 1) - firsts
    return owner[firsts], firsts - (ends - sizes)[owner[firsts]], runs, hashes[at[firsts]].view(np.int64)


def _chunks(bodies: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in chunks of about ``CHUNK_BYTES``, with the number of the first."""
    first, held, size = 0, [], 0
    for i in range(len(bodies)):
        held.append(bodies[i].as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def doc_number(body: str | Column = "body") -> Column:
    """A document's place in the order: its id, or behind all ids 62 bits of its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long").bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(1), body), 2)))


def text_mark(body: str | Column = "body") -> Column:
    """24 bits of the text's hash, which tell apart texts of one number."""
    return F.shiftrightunsigned(F.xxhash64(body), 40)


def keyed(docs: DataFrame) -> DataFrame:
    """doc (its number), mark and body."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(doc_number(body).alias("doc"), text_mark(body).alias("mark"), body.alias("body"))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(segments_of(texts, length)[3])], ["anchor"])

    return keyed(docs).select("body").mapInArrow(find, "anchor long")


def segments(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, content, doc, place) of every segment; ``content`` is the hash of its bytes."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in _chunks(batch.column(2)):
                owner, start, run, anchor = segments_of(texts, length)
                spans = zip(owner.tolist(), start.tolist(), (start + run + length - 1).tolist(), strict=True)
                content = np.array([xxhash.xxh3_64_intdigest(texts[o][a:b]) for o, a, b in spans], np.uint64).view(np.int64)
                place = marks[first + owner] << TEXT_SHIFT | start << START_SHIFT | (run - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, content, docs_[first + owner], place)], ["anchor", "content", "doc", "place"])

    return keyed(docs).mapInArrow(find, "anchor long, content long, doc long, place long")


# --- one text --------------------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``codes`` (0 to 511) ordered by their first ``depth`` codes at least, by prefix doubling.

    Also, for each slot, whether its suffix and the one before differ in their first ``SEED`` codes.
    """
    n = len(codes)
    known = SEED
    padded = np.zeros(n + known, np.int64)
    padded[:n] = codes
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key).astype(np.int32)
    sorted_key = key[order]
    rank = np.empty(n + 1, np.int64)  # the slot where a suffix's group begins; beyond the end, before all
    rank[n] = -1
    opens = np.ones(n, bool)
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=opens[1:])
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    seeds = opens
    tied = ~opens
    tied[:-1] |= ~opens[1:]
    slots = np.flatnonzero(tied)
    while known < depth and len(slots):
        members = order[slots]
        pair = rank[members] * (n + 1) + rank[np.minimum(members + known, n)] + 1
        inner = np.argsort(pair)
        members, pair = members[inner], pair[inner]
        order[slots] = members
        first = np.ones(len(slots), bool)
        np.not_equal(pair[1:], pair[:-1], out=first[1:])
        rank[members] = np.maximum.accumulate(np.where(first, slots, 0))
        tied = ~first  # only suffixes that are not alone yet are ordered further
        tied[:-1] |= ~first[1:]
        slots = slots[tied]
        known *= 2
    return order, seeds


def parted_below(codes: np.ndarray, order: np.ndarray, seeds: np.ndarray, length: int) -> np.ndarray:
    """For each slot of ``order`` whether its suffix and the one before have a common prefix under ``length``.

    Interval expansion: an interval holds the suffixes that begin with one string, at first the strings of ``SEED``
    codes. The transform's codes inside it lead to the intervals of all strings one code longer at the front; where
    such an interval begins at a slot not yet parted, the common prefix there is exactly the string's length, and
    the interval is expanded in turn. Strings are not expanded over a separator (code 0).
    """
    n = len(codes)
    transform = codes[order - 1].astype(np.uint16)
    by_code = np.argsort(transform, kind="stable").astype(np.int32)
    leads = np.empty(n, np.int32)  # the slot of the suffix one code longer
    leads[by_code] = np.arange(n, dtype=np.int32)
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)  # neighbours with the same code
    same = transform[by_code[1:]] == transform[by_code[:-1]]
    before[by_code[1:][same]] = by_code[:-1][same]
    after[by_code[:-1][same]] = by_code[1:][same]
    parted = seeds.copy()
    low = np.flatnonzero(seeds).astype(np.int32)
    high = np.append(low[1:], n).astype(np.int32)
    for _ in range(SEED, length):
        widths = high - low
        total = int(widths.sum())
        if not total:
            break
        ahead = np.cumsum(widths) - widths
        slots = np.arange(total, dtype=np.int32) + np.repeat((low - ahead).astype(np.int32), widths)
        text = transform[slots] > 0
        starts = np.sort(leads[slots[text & (before[slots] < np.repeat(low, widths))]])
        stops = np.sort(leads[slots[text & (after[slots] >= np.repeat(high, widths))]]) + 1
        fresh = ~parted[starts]
        low, high = starts[fresh], stops[fresh]
        parted[low] = True
    return parted


def repeated_in(parts: list[bytes], owners: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part's number, offset) of every string in ``parts`` that starts earlier too.

    ``owners`` order the documents of the parts, ``starts`` are the parts' places in them.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer(b"\x00".join([*parts, b""]), np.uint8)
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    codes = np.where(offset == sizes[part], 0, flat.astype(np.int64) + 1)
    order, seeds = suffix_order(codes, length)
    groups = np.cumsum(parted_below(codes, order, seeds, length))
    whole = (offset + length <= sizes[part])[order]
    order, groups = order[whole], groups[whole]
    if not len(order):
        return order, order
    where = owners[part[order]] << 32 | (starts[part[order]] + offset[order])
    opens = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    first = np.minimum.reduceat(where, opens)
    later = where > np.repeat(first, np.diff(np.append(opens, len(order))))
    return part[order[later]], offset[order[later]]


def _runs(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """The strings at (doc, mark, start) as (doc, mark, first byte, end) of unbroken runs of starts."""
    by = np.lexsort((start, mark, doc))
    doc, mark, start = doc[by], mark[by], start[by]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], mark[at], start[at], start[last] + length] if len(doc) else [doc, mark, start, start]


SPANS = "doc long, mark long, start long, stop long"


def _spans_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "mark", "start", "stop"])


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> TEXT_SHIFT, (place >> START_SHIFT) & START_MASK


def _expanded(given: DataFrame, length: int) -> DataFrame:
    """Repeats among different segments with one anchor: (anchor, doc, place, body), anchors' rows together."""

    def expand(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        doc = np.array([r[1] for r in rows], np.int64)
        mark, start = _unpacked(np.array([r[2] for r in rows], np.int64))
        _, owners = np.unique(np.stack([doc, mark]), axis=1, return_inverse=True)
        part, offset = repeated_in([r[3] for r in rows], owners.ravel().astype(np.int64), start, length)
        return _spans_batch(_runs(doc[part], mark[part], start[part] + offset, length))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TEXT_BYTES and row[0] != held[-1][0]:
                    yield expand(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield expand(held)

    return given.select("anchor", "doc", "place", "body").mapInArrow(run, SPANS)


def _whole_strings(given: DataFrame, length: int) -> DataFrame:
    """(anchor, content, doc, place) of every string of segments (doc, place, body): the longest anchors there are.

    Every string is a row, and nothing is gathered.
    """

    def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                rows = batch.slice(a, 2_000)
                doc, place = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                owner, offset, digest = [], [], []
                for i, body in enumerate(rows.column(2).to_pylist()):
                    n = len(body) - length + 1
                    owner += [i] * n
                    offset += range(n)
                    digest += [xxhash.xxh3_128_digest(body[k : k + length]) for k in range(n)]
                pair = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                mark, start = _unpacked(place[owner])
                spot = mark << TEXT_SHIFT | (start + np.array(offset, np.int64)) << START_SHIFT
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair[:, 0].copy(), pair[:, 1].copy(), doc[owner], spot)], ["anchor", "content", "doc", "place"])

    return given.select("doc", "place", "body").mapInArrow(strings, "anchor long, content long, doc long, place long")


# --- the whole table -------------------------------------------------------------------------------------------


def _bodies(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, many, doc, place, body) for ``wanted`` (anchor, many, doc, place): the segments' bytes.

    Rows that repeat a document give its segments again, at the same places, which repeats nothing.
    """
    mark = F.shiftright("place", TEXT_SHIFT).alias("w_mark")
    lists = wanted.select(F.col("doc").alias("w_doc"), mark, F.struct("anchor", "many", "place").alias("s")).groupBy("w_doc", "w_mark").agg(F.collect_list("s").alias("s"))
    sources = keyed(docs).join(lists, (F.col("doc") == F.col("w_doc")) & (F.col("mark") == F.col("w_mark")))

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, body, own = (batch.column(k)[i].as_py() for k in range(3))
                rows = []
                for s in own:
                    start, run = (s["place"] >> START_SHIFT) & START_MASK, (s["place"] & RUN_MASK) + 1
                    rows.append((s["anchor"], s["many"], doc, s["place"], body[start : start + run + length - 1]))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "many", "doc", "place", "body"])

    return sources.select("doc", "body", "s").mapInArrow(slices, "anchor long, many boolean, doc long, place long, body binary")


def _finer(bodies: DataFrame, length: int) -> DataFrame:
    """(anchor, content, doc, place, body) of the pieces of segments (anchor, doc, place, body).

    A string's piece goes by the distance from its start to the anchoring gram, in steps of ``FINE``, so equal
    strings are in pieces of the same kind; all strings of a kind hold the same ``length - FINE + 1`` bytes.
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for anchor, doc, place, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = gram_hashes(np.frombuffer(body, np.uint8), GRAM).view(np.int64)
                gram = int((grams[: len(body) - GRAM + 1] == anchor).argmax())
                mark, start = place >> TEXT_SHIFT, (place >> START_SHIFT) & START_MASK
                run, at = (place & RUN_MASK) + 1, 0
                while at < run:
                    kind = (gram - at) // FINE
                    end = min(run, gram - kind * FINE + 1)
                    common = gram - kind * FINE
                    key = xxhash.xxh3_64_intdigest(body[common : common + length - FINE + 1], seed=kind)
                    piece = body[at : end + length - 1]
                    rows.append((key - (1 << 63), xxhash.xxh3_64_intdigest(piece) - (1 << 63), doc, mark << TEXT_SHIFT | (start + at) << START_SHIFT | (end - at - 1), piece))
                    at = end
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [*[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "content", "doc", "place", "body"])

    return bodies.select("anchor", "doc", "place", "body").mapInArrow(split, "anchor long, content long, doc long, place long, body binary")


def _spans_of(rows: DataFrame, length: int) -> DataFrame:
    """What whole segments (doc, place) cover."""
    start = F.shiftright("place", START_SHIFT).bitwiseAND(F.lit(START_MASK).cast("long"))
    run = F.col("place").bitwiseAND(F.lit(RUN_MASK).cast("long")) + 1
    return rows.select("doc", F.shiftright("place", TEXT_SHIFT).alias("mark"), start.alias("start"), (start + run + length - 1).alias("stop"))


def _merged(met: DataFrame, carried: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The first of equal segments with ``carried`` columns, and (doc, place) of the others, which repeat it."""
    first = F.min(F.struct("doc", "place", *carried))
    firsts = scratch.stored(met.groupBy("anchor", "content").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    several = firsts.filter("n > 1").select(F.col("anchor").alias("f_anchor"), F.col("content").alias("f_content"), F.col("first.doc").alias("f_doc"), F.col("first.place").alias("f_place"))
    same = (F.col("anchor") == F.col("f_anchor")) & (F.col("content") == F.col("f_content"))
    copies = met.join(several.hint("shuffle_hash"), same).filter(F.struct("doc", "place") > F.struct("f_doc", "f_place"))
    return firsts.select("anchor", "first.*"), copies.select("doc", "place")


def _contested(firsts: DataFrame, hot: int) -> DataFrame:
    """The segments whose anchor has others, with ``many``, whether it has more than ``hot``."""
    several = cut(firsts.groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("s_anchor"), (F.col("count") > hot).alias("many")))
    return firsts.join(several, F.col("anchor") == F.col("s_anchor")).drop("s_anchor")


def _by_anchor(rows: DataFrame) -> DataFrame:
    return rows.repartition("anchor").sortWithinPartitions("anchor")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc, mark, start, stop): bytes [start, stop) of the documents to remove; spans may overlap."""
    first_steps, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    shared = scratch.stored(anchors(docs, length).groupBy("anchor").count().filter("count > 1").select("anchor"))
    met = first_steps.stored(segments(docs, length).join(shared.hint("shuffle_hash"), "anchor", "left_semi"))
    firsts, copies = _merged(met, [], scratch)
    copies = scratch.stored(copies)
    first_steps.clear()
    bodies = scratch.stored(_bodies(docs, _contested(firsts, hot), length))
    pieces, piece_copies = _merged(scratch.stored(_finer(bodies.filter("many"), length)), ["body"], scratch)
    fine = scratch.stored(_contested(pieces, hot))
    _, string_copies = _merged(_whole_strings(fine.filter("many"), length), [], scratch)
    spans = stored(
        _spans_of(copies.unionByName(piece_copies).unionByName(string_copies), length)
        .unionByName(_expanded(_by_anchor(bodies.filter("NOT many")), length))
        .unionByName(_expanded(_by_anchor(fine.filter("NOT many")), length))
    )
    scratch.clear()
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (bytes) of every row."""
    spans = repeated_spans(docs, length)
    lists = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    lists = lists.select(F.col("doc").alias("s_doc"), F.col("mark").alias("s_mark"), "spans")
    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    rows = given.join(lists, (doc_number() == F.col("s_doc")) & (text_mark() == F.col("s_mark")), "left").select("doc_id", "body", "spans")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for i in range(batch.num_rows):
                body, spans_ = batch.column(1)[i].as_py(), batch.column(2)[i].as_py() or []
                left, done, n = [], 0, 0
                for a, b in sorted((s["start"], s["stop"]) for s in spans_):
                    if a > done or not n:
                        n += 1
                        left.append(body[done:a])
                    done = max(done, b)
                left.append(body[done:])
                kept.append(b"".join(left))
                sizes.append(len(body))
                removed.append(len(body) - len(kept[-1]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
