"""Removal of repeated passages by word: matching statistics of streamed texts on full-text indexes of shards.

A window is ``WINDOW`` consecutive words of one document. Each word in a window whose words also start earlier (in a
document of smaller doc_id, or in the same document before) is removed; windows are judged on the input.

No index can hold a whole corpus, and no text should be streamed through all indexes, so texts are dealt to shards
by what can match. Every window has an anchor, the smallest hash among its runs of ``GRAM`` words; equal windows have
equal anchors. Neighbouring windows with one anchor are a segment; segments whose anchor occurs once are let go, the
others are sent to their anchor's shard with their words. There the first segment of each anchor is indexed
(``WordIndex``: a Burrows-Wheeler transform in a wavelet tree) and all others are streamed through it. A place whose
matching statistics reach ``WINDOW`` repeats an earlier window. What is not fully matched is left for the next
index, which takes the first two of each anchor, then four, and so on, so the number of indexes grows with the
logarithm of the different segments. Windows that repeat within an index show as intervals of its suffix order.

An anchor with more than ``HOT`` segments is split into blocks by a hash of their places, and each block is worked on
like an anchor of its own. Windows that are the first of their block may still have come earlier in another; these
few are compared as whole windows, a row each, by a grouping that keeps only the first.

Defined cases: a null text has no words; documents with fewer than ``WINDOW`` words are left whole; documents without
an id come after all others, in the order of a hash of their texts; rows that repeat a doc_id with the same text count
as one document and are all cut alike, different texts under one doc_id are told apart by 24 bits of a hash. Words over
``LONG`` bytes are compared by 128-bit hashes, all others byte by byte. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.suffix_dedup import RUN_MASK, START_MASK, START_SHIFT, TEXT_SHIFT, doc_number, keyed, text_mark
from talweg.llm.word_index import WordIndex
from talweg.session import Scratch, stored

WINDOW = 20
GRAM = 4
HOT = 2_000
LONG = 32
CHUNK_BYTES = 256 << 10
SHARD_WORDS, SHARD_ROWS = 1 << 17, 1 << 16
ORDER_BITS = np.uint64(28)

ODD1, ODD2, ODD3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


# --- words -------------------------------------------------------------------------------------------------------


def word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes begin and end."""
    space = np.ones(len(flat) + 2, bool)
    space[1:-1] = IS_SPACE[flat]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def _loads(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a number; zeros lie beyond the end."""
    padded = np.zeros(len(flat) + 8, np.uint8)
    padded[: len(flat)] = flat
    return np.lib.stride_tricks.as_strided(padded, (len(flat) + 1, 8), (1, 1))


def _part(rows: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of words; what lies beyond their ends is zero."""
    value = rows[begins].view(np.uint64).ravel()
    keep = np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)
    return np.where(sizes >= 8, value, value & ((np.uint64(1) << (keep & np.uint64(63))) - np.uint64(1)))


def word_hashes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; those over ``LONG`` bytes by XXH3."""
    sizes = ends - begins
    h = sizes.astype(np.uint64) * ODD1
    rows = _loads(flat)
    own = np.arange(len(begins))
    for at in range(0, LONG, 8):
        own = own[sizes[own] > at] if at else own
        if not len(own):
            break
        x = (h[own] ^ _part(rows, begins[own] + at, sizes[own] - at)) * ODD2
        x ^= x >> np.uint64(29)
        x *= ODD3
        h[own] = x ^ x >> np.uint64(32)
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(flat[begins[i] : ends[i]].tobytes())
    return h


def word_numbers(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 on for words of at most ``LONG`` + 1 bytes, equal for equal words only, and one more than the largest."""
    hashes = word_hashes(flat, begins, ends)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    same = first[number]
    sizes = ends - begins
    alike = bool((sizes == sizes[same]).all())
    rows, own = _loads(flat), np.arange(len(begins))
    for at in range(0, LONG + 8, 8):
        own = own[sizes[own] > at]
        if not alike or not len(own):
            break
        alike = bool((_part(rows, begins[own] + at, sizes[own] - at) == _part(rows, begins[same[own]] + at, sizes[same[own]] - at)).all())
    if not alike:  # a clash of hashes
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(flat[a:b].tobytes(), len(known)) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
    return number.astype(np.int64) + 1, int(number.max(initial=-1)) + 2


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


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, where its words begin and end, and how many words come before each text (and all)."""
    flat = np.frombuffer(b" ".join(texts), np.uint8)
    begins, ends = word_bounds(flat)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    ahead = np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))
    return flat, begins, ends, ahead


# --- segments ----------------------------------------------------------------------------------------------------


def segments_of(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's number, first word, run, anchor) of all segments: ``run`` windows from there on have the anchor."""
    flat, begins, ends, ahead = _words_of(texts)
    if len(begins) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = word_hashes(flat, begins, ends)
    n = len(h) - gram + 1
    grams = np.zeros(n, np.uint64)
    for k in range(gram):
        grams = (grams ^ h[k : k + n]) * ODD1
        grams ^= grams >> np.uint64(31)
    # ties go to the first, in whatever chunk a window stands
    keys = (grams * ODD3) >> ORDER_BITS << ORDER_BITS | np.arange(n, dtype=np.uint64)
    reach, want = 1, window - gram + 1
    while 2 * reach <= want:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    if reach < want:
        keys = np.minimum(keys[: len(keys) - (want - reach)], keys[want - reach :])
    at = (keys & ((np.uint64(1) << ORDER_BITS) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(ahead))[: len(at)]
    inside = np.arange(len(at)) + window <= ahead[owner + 1]
    opens = np.ones(len(at), bool)
    opens[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    firsts = np.flatnonzero(opens & inside)
    stops = np.append(np.flatnonzero(opens), len(at))
    runs = np.minimum(stops[np.searchsorted(stops, firsts, "right")], ahead[owner[firsts] + 1] - window + 1) - firsts
    return owner[firsts], firsts - ahead[owner[firsts]], runs, grams[at[firsts]].view(np.int64)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(segments_of(texts, window)[3])], ["anchor"])

    return keyed(docs).select("body").mapInArrow(find, "anchor long")


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, place) of every segment; ``place`` is the mark of its text, its first word and its run."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in _chunks(batch.column(2)):
                owner, start, run, anchor = segments_of(texts, window)
                place = marks[first + owner] << TEXT_SHIFT | start << START_SHIFT | (run - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, docs_[first + owner], place)], ["anchor", "doc", "place"])

    return keyed(docs).mapInArrow(find, "anchor long, doc long, place long")


def _shortened(words: bytes) -> bytes:
    """The words; hashes, of one byte more than ``LONG``, stand for longer ones."""
    return b" ".join(w if len(w) <= LONG else b"#" + xxhash.xxh3_128_hexdigest(w).encode() for w in words.split())


BODIES = "anchor long, salt int, hot boolean, doc long, place long, body binary"


def bodies(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the segments ``wanted``, lists ``s`` of (anchor, salt, hot, place) by w_doc and w_mark, cut from their documents.

    Rows that repeat a document give its segments again, at the same places.
    """
    sources = keyed(docs).join(wanted, (F.col("doc") == F.col("w_doc")) & (F.col("mark") == F.col("w_mark")))

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(1)):
                flat, begins, ends, ahead = _words_of(texts)
                lists = batch.column(2).slice(first, len(texts))
                own, owner = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
                place = own.field("place").to_numpy()
                start = ahead[owner] + ((place >> START_SHIFT) & START_MASK)
                stop = start + (place & RUN_MASK) + window
                held = flat.tobytes()
                cuts = [held[a:b] for a, b in zip(begins[start].tolist(), ends[stop - 1].tolist(), strict=True)]
                long = np.concatenate([[0], np.cumsum(ends - begins > LONG)])
                for i in np.flatnonzero(long[start] < long[stop]).tolist():
                    cuts[i] = _shortened(cuts[i])
                doc = batch.column(0).slice(first, len(texts)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([own.field("anchor"), own.field("salt"), own.field("hot"), doc, own.field("place"), pa.array(cuts, pa.binary())], [c.split()[0] for c in BODIES.split(", ")])

    return sources.select("doc", "body", "s").mapInArrow(slices, BODIES)


# --- shards ------------------------------------------------------------------------------------------------------


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for ``sizes[0]`` numbers, then the same for the next."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def repeated_in(groups: np.ndarray, texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For segments in order, whose equal ``groups`` stand together: which windows also start earlier.

    Gives, for each word, whether a window that starts there does, and the number of words before each text (and all).
    Equal texts of a group have the same matching statistics and are streamed once.
    """
    equal = texts.dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first, kind = np.unique(groups * len(texts) + equal, return_index=True, return_inverse=True)
    flat, begins, ends, kind_ahead = _words_of(texts.take(pa.array(first)).to_pylist())
    codes, sigma = word_numbers(flat, begins, ends)
    kind_sizes = np.diff(kind_ahead)
    sizes = kind_sizes[kind]
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    again = np.zeros(ahead[-1], bool)
    alive, taken = np.arange(len(texts)), 1
    while len(alive):
        own = groups[alive]
        opens = np.concatenate([[True], own[1:] != own[:-1]])
        nth = np.arange(len(alive)) - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        batch, rest = alive[nth < taken], alive[nth >= taken]
        words = codes[_places(kind_ahead[kind[batch]], sizes[batch])]
        slots = np.arange(len(words)) + np.repeat(np.arange(len(batch)), sizes[batch])
        used = np.unique(words)
        short = np.full(sigma, -1, np.int64)
        short[used] = np.arange(1, len(used) + 1)
        text = np.zeros(len(words) + len(batch), np.int64)  # each segment ends in a 0
        text[slots] = short[words]
        index = WordIndex(text, len(used) + 1, window)
        again[_places(ahead[batch], sizes[batch])] |= index.own_repeats()[slots]
        if not len(rest):
            break
        streamed, own = np.unique(kind[rest], return_inverse=True)
        stops = np.cumsum(kind_sizes[streamed])
        found = index.matches(short[codes[_places(kind_ahead[streamed], kind_sizes[streamed])]], stops) >= window
        again[_places(ahead[rest], sizes[rest])] |= found[_places((stops - kind_sizes[streamed])[own], sizes[rest])]
        left = np.add.reduceat(~again[_places(ahead[rest], sizes[rest])], np.cumsum(sizes[rest]) - sizes[rest])
        alive, taken = rest[left >= window], 2 * taken  # the last words start no window
    return again, ahead


def shards(batches: Iterable[pa.RecordBatch], window: int, most_words: int, most_rows: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor and salt as tables of whole groups, closed after so many words of different texts, or rows."""
    held: list[pa.RecordBatch] = []
    size, count, last = 0, 0, None
    for batch in batches:
        anchor, salt, place = (batch.column(c).to_numpy() for c in ("anchor", "salt", "place"))
        if not len(anchor):
            continue
        new = np.concatenate([[last != (anchor[0], salt[0])], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
        # blocks of one anchor must not meet: their segments are not in order
        apart = np.concatenate([[last is not None and last[0] == anchor[0]], anchor[1:] == anchor[:-1]])
        # equal texts of a group are streamed once
        equal = batch.column("body").dictionary_encode().indices.to_numpy().astype(np.int64)
        firsts = np.unique(np.cumsum(new) * len(new) + equal, return_index=True)[1]
        words = np.zeros(len(new) + 1, np.int64)
        words[firsts + 1] = (place[firsts] & RUN_MASK) + window
        words, begin = np.cumsum(words), 0
        opens = np.flatnonzero(new)
        for at, ahead, split in zip(opens.tolist(), words[opens].tolist(), apart[opens].tolist(), strict=True):
            if split or size + ahead >= most_words or count + at >= most_rows:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, size, count, begin = [], -ahead, -at, at
        held.append(batch.slice(begin))
        size, count, last = size + int(words[-1]), count + len(new), (anchor[-1], salt[-1])
    if held:
        yield pa.Table.from_batches(held)


FOUND = "doc long, place long, window binary"


def matched(given: DataFrame, window: int) -> DataFrame:
    """Repeats among segments with one anchor and salt, as places whose run is that of the windows, and of hot anchors
    also the windows that are the first of their block, one by one, with their words."""

    def search(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        anchor, salt, doc, place = (rows.column(c).to_numpy() for c in ("anchor", "salt", "doc", "place"))
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])
        again = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        if again.any():  # rows that repeat a document
            rows, new, doc, place = rows.filter(pa.array(~again)).combine_chunks(), new[~again], doc[~again], place[~again]
        hot, texts = rows.column("hot").to_numpy(), rows.column("body").chunk(0)
        again, ahead = repeated_in(np.cumsum(new), texts, window)
        owner = np.repeat(np.arange(len(doc)), np.diff(ahead))
        offset = np.arange(len(again)) - ahead[owner]
        hits = np.flatnonzero(again)
        opens = np.ones(len(hits), bool)
        opens[1:] = (hits[1:] != hits[:-1] + 1) | (owner[hits[1:]] != owner[hits[:-1]])
        first = hits[opens]
        runs = np.diff(np.append(np.flatnonzero(opens), len(hits)))
        left = np.flatnonzero(hot[owner] & ~again & (offset + window <= np.diff(ahead)[owner]))
        windows = [None] * len(first)
        for own, starts in groupby(zip(owner[left].tolist(), offset[left].tolist(), strict=True), itemgetter(0)):
            words = texts[own].as_py().split()
            windows += [b" ".join(words[a : a + window]) for _, a in starts]
        at = np.concatenate([first, left])
        begin = (place[owner[at]] & ~np.int64(RUN_MASK)) + (offset[at] << START_SHIFT)
        columns = [pa.array(doc[owner[at]]), pa.array(begin | np.concatenate([runs - 1, left * 0])), pa.array(windows, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc", "place", "window"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(search, shards(batches, window, SHARD_WORDS, SHARD_ROWS))

    start = F.col("place").bitwiseAND(F.lit(START_MASK << START_SHIFT).cast("long"))
    order = ["anchor", "salt", "doc", F.shiftright("place", TEXT_SHIFT), start]
    return given.repartition("anchor", "salt").sortWithinPartitions(*order).mapInArrow(run, FOUND)


def repeated_places(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(doc, place) of all runs of windows that start earlier too."""
    scratch = Scratch(docs.sparkSession)
    shared = scratch.stored(anchors(docs, window).groupBy("anchor").count().filter("count > 1").select(F.col("anchor").alias("s_anchor"), "count"))
    met = segments(docs, window).join(shared.hint("shuffle_hash"), F.col("anchor") == F.col("s_anchor"))
    blocks = F.ceil(F.col("count") / hot).cast("int")
    salt = F.when(F.col("count") > hot, F.pmod(F.hash("doc", "place"), blocks)).otherwise(0)
    mark = F.shiftright("place", TEXT_SHIFT)
    wanted = met.groupBy(F.col("doc").alias("w_doc"), mark.alias("w_mark")).agg(F.collect_list(F.struct("anchor", salt.alias("salt"), (F.col("count") > hot).alias("hot"), "place")).alias("s"))
    found = stored(matched(bodies(docs, scratch.stored(wanted), window), window))
    scratch.clear()
    # first in their block, but perhaps not of all
    windows = found.filter("window IS NOT NULL")
    place = F.struct("doc", "place")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("window").alias("f_window"), "first")
    later = windows.join(first, F.col("window") == F.col("f_window")).filter(place > F.col("first"))
    return found.filter("window IS NULL").drop("window").unionByName(later.select("doc", "place"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8 bytes of the words left, joined by one space) of every row."""
    places = repeated_places(docs, window)
    lists = places.groupBy(F.col("doc").alias("s_doc"), F.shiftright("place", TEXT_SHIFT).alias("s_mark")).agg(F.collect_list("place").alias("places"))
    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    rows = given.join(lists, (doc_number() == F.col("s_doc")) & (text_mark() == F.col("s_mark")), "left").select("doc_id", "body", "places")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().split()
                left, done = [], 0
                for place in sorted(batch.column(2)[i].as_py() or []):  # of one text, so in the order of their starts
                    start = (place >> START_SHIFT) & START_MASK
                    left += words[done:start]
                    done = max(done, start + (place & RUN_MASK) + window)
                left += words[done:]
                kept.append(b" ".join(left))
                sizes.append(len(words))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept binary")
