"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' word shingles are winnowed (of every ``WINDOW`` neighbouring shingles the smallest hash is kept) into
an inverted index from hash to the places in templates, which is broadcast; the number of its entries is checked. A
document's shingles are winnowed alike, so a run of ``SHARED`` words that it has in common with a template always has
a fingerprint in common with it. Templates of fewer than ``SHORT`` words are also looked for by every two neighbouring
words, since a changed word leaves them no longer run. Fingerprints that meet near one diagonal make a candidate, and an alignment of the
whole template, in a band around the diagonal, gives the words matched and their span. A candidate is a match from
``min_coverage`` of the template's words on. Matches do not overlap: of several licenses on the same words the one
with most words is reported, so a licence is not taken for one that differs from it by a word.

Defined cases: a null or empty text has no match; templates of fewer than ``SHARED`` words cannot be looked for and
raise; equal templates are each reported; a document with several copies of a template has a match for each; rows
that repeat are each scanned. Columns named in ``keep`` are passed on, all others are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from talweg.llm.decontamination import CHUNK_BYTES, FOLD, MULTIPLIER, words_of

SHINGLE, WINDOW = 3, 2
SHARED = SHINGLE + WINDOW - 1
SHORT = 20  # words; of shorter templates every two neighbouring words are in the index
MAX_INDEX = 5_000_000
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the selected shingles of word numbers; number 0 is a word of no template."""
    n = len(ids) - SHINGLE + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        part = ids[k : k + n]
        hashes = hashes * MULTIPLIER + part
        known &= part > 0
    hashes ^= hashes >> np.uint64(31)
    hashes = np.where(known, hashes * MULTIPLIER, NEVER)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    places = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    places = places[hashes[places] != NEVER]
    return places, hashes[places]


MATCH, OTHER, NONE = 4, -1, -(1 << 40)  # scores in quarters


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(words matched, first, end): the best alignment of ``template`` with a run of ``words``.

    A match scores 1, a word put in, left out or changed -1/4. Word j of the text may meet word i of the template where
    j - i is within ``band`` of ``diagonal``. A row holds, for each place in the band, the score, the matches and where
    the run began; words put in are a running maximum along the row.
    """
    low, width, n = diagonal - band, 2 * band + 1, len(words)
    places = np.arange(width)
    began = low + places
    inside = (began >= 0) & (began <= n)
    score, matched = np.where(inside, 0, NONE), np.zeros(width, np.int64)
    padded = np.full(n + 2 * width + len(template), -1, np.int64)  # word j stands at j + width
    padded[width : width + n] = words
    for i, word in enumerate(np.asarray(template).tolist()):
        first = i + low  # the text's word at the row's first place
        a, b = max(0, min(width, -first)), max(0, min(width, n - first))  # places with a word
        same = np.zeros(width, bool)
        same[a:b] = padded[first + a + width : first + b + width] == word
        best = np.full(width, NONE)
        best[a:b] = score[a:b] + np.where(same[a:b], MATCH, OTHER)
        left = np.append(score[1:], NONE) + OTHER  # the template's word left out
        omit = left > best
        best = np.where(omit, left, best)
        from_ = np.where(omit, np.minimum(places + 1, width - 1), places)
        new_matched, new_began = matched[from_] + (same & ~omit), began[from_]
        if b > a:
            c = max(0, a - 1)
            keys = best[c:b] - OTHER * places[c:b]
            top = np.maximum.accumulate(keys)
            source = c + np.maximum.accumulate(np.where(keys == top, places[: b - c], 0))
            put_in = source != places[c:b]
            best[c:b] = np.where(put_in, best[source] + OTHER * (places[c:b] - source), best[c:b])
            new_matched[c:b], new_began[c:b] = new_matched[source], new_began[source]
        score, matched, began = np.maximum(best, NONE), new_matched, new_began
    k = int(score.argmax())
    if score[k] <= NONE // 2:
        return 0, 0, 0
    return int(matched[k]), int(began[k]), len(template) + low + k


def pair_hashes(ids: np.ndarray) -> np.ndarray:
    """The hash of each two neighbouring words; ``NEVER`` where one is in no template."""
    if len(ids) < 2:
        return np.zeros(0, np.uint64)
    hashes = (ids[:-1] + np.uint64(1)) * MULTIPLIER + ids[1:]
    hashes ^= hashes >> np.uint64(29)
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), hashes * MULTIPLIER, NEVER)


class Index:
    """The templates, their vocabulary and the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        split = {name: words_of(text.encode()) for name, text in templates.items()}
        if short := [name for name, words in split.items() if len(words) < SHARED]:
            raise ValueError(f"templates of fewer than {SHARED} words: {short}")
        self.number = {w: i for i, w in enumerate(sorted({w for words in split.values() for w in words}), start=1)}
        self.names = list(split)
        self.words = [np.array([self.number[w] for w in split[name]], np.int64) for name in self.names]
        entries: dict[int, list[tuple[int, int]]] = {}
        pairs: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for place, h in zip(*(x.tolist() for x in winnow(words.astype(np.uint64))), strict=True):
                entries.setdefault(h, []).append((t, place))
            if len(words) < SHORT:
                for place, h in enumerate(pair_hashes(words.astype(np.uint64)).tolist()):
                    pairs.setdefault(h, []).append((t, place))
        if sum(map(len, entries.values())) > MAX_INDEX:
            raise ValueError(f"the index has more than {MAX_INDEX} entries; scan with the templates in several parts")
        self.entries = entries
        self.hashes = np.array(sorted(entries), np.uint64)
        self.pairs = pairs
        self.pair_hashes = np.array(sorted(pairs), np.uint64)

    def candidates(self, places: np.ndarray, hashes: np.ndarray, pair_places: np.ndarray, pairs: np.ndarray) -> dict[int, list[int]]:
        """For each template the diagonals (text's place less template's) of one document's fingerprints and pairs."""
        found: dict[int, set[int]] = {}
        for entries, own, marks in ((self.entries, places, hashes), (self.pairs, pair_places, pairs)):
            for place, h in zip(own.tolist(), marks.tolist(), strict=True):
                for t, at in entries[h]:
                    found.setdefault(t, set()).add(place - at)
        return {t: sorted(d) for t, d in found.items()}

    def matches(self, words: np.ndarray, marks: tuple[np.ndarray, ...], min_coverage: float) -> list[tuple[int, int, int, int]]:
        """(template, words matched, first, end) of one document, by place; where matches overlap, that of most words."""
        own = []
        for t, diagonals in self.candidates(*marks).items():
            template = self.words[t]
            band = max(3, len(template) // 8)
            tried = None
            for d in diagonals:
                if tried is not None and d - tried <= band // 2:
                    continue  # the band around the last diagonal holds this one too
                tried = d
                matched, first, end = align(template, words, d, band)
                if matched >= min_coverage * len(template):
                    own.append((t, matched, first, end))
        out: list[tuple[int, int, int, int]] = []
        for m in sorted(own, key=lambda m: (-m[1], len(self.words[m[0]]), m[3] - m[2], m[2], m[0])):
            equal = lambda o: len(self.words[o[0]]) == len(self.words[m[0]]) and (self.words[o[0]] == self.words[m[0]]).all() and o[0] != m[0] and o[1:] == m[1:]  # noqa: E731, B023
            if all(m[3] <= o[2] or m[2] >= o[3] or equal(o) for o in out):
                out.append(m)
        return sorted(out, key=lambda m: (m[2], m[0]))

    def scan(self, documents: list[list[bytes]], min_coverage: float) -> list[list[tuple[int, int, int, int]]]:
        get, flat = self.number.get, []
        starts = np.zeros(len(documents) + 1, np.int64)
        for k, words in enumerate(documents):
            flat += [get(w, 0) for w in words]
            flat += [0] * SHARED  # no window reaches over a document's end
            starts[k + 1] = len(flat)
        ids = np.array(flat, np.uint64)
        places, hashes = winnow(ids)
        known = np.isin(hashes, self.hashes)
        places, hashes = places[known], hashes[known]
        pairs = pair_hashes(ids)
        pair_places = np.flatnonzero(np.isin(pairs, self.pair_hashes))
        pairs = pairs[pair_places]
        bounds, pair_bounds = np.searchsorted(places, starts), np.searchsorted(pair_places, starts)
        numbers = ids.astype(np.int64)
        out = []
        for k in range(len(documents)):
            (a, b), (c, d) = bounds[k : k + 2], pair_bounds[k : k + 2]
            marks = (places[a:b] - starts[k], hashes[a:b], pair_places[c:d] - starts[k], pairs[c:d])
            out.append(self.matches(numbers[starts[k] : starts[k + 1] - SHARED], marks, min_coverage) if b > a or d > c else [])
        return out


FOUND = {"license": pa.string(), "coverage": pa.float64(), **dict.fromkeys(("n_matched", "start_word", "end_word", "start_char", "end_char"), pa.int32())}


def scan_licenses(docs: DataFrame, templates: Mapping[str, str], keep: list[str], min_coverage: float = 0.8) -> DataFrame:
    """A row for each match: ``keep``, license, coverage, n_matched, and its span in words and in characters."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, names, strict=True)], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            bodies, at, rows, found = batch.column(len(names)), 0, [], []
            while at < len(bodies):
                texts, size = [], 0
                while at + len(texts) < len(bodies) and (size < CHUNK_BYTES or not texts):
                    texts.append(bodies[at + len(texts)].as_py())
                    size += len(texts[-1])
                for k, matches in enumerate(known.scan([words_of(t) for t in texts], min_coverage)):
                    spans = [m.span() for m in re.finditer(rb"\S+", texts[k].translate(FOLD))] if matches else []
                    for t, matched, first, end in matches:
                        rows.append(at + k)
                        a, b = (len(texts[k][:x].decode("utf-8", "replace")) for x in (spans[first][0], spans[end - 1][1]))
                        found.append((known.names[t], matched / len(known.words[t]), matched, first, end, a, b))
                at += len(texts)
            passed = batch.select(names).take(pa.array(rows, pa.int64())).columns if names else []
            columns = list(zip(*found, strict=True)) or [()] * len(FOUND)
            yield pa.RecordBatch.from_arrays([*passed, *[pa.array(c, t) for c, t in zip(columns, FOUND.values(), strict=True)]], [*names, *FOUND])

    schema = StructType([*given.drop("body").schema.fields, *[StructField(c, from_arrow_type(t)) for c, t in FOUND.items()]])
    return given.mapInArrow(scan, schema).toDF(*keep, *FOUND)
