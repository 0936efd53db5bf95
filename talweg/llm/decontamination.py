"""Benchmark decontamination: word windows of benchmark items looked up in every document.

The distinct windows of the benchmark are broadcast as a hash set. Each document's words are numbered by the
vocabulary of those windows, a polynomial hash of every run of words is looked up in the set, and each hit is
verified word by word. If the benchmark has more windows than ``block_windows``, the windows are split into
blocks of about that size. The documents then pass through one block after the other, with what was found written in
the shared folder in between and each block's broadcast removed before the next, so the driver and the tasks hold one
block at a time. No row is shuffled.

Words are runs of ASCII digits and letters, lower-cased, and of all characters beyond ASCII. A window is
``n`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null or empty text has no words and is never hit; an item without words, or null, has no window;
an item without an id counts under the id ''; repeated documents are each judged, repeated items count once.
Columns named in ``keep`` are passed on, all others are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from talweg.session import stored

#: Any byte to its lower-case word byte, or to a space where it is in no word.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 2 << 20
FILTER_BITS = 20

WINDOWS = StructType([StructField("item", StringType()), StructField("size", IntegerType()), StructField("window", BinaryType())])
SPAN = StructType([StructField("start", IntegerType(), False), StructField("end", IntegerType(), False)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def benchmark_windows(benchmark: DataFrame, n: int = 13, text: str = "text", item: str = "item_id") -> DataFrame:
    """The distinct (item, size, window) of the benchmark; a window is its words joined by spaces."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, bytes]] = []
            for item_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                size = min(n, len(words))
                out += [(item_id, size, w) for w in {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary()), strict=True)], ["item", "size", "window"])

    given = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    return given.mapInArrow(cut_up, WINDOWS).distinct()


class WindowSet:
    """A block of windows, ready for lookups."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.items: dict[bytes, list[str]] = {}
        for item, _, window in rows:
            self.items.setdefault(window, []).append(item)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x.split()}), start=1)}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for window in self.items:
            words = window.split()
            h = 0
            for w in words:
                h = (h * int(MULTIPLIER) + self.vocabulary[w]) & 0xFFFFFFFFFFFFFFFF
            by_size.setdefault(len(words), []).append(h)
        for size, hashes in by_size.items():
            table = np.unique(np.array(hashes, np.uint64))
            present = np.zeros(1 << FILTER_BITS, bool)
            present[(table >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[size] = (table, present)

    def hits(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document its hit word runs [start, end), merged, and the items that occur."""
        found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in documents]
        number, flat = self.vocabulary.get, []
        starts = np.zeros(len(documents) + 1, np.int64)
        for k, words in enumerate(documents):
            flat += [number(w, 0) for w in words]
            flat.append(0)  # no window reaches over a document's end
            starts[k + 1] = len(flat)
        ids = np.array(flat, np.uint64)
        if not len(ids) or not self.tables:
            return found
        hashes, known = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool)
        raw: dict[int, list[tuple[int, int]]] = {}
        for size in range(1, max(self.tables) + 1):
            hashes, known = hashes[: len(ids) - size + 1], known[: len(ids) - size + 1]
            if not len(hashes):
                break
            hashes = hashes * MULTIPLIER + ids[size - 1 :]
            known = known & (ids[size - 1 :] > 0)
            if size not in self.tables:
                continue
            table, present = self.tables[size]
            at = np.flatnonzero(known & present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = at[np.isin(hashes[at], table)]
            for i, k in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                start = i - int(starts[k])
                items = self.items.get(b" ".join(documents[k][start : start + size]))  # verified, not only hashed
                if items:
                    found[k][1].update(items)
                    raw.setdefault(k, []).append((start, start + size))
        for k, spans in raw.items():
            found[k] = (merged(spans), found[k][1])
        return found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the word runs ``spans``, from a run's first word to its last."""
    at = [m.span() for m in re.finditer(rb"\S+", text.translate(FOLD))]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


def _scan(rows: DataFrame, windows, drop_text: bool) -> DataFrame:
    """One block of windows over all rows: adds what it finds to the columns ``spans`` and ``items``."""
    columns = [c for c in rows.columns if not (drop_text and c == "body")]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: WindowSet = windows.value
        for batch in batches:
            names = batch.schema.names
            bodies = batch.column(names.index("body"))
            before_spans, before_items = (batch.column(names.index(c)).to_pylist() for c in ("spans", "items"))
            counts, new_spans, new_items = [], [], []
            at = 0
            while at < len(bodies):
                documents, size = [], 0
                while at + len(documents) < len(bodies) and (size < CHUNK_BYTES or not documents):
                    body = bodies[at + len(documents)].as_py() or b""
                    size += len(body)
                    documents.append(words_of(body))
                for k, (own, occurring) in enumerate(block.hits(documents), start=at):
                    counts.append(len(documents[k - at]))
                    old = [(s["start"], s["end"]) for s in before_spans[k]]
                    new_spans.append([{"start": a, "end": b} for a, b in (merged([*old, *own]) if old else own)])
                    new_items.append(sorted({*before_items[k], *occurring}))
                at += len(documents)
            put = {
                "n_words": pa.array(counts, pa.int64()),
                "spans": pa.array(new_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "items": pa.array(new_items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([put[c] if c in put else batch.column(names.index(c)) for c in columns], columns)

    return rows.mapInArrow(scan, StructType([rows.schema[c] for c in columns]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = 13, text: str = "text", keep_text: bool = False, block_windows: int = 500_000
) -> DataFrame:
    """``keep`` of every row with n_words, spans (hit word runs, merged) and items (ids of occurring items).

    With ``keep_text`` the column ``body`` holds the text as UTF-8 bytes.
    """
    found = stored(benchmark_windows(benchmark, n))
    total = found.count()
    blocks = max(1, -(-total // block_windows))
    context = docs.sparkSession.sparkContext
    names = [f"k{i}" for i in range(len(keep))]  # input names cannot clash with ours
    rows = docs.select(
        *[F.col(c).alias(x) for c, x in zip(keep, names, strict=True)],
        F.col(text).cast("binary").alias("body"),
        F.lit(0).cast(LongType()).alias("n_words"),
        F.array().cast(ArrayType(SPAN)).alias("spans"),
        F.array().cast(ArrayType(StringType())).alias("items"),
    )
    for b in range(blocks):
        own = found.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()  # about block_windows rows
        windows = context.broadcast(WindowSet([(r.item, r.size, bytes(r.window)) for r in own]))
        rows = _scan(rows, windows, drop_text=b == blocks - 1 and not keep_text)
        if b < blocks - 1:
            rows = stored(rows)
            windows.destroy()
    return rows.select(*[F.col(x).alias(c) for c, x in zip(keep, names, strict=True)], *[c for c in rows.columns if c not in names])


def contaminated(n_hit, n_words):
    """The contamination rule: something is hit, and it is 5 % of the words at least."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hit_words(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (a, s) -> a + s.end - s.start)")


def _hidden(docs: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, dict[str, str]]:
    """The scan with the other columns of ``docs`` under names that clash with nothing, and those names."""
    to = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    given = docs.select("text", *[F.col(c).alias(x) for c, x in to.items()])
    return find_contamination(given, benchmark, list(to.values()), n, keep_text=True), to


def _restored(rows: DataFrame, to: dict[str, str], columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("body").cast("string").alias(c) if c == "text" else F.col(to[c]).alias(c) for c in columns])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they were."""
    rows, to = _hidden(docs, benchmark, n)
    return _restored(rows.filter(~contaminated(hit_words(), F.col("n_words"))), to, docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """All rows of ``docs``, their texts without the hit word runs."""
    rows, to = _hidden(docs, benchmark, n)
    names = [*to.values(), "body"]

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(batch.schema.names.index(c)) for c in [*names, "spans"]}
            pairs = zip(own["body"].to_pylist(), own["spans"].to_pylist(), strict=True)
            own["body"] = pa.array([without_words(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in pairs], pa.binary())
            yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    return _restored(rows.mapInArrow(clean, StructType([rows.schema[c] for c in names])), to, docs.columns)
