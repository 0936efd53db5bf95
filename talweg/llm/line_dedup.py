"""Line deduplication by winnowing over line hashes.

A document is its lines with a word, each known by its words. A run of lines of ``min_words`` words or more that
occurred before (in a document of smaller doc_id, or in the same one from an earlier line on) is deleted. Windows are
the shortest runs with ``min_words`` words, taken from every line on and up to every line back. Each window selects
its smallest line hash (the last of equal ones), so every run that two places share has a selected line in common:
those are the fingerprints. Positions are joined on fingerprints; one that is seen at one position only ends there.
From each shared position the match is extended both ways over the windows that hold it: they are compared by a
128-bit hash of their lines with the first of their kind, those that begin at each line to the left and those that
end at each line to the right, until a line differs. What matches merges into maximal runs. No pairs of positions are
made, since each window meets the first of its kind only, so a line that a third of all documents have costs no more
than any other.

Defined cases: a null or empty text has no lines and stays as it is; documents without an id come after all
others; rows that repeat a doc_id with the same text are one document at several places and are all cut alike;
lines are compared word by word, so white space at their ends or between words does not count; lines without words
inside a deleted run go with it. Other columns pass through ``drop_repeated_runs`` unchanged, but for n_chars.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.session import cut, stored

MIN_WORDS = 50
LAST = (1 << 63) - 1

WINDOWS = "doc long, text_hash long, fp long, place int, h1 long, h2 long, start int, stop int"


def window_bounds(counts: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of all windows over lines of ``counts`` words: the shortest from every line on, and back."""
    upto = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    n = len(counts)
    last = np.searchsorted(upto, upto[:-1] + min_words) - 1  # of the window that begins at each line
    first = np.searchsorted(upto, upto[1:] - min_words, "right") - 1  # of the one that ends at each line
    found = {(i, int(j)) for i, j in enumerate(last) if j < n}
    return sorted(found | {(int(i), j) for j, i in enumerate(first) if i >= 0})


def windows_of(text: bytes, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(fingerprint, its line, digest, first line, last line) of every window, lines counted from 0 in the text."""
    lines, hashes, counts, bodies = [], [], [], []
    for number, line in enumerate(text.split(b"\n")):
        if words := line.split():
            lines.append(number)
            bodies.append(b" ".join(words))
            hashes.append(xxhash.xxh64_intdigest(bodies[-1]))
            counts.append(len(words))
    at = stop = -1
    for i, j in window_bounds(counts, min_words):
        if at < i or j < stop:
            at = min(range(i, j + 1), key=lambda k: (hashes[k], -k))
        else:  # neither end has gone back
            at = min((at, *range(stop + 1, j + 1)), key=lambda k: (hashes[k], -k))
        stop = j
        yield hashes[at], lines[at], xxhash.xxh3_128_digest(b"\n".join(bodies[i : j + 1])), lines[i], lines[j]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("body"))


def line_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, hashes_ = (batch.column(k).to_numpy() for k in (0, 1))
            row, out, digests = [], [], []
            bodies = batch.column(2)
            for i in range(len(bodies)):
                for fp, place, digest, start, stop in windows_of(bodies[i].as_py() or b"", min_words):
                    row.append(i)
                    out.append((fp, place, start, stop))
                    digests.append(digest)
            fp, place, start, stop = np.array(out, np.uint64).reshape(-1, 4).T
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [docs_[row], hashes_[row], fp.copy().view(np.int64), place.astype(np.int32), pair[:, 0].copy(), pair[:, 1].copy(), start.astype(np.int32), stop.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "text_hash", "fp", "place", "h1", "h2", "start", "stop"])

    return _keyed(docs).mapInArrow(cut_up, WINDOWS)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, start, stop) of the maximal runs of lines to delete, both ends included."""
    windows = stored(line_windows(docs, min_words))
    position = F.struct("doc", "text_hash", "place")
    # written, so that the windows of a very common line can be dealt to several tasks in the join
    met = cut(windows.groupBy("fp").agg(F.min(position).alias("a"), F.max(position).alias("b")).filter("a < b").select("fp"))
    near = windows.join(met, "fp", "left_semi").select("doc", "text_hash", "h1", "h2", "start", "stop")
    origin = F.struct("doc", "text_hash", "start")
    first = cut(near.groupBy("h1", "h2").agg(F.min(origin).alias("first"), F.max(origin).alias("last")).filter("first < last").drop("last"))
    later = near.join(first, ["h1", "h2"]).filter(origin > F.col("first")).select("doc", "text_hash", "start", "stop").distinct()
    order = Window.partitionBy("doc", "text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("opens", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "text_hash", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _with_runs(docs: DataFrame, min_words: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, with ``runs``, null where nothing goes, and ``rest``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    runs = repeated_runs(docs.select("doc_id", "text"), min_words)
    runs = runs.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    given = docs.select(*[F.col(c).alias(x) for c, x in names.items()])
    doc_id, text = F.col(names["doc_id"]), F.col(names["text"])
    joined = given.join(runs, (F.coalesce(doc_id, F.lit(LAST)).cast("long") == F.col("doc")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    left = f"filter(split({names['text']}, '\\n'), (l, i) -> NOT exists(runs, r -> i BETWEEN r.start AND r.stop))"
    rest = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.expr(left), "\n"))
    return joined.select(*names.values(), "runs", rest.alias("rest")), names


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (of all lines), n_removed, n_runs and text, what is left, of every row."""
    rows, names = _with_runs(docs.select("doc_id", "text"), min_words)
    return rows.select(
        F.col(names["doc_id"]).alias("doc_id"),
        F.coalesce(F.size(F.split(names["text"], "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(runs, 0L, (a, r) -> a + r.stop - r.start + 1)"), F.lit(0)).alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.col("rest").alias("text"),
    )


def drop_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated runs, and without the documents that nothing is left of.

    All columns stay; n_chars, if there, is the length of what is left.
    """
    rows, names = _with_runs(docs, min_words)
    left = rows.filter(r"runs IS NULL OR rest RLIKE '[^\\x20\\x09-\\x0D]'")
    put = {"text": F.col("rest"), "n_chars": F.when(F.col("runs").isNull(), F.col(names.get("n_chars", "rest"))).otherwise(F.length("rest"))}
    kinds = {c: docs.schema[c].dataType for c in docs.columns}
    return left.select(*[(put[c].cast(kinds[c]) if c in put else F.col(names[c])).alias(c) for c in docs.columns])
