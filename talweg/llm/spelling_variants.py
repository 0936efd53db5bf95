"""Grouping of spelling variants by an errata trie over the vocabulary.

Two words are near if they differ by exactly one inserted, deleted or replaced letter. Take the trie of all words and
at each node its heavy edge, to the child with most words below (the first of equal ones). Two near words part at
one node, where at least one of them leaves by a light edge or ends. So only words below light edges are moved: at
each light edge above it, a word is merged into the rest of the node's subtree with one letter replaced or skipped:

- replaced by the heavy edge's letter, or by any, which brings words below different light edges together;
- skipped, where the next letter differs (else the pair parts further down);
- with the heavy edge's letter put in front of the light edge's, or at the word's end where it ends at the node.

Where a moved word ends at a word, the two are near, and each near pair is found once. A light subtree has at most half
the words, so a word is moved a logarithmic number of times at each place where it could be, and never by all
letters of the alphabet.

The trie is spread over ranges of the sorted vocabulary, and each task walks the nodes of its range, held as intervals
of neighbouring words. Nodes that reach over the border of a range hold a beginning of its first or last word: their
children's word counts are summed over all ranges first. Moved words meet the vocabulary by a join, those with any
letter replaced by a grouping that holds a word for each letter at most.

Defined cases: a null text has no words, a null doc_id is an empty string where it is hashed; rows that repeat count
each; words may be of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.session import stored

LEAST_LETTERS, LEAST_COUNT, RATIO, DAMAGED = 7, 2, 10, 31
RANGE_WORDS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- vocabulary --------------------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, a letter taken out where the hash of document and run says so, seen often enough."""
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    h, size = F.crc32(F.concat_ws(":", "doc", "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    rest = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))
    words = runs.select(F.when(h % DAMAGED == 0, rest).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


# --- the trie ----------------------------------------------------------------------------------------------------


def common_length(a: str, b: str, known: int = 0) -> int:
    """How many letters two words begin with in common, at least ``known``."""
    most = min(len(a), len(b))
    while known < most and a[known] == b[known]:
        known += 1
    return known


def border_counts(words: list[str]) -> Iterator[tuple[bytes, int, bool, Counter]]:
    """(node's hash, depth, whether it is of the last word, words by next letter) for all nodes on the first and last word."""
    shared = common_length(words[0], words[-1])
    for of_last, own in ((False, words), (True, words[::-1])):
        node, below = hashlib.blake2b(digest_size=16), own
        for depth in range(len(own[0]) + 1):
            if depth:
                letter = own[0][depth - 1]
                node.update(letter.encode())
                below = below[: next((k for k, w in enumerate(below) if len(w) < depth or w[depth - 1] != letter), len(below))]
                if of_last and len(below[-1]) < depth:
                    below = below[:-1]
            if not of_last or depth > shared:
                yield node.copy().digest(), depth, of_last, Counter(w[depth] for w in below if len(w) > depth)


def light_edges(words: list[str], border: tuple[dict[int, str], dict[int, str]]) -> Iterator[tuple[int, int, int, str]]:
    """(first, stop, depth, heavy letter): words [first, stop) leave the node by a light edge, or end there.

    ``words`` are sorted; ``border`` has the heavy letters of the nodes on the first and on the last word by depth.
    """
    stack = [(0, len(words), 0)] if words else []
    while stack:
        first, stop, depth = stack.pop()
        one = words[first]
        below = common_length(one, words[stop - 1], depth)
        heavy_of = border[0] if first == 0 else border[1] if stop == len(words) else None
        if heavy_of is not None:  # nodes with one child here may have others in other ranges
            for at in range(depth, below):
                if heavy_of.get(at, one[at]) != one[at]:
                    yield first, stop, at, heavy_of[at]
        begin = first + (len(one) == below)
        children = []
        at = begin
        for letter, own in groupby(words[begin:stop], key=lambda w: w[below]):
            size = sum(1 for _ in own)
            children.append((size, letter, at))
            at += size
        heavy = heavy_of.get(below) if heavy_of is not None else max(children, key=lambda c: (c[0], -ord(c[1])))[1] if children else None
        if heavy is not None and begin > first:
            yield first, begin, below, heavy
        for size, letter, at in children:
            if heavy is not None and letter != heavy:
                yield at, at + size, below, heavy
            if size > 1 or at == 0 or at + size == len(words):
                stack.append((at, at + size, below + 1))


def moved(word: str, depth: int, heavy: str) -> Iterator[tuple[bool, str]]:
    """(whether any letter may stand at the mark, the word as moved at a light edge)."""
    if len(word) == depth:
        yield False, word + heavy
        return
    head, letter, tail = word[:depth], word[depth], word[depth + 1 :]
    yield True, f"{head}*{tail}"
    yield False, head + heavy + tail
    yield False, head + heavy + letter + tail
    if not tail.startswith(letter) and len(word) > LEAST_LETTERS:
        yield False, head + tail


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    part, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part:
                if held:
                    yield part, held
                part, held = row[0], []
            held.append(row[1:])
    if held:
        yield part, held


def _heavy_borders(parts: DataFrame) -> DataFrame:
    """(part, border): heavy letters of the nodes that a range may share with others, a row for each range."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _ranges(batches):
            out = []
            for node, depth, of_last, letters in border_counts([r[0] for r in rows]):
                out += [(part, node, depth, of_last, letter, n) for letter, n in letters.items()] or [(part, node, depth, of_last, None, 0)]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "node", "depth", "of_last", "letter", "n"])

    kinds = (pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
    counts = stored(parts.select("part", "word").repartition("part").sortWithinPartitions("part", "word").mapInArrow(counted, "part int, node binary, depth int, of_last boolean, letter string, n long"))
    letters = counts.filter("letter IS NOT NULL").groupBy("node", "letter").agg(F.sum("n").alias("n"))
    heavy = letters.groupBy(F.col("node").alias("h_node")).agg(F.max(F.struct("n", -F.ascii("letter"), "letter")).alias("most"))
    own = counts.select("part", "node", "depth", "of_last").distinct().join(heavy, F.col("node") == F.col("h_node"))
    return own.groupBy("part").agg(F.collect_list(F.struct("of_last", "depth", F.col("most.letter").alias("letter"))).alias("border"))


def trie_moves(parts: DataFrame) -> DataFrame:
    """(open, key, word, n): every word as it is moved, with ``*`` for any letter where ``open``."""

    def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _ranges(batches):
            words, counts = [r[0] for r in rows if r[0] is not None], [r[1] for r in rows if r[0] is not None]
            border: tuple[dict, dict] = ({}, {})
            for b in rows[0][2] or []:
                border[b["of_last"]][b["depth"]] = b["letter"]
            shared = common_length(words[0], words[-1]) if words else 0
            border[1].update({d: x for d, x in border[0].items() if d <= shared})  # nodes on both words are listed once
            out: list[tuple] = []
            for first, stop, depth, heavy in light_edges(words, border):
                for k in range(first, stop):
                    out += [(open_, key, words[k], counts[k]) for open_, key in moved(words[k], depth, heavy)]
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["open", "key", "word", "n"])

    kinds = (pa.bool_(), pa.string(), pa.string(), pa.int64())
    borders = _heavy_borders(parts)
    none = F.lit(None).cast(borders.schema["border"].dataType)
    rows = parts.select("part", "word", "n", none.alias("border")).unionByName(borders.select("part", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n"), "border"))
    return rows.repartition("part").sortWithinPartitions("part", "word").mapInArrow(walked, "open boolean, key string, word string, n long")


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n, n_near, best) of all ``words`` (word, n); ``best`` (n, word) is the most frequent near word, the first of equal ones."""
    words = stored(words)
    ranges = max(1, math.ceil(words.count() / range_words))
    parts = stored(words.repartitionByRange(ranges, "word").withColumn("part", F.spark_partition_id()))
    moves = stored(trie_moves(parts))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = moves.filter("NOT open").join(known, F.col("key") == F.col("other"))
    pairs = met.select(F.explode(F.array(F.struct("word", F.lit(1).alias("near"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("name")).alias("best")), F.struct(F.col("other").alias("word"), F.lit(1).alias("near"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("name")).alias("best")))).alias("p")).select("p.*")
    # a word for each letter at most
    alike = moves.filter("open").groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("name")))).alias("own")).filter(F.size("own") > 1)
    alike = alike.select(F.posexplode("own").alias("k", "one"), "own").select(F.col("one.name").alias("word"), (F.size("own") - 1).alias("near"), F.when(F.col("k") == 0, F.col("own")[1]).otherwise(F.col("own")[0]).alias("best"))
    both = pairs.unionByName(alike).groupBy(F.col("word").alias("w")).agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(both, F.col("word") == F.col("w"), "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best").isNotNull(), F.struct((-F.col("best.less")).alias("n"), F.col("best.name").alias("word"))).alias("best"))


def grouped(near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``near`` with each word's form, its best near word if that is ``ratio`` times as frequent, and its root."""
    form = F.col("best.n") >= ratio * F.col("n")
    rows = stored(near.select("word", "n", "n_near", F.when(form, F.col("best.word")).alias("form"), F.when(form, F.col("best.n")).alias("form_n")))
    roots = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # counts grow by the ratio with each step, which bounds the steps; a round doubles those taken
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most, ratio)) + 1)
    for _ in range(max(0, (steps - 1).bit_length())):
        roots = stored(roots)
        on = roots.select(F.col("word").alias("via"), F.col("root").alias("further"))
        roots = roots.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"))
    ends = roots.select(F.col("word").alias("r_word"), "root")
    return rows.join(ends, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents' vocabulary."""
    return grouped(near_words(vocabulary(docs)))
