"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every text has a 64-bit fingerprint: a bit is set if it is set in over half the XXH64 hashes (seed 42) of its word
shingles. Two fingerprints that differ in at most ``radius`` bits have a common variant within half the radius of
both, so every distinct fingerprint emits all its variants within that half, the variants are grouped, and what
meets is verified. A group holds only fingerprints around one variant (65 at most for radius 2), whatever the
number of documents, and gives an edge from each fingerprint to the next larger one, not all pairs. With an even
radius all of a group are within the radius of each other, so these edges join what all pairs would join.
Components are found by alternating large-star and small-star steps over the edges in the shared folder.

Defined cases: a text without words, empty or null has fingerprint zero and is linked like any other; equal texts
have equal fingerprints and so one component; a document without an id is alone in a component of its own, which
has no id; repeated rows are kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.graph import connected_components
from talweg.session import cut

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(b + 32 if b in UPPER else b for b in range(256))
SEED = 42


def _shingle_hashes(text: bytes, size: int) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: -size]]]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(text: bytes, size: int = 3, chunk: int = 1 << 15) -> int:
    """The unsigned fingerprint of a UTF-8 text."""
    return fingerprint_of(_shingle_hashes(text, size), chunk)


def fingerprint_of(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], size: int = 3, text: str = "text") -> DataFrame:
    """``keep`` of every row and ``fp``, its fingerprint as a signed 64-bit number."""
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, names, strict=True)], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(len(names))
            fps = np.array([fingerprint(bodies[i].as_py(), size) for i in range(len(bodies))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*names, "fp"])

    schema = given.drop("body").withColumn("fp", F.lit(0).cast("long")).schema
    return given.mapInArrow(hashed, schema).toDF(*keep, "fp")


def ball(radius: int) -> list[int]:
    """Signed masks of at most ``radius`` set bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_edges(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified edges (a, b) between distinct fingerprints of ``fps`` (fp), enough to connect all near ones.

    ``radius`` must be even: then all fingerprints that share a variant are within ``radius`` of each other.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select(before.alias("a"), F.col("fp").alias("b")).filter("a IS NOT NULL").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that a document can reach by links; one row per row."""
    marked = cut(fingerprints(docs, ["doc_id"], size))
    classes = cut(marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = connected_components(near_edges(classes.select("fp"), radius))
    joined = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    of = cut(of).toDF("c_fp", "component_id")
    known = marked.join(of, F.col("fp") == F.col("c_fp"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return known


def keep_first(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, or null; all columns as they were.

    Rows that repeat a doc_id are copies of one another: they stay or go together.
    """
    found = near_duplicates(docs.select("doc_id", "text"), radius, size)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
