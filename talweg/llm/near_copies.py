"""Near copies by the Jaccard similarity of word shingles: five words and 0.8 or more.

The stage of the pipeline by the SimHash operator's method, for its own rule: each text has a 64-bit fingerprint of its
shingles, fingerprints that differ in at most ``RADIUS`` bits meet by the variants within half of that, what meets is
verified on the sets, and components are found by star steps. SimHash alone cannot apply the rule: at a similarity of
0.8 two fingerprints differ in some ten of 64 bits, and a ball of half that radius has eight million variants. So what
the balls leave apart is met by several more fingerprints over subsets of its shingles.

A text is the set of its five-word shingles' XXH64 hashes (ASCII letters in lower case; a shorter text is one
shingle). Texts of equal sets are one class, known by a 128-bit hash. Each class has 50 fingerprints over subsets of
its shingles, the hash of its least shingles by eight orders each, and classes that share a fingerprint are candidates.
A pair of similarity s shares none with probability (1 - s^8)^50, 1e-4 at 0.8 and far less above; one of 0.5, as a
common passage makes it, shares one with probability 0.18. Candidates are first compared by sketches, three bits of the
least shingle by each of ``SKETCH`` orders, of which ``ALIKE`` must be equal (fewer at 0.8 have a chance of 5e-5), and
then verified on the sets themselves, so no pair below the similarity is linked. Sketches travel with the fingerprints
and are compared where they meet, so only pairs of like sketches are ever written.

Nothing is left out of a large group. While the candidate pairs outnumber the fingerprints' rows, each class is first
compared with one neighbour of its group, by a part of the fingerprints a round; pairs whose ends are linked by then
need no comparison. After ``ROUNDS`` rounds, or once few are left, all the others are compared. More rounds hardly
help: they link what is similar, while pairs a little below the similarity stay to be compared after any number. A
group of more than ``BLOCK`` rows is dealt into blocks, and every two of its blocks meet under a key of their own; a pair
that shares several fingerprints is made for the first of them only.

Defined cases: texts without words, empty or null are equal; a document without an id stays; rows that repeat a
doc_id are copies of one another, they stay or go together. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm.simhash import _shingle_hashes, fingerprint_of, near_edges
from talweg.operators.graph import connected_components
from talweg.session import cut, stored

SIZE, NUMERATOR, DENOMINATOR = 5, 4, 5  # words in a shingle; the least similarity
RADIUS = 2  # bits that fingerprints of all shingles may differ in
BANDS, ROWS = 50, 8
SKETCH, ALIKE = BANDS * ROWS, 299
PLANES, LONGS = 3, -(-SKETCH // 64)  # bits of each order's least shingle, one plane of numbers for each bit
PAIRS_A_ROW, ROUNDS = 1, 2
BLOCK = 1_000

FACTORS, MASKS = (np.array([xxhash.xxh64_intdigest(f"{name} {k}") | 1 for k in range(BANDS * ROWS)], np.uint64) for name in ("factor", "mask"))


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    return np.unique(_shingle_hashes(text, size))


def marks_of(shingles: np.ndarray, chunk: int = 4096) -> tuple[list[int], list[int]]:
    """The signed fingerprints and the sketch of a set; none of an empty one."""
    if not len(shingles):
        return [], []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), chunk):
        part = shingles[at : at + chunk, None]
        least = np.minimum(least, ((part ^ MASKS) * FACTORS).min(axis=0))
    bodies = least.reshape(BANDS, ROWS)
    bands = np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bodies)], np.uint64).view(np.int64).tolist()
    planes = np.zeros((PLANES, LONGS * 64), np.uint8)
    for p in range(PLANES):
        planes[p, :SKETCH] = least >> np.uint64(p) & np.uint64(1)
    return bands, np.packbits(planes, axis=1).view(np.int64).ravel().tolist()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, h1 and h2 (the set's digest), n (its size), fp (its SimHash fingerprint), bands and sketch of every row with an id."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1)
            sets = [shingle_set(bodies[i].as_py()) for i in range(len(bodies))]
            pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            marks = [marks_of(s) for s in sets]
            bands, sketches = pa.array([m[0] for m in marks], pa.list_(pa.int64())), pa.array([m[1] for m in marks], pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)), bands, sketches]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n", "fp", "bands", "sketch"])

    given = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return given.mapInArrow(hashed, "doc_id long, h1 long, h2 long, n long, fp long, bands array<long>, sketch array<long>")


def alike(a: str, b: str) -> str:
    """The condition that the sketches in columns ``a`` and ``b`` are equal at ``ALIKE`` orders or more."""
    differing = [" | ".join(f"({a}[{p * LONGS + i}] ^ {b}[{p * LONGS + i}])" for p in range(PLANES)) for i in range(LONGS)]
    return f"{' + '.join(f'bit_count({d})' for d in differing)} <= {SKETCH - ALIKE}"


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``texts`` (node, body) have the least similarity or more."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("end")).unionAll(pairs.select(F.col("b").alias("end"))).distinct()
    used = stored(texts.join(ends, texts["node"] == ends["end"], "left_semi"))
    one = pairs.join(used.select(F.col("node").alias("a"), F.col("body").alias("a_body")), "a")
    two = one.join(used.select(F.col("node").alias("b"), F.col("body").alias("b_body")), "b")

    def checked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # rows arrive by b, so its set is made once
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                if (body := b.as_py()) != last:
                    last, held = body, shingle_set(body)
                good.append(similar(shingle_set(a.as_py()), held))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return two.select("a", "b", "a_body", "b_body").mapInArrow(checked, "a long, b long")


def _fitting(a: str, b: str) -> str:
    return f"{DENOMINATOR} * least({a}, {b}) >= {NUMERATOR} * greatest({a}, {b})"


def _within_balls(rows: DataFrame) -> DataFrame:
    """(a, b): documents of near fingerprints, enough to connect all of them; each with the first of its fingerprint, and these along the balls."""
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    ends = [fps.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_first")) for side in "ab"]
    balls = near_edges(fps.select("fp"), RADIUS).join(ends[0], "a").join(ends[1], "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    equal = rows.select("doc_id", "fp").join(fps, "fp").select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    return balls.unionAll(equal).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_roots(docs: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest doc_id that each doc_id reaches by links, where that is another."""
    rows = stored(marked(docs).dropDuplicates(["doc_id", "h1", "h2"]))
    classes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    same = stored(rows.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    # narrow rows find the groups, by the same plan whatever their number; sketches follow to those that have others
    single = rows.join(same, rows["doc_id"] == same["a"], "left_anti")
    alone = single.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("k", "band"))
    groups = alone.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select(F.col("band").alias("g_band"))
    narrow = alone.join(groups.hint("merge"), F.col("band") == F.col("g_band"), "left_semi")
    own = rows.select(F.col("doc_id").alias("o_node"), "n", "sketch", "bands")
    met = stored(narrow.join(own.hint("merge"), (F.col("node") == F.col("o_node")) & (F.get("bands", F.col("k")) == F.col("band"))).select("node", "n", "sketch", "k", "band"))
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    limit = PAIRS_A_ROW * max(met.count(), 1)
    edges = cut(same.unionAll(verified(_within_balls(single.select("doc_id", "fp")), texts)))
    placed = _placed(met, edges)
    for turn in range(ROUNDS):
        per_root = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
        open_pairs = per_root.groupBy("band").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"))
        if (open_pairs.agg(F.sum("p")).first()[0] or 0) <= limit:
            break
        order = Window.partitionBy("band", "block").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        own = _in_blocks(placed.filter(F.col("k") % ROUNDS == turn))
        before = own.select(*PLACED, *[F.lag(c).over(order).alias(f"{c}_") for c in PLACED])
        edges = cut(edges.unionAll(verified(_pairs(before), texts)))
        placed = _placed(met, edges)
    edges = cut(edges.unionAll(verified(_pairs(_met_once(placed, rows)), texts)))
    return connected_components(edges).filter("node <> root").select(F.col("node").alias("doc_id"), "root").distinct()


PLACED = ["node", "root", "n", "sketch"]


def _in_blocks(placed: DataFrame) -> DataFrame:
    """``placed`` with the number of blocks of its group and the block of its node."""
    sizes = placed.groupBy(F.col("band").alias("s_band")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return placed.join(sizes, F.col("band") == F.col("s_band")).drop("s_band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _met_once(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """Every two nodes of a group, by the first fingerprint that both have; blocks i <= j of a group meet as (i, j)."""
    bands = rows.select(F.col("doc_id").alias("b_node"), "bands")  # ids of several texts have several
    own_bands = (F.col("node") == F.col("b_node")) & (F.get("bands", F.col("k")) == F.col("band"))
    own = stored(_in_blocks(placed).join(bands, own_bands).select("band", "k", "blocks", "block", "bands", *PLACED))
    one = own.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    two = own.select("band", "block", "bands", *PLACED).withColumn("i", F.explode(F.sequence(F.lit(0), "block"))).withColumn("j", F.col("block"))
    two = two.select(*[F.col(c).alias(f"{c}_") for c in ("band", "i", "j", "bands", *PLACED)])
    met = one.join(two, (F.col("band") == F.col("band_")) & (F.col("i") == F.col("i_")) & (F.col("j") == F.col("j_")))
    met = met.filter("(i < j OR node < node_) AND root <> root_").filter(_fitting("n", "n_")).filter(alike("sketch", "sketch_"))
    return met.filter(F.array_position(F.zip_with("bands", "bands_", lambda x, y: x == y), F.lit(True)) == F.col("k") + 1)


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b): the pairs of nodes not linked yet whose sizes and sketches fit."""
    apart = met.filter("root <> root_ AND node <> node_").filter(_fitting("n", "n_")).filter(alike("sketch", "sketch_"))
    return apart.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _placed(met: DataFrame, edges: DataFrame) -> DataFrame:
    """``met`` with the root of each node, without the groups that are linked already."""
    found = connected_components(edges).select(F.col("node").alias("at"), "root").distinct()
    rooted = stored(met.join(found, F.col("node") == F.col("at"), "left").select("band", "k", "n", "node", "sketch", F.coalesce("root", "node").alias("root")))
    apart = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("band")
    return stored(rooted.join(apart, "band", "left_semi"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest it reaches, or null; all columns as they were."""
    gone = near_roots(docs.select("doc_id", "text")).select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
