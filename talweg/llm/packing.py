"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

``token_pieces`` encodes every whole document; only documents longer than a sequence are cut. ``pack`` puts the
pieces into as few sequences as it can. Pieces are dealt into shards of bounded size. In each shard several islands
evolve a few packings: a crossover injects whole well-filled sequences of one parent into the other, sequences that
then hold a piece twice are opened, displaced pieces are exchanged for smaller ones where that fills a sequence
better, and the rest is put back best-fit, longest first. Between epochs each island's elite moves to the next island
through a shuffle. The best packing of each shard is taken; the pieces of its loosely filled sequences meet those of
other shards at the next level, until one shard is left or a level no longer halves the pieces. If there are still
more sequences than all tokens need, those with the most free tokens, however few, are packed anew across shards, as
long as that dissolves some. Nothing but counts comes to the driver. A shard whose packing has no more sequences than
its tokens need at least is not evolved, since nothing can be gained.

Defined cases: a null or empty text is the end token alone; repeated rows and rows without an id are packed like
any other; an empty table gives an empty result; extra columns of the pieces are passed on as they are.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from talweg.llm import tokens
from talweg.session import cut

SEQUENCE = 2048
END = 0
SHARD_PIECES = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 8, 4
#: The one shard of the last level decides how many sequences there are, and evolves so many times longer.
LAST_LEVEL = 5
#: Sequences that a crossover tries to fill better by exchanging pieces.
EXCHANGES = 40
#: A sequence with this many free tokens or more is opened again at the next level.
LOOSE = 32
BIN_BITS = 20
#: How often surplus sequences are dissolved at most, and how many of them a shard for that is to dissolve.
TURNS, SURPLUS_A_SHARD = 3, 2


def token_pieces(docs: DataFrame, keep: list[str], size: int = SEQUENCE, vocabulary_file: str | None = None, ranks_file: str | None = None) -> DataFrame:
    """``keep`` with piece, start, length and ids (little-endian unsigned 32-bit) of every document's pieces.

    A document's ids end with ``END``. Of a document longer than ``size`` all pieces but the first are full.
    """
    files = vocabulary_file or tokens.vocabulary("byte_bpe_50k.json"), ranks_file or tokens.vocabulary("byte_bpe_50k.tiktoken")
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, names, strict=True)], F.coalesce(F.col("text"), F.lit("")).alias("body"))
    schema = StructType(
        [
            *given.drop("body").schema.fields,
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.fast_encoder(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounds what the ids of one batch hold
                part = batch.slice(at, 512)
                rows, piece, start, length, ids = [], [], [], [], []
                for i, text in enumerate(part.column(len(names)).to_pylist()):
                    own = np.array([*encode(text), END], "<u4")
                    first = (len(own) - 1) % size + 1
                    for k, a in enumerate([0, *range(first, len(own), size)]):
                        b = first if k == 0 else a + size
                        rows.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(own[a:b].tobytes())
                passed = part.select(names).take(pa.array(rows, pa.int64())).columns if names else []
                yield pa.RecordBatch.from_arrays([*passed, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], [*names, "piece", "start", "length", "ids"])

    return given.mapInArrow(encoded, schema).toDF(*keep, "piece", "start", "length", "ids")


# --- one island ------------------------------------------------------------------------------------------------

Bins = list[list[int]]


def best_fit(sizes: list[int], items: list[int], bins: Bins, capacity: int) -> Bins:
    """Puts ``items``, in the order given, each where least room is left; opens bins where none fits."""
    free: dict[int, list[int]] = {}
    open_rooms = 0  # bit r: a bin has room r
    for k, content in enumerate(bins):
        if room := capacity - sum(sizes[i] for i in content):
            free.setdefault(room, []).append(k)
            open_rooms |= 1 << room
    for i in items:
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                open_rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if room > size:
            free.setdefault(room - size, []).append(k)
            open_rooms |= 1 << (room - size)
    return bins


def fitness(sizes: list[int], bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones, are better (smaller)."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def exchange(sizes: list[int], displaced: list[int], bins: Bins, capacity: int, rng: random.Random) -> list[int]:
    """Fills some of ``bins`` better by taking one or two of ``displaced`` for one or two smaller; the pieces left, longest first."""
    pool = sorted(displaced, key=lambda i: sizes[i])
    keys = [sizes[i] for i in pool]

    def swap(content: list[int], out: list[int], chosen: list[int]) -> None:
        """Puts the pool's places ``chosen`` where ``content`` has the places ``out``."""
        given = [content[p] for p in out]
        for p, k in zip(out, chosen, strict=True):
            content[p] = pool[k]
        for k in sorted(chosen, reverse=True):
            del pool[k], keys[k]
        for i in given:
            k = bisect_left(keys, sizes[i])
            pool.insert(k, i)
            keys.insert(k, sizes[i])

    def pair_within(low: int, high: int) -> list[int]:
        """The pool's places of two pieces of the greatest sum above ``low`` and up to ``high``."""
        a, b, best, found = 0, len(keys) - 1, low, []
        while a < b:
            total = keys[a] + keys[b]
            if total > high:
                b -= 1
                continue
            if total > best:
                best, found = total, [a, b]
            a += 1
        return found

    for k in rng.sample(range(len(bins)), min(EXCHANGES, len(bins))):
        content = bins[k]
        room = capacity - sum(sizes[i] for i in content)
        for p in range(len(content)):
            size = sizes[content[p]]
            at = bisect_right(keys, size + room) - 1
            if room and at >= 0 and keys[at] > size:
                room -= keys[at] - size
                swap(content, [p], [at])
        pairs = ([p, q] for p in range(len(content)) for q in range(p))
        for pair in pairs if room else ():
            size = sum(sizes[content[p]] for p in pair)
            if chosen := pair_within(size, size + room):
                swap(content, pair, chosen)
                break
    return pool[::-1]


def crossover(sizes: list[int], a: Bins, b: Bins, capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of ``b`` put into ``a``; a few of the emptiest bins are opened as well."""
    fill = [sum(sizes[i] for i in content) for content in b]
    by_fill = sorted(range(len(b)), key=lambda k: -fill[k])
    good = by_fill[: max(1, len(b) // 2)]
    injected = [b[k] for k in rng.sample(good, max(1, int(len(good) * rng.uniform(0.02, 0.4))))]
    taken = {i for content in injected for i in content}
    kept, displaced = [], []
    for content in a:
        if taken.isdisjoint(content):
            kept.append(list(content))
        else:
            displaced += [i for i in content if i not in taken]
    kept.sort(key=lambda content: sum(sizes[i] for i in content))
    opened = min(len(kept), rng.randint(1, 4))
    for content in kept[:opened]:
        displaced += content
    kept = kept[opened:]
    displaced = exchange(sizes, displaced, kept, capacity, rng)
    return best_fit(sizes, displaced, kept + [list(c) for c in injected], capacity)


def evolve(sizes: list[int], population: list[Bins], capacity: int, generations: int, size: int, rng: random.Random) -> list[Bins]:
    """``population``, filled up to ``size``, after some generations; the best first. ``sizes`` falls."""
    least = -(-sum(sizes) // capacity)
    order = list(range(len(sizes)))
    while len(population) < size:
        noise = 0.0 if not population else 0.15
        keyed = sorted(order, key=lambda i: -sizes[i] * (1 + rng.uniform(-noise, noise)))
        population.append(best_fit(sizes, keyed, [], capacity))
        if len(population[-1]) == least:
            break
    population.sort(key=lambda p: fitness(sizes, p, capacity))
    for _ in range(generations):
        if len(population[0]) == least or len(population) < 2:
            break
        children = []
        for _ in range(max(1, size // 2)):
            a, b = rng.sample(range(len(population)), 2)
            children.append(crossover(sizes, population[a], population[b], capacity, rng))
        population = sorted([*population, *children], key=lambda p: fitness(sizes, p, capacity))[:size]
    return population


def to_places(bins: Bins, n: int) -> list[int]:
    places = [0] * n
    for k, content in enumerate(bins):
        for i in content:
            places[i] = k
    return places


def to_bins(places: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(places, default=-1) + 1)]
    for i, k in enumerate(places):
        bins[k].append(i)
    return bins


STATE = "shard long, island int, sizes array<int>, population array<array<int>>, bins int, score double"


def _epoch(state: DataFrame, capacity: int, epoch: int, generations: int) -> DataFrame:
    """One epoch of every island (shard, island, sizes, population)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                rng = random.Random(f"{row['shard']} {row['island']} {epoch}")
                population = evolve(sizes, [to_bins(p) for p in row["population"]], capacity, generations, POPULATION, rng)
                bins, score = fitness(sizes, population[0], capacity)
                out = row | {"population": [to_places(p, len(sizes)) for p in population], "bins": bins, "score": score}
                yield pa.RecordBatch.from_pylist([out], pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32()), ("score", pa.float64())]))

    return state.mapInArrow(run, STATE)


def _evolved(ranked: DataFrame, capacity: int, shards: int, generations: int) -> DataFrame:
    """(shard, rank, bin) of the best packing of every shard of ``ranked`` (shard, rank, length).

    An island is small and takes long, so they are dealt into a number of tasks that is not left to their bytes.
    """
    tasks = max(1, min(shards * ISLANDS, 10 * ranked.sparkSession.sparkContext.defaultParallelism))
    shards = ranked.groupBy("shard").agg(F.sort_array(F.collect_list(F.col("length").cast("int")), asc=False).alias("sizes"))
    islands = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes", F.array().cast("array<array<int>>").alias("population"))
    state = cut(_epoch(islands.repartition(tasks, "shard", "island"), capacity, 0, generations))
    for epoch in range(1, EPOCHS):
        guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, 1).alias("guest"))
        met = state.join(guests, ["shard", "island"])
        state = cut(_epoch(met.select("shard", "island", "sizes", F.concat("population", "guest").alias("population")).repartition(tasks, "shard", "island"), capacity, epoch, generations))
    best = state.groupBy("shard").agg(F.min_by(F.get("population", F.lit(0)), F.struct("bins", "score", "island")).alias("places"))
    return best.select("shard", F.posexplode("places").alias("rank", "bin"))


def _placed(ranked: DataFrame, capacity: int, shards: int, base: int, generations: int = GENERATIONS) -> DataFrame:
    """``ranked`` (shard, rank, length, ...) evolved: with sequence (negative, none twice), offset and how filled it is."""
    met = ranked.join(_evolved(ranked, capacity, shards, generations), ["shard", "rank"])
    own = Window.partitionBy("shard", "bin")
    ahead = own.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sequence = -(1 + F.col("bin") + ((F.col("shard") + base) * (1 << BIN_BITS)))
    return cut(met.withColumns({"offset": F.coalesce(F.sum("length").over(ahead), F.lit(0)), "filled": F.sum("length").over(own), "sequence": sequence}))


def _ranked(dealt: DataFrame) -> DataFrame:
    by_size = Window.partitionBy("shard").orderBy(F.desc("length"), "uid")
    return cut(dealt.withColumn("rank", F.row_number().over(by_size) - 1))


def dissolved(placed: DataFrame, capacity: int, shard_pieces: int, base: int) -> DataFrame:
    """``placed`` (uid, length, sequence, offset, ...) in fewer sequences, if there are more than the tokens need.

    The sequences with the most free tokens, of whatever shard, are packed anew, a shard for a few surplus ones. A
    shard's new packing counts if it has fewer sequences. The next turn opens twice as many for each.
    """
    columns = placed.columns
    for turn in range(TURNS):
        filled = cut(placed.groupBy("sequence").agg(F.sum("length").alias("filled")))
        total = filled.agg(F.count(F.lit(1)).alias("n"), F.sum("filled").alias("tokens")).first()
        surplus = total.n - -(-(total.tokens or 0) // capacity)
        if surplus <= 0:
            break
        shards = -(-surplus // SURPLUS_A_SHARD)
        opened = filled.filter(F.col("filled") < capacity).orderBy("filled", "sequence").limit(shards * max(2, shard_pieces // 8 << turn))
        opened = opened.select(F.col("sequence").alias("o_sequence"), F.pmod(F.xxhash64("sequence", F.lit(turn)), F.lit(shards)).alias("shard"))
        ranked = _ranked(placed.join(opened, F.col("sequence") == F.col("o_sequence")).select(*[c for c in columns if c != "offset"], "shard").withColumnRenamed("sequence", "old"))
        again = _placed(ranked, capacity, shards, base)
        fewer = again.groupBy("shard").agg(F.count_distinct("sequence").alias("now"), F.count_distinct("old").alias("was")).filter("now < was").select("shard")
        moved = cut(again.join(fewer, "shard", "left_semi").select(*columns))
        if moved.isEmpty():
            continue
        uids = moved.select(F.col("uid").alias("m_uid"))
        placed = cut(placed.join(uids, F.col("uid") == F.col("m_uid"), "left_anti").select(*columns).unionByName(moved))
        base += shards
    return placed


def pack(pieces: DataFrame, capacity: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) and where each is put: sequence_id and offset."""
    names = {c: f"k{i}" for i, c in enumerate(pieces.columns)}
    given = pieces.select(*[F.col(c).alias(x) for c, x in names.items()], F.monotonically_increasing_id().alias("uid"))
    given = cut(given.withColumn("length", F.col(names["length"])))  # the numbers are written, so they do not change
    full = given.filter(F.col("length") == capacity).select("*", F.col("uid").alias("sequence"), F.lit(0).cast("long").alias("offset"))
    rest = given.filter(F.col("length") < capacity)
    put, base, level, before = None, 0, 0, None
    while count := rest.count():
        shards = -(-count // shard_pieces)
        last = shards == 1 or (before is not None and 2 * count > before)
        placed = _placed(_ranked(rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))), capacity, shards, base, GENERATIONS * (LAST_LEVEL if shards == 1 else 1))
        loose = F.lit(False) if last else F.col("filled") <= capacity - LOOSE
        kept = placed.filter(~loose).select(*given.columns, "sequence", "offset")
        put = kept if put is None else put.unionByName(kept)
        rest = placed.filter(loose).select(*given.columns)
        base, level, before = base + shards, level + 1, count
        if last:
            break
    done = full if put is None else full.unionByName(dissolved(put, capacity, shard_pieces, base))
    return done.select(*[F.col(x).alias(c) for c, x in names.items()], F.col("sequence").alias("sequence_id"), "offset")
