"""The objects in the arrays of large JSON files, such as the features of a collection, read by many tasks.

A file is cut into ranges of bytes anywhere. What a range holds depends on whether it begins inside a string and how
deep, so each range is first summed up for every way that it may begin (outside a string, inside one, behind a
backslash in one): how it ends and by how much it is deeper then. Chained over a file's ranges these give how each
begins, and then each range is read again and cuts out the objects that begin in it, reading on behind its end for the
last of them. A range is looked at in blocks, so no task holds more than a block, an object and a batch of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.sources import files

RANGE_BYTES = 16 << 20
BLOCK_BYTES, BEHIND_BYTES = 1 << 19, 1 << 16  # of a range, and behind its end, that are looked at at once
OUTSIDE, INSIDE, ESCAPED = range(3)
QUOTE, BACKSLASH = ord('"'), ord("\\")
DEEPER = np.zeros(256, np.int8)
DEEPER[[ord("{"), ord("[")]], DEEPER[[ord("}"), ord("]")]] = 1, -1


def scanned(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(change of depth at each byte, state behind the last) of bytes that begin in ``state``."""
    slash = data == BACKSLASH
    # a byte is escaped if an odd number of backslashes stands right before it
    slots = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, slots))
    run = slots - last_other  # backslashes up to and with this byte
    if state == ESCAPED:  # one more stands before the first byte
        run[last_other == -1] += 1
    odd = slash & (run % 2 == 1)
    escaped = np.concatenate([[state == ESCAPED], odd[:-1]]) if len(data) else odd
    quotes = (data == QUOTE) & ~escaped
    inside = (np.cumsum(quotes) + (state != OUTSIDE)) % 2 == 1  # behind the byte
    within = inside | quotes
    change = np.where(within, 0, DEEPER[data])
    if not len(data):
        return change, state
    end = OUTSIDE if not inside[-1] else ESCAPED if odd[-1] else INSIDE
    return change, end


def _is_value(read, body: bytes, start: int, at: int) -> bool:
    """Whether what begins at ``body[at]`` stands behind a name, so in an object and not in an array."""
    before = body[max(0, at - 256) : at].rstrip() or body[:at].rstrip()
    while not before and start > 0:  # only white space up to the range's beginning
        size = min(start, 4_096)
        start -= size
        before = read(start, size).rstrip()
    return before.endswith(b":")


def summed_up(read, start: int, stop: int) -> tuple[list[int], list[int]]:
    """For each way that bytes [start, stop) may begin, the state behind them and by how much they are deeper then."""
    ends, deeper = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    for at in range(start, stop, BLOCK_BYTES):
        data = np.frombuffer(read(at, min(BLOCK_BYTES, stop - at)), np.uint8)
        for k, state in enumerate(ends):
            change, ends[k] = scanned(data, state)
            deeper[k] += int(change.sum(dtype=np.int64))
    return ends, deeper


def objects_in(read, start: int, stop: int, size: int, state: int, depth: int, level: int) -> Iterator[bytes]:
    """The objects that begin in bytes [start, stop) ``level`` deep, from a range that begins in ``state`` and ``depth``."""
    at, parts = start, []  # parts of an object that is not shut yet
    while at < stop or (parts and at < size):
        body = read(at, min(BLOCK_BYTES, stop - at) if at < stop else min(BEHIND_BYTES, size - at))
        data = np.frombuffer(body, np.uint8)
        change, state = scanned(data, state)
        deep = depth + np.cumsum(change, dtype=np.int64)  # behind each byte
        shuts = np.flatnonzero((change == -1) & (deep == level))
        if parts:
            parts.append(body[: shuts[0] + 1] if len(shuts) else body)
            if len(shuts):
                yield b"".join(parts)
                parts = []
        if at < stop:
            opens = np.flatnonzero((change == 1) & (deep == level + 1) & (data == ord("{")))
            opens = opens[[not _is_value(read, body, at, a) for a in opens.tolist()]] if len(opens) else opens
            ends = np.searchsorted(shuts, opens)
            whole = ends < len(shuts)
            for a, b in zip(opens[whole].tolist(), shuts[ends[whole]].tolist(), strict=True):
                yield body[a : b + 1]
            if not whole.all():  # the last one goes on behind the block
                parts = [body[opens[~whole][0] :]]
        depth = int(deep[-1])
        at += len(body)


def objects(spark: SparkSession, path: str, level: int = 2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value) the text of every object that stands ``level`` deep: at 2, those in arrays of the file's own object."""
    found = files.listed(path, (".json", ".geojson", ".txt"))
    rows = spark.createDataFrame([(uri, size) for uri, size in found if size], "uri string, size long")
    starts = rows.select("uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = sum(-(-size // range_bytes) for _, size in found)
    ranges = starts.select("uri", "size", "start", F.least(F.col("start") + range_bytes, "size").alias("stop")).repartition(max(1, min(n, 10_000)), "uri", "start")

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, deeper = [], []
            for uri, _, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.Ranges(uri) as read:
                    found = summed_up(read, start, stop)
                ends.append(found[0])
                deeper.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32())), pa.array(deeper, pa.list_(pa.int64()))], [*batch.schema.names, "ends", "deeper"])

    def chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, size, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, depth = OUTSIDE, 0
                for r in own:
                    out.append((uri, size, r["start"], r["stop"], state, depth))
                    depth += r["deeper"][state]
                    state = r["ends"][state]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["uri", "size", "start", "stop", "state", "depth"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, start, stop, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.Ranges(uri) as read:
                    held, taken = [], 0
                    for body in objects_in(read, start, stop, size, state, depth, level):
                        held.append(body.decode("utf-8", "replace"))
                        taken += len(body)
                        if taken > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                            held, taken = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])

    ways = ranges.mapInArrow(summed, "uri string, size long, start long, stop long, ends array<int>, deeper array<long>")
    # a list has an entry for each range of the file
    lists = ways.groupBy("uri", "size").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "ends", "deeper"))).alias("own"))
    begun = lists.mapInArrow(chained, "uri string, size long, start long, stop long, state int, depth long")
    return begun.repartition(max(1, min(n, 10_000)), "uri", "start").mapInArrow(cut, "value string")
