"""Cells (row, col, values) brought together by tiles of the grid, as few packed rows instead of one row a cell.

A task packs the cells that it reads before they are shuffled: a row for each tile that they are in, with their
places and values as bytes of whole arrays. Cells near a tile's border also go to the tiles around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_ONCE = 200_000  # cells packed at once


def in_tiles(row: np.ndarray, col: np.ndarray, tall: int, wide: int, rows: int = 0, cols: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which cells are in, or up to ``rows`` and ``cols`` around, which tiles (cell's number, tile_row, tile_col)."""
    number, high, low = np.arange(len(row)), (row - rows) // tall, (row + rows) // tall
    left, right = (col - cols) // wide, (col + cols) // wide
    if (low > high + 1).any() or (right > left + 1).any():
        raise ValueError("tiles must be at least as large as twice what is around them")
    down, over = low > high, right > left
    parts = [(number, high, left)]
    for some, a, b in ((down, low, left), (over, high, right), (down & over, low, right)):
        parts.append((number[some], a[some], b[some]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pieces(cells: DataFrame, tags: list[str], values: list[str], tall: int, wide: int, rows: int = 0, cols: int = 0) -> DataFrame:
    """(tags, tile_row, tile_col, at, values): the cells of a task by tags and tile.

    ``at`` holds rows and then columns (int32), and each value doubles, NaN for NULL.
    """
    given = cells.filter("row IS NOT NULL AND col IS NOT NULL").select(*tags, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(v).cast("double").alias(v) for v in values])
    names = [*tags, "tile_row", "tile_col", "at", *values]
    kinds = [*[given.schema[t].dataType.simpleString() for t in tags], "int", "int", *["binary"] * (1 + len(values))]

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        coded = [table.column(t).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for t in tags]
        number, tile_row, tile_col = in_tiles(row, col, tall, wide, rows, cols)
        keys = [*[c[number] for c in coded], tile_row, tile_col]
        order = np.lexsort(keys[::-1])
        number, keys = number[order], [k[order] for k in keys]
        opens = np.ones(len(number), bool)
        opens[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.flatnonzero(opens)
        runs = list(zip(first.tolist(), [*first[1:].tolist(), len(number)], strict=True))
        row, col = row[number].astype(np.int32), col[number].astype(np.int32)
        columns = [table.column(t).take(pa.array(number[first])).combine_chunks() for t in tags]
        columns += [pa.array(k[first].astype(np.int32)) for k in keys[-2:]]
        columns.append(pa.array([row[a:b].tobytes() + col[a:b].tobytes() for a, b in runs], pa.binary()))
        for v in values:
            held = table.column(v).to_numpy()[number]
            columns.append(pa.array([held[a:b].tobytes() for a, b in runs], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return given.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def places(packed: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows and columns of some ``at``."""
    both = [np.frombuffer(b, np.int32).reshape(2, -1) for b in packed]
    return tuple(np.concatenate([b[k] for b in both]) if both else np.zeros(0, np.int32) for k in (0, 1))


def numbers(packed: Iterable[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.frombuffer(b, np.float64) for b in packed]])


def whole(cells: DataFrame, tags: list[str], values: list[str], size: int, around: int = 0) -> DataFrame:
    """``pieces`` of square tiles joined, so that there is one row for each tags and tile."""
    parts = pieces(cells, tags, values, size, size, around, around)
    names = parts.columns

    def joined(table: pa.Table) -> pa.Table:
        row, col = places(table.column("at").to_pylist())
        columns = [table.column(k).slice(0, 1) for k in (*tags, "tile_row", "tile_col")]
        columns += [pa.array([row.tobytes() + col.tobytes()], pa.binary())] + [pa.array([numbers(table.column(v).to_pylist()).tobytes()], pa.binary()) for v in values]
        return pa.table(columns, names=names)

    return parts.groupBy(*tags, "tile_row", "tile_col").applyInArrow(joined, parts.schema)


def each(tiles: DataFrame, work: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``work`` makes of each row of ``tiles``, given as its Arrow values by column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if (made := work({n: c[i] for n, c in zip(batch.schema.names, batch.columns, strict=True)})) is not None:
                    yield made

    return tiles.mapInArrow(run, schema)
