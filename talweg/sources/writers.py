"""Results as GeoJSON, JSON for pages, grids as tables, quick images and the manifest of a run."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.scores import ramp


def rounded(points: Column, digits: int = 5) -> Column:
    return F.transform(points, lambda p: F.array(F.bround(p["lon"], digits), F.bround(p["lat"], digits)))


def point_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.bround("lon", 5), F.bround("lat", 5)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def line_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    geometry = F.struct(F.lit("LineString").alias("type"), rounded(F.col("coords")).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """``features`` (feature, as text) as GeoJSON collections in the folder ``path``, one for each partition that has any."""
    write_objects(features.select("feature"), path, '{"type": "FeatureCollection", "features": [')


ROWS_AT_ONCE = 500


def write_objects(objects: DataFrame, path: str, head: str) -> None:
    """Objects (one column of text) in an array behind ``head``, a file in the folder ``path`` for each partition that has any."""

    def collected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = head
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([(before if k == 0 else ",") + row for k, row in enumerate(rows)])], ["value"])
                before = ","
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"])], ["value"])

    objects.mapInArrow(collected, "value string").write.mode("overwrite").text(path)


def records(scored: DataFrame, baseline: str = "current") -> DataFrame:
    """(asset_id, record): an asset's scores of all scenarios as nested JSON, the baseline's on top."""
    inner = F.map_from_entries(F.sort_array(F.collect_list(F.struct("scenario", F.struct("score", "on_site", "reaching").alias("v")))))
    top = F.max(F.when(F.col("scenario") == baseline, F.col("score")))
    out = scored.groupBy("asset_id").agg(top.alias("score"), inner.alias("scenarios"))
    return out.select("asset_id", F.to_json(F.struct("asset_id", "score", "scenarios")).alias("record"))


def page_data(name: str, text: str) -> str:
    """A script that sets a page's data from JSON text, so that the page works without a server."""
    return f"window.PAGE_DATA = window.PAGE_DATA || {{}};\nwindow.PAGE_DATA[{json.dumps(name)}] = JSON.parse({json.dumps(text)});\n"


def write_layer(rows: DataFrame, path: str, tile: int = 256) -> None:
    """A grid's cells as Parquet, written as a whole or not at all, neighbouring cells near each other."""
    placed = rows.withColumns({"tile_row": (F.col("row") / tile).cast("int"), "tile_col": (F.col("col") / tile).cast("int")})
    placed.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "row", "col").drop("tile_row", "tile_col").write.mode("overwrite").parquet(path)


def thumbnail(rows: DataFrame, value: str, factor: int) -> DataFrame:
    """(row, col, value) of blocks of ``factor`` cells: their mean."""
    block = lambda c: (F.col(c) / factor).cast("int").alias(c)
    return rows.filter(F.col(value).isNotNull()).groupBy(block("row"), block("col")).agg(F.avg(value).alias(value))


def png(pixels: DataFrame, value: str, height: int, width: int, alpha: int = 205, most: int = 4_000_000) -> bytes:
    """An image of a small grid (row, col, value 0..1) in the colour ramp, clear where there is no data."""
    if height * width > most:
        raise ValueError("too many pixels for one image; make a thumbnail first")
    found = pixels.filter(F.col(value).isNotNull()).select("row", "col", *[ramp(F.col(value), k).alias(f"c{k}") for k in range(3)]).toArrow()
    row, col, *colour = (found.column(c).to_numpy() for c in found.column_names)
    image = np.zeros((height, width, 4), np.uint8)
    image[row, col] = np.stack([*colour, np.full(len(row), alpha)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\x00" + r.tobytes() for r in image))) + chunk(b"IEND", b"")


def manifest(products: DataFrame, settings: dict) -> str:
    """JSON of a run: its settings, its products by kind, and the sources they name."""
    kinds = products.groupBy("kind").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.array_sort(F.collect_set("source")).alias("sources")).orderBy("kind").collect()
    sources = sorted({s for r in kinds for s in r["sources"]})
    return json.dumps({"settings": settings, "products": {r["kind"]: r["paths"] for r in kinds}, "sources": sources}, indent=1, sort_keys=True)
