"""Exposure of assets that arrive as files: scored against a standing reach table, batch by batch.

The grid's scores per cell stay put; arriving assets are joined to them as a stream to a table, and each batch
replaces the batch's own part of the output, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talweg.functions.scores import band

ASSETS = "asset_id long, name string, row int, col int, seen timestamp"


def cell_scores(edges: DataFrame, probability: DataFrame) -> DataFrame:
    """(row, col, scenario, score) of every cell that assets can be in: ``edges`` (to_row, to_col, row, col, w)."""
    met = edges.join(probability.filter("p IS NOT NULL"), ["row", "col"])
    reaching = met.groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "scenario").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("reaching"))
    site = probability.join(reaching, ["row", "col", "scenario"], "left")
    return site.select("row", "col", "scenario", F.greatest("p", F.coalesce("reaching", F.lit(0.0))).alias("score"))


def scored_stream(spark: SparkSession, assets_dir: str, scores: DataFrame) -> DataFrame:
    """New asset files as a stream, each asset with its score under every scenario."""
    arriving = spark.readStream.schema(ASSETS).json(assets_dir)
    met = arriving.join(scores.select("row", "col", "scenario", "score"), ["row", "col"])
    return met.select("asset_id", "name", "seen", "scenario", "score", band(F.col("score")).alias("band"))


def write_scores(scored: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Works off what has arrived, then ends; started again, it goes on with what came since."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def exposed_per_window(scored: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Per time window and scenario how many assets came and how many of them are exposed; late ones within bounds count."""
    windowed = scored.withWatermark("seen", lateness).groupBy(F.window("seen", width).alias("w"), "scenario")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.08).alias("n_exposed")).select("w.start", "w.end", "scenario", "n", "n_exposed")
