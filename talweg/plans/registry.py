"""All registered queries, with the SQL that DuckDB runs on the same tables where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talweg.plans import assets, formats, made, mechanics, runs, summaries, terrain

MODULES = (terrain, mechanics, assets, summaries, runs, formats, made)
ALL = {name: pair for module in MODULES for name, pair in module.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ALL["q_dinf_direction"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
