"""Exact quantiles of groups of any size, by ranges instead of sorting.

A quantile lies between two values of known ranks. Which range of values holds a rank is found by counting values in
bins, whose prefix sums name the bin; its least and greatest value are the next range. Once a range holds few values,
or one value many times, it is done. Counting is combined before it is shuffled, so a round costs one pass and a
few thousand counts a group; no task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.session import stored

BINS, FEW = 2_000, 500


def _bin(value: Column, low: Column, high: Column) -> Column:
    """0 to ``BINS`` - 1, rising with the value."""
    share = (value / 2 - low / 2) / (high / 2 - low / 2)  # halves, since the span of doubles may be no double
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def order_statistics(rows: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """(keys, k, value): the k-th smallest ``v`` of ``rows``, from 0, for each key and k in ``ranks``.

    ``ranks`` also has each key's least and greatest value and their number (low, high, n); keys must not be null.
    """
    meet = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # noqa: E731  without keys there is a row for each rank
    state = stored(ranks.withColumn("before", F.lit(0).cast("long")))
    done = state.filter(F.col("low") == F.col("high"))
    few = state.filter((F.col("low") < F.col("high")) & (F.col("n") <= FEW))
    open_ = state.filter((F.col("low") < F.col("high")) & (F.col("n") > FEW))
    while not open_.isEmpty():
        inside = meet(rows, open_).filter("v BETWEEN low AND high")
        counts = inside.groupBy(*keys, "k", "before", _bin(F.col("v"), F.col("low"), F.col("high")).alias("bin")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
        order = Window.partitionBy(*keys, "k").orderBy("bin")  # at most BINS rows
        upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("ahead", F.col("before") + upto - F.col("n"))
        state = stored(placed.filter("ahead <= k AND k < ahead + n").select(*keys, "low", "high", "n", "k", F.col("ahead").alias("before")))
        done = done.unionByName(state.filter(F.col("low") == F.col("high")))
        few = few.unionByName(state.filter((F.col("low") < F.col("high")) & (F.col("n") <= FEW)))
        open_ = state.filter((F.col("low") < F.col("high")) & (F.col("n") > FEW))
    held = meet(rows, few).filter("v BETWEEN low AND high").groupBy(*keys, "k", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    chosen = held.select(*keys, "k", F.get("vs", (F.col("k") - F.col("before")).cast("int")).alias("value"))
    return done.select(*keys, "k", F.col("low").alias("value")).unionByName(chosen)


def quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """(keys, quantiles): for each key an array of the quantiles of its known values, between neighbours in proportion.

    The same as exact percentiles of Spark and DuckDB; keys without a known value are left out, null keys are not.
    """
    names = [f"key_{i}" for i in range(len(keys))]
    coded = rows.select(*[F.coalesce(F.to_json(F.struct(c)), F.lit("{}")).alias(x) for c, x in zip(keys, names, strict=True)], *[F.col(c).alias(f"own_{i}") for i, c in enumerate(keys)], F.col(value).cast("double").alias("v"))
    known = stored(coded.filter("v IS NOT NULL AND NOT isnan(v)"))
    own = [F.first(f"own_{i}").alias(f"own_{i}") for i in range(len(keys))]
    sizes = stored(known.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), *own).filter("n > 0"))
    wanted = sizes.select(*names, "low", "high", "n", F.posexplode(F.array(*[F.lit(f) * (F.col("n") - 1) for f in fractions])).alias("i", "at"))
    wanted = wanted.select(*names, "low", "high", "n", "i", F.floor("at").alias("k"), F.ceil("at").alias("k1"), (F.col("at") - F.floor("at")).alias("part"))
    ranks = wanted.select(*names, "low", "high", "n", F.explode(F.array("k", "k1")).alias("k")).distinct()
    found = stored(order_statistics(known.select(*names, "v"), names, ranks))
    low = found.select(*[F.col(x).alias(f"a_{x}") for x in names], F.col("k").alias("a_k"), F.col("value").alias("a"))
    high = found.select(*[F.col(x).alias(f"b_{x}") for x in names], F.col("k").alias("b_k"), F.col("value").alias("b"))
    same = lambda side, k: [F.col(x) == F.col(f"{side}_{x}") for x in names] + [F.col(k) == F.col(f"{side}_k")]
    met = wanted.join(low, same("a", "k")).join(high, same("b", "k1"))
    between = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    arrays = met.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", between.alias("q")))), lambda s: s.q).alias("quantiles")).filter(F.size("quantiles") > 0)
    if not keys:
        return arrays
    own = sizes.select(*[F.col(x).alias(f"o_{x}") for x in names], *[F.col(f"own_{i}").alias(c) for i, c in enumerate(keys)])
    return arrays.join(own, [F.col(x) == F.col(f"o_{x}") for x in names]).select(*keys, "quantiles")


def with_quantiles(base: DataFrame, rows: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """``base``, a row for each key, with ``quantiles`` of ``rows``; NULL where no value is known."""
    found = quantiles(rows, keys, value, fractions)
    found = found.select(*[F.col(c).alias(f"q_{c}") for c in keys], "quantiles")
    same = [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in keys] or F.lit(True)
    return base.join(found, same, "left").drop(*[f"q_{c}" for c in keys])
