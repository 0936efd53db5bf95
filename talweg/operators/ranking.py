"""Rank statistics without a global sort: scores are grouped first and only their counts are put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.quantiles import quantiles, with_quantiles
from talweg.session import cut


def running_counts(counts: DataFrame, keys: list[str], value: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """``counts``, one row per key and value, with ``before_<column>``: the sum over the key's smaller values.

    Values are dealt by range over all tasks and written so, since another deal may draw other bounds; sums within a range are windows, and the ranges' own totals, a row
    for each key and range, give what comes before. No task sees all values.
    """
    ranges = ranges or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(ranges, *keys, value).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "range").orderBy(value)
    inside = dealt.withColumns({f"in_{c}": F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c) for c in columns})
    totals = inside.groupBy(*keys, "range").agg(*[F.sum(c).alias(f"total_{c}") for c in columns])
    across = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*keys, "range", *[F.coalesce(F.sum(f"total_{c}").over(across), F.lit(0)).alias(f"ahead_{c}") for c in columns])
    joined = inside.join(ahead, [*keys, "range"])
    return joined.select(*counts.columns, *[(F.col(f"in_{c}") + F.col(f"ahead_{c}")).alias(f"before_{c}") for c in columns])


def score_counts(rows: DataFrame, keys: list[str], score: str, y: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives of every key and score; NULL scores are left out."""
    n = F.lit(1) if weight is None else weight
    known = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return known.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(y), n).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y), 0).otherwise(n)).alias("neg"))


def auc(rows: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Per key n_pos, n_neg and the rank AUC, ties counting half; NULL where a class is empty."""
    ranked = running_counts(score_counts(rows, keys, score, y), keys, "score", ["neg"])
    wins = F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg")))  # twice the pairs won
    summed = ranked.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("w"))
    return summed.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (2.0 * F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def capture(rows: DataFrame, score: str = "score", y: str = "y", fractions: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """(fraction, captured): the share of positives at or over the (1 - fraction) quantile of the negatives."""
    s = F.col(score)
    found = quantiles(rows.filter(~F.col(y)), [], score, [1 - f for f in fractions])
    pairs = found.select(F.posexplode("quantiles").alias("k", "cut")).select(F.element_at(F.array(*map(F.lit, fractions)), F.col("k") + 1).alias("fraction"), "cut")
    return rows.filter(F.col(y)).join(F.broadcast(pairs)).groupBy("fraction").agg(F.avg(F.when(s >= F.col("cut"), 1.0).otherwise(0.0)).alias("captured"))


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the two columns' ranks, ties having their average rank."""
    def with_rank(df: DataFrame, c: str, name: str) -> DataFrame:
        counts = running_counts(df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")), [], "value", ["n"])
        ranks = counts.select(F.col("value").alias(f"v_{name}"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))
        return df.join(ranks, F.col(c) == F.col(f"v_{name}"))

    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return with_rank(with_rank(known, "a", "rank_a"), "b", "rank_b").agg(F.corr("rank_a", "rank_b").alias("rho"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the median, the interquartile range and the 99th percentile."""
    found = with_quantiles(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), rows, keys, value, [0.25, 0.5, 0.75, 0.99]).withColumnRenamed("quantiles", "q")
    return found.select(*keys, F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), F.get("q", F.lit(3)).alias("p99"))
