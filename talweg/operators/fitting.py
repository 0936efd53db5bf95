"""Parameter search and cross-validation: candidates, samples and folds as rows of one job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from talweg.operators import ranking
from talweg.operators.stability import Soil, draws, failed_draws
from talweg.session import cut

# Fixed values of the search grid.
COHESION_CAPS = (0.05, 0.15, 0.25, 0.40)
FRICTION_BANDS = ((25.0, 35.0), (30.0, 40.0), (35.0, 45.0))
RT_CAPS = (0.0005, 0.002, 0.01, 0.05)


def candidate_soils(depths: tuple[float, ...] = (0.0,)) -> list[Soil]:
    """Every combination, depths outermost; the lower recharge ratio is a fiftieth of the upper."""
    return [Soil((0.0, c), f, (r / 50, r), k) for k, c, f, r in product(depths, COHESION_CAPS, FRICTION_BANDS, RT_CAPS)]


def candidate_draws(spark: SparkSession, soils: list[Soil], n: int, seed: int = 0) -> DataFrame:
    """(cand_id, depth_k, draws): a row per candidate, with its draws in an array; a bounded table."""
    kind = "cand_id int, depth_k double, draws array<struct<c:double,p:double,r:double>>"
    return spark.createDataFrame([(k, s.depth_k, [tuple(map(float, d)) for d in draws(s, n, seed)]) for k, s in enumerate(soils)], kind)


def candidate_scores(samples: DataFrame, candidates: DataFrame, keep: list[str], recharge: Column | None = None) -> DataFrame:
    """``keep``, cand_id and score: each sample's failure probability under each candidate.

    The candidates are the query set: a few rows, which every task holds. A sample meets all draws of all candidates
    as arrays inside its task. Samples without slope or sca drop out.
    """
    rows = candidates.select("cand_id", "depth_k", "draws").collect()  # a row for each candidate
    ids = np.array([r["cand_id"] for r in rows], np.int32)
    tables = [(r["depth_k"], np.array([tuple(d) for d in r["draws"]], float).reshape(-1, 3)) for r in rows]
    shared = samples.sparkSession.sparkContext.broadcast(tables)
    valid = samples.filter(F.col("slope").isNotNull() & F.col("sca").isNotNull())
    scale = F.lit(1.0) if recharge is None else recharge
    given = valid.select(*keep, *[v.cast("double").alias(f"_{k}") for k, v in enumerate((F.col("slope"), F.col("sca"), scale))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slope, sca, rain = (batch.column(len(keep) + k).to_numpy(zero_copy_only=False).astype(float) for k in range(3))
            still = np.zeros(len(slope))
            scores = [failed_draws(slope, sca, rain, still, table, depth_k) / max(1, len(table)) for depth_k, table in shared.value]
            if scores:
                passed = batch.select(keep).take(pa.array(np.tile(np.arange(len(slope)), len(scores)))).columns
                yield pa.RecordBatch.from_arrays([*passed, pa.array(np.repeat(ids, len(slope))), pa.array(np.concatenate(scores))], [*keep, "cand_id", "score"])

    kinds = StructType([*given.schema.fields[: len(keep)], StructField("cand_id", IntegerType()), StructField("score", DoubleType())])
    return given.mapInArrow(run, kinds)


def search(samples: DataFrame, candidates: DataFrame, keys: list[str] | None = None, least: int = 20) -> DataFrame:
    """(keys, cand_id, n_pos, n_neg, auc) where both classes have ``least`` samples at least."""
    keys = keys or []
    scored = candidate_scores(samples, candidates, [*keys, "y"])
    return ranking.auc(scored, [*keys, "cand_id"]).filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least))


def best(trials: DataFrame, keys: list[str] | None = None, value: str = "auc") -> DataFrame:
    """Per key the candidate of the greatest value, the first of equal ones."""
    top = F.max_by(F.struct("cand_id", value), F.struct(F.col(value), -F.col("cand_id"))).alias("b")
    return (trials.groupBy(*keys) if keys else trials.groupBy()).agg(top).select(*(keys or []), "b.*")


def block_folds(spark: SparkSession, n_blocks: int, folds: int, seed: int = 0) -> DataFrame:
    """(block, fold) for blocks numbered from 0: a permutation of the blocks, dealt in turn."""
    order = np.random.default_rng(seed).permutation(n_blocks)
    return spark.createDataFrame([(int(b), int(k % folds)) for k, b in enumerate(order)], "block int, fold int")


def numbered_blocks(points: DataFrame, size: float) -> DataFrame:
    """``points`` (lon, lat) with ``block``, the number of its square of ``size`` degrees among those that have points."""
    square = points.withColumns({"bx": F.floor(F.col("lon") / size), "by": F.floor(F.col("lat") / size)})
    order = Window.partitionBy().orderBy("bx", "by")  # a row for each square that has points
    numbers = square.select("bx", "by").distinct().withColumn("block", F.row_number().over(order) - 1)
    return square.join(numbers, ["bx", "by"]).drop("bx", "by")


def cross_validate(samples: DataFrame, candidates: DataFrame, folds: int, least_train: int = 50, least_test: int = 10) -> DataFrame:
    """(fold, cand_id, train_auc, test_auc): for each fold the candidate best on the others, and how it does on it.

    ``samples`` have y and fold. Every sample is scored once per candidate; for training it is counted under all
    folds but its own, as an array exploded after the score is known.
    """
    scored = candidate_scores(samples, candidates, ["y", "fold"])
    counts = cut(scored.groupBy("fold", "cand_id", "score", "y").agg(F.count(F.lit(1)).alias("n")))  # map-side first
    others = F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold"))
    train = counts.select(F.explode(others).alias("fold"), "cand_id", "score", "y", "n")

    def by_auc(rows: DataFrame, name: str, least: int) -> DataFrame:
        c = ranking.score_counts(rows, ["fold", "cand_id"], "score", "y", F.col("n"))
        ranked = ranking.running_counts(c, ["fold", "cand_id"], "score", ["neg"])
        summed = ranked.groupBy("fold", "cand_id").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg"))).alias("w"))
        return summed.filter((F.col("p") >= least) & (F.col("q") >= least)).select("fold", "cand_id", (F.col("w") / (2.0 * F.col("p") * F.col("q"))).alias(name))

    chosen = best(by_auc(train, "train_auc", least_train), ["fold"], "train_auc")
    return chosen.join(by_auc(counts, "test_auc", least_test), ["fold", "cand_id"])


def summary(folds: DataFrame, value: str = "test_auc") -> DataFrame:
    """Mean and population deviation over the folds."""
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def warnings(report: DataFrame) -> DataFrame:
    """``report`` (in_sample, random_cv, spatial_cv, deviation) with the list of what to beware of."""
    notes = [
        (F.col("random_cv") - F.col("spatial_cv") > 0.03, "random folds score higher than spatial ones"),
        (F.col("deviation") > 0.04, "folds differ widely"),
        (F.col("in_sample") - F.col("spatial_cv") > 0.05, "in-sample fit is better than held-out"),
        (F.col("spatial_cv") < 0.65, "held-out skill is low"),
    ]
    return report.withColumn("warnings", F.array_compact(F.array(*[F.when(test, note) for test, note in notes])))


def random_folds(samples: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """``samples`` with ``fold``, dealt by a hash of ``key``, presences and background each on their own."""
    return samples.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "y", key), F.lit(folds)).cast("int"))


def fit(samples: DataFrame, candidates: DataFrame, random_fold: str, spatial_fold: str, folds: int, least_presence: int = 50, least: int = 20) -> DataFrame:
    """One row: the best candidate, its in-sample AUC, mean AUC over random and spatial folds, their deviation, warnings.

    ``samples`` (slope, sca, y and the two fold columns). With fewer than ``least_presence`` presences there is no row.
    """
    numbers = samples.agg(F.count(F.when(F.col("y"), 1)).alias("n_presence"), F.count(F.when(~F.col("y"), 1)).alias("n_background"))
    whole = best(search(samples, candidates, least=least)).select("cand_id", F.col("auc").alias("in_sample"))

    def folded(column: str, mean: str, deviation: str) -> DataFrame:
        found = cross_validate(samples.withColumn("fold", F.col(column).cast("int")), candidates, folds)
        return summary(found).select(F.col("mean").alias(mean), F.col("deviation").alias(deviation))

    # each of these is one row
    report = numbers.filter(F.col("n_presence") >= least_presence).join(whole).join(folded(random_fold, "random_cv", "random_deviation")).join(folded(spatial_fold, "spatial_cv", "deviation"))
    return warnings(report)


def fit_regions(samples: DataFrame, candidates: DataFrame, region: str = "region", least_presence: int = 100, least_background: int = 20) -> DataFrame:
    """(region, cand_id, auc, own): each region's best candidate, or the best of all samples where it has too few."""
    trials = search(samples.filter(F.col(region).isNotNull()), candidates, [region], 1)
    enough = trials.filter((F.col("n_pos") >= least_presence) & (F.col("n_neg") >= least_background))
    own = best(enough, [region]).select(F.col(region).alias("r"), F.col("cand_id").alias("own_id"), F.col("auc").alias("own_auc"))
    whole = best(search(samples, candidates)).select(F.col("cand_id").alias("all_id"), F.col("auc").alias("all_auc"))  # one row
    regions = samples.filter(F.col(region).isNotNull()).select(region).distinct().join(F.broadcast(whole))
    met = regions.join(own, F.col(region) == F.col("r"), "left")
    return met.select(region, F.coalesce("own_id", "all_id").alias("cand_id"), F.coalesce("own_auc", "all_auc").alias("auc"), F.col("own_id").isNotNull().alias("own"))
