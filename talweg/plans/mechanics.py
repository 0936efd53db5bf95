"""Queries on samples: slope mechanics, triggers, rank statistics, validation and fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from talweg.functions import mechanics as M
from talweg.functions import triggers as T
from talweg.operators import fitting, ranking, stability, validation
from talweg.operators.stability import Soil
from talweg.plans.terrain import r6
from talweg.plans.views import DRAW_ROWS, DRAWS, SAMPLES, samples, table

SOIL = {"cohesion": 0.1, "friction_deg": 33.0, "rt": 0.002}


def fs_sql(c="c", p="p", r="r", k="0e0", depth="0e0", slope="slope", sca="sca") -> str:
    sine, cosine = f"sin(atan({slope}))", f"cos(atan({slope}))"
    wet = f"least(greatest({r} * {sca} / {sine}, 0e0), 1e0)"
    factor = f"CASE WHEN {depth} = 0 THEN 1e0 ELSE exp({depth} * (least({slope}, {M.TAN_60!r}) - {M.TAN_30!r})) END"
    return f"({c} * ({factor}) + ({cosine} - {k} * {sine} - {wet} * 5e-1 * {cosine}) * tan(radians({p}))) / ({sine} + {k} * {cosine})"


def q_wetness(spark, sf_dir):
    return samples(spark, sf_dir).select("id", r6(M.wetness("slope", "sca", SOIL["rt"] / 10), "wetness"))


WETNESS_SQL = f"WITH {SAMPLES} SELECT id, round(least(greatest(2e-4 * sca / sin(atan(slope)), 0e0), 1e0), 6) AS wetness FROM samples"


def q_depth_factor(spark, sf_dir):
    return samples(spark, sf_dir).select("id", r6(M.depth_factor("slope", 1.5), "factor"))


DEPTH_SQL = f"WITH {SAMPLES} SELECT id, round(exp(15e-1 * (least(slope, {M.TAN_60!r}) - {M.TAN_30!r})), 6) AS factor FROM samples"


def q_factor_of_safety(spark, sf_dir):
    fs = M.factor_of_safety("slope", "sca", *SOIL.values(), k_h=0.1, depth_k=1.5)
    return samples(spark, sf_dir).select("id", r6(fs, "fs"))


FS_SQL = f"WITH {SAMPLES} SELECT id, round({fs_sql('1e-1', '33e0', '2e-3', '1e-1', '15e-1')}, 6) AS fs FROM samples"


def q_critical_accel(spark, sf_dir):
    return samples(spark, sf_dir).select("id", r6(M.critical_acceleration("slope", "sca", *SOIL.values()), "kc"))


KC_SQL = f"""WITH {SAMPLES} SELECT id, round((1e-1 + cos(atan(slope)) * (1 - least(greatest(2e-3 * sca / sin(atan(slope)), 0e0), 1e0) * 5e-1) * tan(radians(33e0)) - sin(atan(slope)))
/ (cos(atan(slope)) + sin(atan(slope)) * tan(radians(33e0))), 6) AS kc FROM samples"""


def q_failure_probability(spark, sf_dir):
    out = stability.failure_probability(samples(spark, sf_dir).select("id", "slope", "sca"), np.array(DRAWS))
    return out.select("id", r6("probability", "probability"))


PROBABILITY = f"prob AS (SELECT id, count(*) FILTER (WHERE {fs_sql()} < 1) / 20e0 AS probability FROM samples CROSS JOIN draws GROUP BY id)"
PROBABILITY_SQL = f"WITH {SAMPLES}, {DRAW_ROWS}, {PROBABILITY} SELECT id, round(probability, 6) AS probability FROM prob"


def q_failure_probability_builtin(spark, sf_dir):
    one = F.lit(1.0)
    share = stability.probability_builtin(DRAWS, F.col("slope"), F.col("sca"), one, F.lit(0.0))
    return samples(spark, sf_dir).select("id", r6(share, "probability"))


RANGE = Soil(cohesion=(0.01, 0.238), friction_deg=(24.0, 43.0), rt=(0.0002, 0.00419))


def q_stability_class(spark, sf_dir):
    out = stability.classes(samples(spark, sf_dir).select("id", "slope", "sca"), RANGE, np.array(DRAWS))
    return out.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = f"""WITH {SAMPLES}, {DRAW_ROWS}, {PROBABILITY}, ends AS (
  SELECT id, {fs_sql('1e-2', '24e0', '419e-5')} AS worst, {fs_sql('238e-3', '43e0', '0e0')} AS best FROM samples)
SELECT CASE WHEN best < 1 THEN 6 WHEN worst > 15e-1 THEN 1 WHEN worst > 125e-2 THEN 2 WHEN probability <= 0 THEN 3
  WHEN probability < 5e-1 THEN 4 ELSE 5 END AS class, count(*) AS n FROM prob JOIN ends USING (id) GROUP BY 1"""


def q_regional_safety(spark, sf_dir):
    kind = "region int, cohesion double, friction_deg double, rt double"
    regions = spark.createDataFrame([(0, 0.05, 30.0, 0.001), (1, 0.2, 38.0, 0.0005), (3, 0.0, 35.0, 0.002)], kind)
    out = stability.regional_probability(samples(spark, sf_dir), regions, (0.1, 33.0, 0.0015))
    return out.select("id", "region", r6("fs", "fs"))


REGIONAL_SQL = f"""WITH {SAMPLES}, regions AS (SELECT * FROM (VALUES (0, 5e-2, 30e0, 1e-3), (1, 2e-1, 38e0, 5e-4), (3, 0e0, 35e0, 2e-3)) AS r(region, c, p, r)),
met AS (SELECT s.*, coalesce(c, 1e-1) AS c, coalesce(p, 33e0) AS p, coalesce(r.r, 15e-4) AS r FROM samples s LEFT JOIN regions r ON s.region = r.region)
SELECT id, region, round({fs_sql()}, 6) AS fs FROM met"""


#: Draws of three regions and, under -1, those of all others.
REGION_DRAWS = {
    0: [(round(c + 0.05, 6), p, r) for c, p, r in DRAWS],
    1: [(c, p + 3, r) for c, p, r in DRAWS],
    3: [(c, p - 2, round(2 * r, 6)) for c, p, r in DRAWS],
    -1: DRAWS,
}


def q_regional_probability(spark, sf_dir):
    region = F.when(F.col("region") != 5, F.col("region")).alias("region")
    rows = samples(spark, sf_dir).select("id", "slope", "sca", region, (1 + F.col("years") / 500).alias("recharge"), (F.col("pga") / 5).alias("k_h"))
    tables = {r: np.array(t) for r, t in REGION_DRAWS.items()}
    out = stability.regional_failure_probability(rows, {r: t for r, t in tables.items() if r >= 0}, tables[-1])
    return out.select("id", "region", r6("probability", "probability"))


REGION_DRAW_ROWS = "region_draws AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {c:e}, {p:e}, {r:e})" for k, t in REGION_DRAWS.items() for c, p, r in t) + ") AS d(used, c, p, r))"
REGIONAL_PROBABILITY_SQL = f"""WITH {SAMPLES}, {REGION_DRAW_ROWS}, placed AS (
  SELECT id, slope, sca, 1 + years / 500 AS recharge, pga / 5 AS k_h, nullif(region, 5) AS region, CASE WHEN region IN (0, 1, 3) THEN region ELSE -1 END AS used FROM samples)
SELECT id, region, CASE WHEN region IS NOT NULL THEN round(count(*) FILTER (WHERE {fs_sql(r='(r * recharge)', k='k_h')} < 1) / 20e0, 6) END AS probability
FROM placed JOIN region_draws USING (used) GROUP BY id, region"""


def q_recharge_multiplier(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("years").agg(F.count(F.lit(1)).alias("n")).select("years", "n", r6(T.recharge_multiplier(F.col("years")), "multiplier"))


def _gumbel(years: str) -> str:
    return f"({T.GUMBEL_SCALE!r} * (-ln(-ln(1 - 1 / {years})) - {T.EULER!r}))"


MULTIPLIER_SQL = f"WITH {SAMPLES} SELECT years, count(*) AS n, round((1 + 3e-1 * {_gumbel('years')}) / (1 + 3e-1 * {_gumbel('2e0')}), 6) AS multiplier FROM samples GROUP BY years"


def q_return_period(spark, sf_dir):
    z = (F.col("years") / 50 - 2).alias("z")
    return samples(spark, sf_dir).select(z).distinct().select(r6("z", "z"), r6(T.return_period(F.col("z")), "years"))


RETURN_SQL = f"WITH {SAMPLES}, z AS (SELECT DISTINCT years / 50 - 2 AS z FROM samples) SELECT round(z, 6) AS z, round(1 / greatest(1 - exp(-exp(-(z / {T.GUMBEL_SCALE!r} + {T.EULER!r}))), 1e-9), 6) AS years FROM z"


def q_seismic_terms(spark, sf_dir):
    kind = F.when(F.col("pga") > 0.5, "earthquake").otherwise("rainfall")
    rows = samples(spark, sf_dir).select("id", kind.alias("kind"), "years", "pga")
    return rows.select("id", "kind", r6(T.recharge_term(F.col("kind"), F.col("years")), "multiplier"), r6(T.shaking_term(F.col("kind"), F.col("pga")), "k_h"), T.describe_trigger(F.col("kind"), F.col("years"), F.col("pga")).alias("description"))


SEISMIC_SQL = f"""WITH {SAMPLES}, k AS (SELECT id, CASE WHEN pga > 5e-1 THEN 'earthquake' ELSE 'rainfall' END AS kind, years, pga FROM samples)
SELECT id, kind, round(CASE kind WHEN 'earthquake' THEN 1e0 ELSE (1 + 3e-1 * {_gumbel('years')}) / (1 + 3e-1 * {_gumbel('2e0')}) END, 6) AS multiplier,
       round(CASE kind WHEN 'earthquake' THEN 5e-1 * pga ELSE 0e0 END, 6) AS k_h,
       CASE kind WHEN 'earthquake' THEN 'earthquake, PGA ' || format('{{:.2f}}', pga) || ' g' ELSE 'rainfall, ' || CAST(years AS INT) || '-year return period' END AS description FROM k"""


def _precipitation(spark, sf_dir):
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy(F.col("c_nationkey").alias("unit"), F.month("o_orderdate").alias("month")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e7 - 5).alias("mm"))


PRECIPITATION = "precip AS (SELECT c_nationkey AS unit, month(o_orderdate) AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e7 - 5 AS mm FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def q_wettest_month(spark, sf_dir):
    return stability.wettest_month(_precipitation(spark, sf_dir), ["unit"]).select("unit", r6("mm", "mm"))


WETTEST_SQL = f"WITH {PRECIPITATION} SELECT unit, round(max(CASE WHEN mm >= 0 THEN mm END), 6) AS mm FROM precip GROUP BY unit"


def q_recharge_scale(spark, sf_dir):
    rain = stability.wettest_month(_precipitation(spark, sf_dir), ["unit"])
    reference = stability.reference_recharge(rain)
    return rain.join(F.broadcast(reference)).select("unit", r6(F.col("mm") / F.col("reference"), "scale"))  # one row


SCALE_SQL = f"""WITH {PRECIPITATION}, wet AS (SELECT unit, max(CASE WHEN mm >= 0 THEN mm END) AS mm FROM precip GROUP BY unit),
ref AS (SELECT coalesce(nullif(median(CASE WHEN mm > 0 THEN mm END), 0), nullif(avg(mm), 0), 1e0) AS reference FROM wet)
SELECT unit, round(mm / reference, 6) AS scale FROM wet CROSS JOIN ref"""


def q_auc(spark, sf_dir):
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    out = ranking.auc(met.select(F.col("n_chars").alias("score"), (F.col("quality") == 1).alias("y")), [])
    return out.select("n_pos", "n_neg", r6("auc", "auc"))


AUC_SQL = """WITH s AS (SELECT n_chars AS score, quality = 1 AS y FROM labels JOIN documents USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rk FROM s),
t AS (SELECT count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(rk) FILTER (WHERE y) AS w FROM r)
SELECT p AS n_pos, n AS n_neg, round((w - p * (p + 1) / 2e0) / (p * n), 6) AS auc FROM t"""


def q_auc_by_group(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("y"))
    return ranking.auc(rows, ["line"]).select("line", "n_pos", "n_neg", r6("auc", "auc"))


AUC_GROUP_SQL = """WITH s AS (SELECT l_linenumber AS line, l_quantity AS score, l_returnflag = 'R' AS y FROM lineitem),
r AS (SELECT line, y, rank() OVER (PARTITION BY line ORDER BY score) + (count(*) OVER (PARTITION BY line, score) - 1) / 2e0 AS rk FROM s),
t AS (SELECT line, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(rk) FILTER (WHERE y) AS w FROM r GROUP BY line)
SELECT line, p AS n_pos, n AS n_neg, round((w - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM t"""


def q_capture(spark, sf_dir):
    rows = samples(spark, sf_dir).select(F.col("sca").alias("score"), "y")
    return ranking.capture(rows).select(r6("fraction", "fraction"), r6("captured", "captured"))


CAPTURE_SQL = f"""WITH {SAMPLES}, cuts AS (SELECT unnest([5e-2, 1e-1, 2e-1]) AS fraction, unnest(quantile_cont(sca, [95e-2, 9e-1, 8e-1])) AS cut FROM samples WHERE NOT y)
SELECT round(fraction, 6) AS fraction, round(avg(CASE WHEN sca >= cut THEN 1e0 ELSE 0e0 END), 6) AS captured FROM samples CROSS JOIN cuts WHERE y GROUP BY fraction"""


def q_rank_corr(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return ranking.rank_correlation(rows, "l_quantity", "l_extendedprice").select(r6("rho", "rho"))


CORR_SQL = """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS a,
rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r"""


def q_spread(spark, sf_dir):
    out = ranking.spread(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select(F.col("o_orderpriority").alias("priority"), r6("median", "median"), r6("iqr", "iqr"), r6("p99", "p99"))


SPREAD_SQL = "SELECT o_orderpriority AS priority, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY 1"


def _binned(spark, sf_dir):
    rows = samples(spark, sf_dir).select("id", F.col("sca").alias("v"), "y")
    edges = validation.quantile_edges(rows, "v")
    return rows.join(F.broadcast(edges)).withColumn("bin", validation.bin_of(F.col("v"), F.col("edges")))  # one row


def q_quantile_bins(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("v"), "low"), r6(F.max("v"), "high"))


BINNED = "edges AS (SELECT quantile_cont(sca, [2e-1, 4e-1, 6e-1, 8e-1]) AS e FROM samples WHERE sca > 0),\nbinned AS (SELECT id, sca AS v, y, len(list_filter(e, lambda x: x <= sca)) + 1 AS bin FROM samples CROSS JOIN edges)"
BINS_SQL = f"WITH {SAMPLES}, {BINNED} SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high FROM binned GROUP BY bin"


def q_frequency_ratio(spark, sf_dir):
    out = validation.frequency_ratios(_binned(spark, sf_dir), F.col("y"), "bin")
    return out.select("bin", "n_cells", "n_presence", *[r6(c, c) for c in ("area_percent", "presence_percent", "ratio")])


RATIOS = """ratios AS (SELECT CAST(bin AS INT) AS bin, count(*) AS n_cells, count(*) FILTER (WHERE y) AS n_presence,
  1e2 * count(*) / (SELECT count(*) FROM binned) AS area_percent, 1e2 * count(*) FILTER (WHERE y) / (SELECT count(*) FROM binned WHERE y) AS presence_percent FROM binned GROUP BY bin)"""
RATIO_SQL = f"WITH {SAMPLES}, {BINNED}, {RATIOS} SELECT bin, n_cells, n_presence, round(area_percent, 6) AS area_percent, round(presence_percent, 6) AS presence_percent, round(presence_percent / area_percent, 6) AS ratio FROM ratios"


def q_verdict(spark, sf_dir):
    binned = _binned(spark, sf_dir)
    aucs = ranking.auc(binned.select(F.col("v").alias("score"), "y"), [])
    out = validation.verdict(validation.frequency_ratios(binned, F.col("y"), "bin"), aucs, "bin")
    return out.select("monotone", r6("top_presence_percent", "top_presence_percent"), r6("efficiency", "efficiency"), r6("auc", "auc"), "verdict")


VERDICT_SQL = f"""WITH {SAMPLES}, {BINNED}, {RATIOS},
steps AS (SELECT *, presence_percent / area_percent < lag(presence_percent / area_percent) OVER (ORDER BY bin) - 1e-9 AS falls, row_number() OVER (ORDER BY bin DESC) AS place FROM ratios),
one AS (SELECT NOT coalesce(bool_or(falls), false) AS monotone, sum(presence_percent) FILTER (WHERE place <= 2) AS top, sum(area_percent) FILTER (WHERE place <= 2) AS area FROM steps),
r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS rk FROM binned),
t AS (SELECT count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(rk) FILTER (WHERE y) AS w FROM r),
a AS (SELECT (w - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n) AS auc FROM t)
SELECT monotone, round(top, 6) AS top_presence_percent, round(top / area, 6) AS efficiency, round(auc, 6) AS auc,
       CASE WHEN auc >= 75e-2 AND monotone AND top / area >= 15e-1 THEN 'good' WHEN auc >= 65e-2 AND top / area >= 15e-1 THEN 'fair' ELSE 'poor' END AS verdict FROM one CROSS JOIN a"""

# Three fixed candidates of four draws each.
CANDIDATES = [(k, 0.0, [(round(0.02 * (j + 1) * (k + 1), 6), 26.0 + 3 * j + k, 0.001 * (k + 1)) for j in range(4)]) for k in range(3)]
CANDIDATE_ROWS = "cand AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {c!r}::DOUBLE, {p!r}::DOUBLE, {r!r}::DOUBLE)" for k, _, rows in CANDIDATES for c, p, r in rows) + ") AS t(cand_id, c, p, r))"
SCORED = f"scored AS (SELECT cand_id, id, y, bx, count(*) FILTER (WHERE {fs_sql()} < 1) / 4e0 AS score FROM placed CROSS JOIN cand GROUP BY ALL)"
PLACED = "placed AS (SELECT *, CAST(floor(lon / 5e-1) AS INT) AS bx, CAST(floor(lat / 5e-1) AS INT) AS bby FROM samples)"


def _candidates(spark):
    return spark.createDataFrame(CANDIDATES, "cand_id int, depth_k double, draws array<struct<c:double,p:double,r:double>>")


def q_param_search(spark, sf_dir):
    return fitting.search(samples(spark, sf_dir), _candidates(spark)).select("cand_id", "n_pos", "n_neg", r6("auc", "auc"))


SEARCH_SQL = f"""WITH {SAMPLES}, {PLACED}, {CANDIDATE_ROWS}, {SCORED},
r AS (SELECT cand_id, y, rank() OVER (PARTITION BY cand_id ORDER BY score) + (count(*) OVER (PARTITION BY cand_id, score) - 1) / 2e0 AS rk FROM scored),
t AS (SELECT cand_id, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(rk) FILTER (WHERE y) AS w FROM r GROUP BY cand_id)
SELECT cand_id, p AS n_pos, n AS n_neg, round((w - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM t"""

FOLDS = 4


def q_fold_blocks(spark, sf_dir):
    """Squares with points, numbered and dealt in turn by their number."""
    blocks = fitting.numbered_blocks(samples(spark, sf_dir), 0.5)
    return blocks.groupBy("block", (F.col("block") % FOLDS).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


BLOCKS = f"blocks AS (SELECT bx, bby, row_number() OVER (ORDER BY bx, bby) - 1 AS block FROM (SELECT DISTINCT bx, bby FROM placed)),\nfolded AS (SELECT p.*, CAST(block AS INT) AS block, CAST(block % {FOLDS} AS INT) AS fold FROM placed p JOIN blocks b ON p.bx = b.bx AND p.bby = b.bby)"
BLOCK_SQL = f"WITH {SAMPLES}, {PLACED}, {BLOCKS} SELECT block, fold, count(*) AS n FROM folded GROUP BY block, fold"


def q_cv_spatial(spark, sf_dir):
    rows = fitting.numbered_blocks(samples(spark, sf_dir), 0.5).withColumn("fold", F.col("block") % FOLDS)
    out = fitting.cross_validate(rows, _candidates(spark), FOLDS)
    return out.select("fold", "cand_id", r6("train_auc", "train_auc"), r6("test_auc", "test_auc"))


def _auc_cte(name: str, source: str) -> str:
    return f"""{name}_r AS (SELECT fold, cand_id, y, rank() OVER (PARTITION BY fold, cand_id ORDER BY score) + (count(*) OVER (PARTITION BY fold, cand_id, score) - 1) / 2e0 AS rk FROM {source}),
{name} AS (SELECT fold, cand_id, (sum(rk) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2e0) / (CAST(count(*) FILTER (WHERE y) AS DOUBLE) * count(*) FILTER (WHERE NOT y)) AS auc FROM {name}_r GROUP BY fold, cand_id)"""


CV_SQL = f"""WITH {SAMPLES}, {PLACED}, {BLOCKS}, {CANDIDATE_ROWS},
scored AS (SELECT cand_id, id, y, fold, count(*) FILTER (WHERE {fs_sql()} < 1) / 4e0 AS score FROM folded CROSS JOIN cand GROUP BY ALL),
others AS (SELECT f.fold, cand_id, y, score FROM scored s JOIN (SELECT unnest(range(0, {FOLDS})) AS fold) f ON f.fold <> s.fold),
{_auc_cte('train', 'others')}, {_auc_cte('test', 'scored')},
best AS (SELECT fold, cand_id, auc, row_number() OVER (PARTITION BY fold ORDER BY auc DESC, cand_id) AS nth FROM train)
SELECT CAST(b.fold AS INT) AS fold, b.cand_id, round(b.auc, 6) AS train_auc, round(t.auc, 6) AS test_auc FROM best b JOIN test t ON b.fold = t.fold AND b.cand_id = t.cand_id WHERE nth = 1"""


RANDOM_FOLD = f"CAST((id * 7919 + 13) % 101 % {FOLDS} AS INT)"


def q_fit_report(spark, sf_dir):
    """The whole fit: best candidate, in-sample, random and spatial folds, warnings."""
    rows = fitting.numbered_blocks(samples(spark, sf_dir), 0.5).withColumns({"spatial": F.col("block") % FOLDS, "random": F.expr(RANDOM_FOLD)})
    out = fitting.fit(rows, _candidates(spark), "random", "spatial", FOLDS)
    columns = [r6(c, c) for c in ("in_sample", "random_cv", "spatial_cv", "deviation")]
    return out.select("n_presence", "n_background", "cand_id", *columns, F.array_join("warnings", "; ").alias("warnings"))


def _cv_ctes(name: str, fold: str) -> str:
    """Mean and deviation over folds of the AUC of each fold's best candidate on the others."""
    return f"""{name} AS (SELECT cand_id, id, y, {fold} AS fold, score FROM scored),
{name}_others AS (SELECT f.fold, cand_id, y, score FROM {name} s JOIN (SELECT unnest(range(0, {FOLDS})) AS fold) f ON f.fold <> s.fold),
{_auc_cte(f'{name}_train', f'{name}_others')}, {_auc_cte(f'{name}_test', name)},
{name}_best AS (SELECT fold, cand_id, row_number() OVER (PARTITION BY fold ORDER BY auc DESC, cand_id) AS nth FROM {name}_train),
{name}_sum AS (SELECT avg(t.auc) AS mean, stddev_pop(t.auc) AS deviation FROM {name}_best b JOIN {name}_test t ON b.fold = t.fold AND b.cand_id = t.cand_id WHERE nth = 1)"""


FIT_SQL = f"""WITH {SAMPLES}, {PLACED}, {BLOCKS}, {CANDIDATE_ROWS},
scored AS (SELECT cand_id, id, y, fold AS spatial, region, count(*) FILTER (WHERE {fs_sql()} < 1) / 4e0 AS score FROM folded CROSS JOIN cand GROUP BY ALL),
whole AS (SELECT 0 AS fold, cand_id, y, score FROM scored), {_auc_cte('every', 'whole')},
{_cv_ctes('r', RANDOM_FOLD)}, {_cv_ctes('s', 'spatial')},
report AS (
  SELECT (SELECT count(*) FROM samples WHERE y) AS n_presence, (SELECT count(*) FROM samples WHERE NOT y) AS n_background,
         a.cand_id, a.auc AS in_sample, r_sum.mean AS random_cv, s_sum.mean AS spatial_cv, s_sum.deviation AS deviation
  FROM (SELECT cand_id, auc FROM every ORDER BY auc DESC, cand_id LIMIT 1) a CROSS JOIN r_sum CROSS JOIN s_sum)
SELECT n_presence, n_background, cand_id, round(in_sample, 6) AS in_sample, round(random_cv, 6) AS random_cv, round(spatial_cv, 6) AS spatial_cv, round(deviation, 6) AS deviation,
       concat_ws('; ', CASE WHEN random_cv - spatial_cv > 3e-2 THEN 'random folds score higher than spatial ones' END, CASE WHEN deviation > 4e-2 THEN 'folds differ widely' END,
                 CASE WHEN in_sample - spatial_cv > 5e-2 THEN 'in-sample fit is better than held-out' END, CASE WHEN spatial_cv < 65e-2 THEN 'held-out skill is low' END) AS warnings
FROM report WHERE n_presence >= 50"""


def q_fit_regional(spark, sf_dir):
    """Each region's best candidate, or the best of all where it has too few samples."""
    out = fitting.fit_regions(samples(spark, sf_dir), _candidates(spark), least_presence=REGION_FLOOR)
    return out.select("region", "cand_id", r6("auc", "auc"), "own")


REGION_FLOOR = 80
REGIONAL_FIT_SQL = f"""WITH {SAMPLES}, {PLACED}, {CANDIDATE_ROWS},
scored AS (SELECT cand_id, id, y, region, count(*) FILTER (WHERE {fs_sql()} < 1) / 4e0 AS score FROM placed CROSS JOIN cand GROUP BY ALL),
by_region AS (SELECT region AS fold, cand_id, y, score FROM scored), {_auc_cte('own', 'by_region')},
whole AS (SELECT 0 AS fold, cand_id, y, score FROM scored), {_auc_cte('every', 'whole')},
n AS (SELECT region, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM samples GROUP BY region),
best AS (SELECT fold AS region, cand_id, auc, row_number() OVER (PARTITION BY fold ORDER BY auc DESC, cand_id) AS nth FROM own),
one AS (SELECT cand_id, auc FROM every ORDER BY auc DESC, cand_id LIMIT 1)
SELECT n.region, CASE WHEN p >= {REGION_FLOOR} AND q >= 20 THEN b.cand_id ELSE one.cand_id END AS cand_id,
       round(CASE WHEN p >= {REGION_FLOOR} AND q >= 20 THEN b.auc ELSE one.auc END, 6) AS auc, p >= {REGION_FLOOR} AND q >= 20 AS own
FROM n JOIN best b ON n.region = b.region AND nth = 1 CROSS JOIN one"""


def q_cv_summary(spark, sf_dir):
    rows = fitting.numbered_blocks(samples(spark, sf_dir), 0.5).withColumn("fold", F.col("block") % FOLDS)
    out = fitting.summary(fitting.cross_validate(rows, _candidates(spark), FOLDS))
    return out.select("n_folds", r6("mean", "mean"), r6("deviation", "deviation"))


CV_SUMMARY_SQL = f"WITH cv AS ({CV_SQL.replace('round(t.auc, 6)', 't.auc')}) SELECT count(*) AS n_folds, round(avg(test_auc), 6) AS mean, round(stddev_pop(test_auc), 6) AS deviation FROM cv"

QUERIES = {
    "q_wetness": (q_wetness, WETNESS_SQL),
    "q_depth_factor": (q_depth_factor, DEPTH_SQL),
    "q_factor_of_safety": (q_factor_of_safety, FS_SQL),
    "q_critical_accel": (q_critical_accel, KC_SQL),
    "q_failure_probability": (q_failure_probability, PROBABILITY_SQL),
    "q_failure_probability_builtin": (q_failure_probability_builtin, PROBABILITY_SQL),
    "q_stability_class": (q_stability_class, CLASS_SQL),
    "q_regional_safety": (q_regional_safety, REGIONAL_SQL),
    "q_regional_probability": (q_regional_probability, REGIONAL_PROBABILITY_SQL),
    "q_recharge_multiplier": (q_recharge_multiplier, MULTIPLIER_SQL),
    "q_return_period": (q_return_period, RETURN_SQL),
    "q_seismic_terms": (q_seismic_terms, SEISMIC_SQL),
    "q_wettest_month": (q_wettest_month, WETTEST_SQL),
    "q_recharge_scale": (q_recharge_scale, SCALE_SQL),
    "q_auc": (q_auc, AUC_SQL),
    "q_auc_by_group": (q_auc_by_group, AUC_GROUP_SQL),
    "q_capture": (q_capture, CAPTURE_SQL),
    "q_rank_corr": (q_rank_corr, CORR_SQL),
    "q_spread": (q_spread, SPREAD_SQL),
    "q_quantile_bins": (q_quantile_bins, BINS_SQL),
    "q_frequency_ratio": (q_frequency_ratio, RATIO_SQL),
    "q_verdict": (q_verdict, VERDICT_SQL),
    "q_param_search": (q_param_search, SEARCH_SQL),
    "q_fold_blocks": (q_fold_blocks, BLOCK_SQL),
    "q_cv_spatial": (q_cv_spatial, CV_SQL),
    "q_fit_report": (q_fit_report, FIT_SQL),
    "q_fit_regional": (q_fit_regional, REGIONAL_FIT_SQL),
    "q_cv_summary": (q_cv_summary, CV_SUMMARY_SQL),
}
