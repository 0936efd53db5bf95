"""Queries on comparisons, totals and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from talweg.operators import fitting, summaries
from talweg.plans import views as V
from talweg.plans.mechanics import SEARCH_SQL, _candidates
from talweg.plans.terrain import r6
from talweg.plans.views import CELLS, SAMPLES, table


def q_compare_runs(spark, sf_dir):
    cells = V.cells(spark, sf_dir)
    large = cells.select("row", "col", (F.col("z") + 5000).alias("sca"), "p")
    small = cells.select("row", "col", (F.col("z") + 5000 - F.when(F.col("col") % 9 == 0, 4000).otherwise(0)).alias("sca"), F.least(F.col("p") * 1.1, F.lit(1.0)).alias("p"))
    out = summaries.compare_runs(small, large, ["row", "col"], "sca", "p")
    return out.select("n_cells", *[r6(c, c) for c in out.columns if c != "n_cells"])


COMPARE_SQL = f"""WITH {CELLS}, m AS (SELECT (z + 5000 - CASE WHEN col % 9 = 0 THEN 4000 ELSE 0 END) / (z + 5000) AS ratio, abs(least(p * 11e-1, 1e0) - p) AS moved FROM cells)
SELECT count(*) AS n_cells, round(median(ratio), 6) AS median_ratio, round(100 * avg(CASE WHEN ratio < 5e-1 THEN 1e0 ELSE 0e0 END), 6) AS percent_under_half, round(avg(moved), 6) AS mean_change,
round(max(moved), 6) AS max_change, round(100 * avg(CASE WHEN moved > 5e-2 THEN 1e0 ELSE 0e0 END), 6) AS percent_over_005 FROM m"""


def q_region_totals(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey")
    people = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")).alias("people"))
    units = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("largest", F.col("people"))
    return summaries.region_totals(units, ["people"], ["largest"], ["n_regionkey"])


TOTALS_SQL = """WITH u AS (SELECT n_regionkey, coalesce(CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) END AS BIGINT), 0) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_regionkey, count(*) AS n_units, CAST(sum(p) AS BIGINT) AS people, max(p) AS largest FROM u GROUP BY n_regionkey"""


def q_top_trials(spark, sf_dir):
    """The two best of the fixed candidates, by area under the curve."""
    trials = fitting.search(V.samples(spark, sf_dir), _candidates(spark))
    return summaries.top(trials, 2, "auc", "cand_id").select("cand_id", r6("auc", "auc"))


TRIALS_SQL = f"SELECT cand_id, auc FROM ({SEARCH_SQL}) ORDER BY auc DESC, cand_id LIMIT 2"


def q_worst_settlements(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return summaries.top(rows, 40, "c_acctbal", "c_custkey").select("c_custkey", "c_name", r6("c_acctbal", "score"))


WORST_SQL = "SELECT c_custkey, c_name, round(c_acctbal, 6) AS score FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 40"


def q_unit_search(spark, sf_dir):
    return summaries.search_units(table(spark, sf_dir, "nation"), "n_1", "n_name").select("n_nationkey", "n_name")


UNIT_SEARCH_SQL = "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'n_1')"


def q_presence_by_class(spark, sf_dir):
    return summaries.presence_by_class(V.samples(spark, sf_dir), "region", F.col("y"))


PRESENCE_SQL = f"WITH {SAMPLES} SELECT region, count(*) FILTER (WHERE y) AS n_presence, count(*) AS n FROM samples GROUP BY region"

QUERIES = {
    "q_compare_runs": (q_compare_runs, COMPARE_SQL),
    "q_region_totals": (q_region_totals, TOTALS_SQL),
    "q_top_trials": (q_top_trials, TRIALS_SQL),
    "q_worst_settlements": (q_worst_settlements, WORST_SQL),
    "q_unit_search": (q_unit_search, UNIT_SEARCH_SQL),
    "q_presence_by_class": (q_presence_by_class, PRESENCE_SQL),
}
