"""Quality, scaling, audit and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import checks
from ..operators import quality as Q
from ..operators import report
from . import query
from .views import CELL, r6, table, v_cell

FIELDS = ["nuc_area", "cyto_area", "nuc_cyto_ratio"]
TIDY = """tidy AS (
  SELECT source, plate, row_key, is_control, 'nuc_area' AS feature, CAST(nuc_area AS DOUBLE) AS value FROM v_cell UNION ALL
  SELECT source, plate, row_key, is_control, 'cyto_area', cyto_area FROM v_cell UNION ALL
  SELECT source, plate, row_key, is_control, 'nuc_cyto_ratio', nuc_cyto_ratio FROM v_cell)"""
# a field with gaps: quantity 7 is missing, 11 is not finite
GAPS = "CASE WHEN value = 7 AND feature = 'nuc_area' THEN NULL WHEN value = 11 AND feature = 'nuc_area' THEN NULL ELSE value END"


def _tidy(spark, d):
    return Q.tidy(v_cell(spark, d), ["source", "plate", "row_key", "is_control"], FIELDS)


def _gappy(spark, d):
    nuc = F.col("feature") == "nuc_area"
    holes = F.when(nuc & (F.col("value") == 7), F.lit(None)).when(nuc & (F.col("value") == 11), F.lit(float("inf"))).otherwise(F.col("value"))
    return _tidy(spark, d).withColumn("value", holes)


BOUNDS = f"""b AS (SELECT feature, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM tidy GROUP BY feature)"""


@query(f"WITH {CELL}, {TIDY}, {BOUNDS} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def quantile_bounds(spark, d):
    out = Q.quantile_bounds(v_cell(spark, d), [*FIELDS, "absent"], 0.025, 0.975)
    return out.select("feature", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"WITH {CELL}, {TIDY}, {BOUNDS} SELECT feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")
def quantile_bounds_bracketed(spark, d):
    """The plan for groups too large for one task, forced by a small size limit."""
    out = Q.quantile_bounds(v_cell(spark, d), FIELDS, 0.025, 0.975)
    return out.select("feature", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"""WITH {CELL}, {TIDY}, {BOUNDS}
SELECT source, count(*) AS n, round(sum(cyto_area), 2) AS total FROM v_cell
WHERE nuc_area BETWEEN (SELECT lo FROM b WHERE feature = 'nuc_area') AND (SELECT hi FROM b WHERE feature = 'nuc_area')
  AND cyto_area BETWEEN (SELECT lo FROM b WHERE feature = 'cyto_area') AND (SELECT hi FROM b WHERE feature = 'cyto_area')
  AND nuc_cyto_ratio BETWEEN (SELECT lo FROM b WHERE feature = 'nuc_cyto_ratio') AND (SELECT hi FROM b WHERE feature = 'nuc_cyto_ratio')
GROUP BY source""")
def quality_filter(spark, d):
    kept = Q.quality_filter(v_cell(spark, d).select("source", *FIELDS), FIELDS, 0.025, 0.975)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("cyto_area"), 2).alias("total"))


@query(f"""WITH {CELL}, n AS (SELECT source, plate, well, tile, count(*) AS n_cells FROM v_cell GROUP BY ALL), m AS (SELECT min(n_cells) AS lo, max(n_cells) AS hi FROM n)
SELECT source, plate, well, tile, n_cells, round(least(greatest((n_cells - lo) / greatest(hi - lo, 1) * 255.0, 0.0), 255.0), 6) AS n_cells_scaled FROM n, m""")
def scaled_count(spark, d):
    fovs = v_cell(spark, d).groupBy("source", "plate", "well", "tile").agg(F.count(F.lit(1)).alias("n_cells"))
    return Q.scaled_count(fovs, "n_cells").withColumn("n_cells_scaled", r6("n_cells_scaled"))


@query(f"""WITH {CELL}, {TIDY}, g AS (SELECT source, plate, row_key, is_control, feature, {GAPS} AS value FROM tidy), nc AS (SELECT source, plate, feature, count(*) FILTER (is_control) AS nc FROM g GROUP BY ALL),
ref AS (SELECT t.* FROM g t JOIN nc USING (source, plate, feature) WHERE is_control OR nc < 22),
med AS (SELECT source, plate, feature, median(value) AS med FROM ref GROUP BY ALL),
mad AS (SELECT source, plate, feature, any_value(med) AS med, median(abs(value - med)) AS mad FROM ref JOIN med USING (source, plate, feature) GROUP BY ALL)
SELECT row_key, feature, CASE WHEN value IS NOT NULL THEN round(least(greatest((value - med) / CASE WHEN mad > 0 THEN mad * 1.4826 ELSE 1.0 END, -4.0), 4.0), 6) + 0.0 END AS scaled
FROM g JOIN mad USING (source, plate, feature)""")
def mad_normalise(spark, d):
    cells = v_cell(spark, d)
    holes = F.when(F.col("nuc_area") == 7, F.lit(None)).when(F.col("nuc_area") == 11, F.lit(float("inf"))).otherwise(F.col("nuc_area"))
    gappy = Q.clean_nonfinite(cells.withColumn("nuc_area", holes), FIELDS)
    out = Q.robust_scale_fields(gappy, ["source", "plate"], ["row_key"], FIELDS, F.col("is_control"), min_controls=22)
    return out.select("row_key", "feature", r6("scaled").alias("scaled"))


@query(f"""WITH {CELL}, {TIDY}, g AS (SELECT feature, {GAPS} AS value FROM tidy)
SELECT feature, count(*) AS n_rows, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*), 6) AS missing_fraction,
  round(stddev_pop(value), 4) AS std, (count(*) - count(value)) / count(*) <= 0.03 AND stddev_pop(value) >= 0.05 AS keep FROM g GROUP BY feature""")
def feature_audit(spark, d):
    out = Q.feature_audit(_gappy(spark, d), max_missing=0.03, min_std=0.05)
    return out.withColumns({"missing_fraction": r6("missing_fraction"), "std": r6("std", 4)})


@query(f"""WITH {CELL}, {TIDY}, g AS (SELECT feature, {GAPS} AS value FROM tidy), k AS (SELECT feature FROM g GROUP BY feature HAVING (count(*) - count(value)) / count(*) <= 0.03)
SELECT feature, count(*) AS n, count(value) AS n_present FROM g WHERE feature IN (SELECT feature FROM k) GROUP BY feature""")
def kept_features(spark, d):
    kept = Q.clean_nonfinite(Q.kept_features(_gappy(spark, d), max_missing=0.03), ["value"])
    return kept.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_present"))


@query(f"""WITH {CELL}, {TIDY}, g AS (SELECT row_key, feature, {GAPS} AS value FROM tidy), m AS (SELECT feature, median(value) AS med FROM g GROUP BY feature)
SELECT feature, count(coalesce(value, med)) AS n, round(sum(coalesce(value, med)), 2) AS total FROM g JOIN m USING (feature) GROUP BY feature""")
def impute_median(spark, d):
    out = Q.impute_median(_gappy(spark, d))
    return out.groupBy("feature").agg(F.count("value").alias("n"), r6(F.sum("value"), 2).alias("total"))


@query(f"""WITH {CELL}, x AS (SELECT CASE WHEN nuc_area = 7 THEN 1 ELSE 0 END + CASE WHEN inchikey IS NULL THEN 1 ELSE 0 END AS m FROM v_cell)
SELECT count(*) AS n_rows, count(*) FILTER (m = 2) AS n_rows_all_missing, CAST(sum(m) AS BIGINT) AS n_missing_cells, round(sum(m) / (count(*) * 2), 6) AS missing_rate FROM x""")
def completeness(spark, d):
    cells = v_cell(spark, d).select(
        F.when(F.col("nuc_area") != 7, F.col("nuc_area")).alias("a"), F.when(F.col("inchikey").isNotNull(), 1.0).alias("b")
    )
    return Q.completeness(cells, ["a", "b"]).withColumn("missing_rate", r6("missing_rate"))


@query(f"""WITH {CELL} SELECT source, count(*) AS n_before, count(*) FILTER (nuc_area BETWEEN 5 AND 45) AS n_after, count(*) FILTER (NOT nuc_area BETWEEN 5 AND 45) AS n_dropped FROM v_cell GROUP BY source""")
def filter_counters(spark, d):
    return Q.filter_counters(v_cell(spark, d), F.col("nuc_area").between(5, 45), ["source"])


@query(f"""WITH {CELL} SELECT source, count(DISTINCT batch) AS n_batches, CAST(5 AS BIGINT) AS expected,
  CASE WHEN count(DISTINCT batch) > 5 THEN 'error' WHEN count(DISTINCT batch) < 5 THEN 'warn' ELSE 'ok' END AS status FROM v_cell GROUP BY source""")
def batch_cardinality(spark, d):
    return checks.batch_cardinality(v_cell(spark, d), "batch", 5, group="source")


@query("""SELECT source, count(*) AS n_requested, count(m) AS n_measured, round(count(m) / count(*), 6) AS success_fraction, round(median(m), 6) AS median,
  round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 6) AS iqr, count(m) / count(*) >= 0.85 AS passed
FROM (SELECT event_type AS source, CASE WHEN value >= 3 THEN value END AS m FROM events) GROUP BY source""")
def measured_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") >= 3, F.col("value")).alias("m"))
    out = Q.measured_summary(e, "source", "m", "passed", min_success=0.85)
    return out.withColumns({c: r6(c) for c in ("success_fraction", "median", "iqr")})


@query("""SELECT event_id, event_type, CAST(coalesce(CASE event_type WHEN 'click' THEN 20.0 WHEN 'view' THEN 35.5 END, 30.0) AS DOUBLE) AS diameter FROM events""")
def parameter_default(spark, d):
    params = spark.createDataFrame([("click", 20.0), ("view", 35.5)], "event_type string, diameter double")
    return Q.with_parameter(table(spark, d, "events").select("event_id", "event_type"), params, "event_type", "diameter", 30.0)


@query(f"""WITH {CELL} SELECT source, avg_post - avg_pre AS delta, avg_pre AS pre, avg_post AS post FROM (
  SELECT source, round(avg(nuc_area) FILTER (NOT is_control), 6) AS avg_pre, round(avg(nuc_area) FILTER (is_control), 6) AS avg_post FROM v_cell GROUP BY source)""".replace("SELECT source, avg_post - avg_pre AS delta", "SELECT source, round(avg_post - avg_pre, 5) + 0.0 AS delta"))
def pivot_delta(spark, d):
    long = v_cell(spark, d).select("source", F.when(F.col("is_control"), "post").otherwise("pre").alias("stage"), "nuc_area")
    wide = report.pivot_values(long, ["source"], "stage", ["pre", "post"], "nuc_area").withColumns({"pre": r6("pre"), "post": r6("post")})
    return report.with_deltas(wide, {"delta": ("post", "pre")}).withColumn("delta", r6("delta", 5))


@query(f"""WITH {CELL} SELECT source, coalesce(perturbation, '— mean —') AS perturbation, round(avg(nuc_area), 6) AS mean, min(nuc_area) AS min, max(nuc_area) AS max,
  round(stddev_samp(nuc_area), 6) AS std, count(nuc_area) AS n FROM v_cell GROUP BY GROUPING SETS ((source, perturbation), (source))""")
def grouping_mean_rows(spark, d):
    out = report.group_and_mean_rows(v_cell(spark, d), "source", "perturbation", "nuc_area")
    return out.withColumns({"mean": r6("mean"), "std": r6("std")})


@query(f"""WITH {CELL}, m AS (SELECT source, perturbation, avg(cyto_area) AS score FROM v_cell GROUP BY ALL)
SELECT source, perturbation, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, perturbation) AS rn FROM m) WHERE rn = 1""")
def best_config(spark, d):
    means = v_cell(spark, d).groupBy("source", "perturbation").agg(F.avg("cyto_area").alias("score"))
    return report.best_per_group(means, "source", "perturbation", "score").withColumn("score", r6("score", 4))


@query("""WITH r AS (SELECT p_brand AS name, min(p_retailprice) + 8 * (p_brand = 'Brand#7')::INT * max(p_retailprice) AS lo, max(p_retailprice) + 8 * (p_brand = 'Brand#7')::INT * max(p_retailprice) AS hi FROM part GROUP BY p_brand)
SELECT a.name AS upper, round(a.lo, 4) AS upper_min, b.name AS lower, round(b.hi, 4) AS lower_max, round(a.lo - b.hi, 4) AS margin FROM r a JOIN r b ON a.lo > b.hi""")
def range_overlap(spark, d):
    price = F.col("p_retailprice")
    lift = F.when(F.col("p_brand") == "Brand#7", 8 * F.max(price)).otherwise(0.0)
    ranges = table(spark, d, "part").groupBy(F.col("p_brand").alias("name"), "p_brand").agg((F.min(price) + lift).alias("lo"), (F.max(price) + lift).alias("hi"))
    out = report.range_overlap(ranges, "name", "lo", "hi")
    return out.select("upper", r6("upper_min", 4).alias("upper_min"), "lower", r6("lower_max", 4).alias("lower_max"), r6("margin", 4).alias("margin"))


@query("""WITH r AS (SELECT l_orderkey AS name, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_orderkey),
u AS (SELECT name, k, count(*) FILTER (k = 1) OVER w AS n, max({'v': v, 'name': name}) FILTER (k = 1) OVER w AS last
  FROM (SELECT name, lo AS v, 0 AS k FROM r UNION ALL SELECT name, hi, 1 FROM r) WINDOW w AS (ORDER BY v, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT name, k, count(*) FILTER (k = 1) OVER w AS n, max({'v': v, 'name': name}) FILTER (k = 1) OVER w AS last
  FROM (SELECT name, -hi AS v, 0 AS k FROM r UNION ALL SELECT name, -lo, 1 FROM r) WINDOW w AS (ORDER BY v, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT r.name, u.n AS n_below, o.n AS n_above, (SELECT count(*) FROM r) - 1 - u.n - o.n AS n_overlapping, u.last.name AS below, round(lo - u.last.v, 4) + 0.0 AS gap_below, o.last.name AS above, round(-o.last.v - hi, 4) + 0.0 AS gap_above
FROM r JOIN u ON u.k = 0 AND u.name = r.name JOIN o ON o.k = 0 AND o.name = r.name""")
def range_standing(spark, d):
    """Price ranges of all orders."""
    ranges = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    out = report.range_standing(ranges, "name", "lo", "hi")
    return out.select("name", "n_below", "n_above", "n_overlapping", "below", r6("gap_below", 4).alias("gap_below"), "above", r6("gap_above", 4).alias("gap_above"))
