"""Quality thresholds, feature cleaning and feature audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import check_quantiles
from ..functions.vectors import finite_or_null
from ..plans.durable import checkpoint
from ..plans.joins import salted_join
from ..plans.quantiles import exact_quantiles, large_groups, medians, quantile_of

MAD_SCALE = 1.4826  # fixed values: robust scaling constants
MAD_MIN_CONTROLS = 5
MAD_CLIP = 4.0
MAX_MISSING = 0.05
MIN_STD = 1e-3
MIN_TRAIN_VAR = 1e-8


def tidy(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide numeric columns -> ``keys…, feature, value``."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in fields
    ]))
    return df.select(*keys, pairs.alias("p")).select(*keys, "p.feature", "p.value")


def tidy_vector(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Array column -> ``keys…, feature (0-based position), value``."""
    return df.select(*keys, F.posexplode(vec).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def untidy_vector(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "vec") -> DataFrame:
    """Inverse of ``tidy_vector`` (one row holds one vector, so the group is bounded by its length)."""
    pairs = F.sort_array(F.collect_list(F.struct("feature", value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(out))


def quantile_bounds(df: DataFrame, fields: Sequence[str], low: float, high: float) -> DataFrame:
    """``feature, lo, hi``: exact quantiles; absent and all-null fields are left out."""
    check_quantiles(fields, low, high)
    present = [f for f in fields if f in df.columns]
    q = exact_quantiles(tidy(df, [], present), ["feature"], "value", [low, high])
    return q.select("feature", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def within_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside every closed range; null and NaN fail. Unknown fields are skipped."""
    out = df
    for field, (lo, hi) in bounds.items():
        if field in df.columns:
            out = out.where(F.col(field).between(lo, hi) & ~F.isnan(F.col(field).cast("double")))
    return out


def quality_filter(df: DataFrame, fields: Sequence[str], low: float, high: float, enabled: bool = True) -> DataFrame:
    """Drop rows outside the quantile range of any field. The bounds are one row per field."""
    if not enabled:
        return df
    rows = quantile_bounds(df, fields, low, high).collect()
    return within_bounds(df, {r.feature: (r.lo, r.hi) for r in rows})


def scaled_count(df: DataFrame, count: str, out: str = "n_cells_scaled", keys: Sequence[str] = ()) -> DataFrame:
    """Min-max scaling to 0..255 over the whole table (or per key); a missing count stays missing."""
    lo, hi = F.min(count), F.max(count)
    if keys:
        src = salted_join(df, df.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi")), keys, "left", null_safe=True)
    else:
        src = df.withColumns({"__lo": df.agg(lo).scalar(), "__hi": df.agg(hi).scalar()})
    x = (F.col(count) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)) * 255.0
    inside = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)))
    return src.withColumn(out, inside).drop("__lo", "__hi")


def clean_nonfinite(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.withColumns({f: finite_or_null(F.col(f).cast("double")) for f in fields})


def robust_scale(tidy_df: DataFrame, plate: Sequence[str], unique: Sequence[str], is_control: Column, min_controls: int = MAD_MIN_CONTROLS, clip: float = MAD_CLIP) -> DataFrame:
    """Per plate and feature: ``(x - median) / (1.4826·MAD)`` clipped to ±clip.

    Reference rows are the plate's controls, or the whole plate when it has fewer than
    ``min_controls``. A zero MAD scales by 1. A missing value (null or NaN) stays missing. Input is
    ``plate…, unique…, feature, value`` plus whatever ``is_control`` reads. Null plates are a group.

    A plate and feature of ``IN_ONE_ROW`` values at most (usually all) gives both medians from one array; larger ones take
    the dealt plan twice. Either way they are one row per plate and feature, joined back salted, once.
    """
    keys = [*plate, "feature"]
    src = tidy_df.withColumns({"__ctrl": F.coalesce(is_control, F.lit(False)), "value": F.nanvl(F.col("value").cast("double"), F.lit(None)) + F.lit(0.0)})
    back = lambda rows, per: salted_join(rows, per, keys, "left", spread_by=unique, null_safe=True)
    large = large_groups(src, keys)
    if large.isEmpty():
        per = _scales_in_rows(src, keys, min_controls)
    else:
        marked = back(src, large.withColumn("__large", F.lit(True)))
        per = _scales_in_rows(marked.where(F.col("__large").isNull()), keys, min_controls).unionByName(_scales_dealt(marked.where("__large"), keys, unique, min_controls, back))
    return back(src, per).withColumn("scaled", _scaled(clip)).select(*tidy_df.columns, "scaled")


def _scaled(clip: float) -> Column:
    scale = F.when(F.col("__mad") > 0, F.col("__mad") * MAD_SCALE).otherwise(1.0)
    z = (F.col("value") - F.col("__med")) / scale
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))


def robust_scale_fields(df: DataFrame, plate: Sequence[str], unique: Sequence[str], fields: Sequence[str], is_control: Column, min_controls: int = MAD_MIN_CONTROLS, clip: float = MAD_CLIP) -> DataFrame:
    """``robust_scale`` of wide columns: ``plate…, unique…, feature, value, scaled``.

    A plate of ``IN_ONE_ROW`` rows at most (usually all) is one array of rows, scaled where it lies: each row is shuffled once, with
    all its fields. Rows of larger plates are made long and scaled by ``robust_scale``.
    """
    plate, unique = list(plate), list(unique)
    values = [(F.nanvl(F.col(f).cast("double"), F.lit(None)) + F.lit(0.0)).alias(f) for f in fields]
    wide = df.select(*plate, *unique, F.coalesce(is_control, F.lit(False)).alias("__ctrl"), *values)
    large = large_groups(wide, plate)
    if large.isEmpty():
        return _fields_in_rows(wide, plate, unique, fields, min_controls, clip)
    marked = salted_join(wide, large.withColumn("__large", F.lit(True)), plate, "left", spread_by=unique, null_safe=True)
    small = _fields_in_rows(marked.where(F.col("__large").isNull()), plate, unique, fields, min_controls, clip)
    long = tidy(marked.where("__large"), [*plate, *unique, "__ctrl"], fields)
    return small.unionByName(robust_scale(long, plate, unique, F.col("__ctrl"), min_controls, clip).drop("__ctrl"))


def _fields_in_rows(wide: DataFrame, plate: list[str], unique: list[str], fields: Sequence[str], min_controls: int, clip: float) -> DataFrame:
    """Plates whose rows fit an array. Rows are dealt out by plate before they are gathered, not gathered by each task first, which sorts all."""
    one = wide.repartition(*plate).groupBy(*plate).agg(F.collect_list(F.struct(*unique, "__ctrl", *fields)).alias("__rows"))
    own = F.filter("__rows", lambda r: r["__ctrl"])
    one = one.withColumn("__ref", F.when(F.size(own) < min_controls, F.col("__rows")).otherwise(own))
    present = lambda f: F.filter(F.transform("__ref", lambda r: r[f]), lambda x: x.isNotNull())
    one = one.select(*plate, "__rows", *[F.sort_array(present(f)).alias(f"__x{i}") for i, f in enumerate(fields)])
    one = one.withColumns({f"__med{i}": quantile_of(F.col(f"__x{i}"), 0.5) for i in range(len(fields))})
    dev = lambda i: F.sort_array(F.transform(f"__x{i}", lambda x: F.abs(x - F.col(f"__med{i}"))))
    one = one.withColumns({f"__x{i}": dev(i) for i in range(len(fields))})
    per = F.array(*[F.struct(F.col(f"__med{i}").alias("m"), quantile_of(F.col(f"__x{i}"), 0.5).alias("d")) for i in range(len(fields))])
    rows = one.select(*plate, "__rows", per.alias("__per")).select(*plate, "__per", F.inline("__rows"))
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col("__per")[i]["m"].alias("__med"), F.col("__per")[i]["d"].alias("__mad")) for i, f in enumerate(fields)])
    long = rows.select(*plate, *unique, F.inline(each))
    return long.select(*plate, *unique, "feature", "value", _scaled(clip).alias("scaled"))


def _scales_in_rows(src: DataFrame, keys: list[str], min_controls: int) -> DataFrame:
    """``keys…, __med, __mad`` of groups whose values fit an array."""
    values = lambda x: F.sort_array(F.collect_list(x))
    one = src.groupBy(*keys).agg(F.count_if("__ctrl").alias("__nc"), values("value").alias("__all"), values(F.when(F.col("__ctrl"), F.col("value"))).alias("__own"))
    one = one.select(*keys, F.when(F.col("__nc") < min_controls, F.col("__all")).otherwise(F.col("__own")).alias("__ref"))
    one = one.withColumn("__med", quantile_of(F.col("__ref"), 0.5))
    dev = F.sort_array(F.transform("__ref", lambda x: F.abs(x - F.col("__med"))))
    return one.withColumn("__dev", dev).select(*keys, "__med", quantile_of(F.col("__dev"), 0.5).alias("__mad"))


def _scales_dealt(src: DataFrame, keys: list[str], unique: Sequence[str], min_controls: int, back) -> DataFrame:
    """``keys…, __med, __mad`` of groups of any size."""
    n_ctrl = src.groupBy(*keys).agg(F.count_if("__ctrl").alias("__nc"))
    ref = back(src, n_ctrl).where(F.col("__ctrl") | (F.col("__nc") < min_controls)).select(*keys, *[u for u in unique if u not in keys], "value")
    med = checkpoint(medians(ref, keys, "value", "__med"))
    dev = back(ref, med).withColumn("__dev", F.abs(F.col("value") - F.col("__med")))
    mad = medians(dev, keys, "__dev", "__mad").withColumn("__same", F.struct(*keys)).drop(*keys)
    return med.withColumn("__same", F.struct(*keys)).join(mad, "__same").drop("__same")


def feature_audit(tidy_df: DataFrame, max_missing: float = MAX_MISSING, min_std: float = MIN_STD) -> DataFrame:
    """Per feature: rows, missing share, population std and whether it passes both filters."""
    x = finite_or_null(F.col("value"))
    stats = tidy_df.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(x.isNull()).alias("n_missing"),
        F.avg(x.isNull().cast("double")).alias("missing_fraction"),
        F.stddev_pop(x).alias("std"),
    )
    keep = (F.col("missing_fraction") <= max_missing) & (F.col("std") >= min_std)
    return stats.withColumn("keep", F.coalesce(keep, F.lit(False)))


def per_feature(tidy_df: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``tidy_df`` joined with one row per feature, some thousands at most: these go to every task, and the long table stays where it is."""
    return tidy_df.join(F.broadcast(side), "feature", how)


def kept_features(tidy_df: DataFrame, **kw) -> DataFrame:
    return per_feature(tidy_df, feature_audit(tidy_df, **kw).where("keep").select("feature"), "left_semi").select(*tidy_df.columns)


def impute_median(tidy_df: DataFrame) -> DataFrame:
    """Missing values take the median of their feature."""
    x = finite_or_null(F.col("value"))
    clean = tidy_df.withColumn("value", x)
    med = medians(clean, ["feature"], "value", "__med")
    return per_feature(clean, med, "left").withColumn("value", F.coalesce("value", "__med")).drop("__med").select(*tidy_df.columns)


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: rows, rows with every feature missing, missing cells and their share."""
    miss = [F.when(finite_or_null(F.col(f).cast("double")).isNull(), 1).otherwise(0) for f in fields]
    total = sum(miss[1:], miss[0])
    return df.select(total.alias("m")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("m") == len(fields)).alias("n_rows_all_missing"),
        F.sum("m").cast("bigint").alias("n_missing_cells"),
        (F.sum("m") / (F.count(F.lit(1)) * len(fields))).alias("missing_rate"),
    )


def filter_counters(df: DataFrame, condition: Column, keys: Sequence[str] = ()) -> DataFrame:
    """n_before, n_after, n_dropped of a filter, in one pass."""
    ok = F.coalesce(condition, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n_before"), F.count_if(ok).alias("n_after"), F.count_if(~ok).alias("n_dropped")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def in_bounds(df: DataFrame, row: str, col: str, height: int, width: int, patch: int) -> DataFrame:
    half = patch // 2
    return df.where(
        (F.col(row) >= half) & (F.col(row) < height - half) & (F.col(col) >= half) & (F.col(col) < width - half)
    )


def with_parameter(df: DataFrame, params: DataFrame, key: str, value: str, default) -> DataFrame:
    """Per-group parameter with a default where the group has none."""
    return salted_join(df, params.select(key, value), [key], "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def measured_summary(df: DataFrame, source: str, measure: str, expected: str, min_success: float = 0.5) -> DataFrame:
    """Per source: measured values' median and quartiles, success share, and pass/fail."""
    q = exact_quantiles(df, [source], measure, [0.25, 0.5, 0.75])
    ok = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count(measure).alias("n_measured"),
        (F.count(measure) / F.count(F.lit(1))).alias("success_fraction"),
    )
    q = q.withColumnRenamed(source, "__s")
    return ok.join(q, F.col(source).eqNullSafe(F.col("__s")), "left").select(
        source, "n_requested", "n_measured", "success_fraction",
        F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"),
        (F.col("success_fraction") >= min_success).alias(expected),
    )
