"""Coverage counts, pivots, deltas and summary rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import position_in
from ..plans.durable import checkpoint
from ..plans.ranking import pieces


def distinct_sources(df: DataFrame, key: str, source: str, out: str = "n_sources") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(source).alias(out))


def coverage_histogram(per_key: DataFrame, n: str) -> DataFrame:
    """``n, n_keys, n_keys_at_least``; the running sum covers one row per distinct count."""
    hist = per_key.groupBy(n).agg(F.count(F.lit(1)).alias("n_keys"))
    tail = Window.orderBy(F.col(n).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("n_keys_at_least", F.sum("n_keys").over(tail))


def top_tokens(df: DataFrame, col: str, separator: str, n: int = 20) -> DataFrame:
    """Most frequent trimmed parts of a delimited column (ties by token)."""
    parts = df.select(F.explode(F.split(col, separator)).alias("token")).select(F.trim("token").alias("token"))
    counts = parts.where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "token").limit(n)


def pivot_values(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Long to wide; the value list is given, so no extra job looks for it."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(metric))


def with_deltas(wide: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``name = a - b`` for every entry."""
    return wide.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in pairs.items()})


def group_and_mean_rows(df: DataFrame, group: str, item: str, metric: str, label: str = "— mean —") -> DataFrame:
    """mean/min/max/sample std per (group, item) plus one overall row per group."""
    flag = F.grouping(item).alias("__all")
    out = df.groupingSets([[group, item], [group]], group, item).agg(
        F.avg(metric).alias("mean"), F.min(metric).alias("min"), F.max(metric).alias("max"),
        F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"), flag,
    )
    return out.withColumn(item, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(item))).drop("__all")


def range_overlap(ranges: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """Ordered pairs (upper, lower) whose ranges do not overlap, with the margin min(upper) - max(lower).

    ``ranges`` is a report with one row per dataset; it is gathered into one array read as
    a scalar subquery, so there is no join. More than 10,000 datasets is an error.
    """
    others = F.collect_list(F.struct(F.col(name).alias("lower"), F.col(high).alias("lower_max")))
    kind = f"array<struct<lower:{ranges.schema[name].dataType.simpleString()},lower_max:{ranges.schema[high].dataType.simpleString()}>>"
    bounded = F.when(F.size("all") <= 10_000, F.col("all")).otherwise(F.raise_error(F.lit("too many datasets for a range report")).cast(kind))
    everyone = ranges.agg(others.alias("all")).select(bounded).scalar()
    left = ranges.select(F.col(name).alias("upper"), F.col(low).alias("upper_min"), everyone.alias("all"))
    below = F.explode(F.filter("all", lambda x: x["lower_max"] < F.col("upper_min"))).alias("x")
    return left.select("upper", "upper_min", below).select(
        "upper", "upper_min", "x.lower", "x.lower_max", (F.col("upper_min") - F.col("x.lower_max")).alias("margin")
    )


def _points_before(queries: DataFrame, points: DataFrame) -> DataFrame:
    """``id, n, last``: for each query (id, v) the points (name, v) below it: their number, and the greatest (v, name).

    One sweep over both in order of v, dealt out by ranges: a piece counts on from what the earlier pieces hold.
    """
    events = queries.select("id", "v", F.lit(0).alias("k"), F.lit(None).alias("name")).unionByName(points.select("id", "v", F.lit(1).alias("k"), "name"))
    dealt = pieces(events, [], ["v", "k", "id"])
    point = F.when(F.col("k") == 1, F.struct("v", "name"))
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    per = dealt.groupBy("__piece").agg(F.sum("k").alias("c"), F.max(point).alias("m"))
    per = per.select("__piece", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"), F.max("m").over(earlier).alias("m"))
    run = Window.partitionBy("__piece").orderBy("v", "k", "id").rowsBetween(Window.unboundedPreceding, -1)
    swept = dealt.join(per, "__piece").withColumns({"n": F.col("c") + F.coalesce(F.sum("k").over(run), F.lit(0)), "last": F.greatest("m", F.max(point).over(run))})
    return swept.where("k = 0").select("id", "n", "last")


def range_standing(ranges: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """Per range: how many others lie wholly below, wholly above, or overlap it, and the nearest one on either side.

    ``name, low, high, n_below, n_above, n_overlapping, below, gap_below, above, gap_above``; ranges that touch overlap. Of
    equally near ones the greater name is given below, the greater name above too. Rows without both ends, or with
    low beyond high, are left out; names may repeat. Any number of ranges: two sweeps, no pairs.
    """
    r = checkpoint(ranges.select(F.col(name).alias("name"), F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi"), F.monotonically_increasing_id().alias("id")).where("lo <= hi"))
    under = _points_before(r.select("id", F.col("lo").alias("v")), r.select("id", F.col("hi").alias("v"), "name"))
    over = _points_before(r.select("id", (-F.col("hi")).alias("v")), r.select("id", (-F.col("lo")).alias("v"), "name"))
    both = r.join(under.withColumnsRenamed({"n": "n_below", "last": "u"}), "id").join(over.withColumnsRenamed({"n": "n_above", "last": "o"}), "id")
    return both.select(
        F.col("name").alias(name), F.col("lo").alias(low), F.col("hi").alias(high), "n_below", "n_above",
        (F.lit(r.count() - 1) - F.col("n_below") - F.col("n_above")).alias("n_overlapping"),
        F.col("u.name").alias("below"), (F.col("lo") - F.col("u.v")).alias("gap_below"), F.col("o.name").alias("above"), (-F.col("o.v") - F.col("hi")).alias("gap_above"),
    )


def best_per_group(df: DataFrame, group: str, config: str, metric: str) -> DataFrame:
    """Best configuration per group; equal scores go to the smaller name."""
    best = F.min_by(F.struct(config, metric), F.struct((-F.col(metric)).alias("m"), F.col(config)))
    return df.groupBy(group).agg(best.alias("b")).select(group, f"b.{config}", f"b.{metric}")


def in_category_order(df: DataFrame, orders: dict[str, list[str]], ties: Sequence[str] = ()) -> DataFrame:
    """Rows in the given order of categories, others last; equal ones by the columns of ``ties``."""
    return df.orderBy(*[position_in(c, o) for c, o in orders.items()], *ties)
