"""Ranks that never sort a whole hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import checkpoint

GROUP_LIMIT = 1000  # Spark trims groups map-side up to this n (spark.sql.window.group.limit.threshold)


def _cols(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str | None = None, salts: int = 32) -> DataFrame:
    """First ``n`` rows per group under a total order.

    For small ``n`` Spark keeps only ``n`` rows per group on the map side before the shuffle
    (WindowGroupLimit). For larger ``n`` a salted first pass does the same by hand, so the
    final task of a hot group gets at most ``n * salts`` rows.
    """
    order = _cols(order)
    if n > GROUP_LIMIT:
        plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
        part = df.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
        first = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = part.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).drop("__r", "__salt")
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    return out.drop("__r") if rank is None else out.withColumnRenamed("__r", rank)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    return top_n(df, keys, order, 1)


def hash_bucket(hash_col: str | Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5: 16^digits equal slices, monotone in the hash."""
    return F.substring(F.col(hash_col) if isinstance(hash_col, str) else hash_col, 1, digits)


def bucketed_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column,
    rank: str = "rank",
    total: str | None = None,
    upto: Column | None = None,
) -> DataFrame:
    """1-based ``row_number`` per group without gathering the group in one task.

    ``bucket`` must be monotone in ``order``: a smaller bucket sorts before a larger one. Rows
    are ranked inside ``(group, bucket)`` and shifted by the row count of the earlier buckets,
    which comes from a map-side combined count. Both the join and the window use the same
    ``(group, bucket)`` hash partitioning, so the rows are shuffled once. Group keys must not
    be null. Choose buckets so that rows per bucket and buckets per group both stay in the
    millions. With ``upto`` (an expression over ``total`` and the keys), buckets starting beyond
    that rank are dropped before the rows are ranked.
    """
    tagged = df.withColumn("__b", bucket)
    counts = tagged.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
    by_bucket = Window.partitionBy(*keys).orderBy("__b")
    before = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("__c").over(Window.partitionBy(*keys)))
    if upto is not None:
        offsets = offsets.where(F.col("__off") < upto)
    offsets = offsets.drop("__c")
    local = Window.partitionBy(*keys, "__b").orderBy(*_cols(order))
    return (
        tagged.join(offsets, [*keys, "__b"])
        .withColumn(rank, F.col("__off") + F.row_number().over(local))
        .drop("__b", "__off")
    )


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """``df`` with ``__g`` (a struct of the keys) and ``__piece``: consecutive ranges of (keys, order).

    A piece is one partition of a range shuffle by sampled bounds, so pieces are even whatever the
    keys and values look like; the rows are written to the checkpoint folder, so pieces stay what they are.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.withColumn("__g", group).repartitionByRange(n, "__g", *_cols(order)).withColumn("__piece", F.spark_partition_id()))


def ranged_rank(df: DataFrame, keys: Sequence[str], order: Sequence, rank: str = "rank", total: str | None = None) -> DataFrame:
    """1-based ``row_number`` per group in a total order, null keys included.

    Rows are numbered inside (group, piece) and shifted by the sizes of the earlier pieces; there
    are no more pieces than shuffle partitions, so a group's offsets are few rows.
    """
    dealt = pieces(df, keys, order)
    whole = Window.partitionBy("__g")
    sizes = dealt.groupBy("__g", "__piece").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__g", "__piece", before.alias("__off"), F.sum("__c").over(whole).alias("__total"))
    local = Window.partitionBy("__g", "__piece").orderBy(*_cols(order))
    out = dealt.join(sizes, ["__g", "__piece"]).withColumn(rank, F.col("__off") + F.row_number().over(local))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__g", "__piece", "__off", "__total")


def dense_ids(df: DataFrame, key: str, out: str = "class_id") -> DataFrame:
    """Ids 0..C-1 of the distinct keys in sorted order (works on the distinct keys only)."""
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return ranged_rank(distinct, [], [key], out).withColumn(out, F.col(out) - 1)
