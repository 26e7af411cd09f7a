"""Joins of a large table with a per-key side table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
FILTER_BITS = 1 << 26  # of the table of hashed keys: 8 MB at most


def salted_join(
    fact: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
    spread_by: Sequence[str] | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join where one key may hold a large share of ``fact``.

    ``side`` has one row per key (an aggregate, a lookup), so repeating it ``salts`` times is
    cheap, while each hot key of ``fact`` is spread over ``salts`` shuffle partitions. If the
    size of ``side`` with its repeats is under the broadcast threshold Spark broadcasts it instead. With
    ``null_safe`` a null key meets a null key.
    """
    spread = list(spread_by or [c for c in fact.columns if c not in keys] or keys)
    left = fact.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    # a join on a key that is always 0, as Spark's size estimate counts its repeats, but not those of an explode: it would broadcast them all
    pairs = F.explode(F.array(*[F.col("id").cast("int") + F.lit(i) for i in range(0, salts, 2)])).alias("__salt")
    repeats = side.sparkSession.range(2).select(F.pmod("id", F.lit(1)).alias("__zero"), pairs).where(F.col("__salt") < salts)
    right = side.withColumn("__zero", F.pmod(F.xxhash64(*keys), F.lit(1))).join(F.broadcast(repeats), "__zero").drop("__zero")
    if null_safe:
        same = lambda d: d.withColumn("__key", F.struct(*[F.col(k) for k in keys]))
        return same(left).join(same(right).drop(*keys), ["__key", "__salt"], how).drop("__key", "__salt")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def skew_safe_semi(fact: DataFrame, keys_df: DataFrame, keys: Sequence[str], anti: bool = False, **kw) -> DataFrame:
    how = "left_anti" if anti else "left_semi"
    return salted_join(fact, keys_df.select(*keys).distinct(), keys, how, **kw).select(*fact.columns)


def may_match(rows: DataFrame, side: DataFrame, keys: Sequence[str], out: str = "__may") -> DataFrame:
    """``rows`` with a boolean: false where ``side`` has no such key. True for all others and for a few more, which a join drops.

    One bit for each hashed key goes to every task, so rows without a match need no shuffle.
    """
    place = lambda: F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)) + 1
    bits = side.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = rows.withColumn("__p", place()).withColumns({"__bucket": F.bitmap_bucket_number("__p"), "__at": F.bitmap_bit_position("__p")})
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)")
    there = F.coalesce(F.getbit(byte, F.pmod("__at", F.lit(8)).cast("int")) == 1, F.lit(False))
    return at.join(F.broadcast(bits), "__bucket", "left").select(*rows.columns, there.alias(out))
