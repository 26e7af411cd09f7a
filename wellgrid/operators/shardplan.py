"""Training-shard plans as tables: which rows make up which batch.

The plan is (batches × rows per batch) rows, i.e. linear in the input; it never enumerates
row pairs. Row pools are indexed with skew-safe ranks, so a class holding a third of all rows
is fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import check_positive
from ..functions.hashing import draw
from ..plans.draws import any_below, distinct_below, whole
from ..plans.durable import checkpoint
from ..plans.joins import salted_join
from ..plans.ranking import bucketed_rank, dense_ids, hash_bucket, ranged_rank

SEED = 42  # fixed value


def _pools(df: DataFrame, cls: str, strata: str | None, unique: Sequence[str], seed: int) -> DataFrame:
    """``cls[, stratum], pos, n`` for every row: its hashed position in its pool."""
    keys = [cls] + ([strata] if strata else [])
    tagged = df.select(*keys, *unique).withColumn("__h", draw(seed, *unique))
    return bucketed_rank(tagged, keys, ["__h", *unique], hash_bucket("__h"), "pos", "n").drop("__h")


def equal_per_class(df: DataFrame, label: str, unique: Sequence[str], batch_size: int, seed: int = SEED, drop_last: bool = False) -> DataFrame:
    """Every batch draws from every class evenly, with replacement: ``batch, slot, label, unique…``.

    Slots are dealt to classes in turn; the classes that get one slot more rotate by batch.
    """
    check_positive(batch_size=batch_size)
    classes = dense_ids(df, label)
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    rows, k = per_class.agg(F.sum("n"), F.count(F.lit(1))).first()
    if batch_size < k:
        raise ValueError(f"batch_size {batch_size} is below the number of classes {k}")
    n_batches = rows // batch_size if drop_last else -(-rows // batch_size)
    spark = df.sparkSession
    slots = spark.range(n_batches * batch_size).select(
        F.floor(F.col("id") / batch_size).alias("batch"), F.pmod("id", F.lit(batch_size)).alias("slot")
    ).withColumn("class_id", F.pmod(F.col("slot") + F.col("batch"), F.lit(k)))
    pools = _pools(df.where(F.col(label).isNotNull()), label, None, unique, seed)
    sizes_by_class = per_class.join(classes, label)
    wanted = salted_join(slots, sizes_by_class, ["class_id"]).withColumn(
        "pos", F.pmod(whole(seed, "batch", "slot"), F.col("n")) + 1
    )
    return wanted.join(pools.drop("n"), [label, "pos"]).select("batch", "slot", label, *unique)


def _pick_slots(spark, names: DataFrame, perturbation: str, slots: int, n_batches: int, is_pinned: Column, mode: str, replacement: bool, seed: int) -> DataFrame:
    """``batch, slot, perturbation``: the pinned ones first, then drawn ones."""
    pins, free = dense_ids(names.where(is_pinned), perturbation), dense_ids(names.where(~is_pinned), perturbation)
    p, n = pins.count(), free.count()
    n_random = slots - p
    if n_random < 1:
        raise ValueError("perturbations_per_batch must exceed the number of pinned perturbations")
    if n_random > n and not (replacement and mode == "iid" and n):
        raise ValueError("perturbations_per_batch exceeds the number of perturbations")
    batches = spark.range(n_batches).withColumnRenamed("id", "batch")
    if mode == "iid":
        number = lambda i: whole(seed, F.lit("pick"), F.col("batch"), i)
        picked = (any_below if replacement else distinct_below)(F.lit(n_random), F.lit(n), number)
        drawn = batches.select("batch", F.posexplode(picked).alias("slot", "class_id"))
        drawn = salted_join(drawn, free, ["class_id"])
    else:  # consecutive blocks of a hashed permutation, a new one when no block is left
        blocks = n // n_random
        epochs = -(-n_batches // blocks)
        every = spark.range(epochs * n).select(F.pmod("id", F.lit(n)).alias("class_id"), F.floor(F.col("id") / n).alias("epoch"))
        perm = salted_join(every, free, ["class_id"], spread_by=["epoch"]).withColumn("__h", draw(seed, F.lit("perm"), "epoch", perturbation))
        perm = bucketed_rank(perm, ["epoch"], ["__h", perturbation], hash_bucket("__h"), "r").where(F.col("r") <= blocks * n_random)
        drawn = perm.select(
            perturbation, (F.col("epoch") * blocks + F.floor((F.col("r") - 1) / n_random)).alias("batch"),
            F.pmod(F.col("r") - 1, F.lit(n_random)).alias("slot"),
        ).where(F.col("batch") < n_batches)
    drawn = drawn.select("batch", (F.col("slot") + p).cast("bigint").alias("slot"), perturbation)
    if not p:
        return drawn
    pinned = spark.range(n_batches * p).select(F.floor(F.col("id") / p).alias("batch"), F.pmod("id", F.lit(p)).alias("slot"))
    pinned = salted_join(pinned.withColumn("class_id", F.col("slot")), pins, ["class_id"], spread_by=["batch"])
    return drawn.unionByName(pinned.select("batch", "slot", perturbation))


def perturbation_balanced(
    df: DataFrame,
    perturbation: str,
    unique: Sequence[str],
    batch_size: int,
    perturbations_per_batch: int,
    pinned: Sequence[str] = (),
    mode: str = "cycle",
    strata: str | None = None,
    seed: int = SEED,
    drop_last: bool = False,
    samples_per_perturbation: int | None = None,
    perturbations_with_replacement: bool = False,
    rows_with_replacement: bool = False,
) -> DataFrame:
    """``batch, slot, draw_no, perturbation[, stratum], unique…`` with K perturbations per batch.

    Each batch holds the pinned perturbations (those that exist) plus K−P others. ``cycle`` walks a hashed permutation in
    consecutive blocks and reshuffles when a block no longer fits; ``iid`` draws anew for every batch, the
    same one more than once with ``perturbations_with_replacement``. A slot gets ``samples_per_perturbation`` rows
    (by default ``batch_size // K``), and what then lacks in the batch goes one each to drawn slots. With
    ``strata`` the rows of a slot are spread evenly over the strata of the perturbation, what is left over to drawn ones.

    Rows of a slot (and stratum) are drawn on their own for each slot: different rows, or with
    ``rows_with_replacement``, or where the pool is too small, any rows. ``draw_no`` counts them from 0. Rows without a
    perturbation, or without a stratum where asked for, take no part. The plan grows with its rows; pools are ranked
    by hash, so no pool is gathered.
    """
    check_positive(batch_size=batch_size, perturbations_per_batch=perturbations_per_batch)
    if mode not in ("cycle", "iid"):
        raise ValueError("mode must be 'cycle' or 'iid'")
    base = batch_size // perturbations_per_batch if samples_per_perturbation is None else samples_per_perturbation
    if base < 1:
        raise ValueError("batch_size is smaller than perturbations_per_batch" if samples_per_perturbation is None else "samples_per_perturbation must be 1 or more")
    lacking = batch_size - perturbations_per_batch * base
    if lacking < 0:
        raise ValueError("perturbations_per_batch * samples_per_perturbation exceeds batch_size")
    spark = df.sparkSession
    rows = df.where(F.col(perturbation).isNotNull())
    if strata:
        rows = rows.where(F.col(strata).isNotNull())
    names = checkpoint(rows.groupBy(perturbation).agg(F.count(F.lit(1)).alias("n_rows")))
    total = names.agg(F.sum("n_rows")).first()[0]
    if not total:
        raise ValueError("no row has a perturbation")
    n_batches = int(total // batch_size if drop_last else -(-total // batch_size))
    is_pinned = F.col(perturbation).isin(list(pinned)) if pinned else F.lit(False)
    slots = _pick_slots(spark, names, perturbation, perturbations_per_batch, n_batches, is_pinned, mode, perturbations_with_replacement, seed)
    extra = distinct_below(F.lit(min(lacking, perturbations_per_batch)), F.lit(perturbations_per_batch), lambda i: whole(seed, F.lit("extra"), F.col("batch"), i))
    slots = slots.withColumn("quota", F.lit(base).cast("bigint") + F.array_contains(extra, F.col("slot")).cast("bigint"))

    pools = _pools(rows, perturbation, strata, unique, seed).withColumn("pos", F.col("pos") - 1)
    if strata:
        layers = ranged_rank(pools.groupBy(perturbation, strata).agg(F.max("n").alias("n")), [perturbation], [strata], "layer", "n_layers")
        layers = layers.withColumn("layer", F.col("layer") - 1)
        slots = salted_join(slots, layers.groupBy(perturbation).agg(F.max("n_layers").alias("n_layers")), [perturbation], spread_by=["batch", "slot"])
        left = F.pmod("quota", F.col("n_layers"))
        more = distinct_below(left, F.col("n_layers"), lambda i: whole(seed, F.lit("layer"), F.col("batch"), F.col("slot"), i))
        slots = slots.withColumn("more", more).withColumn("each", F.floor(F.col("quota") / F.col("n_layers")).cast("bigint"))
        share = lambda x, k: F.struct(x.alias("layer"), k.alias("quota"))
        spread = F.when(F.col("each") == 0, F.transform("more", lambda x: share(x, F.lit(1).cast("bigint")))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_layers").cast("bigint") - 1), lambda x: share(x, F.col("each") + F.array_contains("more", x).cast("bigint")))
        )
        slots = slots.select("batch", "slot", perturbation, F.explode(spread).alias("part")).select("batch", "slot", perturbation, "part.layer", "part.quota")
        slots = salted_join(slots, layers.drop("n_layers"), [perturbation, "layer"], spread_by=["batch", "slot"])
        parts, keys = [F.col("layer")], [perturbation, strata, "pos"]
    else:
        slots = salted_join(slots, pools.groupBy(perturbation).agg(F.max("n").alias("n")), [perturbation], spread_by=["batch", "slot"])
        parts, keys = [], [perturbation, "pos"]
    number = lambda i: whole(seed, F.lit("row"), F.col("batch"), F.col("slot"), *parts, i)
    repeated = any_below(F.col("quota"), F.col("n"), number)
    drawn = repeated if rows_with_replacement else F.when(F.col("n") >= F.col("quota"), distinct_below(F.col("quota"), F.col("n"), number)).otherwise(repeated)
    placed = slots.select("batch", "slot", *keys[:-1], F.posexplode(drawn).alias("draw_no", "pos"))
    return placed.join(pools.drop("n"), keys).select("batch", "slot", "draw_no", *keys[:-1], *unique)
