"""Deterministic sampling, caps, buckets, splits and row plans.

All draws rank rows by ``md5(seed|key)`` (see ``functions.hashing``). Caps use trimmed group
ranks; ranks over whole groups go through ``bucketed_rank`` so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import check_fractions, check_positive
from ..functions.hashing import draw
from ..plans.joins import salted_join, skew_safe_semi
from ..plans.ranking import GROUP_LIMIT, bucketed_rank, first_per_key, hash_bucket, ranged_rank, top_n
from .metadata import on_plates_with_control

SEED = 42  # fixed value


def per_group(df: DataFrame, keys: Sequence[str], n: int, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """At most ``n`` rows per group; smaller groups stay whole; rows with a null key are dropped."""
    check_positive(n=n)
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    ranked = present.withColumn("__h", draw(seed, *unique))
    return top_n(ranked, keys, ["__h", *unique], n).drop("__h")


def per_group_except(df: DataFrame, keys: Sequence[str], n: int, unique: Sequence[str], bypass: Column, seed: int = SEED) -> DataFrame:
    """As ``per_group``, but rows matching ``bypass`` (controls, keyless rows) are never capped."""
    free = F.coalesce(bypass, F.lit(False))
    return df.where(free).unionByName(per_group(df.where(~free), keys, n, unique, seed))


def per_perturbation_source(df: DataFrame, perturbation: str, source: str, n: int, unique: Sequence[str], control_labels: Sequence[str] = (), seed: int = SEED) -> DataFrame:
    """Cap per (perturbation × source); null, empty and listed control labels bypass the cap."""
    p = F.col(perturbation)
    bypass = p.isNull() | (p == "")
    if control_labels:
        bypass = bypass | p.isin(list(control_labels))
    return per_group_except(df, [perturbation, source], n, unique, bypass, seed)


def in_total(df: DataFrame, n: int, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """The ``n`` rows with the smallest draws; all rows when there are fewer.

    Small ``n``: each task keeps its own best n before the merge. Larger ``n``: counts per hash
    slice (65,536 rows) say which slices are taken whole; only the last one is ranked.
    """
    check_positive(n=n)
    drawn = df.withColumn("__h", draw(seed, *unique))
    if n <= GROUP_LIMIT:
        return drawn.orderBy("__h", *unique).limit(n).drop("__h")
    ranked = bucketed_rank(drawn, [], ["__h", *unique], hash_bucket("__h", 4), "__r", upto=F.lit(n))
    return ranked.where(F.col("__r") <= n).drop("__h", "__r")


def stratified_fraction(df: DataFrame, strata: Sequence[str], fraction: float, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """Keep ``max(1, round_half_even(n·fraction))`` rows of every stratum."""
    if not 0 < fraction <= 1:
        raise ValueError(f"fraction must be in (0, 1], got {fraction}")
    keep = F.greatest(F.lit(1.0), F.bround(F.col("__n") * F.lit(float(fraction))))
    drawn = df.withColumn("__h", draw(seed, *unique))
    ranked = bucketed_rank(drawn, strata, ["__h", *unique], hash_bucket("__h"), "__r", "__n", upto=keep)
    return ranked.where(F.col("__r") <= keep).drop("__h", "__r", "__n")


def cap_in_order(df: DataFrame, plate: Sequence[str], well: Sequence[str], order: Sequence[str], per_plate: int | None = None, per_well: int | None = None) -> DataFrame:
    """First rows per plate, then per well, in the given order."""
    out = top_n(df, plate, order, per_plate) if per_plate else df
    return top_n(out, well, order, per_well) if per_well else out


def assign_buckets(df: DataFrame, source: str, order: Sequence[str], size: int, out: str = "snakemake_batch", suffix: str = "_snakemake_batch_") -> DataFrame:
    """``{source}_snakemake_batch_{i}``: consecutive runs of ``size`` rows, restarting per source."""
    check_positive(size=size)
    ranked = ranged_rank(df, [source], order, "__r")
    name = F.concat(F.col(source).cast("string"), F.lit(suffix), F.floor((F.col("__r") - 1) / size).cast("string"))
    return ranked.withColumn(out, name).drop("__r")


def fixed_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, out: str = "slice") -> DataFrame:
    check_positive(size=size)
    ranked = ranged_rank(df, keys, order, "__r")
    return ranked.withColumn(out, F.floor((F.col("__r") - 1) / size)).drop("__r")


def slice_counts(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(n / size)).alias("n_slices"))


def file_plan(df: DataFrame, order: Sequence[str], rows_per_file: int = 25_000, max_files: int | None = None) -> DataFrame:
    """Contiguous equal ranges: ``file = (row-1) // ceil(N / files)``, ``files`` from the file size and at most ``max_files`` if given."""
    check_positive(rows_per_file=rows_per_file, **({} if max_files is None else {"max_files": max_files}))
    ranked = ranged_rank(df, [], order, "__r", "__n")
    files = F.ceil(F.col("__n") / rows_per_file)
    files = files if max_files is None else F.least(files, F.lit(max_files))
    return ranked.withColumn("file", F.floor((F.col("__r") - 1) / F.ceil(F.col("__n") / files))).drop("__r", "__n")


def batch_diverse(df: DataFrame, keys: Sequence[str], batch: str, n: int, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """Round-robin over the batches of each key until ``n`` rows are picked.

    Round r takes the r-th row of every batch; within a round batches come in hashed order.
    At most ``n`` rows per (key, batch) can matter, so both ranks are trimmed map-side.
    """
    check_positive(n=n)
    drawn = df.withColumn("__h", draw(seed, *unique))
    rounds = top_n(drawn, [*keys, batch], ["__h", *unique], n, rank="__round")
    order = [F.col("__round"), draw(seed, *keys, batch), F.col("__h"), *[F.col(u) for u in unique]]
    return top_n(rounds, keys, order, n).drop("__h", "__round")


def treatment_wells(wells: DataFrame, universe: DataFrame, key: str, source: str, batch: str, plate: Sequence[str], plate_type: str, eligible: Sequence[str], is_control: Column, n: int, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """Wells of wanted keys on eligible plates that also hold a control, batch-diverse per key and source."""
    pool = wells.where(F.col(plate_type).isin(list(eligible)))
    pool = on_plates_with_control(pool, plate, is_control)
    pool = skew_safe_semi(pool, universe, [key])
    return batch_diverse(pool, [key, source], batch, n, unique, seed)


def control_per_plate(wells: DataFrame, touched: DataFrame, plate: Sequence[str], is_control: Column, unique: Sequence[str], n: int = 1, seed: int = SEED) -> DataFrame:
    pool = skew_safe_semi(wells.where(is_control), touched, plate)
    return per_group(pool, plate, n, unique, seed)


def role_priority(wells: DataFrame, plate: Sequence[str], role: Column, fill_to: int, unique: Sequence[str], seed: int = SEED) -> DataFrame:
    """All controls, all positive controls, then random treatment up to ``fill_to`` per plate.

    ``role`` yields 'dmso', 'poscon' or 'treatment'. Controls stay even above the limit.
    """
    tagged = wells.withColumn("role", role)
    fixed = tagged.where("role <> 'treatment'")
    used = fixed.groupBy(*plate).agg(F.count(F.lit(1)).alias("__used"))
    fill = tagged.where("role = 'treatment'").withColumn("__h", draw(seed, *unique))
    best = top_n(fill, plate, ["__h", *unique], fill_to, rank="__r")
    room = salted_join(best, used, plate, "left").where(
        F.col("__r") <= F.lit(fill_to) - F.coalesce(F.col("__used"), F.lit(0))
    )
    return fixed.unionByName(room.select(*fixed.columns))


def group_split(df: DataFrame, group: str, test: float, val: float, pinned: Column | None = None, seed: int = SEED, out: str = "split") -> DataFrame:
    """Whole groups go to test, val or train; rows matching ``pinned`` always train.

    Groups are ranked by hash; ``round_half_even(fraction · groups)`` go to test and val.
    """
    check_fractions(test, val)
    free = ~F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(True)
    groups = df.where(free).select(group).where(F.col(group).isNotNull()).distinct().withColumn("__h", draw(seed, group))
    ranked = bucketed_rank(groups, [], ["__h", group], hash_bucket("__h"), "__r", "__n")
    n_test = F.bround(F.col("__n") * F.lit(float(test)))
    n_val = F.bround(F.col("__n") * F.lit(float(val)))
    parts = ranked.select(
        group,
        F.when(F.col("__r") <= n_test, "test").when(F.col("__r") <= n_test + n_val, "val").otherwise("train").alias("__s"),
    )
    joined = salted_join(df, parts, [group], "left")
    return joined.withColumn(out, F.when(free, F.coalesce(F.col("__s"), F.lit("train"))).otherwise("train")).drop("__s")


def oversample_factor(df: DataFrame, keys: Sequence[str], well: Sequence[str], batch: str, cells_per_well: int, target: int = 100, ceiling: int = 5) -> DataFrame:
    """``min(ceiling, ceil(target / max(wells·cells, 1)))`` and distinct batches per key."""
    wells = df.groupBy(*keys, *[w for w in well if w not in keys], batch).agg(F.count(F.lit(1)).alias("__c"))
    counted = wells.groupBy(*keys).agg(
        F.countDistinct(*well).alias("n_wells"), F.countDistinct(batch).alias("n_batches")
    )
    cells = F.greatest(F.col("n_wells") * cells_per_well, F.lit(1))
    return counted.withColumn("factor", F.least(F.lit(ceiling).cast("bigint"), F.ceil(F.lit(float(target)) / cells)))


def first_rows(df: DataFrame, key: str, order: Sequence[str], payload: DataFrame | None = None, payload_key: str | None = None) -> DataFrame:
    """One row per key from the narrow table; the payload is joined afterwards."""
    narrow = first_per_key(df, [key], [*order])
    return narrow if payload is None else narrow.join(payload, payload_key, "inner")


def same_rows_across(variants: dict[str, DataFrame], key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows drawn once and shown for every variant."""
    names = list(variants)
    picked = in_total(variants[names[0]].select(key).distinct(), n, [key], seed)
    out = None
    for name in names:
        part = variants[name].join(picked, key, "left_semi").withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
