"""Replicate average precision, permutation significance and BH correction.

Public definition (Kalinin et al., "A versatile information retrieval framework for evaluating
profile strength and similarity"): for a query, positives are profiles of the same perturbation
on another plate, negatives are profiles on the same plate with another reference index.
AP averages, over the positives in similarity order, (positives so far) / (all so far);
a positive precedes a negative of equal similarity. Example: ranking + - + - has
AP = (1/1 + 2/3) / 2 = 5/6.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..plans.blocks import _arrow_schema, chunks, default_lane_rows, grid, matrix, similarity, values
from ..plans.durable import checkpoint, materialise
from ..plans.joins import salted_join
from ..plans.ranking import pieces
from ..plans.sizing import shuffle_partitions

NULL_SIZE = 10_000  # fixed values
SEED = 42
THRESHOLD = 0.05
BAND_ROWS = 50_000  # similarities of one query held in one row
LISTS = 4  # times that the similarities of a query are shuffled when they are written as lists
LANES = 4  # gallery lanes that one cell may hold of a perturbation and of a plate


def _codes(*columns: np.ndarray) -> np.ndarray:
    """One integer per distinct value combination."""
    frame = pd.DataFrame({i: c for i, c in enumerate(columns)})
    return frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()


def _same(left: pa.Table, right: pa.Table, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [np.concatenate([values(left, c), values(right, c)]) for c in cols]
    code = _codes(*both)
    return code[: left.num_rows], code[left.num_rows :]


def _lists(rows: np.ndarray, flat: np.ndarray, n: int, kind) -> pa.Array:
    """ListArray from (row index, value) pairs sorted by row."""
    offsets = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def average_precision(
    df: DataFrame,
    id_col: str,
    vec: str,
    perturbation: str,
    plate: Sequence[str],
    is_control: Column,
    dim: int,
    diff_mode: str = "any",
    negatives: str = "ref_index",
    lane_rows: int | None = None,
) -> DataFrame:
    """``id, perturbation, n_pos, n_neg, ap`` for every treated well; ap is null without positives.

    ``diff_mode`` says whether 'any' or 'all' plate columns must differ for a positive.
    ``negatives``: 'ref_index' takes every other well of the plate, 'controls' only controls.

    No pair becomes a row. The queries of one plate and perturbation have the same positives and
    negatives. Where they are many, all of these meet in one cell that returns a number per query (``_in_cells``).
    Elsewhere, and where a perturbation or plate is too large for a cell, positives of a query are
    similarity arrays, cut into bands of the similarity range when a perturbation is large; per plate, matrix products
    count the negatives above each positive; AP follows from the counts (``_by_lists``).
    """
    if diff_mode not in ("any", "all") or negatives not in ("ref_index", "controls"):
        raise ValueError("diff_mode: any|all, negatives: ref_index|controls")
    plate = list(plate)
    rows = lane_rows or default_lane_rows(dim)
    wells = l2_normalize(df, vec).select(
        F.col(id_col).alias("id"), F.col(perturbation).alias("pert"), *plate,
        F.coalesce(is_control, F.lit(False)).alias("ctrl"), F.col("unit").alias("vec"),
    )
    treated = wells.where(~F.col("ctrl"))
    id_type = df.schema[id_col].dataType
    rival = F.col("ctrl") if negatives == "controls" else F.lit(True)
    replicates = treated.where(F.col("pert").isNotNull())
    n_reps = replicates.groupBy("pert").agg(F.count(F.lit(1)).alias("nq")).withColumn("ng", F.col("nq"))
    on_plate = wells.groupBy(*plate).agg(F.count_if(~F.col("ctrl")).alias("nq"), F.count_if(rival).alias("ng"))

    # a cell gets a vector of each positive, a list a number of each query and positive
    groups = replicates.groupBy(*plate, "pert").agg(F.count(F.lit(1)).alias("__c"))
    groups = groups.join(n_reps.select("pert", F.col("ng").alias("__pos")), "pert").join(on_plate.select(*plate, F.col("ng").alias("__neg")), plate)
    cell = (F.col("__c") * LISTS >= dim) & (F.greatest("__pos", "__neg") <= LANES * rows)
    lanes = F.ceil(F.sum("__pos").over(Window.partitionBy(*plate)) / rows)
    groups = materialise(groups.where(cell).withColumn("__lane", F.pmod(F.xxhash64("pert"), lanes).cast("int")).select(*plate, "pert", "__lane"))
    if groups.isEmpty():
        per_query = _by_lists(wells, treated, replicates, replicates, rival, n_reps, on_plate, plate, id_type, dim, diff_mode, lane_rows)
    else:
        asked = salted_join(treated, groups, [*plate, "pert"], "left", spread_by=["id"], null_safe=True)
        rest = asked.where(F.col("__lane").isNull()).drop("__lane")
        held = asked.where(F.col("__lane").isNotNull())
        per_query = _in_cells(wells.where(rival), held, replicates, groups, plate, id_type, diff_mode)
        others = rest.where(F.col("pert").isNotNull())
        if not others.isEmpty():
            per_query = per_query.unionByName(_by_lists(wells, rest, others, replicates, rival, n_reps, on_plate, plate, id_type, dim, diff_mode, lane_rows))
    return treated.select("id", "pert").join(per_query, "id", "left").select(
        F.col("id").alias(id_col), F.col("pert").alias(perturbation), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), "n_neg", "ap"
    )


def _in_cells(rivals: DataFrame, held: DataFrame, replicates: DataFrame, groups: DataFrame, plate: list[str], id_type: T.DataType, diff_mode: str) -> DataFrame:
    """``id, n_pos, n_neg, ap`` of the ``held`` queries that have positives.

    A cell is a plate's lane of perturbations: its queries, their replicates on other plates, and the plate's negatives.
    What is shuffled grows with queries and positives, not with their pairs, and one row per query comes out.
    """
    far = [~F.col(f"__at_{c}").eqNullSafe(F.col(c)) for c in plate]
    apart = reduce(operator.or_ if diff_mode == "any" else operator.and_, far)
    elsewhere = replicates.withColumnsRenamed({c: f"__at_{c}" for c in plate})
    row = lambda role: [*plate, "__lane", F.lit(role).alias("__role"), "id", "pert", "vec"]
    lanes = groups.select(*plate, "__lane").distinct()
    parts = [
        held.select(*row(0)),
        elsewhere.join(groups, "pert").where(apart).select(*row(1)),
        rivals.join(lanes, plate).select(*row(2)),
    ]
    kind = T.StructType([T.StructField("id", id_type), T.StructField("n_pos", T.LongType()), T.StructField("n_neg", T.LongType()), T.StructField("ap", T.DoubleType())])
    schema = _arrow_schema(kind)

    def score(t: pa.Table) -> pa.Table:
        role, vecs = values(t, "__role"), matrix(t)
        ids, perts = _codes(values(t, "id")), _codes(values(t, "pert"))
        neg = np.flatnonzero(role == 2)
        gm = vecs[neg]
        took, n_pos, n_neg, ap = [], [], [], []
        for pert in np.unique(perts[role == 0]):
            asked, pos = np.flatnonzero((role == 0) & (perts == pert)), np.flatnonzero((role == 1) & (perts == pert))
            pm = vecs[pos]
            for s, e in chunks(len(asked), len(pos) + len(neg)):
                near, far = similarity(vecs[asked[s:e]], pm, "cosine"), similarity(vecs[asked[s:e]], gm, "cosine")
                for i, q in enumerate(asked[s:e]):
                    up = np.sort(near[i][ids[pos] != ids[q]])[::-1]
                    if not len(up):
                        continue
                    down = np.sort(far[i][ids[neg] != ids[q]])
                    place = np.arange(1, len(up) + 1)
                    took.append(q)
                    n_pos.append(len(up))
                    n_neg.append(len(down))
                    ap.append((place / (place + len(down) - np.searchsorted(down, up, side="right"))).mean())
        names = t.column("id").take(pa.array(took, pa.int64())).combine_chunks()
        return pa.Table.from_arrays([names, pa.array(n_pos, pa.int64()), pa.array(n_neg, pa.int64()), pa.array(ap, pa.float64())], names=schema.names).cast(schema)

    every = reduce(DataFrame.unionByName, parts)
    # few cells with much work each: an explicit number keeps them apart
    return every.repartition(shuffle_partitions(every), *plate, "__lane").groupBy(*plate, "__lane").applyInArrow(score, kind)


def _by_lists(wells: DataFrame, treated: DataFrame, queries: DataFrame, replicates: DataFrame, rival: Column, n_reps: DataFrame, on_plate: DataFrame, plate: list[str], id_type: T.DataType, dim: int, diff_mode: str, lane_rows: int | None) -> DataFrame:
    """``id, n_pos, n_neg, ap`` of the ``queries`` that have positives, which are written as lists of similarities."""
    # positives: the query's similarity to every replicate on another plate
    pos_type = T.StructType([
        T.StructField("id", id_type), T.StructField("band", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType())),
    ])
    pos_schema = _arrow_schema(pos_type)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pos_schema.empty_table()
        qm, gm, bands = matrix(left), matrix(right), -(-int(values(left, "__nq")[0]) // BAND_ROWS)
        tests = [_same(left, right, [c]) for c in plate]
        own_q, own_g = _same(left, right, ["id"])
        parts = []
        for s, e in chunks(len(qm), len(gm)):
            sim = similarity(qm[s:e], gm, "cosine")
            differ = [q[s:e, None] != g[None, :] for q, g in tests]
            ok = np.logical_or.reduce(differ) if diff_mode == "any" else np.logical_and.reduce(differ)
            ok &= own_q[s:e, None] != own_g[None, :]
            r, c = np.nonzero(ok)
            v = sim[r, c]
            band = np.clip(np.floor((v + 1.0) / 2.0 * bands), 0, bands - 1).astype(np.int64)
            cell = r * bands + band
            o = np.argsort(cell, kind="stable")
            used, inv = np.unique(cell[o], return_inverse=True)
            lists = _lists(inv, v[o], len(used), pa.float64())
            ids = left.column("id").take(pa.array(used // bands + s))
            parts.append(pa.Table.from_arrays([ids.combine_chunks(), pa.array(used % bands), lists], names=pos_schema.names).cast(pos_schema))
        return pa.concat_tables(parts)

    cells = grid(queries, replicates, ["pert"], "id", "id", dim, positives, pos_type, lane_rows, sizes=n_reps)
    per_band = cells.groupBy("id", "band").agg(F.sort_array(F.flatten(F.collect_list("s")), asc=False).alias("s"))
    ahead = Window.partitionBy("id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("id")
    ranked = per_band.withColumns({
        "offset": F.coalesce(F.sum(F.size("s")).over(ahead), F.lit(0)).cast("bigint"),
        "n_pos": F.sum(F.size("s")).over(whole).cast("bigint"),
    })

    # negatives: how many wells of the plate beat each positive
    asked = ranked.join(treated.select("id", *plate, "vec"), "id")
    neg_type = T.StructType([
        T.StructField("id", id_type), T.StructField("band", T.IntegerType()), T.StructField("offset", T.LongType()),
        T.StructField("n_pos", T.LongType()), T.StructField("beats", T.ArrayType(T.DoubleType())), T.StructField("n_neg", T.LongType()),
    ])
    neg_schema = _arrow_schema(neg_type)

    def count_above(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return neg_schema.empty_table()
        qm = matrix(left)
        gm = matrix(right) if right.num_rows else np.empty((0, qm.shape[1]))
        own_q, own_g = _same(left, right, ["id"])
        pos = left.column("s").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pos).to_numpy(zero_copy_only=False))])
        flat = pos.flatten().to_numpy(zero_copy_only=False)
        beats, totals = np.empty(len(flat)), np.empty(len(qm), dtype=np.int64)
        for s, e in chunks(len(qm), len(gm)):
            sim = similarity(qm[s:e], gm, "cosine")
            for i in range(s, e):
                neg = np.sort(sim[i - s][own_g != own_q[i]])
                at = slice(ends[i], ends[i + 1])
                beats[at] = len(neg) - np.searchsorted(neg, flat[at], side="right")
                totals[i] = len(neg)
        lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(beats))
        kept = [left.column(c).combine_chunks() for c in ("id", "band", "offset", "n_pos")]
        return pa.Table.from_arrays([*kept, lists, pa.array(totals)], names=neg_schema.names).cast(neg_schema)

    counted = grid(
        asked.select("id", "band", "offset", "n_pos", "s", "vec", *plate), wells.where(rival).select("id", "vec", *plate),
        plate, "id", "id", dim, count_above, neg_type, lane_rows, sizes=on_plate,
    )
    above = counted.groupBy("id", "band", "offset", "n_pos").agg(
        vector_to_array(Summarizer.sum(array_to_vector("beats"))).alias("beats"), F.sum("n_neg").alias("n_neg")
    )
    place = F.transform("beats", lambda b, i: (F.col("offset") + i + 1) / (F.col("offset") + i + 1 + b))
    return above.withColumn("part", F.aggregate(place, F.lit(0.0), lambda a, x: a + x)).groupBy("id", "n_pos").agg(
        F.max("n_neg").alias("n_neg"), (F.sum("part") / F.col("n_pos")).alias("ap")
    )


def map_per_perturbation(ap: DataFrame, perturbation: str) -> DataFrame:
    scored = ap.where(F.col("ap").isNotNull())
    return scored.groupBy(perturbation).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("ap").alias("mean_ap"))


MIX = (0x85EBCA6B, 0xC2B2AE35)  # fixed values: a public 32-bit finaliser
LONG_LIST = 65_536


def _mix(h: np.ndarray) -> np.ndarray:
    """32-bit numbers scattered over all 32 bits; any engine with 64-bit integers can repeat it."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(MIX[0])
    h = (h ^ (h >> np.uint32(13))) * np.uint32(MIX[1])
    return h ^ (h >> np.uint32(16))


def _null_draws(n_pos: int, n_total: int, size: int, seed: int = SEED) -> np.ndarray:
    """AP of ``size`` random rankings with ``n_pos`` positives among ``n_total``.

    Walks down the ranks of all rankings at once: the next rank is a positive with the share of positives among
    the ranks left, so every set of ranks is equally likely. The random number of ranking i at rank t is a hash of
    seed, shape, i and t, with no state. Few positives in a list beyond ``LONG_LIST`` are drawn as sets instead.
    """
    if n_total > LONG_LIST and n_pos * 50 < n_total:
        rng = np.random.default_rng([seed, n_pos, n_total])
        ranks = np.stack([np.sort(rng.choice(n_total, n_pos, replace=False, shuffle=False)) for _ in range(size)])
        return (np.arange(1, n_pos + 1) / (ranks + 1)).mean(axis=1)
    one = lambda x: np.array([x & 0xFFFFFFFF], dtype=np.uint32)
    key = _mix(_mix(_mix(one(seed ^ n_pos)) ^ one(n_total)) ^ np.arange(size, dtype=np.uint32))
    at = _mix(np.arange(1, n_total + 1, dtype=np.uint32))
    seen, total = np.zeros(size, dtype=np.int64), np.zeros(size)
    for t in range(n_total):
        hit = _mix(key ^ at[t]).astype(np.int64) * (n_total - t) < (n_pos - seen) << 32
        seen += hit
        total += np.where(hit, seen / (t + 1), 0.0)
    return total / n_pos


def null_distributions(configs: DataFrame, null_size: int = NULL_SIZE, seed: int = SEED) -> DataFrame:
    """``n_pos, n_neg, nulls`` for distinct list shapes; the numbers depend on seed and shape only."""

    def draw(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "n_pos": pdf["n_pos"], "n_neg": pdf["n_neg"],
                "nulls": [_null_draws(int(p), int(p + n), null_size, seed) for p, n in zip(pdf["n_pos"], pdf["n_neg"])],
            })

    # few rows with much work each: an explicit number, so that adaptive execution does not fold them into one task; before
    # distinct(), as Spark leaves out a repartition that repeats the one of distinct(), and folds that
    shapes = configs.select("n_pos", "n_neg").repartition(shuffle_partitions(configs), "n_pos", "n_neg").distinct()
    return shapes.mapInPandas(draw, "n_pos bigint, n_neg bigint, nulls array<double>")


def significance(ap: DataFrame, perturbation: str, null_size: int = NULL_SIZE, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """mAP with permutation p-value, BH-corrected p-value and flags.

    The null of a perturbation is the mean of its queries' nulls: a weighted mean over the
    distinct list shapes, taken as one vector aggregate. The AP table and the p-values, which hold all the
    drawing, are used twice, so they are written to the checkpoint folder first.
    """
    ap = checkpoint(ap)
    scored = ap.where(F.col("ap").isNotNull())
    shapes = scored.groupBy(perturbation, "n_pos", "n_neg").agg(F.count(F.lit(1)).alias("w"))
    nulls = null_distributions(shapes, null_size, seed)
    weighted = salted_join(shapes, nulls, ["n_pos", "n_neg"])
    null_map = weighted.groupBy(perturbation).agg(
        vector_to_array(Summarizer.mean(array_to_vector("nulls"), F.col("w").cast("double"))).alias("nulls")
    )
    maps = map_per_perturbation(ap, perturbation).join(null_map, perturbation)
    # compared at 12 digits, so that a null equal to the mAP does not beat it by the order of its sum
    above = F.size(F.filter("nulls", lambda x: F.round(x, 12) > F.round(F.col("mean_ap"), 12)))
    p = checkpoint(maps.withColumn("p_value", (above + 1) / F.lit(null_size + 1)).drop("nulls"))
    return bh_adjust(p, "p_value").withColumns({
        "below_p": F.col("p_value") < threshold, "below_corrected_p": F.col("corrected_p_value") < threshold,
    })


def bh_adjust(df: DataFrame, p: str, out: str = "corrected_p_value") -> DataFrame:
    """Benjamini–Hochberg: ``min over p' ≥ p of p'·m/rank(p')``, capped at 1; null stays null.

    Works on the distinct p-values, dealt out in consecutive pieces: ranks add the counts of the
    pieces before, minima take those of the pieces after, and only one row per piece is seen together.
    """
    steps = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    dealt = pieces(steps, [], ["__p"])
    per = dealt.groupBy("__piece").agg(F.sum("__c").alias("__in"))
    by_piece = Window.partitionBy().orderBy("__piece")  # one row per piece
    before = F.coalesce(F.sum("__in").over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("__piece", before.alias("__before"), F.sum("__in").over(Window.partitionBy()).alias("__m"))
    inside = Window.partitionBy("__piece").orderBy("__p")
    rank = F.col("__before") + F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    raw = checkpoint(dealt.join(per, "__piece").withColumn("__q", F.col("__p") * F.col("__m") / rank).select("__piece", "__p", "__q"))
    later = F.min("__low").over(by_piece.rowsBetween(1, Window.unboundedFollowing))
    after = raw.groupBy("__piece").agg(F.min("__q").alias("__low")).select("__piece", later.alias("__after"))
    least = F.least(F.min("__q").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("__after"), F.lit(1.0))
    adj = raw.join(after, "__piece").select(F.col("__p").alias(p), least.alias(out))
    return salted_join(df, adj, [p], "left")
