"""Cosine retrieval: Recall@k, prototype retrieval, fingerprint neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import l2_normalize
from ..plans.blocks import _arrow_schema, chunks, grid, topk, values
from ..plans.ranking import top_n

K_MAX = 10  # fixed value


def first_hits(df: DataFrame, query: Column, gallery: Column, id_col: str, vec: str, label: str, is_control: Column, dim: int, k: int = K_MAX, lane_rows: int | None = None) -> DataFrame:
    """``id, label, first_hit``: rank of the nearest gallery row with the query's label, null beyond k.

    Controls are removed first; a row in both sets never retrieves itself.
    """
    wells = l2_normalize(df.where(~F.coalesce(is_control, F.lit(False))), vec)
    q, g = wells.where(query), wells.where(gallery)
    near = topk(q, g, k, dim, id_col=id_col, carry=[label], lane_rows=lane_rows)
    hits = near.where(F.col(f"q_{label}").eqNullSafe(F.col(f"g_{label}"))).groupBy("q_id").agg(F.min("rank").alias("first_hit"))
    return q.select(F.col(id_col).alias("q_id"), label).join(hits, "q_id", "left")


def recall_at_k(hits: DataFrame, label: str, k: int = K_MAX) -> DataFrame:
    """Per perturbation: query wells and hit rate within each k. One minimum rank answers every k."""
    rates = [
        F.avg(F.when(F.col("first_hit") <= i, 1.0).otherwise(0.0)).alias(f"recall_at_{i}") for i in range(1, k + 1)
    ]
    return hits.groupBy(label).agg(F.count(F.lit(1)).alias("n_query_wells"), *rates)


def macro_recall(per_label: DataFrame, k: int = K_MAX, tags: dict[str, str] | None = None) -> DataFrame:
    return per_label.agg(
        F.count(F.lit(1)).alias("n_perturbations"), F.sum("n_query_wells").alias("n_query_wells"),
        *[F.avg(f"recall_at_{i}").alias(f"recall_at_{i}") for i in range(1, k + 1)],
    ).select(*[F.lit(v).alias(t) for t, v in (tags or {}).items()], "*")


def assert_gallery(df: DataFrame, query: Column, gallery: Column, is_control: Column, k: int) -> None:
    """Runs a job: at least one query and k gallery rows besides controls."""
    ctrl = F.coalesce(is_control, F.lit(False))
    r = df.where(~ctrl).agg(F.count_if(query).alias("q"), F.count_if(gallery).alias("g")).first()
    if r.q == 0:
        raise ValueError("no query wells besides controls")
    if r.g < k:
        raise ValueError(f"gallery has {r.g} wells, need at least {k}")


def class_hits(queries: DataFrame, index: DataFrame, q_cls: str, i_cls: str, q_vec: str, i_vec: str, q_id: str, dim: int, k: int, normalize: bool = True) -> DataFrame:
    """Rank of the own class among the index rows, per query: ``id, cls, first_hit``.

    ``index`` holds one vector per class. k beyond the index size simply takes all of it.
    """
    q = queries.select(F.col(q_id).cast("string").alias("id"), F.col(q_cls).cast("string").alias("cls"), F.col(q_vec).alias("v"))
    g = index.select(F.col(i_cls).cast("string").alias("id"), F.col(i_cls).cast("string").alias("cls"), F.col(i_vec).alias("v"))
    if normalize:
        q, g = l2_normalize(q, "v"), l2_normalize(g, "v")
    else:
        q, g = q.withColumnRenamed("v", "unit"), g.withColumnRenamed("v", "unit")
    near = topk(q, g, k, dim, carry=["cls"], exclude_self=False)
    hit = near.where("q_cls = g_cls").groupBy("q_id").agg(F.min("rank").alias("first_hit"))
    return q.select(F.col("id").alias("q_id"), "cls").join(hit, "q_id", "left")


def paired_hits(queries: DataFrame, index: DataFrame, q_id: str, q_vec: str, i_id: str, i_vec: str, dim: int, k: int) -> DataFrame:
    """Index-paired mode: a hit is the index row with the same id."""
    return class_hits(queries, index, q_id, i_id, q_vec, i_vec, q_id, dim, k)


def hit_rates(hits: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Micro (over queries) and macro (over classes) rates: one row."""
    flag = lambda k: F.when(F.col("first_hit") <= k, 1.0).otherwise(0.0)
    per = hits.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *[F.sum(flag(k)).alias(f"h{k}") for k in ks])
    cols = [F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n_queries")]
    for k in ks:
        cols += [(F.sum(f"h{k}") / F.sum("n")).alias(f"micro_at_{k}"), F.avg(F.col(f"h{k}") / F.col("n")).alias(f"macro_at_{k}")]
    return per.agg(*cols)


def tanimoto_topk(df: DataFrame, id_col: str, bits: str, k: int, dim: int, min_sim: float = 0.0, gamma: float = 1.0, scale: float = 1.0, alpha: float = 1.0, eps: float = 1e-8, lane_rows: int | None = None) -> DataFrame:
    """k nearest fingerprints per row with their neighbour weight.

    ``bits`` is an array; entries > 0 are set. Similarity is |a∩b| / |a∪b| (0 for two empty
    sets). Intersections come from blocked products of 0/1 matrices, so a bit set in a third of
    all rows costs no more than a rare one. Weight: ``((s-min)/(1-min+eps))^gamma · scale · alpha``.
    """
    src = df.select(id_col, F.transform(F.col(bits).cast("array<double>"), lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("vec"))
    schema = T.StructType([
        T.StructField("q_id", df.schema[id_col].dataType), T.StructField("g_id", df.schema[id_col].dataType),
        T.StructField("sim", T.DoubleType()),
    ])
    out_schema = _arrow_schema(schema)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        from ..plans.blocks import matrix

        if left.num_rows == 0 or right.num_rows == 0:
            return out_schema.empty_table()
        qm, gm, qid, gid = matrix(left), matrix(right), values(left, id_col), values(right, id_col)
        qs, gs = qm.sum(1), gm.sum(1)
        tie = np.argsort(np.argsort(gid, kind="stable"), kind="stable")
        parts = []
        for s, e in chunks(len(qid), len(gid)):
            inter = qm[s:e] @ gm.T
            union = qs[s:e, None] + gs[None, :] - inter
            sim = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
            sim[qid[s:e, None] == gid[None, :]] = -1.0
            kk = min(k, sim.shape[1])
            kth = np.partition(sim, sim.shape[1] - kk, axis=1)[:, -kk]
            r, c = np.nonzero((sim >= kth[:, None]) & (sim >= 0))
            v = sim[r, c]
            o = np.lexsort((tie[c], -v, r))
            r, c, v = r[o], c[o], v[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < kk
            parts.append(pa.Table.from_arrays([pa.array(qid[s:e][r[keep]]), pa.array(gid[c[keep]]), pa.array(v[keep])], names=out_schema.names))
        return pa.concat_tables(parts).cast(out_schema)

    cells = grid(src, src, [], id_col, id_col, dim, best, schema, lane_rows)
    near = top_n(cells, ["q_id"], [F.col("sim").desc(), "g_id"], k, rank="rank").where(F.col("sim") >= min_sim)
    base = F.least(F.greatest((F.col("sim") - min_sim) / (1.0 - min_sim + eps), F.lit(0.0)), F.lit(1.0))
    return near.withColumn("weight", F.pow(base, F.lit(float(gamma))) * scale * max(alpha, 0.0))
