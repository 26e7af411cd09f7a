"""Blocked vector similarity.

Two tables of vectors are cut into lanes of bounded size. Every (query lane, gallery lane)
cell of the grid becomes one group of a co-grouped Arrow job, which multiplies two matrices
and returns only what the operator needs: the best k per query, sums per label, counts above
a threshold. No row pair is ever materialised, a hot key is split over many cells, and every
pair is still looked at, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import salted_join
from .sizing import shuffle_partitions

LANE_BYTES = 24 << 20
QUERY_SHARE = 4  # a query lane has this part of a gallery lane's rows: what a cell returns grows with its queries
CHUNK_CELLS = 1_000_000  # similarity cells held at once inside a task, in about ten arrays
TILE_CELLS = 2_000_000  # pairs held at once for nearest neighbours, in about three arrays
MIN_LANE_ROWS = 128
SIM_DIGITS = 12


def matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    """Rows of an array column as a float64 matrix."""
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) if n else np.empty((0, 0))


def values(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def similarity(q: np.ndarray, g: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer. Rounded so that equal vectors tie however the lanes fall."""
    if metric == "euclidean":
        d2 = (q * q).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2.0 * (q @ g.T)
        return -np.round(np.sqrt(np.maximum(d2, 0.0)), SIM_DIGITS - 2)
    return np.round(q @ g.T, SIM_DIGITS)


def nearest(q: np.ndarray, g: np.ndarray, k: int, metric: str, tie: np.ndarray, self_col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, gallery row, rounded similarity) of the k best per query, ordered by it and then by ``tie``; ``self_col`` is left out.

    Every pair's raw distance is taken by matrix products, of short numbers where they tell enough. Only pairs within the k-th of a
    query, with room for the products' error, are taken again from the vectors themselves, rounded and sorted, ties included. So
    the result is that of sorting all pairs, and equal vectors tie whatever the products' rounding.
    """
    euclidean = metric == "euclidean"
    digits = SIM_DIGITS - 2 if euclidean else SIM_DIGITS
    q2, g2 = (q * q).sum(1), (g * g).sum(1)
    most = q2.max(initial=0.0) + g2.max(initial=0.0)
    slack = 10.0**-digits  # whatever rounds to the k-th similarity lies within

    def sim(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(i)), max(1, CHUNK_CELLS // max(1, q.shape[1]))
        for s in range(0, len(i), step):
            a, b = q[i[s : s + step]], g[j[s : s + step]]
            out[s : s + step] = -np.sqrt(np.square(a - b).sum(1)) if euclidean else (a * b).sum(1)
        return np.round(out, digits)

    def within(rows: slice, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be among the k best, by products of ``kind``."""
        dots = q[rows].astype(kind, copy=False) @ side[kind]
        x = np.subtract(np.add.outer(q2[rows].astype(kind), g2.astype(kind)), dots, out=dots) if euclidean else dots
        at = np.flatnonzero(self_col[rows] >= 0)
        x[at, self_col[rows][at]] = np.nan
        limit = np.full(len(x), np.inf)
        if k < len(g):
            noise = 4 * (q.shape[1] + 4) * np.finfo(kind).eps * (q2[rows] + g2.max())
            kth = np.partition(x, k - 1, axis=1)[:, k - 1].astype(np.float64)  # missing ones are last
            worst = -np.sqrt(np.maximum(kth, 0.0) + noise) if euclidean else -kth - noise
            limit = (np.square(slack - worst) if euclidean else slack - worst) + noise
            limit[np.isnan(limit)] = np.inf
        return np.nonzero(x <= np.nextafter(limit.astype(kind), kind(np.inf))[:, None])

    side = {np.float64: (2.0 * g if euclidean else -g).T}
    kind = np.float64
    if k < len(g) and 1e-20 < most < 1e30:
        kind, side[np.float32] = np.float32, side[np.float64].astype(np.float32)
    found, step = [], max(1, TILE_CELLS // max(1, len(g)))
    for s in range(0, len(q), step):
        rows = slice(s, min(s + step, len(q)))
        r, c = within(rows, kind)
        if kind is np.float32 and len(r) > 2 * k * (rows.stop - s):  # distances too alike for short numbers
            kind = np.float64
            r, c = within(rows, kind)
        v = sim(r + s, c)
        r, c, v = (a[np.isfinite(v)] for a in (r, c, v))
        o = np.lexsort((tie[c], -v, r))
        r, c, v = r[o], c[o], v[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((r[keep] + s, c[keep], v[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def chunks(n_rows: int, n_cols: int):
    step = max(1, CHUNK_CELLS // max(1, n_cols))
    for start in range(0, n_rows, step):
        yield start, min(n_rows, start + step)


def default_lane_rows(dim: int) -> int:
    """Rows of a lane of ``LANE_BYTES``."""
    return max(MIN_LANE_ROWS, LANE_BYTES // (8 * max(1, dim)))


def grid(
    queries: DataFrame,
    gallery: DataFrame,
    keys: Sequence[str],
    q_id: str,
    g_id: str,
    dim: int,
    fn: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType | str,
    lane_rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Run ``fn(query lane, gallery lane)`` for every cell of every key.

    Lane counts follow from row counts per key (``sizes``: keys, nq, ng; computed in the same
    plan unless given, and only a guide, so estimates are fine). An explicit partition number
    keeps adaptive execution from folding the cells into a few tasks. A query lane meets an
    empty table when its gallery lane has no rows.
    """
    keys = list(keys)
    rows = lane_rows or default_lane_rows(dim)
    q_rows = lane_rows or max(MIN_LANE_ROWS, rows // QUERY_SHARE)
    n_parts = shuffle_partitions(queries)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    lanes_for = lambda n, r: F.greatest(F.ceil(F.col(n) / r), F.lit(1)).cast("int")
    if keys:
        if sizes is None:
            same = queries is gallery
            sizes = count(queries, "nq").withColumn("ng", F.col("nq")) if same else count(queries, "nq").join(count(gallery, "ng"), keys)
        lanes = sizes.select(*keys, F.col("nq").alias("__nq"), lanes_for("nq", q_rows).alias("__a"), lanes_for("ng", rows).alias("__b"))
        q, g = salted_join(queries, lanes, keys, spread_by=[q_id]), salted_join(gallery, lanes, keys, spread_by=[g_id])
        a, b = F.col("__a"), F.col("__b")
    else:
        # one table-wide count per side, read as scalar subqueries; about n_parts cells, shaped so
        # that the rows sent (nq·b + ng·a) are fewest
        total = lambda df: F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))
        nq, ng = total(queries), total(gallery)
        few = lambda n, want: F.least(F.ceil(n / MIN_LANE_ROWS), F.ceil(want))
        a = F.greatest(F.ceil(nq / q_rows), few(nq, F.sqrt(n_parts * nq / ng))).cast("int")
        b = F.greatest(F.ceil(ng / rows), few(ng, n_parts / a)).cast("int")
        q, g = queries, gallery
    seq = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    lane = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    q = q.withColumn("__ql", lane(q_id, a)).withColumn("__gl", seq(b))
    g = g.withColumn("__gl", lane(g_id, b)).withColumn("__ql", seq(a))
    cell = [*keys, "__ql", "__gl"]
    q = q.drop("__a", "__b").repartition(n_parts, *cell)
    g = g.drop("__a", "__b", "__nq").repartition(n_parts, *cell)
    g = g.toDF(*g.columns)  # own attribute ids, so a table can meet itself

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return q.groupBy(*cell).cogroup(g.groupBy(*cell)).applyInArrow(run, schema)


def _field(df: DataFrame, name: str, alias: str) -> T.StructField:
    return T.StructField(alias, df.schema[name].dataType, True)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def topk(
    queries: DataFrame,
    gallery: DataFrame,
    k: int,
    dim: int,
    keys: Sequence[str] = (),
    id_col: str = "id",
    vec: str = "unit",
    metric: str = "cosine",
    carry: Sequence[str] = (),
    exclude_self: bool = True,
    lane_rows: int | None = None,
) -> DataFrame:
    """k best gallery rows per query: ``keys, q_id, g_id, sim, rank`` plus ``q_x, g_x`` per carried x.

    Ties go to the smaller gallery id. Each cell returns at most k rows per query; the merge
    ranks (number of gallery lanes × k) rows per query.
    """
    cols = [*keys, id_col, *carry]
    q = queries.select(*cols, F.col(vec).cast("array<double>").alias("vec"))
    g = q if queries is gallery else gallery.select(*cols, F.col(vec).cast("array<double>").alias("vec"))
    schema = T.StructType(
        [_field(queries, c, c) for c in keys]
        + [_field(queries, id_col, "q_id"), _field(gallery, id_col, "g_id"), T.StructField("sim", T.DoubleType())]
        + [_field(queries, c, f"q_{c}") for c in carry]
        + [_field(gallery, c, f"g_{c}") for c in carry]
    )
    out_schema = _arrow_schema(schema)
    key_names, carried = list(keys), list(carry)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out_schema.empty_table()
        qm, gm = matrix(left), matrix(right)
        qid, gid = values(left, id_col), values(right, id_col)
        order = np.argsort(gid, kind="stable")
        tie = np.empty(len(gid), dtype=np.int64)
        tie[order] = np.arange(len(gid))
        pos = np.minimum(np.searchsorted(gid[order], qid), len(gid) - 1)
        self_col = np.where(gid[order][pos] == qid, order[pos], -1) if exclude_self else np.full(len(qid), -1)
        r, c, sims = nearest(qm, gm, k, metric, tie, self_col)
        r, c = pa.array(r), pa.array(c)
        # only what is returned: a vector per neighbour would be k times the lane
        ql, gl = left.select([*key_names, id_col, *carried]).take(r), right.select([id_col, *carried]).take(c)
        arrays = [ql.column(x) for x in key_names] + [ql.column(id_col), gl.column(id_col), pa.array(sims)]
        arrays += [ql.column(x) for x in carried] + [gl.column(x) for x in carried]
        return pa.Table.from_arrays(arrays, names=out_schema.names).cast(out_schema)

    cells = grid(q, g, keys, id_col, id_col, dim, best, schema, lane_rows)
    w = Window.partitionBy(*keys, "q_id").orderBy(F.col("sim").desc(), "g_id")
    return cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
