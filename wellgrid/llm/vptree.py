"""Nearest neighbours with one vantage-point tree per shard.

Largest inner products are smallest Euclidean distances once every vector ``x`` gets one more
coordinate ``sqrt(R^2 - |x|^2)``, ``R`` the longest norm, and every query a zero: then
``d^2 = |q|^2 + R^2 - 2 q.x``, a metric. Each shard's tree halves its points by their distance to a
vantage point. A query skips a half if the triangle inequality, relaxed by ``factor``, says that
nothing there beats its worst hit: ``factor * worst < gap`` would be exact at factor 1; a smaller
factor skips more. Answers are the exact inner products in double precision.

Shards hold a bounded number of vectors and queries come in blocks of bounded size; a task searches
one shard for one block. Each task returns its best ``k`` of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from ..plans.ranking import top_n
from .registry import query, table

K = 20
EVERY = 20
FACTOR = 0.5
NEAR = 1e-9  # what rounding may take from a squared distance, relative to the longest norm squared
LEAF = 512
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
SEED = 11


class Tree:
    """A vantage-point tree over the rows of ``x``, as arrays of nodes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.x, self.order = x, np.arange(len(x))
        self.nodes: list[tuple] = []  # (vantage row or -1, radius bounds of the halves, children or slice)
        if len(x):
            self.root = self._grow(0, len(x), leaf, rng)

    def _grow(self, a: int, b: int, leaf: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if b - a <= leaf:
            self.nodes[at] = (-1, a, b)
            return at
        rows = self.order[a:b]
        # of a few candidates the vantage point whose distances spread most
        sample = self.x[rng.choice(rows, min(len(rows), 128), replace=False)]
        tries = rng.choice(rows, min(len(rows), 8), replace=False)
        v = max(tries.tolist(), key=lambda i: np.linalg.norm(sample - self.x[i], axis=1).var())
        d = np.linalg.norm(self.x[rows] - self.x[v], axis=1)
        half = len(rows) // 2
        by = np.argsort(d, kind="stable")
        self.order[a:b], d = rows[by], d[by]
        near = self._grow(a, a + half, leaf, rng)
        far = self._grow(a + half, b, leaf, rng)
        self.nodes[at] = (v, near, d[0], d[half - 1], far, d[half], d[-1])
        return at

    def search(self, q: np.ndarray, k: int, factor: float, score, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best found for each query, best first; -1 for none.

        ``score(i, j)`` is the exact nearness of query i and row j. Distances only choose what is scored: all
        that is not surely farther than a query's worst hit. Equal scores go by ``first``, the rows' smallest keys.
        """
        self.best = np.full((len(q), k), -np.inf)
        self.rows = np.full((len(q), k), -1)
        if len(self.x) and len(q):
            squared = (self.x * self.x).sum(axis=1)
            self.slack = NEAR * max(float(squared.max()), float((q * q).sum(axis=1).max()), 1e-300)
            self.offset = (q * q).sum(axis=1) + squared.max()  # all rows have the same norm
            self._visit(self.root, np.arange(len(q)), q, (q * q).sum(axis=1), squared, factor, score, first)
        return self.rows, self.best

    def _worst(self, who: np.ndarray) -> np.ndarray:
        """Squared distance up to which a row may still be a hit, rounding allowed for."""
        return np.maximum(self.offset[who] - 2 * self.best[who, -1], 0) + self.slack

    def _visit(self, node, who, q, qq, squared, factor, score, first) -> None:
        """``who``: the queries that come here, all at once."""
        n = self.nodes[node]
        if n[0] < 0:
            at = self.order[n[1]:n[2]]
            d = np.maximum(qq[who, None] + squared[at][None, :] - 2 * q[who] @ self.x[at].T, 0)
            i, j = np.nonzero(d <= self._worst(who)[:, None])
            if not len(i):
                return
            s = score(who[i], at[j])
            k = self.best.shape[1]
            some = np.unique(i)
            # what may beat a query's worst hit, after its hits so far
            row = np.r_[np.repeat(np.arange(len(some)), k), np.searchsorted(some, i)]
            s = np.r_[self.best[who[some]].ravel(), s]
            r = np.r_[self.rows[who[some]].ravel(), at[j]]
            key = np.where(r < 0, np.iinfo(np.int64).max, first[r])
            order = np.lexsort((key, -s, row))
            begin = np.searchsorted(row[order], np.arange(len(some)))
            pick = order[(begin[:, None] + np.arange(k)).ravel()]
            self.best[who[some]] = s[pick].reshape(-1, k)
            self.rows[who[some]] = r[pick].reshape(-1, k)
            return
        v, near, n0, n1, far, f0, f1 = n
        d = np.sqrt(np.maximum(qq[who] + squared[v] - 2 * q[who] @ self.x[v], 0))
        first_near = d <= (n1 + f0) / 2
        for nearer in (True, False):
            for child, lo, hi, mine in ((near, n0, n1, first_near == nearer), (far, f0, f1, first_near != nearer)):
                group, dist = who[mine], d[mine]
                gap = np.maximum(np.maximum(dist - hi, lo - dist), 0)  # what the triangle inequality leaves
                go = group[gap <= factor * np.sqrt(self._worst(group)) + np.sqrt(self.slack)]
                if len(go):
                    self._visit(child, go, q, qq, squared, factor, score, first)


def usable(vector: str) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)


def _search(k: int, factor: float, norm: float):
    def run(key, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})]
        for dim, part in points.groupby(points["vec"].map(len)):  # vectors of another length don't meet
            ask = queries[queries["vec"].map(len) == dim]
            if not len(ask):
                continue
            x, q = np.stack(part["vec"].to_numpy()).astype(float), np.stack(ask["vec"].to_numpy()).astype(float)
            lift = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
            ids = part["ids"].to_numpy()
            first = np.fromiter((min(i) for i in ids), np.int64, len(ids))
            score = lambda i, j: np.einsum("ij,ij->i", q[i], x[j])  # noqa: B023,E731
            tree = Tree(np.column_stack([x, lift]))
            # one more than k, as one may be the query itself
            rows, best = tree.search(np.column_stack([q, np.zeros(len(q))]), k + 1, factor, score, first)
            i, j = np.nonzero(rows >= 0)
            at, score = rows[i, j], best[i, j]
            n = np.fromiter(map(len, ids), int)[at]
            out = pd.DataFrame({"query_id": np.repeat(ask["id"].to_numpy()[i], n), "vec_id": np.concatenate([*ids[at], np.zeros(0, np.int64)]).astype(np.int64), "score": np.repeat(score, n)})
            out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            found.append(out.groupby("query_id").head(k))
        return pd.concat(found[1:] or found)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` holds.

    Null keys, and vectors that are null, zero or hold a null or non-finite component take no
    part. Repeated rows (key and vector) count once; a query never finds a row of its own key.
    Vectors of different lengths don't meet. Equal scores go to the smaller key, of equal vectors (one point
    of a tree with their ``k + 1`` smallest keys, as no others can be an answer) and of different ones. With
    ``factor`` 1 the answer is exact; with less, what is found is scored exactly and ranked like that.
    An empty table gives an empty result.
    """
    vec = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # no negative zero
    v = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("bigint").alias("id"), vec.alias("vec"), is_query.alias("ask"))
    v = checkpoint(v.dropDuplicates(["id", "vec"]))
    n, norm, asked = v.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))), F.count_if("ask")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // query_rows))
    upto = lambda m: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")))
    points = top_n(v.select("id", "vec"), ["vec"], ["id"], k + 1).groupBy("vec").agg(F.collect_list("id").alias("ids"))
    points = points.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards))).withColumn("block", upto(blocks))
    queries = v.where("ask").select("id", "vec", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block")).withColumn("shard", upto(shards))
    near = queries.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInPandas(_search(k, factor, norm or 0.0), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query()
def op8_vptree(spark, d):
    """Twenty nearest found of every twentieth vector, among all."""
    return search(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
