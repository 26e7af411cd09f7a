"""Connected components over a table of edges, by stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialise
from ..plans.joins import salted_join


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, ``u`` itself included; combined on the map side."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    end = lambda c, up, down: edges.select(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    ends = end("u", 1, 0).unionByName(end("v", 0, 1)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.bool_or(F.col("up") + F.col("down") > 1)).first()[0]


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); ``root`` is the smallest node reachable.

    Alternates two steps until the edges are stars, which is asked before each round, so that none is made for nothing:
    every node hands its larger neighbours to its smallest one, then its smaller ones likewise. The number of rounds grows
    with the logarithm of the longest path. Each round is written as a table: a checkpoint keeps the size estimate of its
    plan, a product for each join, and over rounds the number itself fills the driver. What the driver keeps of tasks and
    plans grows with the shuffles of a round, so it has few. A hub's edges are joined salted. Self loops and repeated
    edges do no harm; edges with a null end are left out.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = materialise(e)
    for _ in range(rounds):
        if _settled(e):
            break
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = salted_join(up, _smallest(e.unionByName(up)), ["u"], spread_by=["v"])
        e = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = salted_join(e, _smallest(e), ["u"], spread_by=["v"])
        both = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        e = materialise(low.select(F.inline(both)).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
