"""Physical plans: no pairwise joins, trimmed group ranks, narrow scans."""

import re

import numpy as np
import pytest

from tests.oracle import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from wellgrid import catalog
from wellgrid.plans.ranking import pieces, ranged_rank

catalog.load_all()


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "recall_across", "average_precision", "tanimoto_topk", "silhouette_label", "kbet_per_label", "whitelist_select", "range_overlap",
    "selected_cells", "classical_profiles", "embedding_profiles", "metric_summary", "scaled_count", "shard_plan_balanced",
])
def test_no_pairwise_join(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["sample_per_well", "cap_per_group", "batch_diverse_pick", "first_row_per_key"])
def test_caps_trim_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "oversample_factor")
    line = next(x for x in text.splitlines() if "lineitem.parquet" in x)
    assert "l_extendedprice" not in line and "l_shipdate" not in line


def test_no_group_is_gathered_for_quantiles(spark):
    """A group with nearly all rows, keys that share a prefix, and one hot value lie in many even pieces."""
    df = spark.range(20_000).select(F.concat(F.lit("JCP2022_"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(1).cast("string")).alias("k"), (F.col("id") * 7 % 20_000).alias("v"))
    sizes = [r["count"] for r in pieces(df, ["k"], ["v"]).groupBy("__piece").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * 20_000
    ids = [r["count"] for r in pieces(df.select("k").distinct(), [], ["k"]).groupBy("__piece").count().collect()]
    assert len(ids) >= 6 and max(ids) < 0.3 * sum(ids)
    assert "percentile" not in plan(spark, "mad_normalise") and "median" not in plan(spark, "well_median")


def test_cells_are_shuffled_once_to_be_scaled(spark):
    """With all their fields, not as a row per feature."""
    text = plan(spark, "mad_normalise")
    assert "hashpartitioning(source" in text and not re.search(r"hashpartitioning\([^)]*feature", text)


@pytest.mark.parametrize(("name", "functions"), [("blob_crop", 4), ("featurise", 2)])
def test_blob_functions_are_called_once(spark, name, functions):
    """Each call has Python processes of its own; a filter on what a function gives must not call it again."""
    assert plan(spark, name).count("EvalPython [") == functions


def test_ranks_and_adjustment_equal_the_plain_ones(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("k"), F.hash("id").alias("v"), "id")
    got = {r.id: (r.rank, r.n) for r in ranged_rank(df, ["g", "k"], ["v", "id"], "rank", "n").collect()}
    w = Window.partitionBy("g", "k")
    want = {r.id: (r.rank, r.n) for r in df.withColumn("rank", F.row_number().over(w.orderBy("v", "id"))).withColumn("n", F.count(F.lit(1)).over(w)).collect()}
    assert got == want


@pytest.mark.parametrize("limit", [0, 3, 40, 10_000])
def test_quantiles_of_small_and_large_groups(spark, limit):
    """Arrays, dealt pieces and both together give what NumPy gives, with nulls, NaN and a hot value."""
    import numpy as np

    from wellgrid.plans.quantiles import exact_quantiles

    rng = np.random.default_rng(6)
    data = {("a", 1): rng.standard_normal(200), ("a", None): [5.0] * 90 + [7.0, -1.0], (None, 2): [3.0], ("b", 3): rng.integers(0, 3, 41).astype(float), (None, None): [1.0, 2.0]}
    rows = [(k, j, float(x)) for (k, j), xs in data.items() for x in xs] + [("a", 1, None), ("b", 3, float("nan")), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.k, r.j): list(r.q) for r in exact_quantiles(df, ["k", "j"], "v", probs, in_one_row=limit).collect()}
    assert got.keys() == data.keys()
    for key, xs in data.items():
        assert got[key] == pytest.approx(np.quantile(xs, probs), abs=1e-12)
    whole = exact_quantiles(df, [], "v", probs, in_one_row=limit).collect()
    assert len(whole) == 1 and list(whole[0].q) == pytest.approx(np.quantile(np.concatenate(list(data.values())), probs), abs=1e-12)
    assert exact_quantiles(df.where("false"), [], "v", probs, in_one_row=limit).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_well_medians_of_small_and_large_wells(spark, monkeypatch, limit):
    import numpy as np

    from wellgrid.operators import pooling

    monkeypatch.setattr(pooling, "VALUES_IN_ONE_ROW", limit)
    nan = float("nan")
    rows = [("a", [1.0, nan, 5.0]), ("a", [2.0, 4.0, None]), ("a", [9.0, 8.0, 7.0]), ("b", [3.0]), ("b", [4.0, 6.0]), ("c", None), ("c", []), ("d", [nan, 2.0]), (None, [1.0])]
    got = {r.k: list(r.vec) for r in pooling.well_median(spark.createDataFrame(rows, "k string, vec array<double>").repartition(4), ["k"], "vec").collect()}
    assert got == {"a": [2.0, 6.0, 6.0], "b": [3.5, 6.0], "d": [2.0]}
    x = np.random.default_rng(3).standard_normal((300, 4))
    df = spark.createDataFrame([(str(i % 7), v.tolist()) for i, v in enumerate(x)], "k string, vec array<double>")
    got = {r.k: list(r.vec) for r in pooling.well_median(df, ["k"], "vec").collect()}
    assert all(got[str(k)] == pytest.approx(np.median(x[k::7], axis=0), abs=1e-12) for k in range(7))


def test_salted_side_counts_its_repeats(spark):
    """A side whose repeats pass the broadcast threshold is not broadcast, though one copy of it would be."""
    from wellgrid.plans.joins import salted_join

    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    side = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    fact = spark.range(4000).select((F.col("id") % 1500).alias("k"), "id")
    try:
        spark.conf.set(conf, "40000")  # one copy is estimated at 12,000 to 24,000 bytes
        out = salted_join(fact, side, ["k"], "left")
        plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [k" not in plan
        assert out.count() == 4000 and out.where("v = 2 * k").count() == out.where("k < 1000").count()
    finally:
        spark.conf.set(conf, before)
    for salts in (1, 3, 16):
        assert salted_join(fact, side, ["k"], salts=salts).count() == fact.where("k < 1000").count()


def test_neighbours_do_not_copy_vectors(spark, monkeypatch):
    """What a cell holds for its neighbours is a small part of one vector for each of them."""
    import numpy as np
    import pyarrow as pa

    from wellgrid.plans import blocks

    cell = []
    monkeypatch.setattr(blocks, "grid", lambda q, g, keys, q_id, g_id, dim, fn, *rest: cell.append(fn) or spark.createDataFrame([], "q_id long, g_id long, sim double, q_lab string, g_lab string"))
    rows, dim, k = 1000, 64, 200
    df = spark.createDataFrame([], "id long, unit array<double>, lab string")
    blocks.topk(df, df, k, dim, carry=["lab"])
    vec = pa.FixedSizeListArray.from_arrays(pa.array(np.random.default_rng(1).random(rows * dim)), dim).cast(pa.list_(pa.float64()))
    lane = pa.table({"id": pa.array(range(rows)), "lab": pa.array(["a"] * rows), "vec": vec})
    plain = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(plain)
    pa.set_memory_pool(pool)
    try:
        found = cell[0](lane, lane).num_rows  # the table goes before its pool does
    finally:
        pa.set_memory_pool(plain)
    assert found == rows * k
    assert pool.max_memory() < rows * k * dim * 8 / 3


def test_means_of_short_vectors_shuffle_numbers(spark):
    """No summarizer state per cell; the same means, and another length fails."""
    from wellgrid.operators import pooling

    rows = [(f"w{i % 7}", i, [float(i), i / 3, -1.0 * i], None if i % 5 else f"m{i}") for i in range(200)] + [("none", 300, None, "m")]
    df = spark.createDataFrame(rows, "well string, row_key long, vec array<double>, meta string")
    mean = lambda **kw: pooling.well_mean(df, ["well"], "vec", ["meta"], order=["row_key"], **kw)
    want = {r.well: r for r in mean().where("well <> 'none'").collect()}
    got = {r.well: r for r in mean(dim=3).collect()}
    assert got.pop("none").vec is None
    assert {w: (r.n_cells, r.meta, r.vec) for w, r in got.items()} == {w: (r.n_cells, r.meta, pytest.approx(r.vec)) for w, r in want.items()}
    assert "ObjectHashAggregate" not in mean(dim=3)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan(spark, "well_mean")
    with pytest.raises(Exception, match="vector without 2 elements"):
        mean(dim=2).collect()


def test_feature_rows_go_to_the_long_table(spark):
    """The long table is not shuffled for a join with one row per feature."""
    from wellgrid.operators import quality

    long = spark.range(3000).select("id", (F.col("id") % 3).cast("int").alias("feature"), F.when(F.col("id") % 10 > 0, F.col("id") * 1.0).alias("value"))
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "-1")  # as for a side whose size Spark does not know
        text = quality.kept_features(long, max_missing=0.5)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        assert quality.impute_median(long).where("value is not null").count() == 3000
    finally:
        spark.conf.set(conf, before)


def test_rows_without_a_match_are_told(spark):
    from wellgrid.plans.joins import may_match

    rows = spark.range(20_000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    side = rows.where("b % 10 = 0")
    got = may_match(rows, side, ["a", "b"])
    assert got.count() == 20_000 and got.where("b % 10 = 0 and not __may").isEmpty() and got.where("__may").count() <= 2020
    assert may_match(rows, side.limit(0), ["a", "b"]).where("__may").isEmpty()


@pytest.mark.parametrize("limit", [10_000, 1])
def test_medians_equal_sql_to_the_last_bit(spark, limit):
    import duckdb

    from wellgrid.plans.quantiles import exact_quantiles

    pairs = [(a * 11 + b, x / 100) for a in range(11) for b in range(11) for x in (a, b)]
    got = exact_quantiles(spark.createDataFrame(pairs, "k int, v double"), ["k"], "v", [0.5], in_one_row=limit)
    want = duckdb.connect().execute("SELECT k, median(x / 100.0) FROM (SELECT a * 11 + b AS k, unnest([a, b])::DOUBLE AS x FROM range(11) s(a), range(11) t(b)) GROUP BY k").fetchall()
    assert {r.k: r.q[0] for r in got.collect()} == dict(want)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("n,m,k,copies", [(300, 9000, 90, 1), (300, 6000, 15, 60), (40, 10, 15, 1), (5, 1, 1, 1), (7, 3000, 2900, 2)])
def test_nearest_is_that_of_sorting_all_pairs(metric, n, m, k, copies, monkeypatch):
    """Equal vectors tie to the last bit and go by ``tie``, wherever the tiles fall."""
    from wellgrid.plans import blocks

    rng = np.random.default_rng(m + k)
    g = rng.normal(size=(m, 6))[rng.integers(0, max(1, m // copies), m)]
    g = g / np.linalg.norm(g, axis=1, keepdims=True) if metric == "cosine" else g + 3.0
    at, tie = rng.integers(0, m, n), rng.permutation(m)
    own = np.where(rng.random(n) < 0.7, at, -1)
    want = []
    for i, (x, o) in enumerate(zip(g[at], own)):
        sim = np.round(-np.sqrt(np.square(x - g).sum(1)), 10) if metric == "euclidean" else np.round((x * g).sum(1), 12)
        want += [(i, int(j), sim[j]) for j in [j for j in np.lexsort((tie, -sim)) if j != o][:k]]
    for cells in (blocks.TILE_CELLS, 1000):
        monkeypatch.setattr(blocks, "TILE_CELLS", cells)
        assert list(zip(*(a.tolist() for a in blocks.nearest(g[at], g, k, metric, tie, own)))) == want


def test_equal_vectors_have_distance_zero(spark):
    """Copies of a vector far from the origin are nearest by id, not by the rounding of a matrix product."""
    from wellgrid.plans.blocks import topk

    rng = np.random.default_rng(3)
    vecs = (rng.normal(size=(30, 16)) * 100).tolist()
    df = spark.createDataFrame([(i, vecs[i % 30]) for i in range(300)], "id long, vec array<double>")
    got = topk(df, df, 9, 16, vec="vec", metric="euclidean").collect()
    assert len(got) == 2700 and all(r.sim == 0.0 and r.g_id % 30 == r.q_id % 30 for r in got)
    for q in (0, 299):
        assert [r.g_id for r in sorted(got, key=lambda r: r.rank) if r.q_id == q] == [i for i in range(q % 30, 300, 30) if i != q]


def test_null_draws_are_dealt_out_and_made_once(spark):
    """A shape of list is much work, so shapes lie in many tasks, and the result does not draw again."""
    from wellgrid.operators import replicate

    ap = spark.createDataFrame([(f"p{i % 7}", 2 + i, 5 + i, 0.5) for i in range(40)], "pert string, n_pos long, n_neg long, ap double")
    nulls = replicate.null_distributions(ap, 20)
    assert nulls.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert nulls.count() == 40
    out = replicate.significance(ap, "pert", null_size=20)
    assert "MapInPandas" not in out._jdf.queryExecution().toString() and out.count() == 7
