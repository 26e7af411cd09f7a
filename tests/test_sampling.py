import pytest
from pyspark.sql import functions as F

from wellgrid.operators import sampling as S
from wellgrid.operators import shardplan
from wellgrid.plans.ranking import bucketed_rank, dense_ids, hash_bucket, top_n


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"src__bat__plate{p}__A{w:02d}__1", f"A{w:02d}", i) for p in (1, 2) for w in (1, 2) for i in range(20)]
    return spark.createDataFrame(rows, "fov_id string, well string, id_local int").withColumn("key", F.concat_ws("|", "fov_id", "id_local"))


def ids_of(df, col="key"):
    return sorted(r[0] for r in df.select(col).collect())


def test_cap_per_well(cells):
    out = S.per_group(cells, ["fov_id"], 5, ["key"])
    assert {r["count"] for r in out.groupBy("fov_id").count().collect()} == {5}
    assert S.per_group(cells, ["fov_id"], 50, ["key"]).count() == 80
    assert out.columns == cells.columns
    assert ids_of(out) == ids_of(S.per_group(cells.repartition(7), ["fov_id"], 5, ["key"]))
    assert ids_of(out) != ids_of(S.per_group(cells, ["fov_id"], 5, ["key"], seed=7))
    assert S.per_group(cells.limit(0), ["fov_id"], 5, ["key"]).count() == 0
    with pytest.raises(ValueError):
        S.per_group(cells, ["fov_id"], 0, ["key"])


def test_bypass_rules(spark):
    rows = [(f"{s}-{k}-{i}", s, k) for s in ("s1", "s2") for k in ("K1", "K2", "EMPTY") for i in range(50)]
    rows += [(f"n{i}", "s1", None) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, source string, pert string")
    out = S.per_perturbation_source(df, "pert", "source", 5, ["key"])
    assert out.where("pert is null").count() == 100 and out.where("pert is not null").count() == 30
    out = S.per_perturbation_source(df, "pert", "source", 5, ["key"], control_labels=["EMPTY"])
    assert out.where("pert = 'EMPTY'").count() == 100 and out.where("pert like 'K%'").count() == 20


@pytest.mark.parametrize("n", [10, 2000])
def test_total(spark, n):
    df = spark.range(60 if n == 10 else 5000).select(F.col("id").cast("string").alias("key"))
    out = S.in_total(df, n, ["key"])
    assert out.count() == n and out.columns == ["key"]
    assert S.in_total(df, 10_000, ["key"]).count() == df.count()
    want = [r.key for r in df.orderBy(F.md5(F.concat_ws("|", F.lit("42"), "key")), "key").limit(n).collect()]
    assert ids_of(out) == sorted(want)


def test_fraction_rounds_half_to_even(spark):
    df = spark.createDataFrame([(g, f"{g}{i}") for g, n in (("a", 25), ("b", 35), ("c", 1)) for i in range(n)], "g string, key string")
    got = {r.g: r["count"] for r in S.stratified_fraction(df, ["g"], 0.1, ["key"]).groupBy("g").count().collect()}
    assert got == {"a": 2, "b": 4, "c": 1}


def test_bucketed_rank_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x")).withColumn("h", F.md5(F.col("x").cast("string")))
    got = bucketed_rank(df, ["g"], ["h"], hash_bucket("h"), "r", "n").selectExpr("g", "x", "cast(r as int) r", "n")
    want = df.selectExpr("g", "x", "row_number() over (partition by g order by h) r", "count(*) over (partition by g) n")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_top_n_beyond_group_limit(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    got = top_n(df, ["g"], [F.col("x").desc()], 3000)
    assert got.count() == 6000 and got.agg(F.min("x")).first()[0] == 14_000


def test_buckets_restart_per_source(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)], "source string, i int")
    got = {(r.source, r.i): r.b for r in S.assign_buckets(df, "source", ["i"], 2, out="b").collect()}
    assert got[("a", 0)] == got[("a", 1)] == "a_snakemake_batch_0" and got[("a", 4)] == "a_snakemake_batch_2" and got[("b", 2)] == "b_snakemake_batch_1"
    with pytest.raises(ValueError):
        S.assign_buckets(df, "source", ["i"], 0)


def test_batch_diverse_is_round_robin(spark):
    rows = [(f"{b}{i}", "k", b) for b, n in (("b1", 10), ("b2", 1), ("b3", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, k string, b string")
    three = S.batch_diverse(df, ["k"], "b", 3, ["id"])
    assert {r.b for r in three.collect()} == {"b1", "b2", "b3"}
    five = {r.b: r["count"] for r in S.batch_diverse(df, ["k"], "b", 5, ["id"]).groupBy("b").count().collect()}
    assert five == {"b1": 2, "b2": 1, "b3": 2}


def test_group_split(spark):
    df = spark.createDataFrame([(f"g{i % 10}", f"r{i}", i == 3) for i in range(200)], "g string, r string, pin boolean")
    out = S.group_split(df, "g", 0.2, 0.1, pinned=F.col("pin"))
    free = out.where("not pin").groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r.n == 1 for r in free)
    assert sorted(r.s for r in free) == ["test"] * 2 + ["train"] * 7 + ["val"]
    assert out.where("pin").first().split == "train"


def test_role_priority_keeps_controls_above_limit(spark):
    rows = [("p", f"w{i}", "dmso" if i < 4 else "poscon" if i < 7 else "treatment") for i in range(40)]
    df = spark.createDataFrame(rows, "plate string, well string, kind string")
    assert S.role_priority(df, ["plate"], F.col("kind"), 20, ["well"]).count() == 20
    few = S.role_priority(df, ["plate"], F.col("kind"), 5, ["well"])
    assert few.count() == 7 and few.where("role = 'treatment'").count() == 0


def test_dense_ids_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "k string")
    assert {r.k: r.class_id for r in dense_ids(df, "k").collect()} == {"a": 0, "b": 1, "c": 2}
    nums = spark.createDataFrame([(10,), (9,), (100_000,)], "k bigint")
    assert {r.k: r.class_id for r in dense_ids(nums, "k").collect()} == {9: 0, 10: 1, 100_000: 2}


def test_equal_class_plan(spark):
    df = spark.createDataFrame([("a" if i else "b", i) for i in range(50)], "lab string, id int")
    out = shardplan.equal_per_class(df, "lab", ["id"], 8)
    per = out.groupBy("batch", "lab").count().collect()
    assert out.count() == 56 and all(r["count"] == 4 for r in per)
    with pytest.raises(ValueError):
        shardplan.equal_per_class(df, "lab", ["id"], 1)


@pytest.mark.parametrize("mode", ["cycle", "iid"])
def test_balanced_plan(spark, mode):
    df = spark.createDataFrame([(i % 4, i // 4 % 3, i) for i in range(120)], "p int, s int, id int").withColumn("p", F.col("p").cast("string"))
    out = shardplan.perturbation_balanced(df, "p", ["id"], 9, 2, strata="s", mode=mode)
    per = out.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("p").alias("k"), F.countDistinct("p", "s").alias("ps"), F.countDistinct("id").alias("ids")).collect()
    assert len(per) == 14 and all(r.n == 9 and r.k == 2 and r.ps == 6 and r.ids == 9 for r in per)
    if mode == "cycle":  # two batches visit all four perturbations once
        first = out.where("batch < 2").select("p").distinct().count()
        assert first == 4
    pinned = shardplan.perturbation_balanced(df, "p", ["id"], 8, 2, pinned=["3"], mode=mode)
    with_pin = pinned.where("p = '3'").select("batch").distinct().count()
    assert with_pin == pinned.select("batch").distinct().count() == 15
    single = shardplan.perturbation_balanced(df.where("s = 0"), "p", ["id"], 4, 2, strata="s", mode=mode)
    assert single.count() == 40
    for bad in ({"batch_size": 1, "perturbations_per_batch": 2}, {"batch_size": 10, "perturbations_per_batch": 9}, {"batch_size": 4, "perturbations_per_batch": 1, "pinned": ["3"]}):
        with pytest.raises(ValueError):
            shardplan.perturbation_balanced(df, "p", ["id"], **bad)


def _collect(df):
    return sorted(map(tuple, df.collect()))


def test_rows_of_a_slot_do_not_travel_together(spark):
    """Two slots of one perturbation share about as many rows as chance says."""
    df = spark.createDataFrame([("a", i) for i in range(200)], "p string, id int")
    out = shardplan.perturbation_balanced(df, "p", ["id"], 20, 1)
    by = {}
    for r in out.collect():
        by.setdefault(r.batch, set()).add(r.id)
    assert len(by) == 10 and all(len(x) == 20 for x in by.values())
    shared = [len(by[a] & by[b]) for a in by for b in by if a < b]
    assert 1.2 < sum(shared) / len(shared) < 2.8  # 20 * 20 / 200 = 2
    assert len({i for x in by.values() for i in x}) > 100


def test_samples_per_perturbation_and_what_lacks(spark):
    df = spark.createDataFrame([(str(i % 5), i) for i in range(100)], "p string, id int")
    out = shardplan.perturbation_balanced(df, "p", ["id"], 10, 3, samples_per_perturbation=2)
    sizes = [tuple(sorted(r["list"])) for r in out.groupBy("batch", "slot").count().groupBy("batch").agg(F.collect_list("count").alias("list")).collect()]
    assert sizes == [(3, 3, 3)] * 10  # of four lacking only one goes to each slot
    for bad in ({"samples_per_perturbation": 4}, {"samples_per_perturbation": 0}):
        with pytest.raises(ValueError):
            shardplan.perturbation_balanced(df, "p", ["id"], 10, 3, **bad)


def test_replacement(spark):
    df = spark.createDataFrame([(str(i % 2), i) for i in range(8)] + [(None, 99)], "p string, id int")
    with pytest.raises(ValueError):
        shardplan.perturbation_balanced(df, "p", ["id"], 40, 10, mode="iid")
    args = dict(batch_size=40, perturbations_per_batch=10, mode="iid", pinned=["1", "absent"], perturbations_with_replacement=True, rows_with_replacement=True)
    out = shardplan.perturbation_balanced(df, "p", ["id"], **args)
    assert out.count() == 40 and out.where("slot = 0").select("p").distinct().collect()[0].p == "1"
    assert _collect(out) == _collect(shardplan.perturbation_balanced(df.repartition(7), "p", ["id"], **args))
    short = shardplan.perturbation_balanced(df, "p", ["id"], 12, 2)  # six of four rows: with repeats
    assert short.count() == 12 and short.select("id").distinct().count() <= 8


def test_distinct_draws_are_even(spark):
    from wellgrid.plans.draws import distinct_below, whole

    df = spark.range(4000).select(distinct_below(F.lit(3), F.lit(7), lambda i: whole(1, F.col("id"), i)).alias("x"))
    got = [tuple(r.x) for r in df.collect()]
    assert all(len(set(x)) == 3 and 0 <= min(x) and max(x) < 7 for x in got)
    sets = {frozenset(x) for x in got}
    assert len(sets) == 35
    per = [sum(frozenset(x) == s for x in got) for s in sets]
    assert 60 < min(per) and max(per) < 180  # 114 each
    assert df.sparkSession.range(1).select(distinct_below(F.lit(0), F.lit(5), lambda i: i).alias("x")).first().x == []
