import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellgrid.functions.vectors import finite_or_null_array, l2_normalize
from wellgrid.operators import correct, integration, pooling, probe, quality, replicate, retrieval
from wellgrid.plans.linalg import correlation, covariance
from wellgrid.plans.quantiles import exact_quantiles

RNG = np.random.default_rng(3)


def vectors(spark, x, **cols):
    pdf = pd.DataFrame({"id": range(len(x)), "vec": [list(map(float, r)) for r in x], **cols})
    return spark.createDataFrame(pdf)


def matrix(df, col):
    return np.array([r[0] for r in df.orderBy("id").select(col).collect()])


# -- quantiles, quality ------------------------------------------------------------------


def test_quantiles_linear_and_null_rules(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("a"), F.lit(None).cast("double").alias("empty"))
    df = df.unionByName(spark.createDataFrame([(float("nan"), None), (None, None)], "a double, empty double"))
    got = {r.feature: (r.lo, r.hi) for r in quality.quantile_bounds(df, ["a", "empty", "absent"], 0.1, 0.9).collect()}
    assert list(got) == ["a"] and got["a"] == pytest.approx((9.9, 89.1), abs=1e-9)


def test_quantiles_equal_numpy_on_skew_and_null_keys(spark):
    x = np.concatenate([np.repeat(5.0, 700), RNG.standard_normal(800) ** 3, [1e9]])
    df = spark.createDataFrame([("hot", float(v)) for v in x] + [("one", 2.0)] + [(None, float(v)) for v in x[:21]], "g string, x double")
    probs = [0.0, 0.001, 0.25, 0.5, 0.975, 1.0]
    got = {r.g: list(r.q) for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(x, probs))) and got["one"] == [2.0] * 6
    assert got[None] == pytest.approx(list(np.quantile(x[:21], probs)))


def test_quality_filter_conjunction(spark):
    one = spark.createDataFrame([(v,) for v in (1.0, 5.0, 10.0, 50.0, 100.0, None, float("nan"))], "x double")
    assert quality.within_bounds(one, {"x": (5, 50), "absent": (0, 1)}).count() == 3
    two = spark.createDataFrame([(1.0, 10.0), (5.0, 5.0), (10.0, 1.0)], "a double, b double")
    assert quality.within_bounds(two, {"a": (2, 8), "b": (2, 8)}).count() == 1
    assert quality.quality_filter(two, ["a"], 0.1, 0.9, enabled=False).count() == 3
    counts = quality.filter_counters(one, F.col("x") > 5).first()
    assert (counts.n_before, counts.n_after, counts.n_dropped) == (7, 4, 3)


@pytest.mark.parametrize("limit", [0, 25, 10_000])
def test_wide_fields_scale_as_long_ones(spark, monkeypatch, limit):
    """Plates in arrays, long ones and both together give what ``robust_scale`` gives, with null plates, gaps and few controls."""
    i = F.col("id")
    value = lambda k: F.when(i % 7 == k, None).when(i % 11 == k, float("nan")).otherwise(F.pmod(F.hash("id", F.lit(k)), F.lit(50)) / 3)
    df = spark.range(90).select("id", F.when(i < 50, "a").when(i < 70, "b").alias("plate"), F.when(i % 4 > 0, i % 4 == 1).alias("ctrl"), value(2).alias("x"), value(3).alias("y"), F.lit(1.5).alias("z"))
    plain = quality.robust_scale(quality.tidy(df, ["plate", "id", "ctrl"], ["x", "y", "z"]), ["plate"], ["id"], F.col("ctrl")).drop("ctrl")
    monkeypatch.setattr(quality, "large_groups", lambda rows, keys, of=quality.large_groups: of(rows, keys, limit))
    got = quality.robust_scale_fields(df, ["plate"], ["id"], ["x", "y", "z"], F.col("ctrl"))
    order = lambda d: sorted(map(str, d.select("plate", "id", "feature", "value", "scaled").collect()))
    assert order(got) == order(plain)


def test_robust_scale(spark):
    rows = [("p4", f"a{i}", i < 4, float(i)) for i in range(10)] + [("p5", f"b{i}", i < 5, float(i * i)) for i in range(10)] + [("p0", f"c{i}", False, 7.0) for i in range(3)]
    df = spark.createDataFrame(rows, "plate string, id string, ctrl boolean, value double").withColumn("feature", F.lit("f"))
    got = {r.id: r.scaled for r in quality.robust_scale(df, ["plate"], ["id"], F.col("ctrl")).collect()}

    def expect(x, ref):
        med = np.median(ref)
        mad = np.median(np.abs(ref - med))
        return np.clip((x - med) / (mad * 1.4826 if mad > 0 else 1.0), -4, 4)

    a, b = np.arange(10.0), np.arange(10.0) ** 2
    assert [got[f"a{i}"] for i in range(10)] == pytest.approx(list(expect(a, a)))
    assert [got[f"b{i}"] for i in range(10)] == pytest.approx(list(expect(b, b[:5])))
    assert got["c0"] == 0.0


def test_missing_values_stay_missing(spark):
    """A gap is no extreme value, and a null plate is scaled like any other."""
    rows = [(p, f"{p}{i}", "f", False, v) for p in ("p", None) for i, v in enumerate([1.0, 2.0, 4.0, None, float("nan"), 50.0])]
    df = spark.createDataFrame(rows, "plate string, id string, feature string, ctrl boolean, value double")
    got = {r.id: r.scaled for r in quality.robust_scale(df, ["plate"], ["id"], F.col("ctrl")).collect()}
    assert got["p3"] is None and got["p4"] is None and got["p5"] == 4.0
    assert [got[f"p{i}"] for i in range(6)] == [got[f"None{i}"] for i in range(6)]
    n = spark.createDataFrame([(1,), (None,), (3,)], "n int")
    assert [r.n_cells_scaled for r in quality.scaled_count(n, "n").orderBy("n").collect()] == [None, 0.0, 255.0]


def test_scaled_count_bounds(spark):
    df = spark.createDataFrame([(1,), (3,), (5,)], "n int")
    assert sorted(r.n_cells_scaled for r in quality.scaled_count(df, "n").collect()) == [0.0, 127.5, 255.0]
    assert [r.n_cells_scaled for r in quality.scaled_count(df.limit(1), "n").collect()] == [0.0]


def test_nonfinite_vectors(spark):
    df = spark.createDataFrame([([1.0, float("inf"), float("nan")],)], "v array<double>")
    assert df.select(finite_or_null_array("v").alias("v")).first().v == [1.0, None, None]


# -- pooling -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for p in ("p1", "p2"):
        for w in ("A01", "A02", "A03"):
            for c in range(4):
                name = None if c == 0 else ("EMPTY" if w == "A03" else f"DRUG_{w}_{c}")
                rows.append((p, w, f"{p}__{w}__cell{c:02d}", c, name, [float(v) for v in RNG.standard_normal(8)]))
    return spark.createDataFrame(rows, "plate string, well string, row_key string, id_local int, inchikey string, vec array<float>")


def test_well_mean_ignores_row_order(cells):
    out = [pooling.well_mean(c, ["plate", "well"], "vec", ["inchikey", "row_key"]).orderBy("plate", "well").collect() for c in (cells, cells.orderBy(F.rand(1)).repartition(5))]
    for a, b in zip(*out):
        assert (a.n_cells, a.inchikey, a.row_key) == (b.n_cells, b.inchikey, b.row_key) and np.allclose(a.vec, b.vec)
    assert out[0][0].row_key.endswith("cell00") and out[0][0].inchikey == "DRUG_A01_1"  # first non-null per column
    want = np.mean([r.vec for r in cells.where("plate = 'p1' and well = 'A01'").collect()], axis=0)
    assert np.allclose(out[0][0].vec, want)


def test_well_mean_needs_determinism_key(cells):
    with pytest.raises(ValueError, match="determin"):
        pooling.well_mean(cells.drop("row_key", "id_local"), ["plate", "well"], "vec")
    nulls = cells.withColumn("well", F.when(F.col("well") != "A01", F.col("well")))
    assert pooling.well_mean(nulls, ["plate", "well"], "vec").count() == 4


def test_well_median_skips_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("w", 1, [1.0, nan]), ("w", 2, [3.0, 4.0]), ("w", 3, [8.0, 6.0])], "well string, o int, vec array<double>")
    r = pooling.well_median(df, ["well"], "vec", ["o"], ["o"]).first()
    assert r.vec == [3.0, 5.0] and r.o == 1


def test_lookup_rules(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, v array<double>")
    ok = make([("a", [1.0, 2.0]), ("b", [3.0, 4.0])])
    for bad in ([("a", [1.0]), ("a", [2.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [float("nan")])], [(None, [1.0])]):
        with pytest.raises(ValueError, match="lookup"):
            pooling.load_lookup(make(bad), "k", "v")
    lk = pooling.load_lookup(ok, "k", "v", control="EMPTY")
    assert lk.where("key = 'EMPTY'").first().vector == [2.0, 3.0]
    df = spark.createDataFrame([("a",), ("EMPTY",), ("zz",)], "k string")
    with pytest.raises(Exception, match="without lookup vector"):
        pooling.attach_lookup(df, lk, "k").collect()
    assert pooling.attach_lookup(df, lk, "k", strict=False).where("vector is null").count() == 1


def test_reassembled_keeps_all_keys(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    out = {r.k: r for r in pooling.reassembled(keys, spark.createDataFrame([("a", [1.0])], "k string, v array<double>"), "k", "v", 1).collect()}
    assert out["a"].present and np.isnan(out["b"].v[0])


# -- retrieval ---------------------------------------------------------------------------


def test_recall_ties_and_self_exclusion(spark):
    x = [[1, 0], [1, 0], [0.9, 0.1], [0, 1], [0, 1], [0.1, 0.9]]
    df = vectors(spark, x, lab=["a", "b", "a", "b", "b", "a"])
    every = F.lit(True)
    hits = {r.q_id: r.first_hit for r in retrieval.first_hits(df, every, every, "id", "vec", "lab", F.lit(False), 2, k=3).collect()}
    # 0: nearest is its twin 1 (b), then 2 (a); 3: twin 4; 5: 3,4 tie at equal similarity, then others
    assert hits[0] == 2 and hits[3] == 1 and hits[4] == 1
    with pytest.raises(ValueError, match="gallery"):
        retrieval.assert_gallery(df, every, every, F.lit(False), 7)
    with pytest.raises(ValueError, match="query"):
        retrieval.assert_gallery(df, F.lit(False), every, F.lit(False), 2)


@pytest.mark.parametrize("lane_rows", [None, 7])
def test_topk_equals_brute_force(spark, lane_rows):
    x = RNG.standard_normal((60, 5))
    x[10] = x[11] = x[12]
    from wellgrid.plans.blocks import topk

    df = l2_normalize(vectors(spark, x), "vec")
    got = topk(df, df, 4, 5, lane_rows=lane_rows).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    np.fill_diagonal(sim, -9)
    for q in range(60):
        want = sorted(range(60), key=lambda g: (-sim[q, g], g))[:4]
        assert [r.g_id for r in sorted((r for r in got if r.q_id == q), key=lambda r: r.rank)] == want


def test_tanimoto_weights_with_lanes(spark):
    bits = (RNG.random((40, 12)) > 0.5).astype(float)
    bits[0] = 0
    got = {(r.q_id, r["rank"]): (r.g_id, r.sim) for r in retrieval.tanimoto_topk(vectors(spark, bits), "id", "vec", 3, 12, lane_rows=9).collect()}
    inter = bits @ bits.T
    union = bits.sum(1)[:, None] + bits.sum(1)[None, :] - inter
    sim = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    for q in range(40):
        want = sorted((g for g in range(40) if g != q), key=lambda g: (-sim[q, g], g))[:3]
        assert [got[(q, r)][0] for r in (1, 2, 3)] == want


# -- replicate scores ----------------------------------------------------------------------


def brute_ap(x, pert, plate, ctrl, negatives):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 12)
    out = {}
    for q in range(len(x)):
        if ctrl[q]:
            continue
        pos = [g for g in range(len(x)) if pert[g] == pert[q] and plate[g] != plate[q]]
        neg = [g for g in range(len(x)) if plate[g] == plate[q] and g != q and (negatives == "ref_index" or ctrl[g])]
        ranked = sorted([(-sim[q, g], 0) for g in pos] + [(-sim[q, g], 1) for g in neg])
        hit = [i for i, r in enumerate(ranked) if r[1] == 0]
        out[q] = np.mean([(j + 1) / (i + 1) for j, i in enumerate(hit)]) if hit else None
    return out


@pytest.mark.parametrize("negatives,lane_rows,band", [("ref_index", None, None), ("controls", None, None), ("ref_index", 8, 3)])
def test_average_precision_brute_force(spark, monkeypatch, negatives, lane_rows, band):
    if band:
        monkeypatch.setattr(replicate, "BAND_ROWS", band)
    n = 50
    x = RNG.standard_normal((n, 4))
    pert, plate = [f"g{i % 4}" for i in range(n - 1)] + ["lonely"], [f"p{i % 3}" for i in range(n)]
    ctrl = [p == "g0" for p in pert]
    df = vectors(spark, x, pert=pert, plate=plate, ctrl=ctrl).withColumn("batch", F.lit("b"))
    got = {r.id: r.ap for r in replicate.average_precision(df, "id", "vec", "pert", ["batch", "plate"], F.col("ctrl"), 4, negatives=negatives, lane_rows=lane_rows).collect()}
    want = brute_ap(x, pert, plate, ctrl, negatives)
    assert set(got) == set(want) and got[n - 1] is None
    assert all(got[q] == pytest.approx(want[q]) for q in want if want[q] is not None)


@pytest.mark.parametrize("negatives", ["ref_index", "controls"])
@pytest.mark.parametrize("lists,way", [(100, "cells"), (1, "both"), (0, "lists")])
def test_average_precision_in_cells_and_lists(spark, monkeypatch, negatives, lists, way):
    """Many queries of a plate and perturbation leave no lists of similarities; all ways give the same numbers."""
    n = 60
    x = RNG.standard_normal((n, 4))
    x[40:44] = x[:4]
    pert = [("a" if i % 3 else "b") if i < 48 else "ctl" if i % 2 else f"g{i % 4}" for i in range(n)]
    plate = [f"p{i % 3 if i < 48 else i % 2}" for i in range(n)]
    ctrl = [p == "ctl" for p in pert]
    df = vectors(spark, x, pert=pert, plate=plate, ctrl=ctrl).withColumn("batch", F.lit("b"))
    used = []
    for f in ("_in_cells", "_by_lists"):
        real = getattr(replicate, f)
        monkeypatch.setattr(replicate, f, lambda *a, real=real, f=f: used.append(f) or real(*a))
    monkeypatch.setattr(replicate, "LISTS", lists)
    got = replicate.average_precision(df, "id", "vec", "pert", ["batch", "plate"], F.col("ctrl"), 4, negatives=negatives).collect()
    want = brute_ap(x, pert, plate, ctrl, negatives)
    assert used == {"cells": ["_in_cells"], "both": ["_in_cells", "_by_lists"], "lists": ["_by_lists"]}[way]
    assert {r.id for r in got} == set(want) and all(r.ap == pytest.approx(want[r.id]) for r in got if want[r.id] is not None)
    assert all(r.ap is None for r in got if want[r.id] is None)


def test_diff_mode(spark):
    df = vectors(spark, RNG.standard_normal((4, 3)), pert=["a"] * 4, batch=["1", "1", "2", "2"], plate=["x", "y", "x", "y"])
    n = lambda mode: {r.n_pos for r in replicate.average_precision(df, "id", "vec", "pert", ["batch", "plate"], F.lit(False), 3, diff_mode=mode).collect()}
    assert n("any") == {3} and n("all") == {1}


def test_known_ap_and_bh(spark):
    # ranking + - + - by cosine to the first vector
    x = [[1, 0], [1, 0.1], [1, 0.2], [1, 0.3], [1, 0.4]]
    df = vectors(spark, x, pert=["a", "a", "z1", "a", "z2"], plate=["1", "2", "1", "2", "1"])
    r = {r.id: r for r in replicate.average_precision(df, "id", "vec", "pert", ["plate"], F.lit(False), 2).collect()}
    assert r[0].ap == pytest.approx(5 / 6) and (r[0].n_pos, r[0].n_neg) == (2, 2)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = {x.p: x.corrected_p_value for x in replicate.bh_adjust(p, "p").collect()}
    assert got == pytest.approx({0.01: 0.04, 0.04: 0.16 / 3, 0.03: 0.16 / 3, 0.5: 0.5})


def test_significance_separates_signal(spark):
    x = RNG.standard_normal((60, 8))
    pert = [f"g{i % 6}" for i in range(60)]
    x[[i for i in range(60) if i % 6 == 0]] += 6
    df = vectors(spark, x, pert=pert, plate=[f"p{i // 6}" for i in range(60)])
    ap = replicate.average_precision(df, "id", "vec", "pert", ["plate"], F.lit(False), 8)
    out = {r.pert: r for r in replicate.significance(ap, "pert", null_size=500).collect()}
    assert out["g0"].below_corrected_p and out["g0"].p_value == pytest.approx(1 / 501)
    assert not any(out[f"g{i}"].below_corrected_p for i in range(1, 6) if out[f"g{i}"].mean_ap < 0.5)


def test_null_draws_have_the_expected_mean():
    for n_pos, n_total in ((2, 4), (1, 200)):
        draws = replicate._null_draws(n_pos, n_total, 20_000)
        if n_pos == 1:
            want = np.mean(1 / np.arange(1, n_total + 1))
        else:
            want = np.mean([np.mean([(j + 1) / (i + 1) for j, i in enumerate(c)]) for c in ((a, b) for a in range(4) for b in range(a + 1, 4))])
        assert draws.mean() == pytest.approx(want, rel=0.03)


def test_null_draws_take_every_set_of_ranks_alike():
    draws = replicate._null_draws(3, 6, 40_000, seed=5)
    sets = [np.mean([(j + 1) / (i + 1) for j, i in enumerate(c)]) for c in itertools.combinations(range(6), 3)]
    values, counts = np.unique(np.round(draws, 9), return_counts=True)
    want, ways = np.unique(np.round(sets, 9), return_counts=True)
    assert np.allclose(values, want) and np.allclose(counts / 40_000, ways / 20, atol=0.006)
    assert (replicate._null_draws(4, 4, 10) == 1.0).all()
    assert (replicate._null_draws(3, 6, 100, seed=5) == draws[:100]).all() and (replicate._null_draws(3, 6, 100, seed=6) != draws[:100]).any()


# -- probe, correction ---------------------------------------------------------------------


def test_ridge_matches_normal_equations(spark):
    x, w = RNG.standard_normal((80, 3)) + 5, RNG.standard_normal((3, 2))
    y = np.hstack([x @ w + 0.1 * RNG.standard_normal((80, 2)) + 4, np.ones((80, 1))])
    df = vectors(spark, x, y=[list(map(float, r)) for r in y])
    m = probe.ridge_fit(df, "vec", "y", alpha=1.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[:, :2] - y[:, :2].mean(0)))
    assert list(m.kept) == [0, 1] and np.allclose(m.coef, want)
    exact = probe.ridge_fit(vectors(spark, x, y=[list(map(float, r)) for r in x @ w]), "vec", "y", alpha=1e-9)
    assert np.allclose(exact.coef / exact.std[:, None], w)
    scores = {r.feature: r for r in probe.ridge_scores(df.withColumn("t", F.col("id") < 60), "vec", "y", F.col("t"), ~F.col("t")).collect()}
    assert set(scores) == {0, 1} and scores[0].n == 20 and scores[0].r2 > 0.9


def test_constant_feature_has_no_pearson(spark):
    df = spark.createDataFrame([("f", 1.0, 2.0), ("f", 1.0, 3.0)], "feature string, t double, p double")
    r = probe.feature_scores(df, "feature", "t", "p").first()
    assert r.pearson is None and r.r2 is None


def test_moments_and_sphering(spark):
    x = RNG.standard_normal((200, 4)) @ RNG.standard_normal((4, 4)) + 1e4
    df = vectors(spark, x)
    n, mean, cov = covariance(df, "vec")
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert np.allclose(correlation(df, "vec"), np.corrcoef(x.T))
    for method in ("ZCA", "ZCA-cor", "PCA", "PCA-cor"):
        s = matrix(correct.sphere(df, "vec", F.lit(True), method, eps=0.0), "sphered")
        assert np.allclose(np.cov(s.T, bias=True), np.eye(4), atol=1e-6)
    assert np.allclose(matrix(correct.sphere(df, "vec", F.lit(True), "none"), "sphered"), x)
    z = matrix(correct.standard_scale(df, "vec"), "scaled")
    assert np.allclose(z.mean(0), 0, atol=1e-6) and np.allclose(z.std(0), 1)


def test_pca_projection(spark):
    x = RNG.standard_normal((50, 6)) * np.array([9, 5, 3, 1, 1, 1]) + 3
    got = matrix(correct.principal_components(vectors(spark, x), "vec", 3), "pca")
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3]))
    assert matrix(correct.principal_components(vectors(spark, x[:3]), "vec", 50), "pca").shape == (3, 2)


def test_correlation_filter(spark):
    a, b = RNG.standard_normal(60), RNG.standard_normal(60)
    df = vectors(spark, np.stack([a, 2 * a, b], axis=1))
    kept = correct.correlated_features(df, "vec", 0.9)
    assert len(kept) == 2 and 2 in kept
    assert matrix(correct.keep_positions(df, "vec", kept), "vec").shape == (60, 2)


def test_harmony_removes_batch_keeps_labels(spark):
    n = 240
    lab, bat = np.arange(n) % 3, (np.arange(n) // 3) % 2
    x = RNG.standard_normal((n, 6)) * 0.3 + np.eye(6)[lab] * 5 + bat[:, None] * np.array([0, 0, 0, 2.0, 2.0, 0])
    df = vectors(spark, x, batch=[str(b) for b in bat], lab=[str(v) for v in lab])
    out = correct.harmony(df, "vec", "batch", "id", n_clusters=6, max_rounds=3, inner_rounds=3)
    r = integration.pcr_comparison(out, "vec", "harmony", "batch").first()
    assert r.r2_post < 0.5 * r.r2_pre
    z = matrix(out, "harmony")
    spread = lambda m: np.var([m[lab == i].mean(0) for i in range(3)], axis=0).sum()
    assert spread(z) > 0.8 * spread(x)


def test_harmony_goes_on_until_settled(spark, monkeypatch):
    """Without a number of rounds it doesn't stop at the tenth."""
    x = RNG.standard_normal((40, 3))
    df = vectors(spark, x, batch=[str(i % 2) for i in range(40)])
    rounds = []

    class Eleventh(Exception):
        pass

    def counted(state, keep=correct.checkpoint):
        rounds.append(1)
        if len(rounds) == 12:  # the first is the packing of the lanes
            raise Eleventh
        return keep(state)

    monkeypatch.setattr(correct, "checkpoint", counted)
    with pytest.raises(Eleventh):
        correct.harmony(df, "vec", "batch", "id", n_clusters=2, inner_rounds=1, tol=-1.0)


def block_harmony(z, batch, first, rounds, inner, sigma=0.1, theta=2.0, ridge=1.0, blocks=20):
    """The sequential block method on rows in their order, with plain matrices."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    hot = np.eye(batch.max() + 1)[batch]
    share, zc = hot.mean(axis=0), z.copy()
    r = np.exp(-2 * (1 - unit(z) @ first.T) / sigma)
    r /= r.sum(axis=1, keepdims=True)
    objectives = []
    for _ in range(rounds):
        u = unit(zc)
        for _ in range(inner):
            dist = 2 * (1 - u @ unit(r.T @ u).T)
            seen = r.T @ hot
            for rows in np.array_split(np.arange(len(z)), blocks):
                seen = seen - r[rows].T @ hot[rows]
                expected = np.outer(seen.sum(axis=1), share)
                w = np.exp(-dist[rows] / sigma) * (((expected + 1) / (seen + 1)) ** theta)[:, batch[rows]].T
                r[rows] = w / w.sum(axis=1, keepdims=True)
                seen = seen + r[rows].T @ hot[rows]
        expected = np.outer(seen.sum(axis=1), share)
        objectives.append((r * dist).sum() + sigma * (r * np.log(r)).sum() + sigma * theta * (seen * np.log((seen + 1) / (expected + 1))).sum())
        design = np.hstack([np.ones((len(z), 1)), hot])
        zc = z.copy()
        for c in range(r.shape[1]):
            weighted = design * r[:, [c]]
            w = np.linalg.solve(weighted.T @ design + np.diag([0.0] + [ridge] * hot.shape[1]), weighted.T @ z)
            w[0] = 0
            zc -= weighted @ w
    return zc, objectives


@pytest.mark.parametrize("lane_rows", [8192, 150])
def test_harmony_against_the_block_method(spark, lane_rows):
    """One lane is the block method itself; several come close to it."""
    g = np.random.default_rng(71)
    n, d, k = 600, 5, 4
    lab, bat = np.arange(n) % 3, (np.arange(n) // 3) % 3
    x = g.standard_normal((n, d)) * 0.4 + np.eye(d)[lab] * 4 + (bat == 1)[:, None] * np.array([0, 0, 0, 1.5, 0.5])
    df = vectors(spark, x, batch=[str(b) for b in bat])
    history = []
    got = matrix(correct.harmony(df, "vec", "batch", "id", n_clusters=k, max_rounds=4, inner_rounds=3, tol=-1.0, history=history, lane_rows=lane_rows), "harmony")
    feats = correct.Normalizer(inputCol="f", outputCol="u").transform(df.select(correct.array_to_vector("vec").alias("f")))
    first = np.array(correct.KMeans(k=k, seed=42, featuresCol="u", maxIter=25).fit(feats.select("u")).clusterCenters())
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    order = [r[0] for r in df.select("id", F.xxhash64(F.lit(43), "id").alias("at")).orderBy("at").collect()]
    ref, objectives = block_harmony(x[order], bat[order], first, 4, 3)
    want = np.empty_like(ref)
    want[order] = ref
    if lane_rows == 8192:
        assert np.allclose(got, want, atol=1e-8) and np.allclose(history, objectives, rtol=1e-9)
    else:
        assert np.linalg.norm(got - want) < 0.05 * np.linalg.norm(x - want) and np.allclose(history, objectives, rtol=0.01)
    assert history[-1] < history[0]


def test_harmony_of_no_rows(spark):
    none = vectors(spark, np.zeros((1, 2)), batch=["a"]).limit(0)
    assert correct.harmony(none, "vec", "batch", "id").count() == 0


# -- integration scores ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    n = 90
    lab, bat = np.arange(n) % 3, (np.arange(n) // 3) % 2
    x = np.random.default_rng(31).standard_normal((n, 4)) + np.eye(4)[lab] * 12
    return vectors(spark, x, lab=[f"l{v}" for v in lab], batch=[f"b{v}" for v in bat]), x, lab, bat


def test_contingency_scores(spark):
    same = spark.createDataFrame([("a", 1)] * 3 + [("b", 2)] * 2, "l string, c int")
    r = integration.clustering_agreement(same, "l", "c").first()
    assert r.nmi == pytest.approx(1) and r.ari == pytest.approx(1)
    mixed = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2)], "l string, c int")
    r = integration.clustering_agreement(mixed, "l", "c").first()
    assert r.nmi == pytest.approx(0) and r.ari == pytest.approx(-0.5)


@pytest.mark.parametrize("lane_rows", [None, 11])
def test_silhouette_brute_force(blobs, lane_rows):
    df, x, lab, _ = blobs
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(len(x)):
        own = [d[i, j] for j in range(len(x)) if lab[j] == lab[i] and j != i]
        other = min(np.mean(d[i, lab == k]) for k in range(3) if k != lab[i])
        s.append((other - np.mean(own)) / max(other, np.mean(own)))
    got = integration.silhouette_label(df, "id", "vec", "lab", 4, lane_rows=lane_rows).first()[0]
    assert got == pytest.approx((np.mean(s) + 1) / 2)


def test_silhouette_many_labels(spark):
    """Labels of every size, cut and whole: equal to plain distances, and one row per query and lane besides cut labels."""
    r = np.random.default_rng(77)
    n = 260
    lab = np.where(np.arange(n) < 90, 0, np.where(np.arange(n) < 100, 1, 2 + np.arange(n) // 2))
    x = r.standard_normal((n, 5))
    df = vectors(spark, x, lab=[f"l{v}" for v in lab])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near, rest = [], []
    for i in range(n):
        same = (lab == lab[i]) & (np.arange(n) != i)
        if not same.any():
            near.append(0.0)
            rest.append(0.0)
            continue
        a = d[i, same].mean()
        for out, b in ((near, min(d[i, lab == k].mean() for k in set(lab) - {lab[i]})), (rest, d[i, lab != lab[i]].mean())):
            out.append((b - a) / max(a, b))
    ids = [row.id for row in df.select("id").collect()]
    for between, want in (("nearest", near), ("mean_other", rest)):
        for lane_rows in (None, 40):
            got = {row.id: row.s for row in integration.silhouette_samples(df, "id", "vec", "lab", 5, between=between, lane_rows=lane_rows).collect()}
            assert [got[i] for i in ids] == pytest.approx(want, abs=1e-9)


def lisi_by_hand(x, code, k):
    """Median inverse Simpson index over the k nearest rows (the row itself left out), one row after another."""
    out = []
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1)
        near = [j for j in np.argsort(d, kind="stable") if j != i][:k]
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(200):
            w = np.exp(-(d[near] - d[near].min()) * beta)
            w /= w.sum()
            if -(w * np.log(np.maximum(w, 1e-300))).sum() > np.log(k / 3):
                lo = beta
            else:
                hi = beta
            beta = beta * 2 if np.isinf(hi) else (lo + hi) / 2
        out.append(1 / sum(w[code[near] == c].sum() ** 2 for c in set(code[near].tolist())))
    return np.median(out)


def test_lisi_against_plain_loops(blobs):
    df, x, lab, bat = blobs
    r = integration.lisi_scores(df, "id", "vec", "lab", "batch", 4, k=15).first()
    assert r.clisi == pytest.approx((3 - lisi_by_hand(x, lab, 15)) / 2, abs=1e-5)
    assert r.ilisi == pytest.approx(lisi_by_hand(x, bat, 15) - 1, abs=1e-4)


def test_lisi_weights_reach_perplexity():
    w = integration._weights(np.sort(RNG.random((5, 30)) * 7, axis=1), 10.0)
    assert np.allclose(np.exp(-(w * np.log(w)).sum(1)), 10.0, rtol=1e-4)


def test_chi2_tail_known_values():
    got = integration.chi2_sf(np.array([3.841458820694124, 9.487729036781154, 0.0, 7.814727903251179]), np.array([1, 4, 3, 3]))
    assert got == pytest.approx([0.05, 0.05, 1.0, 0.05])


def test_kbet_accepts_mixed_rejects_split(spark, blobs):
    df, x, lab, bat = blobs
    assert min(r.kbet for r in integration.kbet_per_label(df, "id", "vec", "lab", "batch", 4).collect()) > 0.8
    apart = vectors(spark, x + bat[:, None] * 50, lab=[f"l{v}" for v in lab], batch=[f"b{v}" for v in bat])
    assert max(r.kbet for r in integration.kbet_per_label(apart, "id", "vec", "lab", "batch", 4).collect()) < 0.2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in integration.connected_components(edges, "a", "b").collect()}
    assert {got[i] for i in range(21)} == {0} and got[101] == 100


def test_composite_uses_five_batch_terms(spark):
    row = {"bras": 0.64938, "ilisi": 0.0, "kbet": 0.03097, "graph_connectivity": 0.18747, "pcr_comparison": 0.0}
    row |= dict.fromkeys(integration.BIO_TERMS, 0.5)
    r = integration.composites(spark.createDataFrame([row])).first()
    assert r.batch_correction == pytest.approx(0.17356, abs=1e-4) and r.total == pytest.approx(0.4 * r.batch_correction + 0.3)


def test_full_report(blobs):
    df, *_ = blobs
    r = integration.full_report(df, "id", "vec", "lab", "batch", 4, k=15).first()
    assert r.nmi > 0.9 and r.silhouette_label > 0.8 and r.graph_connectivity > 0.9 and r.pcr_comparison == 0.0


# -- whole flows -------------------------------------------------------------------------------


def test_classical_profiles_by_means(spark):
    from wellgrid.operators import profiles

    rows, nan = [], float("nan")
    for w in range(30):
        for c in range(3):
            x = RNG.standard_normal(5)
            # 2 is mostly missing, 3 is constant on controls, 4 has one infinite value
            feats = [x[0], x[1], nan if (w + c) % 2 else 1.0, 1.0 if w < 10 else x[3], float("inf") if w == c == 0 else x[4]]
            rows.append((f"w{w:02d}c{c}", "s", "p", f"w{w:02d}", f"b{w % 2}", "EMPTY" if w < 10 else "drug", [float(v) for v in feats]))
    df = spark.createDataFrame(rows, "row_key string, source string, plate string, well string, batch string, perturbation string, f array<double>")
    out = profiles.classical_profiles_mean(
        df, "f", F.col("perturbation") == "EMPTY", "row_key", metadata=["perturbation"], n_clusters=2, max_rounds=1, inner_rounds=1
    ).collect()
    assert len(out) == 30 and {len(r.sphered) for r in out} == {3} and {len(r.pca_harmony) for r in out} == {3}
    assert np.isfinite([r.pca_harmony for r in out]).all() and sum(r.is_control for r in out) == 10
    with pytest.raises(ValueError, match="control"):
        profiles.classical_profiles_mean(df, "f", F.col("perturbation") == "none", "row_key", metadata=["perturbation"])


def test_select_cells_rules(spark):
    from wellgrid.operators import profiles

    cells = spark.createDataFrame([(f"s__b__p__w{w}__1", i, 10 + w) for w in range(3) for i in range(8)], "fov_id string, id_local int, n_cells_in_fov int")
    meta = spark.createDataFrame([(f"s__b__p__w{w}__1", None if w == 0 else f"K{w}") for w in range(3)], "fov_id string, Metadata_InChIKey string")
    columns = ["Metadata_InChIKey", "Metadata_SMILES"]
    out = profiles.select_cells(cells, meta, "uniform_per_compound_source", columns, n_per_group=2).collect()
    per = {k: sum(r.well == k for r in out) for k in ("w0", "w1", "w2")}
    assert per == {"w0": 8, "w1": 2, "w2": 2}
    assert {r.n_cells_scaled for r in out} == {0.0, 127.5, 255.0} and {r.Metadata_SMILES for r in out} == {""}
    assert next(r for r in out if r.well == "w0").Metadata_InChIKey == ""
    assert profiles.select_cells(cells, meta, "uniform_total", columns, n_total=5).count() == 5
    with pytest.raises(ValueError, match="duplicate"):
        profiles.select_cells(cells, meta.unionByName(meta), "uniform_total", columns, n_total=5)


def test_one_hot_key_is_split(spark):
    """A third of the rows in one group: same results whatever the lane size."""
    n = 150
    x = RNG.standard_normal((n, 3))
    pert = ["hot" if i % 3 == 0 else f"g{i % 11}" for i in range(n)]
    df = vectors(spark, x, pert=pert, plate=["big" if i % 3 == 1 else f"p{i % 7}" for i in range(n)])
    wide, narrow = (
        {r.id: r.ap for r in replicate.average_precision(df, "id", "vec", "pert", ["plate"], F.lit(False), 3, lane_rows=k).collect()} for k in (None, 10)
    )
    assert wide.keys() == narrow.keys()
    assert all((wide[i] is None and narrow[i] is None) or wide[i] == pytest.approx(narrow[i]) for i in wide)


def test_component_rounds_do_not_swell_the_plan(spark):
    """A long path takes many rounds; the size estimate of the result must not be a product over them."""
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    comp = integration.connected_components(path, "u", "v")
    assert comp._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
    assert comp.agg(F.count("*"), F.max("component")).first()[:] == (301, 0)


def test_cell_counts_from_the_fov_table(spark):
    """Counts of the FOV table meet the sampled cells and give what counts on every cell give."""
    from wellgrid.operators import profiles

    cells = spark.createDataFrame([(f"s__b__p__W{i % 3}__t{i % 2}", str(i)) for i in range(60)], "fov_id string, id_local string")
    fovs = cells.groupBy("fov_id").agg(F.count("*").alias("n_cells_in_fov"))
    pick = lambda c, m: sorted(map(str, profiles.select_cells(c, m, "uniform_per_well", ["x"], n_per_well=4).select("row_key", "n_cells_in_fov", "n_cells_scaled").collect()))
    got = pick(cells, fovs)
    assert len(got) == 12 and got == pick(cells.join(fovs, "fov_id"), fovs.select("fov_id"))


def test_classical_profiles_equal_sql_where_medians_tie(spark, tmp_path):
    """Controls of equal median made from different cells have no deviation, so their plate is not scaled by a rounding error."""
    import shutil

    from tests.oracle import SF, connect, differences
    from wellgrid import catalog

    catalog.load_all()
    for t in ("part", "supplier", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    cell = lambda i, well, v: (i, well, 1, 1, float(i * 7 % 16), float(i * i * 11 % 23), v, "2020-01-01")
    pairs = [(0.01, 0.03)] * 3 + [(0.02, 0.02)] * 3 + [(0.01, 0.05), (0.0, 0.1)]
    rows = [cell(2 * i + j, w, v) for i, (w, pair) in enumerate(zip((1, 2, 3, 4, 5, 6, 8, 9), pairs)) for j, v in enumerate(pair)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate string"
    spark.createDataFrame(rows, kinds).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "cells"))
    shutil.copy(next((tmp_path / "cells").glob("*.parquet")), tmp_path / "lineitem.parquet")
    assert differences(catalog.QUERIES["classical_profiles"](spark, str(tmp_path)), connect(str(tmp_path)), catalog.ORACLES["classical_profiles"]) == []


def test_harmony_rounds_do_not_pile_up(spark):
    """Whatever the number of rounds, the checkpoint folder holds one state, without a number per row and cluster."""
    from pathlib import Path
    from urllib.parse import urlparse

    from wellgrid.plans.durable import ensure_checkpoint_dir

    rng, n, k = np.random.default_rng(5), 3000, 40
    df = spark.createDataFrame([(i, f"b{i % 3}", rng.normal(size=4).tolist()) for i in range(n)], "id long, batch string, vec array<double>").cache()
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    size, before = {}, held()
    for rounds in (1, 6):
        assert correct.harmony(df, "vec", "batch", "id", n_clusters=k, max_rounds=rounds, tol=-1.0).count() == n
        size[rounds] = held() - before
        before += size[rounds]
    assert size[6] < 1.5 * size[1] and size[6] < n * k * 8


def test_fov_table_meets_sampled_cells_once(spark):
    """Counts and metadata of the FOV table come by one join without repeats of that table, and id parts are not shuffled."""
    from wellgrid.operators import profiles

    cells = spark.createDataFrame([(f"s__b__p{i % 2}__W{i % 3}__t{i % 5}", str(i)) for i in range(200)], "fov_id string, id_local string")
    fovs = cells.groupBy("fov_id").agg(F.count("*").alias("n_cells_in_fov")).withColumn("kind", F.concat(F.lit("k"), "fov_id"))
    out = profiles.select_cells(cells, fovs, "uniform_per_well", ["kind"], n_per_well=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" not in plan and plan.count("Join LeftOuter") == 3  # the result, and the lowest and highest count
    rows = out.collect()
    assert len(rows) == 24 and all(r.kind == f"k{r.fov_id}" and r.fov_id == "__".join([r.source, r.batch, r.plate, r.well, r.tile]) for r in rows)
    assert all(r.plate_key == f"s__b__{r.plate}" and r.row_key == f"{r.fov_id}__{r.id_local}" for r in rows)
