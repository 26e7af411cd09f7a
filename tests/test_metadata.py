import pytest
from pyspark.sql import functions as F

from wellgrid import checks
from wellgrid.functions import ids
from wellgrid.functions.hashing import fingerprint
from wellgrid.operators import metadata as M
from wellgrid.operators import report
from wellgrid.plans.ranking import first_per_key
from wellgrid.sources import readers

WELLS = [
    ("source_2", "B1", "P1", "A01", "K0"), ("source_2", "B1", "P1", "A02", "K1"), ("source_2", "B2", "P2", "B01", "K2"),
    ("source_4", "B1", "P3", "A01", "K3"), ("source_4", "B1", "P3", "A02", "K4"), ("source_4", "B1", "P3", "A03", "K5"),
]
FIELDS = ["source", "plate"]
KEY = ["source", "batch", "plate", "well"]


@pytest.fixture(scope="module")
def wells(spark):
    return spark.createDataFrame(WELLS, "source string, batch string, plate string, well string, inchikey string")


def pick(spark, wells, *entries):
    return M.select_samples(wells, readers.whitelist(spark, list(entries), FIELDS), FIELDS, KEY, ["inchikey"])


def test_whitelist_algebra(spark, wells):
    assert pick(spark, wells, {"source": "source_2", "plate": "P1"}).count() == 2
    assert pick(spark, wells, {"source": "source_2", "plate": "P2"}, {"source": "source_4"}).count() == 4
    assert pick(spark, wells, {"source": "source_4"}, {"plate": "P3"}, {"source": "source_4", "plate": "P3"}).count() == 3
    assert pick(spark, wells, {}).count() == 6
    with pytest.raises(ValueError, match="empty selection"):
        checks.assert_not_empty(pick(spark, wells, {"source": "nowhere"}))
    with pytest.raises(ValueError, match="unknown whitelist fields"):
        readers.whitelist(spark, [{"sourc": "x"}], FIELDS)
    with pytest.raises(ValueError, match="empty sample list"):
        readers.whitelist(spark, [], FIELDS)


def test_repeated_well_keeps_one_row(spark, wells):
    twice = wells.unionByName(wells.limit(1).withColumn("inchikey", F.lit("K9")))
    got = pick(spark, twice, {"source": "source_2", "plate": "P1"}).collect()
    assert sorted(r.inchikey for r in got) == ["K0", "K1"]


def test_whitelist_compares_plate_as_text(spark):
    meta = spark.createDataFrame([("s", "b", 7, "A01", "k")], "source string, batch string, plate bigint, well string, inchikey string")
    assert pick(spark, meta, {"plate": "7"}).count() == 1


def test_unmatched_entries(spark, wells):
    s = readers.whitelist(spark, [{"source": "source_2"}, {"source": "x"}, {"source": "source_4", "plate": "P1"}], FIELDS)
    assert sorted((r.source, r.plate) for r in M.unmatched_samples(wells, s, FIELDS).collect()) == [("source_4", "P1"), ("x", None)]


def test_site_expansion_casts_keys(spark, wells):
    listing = spark.createDataFrame(
        [(s, b, p, w, str(i)) for s, b, p, w, _ in WELLS[:3] for i in (1, 2)], "source string, batch string, plate string, well string, site string"
    )
    out = M.expand_to_sites(wells, listing, KEY, "site")
    first = out.select(ids.composite_id(*KEY, "site").alias("id")).orderBy("id").first().id
    assert out.count() == 6 and first == "source_2__B1__P1__A01__1"
    with pytest.raises(KeyError, match="site"):
        M.expand_to_sites(wells, listing.drop("site"), KEY, "site")
    numeric = spark.createDataFrame([(1, "x")], "plate bigint, v string")
    assert M.well_table(numeric, spark.createDataFrame([("1", "y")], "plate string, w string"), ["plate"]).count() == 1


def test_unsafe_identifiers(spark):
    bad = ["../evil", "foo/bar", "plate with space", "A0\0", ""]
    df = spark.createDataFrame([(b,) for b in [*bad, "ok-1.2_3"]], "well string")
    assert sorted(r.value for r in checks.unsafe_identifiers(df, ["well"]).collect()) == sorted(bad)
    with pytest.raises(ValueError, match="unsafe identifiers"):
        checks.assert_safe_identifiers(df, ["well"])


def test_id_parse_keeps_rest_in_last_part(spark):
    df = ids.with_id_parts(spark.createDataFrame([("s__b__p__w__t__9",)], "fov_id string")).first()
    assert (df.source, df.batch, df.plate, df.well, df.tile, df.plate_key) == ("s", "b", "p", "w", "t__9", "s__b__p")


def test_annotation_priority_and_unannotated_wells(spark):
    t = lambda rows: spark.createDataFrame(rows, "jcp string, label string")
    wells = spark.createDataFrame([("J1",), ("J2",), ("J3",), (None,)], "jcp string")
    tables = [t([("J1", "compound")]), t([("J1", "orf"), ("J2", "orf")]), t([("J2", "crispr")])]
    got = {(r.jcp, r.label) for r in M.annotate_by_priority(wells, tables, "jcp", ["label"]).collect()}
    assert got == {("J1", "compound"), ("J2", "orf"), ("J3", None), (None, None)}
    with_null = [t([(None, "keyless")])]
    assert M.annotate_by_priority(wells.where("jcp is null"), with_null, "jcp", ["label"]).first().label is None
    assert M.annotate_by_priority(wells.where("jcp is null"), with_null, "jcp", ["label"], null_safe=True).first().label == "keyless"


def test_sirna_rules(spark):
    smap = spark.createDataFrame(
        [("n1", "NEGATIVE_CONTROL"), ("n2", "TP53"), ("n3", None), ("n4", "NA"), ("n5", "")], "sirna_id string, gene_symbol string"
    )
    df = spark.createDataFrame([(s,) for s in ("n1", "n2", "n3", "n4", "n5", "EMPTY", "zz")], "sirna string")
    got = {r.sirna: r.perturbation for r in M.rekey_sirna(df, smap, "sirna").collect()}
    assert got == {"n1": "EMPTY", "n2": "TP53", "n4": "NA", "EMPTY": "EMPTY"}
    assert {r.sirna for r in M.resolve_wells(df, smap, "sirna").collect()} == {"n2", "n4"}
    assert {r.sirna for r in M.resolve_wells(df, smap, "sirna", keep_controls=True).collect()} == {"n2", "n4", "EMPTY"}


def test_canonical_labels_by_kind(spark):
    df = spark.createDataFrame([("EMPTY_control", "t", "src", "4"), ("G", "t", "src", "5")], "k string, inchi string, source string, plate string")
    r = {x.perturbation: x for x in M.canonical_labels(df, "crispr", "k", "inchi", "source", "plate").collect()}
    assert r["EMPTY"].batch == "plate_4" and r["G"].treatment == "t"
    c = M.canonical_labels(df, "compound", "k", "inchi", "source", "plate").first()
    assert c.batch == "src" and c.treatment == ""


def test_page_gene_window_and_stopwords(spark):
    page = "header\nn123\nSelect\nHUMAN\nTP53\nBRCA1"
    far = "\n".join(["n123", *["filler text"] * 7, "TP53"])
    df = spark.createDataFrame([(1, "n123", page), (2, "n123", far), (3, "n9", page), (4, "N123", "x\n n123 \r\nMYC")], "id int, wanted string, text string")
    assert {r.id: r.gene for r in M.genes_on_pages(df, "id", "wanted", "text").collect()} == {1: "TP53", 4: "MYC"}


def test_best_hit_prefers_exact_name(spark):
    hits = spark.createDataFrame([("TP53", "TP53L", 1), ("TP53", "tp53", 2), ("MYC", "X", 1), ("MYC", None, 2)], "s string, p string, r int")
    assert {r.s: r.r for r in M.best_hit(hits, "s", "p", "r").collect()} == {"TP53": 2, "MYC": 1}


def test_schema_check_and_request_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "id string, x int")
    with pytest.raises(KeyError, match="'y'"):
        checks.require_columns(df, ["id", "y"])
    got = {(r.id, r.problem) for r in checks.request_violations(df, "id", ["x"]).collect()}
    assert got == {("a", "repeated"), ("b", "missing:x")}
    with pytest.raises(ValueError, match="duplicate"):
        checks.assert_unique(df, ["id"])
    with pytest.raises(Exception, match="x is null"):
        checks.guard(df, F.col("x").isNotNull(), "x is null", on="id").collect()
    assert checks.guard(df, F.col("id").isNotNull(), "no id", on="id").count() == 3


def test_batch_guard(spark):
    df = spark.range(12).select(F.col("id").cast("string").alias("batch"))
    with pytest.raises(ValueError, match="12 batches"):
        checks.assert_batch_cardinality(df, "batch", 9)
    assert checks.batch_cardinality(df, "batch", 20).first().status == "warn"
    assert checks.batch_cardinality(df, "batch", None).first().status == "skip"


def test_observed_counter(spark):
    df, obs = checks.counted(spark.range(7), "seen")
    assert df.count() == 7 and obs.get["rows"] == 7


def test_fingerprint_ignores_argument_order(spark):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    r = df.select(fingerprint("x", "y").alias("p"), fingerprint("y", "x").alias("q")).first()
    assert r.p == r.q and len(r.p) == 12


def test_url_and_group_labels(spark):
    df = spark.createDataFrame([("s3://b/k/x.tif",), ("nonsense",)], "u string")
    rows = [r.p for r in df.select(ids.url_parts("u").alias("p")).collect()]
    assert tuple(rows[0]) == ("s3", "b", "k/x.tif") and tuple(rows[1]) == (None, None, None)
    lab = spark.createDataFrame([("Rxrx1 — DINO",), ("other — Zero-shot",)], "g string")
    got = [tuple(r.p) for r in lab.select(ids.split_group_label("g", {"rxrx1": "RxRx1"}).alias("p")).collect()]
    assert got == [("RxRx1", "DINO"), ("other", "zero-shot")]


def test_first_per_key_null_order_is_deterministic(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), (None, 3)], "k string, v int")
    assert {(r.k, r.v) for r in first_per_key(df, ["k"], ["v"]).collect()} == {("k", 1), (None, 3)}


def test_range_report_refuses_overlap(spark):
    r = spark.createDataFrame([("a", 5.0, 9.0), ("b", 1.0, 4.0), ("c", 3.0, 6.0)], "n string, lo double, hi double")
    assert [(x.upper, x.lower, x.margin) for x in report.range_overlap(r, "n", "lo", "hi").collect()] == [("a", "b", 1.0)]


def test_argument_rules():
    checks.check_sampling("uniform_total", n_total=5)
    for bad in (("uniform_total", {}), ("nope", {"n": 1}), ("uniform_per_well", {"n_per_well": 0}), ("uniform_total", {"n_total": 5, "control_labels": ["x"]})):
        with pytest.raises(ValueError):
            checks.check_sampling(bad[0], **bad[1])
    for bad in ((["a"], 0.9, 0.1), ([], 0.1, 0.9), (["a"], -0.1, 0.5)):
        with pytest.raises(ValueError):
            checks.check_quantiles(*bad)
    with pytest.raises(ValueError):
        checks.check_fractions(0.6, 0.5)


def test_range_standing_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(f"n{i}", float(a := rng.randrange(60)), float(a + rng.randrange(8))) for i in range(150)] + [("n0", 1.0, 1.0), ("bad", 5.0, 1.0), ("none", None, 2.0)]
    df = spark.createDataFrame(rows, "name string, lo double, hi double").repartition(6)
    good = [r for r in rows if None not in r and r[1] <= r[2]]
    want = []
    for k, (n, lo, hi) in enumerate(good):
        under = [(b, m) for j, (m, a, b) in enumerate(good) if j != k and b < lo]
        over = [(-a, m) for j, (m, a, b) in enumerate(good) if j != k and a > hi]
        u, o = max(under, default=None), max(over, default=None)
        want.append((n, lo, hi, len(under), len(over), len(good) - 1 - len(under) - len(over), u and u[1], u and lo - u[0], o and o[1], o and -o[0] - hi))
    assert sorted(map(tuple, report.range_standing(df, "name", "lo", "hi").collect()), key=str) == sorted(want, key=str)
    assert report.range_standing(df.limit(0), "name", "lo", "hi").count() == 0
