import gzip
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wellgrid import checks, schemas
from wellgrid.operators import blobs as B
from wellgrid.sources import readers, writers
from wellgrid.streaming import ingest

RNG = np.random.default_rng(5)


def fov_rows(spark, stacks):
    return spark.createDataFrame(
        [(f"f{i}", *s.shape, bytearray(s.astype("<u2").tobytes())) for i, s in enumerate(stacks)], "fov string, c int, h int, w int, pixels binary"
    )


def test_stretch(spark):
    ramp = np.arange(64).reshape(1, 8, 8) * 1000
    flat = np.full((1, 8, 8), 7)
    got = [np.frombuffer(r.pixels, np.uint8) for r in B.normalise_fov(fov_rows(spark, [ramp, flat]), low=0.0, high=1.0).orderBy("fov").collect()]
    assert got[0].min() == 0 and got[0].max() == 255 and not got[1].any()
    naive = B.normalise_fov(fov_rows(spark, [np.full((1, 2, 2), 65535)]), scheme="naive").first().pixels
    assert set(naive) == {255}
    with pytest.raises(ValueError):
        B.normalise_fov(fov_rows(spark, [flat]), scheme="zzz")


def test_stacking_reports_problems(spark):
    rows = [("a", 1, 2, 2, b"\x01"), ("a", 0, 2, 2, b"\x00"), ("b", 0, 2, 2, b"\x05"), ("c", 0, 2, 2, b"\x01"), ("c", 1, 3, 2, b"\x02")]
    df = spark.createDataFrame([(f, c, h, w, bytearray(p)) for f, c, h, w, p in rows], "fov string, ch int, h int, w int, pixels binary")
    got = {r.fov: r for r in B.stack_channels(df, "fov", "ch", "pixels", 2).collect()}
    assert bytes(got["a"].pixels) == b"\x00\x01" and got["a"].problem is None
    assert got["b"].problem == "channel count" and got["c"].problem == "shapes differ"


def labels(spark, *pairs):
    rows = [(f"f{i}", *n.shape, bytearray(n.astype("<u4").tobytes()), bytearray(c.astype("<u4").tobytes())) for i, (n, c) in enumerate(pairs)]
    return spark.createDataFrame(rows, "fov string, h int, w int, nucleus binary, cell_labels binary")


def test_border_labels(spark):
    m = np.zeros((6, 6), int)
    m[0, 0], m[5, 2], m[2, 0], m[2:4, 2:4], m[3, 5] = 1, 2, 3, 9, 4
    out = B.drop_border_labels(labels(spark, (m, m), (np.zeros((6, 6), int), m)), "nucleus").orderBy("fov").collect()
    got = np.frombuffer(out[0].nucleus, "<u4").reshape(6, 6)
    assert set(np.unique(got)) == {0, 9} and (got == 9).sum() == 4
    assert not np.frombuffer(out[1].nucleus, "<u4").any()


def test_matching_and_stats(spark):
    nuc, cell = np.zeros((10, 10), int), np.zeros((10, 10), int)
    cell[0:5, 0:5], cell[6:10, 6:10] = 40, 7
    nuc[1:3, 1:3], nuc[3, 3], nuc[8, 8], nuc[0, 9] = 5, 6, 2, 3  # 5 and 6 share a cell, 3 lies outside
    df = B.match_labels(labels(spark, (nuc, cell), (np.zeros((10, 10), int), cell)))
    r = df.orderBy("fov").first().matched
    assert list(r.nucleus_ids) == [2, 5] and list(r.cell_ids) == [7, 40]
    new = np.frombuffer(r.cell, "<u4").reshape(10, 10)
    assert new[8, 8] == 1 and new[0, 0] == 2 and set(np.unique(np.frombuffer(r.nucleus, "<u4"))) == {0, 1, 2}
    stats = {s.id_local: s for s in B.cell_stats(df, "fov").collect()}
    assert len(stats) == 2 and stats[2].nuc_area == 4 and stats[2].cyto_area == 25 and stats[2].nuc_cent_row == 1.5
    assert stats[2].nuc_cyto_ratio == 4 / 25 and stats[1].n_cells_in_fov == 2 and stats[1].nuc_id_global == 2


def test_crops(spark):
    stack = RNG.integers(0, 65535, (2, 12, 12))
    lab = np.zeros((2, 12, 12), int)
    lab[:, 4:7, 4:7] = 1
    fovs = fov_rows(spark, [stack, stack]).withColumn("labels", F.lit(bytearray(lab.astype("<u4").tobytes())))
    cells = spark.createDataFrame([("f0", 1, 5.9, 5.2), ("f0", 2, 0.5, 5.0), ("f0", 3, 10.0, 5.0), ("gone", 1, 5.0, 5.0)], "fov string, id_local int, cyto_cent_row double, cyto_cent_col double")
    rows = B.extract_crops(cells, fovs, "fov", 4, 12, 12, scheme="naive").collect()
    assert [(r.fov, r.id_local) for r in rows] == [("f0", 1)]
    want = (stack / 257.0).astype(np.uint8)[:, 3:7, 3:7]
    assert np.array_equal(np.frombuffer(rows[0].cell, np.uint8).reshape(2, 4, 4), want)
    assert set(rows[0].mask) == {0, 255}
    drops = {r.fov: r.n_dropped for r in B.border_drops(cells, "fov", 4, 12, 12).collect()}
    assert drops == {"f0": 2, "gone": 0}


@pytest.fixture(scope="module")
def crops(spark):
    rows = []
    for i in range(20):
        img, m = RNG.integers(1, 255, (5, 16, 16)), (RNG.random((2, 16, 16)) > 0.5) * 255
        rows.append((f"r{i}", "w", [float("nan"), -4.0, 300.9, 12.7][i % 4], bytearray(img.astype(np.uint8).tobytes()), bytearray(m.astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "row_key string, well string, n_cells_scaled double, cell binary, mask binary")


def test_variants_are_aligned(crops):
    shape = (5, 16, 16)
    v = B.all_variants(crops, shape, 2, 1)
    for a, b in (("C", "S"), ("C", "CD"), ("S", "SD"), ("CD", "SD")):
        r = B.variant_mismatches(v[a], v[b], "row_key", ["well", "mask"]).first()
        assert (r.n_missing, r.n_repeated, r.n_metadata_differs, r.n_keys) == (0, 0, 0, 20) and r.n_image_differs == 20
    got = {k: {r.row_key: np.frombuffer(r.cell, np.uint8).reshape(shape) for r in d.collect()} for k, d in v.items()}
    m = {r.row_key: np.frombuffer(r.mask, np.uint8).reshape(2, 16, 16) != 0 for r in crops.collect()}
    for k, img in got["C"].items():
        seg = np.concatenate([img[:1] * m[k][0], img[1:] * m[k][1]])
        assert np.array_equal(got["S"][k], seg)
        level = [0, 0, 255, 12][int(k[1:]) % 4]
        marked = seg.copy()
        for r in (slice(1, 3), slice(13, 15)):
            for c in (slice(1, 3), slice(13, 15)):
                marked[:, r, c] = level
        assert np.array_equal(got["SD"][k], marked)
    with pytest.raises(ValueError):
        B.mark_density(crops, shape, 16, 1)


def test_variant_check_sees_damage(crops):
    broken = crops.where("row_key <> 'r0'").unionByName(crops.where("row_key = 'r1'")).withColumn("well", F.when(F.col("row_key") == "r2", "x").otherwise(F.col("well")))
    r = B.variant_mismatches(crops, broken, "row_key", ["well"]).first()
    assert (r.n_missing, r.n_repeated, r.n_metadata_differs) == (1, 1, 1)


def test_wrong_blob_size_names_the_row(crops):
    assert checks.blob_size_violations(crops, "cell", (5, 16, 15), "row_key").count() == 20
    with pytest.raises(Exception, match="expected 1200"):
        B.mask_channels(crops, (5, 16, 15)).collect()


def test_resize(crops):
    assert B.resize(crops, (5, 16, 16), (16, 16)) is crops
    up = np.frombuffer(B.resize(crops, (5, 16, 16), (31, 31)).first().cell, np.uint8).reshape(5, 31, 31)
    src = np.frombuffer(crops.first().cell, np.uint8).reshape(5, 16, 16)
    assert np.array_equal(up[:, ::2, ::2], src)  # corners align, so every second pixel is a source pixel
    mask = np.frombuffer(B.resize(crops, (2, 16, 16), (40, 40), blob="mask", nearest=True).first().mask, np.uint8)
    assert set(mask) <= {0, 255} and len(mask) == 2 * 1600


def test_embedding_is_unit_and_repeatable(crops):
    e = B.embed(crops, (5, 16, 16), "linear", dim=16)
    a = np.array([r.embedding for r in e.orderBy("row_key").collect()])
    b = np.array([r.embedding for r in B.embed(crops.repartition(3), (5, 16, 16), "linear", dim=16).orderBy("row_key").collect()])
    assert a.shape == (20, 16) and np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-5) and np.allclose(a, b, atol=1e-6)
    assert "cell" not in checks.non_binary_columns(e) and "row_key" in checks.non_binary_columns(e)


def test_features_and_failing_measurement(crops):
    def broken(img, region):
        if img.max() > 1:
            raise RuntimeError("no measurement")
        return {"x": 0.0}

    f = B.featurise(crops, (5, 16, 16), measures=[B.intensity, B.channel_correlation]).first().features
    row = crops.first()
    img, m = np.frombuffer(row.cell, np.uint8).reshape(5, 16, 16), np.frombuffer(row.mask, np.uint8).reshape(2, 16, 16) != 0
    assert f["Nuclei_AreaShape_Area"] == m[0].sum() and f["Cells_Intensity_Mean_2"] == pytest.approx(img[2][m[1]].mean())
    assert f["Cells_Correlation_Correlation_3_1"] == pytest.approx(np.corrcoef(img[3][m[1]], img[1][m[1]])[0, 1])
    assert B.featurise(crops, (5, 16, 16), measures=[broken]).first().features == {"Nuclei_x": None, "Cells_x": None}


# -- sources and sinks -----------------------------------------------------------------------


def test_text_sources(spark, tmp_path):
    with gzip.open(tmp_path / "w.csv.gz", "wt") as f:
        f.write("Metadata_Source,Metadata_Plate\ns1,007\n")
    df = readers.csv_table(spark, str(tmp_path / "w.csv.gz"), readers.strings(["Metadata_Source", "Metadata_Plate"]), with_file=True)
    assert df.first().Metadata_Plate == "007" and "w.csv.gz" in df.first().file_path
    (tmp_path / "d.tsv").write_bytes("!note\nname\tmoa\ncaf\xe9\tx|y\n".encode("latin-1"))
    assert readers.commented_tsv(spark, str(tmp_path / "d.tsv"), readers.strings(["name", "moa"]), encoding="ISO-8859-1").first().name == "café"
    (tmp_path / "l.txt").write_text("b\n\n a \nb\n")
    assert sorted(r.value for r in readers.text_list(spark, str(tmp_path / "l.txt")).collect()) == ["a", "b"]
    (tmp_path / "p.fa").write_text(">sp|1 GN=TP53 PE=1\nMEE\nPQS\n>sp|2 no tag\nAAA\n>sp|3 GN=MYC\nMPL\n")
    assert {r.gene: r.sequence for r in readers.fasta(spark, str(tmp_path / "p.fa")).collect()} == {"TP53": "MEEPQS", "MYC": "MPL"}
    (tmp_path / "iso.fa").write_text(">b GN=A\nMMM\n>a GN=A PE=1\nPPP\n>c ORGN=A\nQQQ\n")
    assert {r.gene: r.sequence for r in readers.fasta(spark, str(tmp_path / "iso.fa")).collect()} == {"A": "PPP"}  # the last record, whole tag only
    only = spark.createDataFrame([("MYC",)], "gene string")
    assert readers.fasta(spark, str(tmp_path / "p.fa"), only).count() == 1
    (tmp_path / "c.yaml").write_text("samples:\n  - source: s1\n    plate: 7\n  - plate: p2\n")
    assert readers.whitelist_yaml(spark, str(tmp_path / "c.yaml"), ["source", "plate"]).where("source is null").first().plate == "p2"


def test_shard_index_and_image_blobs(spark, tmp_path):
    df = spark.createDataFrame([("e_1_A01_c1", bytearray(b"x")), ("e_1_A01_c2", bytearray(b"y"))], "__key__ string, jp2 binary")
    df.coalesce(1).write.parquet(str(tmp_path / "raw"))
    assert readers.image_blobs(spark, str(tmp_path / "raw"), "__key__", "jp2").count() == 2
    nested = df.select("__key__", F.struct(F.col("jp2").alias("bytes"), F.lit("p").alias("path")).alias("jp2"))
    nested.coalesce(1).write.parquet(str(tmp_path / "nested"))
    assert bytes(readers.image_blobs(spark, str(tmp_path / "nested"), "__key__", "jp2").orderBy("__key__").first().bytes) == b"x"
    part = next(f for f in os.listdir(tmp_path / "raw") if f.endswith(".parquet"))
    os.makedirs(tmp_path / "shards")
    os.rename(tmp_path / "raw" / part, tmp_path / "shards" / "train-00017.parquet")
    idx = readers.shard_index(spark, str(tmp_path / "shards"))
    assert [(r.prefix, r.shard) for r in idx.collect()] == [("e_1_A01", 17)]
    with pytest.raises(FileNotFoundError):
        readers.parquet_tree(spark, str(tmp_path / "nowhere"))


def test_scan_pushes_filters(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("plate"), F.lit("x").alias("blob"), F.lit(1).alias("v")).write.parquet(str(tmp_path / "t"))
    plan = readers.parquet_scan(spark, str(tmp_path / "t"), ["v"], {"plate": 3})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(plate,3)" in plan and "blob" not in plan


def test_partitioned_resharded_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("s", "b", f"p{i % 2}", i) for i in range(10)], "source string, batch string, plate string, id int")
    writers.by_plate(df, str(tmp_path / "plates"))
    assert sorted(os.listdir(tmp_path / "plates" / "source=s" / "batch=b"))[-2:] == ["plate=p0", "plate=p1"]
    writers.resharded(df, str(tmp_path / "files"), ["id"], rows_per_file=3, max_files=64)
    files = sorted(f for f in os.listdir(tmp_path / "files") if f.endswith(".parquet"))
    parts = [[r.id for r in spark.read.parquet(str(tmp_path / "files" / f)).collect()] for f in files]
    assert [p for p in sorted(parts)] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    writers.metric_csv(df.limit(1), str(tmp_path / "m"))
    writers.run_report(df.limit(1), str(tmp_path / "r"))
    writers.merge_parts(df, str(tmp_path / "merged"), "plate")
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == df.columns


def test_resharded_files_by_number(spark, tmp_path):
    """Every file has its own rows, however coarsely ranges are sampled."""
    conf = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    spark.conf.set(conf, "1")
    try:
        writers.resharded(spark.range(0, 4000, 1, 16), str(tmp_path / "files"), ["id"], rows_per_file=20)
    finally:
        spark.conf.unset(conf)
    names = F.col("_metadata.file_name").alias("file")
    files = spark.read.parquet(str(tmp_path / "files")).select("id", names).groupBy("file").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count("id").alias("n")).collect()
    assert sorted((r.a, r.z, r.n) for r in files) == [(i, i + 19, 20) for i in range(0, 4000, 20)]


def test_append_is_resumable(spark, tmp_path):
    out = str(tmp_path / "out")
    a = spark.createDataFrame([("k1", "7", 1), ("k2", "8", 2), ("k2", "8", 2)], "row_key string, plate string, v int")
    writers.append_new(a, out, ["row_key"], partition_by=["plate"])
    writers.append_new(a.unionByName(spark.createDataFrame([("k3", "8", 3)], a.schema)), out, ["row_key"], partition_by=["plate"])
    assert sorted(r.row_key for r in spark.read.parquet(out).collect()) == ["k1", "k2", "k3"]
    with pytest.raises(ValueError, match="schema changed"):
        writers.append_new(a.withColumn("v", F.lit("text")), out, ["row_key"], partition_by=["plate"])


def test_incremental_ingest(spark, tmp_path, crops):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    crops.limit(8).write.parquet(src)
    step = lambda b: B.embed(b, (5, 16, 16), "linear", dim=4).drop("cell", "mask")
    run = lambda: ingest.ingest_once(ingest.file_stream(spark, src, crops.schema), out, state, ["row_key"], step)
    run()
    assert spark.read.parquet(out).count() == 8
    crops.write.mode("append").parquet(src)  # 8 old keys and 12 new ones land
    run()
    run()
    got = spark.read.parquet(out)
    assert got.count() == got.select("row_key").distinct().count() == 20 and len(got.first().embedding) == 4


def test_ingest_refuses(spark, tmp_path, crops):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    crops.limit(4).write.parquet(src)
    stream = lambda: ingest.file_stream(spark, src, crops.schema)
    keys = lambda b: b.select("row_key", "well")
    ingest.ingest_once(stream(), out, state, ["row_key"], keys)
    with pytest.raises(ValueError, match="schema changed"):
        ingest.ingest_once(stream(), out, state, ["row_key"], lambda b: keys(b).withColumn("well", F.lit(1)))
    with pytest.raises(ValueError, match="does not know"):
        ingest.ingest_once(stream(), out, str(tmp_path / "other"), ["row_key"], keys)
    assert spark.read.parquet(out).count() == 4 and spark.conf.get(ingest.PROVIDER) != ingest.ROCKS


def test_ingest_after_failure(spark, tmp_path):
    """A batch that stops half-way is run again; its keys and those of a later copy are stored once."""
    src, out, state, mark = (str(tmp_path / n) for n in ("in", "out", "state", "mended"))
    for i in range(3):
        spark.range(i * 10, i * 10 + 20).coalesce(1).write.mode("append").parquet(src)

    def careful(batches):
        for b in batches:
            if not os.path.exists(mark) and (b["id"] >= 30).any():
                raise RuntimeError("lost")
            yield b

    run = lambda: ingest.ingest_once(ingest.file_stream(spark, src, spark.range(1).schema, files_per_batch=1), out, state, ["id"], lambda b: b.mapInPandas(careful, "id long"))
    with pytest.raises(Exception, match="lost"):
        run()
    open(mark, "w").close()
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_crop_schema_order():
    assert schemas.CROP.names[0] == "row_key" and schemas.CROP.names[-2:] == ["mask", "cell"] and len(schemas.CROP.names) == 19
    assert schemas.PUBLISHED_CROP.names[-1] == "Metadata_Perturbation"


def test_blob_functions_see_pieces():
    """Few rows are Python objects at once, whatever the Arrow batch; no rows give no rows."""
    seen = []

    def run(x, n):
        seen.append(len(x))
        return pd.DataFrame({"cell": [b * k for b, k in zip(x, n)], "ids": [[k] * k for k in n]})

    kind = pa.struct({"cell": B.BYTES, "ids": B.LONGS})
    whole = B.in_pieces(run, kind)
    n = 2 * B.PIECE + 3
    made = whole(pa.array([b"a"] * n), pa.array([i % 4 for i in range(n)], pa.int32())).to_pylist()
    assert seen == [B.PIECE, B.PIECE, 3]
    assert made == [{"cell": b"a" * (i % 4), "ids": [i % 4] * (i % 4)} for i in range(n)]
    assert whole(pa.array([], pa.binary()), pa.array([], pa.int32())).type == kind
