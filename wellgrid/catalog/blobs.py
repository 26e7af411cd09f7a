"""Image-blob and ingest queries. Images are the embeddings read as 8×8 pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import checks
from ..operators import blobs as B
from ..plans.durable import ensure_checkpoint_dir
from ..streaming import ingest
from . import query
from .views import PIXELS, pack, pixels16, r6, table, v_img

HEX = "string_agg(printf('%02X', {v}), '' ORDER BY {o})"


@query(f"""WITH {PIXELS}, q AS (SELECT fov, quantile_cont(p, 0.001) AS lo, quantile_cont(p, 0.999) AS hi FROM px GROUP BY fov)
SELECT fov, {HEX.format(v="CAST(CASE WHEN hi > lo THEN floor(least(greatest((p - lo) / (hi - lo) * 255.0, 0), 255)) ELSE 0 END AS BIGINT)", o="i")} AS pixels FROM px JOIN q USING (fov) GROUP BY fov""")
def blob_percentile_norm(spark, d):
    return B.normalise_fov(v_img(spark, d)).select("fov", F.hex("pixels").alias("pixels"))


@query(f"WITH {PIXELS} SELECT fov, {HEX.format(v='CAST(floor(p / 257.0) AS BIGINT)', o='i')} AS pixels FROM px GROUP BY fov")
def blob_u16_to_u8(spark, d):
    return B.normalise_fov(v_img(spark, d), scheme="naive").select("fov", F.hex("pixels").alias("pixels"))


def _planes(spark, d):
    """Each embedding as two 4×8 planes."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fov"), F.col("embedding").cast("array<double>").alias("v"))
    half = F.explode(F.array(F.struct(F.lit(0).alias("ch"), F.slice("v", 1, 32).alias("p")), F.struct(F.lit(1).alias("ch"), F.slice("v", 33, 32).alias("p"))))
    x = e.select("fov", half.alias("x")).select("fov", "x.ch", "x.p")
    return x.select("fov", "ch", F.lit(4).alias("h"), F.when((F.col("fov") == 3) & (F.col("ch") == 1), 5).otherwise(8).alias("w"), pack(pixels16("p"), 2).alias("pixels"))


@query(f"""WITH {PIXELS} SELECT fov, CASE WHEN fov = 3 THEN 'shapes differ' END AS problem,
  {HEX.format(v='p & 255', o='i').replace("printf('%02X', p & 255)", "printf('%02X%02X', p & 255, p >> 8)")} AS pixels FROM px GROUP BY fov""")
def stack_channels(spark, d):
    return B.stack_channels(_planes(spark, d), "fov", "ch", "pixels", 2).select("fov", "problem", F.hex("pixels").alias("pixels"))


def _matched(spark, d):
    return B.match_labels(v_img(spark, d))


MATCH = f"""{PIXELS}, nc AS (SELECT fov, nuc, CAST(floor(avg(r)) AS BIGINT) AS r, CAST(floor(avg(c)) AS BIGINT) AS c FROM lab WHERE nuc > 0 GROUP BY ALL),
hit AS (SELECT nc.fov, nc.nuc, lab.cel, row_number() OVER (PARTITION BY nc.fov, lab.cel ORDER BY nc.nuc) AS rn FROM nc JOIN lab ON lab.fov = nc.fov AND lab.r = nc.r AND lab.c = nc.c WHERE lab.cel > 0),
pr AS (SELECT fov, nuc, cel, row_number() OVER (PARTITION BY fov ORDER BY nuc) AS id FROM hit WHERE rn = 1),
ns AS (SELECT pr.fov, pr.id, avg(r) AS nr, avg(c) AS nc, count(*) AS na FROM pr JOIN lab ON lab.fov = pr.fov AND lab.nuc = pr.nuc GROUP BY ALL),
cs AS (SELECT pr.fov, pr.id, avg(r) AS cr, avg(c) AS cc, count(*) AS ca FROM pr JOIN lab ON lab.fov = pr.fov AND lab.cel = pr.cel GROUP BY ALL),
st AS (SELECT pr.fov, pr.id AS id_local, pr.nuc AS nuc_id_global, pr.cel AS cell_id_global, cr, cc, nr, nc, na, ca, count(*) OVER (PARTITION BY pr.fov) AS n
  FROM pr JOIN ns ON ns.fov = pr.fov AND ns.id = pr.id JOIN cs ON cs.fov = pr.fov AND cs.id = pr.id)"""


@query(f"""WITH {MATCH}, m AS (SELECT lab.fov, lab.i, coalesce(a.id, 0) AS n, coalesce(b.id, 0) AS c FROM lab LEFT JOIN pr a ON a.fov = lab.fov AND a.nuc = lab.nuc LEFT JOIN pr b ON b.fov = lab.fov AND b.cel = lab.cel)
SELECT fov, string_agg(printf('%02X', n), '000000' ORDER BY i) || '000000' AS nucleus, string_agg(printf('%02X', c), '000000' ORDER BY i) || '000000' AS cell FROM m GROUP BY fov""")
def match_labels(spark, d):
    return _matched(spark, d).select("fov", F.hex("matched.nucleus").alias("nucleus"), F.hex("matched.cell").alias("cell"))


@query(f"""WITH {MATCH} SELECT fov, id_local, CAST(nuc_id_global AS BIGINT) AS nuc_id_global, CAST(cell_id_global AS BIGINT) AS cell_id_global, round(cr, 6) AS cyto_cent_row, round(cc, 6) AS cyto_cent_col,
  round(nr, 6) AS nuc_cent_row, round(nc, 6) AS nuc_cent_col, na AS nuc_area, ca AS cyto_area, round(na / ca, 6) AS nuc_cyto_ratio, n AS n_cells_in_fov FROM st""")
def cell_stats(spark, d):
    out = B.cell_stats(_matched(spark, d), "fov")
    return out.withColumns({c: r6(c) for c in ("cyto_cent_row", "cyto_cent_col", "nuc_cent_row", "nuc_cent_col", "nuc_cyto_ratio")})


@query(f"""WITH {PIXELS}, edge AS (SELECT DISTINCT fov, lev FROM lab WHERE r IN (0, 7) OR c IN (0, 7))
SELECT fov, string_agg(printf('%02X', CASE WHEN edge.lev IS NULL THEN lab.lev ELSE 0 END), '000000' ORDER BY i) || '000000' AS labels FROM lab LEFT JOIN edge USING (fov, lev) GROUP BY fov""")
def drop_border_labels(spark, d):
    return B.drop_border_labels(v_img(spark, d), "levels", "labels").select("fov", F.hex("labels").alias("labels"))


def _crops(spark, d):
    m = _matched(spark, d)
    fovs = m.select("fov", "c", "h", "w", "pixels", F.concat("matched.nucleus", "matched.cell").alias("labels"))
    return B.extract_crops(B.cell_stats(m, "fov"), fovs, "fov", 4, 8, 8, scheme="naive")


@query(f"""WITH {MATCH}, k AS (SELECT st.*, CAST(floor(cr) AS BIGINT) AS r0, CAST(floor(cc) AS BIGINT) AS c0 FROM st WHERE cr >= 2 AND cr < 6 AND cc >= 2 AND cc < 6),
x AS (SELECT k.fov, k.id_local, lab.r, lab.c, lab.p, CASE WHEN lab.nuc = k.nuc_id_global THEN 255 ELSE 0 END AS mn, CASE WHEN lab.cel = k.cell_id_global THEN 255 ELSE 0 END AS mc
  FROM k JOIN lab ON lab.fov = k.fov AND lab.r BETWEEN k.r0 - 2 AND k.r0 + 1 AND lab.c BETWEEN k.c0 - 2 AND k.c0 + 1)
SELECT fov, id_local, string_agg(printf('%02X', CAST(floor(p / 257.0) AS BIGINT)), '' ORDER BY r, c) AS cell,
  string_agg(printf('%02X', mn), '' ORDER BY r, c) || string_agg(printf('%02X', mc), '' ORDER BY r, c) AS mask FROM x GROUP BY ALL""")
def blob_crop(spark, d):
    return _crops(spark, d).select("fov", "id_local", F.hex("cell").alias("cell"), F.hex("mask").alias("mask"))


@query(f"""WITH {MATCH} SELECT fov, count(*) AS n_cells, count(*) FILTER (NOT (cr >= 2 AND cr < 6 AND cc >= 2 AND cc < 6)) AS n_dropped FROM st GROUP BY fov""")
def border_drops(spark, d):
    return B.border_drops(B.cell_stats(_matched(spark, d), "fov"), "fov", 4, 8, 8)


SHAPE = (2, 4, 8)
SPLIT = f"""{PIXELS}, cell AS (SELECT fov, i, i // 32 AS ch, (i % 32) // 8 AS y, i % 8 AS x, CAST(floor(p / 257.0) AS BIGINT) AS u, v FROM px),
msk AS (SELECT fov, i % 32 AS j, v > CASE WHEN i < 32 THEN 0.05 ELSE -0.05 END AS m, i // 32 AS ch FROM px)"""


def _pair(spark, d):
    """2×4×8 uint8 images with 2×4×8 masks and a count that may be missing."""
    img = B.normalise_fov(v_img(spark, d), scheme="naive", out="cell")
    bits = F.transform("v", lambda x, i: F.when(x > F.when(i < 32, 0.05).otherwise(-0.05), 255).otherwise(0).cast("bigint"))
    count = F.when(F.pmod("fov", F.lit(11)) == 0, F.lit(float("nan"))).otherwise(F.col("fov") * 0.75)
    return img.select("fov", F.lit("w").alias("well"), "cell", pack(bits, 1).alias("mask"), count.alias("n_cells_scaled"))


SEG = """seg AS (SELECT cell.*, CASE WHEN msk.m THEN u ELSE 0 END AS s FROM cell JOIN msk ON msk.fov = cell.fov AND msk.j = cell.i % 32 AND msk.ch = least(cell.ch, 1))"""


@query(f"WITH {SPLIT}, {SEG} SELECT fov, {HEX.format(v='s', o='i')} AS cell FROM seg GROUP BY fov")
def blob_mask(spark, d):
    return B.mask_channels(_pair(spark, d), SHAPE).select("fov", F.hex("cell").alias("cell"))


LEVEL = "CAST(floor(CASE WHEN fov % 11 = 0 THEN 0 ELSE least(fov * 0.75, 255) END) AS BIGINT)"


@query(f"WITH {SPLIT}, {SEG} SELECT fov, {HEX.format(v=f'CASE WHEN y IN (1, 2) AND x IN (1, 6) THEN {LEVEL} ELSE s END', o='i')} AS cell FROM seg GROUP BY fov")
def blob_density(spark, d):
    return B.all_variants(_pair(spark, d), SHAPE, 1, 1)["SD"].select("fov", F.hex("cell").alias("cell"))


@query("""WITH n AS (SELECT vec_id AS id FROM embeddings)
SELECT count(*) FILTER (id % 10 = 1) AS n_missing, count(*) FILTER (id % 10 = 2) AS n_repeated, count(*) FILTER (id % 10 = 3) AS n_metadata_differs, count(*) FILTER (id % 10 = 4) AS n_image_differs FROM n""")
def variant_damage(spark, d):
    """A variant with a tenth of its rows missing, repeated, with other metadata, and with another image."""
    good = _pair(spark, d)
    tenth = lambda i: F.pmod("fov", F.lit(10)) == i
    bad = good.where(~tenth(1)).unionByName(good.where(tenth(2)))
    bad = bad.withColumn("well", F.when(tenth(3), "elsewhere").otherwise(F.col("well")))
    bad = bad.withColumn("cell", F.when(tenth(4), F.unhex(F.repeat(F.lit("FE"), F.octet_length("cell")))).otherwise(F.col("cell")))
    return B.variant_mismatches(good, bad, "fov", ["well", "n_cells_scaled"]).select("n_missing", "n_repeated", "n_metadata_differs", "n_image_differs")


@query("""SELECT 'C-S' AS pair, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_metadata_differs, count(*) AS n_keys FROM embeddings UNION ALL
SELECT 'C-CD', 0, 0, 0, count(*) FROM embeddings UNION ALL SELECT 'S-SD', 0, 0, 0, count(*) FROM embeddings""")
def variant_alignment(spark, d):
    v = B.all_variants(_pair(spark, d), SHAPE, 1, 1)
    out = None
    for a, b in (("C", "S"), ("C", "CD"), ("S", "SD")):
        row = B.variant_mismatches(v[a], v[b], "fov", ["well", "n_cells_scaled"]).withColumn("pair", F.lit(f"{a}-{b}")).drop("n_image_differs")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {PIXELS}, g AS (SELECT fov, CAST(floor(p / 257.0) AS BIGINT) AS u, r, c FROM px), t AS (SELECT y, x, y * 7 / 15.0 AS fy, x * 7 / 15.0 AS fx FROM range(16) a(y), range(16) b(x)),
k AS (SELECT y, x, fy - floor(fy) AS wy, fx - floor(fx) AS wx, CAST(floor(fy) AS BIGINT) AS y0, CAST(floor(fx) AS BIGINT) AS x0, least(CAST(floor(fy) AS BIGINT) + 1, 7) AS y1, least(CAST(floor(fx) AS BIGINT) + 1, 7) AS x1 FROM t),
v AS (SELECT a.fov, y, x, (a.u * (1 - wy) + b.u * wy) * (1 - wx) + (e.u * (1 - wy) + f.u * wy) * wx AS z FROM k JOIN g a ON a.r = y0 AND a.c = x0
  JOIN g b ON b.fov = a.fov AND b.r = y1 AND b.c = x0 JOIN g e ON e.fov = a.fov AND e.r = y0 AND e.c = x1 JOIN g f ON f.fov = a.fov AND f.r = y1 AND f.c = x1)
SELECT fov, string_agg(printf('%02X', CAST(floor(z + 1e-9) AS BIGINT)), '' ORDER BY y, x) AS pixels FROM v GROUP BY fov""")
def blob_resize(spark, d):
    img = B.normalise_fov(v_img(spark, d), scheme="naive")
    return B.resize(img, (1, 8, 8), (16, 16), blob="pixels").select("fov", F.hex("pixels").alias("pixels"))


NEAREST = "g.x = CAST(floor(x.x * 0.5 + 0.5) AS BIGINT) AND g.y = CAST(floor(y.y * 0.5 + 0.5) AS BIGINT)"
TARGET = "range(7) y(y), range(15) x(x)"


@query(f"""WITH {SPLIT}, near AS (SELECT g.fov, g.ch, y.y, x.x, g.u FROM {TARGET}, cell g WHERE {NEAREST})
SELECT fov, {HEX.format(v='u', o='ch, y, x')} AS cell FROM near GROUP BY fov""")
def blob_resize_nearest(spark, d):
    return B.resize(_pair(spark, d), SHAPE, (7, 15), nearest=True).select("fov", F.hex("cell").alias("cell"))


@query(f"""WITH {SPLIT}, near AS (SELECT g.fov, g.ch, y.y, x.x, g.u FROM {TARGET}, cell g WHERE g.ch = 1 AND {NEAREST}),
four AS (SELECT g.fov, g.ch, y.y, x.x, g.u * (1 - abs(y.y * 0.5 - g.y)) * (1 - abs(x.x * 0.5 - g.x)) AS z FROM {TARGET}, cell g WHERE g.ch = 0 AND abs(y.y * 0.5 - g.y) < 1 AND abs(x.x * 0.5 - g.x) < 1),
mixed AS (SELECT * FROM near UNION ALL SELECT fov, ch, y, x, CAST(floor(sum(z) + 1e-9) AS BIGINT) FROM four GROUP BY ALL)
SELECT fov, {HEX.format(v='u', o='ch, y, x')} AS cell FROM mixed GROUP BY fov""")
def blob_resize_mixed(spark, d):
    """An image channel bilinear and a mask channel nearest in one stack."""
    return B.resize(_pair(spark, d), SHAPE, (7, 15), nearest=[1]).select("fov", F.hex("cell").alias("cell"))


@query("SELECT vec_id AS fov, 'w' AS well FROM embeddings")
def columns_without_blobs(spark, d):
    pair = _pair(spark, d).drop("n_cells_scaled")
    return pair.select(*checks.non_binary_columns(pair))


@query("""SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, CAST(512 AS BIGINT) AS expected FROM documents WHERE octet_length(encode(text)) <> 512""")
def blob_size_violations(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("blob"))
    return checks.blob_size_violations(docs, "blob", (2, 16, 16), "doc_id")


CHANNEL_MEANS = f"""WITH {SPLIT}, m AS (SELECT fov, ch, avg(u) / 255.0 AS m FROM cell GROUP BY ALL), n AS (SELECT fov, sqrt(sum(m * m)) AS n FROM m GROUP BY fov)
SELECT fov, ch AS pos, round(m / n, 4) AS value FROM m JOIN n USING (fov)"""


@query(CHANNEL_MEANS)
def batch_inference(spark, d):
    e = B.embed(_pair(spark, d), SHAPE, "channel_mean").select("fov", F.posexplode("embedding").alias("pos", "value"))
    return e.select("fov", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value").cast("double"), 4).alias("value"))


@query(f"""WITH {SPLIT}, r AS (SELECT cell.fov, CASE msk.ch WHEN 0 THEN 'Nuclei' ELSE 'Cells' END AS part, cell.ch, u FROM cell JOIN msk ON msk.fov = cell.fov AND msk.j = cell.i % 32 WHERE msk.m),
s AS (SELECT fov, part, ch, count(*) AS a, avg(u) AS mean, stddev_pop(u) AS std, min(u) AS mn, max(u) AS mx FROM r GROUP BY ALL)
SELECT fov, part || '_AreaShape_Area' AS feature, CAST(a AS DOUBLE) AS value FROM s WHERE ch = 0 UNION ALL SELECT fov, part || '_Intensity_Mean_' || ch, round(mean, 6) FROM s
UNION ALL SELECT fov, part || '_Intensity_Std_' || ch, round(std, 6) FROM s UNION ALL SELECT fov, part || '_Intensity_Min_' || ch, mn FROM s UNION ALL SELECT fov, part || '_Intensity_Max_' || ch, mx FROM s""")
def featurise(spark, d):
    f = B.featurise(_pair(spark, d), SHAPE, measures=[B.intensity]).select("fov", F.explode_outer("features").alias("feature", "value"))  # outer: an inner one calls the functions twice
    return f.select("fov", "feature", r6("value").alias("value")).where("value is not null")


@query("SELECT event_id, event_type, user_id FROM events")
def ingest_once(spark, d):
    """Two runs of the incremental job store every event exactly once."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()  # shared by all executors, however it was set
    out, state = (f"{base}/ingest-{uuid.uuid4().hex}-{part}" for part in ("out", "state"))
    schema = table(spark, d, "events").schema
    for _ in range(2):
        ingest.ingest_once(ingest.file_stream(spark, d, schema, "events.parquet"), out, state, ["event_id"])
    return spark.read.parquet(out).select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type, user_id FROM events")
def ingest_replayed(spark, d):
    """Files that repeat stored events, once in a run of their own and once beside each other, add nothing."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/replayed-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    for landed in (events.where("value < 50"), events, events):
        landed.write.mode("append").parquet(f"{base}/in")
        stream = ingest.file_stream(spark, f"{base}/in", events.schema, files_per_batch=2)
        ingest.ingest_once(stream, f"{base}/out", f"{base}/state", ["event_id"])
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type", "user_id")


@query(CHANNEL_MEANS)
def stream_inference(spark, d):
    """Images land as files and are embedded one micro-batch per file; a second start finds nothing to do."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/inference-{uuid.uuid4().hex}"
    landed = _pair(spark, d).select("fov", "cell")
    landed.repartition(4, "fov").write.parquet(f"{base}/in")
    embed = lambda batch: B.embed(batch, SHAPE, "channel_mean").drop("cell")
    for _ in range(2):
        stream = ingest.file_stream(spark, f"{base}/in", landed.schema, files_per_batch=1)
        ingest.ingest_once(stream, f"{base}/out", f"{base}/state", ["fov"], embed)
    e = spark.read.parquet(f"{base}/out").select("fov", F.posexplode("embedding").alias("pos", "value"))
    return e.select("fov", F.col("pos").cast("bigint").alias("pos"), r6(F.col("value").cast("double"), 4).alias("value"))
