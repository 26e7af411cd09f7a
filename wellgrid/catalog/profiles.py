"""Pooling, retrieval, replicate, integration, correction and probe queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import correct, integration, pooling, probe, profiles, replicate, retrieval
from ..plans.durable import checkpoint
from ..plans.linalg import mean_vector
from . import query
from .views import CELL, DIM, VEC, r6, table, v_cell, v_vec


def _tidy(df, keys, vec, digits=6):
    flat = df.select(*keys, F.posexplode(vec).alias("pos", "value"))
    return flat.select(*keys, F.col("pos").cast("bigint").alias("pos"), r6(F.col("value").cast("double"), digits).alias("value"))


def _cell_vec(spark, d):
    vec = F.array(F.col("nuc_area").cast("double"), F.col("cyto_area"), F.col("nuc_cyto_ratio"))
    return v_cell(spark, d).withColumn("vec", vec)


FIELDS_SQL = "(VALUES (0), (1), (2)) f(pos)"
PICK = "CASE pos WHEN 0 THEN nuc_area WHEN 1 THEN cyto_area ELSE nuc_cyto_ratio END"


# -- pooling ---------------------------------------------------------------------------


@query(f"""WITH {CELL}, g AS (SELECT source, plate, well, count(*) AS n_cells, arg_min(inchikey, row_key) FILTER (inchikey IS NOT NULL) AS inchikey FROM v_cell GROUP BY ALL),
m AS (SELECT source, plate, well, pos, round(avg({PICK}), 8) AS value FROM v_cell, {FIELDS_SQL} GROUP BY ALL)
SELECT source, plate, well, n_cells, inchikey, CAST(pos AS BIGINT) AS pos, value FROM g JOIN m USING (source, plate, well)""")
def well_mean(spark, d):
    wells = pooling.well_mean(_cell_vec(spark, d), ["source", "plate", "well"], "vec", ["inchikey"], order=["row_key"], dim=3)
    return _tidy(wells, ["source", "plate", "well", "n_cells", "inchikey"], "vec", 8)


@query(f"""WITH {CELL} SELECT source, plate, well, CAST(pos AS BIGINT) AS pos, round(median({PICK}), 6) AS value FROM v_cell, {FIELDS_SQL} GROUP BY ALL""")
def well_median(spark, d):
    return _tidy(pooling.well_median(_cell_vec(spark, d), ["source", "plate", "well"], "vec"), ["source", "plate", "well"], "vec")


@query(f"""WITH {VEC}, g AS (SELECT batch, plate, perturbation, is_control, count(*) AS n_wells FROM v_vec GROUP BY ALL),
m AS (SELECT batch, plate, perturbation, is_control, i AS pos, round(avg(vec[i + 1]), 6) + 0.0 AS value FROM v_vec, range(64) t(i) GROUP BY ALL)
SELECT g.*, pos, value FROM g JOIN m USING (batch, plate, perturbation, is_control)""")
def consensus_profile(spark, d):
    keys = ["batch", "plate", "perturbation", "is_control"]
    return _tidy(pooling.consensus(v_vec(spark, d), keys, "vec"), [*keys, "n_wells"], "vec")


@query(f"""WITH {VEC}, g AS (SELECT perturbation, count(*) AS n FROM v_vec GROUP BY ALL),
m AS (SELECT perturbation, i AS pos, round(avg(vec[i + 1]), 6) + 0.0 AS value FROM v_vec, range(64) t(i) GROUP BY ALL)
SELECT g.*, pos, value FROM g JOIN m USING (perturbation)""")
def prototypes(spark, d):
    return _tidy(pooling.prototypes(v_vec(spark, d), "perturbation", "vec"), ["perturbation", "n"], "prototype")


@query(f"""WITH {VEC} SELECT id AS key, batch, c_acctbal AS target FROM v_vec JOIN customer ON id = c_custkey""")
def aligned_profiles(spark, d):
    target = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("target"))
    out = pooling.aligned(v_vec(spark, d).withColumnRenamed("id", "key"), target, ["key"])
    return out.select(F.col("key").cast("bigint").alias("key"), "batch", "target")


@query("""SELECT p_partkey AS key, vec_id IS NOT NULL AS present, CAST(CASE WHEN vec_id IS NULL THEN 64 ELSE 0 END AS BIGINT) AS n_nan FROM part LEFT JOIN embeddings ON p_partkey = vec_id""")
def key_reassembly(spark, d):
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    parts = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    out = pooling.reassembled(keys, parts, "key", "vec", DIM)
    return out.select("key", "present", F.size(F.filter("vec", F.isnan)).cast("bigint").alias("n_nan"))


@query(f"""WITH {VEC}, p AS (SELECT perturbation AS key, list_transform(range(64), lambda i: 0) AS z, perturbation FROM v_vec GROUP BY perturbation),
m AS (SELECT perturbation AS key, i AS pos, avg(vec[i + 1]) AS value FROM v_vec, range(64) t(i) GROUP BY ALL),
l AS (SELECT key, pos, value FROM m UNION ALL SELECT 'EMPTY', pos, avg(value) FROM m GROUP BY pos),
q AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'EMPTY' ELSE CAST(doc_id % 10 AS VARCHAR) END AS key FROM documents)
SELECT doc_id, key, pos, round(value, 6) + 0.0 AS value FROM q JOIN l USING (key)""")
def lookup_embeddings(spark, d):
    protos = checkpoint(pooling.prototypes(v_vec(spark, d), "perturbation", "vec"))
    lookup = pooling.load_lookup(protos, "perturbation", "prototype", control="EMPTY")
    key = F.when(F.col("lang") == "de", "EMPTY").otherwise(F.pmod("doc_id", F.lit(10)).cast("string"))
    docs = table(spark, d, "documents").select("doc_id", key.alias("key"))
    return _tidy(pooling.attach_lookup(docs, lookup, "key"), ["doc_id", "key"], "vector")


@query(f"""WITH {CELL}, picked AS (SELECT DISTINCT source, plate, well FROM v_cell WHERE perturbation = 'Brand#5' AND nuc_area > 30)
SELECT source, plate, well, count(*) AS n FROM v_cell v WHERE EXISTS (SELECT 1 FROM picked p WHERE p.source = v.source AND p.plate = v.plate AND p.well = v.well) GROUP BY ALL""")
def picked_wells(spark, d):
    from ..operators.metadata import restrict_to

    cells = v_cell(spark, d).select("source", "plate", "well", "perturbation", "nuc_area")
    out = restrict_to(cells, cells.where("perturbation = 'Brand#5' and nuc_area > 30"))
    return out.groupBy("source", "plate", "well").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id AS id, i AS pos, round(ln(1 + abs(CAST(embedding[i + 1] AS DOUBLE))), 6) + 0.0 AS value FROM embeddings, range(64) t(i)""")
def log1p_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.log1p(F.transform(V.to_double("embedding"), F.abs)).alias("v"))
    return _tidy(e, ["id"], "v")


# -- retrieval -------------------------------------------------------------------------


def _recall_sql(gallery: str) -> str:
    rates = ", ".join(f"round(avg(CASE WHEN hit <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in range(1, 11))
    return f"""WITH {VEC}, w AS (SELECT * FROM v_vec WHERE NOT is_control),
s AS (SELECT q.id, q.perturbation AS qp, g.perturbation AS gp, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.unit, g.unit) DESC, g.id) AS rn
  FROM w q JOIN w g ON q.id <> g.id WHERE q.batch = '0' AND {gallery}),
h AS (SELECT id, qp AS perturbation, min(rn) FILTER (qp = gp AND rn <= 10) AS hit FROM s GROUP BY ALL),
per AS (SELECT perturbation, count(*) AS n_query_wells, {rates} FROM h GROUP BY perturbation)
"""


def _hits(spark, d, across: bool):
    held = F.col("batch") == "0"
    return retrieval.first_hits(v_vec(spark, d), held, ~held if across else held, "id", "vec", "perturbation", F.col("is_control"), DIM)


def _rounded(df):
    return df.withColumns({c: r6(c) for c in df.columns if c.startswith(("recall", "micro", "macro"))})


@query(_recall_sql("g.batch <> '0'") + "SELECT * FROM per")
def recall_across(spark, d):
    return _rounded(retrieval.recall_at_k(_hits(spark, d, True), "perturbation"))


@query(_recall_sql("g.batch = '0'") + "SELECT * FROM per")
def recall_within(spark, d):
    return _rounded(retrieval.recall_at_k(_hits(spark, d, False), "perturbation"))


_MACRO = ", ".join(f"round(avg(recall_at_{k}), 5) AS recall_at_{k}" for k in range(1, 11))


@query(_recall_sql("g.batch <> '0'") + f"SELECT 'across_batch' AS recall_type, count(*) AS n_perturbations, CAST(sum(n_query_wells) AS BIGINT) AS n_query_wells, {_MACRO} FROM per")
def recall_macro(spark, d):
    per = retrieval.recall_at_k(_hits(spark, d, True), "perturbation")
    out = retrieval.macro_recall(per, tags={"recall_type": "across_batch"})
    return out.withColumns({c: r6(c, 5) for c in out.columns if c.startswith("recall_at")})


PROTO = f"""{VEC}, pm AS (SELECT perturbation, i, avg(vec[i + 1]) AS value FROM v_vec, range(64) t(i) GROUP BY ALL),
pv AS (SELECT perturbation, list(value ORDER BY i) AS p FROM pm GROUP BY perturbation),
proto AS (SELECT perturbation, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS unit FROM pv)"""


def _rates_sql(ks=(1, 5)):
    return ", ".join(f"round(sum(h{k}) / sum(n), 6) AS micro_at_{k}, round(avg(h{k} / n), 6) AS macro_at_{k}" for k in ks)


@query(f"""WITH {PROTO}, s AS (SELECT q.id, q.perturbation AS cls, g.perturbation AS gp, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.unit, g.unit) DESC, g.perturbation) AS rn FROM v_vec q, proto g),
h AS (SELECT cls, rn AS hit FROM s WHERE cls = gp), per AS (SELECT cls, count(*) AS n, count(*) FILTER (hit <= 1) AS h1, count(*) FILTER (hit <= 5) AS h5 FROM h GROUP BY cls)
SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_queries, {_rates_sql()} FROM per""")
def retrieval_i2p(spark, d):
    wells = v_vec(spark, d)
    protos = pooling.prototypes(wells, "perturbation", "vec")
    hits = retrieval.class_hits(wells, protos, "perturbation", "perturbation", "vec", "prototype", "id", DIM, 5)
    return _rounded(retrieval.hit_rates(hits, [1, 5]))


@query(f"""WITH {PROTO}, ctl AS (SELECT perturbation, i, avg(vec[i + 1]) AS value FROM v_vec, range(64) t(i) WHERE batch IN ('0', '1') GROUP BY ALL),
cv AS (SELECT perturbation, list(value ORDER BY i) AS p FROM ctl GROUP BY perturbation), q AS (SELECT perturbation, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS unit FROM cv),
s AS (SELECT q.perturbation AS cls, g.perturbation AS gp, row_number() OVER (PARTITION BY q.perturbation ORDER BY list_dot_product(q.unit, g.unit) DESC, g.perturbation) AS rn FROM q, proto g),
h AS (SELECT cls, rn AS hit FROM s WHERE cls = gp), per AS (SELECT cls, count(*) AS n, count(*) FILTER (hit <= 1) AS h1, count(*) FILTER (hit <= 5) AS h5 FROM h GROUP BY cls)
SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_queries, {_rates_sql()} FROM per""")
def retrieval_p2i(spark, d):
    wells = v_vec(spark, d)
    images = pooling.prototypes(wells, "perturbation", "vec")
    perts = pooling.prototypes(wells.where("batch in ('0', '1')"), "perturbation", "vec")
    hits = retrieval.class_hits(perts, images, "perturbation", "perturbation", "prototype", "prototype", "perturbation", DIM, 5)
    return _rounded(retrieval.hit_rates(hits, [1, 5]))


@query("""WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS bits FROM embeddings),
n AS (SELECT *, list_sum(bits) AS n FROM b),
s AS (SELECT a.id AS q_id, g.id AS g_id, list_dot_product(a.bits, g.bits) AS inter, a.n AS na, g.n AS nb FROM n a JOIN n g ON a.id <> g.id),
t AS (SELECT q_id, g_id, CASE WHEN na + nb - inter > 0 THEN inter / (na + nb - inter) ELSE 0 END AS sim FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, g_id) AS rank FROM t)
SELECT q_id, g_id, round(sim, 6) AS sim, rank, round(power((sim - 0.2) / (0.8 + 1e-8), 2) * 0.5, 6) AS weight FROM r WHERE rank <= 5 AND sim >= 0.2""")
def tanimoto_topk(spark, d):
    e = table(spark, d, "embeddings")
    out = retrieval.tanimoto_topk(e, "vec_id", "embedding", 5, DIM, min_sim=0.2, gamma=2.0, scale=0.5)
    return out.select("q_id", "g_id", r6("sim").alias("sim"), F.col("rank").cast("bigint").alias("rank"), r6("weight").alias("weight"))


# -- replicate scores ------------------------------------------------------------------


AP = f"""{VEC}, w AS (SELECT * FROM v_vec),
pairs AS (SELECT q.id, q.perturbation, 1 AS pos, round(list_dot_product(q.unit, g.unit), 12) AS sim FROM w q JOIN w g ON q.perturbation = g.perturbation AND q.id <> g.id
    AND (q.batch <> g.batch OR q.plate <> g.plate) WHERE NOT q.is_control UNION ALL
  SELECT q.id, q.perturbation, 0, round(list_dot_product(q.unit, g.unit), 12) FROM w q JOIN w g ON q.batch = g.batch AND q.plate = g.plate AND q.id <> g.id WHERE NOT q.is_control),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, pos DESC) AS rk, sum(pos) OVER (PARTITION BY id ORDER BY sim DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS cp FROM pairs),
ap AS (SELECT id, perturbation, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(1 - pos) AS BIGINT) AS n_neg, avg(CASE WHEN pos = 1 THEN cp / rk END) AS ap FROM ranked GROUP BY ALL)"""


def _ap(spark, d):
    return replicate.average_precision(v_vec(spark, d), "id", "vec", "perturbation", ["batch", "plate"], F.col("is_control"), DIM)


@query(f"WITH {AP} SELECT id, perturbation, n_pos, n_neg, round(ap, 6) AS ap FROM ap")
def average_precision(spark, d):
    return _ap(spark, d).withColumn("ap", r6("ap"))


AP_ALL = AP.replace("q.batch <> g.batch OR q.plate <> g.plate", "q.batch <> g.batch AND q.plate <> g.plate")
AP_CONTROLS = AP.replace("AND q.id <> g.id WHERE NOT q.is_control),", "AND q.id <> g.id AND g.is_control WHERE NOT q.is_control),")


@query(f"WITH {AP_ALL} SELECT id, perturbation, n_pos, n_neg, round(ap, 6) AS ap FROM ap")
def average_precision_all(spark, d):
    """Positives differ in every plate column."""
    out = replicate.average_precision(v_vec(spark, d), "id", "vec", "perturbation", ["batch", "plate"], F.col("is_control"), DIM, diff_mode="all")
    return out.withColumn("ap", r6("ap"))


@query(f"WITH {AP_CONTROLS} SELECT id, perturbation, n_pos, n_neg, round(ap, 6) AS ap FROM ap")
def average_precision_controls(spark, d):
    """Negatives are the plate's controls only."""
    out = replicate.average_precision(v_vec(spark, d), "id", "vec", "perturbation", ["batch", "plate"], F.col("is_control"), DIM, negatives="controls")
    return out.withColumn("ap", r6("ap"))


@query(f"WITH {AP} SELECT perturbation, count(*) AS n_queries, round(avg(ap), 6) AS mean_ap FROM ap WHERE ap IS NOT NULL GROUP BY perturbation")
def map_per_perturbation(spark, d):
    return replicate.map_per_perturbation(_ap(spark, d), "perturbation").withColumn("mean_ap", r6("mean_ap"))


@query("""WITH p AS (SELECT event_id, value / 1000.0 AS p FROM events), r AS (SELECT *, rank() OVER (ORDER BY p DESC) AS down, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS up FROM p)
SELECT event_id, round(least(min(p * m / up) OVER (ORDER BY p DESC), 1.0), 6) AS corrected_p_value FROM r""")
def bh_adjust(spark, d):
    p = table(spark, d, "events").select("event_id", (F.col("value") / 1000.0).alias("p"))
    return replicate.bh_adjust(p, "p").select("event_id", r6("corrected_p_value").alias("corrected_p_value"))


def _mixed(name: str, columns: str, h: str, source: str) -> str:
    """A common table expression with the scattered 32-bit number of ``h`` under ``name``."""
    a, b = replicate.MIX
    h0, h1, h2 = (f"{name}_{i}" for i in range(3))
    return f"""(SELECT {columns}, CAST({h} AS UBIGINT) AS {h0}, xor({h0}, {h0} >> 16) * CAST({a} AS UBIGINT) % 4294967296 AS {h1},
  xor({h1}, {h1} >> 13) * CAST({b} AS UBIGINT) % 4294967296 AS {h2}, xor({h2}, {h2} >> 16) AS {name} FROM {source})"""


@query(f"""WITH RECURSIVE {AP}, scored AS (SELECT * FROM ap WHERE ap IS NOT NULL), cfg AS (SELECT DISTINCT n_pos, n_neg FROM scored),
k1 AS {_mixed("a", "n_pos, n_neg", f"xor({replicate.SEED}, n_pos)", "cfg")}, k2 AS {_mixed("b", "n_pos, n_neg", "xor(a, CAST(n_pos + n_neg AS UBIGINT))", "k1")},
k3 AS {_mixed("key", "n_pos, n_neg, i", "xor(b, CAST(i AS UBIGINT))", f"k2, range({replicate.NULL_SIZE}) x(i)")},
steps AS {_mixed("g", "t", "t + 1", "range((SELECT max(n_pos + n_neg) FROM cfg)) x(t)")},
walk AS (SELECT n_pos, n_neg, i, key, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS seen, CAST(0 AS DOUBLE) AS total FROM k3 UNION ALL
  SELECT n_pos, n_neg, i, key, t + 1, seen + hit, total + CASE WHEN hit = 1 THEN (seen + 1) / (t + 1) ELSE 0 END FROM (
    SELECT *, CAST(CAST(u AS BIGINT) * (n_pos + n_neg - t) < (n_pos - seen) * 4294967296 AS BIGINT) AS hit FROM
      {_mixed("u", "w.*", "xor(w.key, s.g)", "walk w JOIN steps s ON s.t = w.t WHERE w.t < w.n_pos + w.n_neg")})),
nulls AS (SELECT n_pos, n_neg, i, total / n_pos AS x FROM walk WHERE t = n_pos + n_neg),
shapes AS (SELECT perturbation, n_pos, n_neg, count(*) AS w FROM scored GROUP BY ALL),
mixed AS (SELECT perturbation, i, sum(x * w) / sum(w) AS x FROM shapes JOIN nulls USING (n_pos, n_neg) GROUP BY ALL),
maps AS (SELECT perturbation, count(*) AS n_queries, avg(ap) AS mean_ap FROM scored GROUP BY ALL),
p AS (SELECT perturbation, n_queries, mean_ap, (count_if(round(x, 12) > round(mean_ap, 12)) + 1) / {replicate.NULL_SIZE + 1} AS p FROM maps JOIN mixed USING (perturbation) GROUP BY ALL),
r AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS up FROM p),
c AS (SELECT *, least(min(p * m / up) OVER (ORDER BY p DESC), 1.0) AS corrected FROM r)
SELECT perturbation, n_queries, round(mean_ap, 6) AS mean_ap, round(p, 6) AS p_value, round(corrected, 6) AS corrected_p_value,
  p < {replicate.THRESHOLD} AS below_p, corrected < {replicate.THRESHOLD} AS below_corrected_p FROM c""")
def map_significance(spark, d):
    out = replicate.significance(_ap(spark, d), "perturbation")
    return out.withColumns({c: r6(c) for c in ("mean_ap", "p_value", "corrected_p_value")})


# -- integration scores ------------------------------------------------------------------


CONT = """c AS (SELECT CAST(label AS VARCHAR) AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY ALL), t AS (SELECT sum(n) AS N FROM c),
ra AS (SELECT a, sum(n) AS n FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
s AS (SELECT N, (SELECT sum(n * ln(n)) FROM c) AS l0, (SELECT sum(n * ln(n)) FROM ra) AS l1, (SELECT sum(n * ln(n)) FROM rb) AS l2,
  (SELECT sum(n * (n - 1) / 2) FROM c) AS p0, (SELECT sum(n * (n - 1) / 2) FROM ra) AS p1, (SELECT sum(n * (n - 1) / 2) FROM rb) AS p2 FROM t)"""


@query(f"""WITH {CONT} SELECT round((ln(N) + (l0 - l1 - l2) / N) / ((ln(N) - l1 / N + ln(N) - l2 / N) / 2), 6) AS nmi,
  round((p0 - p1 * p2 / (N * (N - 1) / 2)) / ((p1 + p2) / 2 - p1 * p2 / (N * (N - 1) / 2)), 6) AS ari FROM s""")
def contingency_scores(spark, d):
    e = table(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).alias("cluster"))
    return integration.clustering_agreement(e, "label", "cluster").select(r6("nmi").alias("nmi"), r6("ari").alias("ari"))


@query()
def kmeans_scores(spark, d):
    wells = v_vec(spark, d)
    out = integration.clustering_agreement(integration.kmeans_clusters(wells, "vec", 10), "perturbation", "cluster")
    return out.select(r6("nmi").alias("nmi"), r6("ari").alias("ari"))


DIST = f"""{VEC}, dd AS (SELECT q.id, q.perturbation AS own, g.perturbation AS other, q.batch AS qb, g.batch AS gb,
  sqrt(list_sum(list_transform(list_zip(q.vec, g.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d, 1 - list_dot_product(q.unit, g.unit) AS cd FROM v_vec q JOIN v_vec g ON q.id <> g.id)"""


@query(f"""WITH {DIST}, m AS (SELECT id, own, other, avg(d) AS d FROM dd GROUP BY ALL),
s AS (SELECT id, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM m GROUP BY id)
SELECT round((avg((b - a) / greatest(a, b)) + 1) / 2, 6) AS silhouette_label FROM s""")
def silhouette_label(spark, d):
    return integration.silhouette_label(v_vec(spark, d), "id", "vec", "perturbation", DIM).select(r6("silhouette_label").alias("silhouette_label"))


@query(f"""WITH {DIST}, nb AS (SELECT perturbation AS own, count(DISTINCT batch) AS nb FROM v_vec GROUP BY ALL),
s AS (SELECT id, own, avg(d) FILTER (own = other) AS a, avg(d) FILTER (own <> other) AS b FROM dd GROUP BY ALL),
p AS (SELECT own, (avg((b - a) / greatest(a, b)) + 1) / 2 AS x FROM s WHERE own IN (SELECT own FROM nb WHERE nb = (SELECT min(nb) FROM nb)) GROUP BY own)
SELECT count(*) AS n_isolated, round(avg(x), 6) AS isolated_labels FROM p""")
def isolated_labels(spark, d):
    out = integration.isolated_labels(v_vec(spark, d), "id", "vec", "perturbation", "batch", DIM)
    return out.withColumn("isolated_labels", r6("isolated_labels"))


@query(f"""WITH {DIST}, s AS (SELECT id, own, qb, avg(cd) FILTER (qb = gb) AS a, avg(cd) FILTER (qb <> gb) AS b FROM dd WHERE own = other GROUP BY ALL),
x AS (SELECT own, 1 - abs(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS x, qb FROM s),
p AS (SELECT own, avg(x) AS x FROM x GROUP BY own HAVING count(DISTINCT qb) > 1) SELECT round(avg(x), 6) AS bras FROM p""")
def bras(spark, d):
    return integration.bras(v_vec(spark, d), "id", "vec", "perturbation", "batch", DIM).select(r6("bras").alias("bras"))


@query(f"""WITH {DIST}, k AS (SELECT own, count(*) AS total, count(DISTINCT qb) AS nb FROM (SELECT DISTINCT id, own, qb FROM dd) GROUP BY own),
kk AS (SELECT own, total, nb, least(70, greatest(10, floor(total / nb / 4)), total - 1) AS k FROM k),
sh AS (SELECT own, qb AS b, count(DISTINCT id) AS nbatch FROM dd GROUP BY ALL),
nn AS (SELECT id, own, gb, row_number() OVER (PARTITION BY id ORDER BY round(d, 10), gid) AS rk FROM (SELECT q.id, q.perturbation AS own, g.batch AS gb, g.id AS gid,
  sqrt(list_sum(list_transform(list_zip(q.vec, g.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v_vec q JOIN v_vec g ON q.perturbation = g.perturbation AND q.id <> g.id)),
o AS (SELECT nn.id, nn.own, kk.k, kk.nb, kk.total, gb, count(*) AS o FROM nn JOIN kk ON nn.own = kk.own WHERE rk <= kk.k GROUP BY ALL),
x AS (SELECT o.id, o.own, any_value(o.k) AS k, sum(o.o * o.o / (o.k * sh.nbatch / o.total)) - any_value(o.k) AS x2 FROM o JOIN sh ON sh.own = o.own AND sh.b = o.gb GROUP BY o.id, o.own)
SELECT own AS perturbation, CAST(max(k) AS BIGINT) AS k, count(*) AS n, round(avg(CASE WHEN exp(-x2 / 2) * (1 + x2 / 2) >= 0.05 THEN 1.0 ELSE 0.0 END), 6) AS kbet FROM x GROUP BY own""")
def kbet_per_label(spark, d):
    out = integration.kbet_per_label(v_vec(spark, d), "id", "vec", "perturbation", "batch", DIM)
    return out.withColumn("kbet", r6("kbet"))


@query()
def lisi_scores(spark, d):
    out = integration.lisi_scores(v_vec(spark, d), "id", "vec", "perturbation", "batch", DIM, k=90)
    return out.select(r6("clisi").alias("clisi"), r6("ilisi").alias("ilisi"))


@query(f"""WITH RECURSIVE {VEC}, nn AS (SELECT q.id, q.perturbation AS qp, g.id AS gid, g.perturbation AS gp, row_number() OVER (PARTITION BY q.id ORDER BY
  round(sqrt(list_sum(list_transform(list_zip(q.vec, g.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 10), g.id) AS rk FROM v_vec q JOIN v_vec g ON q.id <> g.id),
e AS (SELECT id AS u, gid AS v FROM nn WHERE rk <= 15 AND qp = gp UNION SELECT gid, id FROM nn WHERE rk <= 15 AND qp = gp),
reach AS (SELECT id AS u, id AS v FROM v_vec UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
comp AS (SELECT u, min(v) AS c FROM reach GROUP BY u), sz AS (SELECT perturbation, c, count(*) AS n FROM comp JOIN v_vec ON id = u GROUP BY ALL),
per AS (SELECT perturbation, max(n) / sum(n) AS share FROM sz GROUP BY perturbation) SELECT round(avg(share), 6) AS graph_connectivity FROM per""")
def graph_connectivity(spark, d):
    out = integration.graph_connectivity(v_vec(spark, d), "id", "vec", "perturbation", DIM)
    return out.select(r6("graph_connectivity").alias("graph_connectivity"))


PCR = """SELECT sum(bss) / sum(tss) AS r2 FROM (SELECT i, sum(n * (m - gm) * (m - gm)) AS bss, any_value(tss) AS tss FROM
  (SELECT i, batch, count(*) AS n, avg(x) AS m FROM {t} GROUP BY ALL) JOIN (SELECT i, avg(x) AS gm, var_pop(x) * count(*) AS tss FROM {t} GROUP BY i) USING (i) GROUP BY i)"""


@query(f"""WITH {VEC}, a AS (SELECT batch, i, vec[i + 1] AS x FROM v_vec, range(64) t(i)),
mb AS (SELECT batch, i, avg(x) AS m FROM a GROUP BY ALL), b AS (SELECT a.batch, a.i, a.x - 0.5 * m AS x FROM a JOIN mb USING (batch, i)),
ra AS ({PCR.format(t='a')}), rb AS ({PCR.format(t='b')})
SELECT round(ra.r2, 6) AS r2_pre, round(rb.r2, 6) AS r2_post, round(greatest((ra.r2 - rb.r2) / ra.r2, 0.0), 6) AS pcr_comparison FROM ra, rb""")
def pcr_comparison(spark, d):
    wells = v_vec(spark, d).withColumn("vec", V.to_double("vec"))
    means = pooling.consensus(wells, ["batch"], "vec", "m").select("batch", "m")
    half = wells.join(means, "batch").withColumn("post", F.zip_with("vec", "m", lambda x, m: x - m * 0.5))
    out = integration.pcr_comparison(half, "vec", "post", "batch")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal / 10000 AS x, c_nationkey / 25 AS y FROM customer)
SELECT id, round((x + y + 0.1 + 0.2 + 0.3) / 5, 6) + 0.0 AS batch_correction, round((x + y + 0.4 + 0.5 + 0.6) / 5, 6) + 0.0 AS bio_conservation,
  round(0.4 * (x + y + 0.1 + 0.2 + 0.3) / 5 + 0.6 * (x + y + 0.4 + 0.5 + 0.6) / 5, 6) + 0.0 AS total FROM s""")
def composite_score(spark, d):
    x, y = F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25
    values = dict(zip(integration.BATCH_TERMS, (x, y, F.lit(0.1), F.lit(0.2), F.lit(0.3)))) | dict(zip(integration.BIO_TERMS, (x, y, F.lit(0.4), F.lit(0.5), F.lit(0.6))))
    scored = integration.composites(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *[v.alias(k) for k, v in values.items()]))
    return scored.select("id", *[r6(c).alias(c) for c in ("batch_correction", "bio_conservation", "total")])


@query()
def integration_report(spark, d):
    """All scores of one embedding and their composites."""
    return integration.full_report(v_vec(spark, d), "id", "vec", "perturbation", "batch", DIM)


# -- correction --------------------------------------------------------------------------


@query(f"""WITH {VEC}, x AS (SELECT id, is_control, i AS pos, vec[i + 1] AS x FROM v_vec, range(64) t(i)), m AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE is_control GROUP BY pos)
SELECT id, pos, round((x - m) / s, 5) + 0.0 AS value FROM x JOIN m USING (pos)""")
def standard_scale(spark, d):
    return _tidy(correct.standard_scale(v_vec(spark, d), "vec", F.col("is_control")), ["id"], "scaled", 5)


@query()
def sphere(spark, d):
    return _tidy(correct.sphere(v_vec(spark, d), "vec", F.col("perturbation") != "1", "ZCA-cor"), ["id"], "sphered", 4)


@query()
def pca(spark, d):
    return _tidy(correct.principal_components(v_vec(spark, d), "vec"), ["id"], "pca", 4)


# the copied features tie with their originals, of which the first goes; no other pair exceeds 0.9
@query(f"""WITH {VEC}, e AS (SELECT id, list_concat(vec, list_transform(vec[1:8], lambda x: x * 2)) AS v FROM v_vec)
SELECT id, i AS pos, round(v[i + 9], 6) + 0.0 AS value FROM e, range(64) t(i)""")
def correlation_filter(spark, d):
    wells = v_vec(spark, d)
    doubled = wells.withColumn("vec", F.concat(V.to_double("vec"), F.transform(F.slice("vec", 1, 8), lambda x: x * 2.0)))
    kept = correct.correlated_features(doubled, "vec", 0.9)
    return _tidy(correct.keep_positions(doubled, "vec", kept), ["id"], "vec")


@query()
def harmony(spark, d):
    wells = v_vec(spark, d)
    shifted = wells.withColumn("vec", F.transform("vec", lambda x: x.cast("double") + F.col("batch").cast("double") * 0.05))
    return _tidy(correct.harmony(shifted, "vec", "batch", "id", max_rounds=100), ["id"], "harmony", 4)


@query(f"""WITH {VEC}, s AS (SELECT id, batch, list_transform(vec, lambda x: x + CAST(batch AS DOUBLE) * 0.5) AS v FROM v_vec),
u AS (SELECT batch, i, v[i + 1] AS x FROM s, range(64) t(i)), a AS (SELECT i, avg(x) AS m FROM u GROUP BY ALL), b AS (SELECT batch, i, avg(x) AS x, count(*) AS n FROM u GROUP BY ALL)
SELECT batch, n, round(sqrt(sum((x - m) * (x - m))), 6) AS gap_before, TRUE AS closer FROM b JOIN a USING (i) GROUP BY ALL""")
def harmony_gaps(spark, d):
    """How far the mean of each batch lies from the mean of all before the correction, and whether the batches lie closer together after it."""
    wells = v_vec(spark, d)
    shifted = wells.withColumn("vec", F.transform("vec", lambda x: x.cast("double") + F.col("batch").cast("double") * 0.5))
    both = checkpoint(correct.harmony(shifted, "vec", "batch", "id", max_rounds=5).select("batch", "vec", "harmony"))

    def gaps(vec):
        every = mean_vector(both, [], vec, "a").scalar()
        apart = F.zip_with("m", "a", lambda x, y: (x - y) * (x - y))
        return mean_vector(both, ["batch"], vec, "m", "n").withColumn("a", every).select("batch", "n", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda t, x: t + x)).alias(vec))

    apart = lambda c: F.sum(F.col("n") * F.col(c) * F.col(c)).over(Window.partitionBy())  # noqa: E731  (one row per batch)
    out = gaps("vec").join(gaps("harmony").drop("n"), "batch")
    return out.select("batch", "n", r6("vec").alias("gap_before"), (apart("harmony") < 0.5 * apart("vec")).alias("closer"))


# -- whole flows -------------------------------------------------------------------------


@query(f"""WITH {CELL}, k AS (SELECT *, concat_ws('__', source, batch, plate, well, tile) AS fov, concat_ws('__', source, batch, plate) AS pk, concat_ws('__', row_key, CAST(id_local AS VARCHAR)) AS rk FROM v_cell),
c AS (SELECT k.*, n FROM k JOIN (SELECT fov, count(*) AS n FROM k GROUP BY fov) USING (fov)),
x AS (SELECT *, concat_ws('__', fov, row_key) AS key FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY pk, well ORDER BY md5(concat_ws('|', '42', key)), key) AS rn FROM x),
s AS (SELECT * FROM r WHERE rn <= 5), m AS (SELECT min(n) AS lo, max(n) AS hi FROM s)
SELECT key AS row_key, plate, well, tile, n AS n_cells_in_fov, round(least(greatest((n - lo) / greatest(hi - lo, 1) * 255.0, 0.0), 255.0), 6) AS n_cells_scaled,
  'type_' || well AS "Metadata_PlateType", '' AS "Metadata_SMILES" FROM s, m""")
def selected_cells(spark, d):
    from ..functions import ids

    cells = v_cell(spark, d).select(ids.composite_id("source", "batch", "plate", "well", "tile").alias("fov_id"), F.col("row_key").alias("id_local"))
    fovs = checkpoint(cells.groupBy("fov_id").agg(F.count(F.lit(1)).alias("n_cells_in_fov")))
    meta = fovs.select("fov_id", "n_cells_in_fov", F.concat(F.lit("type_"), ids.id_part("fov_id", 3)).alias("Metadata_PlateType"))
    out = profiles.select_cells(cells, meta, "uniform_per_well", ["Metadata_PlateType", "Metadata_SMILES"], n_per_well=5)
    return out.select("row_key", "plate", "well", "tile", "n_cells_in_fov", r6("n_cells_scaled").alias("n_cells_scaled"), "Metadata_PlateType", "Metadata_SMILES")


@query(f"""WITH {CELL}, w AS (SELECT source, plate, well, pos, median({PICK}) AS x FROM v_cell, {FIELDS_SQL} GROUP BY ALL),
o AS (SELECT *, well IN ('W01', 'W02', 'W03', 'W04', 'W05', 'W06') AS ctrl FROM w WHERE well <> 'W07'),
nc AS (SELECT source, plate, pos, count(*) FILTER (ctrl) AS nc FROM o GROUP BY ALL), ref AS (SELECT o.* FROM o JOIN nc USING (source, plate, pos) WHERE ctrl OR nc < 5),
med AS (SELECT source, plate, pos, median(x) AS med FROM ref GROUP BY ALL), mad AS (SELECT source, plate, pos, any_value(med) AS med, median(abs(x - med)) AS mad FROM ref JOIN med USING (source, plate, pos) GROUP BY ALL)
SELECT source, plate, well, CAST(pos AS BIGINT) AS pos, round(least(greatest((x - med) / CASE WHEN mad > 0 THEN mad * 1.4826 ELSE 1.0 END, -4.0), 4.0), 5) + 0.0 AS value FROM o JOIN mad USING (source, plate, pos)""")
def classical_profiles(spark, d):
    cells = _cell_vec(spark, d)
    control = F.col("well").isin("W01", "W02", "W03", "W04", "W05", "W06")
    obs = cells.select("source", "plate", "well", control.alias("is_control")).where("well <> 'W07'").distinct()
    out = profiles.classical_profiles_median(cells, "vec", obs, plate=["source", "plate"], sphering="none")
    return _tidy(out, ["source", "plate", "well"], "sphered", 5)


@query()
def classical_profiles_sphered(spark, d):
    """The same flow with its last step."""
    cells = _cell_vec(spark, d)
    control = F.col("well").isin("W01", "W02", "W03", "W04", "W05", "W06")
    obs = cells.select("source", "plate", "well", control.alias("is_control")).where("well <> 'W07'").distinct()
    return _tidy(profiles.classical_profiles_median(cells, "vec", obs, plate=["source", "plate"]), ["source", "plate", "well"], "sphered", 5)


@query()
def classical_profiles_mean(spark, d):
    """Classical features on the embedding path, by well means."""
    cells = _cell_vec(spark, d)
    control = F.col("perturbation").isin("Brand#1", "Brand#2", "Brand#3")
    out = profiles.classical_profiles_mean(cells, "vec", control, "row_key", keys=["source", "plate", "well"], metadata=["perturbation"])
    return _tidy(out, ["well_key", "batch", "n_cells"], "pca_harmony", 4)


@query()
def embedding_profiles(spark, d):
    cells = v_vec(spark, d).withColumns({"source": F.lit("s"), "well": F.pmod("id", F.lit(100)).cast("string")})
    out = profiles.embedding_profiles(
        cells, "vec", F.col("perturbation").isin("0", "1", "2", "3"), metadata=["perturbation"], order=["id"], max_rounds=100
    )
    return _tidy(out, ["well_key", "batch", "n_cells"], "pca_harmony", 4)


# -- probe -------------------------------------------------------------------------------


def _probe_table(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("vec_id", F.lit(5)).alias("batch"), V.to_double("embedding").alias("v"))
    return e.select("id", "batch", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("y"))


@query()
def ridge_probe(spark, d):
    df = _probe_table(spark, d)
    out = probe.ridge_scores(df, "x", "y", F.col("batch") != 0, F.col("batch") == 0)
    return out.select(F.col("feature").cast("bigint").alias("feature"), "n", r6("pearson", 5).alias("pearson"), r6("r2", 5).alias("r2"))


@query("""WITH d AS (SELECT vec_id % 5 AS b, CAST(embedding[1] AS DOUBLE) AS x, i AS feature, CAST(embedding[i + 33] AS DOUBLE) AS y FROM embeddings, range(32) t(i)),
m AS (SELECT feature, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM d WHERE b <> 0 GROUP BY feature),
c AS (SELECT feature, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((x - mx) / sx * (y - my)) / (any_value(n) + 1.0) AS coef FROM d JOIN m USING (feature) WHERE b <> 0 GROUP BY feature),
p AS (SELECT feature, y, (x - mx) / sx * coef + my AS pred FROM d JOIN c USING (feature) WHERE b = 0)
SELECT feature, count(*) AS n, round(corr(y, pred), 5) AS pearson, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 5) AS r2 FROM p GROUP BY feature""")
def ridge_probe_one_input(spark, d):
    df = _probe_table(spark, d).withColumn("x", F.slice("x", 1, 1))
    out = probe.ridge_scores(df, "x", "y", F.col("batch") != 0, F.col("batch") == 0)
    return out.select(F.col("feature").cast("bigint").alias("feature"), "n", r6("pearson", 5).alias("pearson"), r6("r2", 5).alias("r2"))


SCORES = """p AS (SELECT vec_id AS id, i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS t, CAST(embedding[i + 33] AS DOUBLE) AS p FROM embeddings, range(32) r(i)),
s AS (SELECT feature, count(*) AS n, corr(t, p) AS pearson, 1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)) AS r2 FROM p GROUP BY feature)"""


def _feature_scores(spark, d):
    both = F.arrays_zip(F.col("x").alias("t"), F.col("y").alias("p"))
    rows = _probe_table(spark, d).select(F.posexplode(both).alias("feature", "v")).select(F.col("feature").cast("bigint").alias("feature"), F.col("v.t").alias("t"), F.col("v.p").alias("p"))
    return probe.feature_scores(rows, "feature", "t", "p")


@query(f"WITH {SCORES} SELECT feature, n, round(pearson, 6) AS pearson, round(r2, 6) AS r2 FROM s")
def feature_scores(spark, d):
    out = _feature_scores(spark, d)
    return out.withColumns({"pearson": r6("pearson"), "r2": r6("r2")})


@query(f"""WITH {SCORES}, f AS (SELECT pearson AS x, CASE WHEN feature % 2 = 0 THEN 'Texture' ELSE 'Intensity' END AS fam FROM s)
SELECT count(*) AS r_n, round(median(x), 6) AS r_median, round(quantile_cont(x, 0.25), 6) AS r_iqr_lo, round(quantile_cont(x, 0.75), 6) AS r_iqr_hi,
  round(avg(CAST(x > 0 AS INT)), 6) AS r_frac_gt_0, round(avg(CAST(x > 0.1 AS INT)), 6) AS r_frac_gt_0p1, round(avg(CAST(x > 0.3 AS INT)), 6) AS r_frac_gt_0p3,
  round(median(x) FILTER (fam = 'Intensity'), 6) AS r_intensity, round(median(x) FILTER (fam = 'Texture'), 6) AS r_texture FROM f""")
def metric_summary(spark, d):
    scores = checkpoint(_feature_scores(spark, d).select("pearson", F.when(F.pmod("feature", F.lit(2)) == 0, "Texture").otherwise("Intensity").alias("family")))
    out = probe.metric_summary(scores, "pearson", "family", "r", ["Intensity", "Texture"])
    return out.select("r_n", *[r6(c).alias(c) for c in out.columns if c != "r_n"])
