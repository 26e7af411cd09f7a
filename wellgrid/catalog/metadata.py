"""Metadata, join, set and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import checks
from ..functions import ids, text
from ..operators import metadata as M
from ..operators import probe, report
from ..plans.ranking import dense_ids
from ..sources import readers
from . import query
from .views import CELL, FOV, r6, table, v_cell, v_fov

ENTRIES = [{"source": "ASIA"}, {"batch": "NATION_3"}, {"source": "EUROPE", "batch": "NATION_7"}, {"source": "ATLANTIS", "batch": "NATION_1"}]
ENTRIES_SQL = """samples(source, batch) AS (VALUES ('ASIA', NULL), (NULL, 'NATION_3'), ('EUROPE', 'NATION_7'), ('ATLANTIS', 'NATION_1'))"""


@query(f"""WITH {FOV}, {ENTRIES_SQL}, hit AS (
  SELECT *, row_number() OVER (PARTITION BY source, batch, plate, well ORDER BY site) AS rn FROM v_fov f
  WHERE EXISTS (SELECT 1 FROM samples s WHERE (s.source IS NULL OR s.source = f.source) AND (s.batch IS NULL OR s.batch = f.batch)))
SELECT source, batch, plate, well, site FROM hit WHERE rn = 1""")
def whitelist_select(spark, d):
    samples = readers.whitelist(spark, ENTRIES, ["source", "batch"])
    out = M.select_samples(v_fov(spark, d), samples, ["source", "batch"], ["source", "batch", "plate", "well"], ["site"])
    return out.select("source", "batch", "plate", "well", "site")


@query(f"""WITH {FOV}, {ENTRIES_SQL}
SELECT source, batch FROM samples s WHERE NOT EXISTS (
  SELECT 1 FROM v_fov f WHERE (s.source IS NULL OR s.source = f.source) AND (s.batch IS NULL OR s.batch = f.batch))""")
def whitelist_unmatched(spark, d):
    return M.unmatched_samples(v_fov(spark, d), readers.whitelist(spark, ENTRIES, ["source", "batch"]), ["source", "batch"])


@query(f"WITH {FOV} SELECT kind, count(*) AS n FROM v_fov GROUP BY kind")
def available_types(spark, d):
    return M.available_types(v_fov(spark, d), "kind")


@query(f"""WITH {FOV} SELECT source AS "Metadata_Source", batch AS "Metadata_Batch", plate AS "Metadata_Plate", well AS "Metadata_Well",
  'CRISPR' AS "Metadata_PlateType", site FROM v_fov WHERE kind IN ('1-URGENT', '2-HIGH')""")
def schema_mapping(spark, d):
    picked = M.of_type(v_fov(spark, d), "kind", "1-URGENT", "2-HIGH")
    names = {"source": "Metadata_Source", "batch": "Metadata_Batch", "plate": "Metadata_Plate", "well": "Metadata_Well"}
    out = M.map_schema(picked, names, {"Metadata_PlateType": "CRISPR"})
    return checks.require_columns(out, [*names.values(), "Metadata_PlateType", "site"], select=True)


@query(f"""WITH {CELL} SELECT row_key, concat_ws('__', source, batch, plate, well, tile) AS fov_id,
  coalesce(inchikey, '') AS inchikey, '' AS smiles FROM v_cell""")
def composite_id(spark, d):
    out = M.fill_text(v_cell(spark, d), ["inchikey", "smiles"])
    return out.select("row_key", ids.composite_id("source", "batch", "plate", "well", "tile").alias("fov_id"), "inchikey", "smiles")


@query(f"""WITH {CELL}, k AS (SELECT row_key, string_split(concat_ws('__', source, batch, plate, well, tile, CAST(id_local AS VARCHAR)), '__') AS p FROM v_cell)
SELECT row_key, p[1] AS source, p[2] AS batch, p[3] AS plate, p[4] AS well, p[5] || '__' || p[6] AS tile,
  p[1] || '__' || p[2] || '__' || p[3] AS plate_key FROM k""")
def id_parse(spark, d):
    fov = ids.composite_id("source", "batch", "plate", "well", "tile")
    keyed = v_cell(spark, d).select("row_key", ids.row_key(fov, "id_local").alias("fov_id"))
    return ids.with_id_parts(keyed).drop("fov_id")


@query(f"""WITH {FOV}, p AS (SELECT DISTINCT 'source' AS column_name, source AS value FROM v_fov
  UNION SELECT DISTINCT 'plate', plate FROM v_fov UNION SELECT DISTINCT 'kind', kind FROM v_fov)
SELECT * FROM p WHERE NOT regexp_full_match(value, '[A-Za-z0-9._-]+')""")
def unsafe_identifier_report(spark, d):
    return checks.unsafe_identifiers(v_fov(spark, d), ["source", "plate", "kind"])


@query("""WITH ann AS (
  SELECT s_suppkey AS key, s_name AS label, NULL AS kind, 0 AS p FROM supplier UNION ALL
  SELECT c_custkey, c_name, c_mktsegment, 1 FROM customer UNION ALL SELECT p_partkey, p_name, p_type, 2 FROM part),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, label) AS rn FROM ann) WHERE rn = 1)
SELECT l_partkey AS key, label, kind, count(*) AS n_wells FROM lineitem LEFT JOIN best ON l_partkey = best.key GROUP BY ALL""")
def annotation_priority_join(spark, d):
    key = lambda t, c: table(spark, d, t).withColumnRenamed(c, "key")
    tables = [
        key("supplier", "s_suppkey").select("key", F.col("s_name").alias("label")),
        key("customer", "c_custkey").select("key", F.col("c_name").alias("label"), F.col("c_mktsegment").alias("kind")),
        key("part", "p_partkey").select("key", F.col("p_name").alias("label"), F.col("p_type").alias("kind")),
    ]
    wells = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey")
    out = M.annotate_by_priority(wells, tables, "key", ["label", "kind"], order=["label"])
    return out.groupBy("key", "label", "kind").agg(F.count(F.lit(1)).alias("n_wells"))


@query("""SELECT n_name AS batch, s_name AS well_name, l_orderkey AS site, l_linenumber AS line,
  's3://images/Plate' || CAST(l_suppkey AS VARCHAR) || '/' || n_name || '_s' || CAST(l_linenumber AS VARCHAR) || '_w1.png' AS "s3_DNA",
  's3://images/Plate' || CAST(l_suppkey AS VARCHAR) || '/' || n_name || '_s' || CAST(l_linenumber AS VARCHAR) || '_w4.png' AS "s3_RNA"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def site_expansion_join(spark, d):
    plates = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("batch"))
    wells = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("plate"), F.col("s_name").alias("well_name"))
    listing = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plate"), F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("line"))
    out = M.expand_to_sites(M.well_table(plates, wells, ["nation"]), listing, ["plate"], "site")
    paths = ids.channel_paths({"DNA": 1, "RNA": 4}, "s3://images", "plate", "batch", "line")
    return out.withColumns(paths).select("batch", "well_name", "site", "line", *paths)


@query("""SELECT l_suppkey AS plate, s_name AS value, s_name IS NULL AS missing, count(*) AS n FROM lineitem
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey GROUP BY ALL""")
def lookup_with_missing(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plate"), "l_orderkey")
    side = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("plate"), F.col("s_name").alias("value"))
    return M.lookup_or_missing(li, side, "plate", "value").groupBy("plate", "value", "missing").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT o_custkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey AND s_acctbal > 0)""")
def missing_lookup_keys(spark, d):
    have = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"))
    return M.missing_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), have, "key")


SIRNA_SQL = """smap AS (SELECT 'n' || CAST(p_partkey AS VARCHAR) AS sirna_id,
  CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN 'NEGATIVE_CONTROL' WHEN 'LARGE' THEN 'NA' ELSE p_brand END AS gene FROM part),
cells AS (SELECT CASE WHEN l_quantity > 49 THEN 'EMPTY' ELSE 'n' || CAST(l_partkey AS VARCHAR) END AS sirna FROM lineitem)"""


def _sirna(spark, d):
    gene = (
        F.when(F.col("p_type") == "PROMO", F.lit(None)).when(F.col("p_type") == "SMALL", "NEGATIVE_CONTROL")
        .when(F.col("p_type") == "LARGE", "NA").otherwise(F.col("p_brand"))
    )
    mapping = table(spark, d, "part").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("sirna_id"), gene.alias("gene_symbol"))
    sirna = F.when(F.col("l_quantity") > 49, "EMPTY").otherwise(F.concat(F.lit("n"), F.col("l_partkey").cast("string")))
    return table(spark, d, "lineitem").select(sirna.alias("sirna"), "l_orderkey"), mapping


@query(f"""WITH {SIRNA_SQL}, j AS (SELECT CASE WHEN sirna = 'EMPTY' OR gene = 'NEGATIVE_CONTROL' THEN 'EMPTY' ELSE gene END AS perturbation
  FROM cells LEFT JOIN smap ON sirna = sirna_id)
SELECT perturbation, count(*) AS n FROM j WHERE perturbation IS NOT NULL GROUP BY perturbation""")
def sirna_to_gene(spark, d):
    cells, mapping = _sirna(spark, d)
    return M.rekey_sirna(cells, mapping, "sirna").groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SIRNA_SQL} SELECT gene AS perturbation, count(*) AS n FROM cells JOIN smap ON sirna = sirna_id
WHERE gene IS NOT NULL AND gene <> 'NEGATIVE_CONTROL' GROUP BY gene""")
def resolved_wells(spark, d):
    cells, mapping = _sirna(spark, d)
    return M.resolve_wells(cells, mapping, "sirna").groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH one AS (SELECT * FROM (SELECT c_nationkey AS inchikey, c_name AS pert_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1),
drugs AS (SELECT c_name AS pert_name, c_mktsegment AS moa FROM customer WHERE c_acctbal > 0)
SELECT s_suppkey AS id, pert_name, moa FROM supplier LEFT JOIN (SELECT one.inchikey, one.pert_name, moa FROM one LEFT JOIN drugs USING (pert_name)) x ON s_nationkey = inchikey""")
def drug_annotation(spark, d):
    cust = table(spark, d, "customer")
    samples = cust.select(F.col("c_nationkey").alias("inchikey"), F.col("c_name").alias("pert_name"), "c_custkey")
    drugs = cust.where("c_acctbal > 0").select(F.col("c_name").alias("pert_name"), F.col("c_mktsegment").alias("moa"))
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("inchikey"))
    return M.annotate_drugs(df, samples, drugs, "inchikey", "pert_name", ["c_custkey"]).select("id", "pert_name", "moa")


CTRL_SQL = "(perturbation = 'Brand#1' AND nuc_area = 50)"


@query(f"""WITH {CELL}, k AS (SELECT DISTINCT source, plate FROM v_cell WHERE {CTRL_SQL})
SELECT source, plate, EXISTS (SELECT 1 FROM k WHERE k.source = v.source AND k.plate = v.plate) AS has_control, count(*) AS n
FROM v_cell v WHERE NOT {CTRL_SQL} GROUP BY ALL""")
def plates_with_control(spark, d):
    cells = v_cell(spark, d).select("source", "plate", "perturbation", "nuc_area")
    ctrl = (F.col("perturbation") == "Brand#1") & (F.col("nuc_area") == 50)
    kept = M.on_plates_with_control(cells, ["source", "plate"], ctrl).withColumn("has_control", F.lit(True))
    lost = M.on_plates_with_control(cells, ["source", "plate"], ctrl, anti=True).withColumn("has_control", F.lit(False))
    return kept.unionByName(lost).groupBy("source", "plate", "has_control").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELL} SELECT row_key, 'C' || well AS compound, CASE WHEN is_control THEN 'CONTROL' ELSE inchikey END AS sirna,
  CASE WHEN perturbation = 'Brand#2' THEN 'CONTROL' ELSE perturbation END AS crispr FROM v_cell""")
def published_labels(spark, d):
    cells = v_cell(spark, d).withColumns({
        "smiles": F.concat(F.lit("C"), "well"), "plate_type": F.when(F.col("is_control"), "negative_control").otherwise("treatment"),
        "gene": F.when(F.col("perturbation") == "Brand#2", "EMPTY_control").otherwise(F.col("perturbation")),
    })
    out = M.published_perturbation(cells, "compound", "inchikey", "plate_type", "smiles", out="compound")
    out = M.published_perturbation(out, "sirna", "inchikey", "plate_type", "smiles", out="sirna")
    return M.published_perturbation(out, "crispr", "gene", "plate_type", "smiles", out="crispr").select("row_key", "compound", "sirna", "crispr")


@query(f"""WITH {CELL} SELECT CASE WHEN perturbation = 'Brand#2' THEN 'EMPTY' ELSE perturbation END AS perturbation,
  inchikey AS treatment, 'plate_' || plate AS batch, count(*) AS n FROM v_cell GROUP BY ALL""")
def canonical_labels(spark, d):
    cells = v_cell(spark, d).withColumn("gene", F.when(F.col("perturbation") == "Brand#2", "EMPTY_control").otherwise(F.col("perturbation")))
    out = M.canonical_labels(cells.drop("perturbation", "batch"), "crispr", "gene", "inchikey", "source", "plate")
    return out.groupBy("perturbation", "treatment", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH allow AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT doc_id, source, lang FROM documents WHERE lang = 'de' OR source IN (SELECT source FROM allow)""")
def allowlist_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    allow = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("source")
    return M.allowlisted(docs, allow, "source", F.col("lang") != "de")


@query(f"""WITH {CELL}, inc AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48 AND p_retailprice < 1100 UNION SELECT 'Brand#1'),
exc AS (SELECT DISTINCT p_brand FROM part WHERE p_size = 50 AND p_type = 'PROMO' AND p_retailprice < 1000)
SELECT perturbation, count(*) AS n FROM v_cell WHERE perturbation IN (SELECT * FROM inc) AND perturbation NOT IN (SELECT * FROM exc) GROUP BY perturbation""")
def include_exclude_filter(spark, d):
    part = table(spark, d, "part")
    brand = F.col("p_brand").alias("perturbation")
    inc = part.where("p_size > 48 and p_retailprice < 1100").select(brand)
    exc = part.where("p_size = 50 and p_type = 'PROMO' and p_retailprice < 1000").select(brand)
    cells = v_cell(spark, d).select("perturbation", "row_key")
    return M.include_exclude(cells, "perturbation", inc, exc, ["Brand#1"]).groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'broken_' || CAST(event_id AS VARCHAR)
  ELSE concat_ws('_', CAST(event_id AS VARCHAR), event_type, 'dino', CAST(user_id AS VARCHAR), 'C') END AS config_id FROM events)
SELECT event_id, config_id, CASE WHEN len(p) = 5 THEN p[1] END AS config_num, CASE WHEN len(p) = 5 THEN p[2] END AS dataset,
  CASE WHEN len(p) = 5 THEN p[3] END AS encoder, CASE WHEN len(p) = 5 THEN p[4] END AS perturbation_encoder, CASE WHEN len(p) = 5 THEN p[5] END AS view
FROM (SELECT *, string_split(config_id, '_') AS p FROM k)""")
def config_id_parse(spark, d):
    e = table(spark, d, "events")
    whole = F.concat_ws("_", F.col("event_id").cast("string"), "event_type", F.lit("dino"), F.col("user_id").cast("string"), F.lit("C"))
    cid = F.when(F.col("event_type") == "error", F.concat(F.lit("broken_"), F.col("event_id").cast("string"))).otherwise(whole)
    return ids.config_components(e.select("event_id", cid.alias("config_id")))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS dataset,
  CASE WHEN source = 'src0' THEN 'zero-shot' ELSE source END AS encoder, CASE WHEN n_chars < 500 THEN 'pre' ELSE 'post' END AS stage FROM documents""")
def label_normalise(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    encoder = F.when(F.col("source") == "src0", "Zero-shot").otherwise(F.col("source"))
    parts = ids.split_group_label(F.concat("lang", F.lit(" — "), encoder), {"en": "English", "de": "German"})
    stage = ids.stage_tag(F.when(F.col("n_chars") < 500, "X_pca").otherwise("X_pca_harmony"))
    return docs.select("doc_id", parts.alias("p"), stage.alias("stage")).select("doc_id", "p.dataset", "p.encoder", "stage")


@query("""WITH f AS (SELECT CASE p_type WHEN 'PROMO' THEN 'Intensity' WHEN 'SMALL' THEN 'Texture' WHEN 'MEDIUM' THEN 'Zernike'
  WHEN 'LARGE' THEN 'AreaShape' WHEN 'ECONOMY' THEN 'Granularity' ELSE 'Other' END AS family FROM part)
SELECT family, count(*) AS n_features FROM f GROUP BY family""")
def feature_family(spark, d):
    token = (
        F.when(F.col("p_type") == "PROMO", "Intensity").when(F.col("p_type") == "SMALL", "Contrast").when(F.col("p_type") == "MEDIUM", "Zernike")
        .when(F.col("p_type") == "LARGE", "Extent").when(F.col("p_type") == "ECONOMY", "Granularity").otherwise("Unknown")
    )
    name = F.concat_ws("_", F.lit("Cells"), token, F.col("p_partkey").cast("string"))
    feats = table(spark, d, "part").select(name.alias("name")).withColumn("family", text.feature_family("name"))
    return probe.family_counts(feats, "family")


@query("SELECT DISTINCT p_brand AS perturbation FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def gene_universe(spark, d):
    return M.key_universe(table(spark, d, "part").withColumnRenamed("p_brand", "perturbation"), "perturbation", ["Brand#1", "Brand#2"])


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25),
j AS (SELECT a.k AS a, b.k AS b FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.k, b.k) <> 7)
SELECT count(a) AS n_left, count(b) AS n_right, count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n_both, count(*) AS n_either FROM j""")
def key_universe_sizes(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    b = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    return M.universe_sizes(a, b, discard=[7])


@query("""WITH h AS (SELECT p_brand AS symbol, CASE WHEN p_size = 7 THEN lower(p_brand) ELSE p_name END AS primary_name, p_partkey AS rank FROM part)
SELECT symbol, primary_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN upper(primary_name) = upper(symbol) THEN 0 ELSE 1 END, rank) AS rn FROM h) WHERE rn = 1""")
def best_hit(spark, d):
    hits = table(spark, d, "part").select(
        F.col("p_brand").alias("symbol"), F.when(F.col("p_size") == 7, F.lower("p_brand")).otherwise(F.col("p_name")).alias("primary_name"), F.col("p_partkey").alias("rank")
    )
    return M.best_hit(hits, "symbol", "primary_name", "rank")


PAGE_SYMBOL = r"^[A-Z][a-z]+ .*$"


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x, '""" + text.BLANKS + r"""')), lambda x: x <> '') AS lines FROM documents),
w AS (SELECT doc_id, flatten(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN upper(lines[i]) = upper(lines[1]) THEN list_slice(lines, i + 1, i + 7) ELSE [] END)) AS near
  FROM l WHERE len(lines) > 0),
g AS (SELECT doc_id, list_filter(near, lambda x: regexp_full_match(x, '[A-Z][a-z]+ .*'))[1] AS gene FROM w)
SELECT doc_id, gene FROM g WHERE gene IS NOT NULL""")
def genes_on_pages(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs = docs.withColumn("wanted", F.get(text.text_lines("text"), F.lit(0)))
    return M.genes_on_pages(docs, "doc_id", "wanted", "text", symbol=PAGE_SYMBOL)


@query("""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS value FROM pages""")
def tagged_values(spark, d):
    return M.tagged_values(table(spark, d, "pages"), "html", 'href="/([^"]*)"')


@query(r"""WITH r AS (SELECT doc_id, 'sp|' || CAST(doc_id AS VARCHAR) || ' ORGN=other' || CASE WHEN lang = 'de' THEN '' ELSE ' GN=' || source || '_' || lang END AS header, regexp_replace(text, '\s', '', 'g') AS sequence,
  CASE WHEN lang <> 'de' THEN source || '_' || lang END AS gene FROM documents)
SELECT gene, sequence FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY doc_id DESC) AS rn FROM r WHERE gene IS NOT NULL AND sequence <> '') WHERE rn = 1""")
def sequence_records(spark, d):
    tag = F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit(" GN="), "source", F.lit("_"), "lang"))
    rec = F.concat(F.lit("sp|"), F.col("doc_id").cast("string"), F.lit(" ORGN=other"), tag, F.lit("\n"), "text")
    return M.sequence_records(table(spark, d, "documents").select("doc_id", rec.alias("record")), "record", ["doc_id"])


@query(f"""WITH {CELL}, s AS (SELECT perturbation, count(DISTINCT batch) AS n_sources FROM v_cell GROUP BY perturbation),
h AS (SELECT n_sources, count(*) AS n_keys FROM s GROUP BY n_sources)
SELECT n_sources, n_keys, CAST(sum(n_keys) OVER (ORDER BY n_sources DESC) AS BIGINT) AS n_keys_at_least FROM h""")
def coverage_histogram(spark, d):
    return report.coverage_histogram(report.distinct_sources(v_cell(spark, d), "perturbation", "batch"), "n_sources")


@query("""WITH t AS (SELECT trim(unnest(string_split(text, ' ')), ' ') AS token FROM documents)
SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 20""")
def top_tokens(spark, d):
    return report.top_tokens(table(spark, d, "documents"), "text", " ")


@query("""SELECT p_name AS key, dense_rank() OVER (ORDER BY p_name) - 1 AS class_id FROM (SELECT DISTINCT p_name FROM part)""")
def factorise(spark, d):
    return dense_ids(table(spark, d, "part").select(F.col("p_name").alias("key")), "key")


@query("""SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)/(.+)$', 1), '') AS scheme, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)/(.+)$', 2), '') AS bucket,
  nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)/(.+)$', 3), '') AS key FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", ids.url_parts("url").alias("u")).select("page_id", "u.scheme", "u.bucket", "u.key")


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT id, 'repeated' AS problem FROM r WHERE n > 1""")
def request_violations(spark, d):
    return checks.request_violations(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_totalprice"])


@query(f"""WITH {CELL}, m AS (SELECT source, perturbation, round(avg(nuc_area), 6) AS mean FROM v_cell GROUP BY source, perturbation)
SELECT source, perturbation, mean, row_number() OVER (ORDER BY CASE source WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END, CASE perturbation WHEN 'Brand#9' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 2 END, source, perturbation) - 1 AS position FROM m""")
def category_order(spark, d):
    means = v_cell(spark, d).groupBy("source", "perturbation").agg(r6(F.avg("nuc_area")).alias("mean"))
    ordered = report.in_category_order(means, {"source": ["EUROPE", "ASIA"], "perturbation": ["Brand#9", "Brand#1"]}, ["source", "perturbation"])
    # the report's few rows, numbered as they come: the order itself is what is checked
    return ordered.coalesce(1).withColumn("position", F.monotonically_increasing_id())
