"""Sampling, bucket, split and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from ..operators import metadata as M
from ..operators import sampling as S
from ..operators import shardplan
from ..plans.ranking import first_per_key
from . import query
from .views import CELL, FOV, VEC, table, v_cell, v_fov, v_vec

H = "md5(concat_ws('|', '42', row_key))"
NARROW = ["source", "batch", "plate", "well", "perturbation", "row_key"]


def _cells(spark, d):
    return v_cell(spark, d).select(*NARROW, "is_control", "inchikey", "nuc_area")


@query(f"""WITH {FOV}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY site) AS rn FROM v_fov)
SELECT site, source || '_snakemake_batch_' || CAST((rn - 1) // 380 AS VARCHAR) AS snakemake_batch FROM r""")
def bucket_assign(spark, d):
    return S.assign_buckets(v_fov(spark, d).select("source", "site"), "source", ["site"], 380).select("site", "snakemake_batch")


@query(f"""WITH {CELL}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, plate ORDER BY row_key) AS rn FROM v_cell) WHERE rn <= 100)
SELECT source, plate, well, row_key FROM (SELECT *, row_number() OVER (PARTITION BY source, plate, well ORDER BY row_key) AS rw FROM a) WHERE rw <= 3""")
def cap_per_group(spark, d):
    cells = _cells(spark, d).select("source", "plate", "well", "row_key")
    return S.cap_in_order(cells, ["source", "plate"], ["source", "plate", "well"], ["row_key"], per_plate=100, per_well=3)


@query("""SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 50 AS slice FROM events""")
def fixed_slices(spark, d):
    return S.fixed_slices(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], 50)


@query("SELECT event_type, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS n_slices FROM events GROUP BY event_type")
def slice_counts(spark, d):
    return S.slice_counts(table(spark, d, "events"), ["event_type"], 50)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents),
f AS (SELECT *, least(ceil(n / 100.0), 8) AS files FROM r)
SELECT doc_id, CAST(floor((rn - 1) / ceil(n / files)) AS BIGINT) AS file FROM f""")
def contiguous_file_plan(spark, d):
    return S.file_plan(table(spark, d, "documents").select("doc_id"), ["doc_id"], rows_per_file=100, max_files=8)


@query(f"""WITH {CELL} SELECT plate, well, row_key FROM (SELECT *, row_number() OVER (PARTITION BY plate, well ORDER BY {H}, row_key) AS rn FROM v_cell) WHERE rn <= 5""")
def sample_per_well(spark, d):
    return S.per_group(_cells(spark, d).select("plate", "well", "row_key"), ["plate", "well"], 5, ["row_key"])


@query(f"""WITH {CELL}, r AS (SELECT *, row_number() OVER (PARTITION BY perturbation, source ORDER BY {H}, row_key) AS rn FROM v_cell)
SELECT perturbation, source, row_key FROM r WHERE rn <= 20 OR perturbation = 'Brand#1'""")
def sample_per_perturbation_source(spark, d):
    cells = _cells(spark, d).select("perturbation", "source", "row_key")
    return S.per_perturbation_source(cells, "perturbation", "source", 20, ["row_key"], control_labels=["Brand#1"])


@query(f"""WITH {CELL}, r AS (SELECT *, row_number() OVER (PARTITION BY inchikey, source ORDER BY {H}, row_key) AS rn FROM v_cell)
SELECT inchikey, source, row_key FROM r WHERE rn <= 30 OR inchikey IS NULL""")
def sample_with_keyless_bypass(spark, d):
    cells = _cells(spark, d).select("inchikey", "source", "row_key")
    return S.per_perturbation_source(cells, "inchikey", "source", 30, ["row_key"])


@query(f"WITH {CELL} SELECT row_key, source FROM v_cell ORDER BY {H}, row_key LIMIT 1000")
def sample_total(spark, d):
    return S.in_total(_cells(spark, d).select("row_key", "source"), 1000, ["row_key"])


@query(f"""WITH {CELL}, r AS (SELECT *, row_number() OVER (PARTITION BY perturbation ORDER BY {H}, row_key) AS rn, count(*) OVER (PARTITION BY perturbation) AS n FROM v_cell)
SELECT perturbation, row_key FROM r WHERE rn <= greatest(1, round_even(n * 0.1, 0))""")
def sample_fraction(spark, d):
    return S.stratified_fraction(_cells(spark, d).select("perturbation", "row_key"), ["perturbation"], 0.1, ["row_key"])


@query(f"""WITH {FOV} SELECT source, site FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', CAST(site AS VARCHAR))), site) AS rn FROM v_fov) WHERE rn <= 200""")
def sample_fovs_per_source(spark, d):
    return S.per_group(v_fov(spark, d).select("source", "site"), ["source"], 200, ["site"])


@query(f"""WITH {CELL} SELECT inchikey, row_key FROM (SELECT *, row_number() OVER (PARTITION BY inchikey ORDER BY {H}, row_key) AS rn FROM v_cell WHERE inchikey IS NOT NULL AND source = 'ASIA') WHERE rn <= 4""")
def sample_wells_per_compound(spark, d):
    return S.per_group(M.of_type(_cells(spark, d), "source", "ASIA").select("inchikey", "row_key"), ["inchikey"], 4, ["row_key"])


@query(f"""WITH {CELL}, r AS (SELECT *, perturbation IN ('Brand#2', 'Brand#3') AS pos, row_number() OVER (PARTITION BY perturbation, batch ORDER BY {H}, row_key) AS rn FROM v_cell)
SELECT perturbation, batch, row_key FROM r WHERE NOT pos OR rn <= 6""")
def cap_positive_controls(spark, d):
    cells = _cells(spark, d).select("perturbation", "batch", "row_key")
    return S.per_group_except(cells, ["perturbation", "batch"], 6, ["row_key"], ~F.col("perturbation").isin("Brand#2", "Brand#3"))


DIVERSE = """a AS (SELECT *, row_number() OVER (PARTITION BY perturbation, source, batch ORDER BY {h}, row_key) AS rd FROM {src}),
b AS (SELECT *, row_number() OVER (PARTITION BY perturbation, source ORDER BY rd, md5(concat_ws('|', '42', perturbation, source, batch)), {h}, row_key) AS rn FROM a)
SELECT perturbation, source, batch, row_key FROM b WHERE rn <= {n}"""


@query(f"WITH {CELL}, " + DIVERSE.format(h=H, src="v_cell", n=7))
def batch_diverse_pick(spark, d):
    cells = _cells(spark, d).select("perturbation", "source", "batch", "row_key")
    return S.batch_diverse(cells, ["perturbation", "source"], "batch", 7, ["row_key"])


@query(f"""WITH {CELL}, ctrl AS (SELECT DISTINCT source, plate FROM v_cell WHERE tile IN ('1', '2', '3') AND is_control AND nuc_area >= 40),
uni AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48 AND p_retailprice < 1100),
pool AS (SELECT * FROM v_cell v WHERE tile IN ('1', '2', '3') AND NOT (is_control AND nuc_area >= 40)
  AND EXISTS (SELECT 1 FROM ctrl c WHERE c.source = v.source AND c.plate = v.plate) AND perturbation IN (SELECT p_brand FROM uni)), """ + DIVERSE.format(h=H, src="pool", n=5))
def treatment_wells(spark, d):
    cells = v_cell(spark, d).select(*NARROW, "tile", "is_control", "nuc_area")
    uni = table(spark, d, "part").where("p_size > 48 and p_retailprice < 1100").select(F.col("p_brand").alias("perturbation"))
    ctrl = F.col("is_control") & (F.col("nuc_area") >= 40)
    out = S.treatment_wells(cells, uni, "perturbation", "source", "batch", ["source", "plate"], "tile", ["1", "2", "3"], ctrl, 5, ["row_key"])
    return out.select("perturbation", "source", "batch", "row_key")


@query(f"""WITH {CELL}, t AS (SELECT DISTINCT source, plate FROM v_cell WHERE perturbation = 'Brand#2' AND nuc_area > 45)
SELECT source, plate, row_key FROM (SELECT v.*, row_number() OVER (PARTITION BY source, plate ORDER BY {H}, row_key) AS rn FROM v_cell v
  WHERE is_control AND EXISTS (SELECT 1 FROM t WHERE t.source = v.source AND t.plate = v.plate)) WHERE rn = 1""")
def control_well_per_plate(spark, d):
    cells = _cells(spark, d)
    touched = cells.where("perturbation = 'Brand#2' and nuc_area > 45")
    return S.control_per_plate(cells, touched, ["source", "plate"], F.col("is_control"), ["row_key"]).select("source", "plate", "row_key")


@query(f"""WITH {CELL}, t AS (SELECT *, CASE WHEN is_control THEN 'dmso' WHEN perturbation IN ('Brand#2', 'Brand#3') THEN 'poscon' ELSE 'treatment' END AS role FROM v_cell),
r AS (SELECT *, row_number() OVER (PARTITION BY source, plate, role ORDER BY {H}, row_key) AS rn,
  sum(CASE WHEN role <> 'treatment' THEN 1 ELSE 0 END) OVER (PARTITION BY source, plate) AS used FROM t)
SELECT source, plate, role, row_key FROM r WHERE role <> 'treatment' OR rn <= 90 - used""")
def role_priority_pick(spark, d):
    role = F.when(F.col("is_control"), "dmso").when(F.col("perturbation").isin("Brand#2", "Brand#3"), "poscon").otherwise("treatment")
    return S.role_priority(_cells(spark, d), ["source", "plate"], role, 90, ["row_key"]).select("source", "plate", "role", "row_key")


@query(f"""WITH {CELL}, g AS (SELECT batch, row_number() OVER (ORDER BY md5(concat_ws('|', '42', batch)), batch) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT batch FROM v_cell WHERE NOT is_control)),
p AS (SELECT batch, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' WHEN rn <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS s FROM g)
SELECT batch, is_control, CASE WHEN is_control THEN 'train' ELSE s END AS split, count(*) AS n FROM v_cell JOIN p USING (batch) GROUP BY ALL""")
def group_split(spark, d):
    out = S.group_split(_cells(spark, d).select("batch", "is_control", "row_key"), "batch", 0.2, 0.1, pinned=F.col("is_control"))
    return out.groupBy("batch", "is_control", "split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELL} SELECT perturbation, source, count(DISTINCT (plate, well)) AS n_wells, count(DISTINCT batch) AS n_batches,
  least(5, CAST(ceil(400.0 / greatest(count(DISTINCT (plate, well)) * 2, 1)) AS BIGINT)) AS factor FROM v_cell GROUP BY perturbation, source""")
def oversample_factor(spark, d):
    cells = _cells(spark, d).select("perturbation", "source", "plate", "well", "batch")
    return S.oversample_factor(cells, ["perturbation", "source"], ["plate", "well"], "batch", cells_per_well=2, target=400)


@query(f"""WITH {CELL} SELECT perturbation, source, row_key FROM (SELECT *, row_number() OVER (PARTITION BY perturbation ORDER BY row_key) AS rn FROM v_cell) WHERE rn = 1""")
def first_row_per_key(spark, d):
    return S.first_rows(_cells(spark, d).select("perturbation", "source", "row_key"), "perturbation", ["row_key"])


@query(f"""WITH {CELL} SELECT batch, plate, well, row_key FROM (SELECT *, row_number() OVER (PARTITION BY batch, plate, well ORDER BY is_control DESC, row_key) AS rn FROM v_cell) WHERE rn = 1""")
def dedupe_keep_first(spark, d):
    cells = _cells(spark, d).select("batch", "plate", "well", "row_key", "is_control")
    return first_per_key(cells, ["batch", "plate", "well"], [F.col("is_control").desc(), "row_key"]).drop("is_control")


@query("""WITH p AS (SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 3)
SELECT doc_id, source AS tag, 'C' AS variant FROM documents WHERE doc_id IN (SELECT doc_id FROM p) UNION ALL
SELECT doc_id, upper(lang), 'S' FROM documents WHERE doc_id IN (SELECT doc_id FROM p)""")
def same_rows_across_variants(spark, d):
    docs = table(spark, d, "documents")
    return S.same_rows_across({"C": docs.select("doc_id", F.col("source").alias("tag")), "S": docs.select("doc_id", F.upper("lang").alias("tag"))}, "doc_id", 3)


@query("""WITH c AS (SELECT lang, count(*) AS n, dense_rank() OVER (ORDER BY lang) - 1 AS class_id FROM documents GROUP BY lang),
k AS (SELECT count(*) AS k, sum(n) AS rows FROM c),
s AS (SELECT i // 32 AS batch, i % 32 AS slot FROM (SELECT unnest(range(CAST(ceil(rows / 32.0) * 32 AS BIGINT))) AS i FROM k)),
w AS (SELECT s.*, c.lang, CAST('0x' || substr(md5(concat_ws('|', '42', CAST(batch AS VARCHAR), CAST(slot AS VARCHAR))), 1, 15) AS BIGINT) % c.n + 1 AS pos
  FROM s, k JOIN c ON c.class_id = (s.slot + s.batch) % k.k),
p AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) AS pos FROM documents)
SELECT batch, slot, lang, doc_id FROM w JOIN p USING (lang, pos)""")
def shard_plan_equal(spark, d):
    return shardplan.equal_per_class(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], batch_size=32)


def _whole(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', {', '.join(parts)})), 1, 15) AS BIGINT)"


def _distinct(q: str, n: str, *parts: str) -> str:
    draws = f"list_transform(range(CAST({q} AS BIGINT)), lambda i: [{_whole(*parts, 'i')} % CAST({n} - {q} + i + 1 AS BIGINT), CAST({n} - {q} + i AS BIGINT)])"
    return f"list_reduce(list_prepend(CAST([] AS BIGINT[]), {draws}), lambda a, b: list_append(a, CASE WHEN list_contains(a, b[1]) THEN b[2] ELSE b[1] END))"


def _any(q: str, n: str, *parts: str) -> str:
    return f"list_transform(range(CAST({q} AS BIGINT)), lambda i: {_whole(*parts, 'i')} % {n})"


def _balanced_sql(size: int, k: int, pinned: str, base: int, mode: str, strata: bool, again: bool = False, repeated: bool = False) -> str:
    """SQL of a balanced plan over the vectors; ``again`` and ``repeated`` draw perturbations and rows with replacement."""
    extra = _distinct(str(min(size - k * base, k)), str(k), "'extra'", "batch")
    if mode == "iid":
        picks = (_any if again else _distinct)(f"({k} - p)", "m", "'pick'", "batch")
        drawn = f"""d0 AS (SELECT batch, p, unnest({picks}) AS class_id, unnest(range({k} - p)) AS k FROM batches, sizes),
drawn AS (SELECT batch, k + p AS slot, perturbation FROM d0 JOIN free USING (class_id))"""
    else:
        drawn = f"""d0 AS (SELECT epoch, perturbation, p, {k} - p AS w, m // ({k} - p) AS blocks, row_number() OVER (PARTITION BY epoch ORDER BY md5(concat_ws('|', '42', 'perm', epoch, perturbation)), perturbation) - 1 AS r
  FROM free, sizes, (SELECT unnest(range((SELECT -(-max(batch + 1) // (max(m) // ({k} - max(p)))) + 1 FROM batches, sizes))) AS epoch)),
drawn AS (SELECT epoch * blocks + r // w AS batch, r % w + p AS slot, perturbation FROM d0 WHERE r < blocks * w AND epoch * blocks + r // w < (SELECT count(*) FROM batches))"""
    pool, layer = ("perturbation, stratum", "layer, ") if strata else ("perturbation", "")
    if strata:
        cut = f"""layers AS (SELECT perturbation, stratum, count(*) AS n, row_number() OVER (PARTITION BY perturbation ORDER BY stratum) - 1 AS layer, count(*) OVER (PARTITION BY perturbation) AS n_layers FROM wells GROUP BY perturbation, stratum),
q0 AS (SELECT batch, slot, perturbation, quota // n_layers AS each, {_distinct('(quota % n_layers)', 'n_layers', "'layer'", 'batch', 'slot')} AS more FROM slots JOIN (SELECT DISTINCT perturbation, n_layers FROM layers) USING (perturbation)),
q1 AS (SELECT batch, slot, perturbation, stratum, layer, n, each + CAST(list_contains(more, layer) AS BIGINT) AS quota FROM q0 JOIN layers USING (perturbation))"""
    else:
        cut = "q1 AS (SELECT batch, slot, perturbation, quota, n FROM slots JOIN (SELECT perturbation, count(*) AS n FROM wells GROUP BY perturbation) USING (perturbation))"
    parts = ["'row'", "batch", "slot", *["layer"] * strata]
    many, few = _any("quota", "n", *parts), _distinct("quota", "n", *parts)
    rows = many if repeated else f"CASE WHEN n >= quota THEN {few.replace('range(CAST(quota', 'range(CAST(least(quota, n)')} ELSE {many} END"
    return f"""WITH {VEC}, wells AS (SELECT id, perturbation, batch AS stratum FROM v_vec WHERE perturbation IS NOT NULL),
free AS (SELECT perturbation, row_number() OVER (ORDER BY perturbation) - 1 AS class_id FROM (SELECT DISTINCT perturbation FROM wells WHERE perturbation <> '{pinned}')),
pins AS (SELECT DISTINCT perturbation FROM wells WHERE perturbation = '{pinned}'),
sizes AS (SELECT (SELECT count(*) FROM pins) AS p, (SELECT count(*) FROM free) AS m),
batches AS (SELECT unnest(range(CAST(ceil(count(*) / {size}.0) AS BIGINT))) AS batch FROM wells),
{drawn},
both_ AS (SELECT batch, slot, perturbation FROM drawn UNION ALL SELECT batch, 0, perturbation FROM pins, batches),
slots AS (SELECT batch, slot, perturbation, {base} + CAST(list_contains({extra}, slot) AS BIGINT) AS quota FROM both_),
{cut},
picked AS (SELECT batch, slot, {pool}, unnest({rows}) AS pos, unnest(range(quota)) AS draw_no FROM q1 WHERE quota > 0),
pools AS (SELECT *, row_number() OVER (PARTITION BY {pool} ORDER BY md5(concat_ws('|', '42', id)), id) - 1 AS pos FROM wells)
SELECT batch, slot, draw_no, perturbation, {'stratum, ' if strata else ''}id FROM picked JOIN pools USING ({pool}, pos)"""


def _wells(spark, d):
    return v_vec(spark, d).select("id", "perturbation", F.col("batch").alias("stratum"))


@query(_balanced_sql(18, 4, "0", 4, "cycle", strata=True))
def shard_plan_balanced(spark, d):
    return shardplan.perturbation_balanced(_wells(spark, d), "perturbation", ["id"], batch_size=18, perturbations_per_batch=4, pinned=["0"], strata="stratum")


@query(_balanced_sql(16, 6, "3", 2, "iid", strata=False))
def shard_plan_iid(spark, d):
    return shardplan.perturbation_balanced(_wells(spark, d), "perturbation", ["id"], batch_size=16, perturbations_per_batch=6, pinned=["3"], mode="iid")


@query(_balanced_sql(40, 12, "0", 3, "iid", strata=True, again=True, repeated=True))
def shard_plan_replacement(spark, d):
    """More slots than perturbations: both are drawn with replacement, three rows a slot and one more for four."""
    return shardplan.perturbation_balanced(
        _wells(spark, d), "perturbation", ["id"], batch_size=40, perturbations_per_batch=12, pinned=["0"], mode="iid", strata="stratum",
        samples_per_perturbation=3, perturbations_with_replacement=True, rows_with_replacement=True,
    )


@query("""SELECT substr(sha256('{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}'), 1, 12) AS fp, event_id FROM events""")
def row_fingerprint(spark, d):
    return table(spark, d, "events").select(fingerprint("event_type", "event_id").alias("fp"), "event_id")
