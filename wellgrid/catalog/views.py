"""Microscopy-shaped views of the driver tables, as DataFrames and as SQL common tables.

``v_cell``: line items are cells; region/nation/supplier are source/batch/plate, parts give the
well column and the perturbation (brand). ``v_fov``: orders are fields of view. ``v_vec``:
embeddings are well profiles. ``v_img``: an embedding is an 8×8 image. Derived coordinates use
remainders of keys; every row of the tables takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
CONTROL_BRAND = "Brand#1"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x, digits) + F.lit(0.0)  # no negative zero


def v_cell(spark: SparkSession, d: str) -> DataFrame:
    li, pa, su = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    na, re = table(spark, d, "nation"), table(spark, d, "region")
    j = (
        li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey)
        .join(na, su.s_nationkey == na.n_nationkey).join(re, na.n_regionkey == re.r_regionkey)
    )
    return j.select(
        F.col("r_name").alias("source"), F.col("n_name").alias("batch"), F.col("l_suppkey").cast("string").alias("plate"),
        F.concat(F.lit("W"), F.lpad(F.pmod("l_partkey", F.lit(24)).cast("string"), 2, "0")).alias("well"),
        F.col("l_linenumber").cast("string").alias("tile"), F.col("l_orderkey").alias("id_local"),
        F.col("p_brand").alias("perturbation"), F.nullif("p_type", F.lit("PROMO")).alias("inchikey"),
        F.col("l_quantity").alias("nuc_area"), F.col("l_extendedprice").alias("cyto_area"), F.col("l_discount").alias("nuc_cyto_ratio"),
        (F.col("p_brand") == CONTROL_BRAND).alias("is_control"),
        F.concat_ws(
            "__", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
            F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("bigint").cast("string"),
            (F.col("l_extendedprice") * 100 + 0.5).cast("bigint").cast("string"), F.unix_date(F.col("l_shipdate").cast("date")).cast("string"),
        ).alias("row_key"),
    )


CELL = """v_cell AS (
  SELECT r_name AS source, n_name AS batch, CAST(l_suppkey AS VARCHAR) AS plate,
         'W' || lpad(CAST(l_partkey % 24 AS VARCHAR), 2, '0') AS well, CAST(l_linenumber AS VARCHAR) AS tile,
         l_orderkey AS id_local, p_brand AS perturbation, nullif(p_type, 'PROMO') AS inchikey,
         l_quantity AS nuc_area, l_extendedprice AS cyto_area, l_discount AS nuc_cyto_ratio,
         p_brand = 'Brand#1' AS is_control,
         concat_ws('__', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
           CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS VARCHAR),
           CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR)) AS row_key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def v_fov(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    na, re = table(spark, d, "nation"), table(spark, d, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(na, c.c_nationkey == na.n_nationkey).join(re, na.n_regionkey == re.r_regionkey)
    return j.select(
        F.col("r_name").alias("source"), F.col("n_name").alias("batch"), F.col("c_mktsegment").alias("plate"),
        F.col("o_custkey").cast("string").alias("well"), F.col("o_orderkey").alias("site"), F.col("o_orderpriority").alias("kind"),
        F.col("o_totalprice").alias("price"),
    )


FOV = """v_fov AS (
  SELECT r_name AS source, n_name AS batch, c_mktsegment AS plate, CAST(o_custkey AS VARCHAR) AS well,
         o_orderkey AS site, o_orderpriority AS kind, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def v_vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("perturbation"),
        F.pmod("vec_id", F.lit(5)).cast("string").alias("batch"), F.pmod("vec_id", F.lit(10)).cast("string").alias("plate"),
        (F.col("label") == 0).alias("is_control"), F.col("embedding").alias("vec"),
    )


VEC = """v_raw AS (
  SELECT vec_id AS id, CAST(label AS VARCHAR) AS perturbation, CAST(vec_id % 5 AS VARCHAR) AS batch,
         CAST(vec_id % 10 AS VARCHAR) AS plate, label = 0 AS is_control, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
v_vec AS (SELECT *, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS unit FROM v_raw)"""


def pixels16(vec: str) -> Column:
    """Vector entries in [-1, 1] to unsigned 16-bit integers."""
    return F.transform(vec, lambda x: F.floor((x.cast("double") + 1.0) * 30000.0))


def pack(ints: Column, width: int) -> Column:
    """Little-endian bytes of an integer array."""
    byte = lambda x, i: F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0")
    return F.unhex(F.array_join(F.transform(ints, lambda x: F.concat(*[byte(x.cast("bigint"), i) for i in range(width)])), ""))


def v_img(spark: SparkSession, d: str) -> DataFrame:
    """One 8×8 image per embedding with two label images of quadrant blobs."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fov"), F.col("embedding").cast("array<double>").alias("v"))
    quad = lambda i: F.floor(i / 32) * 2 + F.floor(F.pmod(i, F.lit(8)) / 4)
    nuc = F.transform("v", lambda x, i: F.when(x > 0.05, quad(i) + 1).otherwise(0).cast("bigint"))
    cel = F.transform("v", lambda x, i: F.when(x > -0.05, 9 - quad(i)).otherwise(0).cast("bigint"))
    lev = F.transform("v", lambda x: (F.floor(F.abs(x) * 20) + 1).cast("bigint"))
    return e.select(
        "fov", F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), pack(pixels16("v"), 2).alias("pixels"),
        pack(nuc, 4).alias("nucleus"), pack(cel, 4).alias("cell_labels"), pack(lev, 4).alias("levels"), "v",
    )


PIXELS = """px AS (
  SELECT vec_id AS fov, i, i // 8 AS r, i % 8 AS c, CAST(embedding[i + 1] AS DOUBLE) AS v,
         CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1.0) * 30000.0) AS BIGINT) AS p
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
lab AS (
  SELECT *, CASE WHEN v > 0.05 THEN (i // 32) * 2 + (i % 8) // 4 + 1 ELSE 0 END AS nuc,
         CASE WHEN v > -0.05 THEN 9 - ((i // 32) * 2 + (i % 8) // 4) ELSE 0 END AS cel,
         CAST(floor(abs(v) * 20) AS BIGINT) + 1 AS lev FROM px)"""
