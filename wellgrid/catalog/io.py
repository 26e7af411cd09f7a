"""Round trips of given tables through the sinks and scans, in the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import ensure_checkpoint_dir
from ..sources import readers, writers
from . import query
from .views import table


def _place(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_csv(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _place(spark, "csv")
    df.write.option("header", True).option("compression", "gzip").csv(path)
    return readers.csv_table(spark, path, df.schema)


@query("SELECT n_regionkey AS region_file, n_nationkey, n_name FROM nation")
def scan_csv_files(spark, d):
    """One file per region, read as one table that knows the file of each row."""
    df = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = _place(spark, "csv-files")
    df.repartition("n_regionkey").write.partitionBy("n_regionkey").option("header", True).csv(path)
    regions = [r[0] for r in table(spark, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]
    folders = [f"{path}/n_regionkey={r}" for r in regions]
    got = readers.csv_table(spark, folders, df.drop("n_regionkey").schema, with_file=True)
    return got.select(F.regexp_extract("file_path", r"n_regionkey=(\d+)/", 1).cast("int").alias("region_file"), "n_nationkey", "n_name")


@query("SELECT DISTINCT 'p' || CAST(vec_id % 50 AS VARCHAR) AS prefix, CAST(vec_id % 50 % 4 AS INTEGER) AS shard FROM embeddings")
def scan_shard_index(spark, d):
    """Which shard holds which key prefix, from keys and file names; the vectors are not read."""
    e = table(spark, d, "embeddings")
    path = _place(spark, "shards")
    keyed = e.select(F.concat_ws("_", F.concat(F.lit("p"), (F.col("vec_id") % 50).cast("string")), F.col("vec_id").cast("string")).alias("__key__"), "embedding", (F.col("vec_id") % 50 % 4).alias("shard"))
    found = None
    for k in range(4):  # a file's number stands in its name, so each shard is a write of one task
        keyed.where(F.col("shard") == k).drop("shard").coalesce(1).write.parquet(f"{path}/shard-{k}")
        one = readers.shard_index(spark, f"{path}/shard-{k}", shard=r"part-(\d+)").withColumn("shard", F.col("shard") + k)
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def scan_commented_tsv(spark, d):
    """A comment line of its own among the rows is skipped."""
    df = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    path = _place(spark, "tsv")
    noted = df.unionByName(df.limit(1).withColumn("n_nationkey", F.lit("! a remark")))
    noted.write.options(header=True, sep="\t").csv(path)
    return readers.commented_tsv(spark, path, readers.strings(["n_nationkey", "n_name"]))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def scan_parquet_subset(spark, d):
    """Columns and an equality reach the scan."""
    return readers.parquet_scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F"})


@query("SELECT c_custkey, c_name FROM customer")
def scan_parquet_tree(spark, d):
    path = _place(spark, "tree")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return readers.parquet_tree(spark, path).select("c_custkey", "c_name")


@query("SELECT DISTINCT trim(p_type) AS value FROM part WHERE trim(p_type) <> ''")
def scan_text_list(spark, d):
    path = _place(spark, "list")
    table(spark, d, "part").select(F.concat(F.lit("  "), "p_type").alias("value")).write.text(path)
    return readers.text_list(spark, path)


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents")
def scan_image_blobs(spark, d):
    """Shards that hold struct{bytes, path}."""
    path = _place(spark, "blobs")
    image = F.struct(F.encode("text", "UTF-8").alias("bytes"), F.lit("x").alias("path"))
    table(spark, d, "documents").select("doc_id", image.alias("image")).write.parquet(path)
    out = readers.image_blobs(spark, path, "doc_id", "image")
    return out.select("doc_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"), F.md5("bytes").alias("digest"))


@query("SELECT r_regionkey, r_name FROM region")
def sink_overwrite(spark, d):
    """The second write replaces the first."""
    path = _place(spark, "over")
    df = table(spark, d, "region").select("r_regionkey", "r_name")
    writers.overwrite(df.unionByName(df), path)
    writers.overwrite(df, path)
    return spark.read.parquet(path)


@query("""SELECT 'after a failed write' AS seen, n_nationkey, n_name, n_regionkey FROM nation
UNION ALL SELECT 'after a whole write', n_nationkey, upper(n_name), n_regionkey FROM nation WHERE n_regionkey <> 2""")
def sink_replaced(spark, d):
    """A write that fails half-way leaves the old rows; a whole one replaces them."""
    path = _place(spark, "replaced")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.replace(nations, path)
    broken = nations.withColumn("n_name", F.when(F.col("n_nationkey") == 20, F.raise_error(F.lit("broken row"))).otherwise(F.lower("n_name")))
    try:
        writers.replace(broken, path)
    except Exception as e:
        if "broken row" not in str(e):
            raise
    before = readers.current(spark, path)
    writers.replace(nations.where("n_regionkey <> 2").withColumn("n_name", F.upper("n_name")), path)
    seen = lambda df, what: df.select(F.lit(what).alias("seen"), *nations.columns)
    return seen(before, "after a failed write").unionByName(seen(readers.current(spark, path), "after a whole write"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def sink_by_plate(spark, d):
    """One folder per plate, a large plate spread over files."""
    path = _place(spark, "plates")
    writers.by_plate(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), path, ["l_returnflag", "l_linestatus"], salts=3)
    return spark.read.parquet(path)


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT min(event_id) AS low, max(event_id) AS high, count(*) AS n FROM (SELECT event_id, CAST(floor(r / ceil(n / ceil(n / 300.0))) AS BIGINT) AS file FROM r) GROUP BY file""")
def sink_resharded(spark, d):
    """Contiguous equal files, read back file by file."""
    path = _place(spark, "files")
    writers.resharded(table(spark, d, "events").select("event_id", "event_type"), path, ["event_id"], rows_per_file=300)
    files = spark.read.parquet(path).select("event_id", F.col("_metadata.file_name").alias("file"))
    return files.groupBy("file").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.count(F.lit(1)).alias("n")).drop("file")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sink_metric_csv(spark, d):
    path = _place(spark, "metric")
    writers.metric_csv(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return readers.csv_table(spark, path, T.StructType([T.StructField("event_type", T.StringType()), T.StructField("n", T.LongType())]))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events")
def sink_run_report(spark, d):
    path = _place(spark, "report")
    writers.run_report(table(spark, d, "events").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users")), path)
    return spark.read.schema("n_rows bigint, n_users bigint").json(path)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def sink_merge_parts(spark, d):
    """Parts of a plate become its partition."""
    path = _place(spark, "merged")
    writers.merge_parts(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")
