"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Copies that every document of a source is sure of (the whole
part of target / size) are allocated first. The rest of the target is a sample without
replacement: document i with inclusion probability p_i gets the ranking value
``u/(1-u) / (p/(1-p))``, ``u`` from a hash of seed and id, and the smallest values win until the
sample has its fixed size. The size is fixed in words: the running sum of sizes comes as near to
what is left of the target as one document allows.

No source is ordered in one task: the ranking values fall into fixed slices, sizes are summed by
slice on the map side, and only the slice that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from ..plans.ranking import ranged_rank
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2  # copies of a document
SLICES = 4096
SEED = "pareto-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) per source, from ``sized`` (source, size).

    Sources in order of code points, null last, take ``weights`` in turn. A target above ``most``
    times the source's size stops there, and the excess goes to the others by weight, until none
    is above. In closed form: sources fill up in the order of size / weight, so a target is
    ``least(most * size, weight * level)`` with the level that makes the targets sum up.
    The windows run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumns({
        "full": F.coalesce(F.sum("source_size").over(upto), F.lit(0)),
        "open": F.sum("weight").over(onward),
        "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(share),
    })
    level = (F.col("budget") - F.lit(float(most)) * F.col("full")) / F.col("open")
    # the first source that does not fill up sets the level for all after it
    per = per.withColumn("level", F.when(F.col("weight") * level <= F.lit(float(most)) * F.col("source_size"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cap = F.lit(float(most)) * F.col("source_size")
    return per.select("source", "source_size", F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("level"))).alias("target"))


def unit_draw(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of seed and key; rows without a key draw by their text."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("null/"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def _ranked(d: DataFrame, goal: DataFrame) -> DataFrame:
    """``d`` (__source, __u, ...) with its source's goal and its Pareto ranking value.

    ``goal`` has a row per source; Spark broadcasts it by its measured size, else it shuffles by source.
    """
    d = d.join(goal.withColumnRenamed("source", "__g"), F.col("__source").eqNullSafe(F.col("__g"))).drop("__g")
    odds = (F.col("__u") / (F.lit(1.0) - F.col("__u"))) / (F.col("__p") / (F.lit(1.0) - F.col("__p")))
    return d.withColumn("__rank", F.when(F.col("__p") > 0, odds))


def pareto_plan(sized: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source: source_size, target, and which documents the sample holds.

    ``__whole`` copies are certain; a document is in the sample if its (rank, key, size, text hash) is not
    above ``__last``, and of the rows that equal ``__cut`` in these, ``__some`` are. ``sized`` has __key, __source,
    __size, __hash and __u.
    """
    goal = source_targets(sized.select(F.col("__source").alias("source"), F.col("__size").alias("size")), share, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumns({"__whole": F.floor(rate).cast("bigint"), "__p": rate - F.floor(rate), "__left": F.col("target") - F.floor(rate) * F.col("source_size")})
    goal = checkpoint(goal)
    q = F.col("__rank") / (F.lit(1.0) + F.col("__rank"))
    d = _ranked(sized, goal).where(F.col("__rank").isNotNull()).withColumn("slice", F.floor(q * SLICES).cast("int"))
    sums = d.groupBy("__source", "slice").agg(F.sum("__size").alias("n"), F.first("__left").alias("__left"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where((F.col("before") < F.col("__left")) & (F.col("before") + F.col("n") >= F.col("__left")))
    cut = cut.select(F.col("__source").alias("__c"), F.col("slice").alias("cut"), "before")
    edge = d.join(cut, F.col("__source").eqNullSafe(F.col("__c")) & (F.col("slice") == F.col("cut")))
    # rows alike in draw, key, size and text are one class; the mark may cut a class
    at = F.struct("__rank", F.col("__key").cast("string").alias("__key"), "__size", "__hash")
    classes = edge.groupBy("__source", at.alias("at"), "before", "cut", "__left").agg(F.count(F.lit(1)).alias("n"))
    size = F.col("at.__size")
    first = F.col("before") + F.coalesce(F.sum(size * F.col("n")).over(Window.partitionBy("__source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a document that crosses the mark is in if that comes nearer to it
    fit = F.when(size > 0, F.floor((F.col("__left") - F.col("first") + size / 2.0) / size)).otherwise(F.when(F.col("first") <= F.col("__left"), F.col("n")).otherwise(0))
    classes = classes.withColumn("first", first).withColumn("in", F.greatest(F.lit(0), F.least(fit, F.col("n"))).cast("bigint"))
    start = F.struct((F.col("cut") / SLICES / (1 - F.col("cut") / SLICES)).alias("__rank"), F.lit("").alias("__key"), F.lit(-1).cast("bigint").alias("__size"), F.lit(-(2**63)).cast("bigint").alias("__hash"))
    part = (F.col("in") > 0) & (F.col("in") < F.col("n"))
    last = classes.groupBy("__source").agg(F.coalesce(F.max(F.when(F.col("in") == F.col("n"), F.col("at"))), F.first(start)).alias("__last"), F.max(F.when(part, F.col("at"))).alias("__cut"), F.coalesce(F.max(F.when(part, F.col("in"))), F.lit(0)).alias("__some"))
    return goal.join(last.withColumnRenamed("__source", "__c"), F.col("source").eqNullSafe(F.col("__c")), "left").drop("__c")


def pareto_mix(docs: DataFrame, key: str = "doc_id", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    ``docs`` has the key, ``text`` and ``source``; other columns stay, apart from those named as
    the new ones, which are replaced. Null text and text without words have size 0 and take
    nothing. Null is a source of its own. Rows without a key draw by their text. Repeated rows are taken one by one,
    as many as the target asks for. An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    d = docs.select(*[c for c in docs.columns if c not in new], F.col(key).alias("__key"), F.col("source").alias("__source"), n_words(F.col("text")).alias("__size"), F.xxhash64("text").alias("__hash"), unit_draw(F.col(key), F.col("text"), seed).alias("__u"))
    sized = checkpoint(d.select("__key", "__source", "__size", "__hash", "__u"))
    plan = checkpoint(pareto_plan(sized, share, weights, most))
    if set(docs.columns) <= {key, "source", "text"}:  # no more is asked for than the slim table has
        d = sized.withColumns({key: F.col("__key"), "source": F.col("__source")})
    d = _ranked(d, plan)
    at = F.struct("__rank", F.col("__key").cast("string").alias("__key"), "__size", "__hash")
    cut = F.coalesce(at.eqNullSafe(F.col("__cut")), F.lit(False)) & F.col("__cut").isNotNull()
    extra = F.coalesce(F.when(F.col("__rank").isNotNull(), at <= F.col("__last")), F.lit(False)).cast("int")
    if plan.where(F.col("__some") > 0).isEmpty():
        d = d.withColumn("__extra", extra)
    else:  # number the equal rows of a class that the mark cuts
        d = d.withColumn("__at_cut", cut)
        numbered = ranged_rank(d.where("__at_cut").withColumn("__row", F.xxhash64(*[c for c in docs.columns if c in d.columns])).withColumn("__tie", F.monotonically_increasing_id()), ["__source"], ["__row", "__tie"], "__number")
        some = numbered.withColumn("__extra", (F.col("__number") <= F.col("__some")).cast("int")).drop("__row", "__tie", "__number")
        d = d.where("not __at_cut").withColumn("__extra", extra).unionByName(some)
    extra = F.col("__extra")
    d = d.withColumn("size", F.col("__size")).withColumn("copies", (F.col("__whole") + extra).cast("bigint"))
    d = d.withColumn("taken", F.col("copies") * F.col("size"))
    return d.select(*[c for c in docs.columns if c in d.columns and c not in new], *new)


def take_mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows and columns of ``docs``, each row as often as the mix takes it.

    Texts aren't shuffled: the plan is a row per source.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(*[F.col(c).alias(own[c]) for c in docs.columns], key, "source", "text")
    d = pareto_mix(d, key, **options).where(F.col("copies") > 0)
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(own[c]).alias(c) for c in docs.columns])


SQL = f"""WITH d0 AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d0 GROUP BY source),
s1 AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} AS budget
       FROM s1 WINDOW f AS (ORDER BY source_size / weight, encode(source) NULLS LAST)),
s3 AS (SELECT *, CASE WHEN weight * ((budget - 2.0::DOUBLE * filled) / open) <= 2.0::DOUBLE * source_size THEN (budget - 2.0::DOUBLE * filled) / open END AS lv FROM s2),
s4 AS (SELECT *, first_value(lv IGNORE NULLS) OVER (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, weight * level) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM s5),
d1 AS (SELECT d0.*, source_size, target, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS p, target - floor(rate) * source_size AS remains,
         (CAST(CAST('0x' || substr(md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null/' || coalesce(text, ''))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / {16**12}.0::DOUBLE AS u
       FROM d0 JOIN s6 ON d0.source IS NOT DISTINCT FROM s6.source),
d2 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM d1),
d3 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d2),
d4 AS (SELECT *, whole + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE <= remains THEN 1 ELSE 0 END AS copies FROM d3)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM d4"""


@query(SQL)
def op3_mixing(spark, d):
    """Words that the mix takes of every document."""
    return pareto_mix(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
