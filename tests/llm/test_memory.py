"""Helpers of tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wellgrid.llm import arrow_text
from wellgrid.llm.components import components


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 10, None, "", "é" * 300, "b", "c" * 90])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(6))], names=["text", "i"])
    seen = []
    for rows, data, offsets in arrow_text.text_slices(batch, limit=100):
        raw = data.tobytes()
        for i, a, b in zip(rows.column("i").to_pylist(), offsets[:-1], offsets[1:]):
            seen.append((i, raw[a:b].decode()))
    assert seen == [(i, t or "") for i, t in enumerate(texts.to_pylist())]


def test_words_stay_inside_their_text():
    data, offsets = arrow_text.text_bytes(pa.array(["ab Cd", "ef", None, " x "]))
    space = np.ones(256, bool)
    space[32] = False
    w = arrow_text.words(data, offsets, space)
    assert [w.text(i, i + 1) for i in range(len(w.starts))] == [b"ab", b"cd", b"ef", b"x"]
    assert w.first.tolist() == [0, 2, 3, 3, 4]
    again = arrow_text.words(*arrow_text.text_bytes(pa.array(["CD"])), space)
    assert again.hashes[0] == w.hashes[1] != w.hashes[0]


def test_give_back_is_harmless():
    arrow_text.give_back()


def test_component_rounds_do_not_swell_the_plan(spark):
    """A long path takes many rounds; the size estimate of the result must not be a product over them."""
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    comp = components(path)
    assert comp._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
    assert comp.agg(F.count("*"), F.max("root")).first()[:] == (301, 0)


def shuffles_of(spark, edges):
    """Distinct nodes and roots of ``components``, and the stages that Spark ran for it."""
    tracker, group = spark.sparkContext.statusTracker(), "stages-of-components"
    spark.sparkContext.setJobGroup(group, group)
    got = sorted(tuple(r) for r in components(edges).collect())
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(stages)


def test_stars_take_no_round(spark):
    """What the driver keeps grows with stages; edges that are stars already need none but those that say so."""
    stars = spark.createDataFrame([(10 * g + i, 10 * g) for g in range(5) for i in range(1, 10)], "u long, v long")
    got, stages = shuffles_of(spark, stars)
    assert got == sorted((10 * g + i, 10 * g) for g in range(5) for i in range(10))
    assert stages < 20
