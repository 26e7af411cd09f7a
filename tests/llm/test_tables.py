"""Registered queries with SQL against DuckDB, on given tables and on tables made of hard cases."""

import os

import pytest

from tests.oracle import connect, differences
from wellgrid.llm import registry

registry.load_all()
SF = os.environ.get("WELLGRID_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) == []


HARD = [
    (1, None, "de", None), (2, "", None, "a"), (3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "b"),
    (4, "ONE,two;three.four five-six seven eight nine ten eleven twelve thirteen", "en", "É"), (5, "short item here", None, None), (6, "a short ITEM here now", "fr", "a"),
    (7, "word " * 40_000, "en", "a"), (8, " nbsp ", "en", "a"), (9, "tab\tand\x0bmore", None, "b"), (None, "no id", "en", "b"), (None, None, None, None), (11, "short item here", "en", "b"),
    (12, "12345 ñandú 🙂🙂", "es", "𝒳"), (13, "12345 ñandú 🙂🙂", "es", "z"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "short item here"), (3, None), (4, ""), (10, "Short item HERE!"), (None, "no id"), (2, "ñandú 🙂🙂")]


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "extra", True) for i, t, lang, s in HARD], "doc_id long, text string, lang string, source string, n_chars long, size string, n_hit boolean").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


def duck(d):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["op2_sharding", "op3_mixing"])
def test_hard_cases_match_sql(spark, hard, name):
    assert differences(registry.QUERIES[name](spark, hard), duck(hard), registry.ORACLES[name]) == []


@pytest.mark.parametrize("block", [1, 5, 200_000])
def test_winnowing_hard_cases(spark, hard, block):
    """With one window to a block, with a few, and with all in one."""
    from wellgrid.llm import winnowing

    out = winnowing.contamination(spark.read.parquet(f"{hard}/documents.parquet"), spark.read.parquet(f"{hard}/benchmark.parquet"), block)
    out = out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").where("doc_id is not null")
    assert differences(out, duck(hard), registry.ORACLES["op5_winnowing"].replace("FROM documents)", "FROM documents WHERE doc_id IS NOT NULL)")) == []


def test_stages_on_hard_cases(spark, hard):
    """Whole rows come back with their columns, clashing names included; the empty table stays empty."""
    from wellgrid.llm import language, mixing, sharding, simhash, winnowing

    docs, items = spark.read.parquet(f"{hard}/documents.parquet"), spark.read.parquet(f"{hard}/benchmark.parquet")
    rows = {str(r) for r in docs.collect()}
    for f in (language.keep_identified, simhash.keep_one, lambda d: winnowing.drop_contaminated(d, items), mixing.take_mix):
        got = f(docs)
        assert got.columns == docs.columns and {str(r) for r in got.collect()} <= rows
        assert f(docs.limit(0)).count() == 0
    assert sharding.assign_shards(docs).count() == len(HARD)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_targets_stop_at_twice_the_size(spark):
    from wellgrid.llm import mixing

    sized = spark.createDataFrame([("a", 10), ("b", 10_000), ("c", 1000), (None, 5), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    size = {"a": 10, "b": 10_000, "c": 1000, None: 5, "d": 0}
    assert all(got[s] <= 2 * n + 1e-9 for s, n in size.items())
    assert sum(got.values()) == pytest.approx(1.5 * 11_015)
    assert got["a"] == 20 and got["d"] == 0


@pytest.mark.parametrize("seed", [f"p{i}" for i in range(4)])
def test_repeated_rows_are_mixed_one_by_one(spark, seed):
    from wellgrid.llm import mixing

    rows = [(7, "many words of one text " * 20, "a")] * 200 + [(i, f"w{i} " * (1 + i % 90), "a") for i in range(200, 400)] + [(None, "none " * 30, "b")] * 50 + [(900 + i, "x y z", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.pareto_mix(df, seed=seed).groupBy("source").agg({"taken": "sum", "size": "max", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] / 2 + 1e-6 for r in got)
    mix = mixing.take_mix(df, seed=seed)
    assert mix.count() == mixing.pareto_mix(df, seed=seed).agg({"copies": "sum"}).first()[0]


def test_repeated_rows_match_sql(spark, tmp_path):
    rows = [(7, "many words of one text " * 20, "a")] * 60 + [(i, f"w{i} " * (1 + i % 9), "a") for i in range(20)] + [(8, "c d " * 40, "b")] * 90 + [(900 + i, "x y z", "c") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert differences(registry.QUERIES["op3_mixing"](spark, str(tmp_path)), duck(str(tmp_path)), registry.ORACLES["op3_mixing"]) == []


def test_shares_of_the_lookup_table():
    from collections import Counter

    from wellgrid.llm import sharding

    t = sharding.lookup_table(sharding.SHARDS)
    n = Counter(t)
    assert len(t) == sharding.SLOTS and max(n.values()) - min(n.values()) <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(t, less) if a != sharding.SHARDS[-1])
    assert moved / sharding.SLOTS < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(sharding.SHARDS, 5004)
