"""Manifest and proofs against a tree built level by level in plain Python, and against SQL."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, differences
from wellgrid.llm import merkle

SF = "/root/testdata/sf0.001"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """Root and each leaf's steps (left, right)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[k:k + 3] for k in range(0, len(level), 3)]
        for leaf, i in enumerate(at):
            run, k = runs[i // 3], i % 3
            steps[leaf].append(("".join(run[:k]), "".join(run[k + 1:])))
            at[leaf] = i // 3
        level = [H(*r) for r in runs]
    return level[0], steps


def brute(rows):
    """(source, doc_id, leaf) rows -> sorted (doc_id, leaf, subroot, root, proof)."""
    by = {}
    for s, i, leaf in rows:
        by.setdefault(s, []).append((i is not None, i or 0, leaf))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    root, upper = tree([sub[s][0] for s in names])
    out = []
    for s, up in zip(names, upper):
        for (has, i, leaf), steps in zip(sorted(by[s]), sub[s][1]):
            out.append((i if has else None, leaf, sub[s][0], root, ";".join(f"{a}|{b}" for a, b in [*steps, *up])))
    return sorted(out, key=str)


LOPSIDED = [82, 0, 5, 1, 1, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("sizes,levels", [([1], 2), ([2], 2), ([4], 2), ([28], 2), ([1, 1], 2), ([1, 2, 9, 10], 2), ([27, 9], 1), (LOPSIDED, 1), (LOPSIDED, 2), (LOPSIDED, 6)])
def test_trees(spark, sizes, levels):
    rows = [(f"s{k}" if k else None, i, H(str(k), str(i))) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(3)
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in merkle.manifest(df, levels=levels).collect()), key=str)
    assert got == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, "a"), (None, None, "b"), ("", 1, "c"), ("", 1, "c"), ("", 2, None), ("x", 9, "")] + [("hot", 7, "same")] * 900
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    df = df.withColumns({"n": F.lit(3), "key": F.lit("k"), "root": F.lit("r"), "proof": F.lit(None).cast("string")})
    leaves = df.withColumn("leaf", merkle.row_digest([F.col(c) for c in ("doc_id", "source", "text")])).drop("text")
    out = merkle.manifest(leaves)
    got = out.withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).withColumn("bad", merkle.folded(F.lit("0" * 64), F.col("proof")) == F.col("root")).collect()
    assert all(r.ok and not r.bad and r.n == 3 and r.key == "k" for r in got)
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=str) == brute([(s, i, H(f(i), f(s), f(t))) for s, i, t in rows])
    assert merkle.manifest(leaves.limit(0)).count() == 0
    one = merkle.manifest(leaves.limit(1)).first()
    assert one.proof == "" and one.root == one.subroot == one.leaf


def test_query_against_sql(spark):
    assert differences(merkle.op13_merkle(spark, SF), connect(SF), merkle.OP13_SQL) == []


def test_crc_in_sql(spark):
    con = connect(SF)
    got = con.execute(f"SELECT doc_id, {merkle.CRC_SQL} FROM (SELECT unnest([0, 7, 10, 123456789, 9007199254740993, -5]) AS doc_id)").fetchall()
    assert all(c == zlib.crc32(str(i).encode()) for i, c in got)


def test_only_line_ends_break_proofs(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = merkle.op13_merkle(spark, SF).collect()
    assert len(got) == len(text) and len({r.root for r in got}) == 1
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in (text[r.doc_id] or ""))
    assert {r.verified for r in got} == {True, False}
