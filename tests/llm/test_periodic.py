"""Runs against plain loops over periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wellgrid.llm import periodic

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=6, repeats=4):
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sample(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        block = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        return (block * (n // len(block) + 1))[:n]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    w = [rng.randrange(1000) for _ in range(n)]
    for _ in range(4):
        p, at = rng.randint(1, 12), rng.randrange(n + 1)
        w[at:at + 60] = (w[at:at + p] * 60)[:len(w[at:at + 60])]
    return w


@pytest.mark.parametrize("repeats", [2, 3, 4, 6])
def test_runs_of_random_texts(repeats):
    rng = random.Random(repeats)
    for _ in range(60):
        texts = [sample(rng, rng.choice([0, 1, 3, 5, 6, 7, 12, 40, 150, 400])) for _ in range(rng.randint(1, 6))]
        got = periodic.runs([np.array(t, np.int32) for t in texts], 6, repeats)
        for t, r in zip(texts, got):
            assert list(map(tuple, r.tolist())) == brute_runs(t, 6, repeats), t


def test_extensions_of_all_pairs():
    rng = random.Random(9)
    for n in (1, 2, 12, 13, 14, 27, 90):
        s = [rng.randrange(2) for _ in range(n)] + [99]
        lce = periodic.Extensions(np.array(s))
        i, j = np.triu_indices(len(s), 1)
        want = [next((t for t in range(len(s) - b) if s[a + t] != s[b + t]), len(s) - b) for a, b in zip(i, j)]
        assert lce(i, j).tolist() == want


def cyclic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def test_query_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in periodic.op12_periodic(spark, SF).collect()}
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        w = cyclic(r.doc_id, re.findall("[^\x20\x09-\x0d]+", r.text or ""))
        if len(w) > 1500:
            continue
        found = brute_runs(w)
        some += bool(found)
        x = got[r.doc_id]
        assert x.n_runs == len(found) and x.n_words == len(w)
        best = min(((-n, s, q) for s, n, q in found), default=None)
        assert (x.start, x.length, x.period, x.exponent_milli) == ((best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(brute_collapse(w, found).encode()).hexdigest()
    assert some > 5


def test_edges(spark):
    long = " ".join(["tick", "tock"] * 60_000 + ["end"])
    rows = [(None, None, 1), (1, "", 2), (1, " \t\x0b", 3), (2, "a a a a a a", 4), (2, "a a a a a a", 4), (3, long, 5), (4, "x" * 300_000, 6), (5, "É É É É É É b", 7), (6, "A a A a A a A a", 8), (7, "a a " * 6, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long").withColumnRenamed("runs", "n_words").repartition(3)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df).collect()), key=str)
    assert len(got) == len(rows) and periodic.find_runs(df.limit(0)).count() == 0
    by = {}
    for i, n, found, text in got:
        by.setdefault(i, []).append((n, found, text))
    assert by[None] == [(0, [], "")] and by[1] == [(0, [], "")] * 2
    assert by[2] == [(6, [(0, 6, 1)], "a")] * 2
    assert by[3] == [(120_001, [(0, 120_000, 2)], "tick tock end")]
    assert by[4] == [(1, [], "x" * 300_000)] and by[5] == [(7, [(0, 6, 1)], "É b")]
    assert by[6] == [(8, [(0, 8, 2)], "A a")] and by[7] == [(6, [(0, 6, 1)], "a a")]


def test_cycles_of_odd_rows(spark):
    chosen = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(None, "a b"), (chosen, None), (chosen, "  "), (chosen, " one two\nthree four five six seven ")]
    got = [r.text for r in periodic.with_cycles(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert got[:3] == ["a b", None, "  "] and got[3] == " ".join(cyclic(chosen, rows[3][1].split()))
