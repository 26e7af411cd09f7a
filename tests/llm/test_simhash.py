"""SimHash groups against all pairs compared one by one."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wellgrid.llm import simhash
from wellgrid.llm.components import components


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.translate({i: " " for i in range(9, 14)}).split(" ") if x]
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    parent = list(range(len(ids)))
    a = np.array(fps, np.uint64)
    for i in range(len(ids)):
        near = np.array([int(x).bit_count() for x in a ^ a[i]]) <= 2
        for j in np.flatnonzero(near):
            parent[find(parent, i)] = find(parent, int(j))
    best = {}
    for i, x in enumerate(ids):
        r = find(parent, i)
        best[r] = min(best.get(r, x), x)
    return {x: best[find(parent, i)] for i, x in enumerate(ids)}


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(300)]
    texts = [None, "", "  \t", "one", "two words", "Two  WORDS", "nbsp stays one", "long " * 30_000]
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([5, 40, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 6])):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append("\n".join(near))
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, n int").repartition(5)
    got = {r.doc_id: r for r in simhash.groups(df).collect()}
    fps = [brute_fp(t) for t in texts]
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == dict(enumerate(fps))
    assert {i: r.component_id for i, r in got.items()} == brute_components(range(len(fps)), fps)


def near_set(seed, bases, per, spread):
    rng = np.random.default_rng(seed)
    out = []
    for b in rng.integers(0, 2**63, bases, dtype=np.uint64):
        for _ in range(per):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, spread)):
                x ^= 1 << int(bit)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("crowd", [1, 8, 512])
def test_links_at_every_crowd_limit(spark, crowd):
    """Crowded buckets cut finer lose no link, whatever the limit."""
    fps = near_set(1, 12, 25, 5) + near_set(2, 1, 300, 4)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    edges = simhash.links(df, crowd=crowd)
    comp = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(edges).collect()}
    want = brute_components(fps, fps)
    groups, wanted = {}, {}
    for x in fps:
        groups.setdefault(comp.get(x, x), set()).add(x)
        wanted.setdefault(want[x], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_bit_sliced_distances():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 130, dtype=np.uint64)
    fps[1], fps[2], fps[3] = fps[0] ^ np.uint64(3), fps[0] ^ np.uint64(7), fps[0]
    for radius in (0, 1, 2, 3, 30, 64):
        planes = simhash.planes_of(fps, np.arange(130), 3)
        for probe in fps[:5]:
            mask = simhash.within(planes, np.repeat(probe, 3), radius)
            got = np.unpackbits(mask.view(np.uint8), bitorder="little")[:130].astype(bool)
            assert (got == np.array([int(x ^ probe).bit_count() <= radius for x in fps])).all()


def test_large_groups_are_compared_whole():
    fps = np.array(near_set(7, 3, 90, 4), np.uint64)
    u, v = simhash.forest(fps, np.array([len(fps)]), 2)
    parent = {int(x): int(x) for x in fps}
    for a, b in zip(u.tolist(), v.tolist()):
        parent[find(parent, a)] = find(parent, b)
    want = brute_components([int(x) for x in fps], [int(x) for x in fps])
    assert len({find(parent, int(x)) for x in fps}) == len(set(want.values()))


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}
    for a, b in edges:
        if a is not None and b is not None:
            parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "s"), (2, "A b c d  e", "t"), (3, "other words here now", None), (3, "other words here now", None), (None, "a b c d e", "z"), (7, None, "s"), (8, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("component_id", F.lit(1))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e"), (3, "other words here now"), (7, None)]


def test_groups_that_share_an_id_stay_apart(spark):
    """Different texts under null ids, and under one repeated id, are different groups."""
    texts = ["red apples fall from old trees", "ships sail over the cold sea", "nobody reads the long manual"]
    rows = [(None, t) for t in texts] + [(4, "quiet rivers run through green valleys"), (4, "seven engines hum below the deck"), (9, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("9", texts[0]), ("None", texts[1]), ("None", texts[2]), ("4", rows[3][1]), ("4", rows[4][1])])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(df).count() == 0
    assert simhash.keep_one(df).count() == 0
