"""Near copies against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from wellgrid.llm import nearcopies


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted(seed=11):
    rng = random.Random(seed)
    texts = [None, "", "  \t", "one", "two words", "Two  WORDS"]
    for n in [100] * 8 + [250] * 8 + [1000] * 3:
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([1, n // 60 + 1, n // 40 + 1, n // 20])):
                copy[rng.randrange(n)] = "Changed"
            texts.append("\n".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


def brute_groups(rows):
    """Smallest id of each group of near copies, by all pairs."""
    sets = {i: brute_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if find(a) != find(b) and near(sets[a], sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(i) for i in sets}


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_stage_against_all_pairs(spark, rounds):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in nearcopies.keep_one(df, rounds=rounds).collect()} == brute_groups(rows)


def crowd(n=600, seed=3):
    """Edits of one text, near its border: most pairs lie about the similarity asked for."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(220)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([2, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_one_large_group(spark):
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in nearcopies.keep_one(df).collect()} == brute_groups(rows)


@pytest.mark.parametrize("least", [2, 40])
def test_links_stay_few(spark, monkeypatch, least):
    """Links grow with the rows of the buckets, however many pairs these have; lanes change nothing."""
    monkeypatch.setattr(nearcopies, "CELL_NODES", 1024 // least)
    rows = crowd(300, 8)
    data = [nearcopies.np.frombuffer(t.encode(), nearcopies.np.uint8) for _, t in rows]
    sets = [nearcopies.shingles(x, nearcopies.np.array([0, len(x)]))[0] for x in data]
    keys = nearcopies.bands(sets).T.view("int64")
    table = [(i, s.view("int64").tolist(), keys[i].tolist(), k.astype("int64").tolist()) for i, (s, k) in enumerate(zip(sets, nearcopies.sketches(sets)))]
    st = spark.createDataFrame(table, "node long, set array<bigint>, bands array<bigint>, sketch array<bigint>")
    buckets = spark.createDataFrame([(b, int(keys[i][b]), i, (i, len(sets[i]))) for i in range(len(sets)) for b in range(nearcopies.BANDS)], "band int, h long, node long, at struct<node: bigint, size: bigint>")
    none = spark.createDataFrame([], "node long, root long")
    found = nearcopies.crossing_links(buckets, st, none).collect()
    lanes = -(-300 // nearcopies.CELL_NODES)
    assert len(found) <= nearcopies.BANDS * len(rows) * lanes
    assert all(near(brute_set(rows[r.u][1]), brute_set(rows[r.v][1])) for r in found)
    root = list(range(len(rows)))
    for _ in range(20):
        for r in found:
            root[r.u] = root[r.v] = min(root[r.u], root[r.v], root[root[r.u]], root[root[r.v]])
    assert {i for i in range(len(rows)) if root[i] == i} == brute_groups(rows)


def test_pipeline_drops_near_copies(spark):
    rows = planted(12)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    out = stage(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == brute_groups(rows)


def test_ids_that_repeat_or_lack(spark):
    texts = ["red apples fall from old trees", "ships sail over the cold sea", "nobody reads the long manual"]
    rows = [(None, t) for t in texts] + [(4, "quiet rivers run through green valleys"), (4, "seven engines hum below the deck"), (9, texts[0]), (9, texts[0])]
    kept = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("9", texts[0]), ("None", texts[1]), ("None", texts[2]), ("4", rows[3][1]), ("4", rows[4][1])])
    assert nearcopies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_proposes(spark, monkeypatch):
    """With no band shared by chance alone, slight edits are still found, through their fingerprints."""
    rng = random.Random(5)
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(900)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base + ["end"])), (3 * i + 2, " ".join([f"v{x}" for x in base]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(nearcopies, "leading_links", lambda b, s, r, proposed: nearcopies.similar(proposed, s))
    monkeypatch.setattr(nearcopies, "crossing_links", lambda b, s, g: spark.createDataFrame([], "u long, v long"))
    kept = {r.doc_id for r in nearcopies.keep_one(df).collect()}
    assert {r for r in kept if r % 3 != 1} == {r for r, _ in rows if r % 3 != 1} and len(kept) <= 50
