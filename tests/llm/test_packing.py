"""Packing against whole-text encoding, gapless sequences and packing item by item."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from wellgrid.llm import packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(packing.VOCABULARY)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def best_fit(lengths, capacity):
    """Sequences used by plain best-fit, one item after another."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(gaps, n)
        insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - n)
    return len(gaps)


def filled(rules, counts, capacity):
    """Contents by sequence; each piece has a place and sequences have no holes."""
    at, placed = {}, Counter()
    for length, rank, n, first, per, offset in rules.tolist():
        assert placed[length] == rank
        placed[length] += n
        for k in range(n):
            at.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert placed == Counter({k: v for k, v in counts.items() if v})
    for spots in at.values():
        spots.sort()
        assert [o for o, _ in spots] == [0, *np.cumsum([n for _, n in spots])[:-1]] and sum(n for _, n in spots) <= capacity
    assert sorted(at) == list(range(len(at)))
    return at


@pytest.mark.parametrize("capacity", [1, 2, 3, 7, 30, 100])
def test_plans(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 5, 50, 400]))]
        if rng.random() < 0.5:
            lengths = [max(1, n // rng.choice([1, 2, 5])) for n in lengths]
        counts = Counter(lengths)
        at = filled(packing.plan(counts, capacity), counts, capacity)
        assert len(at) <= best_fit(lengths, capacity) + 1
        assert len(at) >= -(-sum(lengths) // capacity)
        assert all(sum(3 * n > capacity for _, n in spots) <= 2 for spots in at.values())


def test_large_pieces_are_a_largest_matching():
    """Above a third, sequences are as few as a largest matching of pairs that fit leaves."""
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted(rng.randint(11, 30) for _ in range(rng.randint(1, 25)))
        pairs, lo, hi = 0, 0, len(lengths) - 1
        while lo < hi:
            if lengths[lo] + lengths[hi] <= 30:
                pairs, lo = pairs + 1, lo + 1
            hi -= 1
        counts = Counter(lengths)
        assert len(filled(packing.plan(counts, 30), counts, 30)) == len(lengths) - pairs


def test_rules_stay_few():
    rng = random.Random(1)
    counts = {n: rng.randint(0, 10**9) for n in range(1, 2049)}
    rules = packing.plan(counts)
    assert len(rules) < 100_000 and rules[:, 2].sum() == sum(counts.values())


def test_words_alone_encode_like_the_whole(whole):
    encoder = packing.Encoder(Path(packing.VOCABULARY).read_bytes())
    rng = random.Random(3)
    bits = ["the", "Éaux", "don't", "WE'LL", "'s", "12", "3.14", " ", "  ", "\n", "\t", "\r\n", "\x0b", "…", "日本語", "🙂", " ", " ", "é", "́", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "x" * 90, "-"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.choice([0, 1, 4, 40])))
        assert [*encoder.ids([text])[0].tolist(), 0] == whole(text), text
    texts = ["".join(rng.choice(bits[:8]) + " " for _ in range(rng.randrange(9))) for _ in range(300)]
    assert [[*x.tolist(), 0] for x in encoder.ids(texts)] == [whole(t) for t in texts]


def check(rows, texts, whole, capacity=2048):
    by, spots = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, text in texts.items():
        ids = np.array(whole(text), "<u4")
        want = [(k, a, len(ids[a:a + capacity]), zlib.crc32(ids[a:a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[key]) == want
    for s in spots.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= capacity
    return len(spots)


def test_query_over_documents(spark, whole):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op11_packing(spark, SF).collect()
    n = check(rows, {r.doc_id: r.text for r in docs}, whole)
    assert n <= best_fit([r.length for r in rows], 2048) and n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark, whole, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 1000)
    long = "wörter und  mehr\n" * 5000
    rows = [(None, None, 1, "x"), (1, "", 2, None), (2, "a", 3, ""), (3, long, 4, "y"), (3, long, 4, "y")] + [(10, "same text", 5, "z")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int, length string").repartition(7)
    packed = packing.pack(df)
    got = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert sum(r.doc_id == 10 for r in got) == 300 and sum(r.doc_id == 3 and r.piece == 0 for r in got) == 2
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert max(map(len, joined.values())) <= 2048
    for r in got:
        assert joined[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    pieces = sorted((r.piece, r.ids) for r in got if r.doc_id == 3)
    assert [i for _, p in pieces[::2] for i in p] == whole(long)
    assert [r.ids for r in got if r.doc_id is None or r.doc_id == 1] == [[0], [0]]
    assert packing.pack(df.limit(0)).count() == 0
