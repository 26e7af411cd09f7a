"""Context-tree weighting against a recursion over explicit counts, and the word baseline."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wellgrid.llm import contexttree as C

TEXTS = [
    "the cat sat on the mat", "The cat ate the rat", None, "", "  \t ", "é è 🙂 the", "a\x0bb c", "aaaa aaaa aaaa", "x" * 3000, "the cat sat on the mat",
    "completely different words", "mat the on sat", "\n", "numbers 12 12 12", "the", "Ünseen ßtuff",
]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False


def brute(rows):
    """log10 probability of each text."""
    counts = defaultdict(lambda: [0, 0])  # (context, node) of every depth
    children = defaultdict(set)

    def path(data, i):
        return [data[i - d:i] for d in range(C.DEPTH + 1)]

    def decisions(byte):
        for s in range(8, 0, -1):
            yield (byte | 256) >> s, (byte | 256) >> (s - 1) & 1

    coded = [bytes([C.END] * C.DEPTH) + lower(t).encode() + bytes([C.END]) for _, t in rows]
    for (i, _), data in zip(rows, coded):
        if not held(i):
            for at in range(C.DEPTH, len(data)):
                contexts = path(data, at)
                for node, bit in decisions(data[at]):
                    for c in contexts:
                        counts[c, node][bit] += 1
                    for shallow, deep in zip(contexts, contexts[1:]):
                        children[shallow, node].add(deep)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(c, node):
        key = c, node
        if key not in memo:
            own = kt(*counts[key])
            if len(c) < C.DEPTH:
                deep = sum(weighted(x, node)[0] for x in children[key])
                top = max(own, deep)
                memo[key] = top + math.log((math.exp(own - top) + math.exp(deep - top)) / 2), 1 / (1 + math.exp(deep - own))
            else:
                memo[key] = own, 1.0
        return memo[key]

    out = []
    for data in coded:
        total = 0.0
        for at in range(C.DEPTH, len(data)):
            for node, bit in decisions(data[at]):
                p = 0.5
                for c in reversed(path(data, at)):
                    if (c, node) in counts:
                        n = counts[c, node]
                        stop = weighted(c, node)[1]
                        p = stop * (n[bit] + 0.5) / (sum(n) + 1) + (1 - stop) * p
                total += math.log10(p) if p else 0
        out.append(total)
    return out


def test_scores_match_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    assert any(held(i) for i, _ in rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    docs = C.with_block(df, "doc_id", "text").withColumn("held_out", C.is_held_out(F.col("doc_id"))).withColumn("bytes", F.col("text"))
    got = {(r.doc_id, r.bytes): r for r in C.score(docs).collect()}
    want = dict(zip(rows, brute(rows)))
    assert len(got) == len(want)
    train = Counter(w for i, t in rows if not held(i) for w in [*lower(t).translate({x: " " for x in range(9, 14)}).split(" "), "END"] if w)
    n, v = train.total(), len(train)
    for (i, t), score in want.items():
        r = got[i, t]
        assert r.score == pytest.approx(score, rel=1e-5)
        words = [w for w in lower(t).translate({x: " " for x in range(9, 14)}).split(" ") if w] + ["END"]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in train for w in words), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    docs = C.with_block(df, "text").withColumn("held_out", F.lit(True))
    assert {r.doc_id: (r.score, r.n_known, r.base_score) for r in C.score(docs).collect()} == {1: (pytest.approx(24 * math.log10(0.5)), 0, 0.0), 2: (pytest.approx(8 * math.log10(0.5)), 0, 0.0)}
    assert C.score(docs.limit(0)).count() == 0


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1.0, 1.5, 2.5, 7.9, 8.0, 1e3 + 0.5, 1e9])
    assert C._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)


def test_probabilities_sum_to_one(spark):
    """All continuations of one context."""
    text = "abracadabra " * 5
    rows = [(f"{i}", i != 0, text if i == 0 else "zzabra" + chr(i)) for i in range(128)]
    df = spark.createDataFrame(rows, "key string, held_out boolean, text string").withColumn("block", F.lit(1).cast("long"))
    data = {r.key: r.score for r in C.score(df).collect()}
    assert all(v < 0 for v in data.values())
