"""The pipeline's stages followed in plain Python."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_nearcopies import brute_groups
from wellgrid.llm import sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.collect())
    return kept


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_stages_keep_columns(spark, stages):
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(r.asDict()) == columns for rows in stages[:5] for r in rows)
    assert all(set(r.asDict()) == columns | {"slot", "shard"} for r in stages[5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "near-duplicates", "benchmark decontamination", "mixing to target weights", "sharding"]


def test_language_keeps_prose(stages):
    kept = {r.doc_id for r in stages[1]}
    assert all(r.doc_id in kept for r in stages[0] if r.text and len(words(r.text)) > 30)


def test_one_of_each_group(stages):
    assert {r.doc_id for r in stages[2]} == brute_groups([(r.doc_id, r.text) for r in stages[1]])


def contaminated(text, windows):
    w = words(text)
    hit = set()
    for n, grams in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in grams:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_no_benchmark_text_stays(stages):
    windows = {}
    for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(n, set()).add(tuple(w[i:i + n]))
    want = {r.doc_id for r in stages[2] if not contaminated(r.text, windows)}
    assert {r.doc_id for r in stages[3]} == want and len(want) < len(stages[2])


def test_mix_and_shards(stages):
    size = lambda t: len((t or "").translate({i: " " for i in range(9, 14)}).split(" ")) - (t or "").translate({i: " " for i in range(9, 14)}).split(" ").count("")
    per, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3]:
        per[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in stages[4]:
        taken[r.source] += size(r.text)
    sources = sorted(per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(per.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * per[s]}
        for s in full or open_:
            target[s] = 2 * per[s] if full else weight[s] * level
            left -= target[s]
        open_ -= full or open_
    for s in sources:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 2
    owner = sharding.lookup_table(sharding.SHARDS)
    assert all(r.shard == owner[r.slot] == owner[sharding._hash(str(r.doc_id)) % sharding.SLOTS] for r in stages[5])
    assert len(stages[5]) == len(stages[4])


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, got)) == sorted(map(str, stages[5]))


def test_run_reads_parquet(spark):
    assert all(f.endswith(".parquet") for f in corpus_pipeline.run(spark, SF).inputFiles() or ["none"])
