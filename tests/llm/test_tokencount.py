"""Edit-aware counts against encoding the edited text whole."""

import random
from pathlib import Path

import pytest

from wellgrid.llm import tokencount as T

WORDS = ["the", "Éaux", "don't", "we'll", "'s", "'", "re", "12", "3.14", "  ", "\n", "\t\n", "...", "x" * 50, "日本", "🙂", " ", "-", "'r", "e"]


@pytest.fixture(scope="module")
def counter():
    return T.Counter(Path(T.VOCABULARY).read_bytes())


def apply(text, edits):
    out, at = [], 0
    for s, e, new in edits:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def test_random_edits(counter):
    rng = random.Random(2)
    for n in range(3000):
        text = "".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.choice([0, 1, 3, 20, 200])))
        doc = T.Document(text, counter)
        assert doc.tree.total == len(counter.encoding.encode_ordinary(text))
        raw = [{"s": rng.randint(-2, len(text) + 2), "e": 0, "new": rng.choice(["", "", *WORDS])} for _ in range(rng.choice([0, 1, 1, 2, 5, 30]))]
        for x in raw:
            x["e"] = x["s"] + rng.choice([0, 0, 1, 2, 9, 60])
        edits = T.clean_edits(raw, len(text))
        doc.edit(edits)
        assert doc.tree.total == len(counter.encoding.encode_ordinary(apply(text, edits))), (text, edits)


def test_only_the_region_is_cut_anew(counter):
    text = "some plain words here " * 20_000
    doc = T.Document(text, counter)
    assert doc.edit([(200_000, 200_003, "new"), (300_000, 300_000, " more")]) < 1000


def test_counts_of_a_table(spark, counter):
    rows = [(1, None, "a", 5), (2, "", None, 5), (3, "mail me at a.b@c.example.org or 10.20.30.40 now", "s", 5), (3, "mail me at a.b@c.example.org or 10.20.30.40 now", "s", 5), (None, "word " * 50_000, "t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens long")
    got = sorted(T.count_edited(T.masking_edits(df)).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        source = next(s for i, _, s, _ in rows if i == r.doc_id) or "unknown"
        new = f"[{source}] " + text.replace("a.b@c.example.org", "<email>").replace("10.20.30.40", "<number>")
        assert (r.n_tokens, r.n_tokens_edited) == tuple(len(counter.encoding.encode_ordinary(x)) for x in (text, new))
    assert T.count_edited(T.masking_edits(df.limit(0))).count() == 0


def test_edit_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (None, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 0, 3, "1"), (1, 7, 7, " three"), (9, 0, 0, "lost"), (None, 0, 0, "y")], "doc_id long, s int, e int, new string")
    got = {r.doc_id: (r.n_edits, r.n_tokens, r.n_tokens_edited) for r in T.count_edited(T.attach_edits(docs, edits)).collect()}
    assert got == {1: (2, 2, 3), 2: (0, 1, 1), None: (0, 1, 1)}
