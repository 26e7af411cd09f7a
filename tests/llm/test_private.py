"""Base spans against plain regular expressions; what the method adds."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from wellgrid.llm import private as P
from wellgrid.llm import spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def good(kind, m):
    n = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 8 <= len(n) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_base_spans_match_plain_expressions(spark):
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    texts += [
        None, "", "a@b.c_d@e.f.g x@y", "é🙂 4539 1488 0343 6467, 4539-1488-0343-6467 1 2 3", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1..2.3.4", "+1 (2) 3456-789 +1 234 ++49 30 123456 12+1.2.3.4.5.6.7.8)",
        "9" * 60_000, "a." * 60_000 + "@x", "1 " * 60_000, "x@" * 5000 + "y.z", "+1" + "(" * 60_000, "%" * 60_000 + "@a.b", "4539148803436467" * 2, "a@b.c@d.e",
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, base string, found string").repartition(4)
    got = {r.doc_id: r for r in P.find_private(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(x.kind, x.s, x.e) for x in got[i].base] == base(t), t and t[:80]
        assert {tuple(x) for x in got[i].base} <= {tuple(x) for x in got[i].found}


def test_query_and_additions(spark):
    out = {r.doc_id: r for r in P.op1_private(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    extra = 0
    for i, t in texts.items():
        want = base(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [sum(k == x for k, *_ in want) for x in PLAIN]
        spans = [x.split(":") for x in out[i].spans.split(",") if x]
        for kind, s, e in spans:
            if kind == "secret":
                extra += 1
                assert re.search("AKIA|password|token|secret", t[int(s):int(e)])
    assert extra >= sum(len(re.findall(r'AKIA[0-9A-Z]{16}|password=[0-9a-f]{16,}|token = "[0-9a-f]{40}', t)) for t in texts.values()) > 0


def test_reliabilities():
    """A labeler that votes at random gets less say than two that agree."""
    rows = [((1, 1, 1), 40.0), ((1, 1, -1), 40.0), ((-1, -1, 1), 100.0), ((-1, -1, -1), 100.0)]
    post = P.expectation_maximisation(rows)
    assert post[1] > 0.9 and post[2] < 0.1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None), (2, "plain words")], "doc_id long, text string")
    assert [r.found for r in P.find_private(df).collect()] == [[], []]
    assert P.find_private(df.limit(0)).count() == 0


def test_long_secrets_are_whole(spark):
    text = "token=" + "a1" * 150 + " end"
    row = spark.createDataFrame([(text,)], "text string").select(P.candidates(F.col("text"), "secret").alias("c")).first()
    assert [(x.s, x.e) for x in row.c] == [(0, 306)]


def test_many_matches_in_one_text(spark):
    """Positions and context stay right over part borders, for counts around squares, marks of four bytes and matches side by side."""
    for n in (1, 2, 3, 8, 9, 10, 400):
        text = "".join(f"\U0001F600 {'mail: ' if i % 3 else ''}u{i}@x{i}.org" + ("," if i % 2 else "\n") for i in range(n)) + "end"
        df = spark.createDataFrame([(text,)], "text string")
        got = df.select(spans.match_spans(F.col("text"), P.PATTERNS["email"], 24, 1).alias("x")).first().x
        want = [(m.start(), m.end(), m.group(), text[max(m.start() - 24, 0) : m.start()], text[m.end() : m.end() + 1]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert [tuple(r) for r in got] == want and len(want) == n


def test_time_follows_the_number_of_matches(spark):
    def seconds(n):
        text = ", ".join(f"+49 170 {10_000_000 + i}" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        assert P.find_private(df).select(F.size("base")).first()[0] == n
        return time.time() - t

    seconds(100)
    assert seconds(32_000) < 4 * max(seconds(16_000), 2.0)
