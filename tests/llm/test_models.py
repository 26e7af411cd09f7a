"""Language, severity and nearest neighbours: held-out accuracy, recall, hard cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellgrid.llm import language, toxicity, vptree

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = language.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard_cases(spark):
    rows = [(0, "the cat and the dog", "en", 1), (1, "le chat et le chien", "fr", 1), (2, None, "en", 1), (3, "", "fr", 1), (5, "12 + 34", None, 1), (6, "le chien, le chat!", None, 1), (7, "THE dog", None, 1), (None, "cats", "en", 1), (9, "hund " * 50_000, "de", 1), (9, "hund", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = language.learn(df)
    got = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in language.predict(df, model).collect()}
    assert got[2, "en"] == got[3, "fr"] == got[5, None] == ("und", 0.0)
    assert got[6, None][0] == "fr" and got[7, None][0] == "en" and got[9, "de"][0] == "de"
    assert language.identify(df.limit(0)).count() == 0
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_language_of_long_runs(spark):
    """Runs that are too long for words teach their n-grams."""
    df = spark.createDataFrame([("天地玄黄宇宙洪荒" * 8, "zh"), ("the cat and the dog", "en")], "text string, lang string")
    got = language.predict(spark.createDataFrame([(1, "宇宙洪荒" * 15)], "doc_id long, text string"), language.learn(df)).first()
    assert got.lang_pred == "zh"


def test_unknown_words_fall_back_to_shorter_grams(spark):
    df = spark.createDataFrame([("abcdef abcdef xy", "aa"), ("uvwxyz uvwxyz", "bb")], "text string, lang string")
    m = language.Model(language.learn(df).collect())
    known, by_four, by_one, never = m.score(["abcdef", "zzabcdzz", "u", "ж"])
    assert known[0] > known[1] == language.PENALTY
    assert by_four[0] > by_four[1] and by_one[1] > by_one[0]
    assert (never == language.PENALTY).all()


def test_language_model_is_bounded(spark):
    df = spark.createDataFrame([(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x", "ab"[i % 2]) for i in range(600)], "text string, lang string")
    model = language.learn(df, entries=100)
    per = {(r.lang, r.kind): r["count"] for r in model.groupBy("lang", "kind").count().collect()}
    assert len(per) == 10 and max(per.values()) <= 100 and per["a", 0] > 80
    assert sorted(model.collect()) == sorted(language.learn(df.repartition(9), entries=100).collect())


def test_language_keeps_the_most_frequent_keys(spark):
    """Scores by hand: counts, limit, word first, then the longest n-grams known."""
    texts = {"aa": "one one one two two three un", "bb": "uno uno dos dos dos one"}
    df = spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string")
    model = {(r.lang, r.kind, r.key): r.logf for r in language.learn(df, entries=2).collect()}
    want = {("aa", "one"): 3 / 7, ("aa", "two"): 2 / 7, ("bb", "dos"): 3 / 6, ("bb", "uno"): 2 / 6}
    assert {(k[0], k[2]): v for k, v in model.items() if k[1] == 0} == {k: pytest.approx(np.log10(v)) for k, v in want.items()}
    full = language.learn(df)
    logf = {(r.lang, r.kind, r.key): r.logf for r in full.collect()}
    for text in ["one dos", "one, onex!", "twofold unodos", "zzz", "ОДИН one"]:
        means = []
        words = [w for w in language.LETTERS.findall(text.lower())]
        for lang in ("aa", "bb"):
            total = 0.0
            for w in words:
                if any((x, 0, w) in logf for x in texts):
                    total += logf.get((lang, 0, w), language.PENALTY)
                    continue
                pad, score = f" {w} ", language.PENALTY
                for size in range(language.GRAMS, 0, -1):
                    grams = [g for g in (w if size == 1 else [pad[i:i + size] for i in range(len(pad) - size + 1)]) if any((x, size, g) in logf for x in texts)]
                    if grams:
                        score = sum(logf.get((lang, size, g), language.PENALTY) for g in grams) / len(grams)
                        break
                total += score
            means.append(total / len(words))
        got = language.predict(spark.createDataFrame([(text,)], "text string").withColumn("k", F.lit(1)), full).first()
        assert got.lang_pred == ("aa" if means[0] >= means[1] else "bb")
        assert got.score == pytest.approx(1 / sum(10 ** (m - max(means)) for m in means))


def test_only_letters_are_words(spark):
    assert [list(language.words_of(t)) for t in ("½", "²³", "Ⅷ", "हिन्दी", "ภาษาไทย", "(l’ami)", "«où?»", "a1b")] == [[], [], [], ["हिन्दी"], ["ภาษาไทย"], ["l", "ami"], ["où"], ["a", "b"]]
    model = language.learn(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string"))
    df = spark.createDataFrame([("½",), ("² ³",), ("Ⅷ",), ("1 2",), ("\u0301",)], "text string").withColumn("k", F.lit(0))
    assert {(r.lang_pred, r.score) for r in language.predict(df, model).collect()} == {("und", 0.0)}


def test_severity_of_labelled_documents(spark):
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    got = toxicity.op7_toxicity(spark, SF).join(marks, "doc_id").collect()
    clean = [r for r in got if r.label == 0]
    assert sum(r.toxic for r in clean) / len(clean) < 0.02
    bad = [r for r in got if r.label == 1]
    assert sum(r.toxic for r in bad) / len(bad) > 0.5
    assert all(0 <= r.severity <= 2 for r in got)


def test_severity_hard_cases(spark):
    rows = [(i, "you idiot " + "fine words here " * (i % 7) if i % 3 == 0 else "fine words here", 1) for i in range(90)] + [(100, None, 1), (101, "", 1), (102, "idiot " * 40_000, 1), (None, "idiot", 1), (102, "idiot " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.grade(docs, labels).collect()}
    assert got[102].toxic and got[None].toxic and not got[100].toxic and not got[101].toxic and not got[1].toxic
    assert got[102].severity > got[60].severity > got[1].severity
    assert toxicity.grade(docs.limit(0), labels).count() == 0
    assert not any(r.toxic for r in toxicity.grade(docs, labels.limit(0)).collect())


def test_one_copied_document_hides_no_words(spark):
    """A third of the labelled rows are one toxic text; the words of the others still tell."""
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}{c}word" for a in "bdfghk" for b in "aeiou" for c in "lmnprst"]
    bad = ["idiot", "moron", "scum", "loser", "trash", "clown"]
    fine = [" ".join(rng.choice(plain, 30)) for _ in range(300)]
    toxic = [" ".join([*rng.choice(plain, 30), *rng.choice(bad, 4)]) for _ in range(100)]
    hot = " ".join(f"{a}{b}{c}{a}harmless" for a in "vwxyzq" for b in "aeiou" for c in "bcdfgklmnprst")
    texts = [*fine, *toxic, *[hot] * 200]
    rows = list(enumerate(texts)) + [(1000 + i, f"{w} {w} you {w}") for i, w in enumerate(bad)] + [(2000, "you and others")]
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(len(texts))], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.grade(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(got[1000 + i] for i in range(len(bad))) and not got[2000]


def test_repeated_rows_teach_once(spark):
    """More rows under one id than there are labelled ids."""
    rows = [(i, f"you idiot {i}" if i % 3 == 0 else f"fine words {i}") for i in range(90)] + [(0, "you idiot 0")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    features, _ = toxicity.learn(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"))
    assert "idiot" in features


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, 600)
    grade = np.clip(x - (rng.random(600) < 0.1), 0, 2)
    m = toxicity.fit(np.arange(600), np.zeros(600, int), x.astype(float), grade, 1, 3)
    assert m.weights[0] > 0 and m.thresholds[0] < m.thresholds[1]
    assert (m.grades(x * m.weights[0]).argmax(axis=1) == grade).mean() > 0.85


def exact(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (vptree.FACTOR, 0.9)])
def test_neighbours(spark, factor, least):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = v.collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), 20)
    got = found(vptree.search(v, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=700, query_rows=40))
    assert got.keys() == want.keys()
    recall = np.mean([sum(b >= want[q][-1][1] - 1e-12 for _, b in got[q]) / 20 for q in want])
    assert recall >= least and all(len(x) == 20 for x in got.values())
    assert all(x == sorted(x, key=lambda p: (-p[1], p[0])) for x in got.values())


def test_equal_vectors_go_by_key(spark):
    rows = [(i, [1.0, 0.5] if i % 2 else [0.5, 1.0]) for i in range(700, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = found(vptree.search(df, F.col("vec_id") % 20 == 0, shard_rows=50))
    assert all([i for i, _ in got[q]] == [i for i in range(2, 60, 2) if i != q][:20] for q in range(20, 701, 20))


def test_different_vectors_of_equal_score_go_by_key(spark):
    rng = np.random.default_rng(4)
    order = rng.permutation(400) + 1
    rows = [(0, [1.0, 0.0])] + [(int(i), [1.0, float(y)]) for i, y in zip(order, np.linspace(-3, 3, 400))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = found(vptree.search(df, F.col("vec_id") == 0, factor=1.0, shard_rows=150))
    assert got[0] == [(i, 1.0) for i in range(1, 21)]


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_many_ties_against_brute_force(spark, factor):
    rng = np.random.default_rng(7)
    x = rng.integers(-1, 2, (3000, 8)).astype(float)
    x[(x == 0).all(axis=1), 0] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    want = exact(np.arange(len(x)), x, 20)
    got = found(vptree.search(df, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=700, query_rows=50))
    same = np.mean([got[q] == want[q] for q in want])
    assert same == 1.0 if factor == 1.0 else same > 0.9


def test_neighbours_hard_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (20, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (0, [1.0, 0.0]), (40, []), (60, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = found(vptree.search(df, F.col("vec_id") % 20 == 0, factor=1.0))
    assert got[0] == [(1, 2.0), (2, 2.0), (20, 0.0), (8, -1.0)]
    assert got[20] == [(0, 0.0), (1, 0.0), (2, 0.0), (8, 0.0)]
    assert 40 not in got and 60 not in got
    assert vptree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_toxicity_shuffles_few_unlabelled_texts(spark):
    """Every labelled row comes through the filter, repeated keys too, and hardly any other."""
    texts = spark.range(20_000).select((F.col("id") % 19_000).alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    marks = spark.range(0, 19_000, 10).select(F.col("id").alias("k"))
    got = toxicity.maybe_marked(texts, marks, "k")
    assert got.columns == ["k", "text"]
    want = texts.join(marks, "k").count()
    assert got.join(marks, "k").count() == want and got.count() <= want + 20
    assert toxicity.maybe_marked(texts, marks.limit(0), "k").count() == 0
    names = texts.select(F.col("k").cast("string").alias("k"), "text")
    assert toxicity.maybe_marked(names, marks.select(F.col("k").cast("string")), "k").join(marks, "k").count() == want
