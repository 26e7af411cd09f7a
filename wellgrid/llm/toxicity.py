"""Toxicity grades by cumulative-link ordinal regression.

``P(grade <= k | x) = sigmoid(threshold_k - w.x)``: one weight vector for all thresholds, which are
ordered by construction. Features are log(1 + count) of the words and word beginnings (four to six
letters, so that inflected forms count together) that tell labelled toxic documents from others: all
whose z-value is above ``TELLING``, from counts over every labelled document. Rows of equal
key and text count once. The regression is fitted on a bounded sample of labelled
documents (``SAMPLE`` of each label, first by a hash of the key, so reruns agree). Every document is scored.

Labels say toxic or not. The grades of toxic documents come from the share of telling words among
all: 1 below ``SEVERE``, 2 from it on; documents that are not toxic have grade 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from ..plans.joins import may_match
from .arrow_text import give_back
from .registry import query, table

LETTERS = re.compile(r"[^\W\d_]+")
TELLING = 3.0  # z-value from which a word is a feature
SAMPLE = 10_000  # documents of each label that the fit sees
LEAST = 5  # labelled documents that have a feature
SEVERE = 0.02
SURE = 0.5
LONGEST = 40
STEMS = (4, 5, 6)


def names(token: str) -> list[str]:
    """Features of a token: its words, and their beginnings with a star."""
    out = []
    for w in (token,) if token.isalpha() else LETTERS.findall(token):
        if len(w) <= LONGEST:
            out.append(w)
        out += [w[:k] + "*" for k in STEMS if len(w) > k]
    return out


def _presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> Iterator[pd.DataFrame]:
        for label, c in seen.items():
            yield pd.DataFrame({"word": list(c), "toxic": label, "n": list(c.values())}).astype({"word": object, "toxic": "int32", "n": "int64"})
            c.clear()

    for batch in batches:
        for label, text in zip(batch["toxic"], batch["text"]):
            seen[int(label)].update({x for t in set(text.lower().split()) for x in names(t)})
        if len(seen[0]) + len(seen[1]) > 400_000:
            yield from flush()
    yield from flush()
    give_back()


def telling_words(labelled: DataFrame, n: dict[int, int]) -> list[str]:
    """The words whose presence tells the labels apart, by the z-value of their log odds ratio.

    Only words at home in toxic documents; ``labelled`` has toxic (0 or 1) and text, ``n`` the rows of each. Counts cover all rows.
    """
    bad, fine = n.get(1, 0), n.get(0, 0)
    if not bad or not fine:
        return []
    c = labelled.select("toxic", "text").mapInPandas(_presence, "word string, toxic int, n bigint")
    c = c.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    c = c.where(F.col("a") + F.col("b") >= LEAST)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    ratio = F.log(a / (F.lit(bad + 1.0) - a)) - F.log(b / (F.lit(fine + 1.0) - b))
    z = ratio / F.sqrt(1 / a + 1 / (F.lit(bad + 1.0) - a) + 1 / b + 1 / (F.lit(fine + 1.0) - b))
    top = c.withColumn("z", z).where(F.col("z") > TELLING).orderBy(F.col("z").desc(), "word")
    return [r.word for r in top.collect()]


class Features(dict):
    """Token to the features of its words; bounded."""

    def __init__(self, words: list[str]) -> None:
        super().__init__()
        self.place = {w: i for i, w in enumerate(words)}

    def __missing__(self, token: str) -> tuple[tuple[int, ...], int]:
        if len(self) > 500_000:
            self.clear()
        found = names(token)
        out = self[token] = (tuple(self.place[w] for w in found if w in self.place), sum(x[-1] != "*" for x in found))
        return out

    def of(self, text: str | None) -> tuple[Counter, int]:
        """Counts of the features, and number of words."""
        counts, n = Counter(), 0
        for places, words in map(self.__getitem__, (text or "").lower().split()):
            n += words
            if places:
                counts.update(places)
        return counts, n


def _vectors(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feats = Features(sent.value)
        for batch in batches:
            got = [feats.of(t) for t in batch["text"]]
            yield pd.DataFrame({"t": batch["t"], "toxic": batch["toxic"], "at": [list(c) for c, _ in got], "n": [list(c.values()) for c, _ in got], "words": [w for _, w in got]})

    return run


class Ordinal:
    """A fitted cumulative-link model; grades 0..len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def below(self, z: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each threshold."""
        return _sigmoid(self.thresholds[None, :] - z[:, None])

    def grades(self, z: np.ndarray) -> np.ndarray:
        """P(grade = k)."""
        cumulative = np.hstack([np.zeros((len(z), 1)), self.below(z), np.ones((len(z), 1))])
        return np.diff(cumulative, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, features: int, levels: int, weight: np.ndarray | None = None, penalty: float = 1e-4, steps: int = 400) -> Ordinal:
    """Maximum likelihood with a ridge, by accelerated gradient steps over a sparse matrix.

    ``weight`` says how many documents each row stands for (a sample by label isn't balanced like the whole).
    Thresholds are a first one and exponentials of the gaps, so they stay in order.
    """
    part = np.ones(len(grade)) if weight is None else weight
    part = part / max(part.sum(), 1e-9)
    share = np.array([part[grade <= k].sum() if len(grade) else 0.5 for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = np.r_[np.zeros(features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, first, gaps = p[:features], p[features], np.exp(p[features + 1:])
        theta = first + np.r_[0.0, np.cumsum(gaps)]
        z = np.bincount(rows, values * w[cols], minlength=len(grade))
        edge = np.concatenate([[-40.0], theta, [40.0]])
        hi, lo = _sigmoid(edge[grade + 1] - z), _sigmoid(edge[grade] - z)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dhi, dlo = np.where(grade == levels - 1, 0, dhi), np.where(grade == 0, 0, dlo)
        hi, lo = np.where(grade == levels - 1, 1.0, hi), np.where(grade == 0, 0.0, lo)
        like = np.maximum(hi - lo, 1e-9)
        dz = (dhi - dlo) / like * part  # of minus the log likelihood
        dtheta = np.bincount(grade, -dhi / like * part, minlength=levels)[:levels - 1] + np.bincount(grade, dlo / like * part, minlength=levels)[1:]
        g = np.r_[np.bincount(cols, values * dz[rows], minlength=features) + penalty * w, dtheta.sum(), [gaps[k] * dtheta[k + 1:].sum() for k in range(levels - 2)]]
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        p = p - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Ordinal(p[:features], p[features] + np.r_[0.0, np.cumsum(np.exp(p[features + 1:]))])


def maybe_marked(texts: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """The rows of ``texts`` with a key of ``marks``, and a few others, which a join drops: most texts without a label need no shuffle."""
    return may_match(texts, marks, [key]).where("__may").drop("__may")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], Ordinal]:
    """Features and model from labels (key, toxic); rows with a null in either, and null texts, teach nothing.

    Rows of equal key and text teach once. Texts of labelled documents are shuffled once, for the counts; repeated
    rows are cut to one before that, where they are.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(key, "text", F.xxhash64("text").alias("t")).where(F.col("text").isNotNull())
    marks = checkpoint(texts.select(key, "t").distinct().join(marks, key))  # of documents that are there; no text moves
    n_rows = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    features = telling_words(maybe_marked(texts, marks, key).groupBy(key, "t").agg(F.first("text").alias("text")).join(marks, [key, "t"]), n_rows)
    if not features:
        return [], Ordinal(np.zeros(0), np.array([40.0, 41.0]))
    drawn = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64(key), key, "t").limit(sample) for t in (0, 1)]
    sent = docs.sparkSession.sparkContext.broadcast(features)
    # at most 2 * sample rows, so the broadcast and the vectors are bounded
    x = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), [key, "t"]).select(F.xxhash64(key, "t").alias("t"), "toxic", "text")
    x = x.mapInPandas(_vectors(sent), "t bigint, toxic int, at array<int>, n array<int>, words bigint").dropDuplicates(["t"]).toPandas()
    x = x.sort_values("t", ignore_index=True)
    size = x["at"].map(len).to_numpy(int)
    rows = np.repeat(np.arange(len(x)), size)
    cols = np.concatenate([*x["at"], np.zeros(0)]).astype(int)
    n = np.concatenate([*x["n"], np.zeros(0)]).astype(float)
    # a telling word counts once for itself and once for each telling beginning
    told = np.bincount(rows, n, minlength=len(x)) / (1 + len(STEMS)) / np.maximum(x["words"].to_numpy(float), 1)
    grade = np.where(x["toxic"] == 0, 0, np.where(told < SEVERE, 1, 2))
    weight = x["toxic"].map({t: n_rows[t] / max(1, (x["toxic"] == t).sum()) for t in (0, 1)}).to_numpy(float)
    return features, fit(rows, cols, np.log1p(n), grade, len(features), 3, weight)


def _score(sent, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, model = sent.value
        feats = Features(words)
        for batch in batches:
            got = [feats.of(t)[0] for t in batch["text"]]
            z = np.array([sum(model.weights[i] * np.log1p(n) for i, n in c.items()) for c in got], float)
            p = model.grades(z)
            yield batch[keep].assign(severity=p @ np.arange(p.shape[1]), grade=p.argmax(axis=1).astype("int32"), p_toxic=1 - p[:, 0], toxic=1 - p[:, 0] >= SURE)

    return run


NEW = ("severity", "grade", "p_toxic", "toxic")


def grade(docs: DataFrame, labels: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without text: expected severity (0 to 2), likeliest grade, P(grade > 0) and the verdict.

    Null and empty texts score as a text without telling words. With no labelled toxic or no
    labelled clean document nothing is toxic. Columns named as the new ones are replaced; repeated
    rows are scored one by one.
    """
    keep = [c for c in docs.columns if c not in ("text", *NEW)]
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, **options))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "severity double, grade int, p_toxic double, toxic boolean"])
    return docs.select(*keep, "text").mapInPandas(_score(sent, keep), schema)


@query()
def op7_toxicity(spark, d):
    """Severity of every document."""
    return grade(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "toxic"))
