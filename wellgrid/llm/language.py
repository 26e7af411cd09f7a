"""Language identification with word-first backoff.

Learning counts, for each language, its words (maximal runs of letters, lower-cased) and the
character n-grams of the words with a space on either side; runs of more than ``LONGEST`` letters have
n-grams, but are no words of the model. The model keeps the most frequent
words and n-grams of each language, up to ``ENTRIES`` of each kind for each language, whatever the number of languages
and the size of the corpus; all counts are over all of it.

A word that the model knows scores the logarithm of its relative frequency in each language, or
``PENALTY`` where the language lacks it. A word it doesn't know falls back to its n-grams of the
greatest length of which the model knows any, down to single characters, and takes their mean. A
text scores the mean of its words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from ..plans.joins import salted_join
from .arrow_text import give_back
from .registry import query, table

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # marks belong to the letter before them
EDGES = ".,;:!?\"'()[]{}<>…«»„“”‘’¿¡-–—|*#/0123456789"
ENTRIES = 10_000  # keys of the model for each language and kind
SLICES = 4096  # of keys that are equally frequent
GRAMS = 4  # longest n-gram
LONGEST = 40  # characters of a word that can be in the model
PENALTY = -7.0  # log10
UNKNOWN = "und"
FLUSH = 300_000  # distinct tokens a task holds while it counts
TOGETHER_WORDS = 5_000  # whose n-grams are counted at once
PIECE = 20_000  # rows that leave a counting task together
SURE = 0.5  # the pipeline keeps a document from this score on


def is_held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows whose key is kept from learning; a null key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def words_of(token: str) -> tuple[str, ...] | list[str]:
    """Runs of letters in a token; most tokens are one word, or one between marks of punctuation."""
    if token.isalpha():
        return (token,)
    inner = token.strip(EDGES)
    return (inner,) if inner.isalpha() else LETTERS.findall(token)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens: dict[str, Counter] = defaultdict(Counter)  # between spaces; cut into words once for all their occurrences

    def rows(lang: str, kind: int, found: Counter) -> Iterator[pd.DataFrame]:
        items = iter(found.items())
        while part := list(islice(items, PIECE)):
            yield pd.DataFrame({"lang": lang, "kind": kind, "key": [k for k, _ in part], "n": [n for _, n in part]})

    def flush() -> Iterator[pd.DataFrame]:
        while tokens:
            lang, seen = tokens.popitem()
            words, long = Counter(), Counter()
            for token, n in seen.items():
                for w in words_of(token):
                    if len(w) <= LONGEST:
                        words[w] += n
                    else:
                        long[w] += n
            del seen
            words[""] = long.total()  # the total of a language's words counts the long ones too
            yield from rows(lang, 0, words)
            del words[""]
            often: dict[int, list[str]] = defaultdict(list)  # words by their count
            for w, n in chain(words.items(), long.items()):
                often[n].append(w)
            for size in range(1, GRAMS + 1):
                grams: Counter = Counter()
                for n, some in often.items():
                    count_grams(some, n, size, grams)
                yield from rows(lang, size, grams)

    held = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            before = len(tokens[lang])
            found = text.lower().split()
            tokens[lang].update(found)
            # a long token holds as much as several
            held += len(tokens[lang]) - before + sum(len(t) // LONGEST for t in found if len(t) > LONGEST)
            if held > FLUSH:
                yield from flush()
                held = 0
    yield from flush()
    give_back()


def count_grams(words: list[str], n: int, size: int, into: Counter) -> None:
    """Add the grams of words with a space on either side, each word ``n`` times; the bare space is none."""
    for a in range(0, len(words), TOGETHER_WORDS):
        joined = f" {' \0 '.join(words[a:a + TOGETHER_WORDS])} "
        found = Counter([joined[i:i + size] for i in range(len(joined) - size + 1)])
        for g, k in found.items():
            if "\0" not in g and g != " ":
                into[g] += n * k


def grams_of(padded: str, size: int) -> list[str]:
    if size == 1:
        return list(padded[1:-1])
    return [padded[i:i + size] for i in range(len(padded) - size + 1)]


def learn(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """The model: (lang, kind, key, logf), at most ``entries`` keys of each language and kind; kind 0 are words, n are n-grams.

    ``docs`` has ``text`` and ``lang``. Rows in which either is null teach nothing. Of keys of equal count at the
    limit some go in by their hash, so reruns agree. The limit is found from the numbers of keys of each
    count, so no language's keys are sorted or gathered. No rows give no model.
    """
    rows = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    seen = rows.mapInPandas(_count, "lang string, kind int, key string, n bigint")
    counts = checkpoint(seen.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = checkpoint(counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")))
    by = ["lang", "kind"]
    real = counts.where("key <> ''").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)))

    def limit(c: DataFrame, order: Column, room: Column, name: str) -> DataFrame:
        """Per language and kind the first value of ``name``, in its order, that no longer has room, and the room before it."""
        per = c.groupBy(*by, name).agg(F.count(F.lit(1)).alias("c"), F.max(room).alias("room"))
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy(order))
        over = per.withColumn("left", F.col("room") - upto + F.col("c")).where(F.col("left") < F.col("c"))
        return over.groupBy(*by).agg(F.max(F.struct("left", name)).alias("at")).select(*by, F.col(f"at.{name}").alias(f"{name}_at"), F.col("at.left").alias("left"))

    # the first that has no room left has the most room before it
    rank = limit(real, F.col("n").desc(), F.lit(entries), "n")
    ties = salted_join(real, rank, by, spread_by=["key"]).where(F.col("n") == F.col("n_at"))
    part = limit(ties, F.col("slice"), F.col("left"), "slice").drop("left")
    # small tables, joined to the keys at once and spread, as a language may hold most of them
    per = checkpoint(totals.join(rank.drop("left"), by, "left").join(part, by, "left"))
    inside = F.col("n_at").isNull() | (F.col("n") > F.col("n_at")) | ((F.col("n") == F.col("n_at")) & (F.col("slice") < F.col("slice_at")))
    return salted_join(real, per, by, spread_by=["key"]).where(inside).select(*by, "key", F.log10(F.col("n") / F.col("total")).alias("logf"))


class Model:
    """Score vectors of keys; made on the driver from at most ``ENTRIES`` keys of each kind and language, used in tasks."""

    def __init__(self, rows: list) -> None:
        self.langs = sorted({r.lang for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.known: list[dict[str, int]] = [{} for _ in range(GRAMS + 1)]
        for r in rows:
            self.known[r.kind][r.key] = -1
        n = 0
        for keys in self.known:
            for key in keys:
                keys[key] = n
                n += 1
        self.vectors = np.full((n, len(self.langs)), PENALTY)
        for r in rows:
            self.vectors[self.known[r.kind][r.key], place[r.lang]] = r.logf

    def score(self, words: list[str]) -> np.ndarray:
        """Score vector of each word."""
        out = np.full((len(words), len(self.langs)), PENALTY)
        row = [self.known[0].get(w, -1) for w in words]
        hit = np.array(row) >= 0 if row else np.zeros(0, bool)
        out[hit] = self.vectors[np.array(row, int)[hit]]
        open_ = np.flatnonzero(~hit).tolist()
        for size in range(GRAMS, 0, -1):
            get = self.known[size].get
            found = [[r for g in grams_of(f" {words[i]} ", size) if (r := get(g, -1)) >= 0] for i in open_]
            some = [(i, f) for i, f in zip(open_, found) if f]
            if some:
                n = np.array([len(f) for _, f in some])
                sums = np.add.reduceat(self.vectors[[r for _, f in some for r in f]], np.r_[0, np.cumsum(n)[:-1]], axis=0)
                out[[i for i, _ in some]] = sums / n[:, None]
            open_ = [i for i, f in zip(open_, found) if not f]
        return out


class Tokens(dict):
    """Token to row of a table: sum of its words' score vectors, and their number; bounded."""

    LIMIT = 250_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.rows = np.empty((self.LIMIT, len(model.langs) + 1))  # the first len(self) are in use

    def add(self, tokens: set[str]) -> None:
        """Score what isn't known yet, all at once."""
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > len(self.rows):
            self.clear()
            new = list(tokens)
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), self.rows.shape[1]))
        cut = [words_of(t) for t in new]
        n = np.array([len(c) for c in cut], int)
        rows = np.zeros((len(new), self.rows.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            v = self.model.score([w for c in cut for w in c])
            rows[some, :-1] = np.add.reduceat(v, np.r_[0, np.cumsum(n[some])[:-1]], axis=0)
            rows[:, -1] = n
        at = len(self)
        self.rows[at:at + len(new)] = rows
        self.update(zip(new, range(at, at + len(new))))

    def of(self, tokens: list[str]) -> np.ndarray | None:
        """Mean score of the words for each language; None without a word."""
        total = self.rows[list(map(self.__getitem__, tokens))].sum(axis=0)
        return total[:-1] / total[-1] if total[-1] else None


TOGETHER = 1 << 20  # characters of texts whose new tokens are scored at once


def _predict(model, keep: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = model.value
        table_ = Tokens(m)

        def verdicts(texts: list[list[str]]) -> Iterator[tuple[str, float]]:
            table_.add(set().union(*texts))
            for tokens in texts:
                mean = table_.of(tokens) if tokens and m.langs else None
                if mean is None:
                    yield UNKNOWN, 0.0
                    continue
                best = int(np.argmax(mean))  # the first of equals
                yield m.langs[best], float(1.0 / np.exp((mean - mean[best]) * np.log(10.0)).sum())

        for batch in batches:
            out: list[tuple[str, float]] = []
            held, size = [], 0
            for text in batch["text"]:
                held.append(text.lower().split() if text else [])
                size += len(text or "")
                if size > TOGETHER:
                    out += verdicts(held)
                    held, size = [], 0
            out += verdicts(held)
            yield batch[keep].assign(lang_pred=pd.Series([x for x, _ in out], batch.index, dtype=object), score=pd.Series([x for _, x in out], batch.index, dtype=float))
        del table_
        give_back()

    return run


def predict(docs: DataFrame, model: DataFrame, carry_text: bool = False) -> DataFrame:
    """``docs`` without ``text`` (unless ``carry_text``), with ``lang_pred`` and ``score``.

    The score is the share of the best language among all, at the mean odds of one word. Text that
    is null or has no letter, and any text if nothing was learned, is ``und`` with score 0. Equal
    scores go to the first language by name. Columns named as the new ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (carry_text or c != "text")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.collect()))
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(_predict(sent, keep), schema)


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` (key, text, lang) without text: held_out, lang_pred and score, learned from the other rows.

    A null key is not held out; repeated rows teach and are predicted one by one; no rows give no rows.
    """
    marked = docs.withColumn("held_out", is_held_out(F.col(key)))
    return predict(marked, learn(marked.where(~F.col("held_out"))))


def keep_identified(docs: DataFrame, key: str = "doc_id", sure: float = SURE) -> DataFrame:
    """Rows of ``docs``, whole, whose language is known with at least the score ``sure``."""
    model = learn(docs.where(~is_held_out(F.col(key))))
    own = {c: f"__own_{i}" if c != "text" else c for i, c in enumerate(docs.columns)}
    out = predict(docs.select(*[F.col(c).alias(own[c]) for c in docs.columns]), model, carry_text=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= sure))
    return out.select(*[F.col(own[c]).alias(c) for c in docs.columns])


@query()
def op4_language(spark, d):
    """Language of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
