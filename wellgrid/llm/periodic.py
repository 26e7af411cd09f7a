"""Periodic runs of words, found on a harmonic grid by longest common extensions.

A run is a stretch of words with smallest period q and at least ``repeats`` times q words that no
neighbouring word extends. For each q the grid points 0, q, 2q, … are looked at: a run covers ``repeats`` - 1
grid points in a row that each hold the same word as the next one. From the first of them, the longest
common extensions forward and backward with the point q further give the run's ends. There are n/1 + n/2 + …
grid points in all, so a text of n words takes O(n log n) steps.

An extension is answered from a difference cover: every two positions reach, within a few words, positions
that both lie in the cover's sample. Only sampled suffixes are sorted; the words before are compared
one by one, and behind them a sparse table over the sorted suffixes' common prefixes gives the rest.
Texts without a grid point worth asking need no such table.

A text is looked at whole by one task; memory is about 40 bytes a word of the slice (1 MB of texts, or one text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import give_back, text_slices
from .registry import query, table

LEAST, REPEATS = 6, 4
# every difference modulo 13 is one of two members
MODULUS, COVER = 13, (0, 1, 3, 9)
ASK = 1 << 20  # extensions answered together


def _delays() -> np.ndarray:
    """[i % v, j % v] -> steps until both positions are in the cover."""
    v = MODULUS
    return np.array([[next(d for d in range(v) if (i + d) % v in COVER and (j + d) % v in COVER) for j in range(v)] for i in range(v)])


DELAYS = _delays()


class Extensions:
    """Longest common prefixes of any two suffixes of ``s``, whose texts end with values of their own."""

    def __init__(self, s: np.ndarray) -> None:
        v = MODULUS
        self.n = n = len(s)
        self.s = np.r_[s, -1 - np.arange(2 * v)]
        at = [np.arange(r, n, v) for r in COVER]  # one class after another: the next block of a suffix is the next entry
        self.where = np.concatenate(at)
        self.base = np.zeros(v, np.int64)
        self.base[list(COVER)] = np.r_[0, np.cumsum([len(a) for a in at])[:-1]]
        m = len(self.where)
        last = np.repeat(np.cumsum([len(a) for a in at]), [len(a) for a in at])
        levels = [self._blocks()]
        while m and levels[-1].max() < m - 1:  # prefix doubling over blocks of v words
            rank, step = levels[-1], 1 << (len(levels) - 1)
            to = np.arange(m) + step
            key = rank * (m + 1) + np.where(to < last, rank[np.minimum(to, m - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            new = np.empty(m, np.int64)
            new[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            levels.append(new)
        self.rank = levels[-1]
        self._table(levels, last)

    def _blocks(self) -> np.ndarray:
        """Rank of the v words from each sampled position on."""
        cols = [self.s[self.where + t] for t in range(MODULUS)]
        order = np.lexsort(cols[::-1])
        change = np.zeros(max(len(order) - 1, 0), bool)
        for c in cols:
            change |= np.diff(c[order]) != 0
        rank = np.empty(len(order), np.int64)
        rank[order] = np.r_[0, np.cumsum(change)][:len(order)]
        return rank

    def _table(self, levels: list[np.ndarray], last: np.ndarray) -> None:
        m = len(self.rank)
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        inside, ends = np.ones(len(a), bool), (last[a], last[b])
        for k in range(len(levels) - 1, -1, -1):
            same = inside & (levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)])
            a, b = a + (same << k), b + (same << k)
            inside &= (a < ends[0]) & (b < ends[1])
        start = self.where[order]
        blocks = (a - order[:-1]) * MODULUS
        i, j = start[:-1] + blocks, start[1:] + blocks
        more, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        top = len(self.s) - 1
        for t in range(MODULUS):
            open_ &= self.s[np.minimum(i + t, top)] == self.s[np.minimum(j + t, top)]
            more += open_
        self.least = [(blocks + more).astype(np.int32)]
        k = 1
        while 2 * k <= len(self.least[0]):
            one = self.least[-1]
            self.least.append(np.minimum(one[:-k], one[k:]))
            k *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words in common from i and from j on, for i < j; positions at the end have none."""
        delay = DELAYS[i % MODULUS, j % MODULUS]
        out, open_ = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for t in range(int(delay.max(initial=0))):
            open_ &= (t >= delay) | (self.s[np.minimum(i + t, self.n)] == self.s[np.minimum(j + t, self.n + 1)])
            out += open_ & (t < delay)
        go = np.flatnonzero(open_ & (j + delay < self.n))
        if len(go):
            a, b = ((p[go] + delay[go]) for p in (i, j))
            a, b = (self.rank[self.base[p % MODULUS] + p // MODULUS] for p in (a, b))
            a, b = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                out[go[at]] += np.minimum(self.least[k][a[at]], self.least[k][b[at] - (1 << k)])
        return out


def grid_points(s: np.ndarray, largest: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): grid points that start ``repeats`` - 1 equal steps of q words, for q up to ``largest``."""
    found: list[tuple[np.ndarray, int]] = []
    for q in range(1, largest + 1):
        x = s[::q]
        same = x[:-1] == x[1:]
        row = same
        for k in range(1, repeats - 1):
            row = row[:-1] & same[k:]
        if row.any():
            found.append((np.flatnonzero(row) * q, q))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.repeat([q for _, q in found], [len(p) for p, _ in found])


def runs(texts: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """Rows (start, length, period) of each text of word ids from 0 on, by start, then period."""
    empty = np.zeros((0, 3), np.int64)
    out = [empty] * len(texts)
    some = [k for k, t in enumerate(texts) if len(t) >= max(least, repeats)]
    if not some:
        return out
    joined, first = _joined([texts[k] for k in some])
    p, q = grid_points(joined, max(len(texts[k]) for k in some) // repeats, repeats)
    own = np.searchsorted(first, p, side="right") - 1
    inside = p + (repeats - 1) * q < first[own + 1] - 1
    p, q, own = p[inside], q[inside], own[inside]
    if not len(p):
        return out
    asked, slot = np.unique(own, return_inverse=True)  # texts that need a table of their own
    p = p - first[own]
    joined, first = _joined([texts[some[k]] for k in asked])
    p += first[slot]
    n = len(joined)
    after = _ask(Extensions(joined), p, p + q)
    before = _ask(Extensions(joined[::-1].copy()), n - p - q, n - p)
    start, end = p - before, p + after + q
    kept = end - start >= np.maximum(least, repeats * q)
    start, end, q, slot = (x[kept] for x in (start, end, q, slot))
    order = np.lexsort((q, end, start))  # of equal stretches the smallest period comes first, others are its multiples
    start, end, q, slot = (x[order] for x in (start, end, q, slot))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q, slot = (x[new] for x in (start, end, q, slot))
    order = np.lexsort((q, start))
    rows = np.stack([start - first[slot], end - start, q], 1)[order]
    bounds = np.searchsorted(slot[order], np.arange(len(asked) + 1))
    for k, a, z in zip(asked, bounds[:-1], bounds[1:]):
        out[some[k]] = rows[a:z]
    return out


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each ended by a value of its own, and where each begins (and the end)."""
    top = max(int(t.max(initial=0)) for t in texts) + 1
    first = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return np.concatenate([x for k, t in enumerate(texts) for x in (t, [top + k])]).astype(np.int64), first


def _ask(extend: Extensions, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([extend(i[a:a + ASK], j[a:a + ASK]) for a in range(0, len(i), ASK)])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
NEW = ["n_words", "runs", "collapsed"]


def _find(keep: list[str], least: int, repeats: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                whole = data.tobytes()
                split = [whole[a:z].split() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ids = _Ids()
                found = runs([np.fromiter(map(ids.__getitem__, w), np.int32, len(w)) for w in split], least, repeats)
                kept = [b" ".join(w if not len(r) else [w[i] for i in _kept(len(w), r)]) for w, r in zip(split, found)]
                flat = np.concatenate(found)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
                new = [pa.array([len(w) for w in split], pa.int64()), lists.cast(RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], *new], names=[*keep, *NEW])
        give_back()

    return work


def _kept(n: int, found: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()


def find_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``docs`` without text: ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` text.

    A run has at least ``least`` words and ``repeats`` (2 or more) times its period. ``collapsed`` keeps the first
    period of each run: a word goes if any run has it behind its first period; what stays is joined by one space.
    Null texts have no words; an empty or wordless text collapses to the empty one. Rows are independent, so null
    and repeated keys do no harm. Columns named as the new ones are replaced. Nothing is shuffled.
    """
    if repeats < 2:
        raise ValueError("repeats must be 2 or more")
    keep = [c for c in docs.columns if c not in ("text", *NEW)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words bigint", "runs array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed string"])
    return docs.select(*keep, "text").mapInArrow(_find(keep, least, repeats), schema)


def with_cycles(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text (by CRC-32 of its id) repeats a block of its words from some word on; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    n, g = F.size("__w"), F.floor(F.col("__h") / 10)
    sized = chosen.withColumn("__n", F.when(n > 0, n)).withColumn("__a", (g % F.col("__n")).cast("int"))
    rest = F.col("__n") - F.col("__a")
    sized = sized.withColumn("__rest", rest).withColumn("__p", (F.floor(F.col("__rest") / (g % 8 + 3)) + 1).cast("int"))
    block = F.slice("__w", F.col("__a") + 1, F.col("__p"))
    times = F.ceil(F.col("__rest") / F.col("__p")).cast("int")
    cyclic = F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), F.col("__rest")))
    text = F.when(F.col("__n").isNotNull(), F.array_join(cyclic, " ")).otherwise(F.col("text"))
    return sized.withColumn("text", text).drop("__h", "__w", "__n", "__a", "__rest", "__p")


@query()
def op12_periodic(spark, d):
    """Every document's runs: number, greatest one, digests of all and of the collapsed text."""
    found = find_runs(with_cycles(table(spark, d, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.less") * -1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
