"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes (A-Z lower-cased) and one end byte; before it lie ``DEPTH`` end bytes. A byte
is eight binary decisions, each a node 1..255 of the byte's own binary tree. Every decision has a
context tree over the ``DEPTH`` bytes before. A tree node that saw ``a`` zeros and ``b`` ones has
the Krichevsky-Trofimov estimate, and the weighted probability of a node is half of its own
estimate plus half of the product over its children (at full depth: the estimate alone). Scoring
takes the conditional probabilities of the learned trees: along the path from depth DEPTH to 0,
each node's estimate is mixed with what lies deeper, by their posterior weights.

As a Spark job: tasks count the distinct (DEPTH+1)-byte grams of each block of documents, packed
into arrays by a hash of the gram, whose number of parts grows with the input; counts are summed
part by part over all blocks. Nodes of depth SHARED and deeper that share the last SHARED context
bytes are one group: at most 256^(DEPTH-SHARED+1) grams. Lesser depths follow from sums over groups;
valid UTF-8 has fewer than 45,000 contexts of two bytes, so these have a fixed bound however large
the corpus (some hundred thousand nodes in practice), and they are broadcast. Each block then gets
the probabilities of its own grams, and its documents are scored against that table. No part of
the model that grows with the corpus is broadcast or sent to the driver.

The word baseline of the contract takes the same way: distinct words (64-bit hashes) of a block,
counts over all blocks, and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialise
from .arrow_text import LOWER, mix, text_slices, words
from .registry import query, table

DEPTH = 5
SHARED = 3  # last context bytes that nodes of one group share
END = 0xFF  # no byte of UTF-8
FREE_BLOCKS = 64  # blocks of documents that come from no file
BLOCK_BYTES = 32 << 20  # file bytes of a block, about
PART_BYTES = 16 << 20  # text bytes for each part of the counts
PARTS = 64  # at least

IS_TOKEN = np.ones(256, bool)
IS_TOKEN[[32, 9, 10, 11, 12, 13]] = False

GRAM, WORD = 0, 1


def is_held_out(key: Column, parts: int = 7, part: int = 2) -> Column:
    """Rows whose key is kept from learning; a null key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def with_block(docs: DataFrame, *content: str) -> DataFrame:
    """A column ``block``: documents of one split of a file; a repeated scan gives the same.

    Splits of more than ``BLOCK_BYTES`` are halved by content as often as needed. Documents from
    no file are dealt out by content.
    """
    split = docs.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(docs.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(split))
    part = F.pmod(F.xxhash64(*content), F.lit(max(1, -(-size // BLOCK_BYTES))))
    of_file = F.xxhash64(F.input_file_name(), F.input_file_block_start(), part)
    return docs.withColumn("block", F.when(F.input_file_name() != "", of_file).otherwise(F.pmod(F.xxhash64(*content), F.lit(FREE_BLOCKS))))


# -- bytes to grams --------------------------------------------------------------------------


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte (an integer; the byte lowest), and where each text's begin.

    Each text gives its bytes and one end byte, with end bytes before it.
    """
    n = np.diff(offsets)
    begins = offsets[:-1] + DEPTH * np.arange(1, len(n) + 1)  # texts lie apart by DEPTH end bytes, the first of which ends the text before
    text = np.full(len(data) + DEPTH * (len(n) + 1), END, np.int64)
    text[np.arange(len(data)) + np.repeat(begins - offsets[:-1], n)] = LOWER[data]
    joined, have = text, 1  # joined[i]: bytes i .. i+have-1
    while have < DEPTH + 1:
        by = min(have, DEPTH + 1 - have)
        joined = (joined[:-by] << 8 * by) | (joined[by:] & ((1 << 8 * by) - 1))
        have += by
    first = np.r_[0, np.cumsum(n + 1)]
    ends = np.arange(first[-1]) + np.repeat(begins - first[:-1], n + 1)
    return joined[ends - DEPTH], first


def _distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``learn`` for each."""
    codes, found = pd.factorize(keys)
    n = np.bincount(codes, learn, minlength=len(found)).astype(np.int64)
    order = np.argsort(found)
    return found[order], n[order]


class Tally:
    """Keys and their counts in learning rows, gathered in pieces; keys of other rows count 0."""

    LIMIT = 1 << 22

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learn: np.ndarray) -> None:
        if len(keys):
            self.parts.append(_distinct(keys, learn))
            self.size += len(self.parts[-1][0])
        if self.size > self.LIMIT:
            self.pack()

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_distinct(*(np.concatenate([p[i] for p in self.parts]) for i in (0, 1)))]
            self.size = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of ``n``."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _arrays(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def _packed(keys: np.ndarray, *columns: np.ndarray, parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Parts that occur, and for each its keys (in order) and columns as arrays."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    first = np.r_[first, len(keys)]
    return found, [_arrays(x[order], first) for x in (keys, *columns)]


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[tuple[int, int], Tally] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (block, kind), t in tallies.items():
                keys, n = t.pack()
                found, arrays = _packed(keys, n.astype(np.int32), parts=parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(np.full(len(found), kind, np.int32)), pa.array(found), *arrays], names=["block", "kind", "part", "keys", "n"])
            tallies.clear()

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for block in np.unique(blocks):
                rows = batch.filter(pa.array(blocks == block)) if (blocks != block).any() else batch
                for part, data, offsets in text_slices(rows):
                    learn = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                    g, first = grams(data, offsets)
                    tallies.setdefault((int(block), GRAM), Tally()).add(g, np.repeat(learn, np.diff(first)))
                    w = words(data, offsets, IS_TOKEN)
                    tallies.setdefault((int(block), WORD), Tally()).add(w.hashes.view(np.int64), np.repeat(learn, np.diff(w.first)))
            if sum(t.size for t in tallies.values()) > 2 * Tally.LIMIT:
                yield from flush()
        yield from flush()

    return run


def count(docs: DataFrame, parts: int) -> DataFrame:
    """(block, kind, part, keys, n) from ``docs`` (text, held_out, block): the grams and words of a block
    with their counts in its learning rows, as arrays by part."""
    return docs.select("block", "held_out", "text").mapInArrow(_count(parts), "block bigint, kind int, part int, keys array<bigint>, n array<int>")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _total(table: pa.Table) -> pa.Table:
    """Counts of one part over all blocks."""
    keys, n = _distinct(_flat(table.column("keys")), _flat(table.column("n")))
    one = [0, len(keys)]
    return pa.table({"kind": table.column("kind")[:1], "part": table.column("part")[:1], "keys": _arrays(keys, np.array(one)), "n": _arrays(n, np.array(one))})


# -- trees -----------------------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, the recurrence below it."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    s = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of ``a`` zeros and ``b`` ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1.0)


def steps(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (1..255) and decisions of each byte's eight steps, as (n, 8) arrays."""
    full = byte.astype(np.int64)[:, None] | 256
    shift = np.arange(8, 0, -1)
    return full >> shift, full >> (shift - 1) & 1


class Level:
    """Nodes of one depth, sorted by ``context * 256 + node``, with their weighting."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, deeper: np.ndarray | None) -> None:
        """``deeper``: sums of the children's log weighted probabilities; None at full depth."""
        self.keys, self.a, self.b = keys, a, b
        own = log_kt(a, b)
        self.log_pw = own if deeper is None else np.logaddexp(own, deeper) - np.log(2.0)
        # posterior weight of stopping here
        self.stop = np.ones(len(keys)) if deeper is None else np.exp(own - np.logaddexp(own, deeper))

    def mixed(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of ``bit`` here, given that of the deeper nodes on the path."""
        if not len(self.keys):
            return np.full(keys.shape, 0.5)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        a, b = np.where(hit, self.a[at], 0), np.where(hit, self.b[at], 0)
        kt = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1.0)
        stop = np.where(hit, self.stop[at], 0.5)
        return stop * kt + (1 - stop) * deeper


def deepest_first(contexts: np.ndarray, byte: np.ndarray, n: np.ndarray, last: int) -> list[Level]:
    """Levels DEPTH, DEPTH-1, ..., ``last`` from learned grams (context of DEPTH bytes, byte, count)."""
    node, bit = steps(byte)
    keys = (contexts[:, None] * 256 + node).ravel()
    zeros, ones = (n[:, None] * (1 - bit)).ravel(), (n[:, None] * bit).ravel()
    out: list[Level] = []
    deeper = None
    for depth in range(DEPTH, last - 1, -1):
        order = np.argsort(keys, kind="stable")
        k, a = _summed(keys[order], zeros[order])
        _, b = _summed(keys[order], ones[order])
        if out:
            d = np.add.reduceat(deeper[order], np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])) if len(keys) else deeper
        out.append(Level(k, a, b, d if out else None))
        keys, zeros, ones, deeper = shorten(k, depth), a, b, out[-1].log_pw
    return out


def shorten(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys of depth ``depth`` without the oldest byte of the context."""
    return keys & ((1 << 8 * max(depth, 1)) - 1)


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return key >> 8, key & 255


def _roots(table: pa.Table) -> pa.Table:
    """Nodes of depth SHARED of one group, as their parents see them."""
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    learned = n > 0
    contexts, byte = _split(key[learned])
    top = deepest_first(contexts, byte, n[learned], SHARED)[-1]
    return pa.table({"node": shorten(top.keys, SHARED), "a": top.a, "b": top.b, "deeper": top.log_pw})


def _predict(upper, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """log10 probability of the byte of every gram of one group."""
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        learned = n > 0
        levels = deepest_first(*_split(key[learned]), n[learned], SHARED) + upper.value
        contexts, byte = _split(key)
        node, bit = steps(byte)
        at = contexts[:, None] * 256 + node
        p = np.full(at.shape, 0.5)
        for depth, level in zip(range(DEPTH, -1, -1), levels):
            p = level.mixed(at, bit, p)
            if depth:
                at = shorten(at, depth)
        value = np.log10(p).sum(axis=1).astype(np.float32).astype(np.float64)  # digits that pack well
        return pa.table({"kind": pa.array(np.full(len(key), GRAM, np.int32)), "part": part_of(key, parts), "key": key, "value": value})

    return run


def upper_levels(groups: DataFrame) -> list[Level]:
    """Depths SHARED-1 to 0, from sums over the groups (one row per node of depth SHARED-1)."""
    rows = groups.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("deeper").alias("deeper")).toArrow()
    keys, a, b, deeper = (rows.column(c).to_numpy() for c in ("node", "a", "b", "deeper"))
    out = []
    for depth in range(SHARED - 1, -1, -1):
        order = np.argsort(keys, kind="stable")
        k, a, b, deeper = keys[order], a[order], b[order], deeper[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        out.append(Level(k[first], *(np.add.reduceat(x, first) if len(first) else x for x in (a, b, deeper))))
        top = out[-1]
        keys, a, b, deeper = shorten(top.keys, depth), top.a, top.b, top.log_pw
    return out


def gram_scores(counts: DataFrame, parts: int) -> DataFrame:
    """(kind, part, key, value): log10 probability of each gram's byte after its context; ``counts`` has key and n (0: not learned)."""
    held = counts.withColumn("last", F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1).cast("bigint")))
    roots = held.groupBy("last").applyInArrow(_roots, "node bigint, a bigint, b bigint, deeper double")
    sent = counts.sparkSession.sparkContext.broadcast(upper_levels(roots))
    return held.groupBy("last").applyInArrow(_predict(sent, parts), "kind int, part int, key bigint, value double")


# -- scoring ---------------------------------------------------------------------------------


def _look_back(blocks: pa.Table, values: pa.Table) -> pa.Table:
    """Values of the keys of each block in one part."""
    order = np.argsort(values.column("key").to_numpy())
    keys, value = values.column("key").to_numpy()[order], values.column("value").to_numpy()[order]
    mine = blocks.column("keys").combine_chunks()
    wanted = mine.flatten().to_numpy()
    found = value[np.searchsorted(keys, wanted)] if len(wanted) else np.zeros(0)
    first = np.r_[0, np.cumsum(mine.value_lengths().to_numpy())]
    return pa.table({"block": blocks.column("block"), "kind": blocks.column("kind"), "keys": mine, "found": _arrays(found, first)})


class Lookup:
    """Values of 64-bit keys, all of which are there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return np.zeros(0)
        codes, found = pd.factorize(wanted)
        return self.values[np.searchsorted(self.keys, found)][codes]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's part; 0 for none."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(x, first[some])
    return out


def _score(keep: list[str], total: int, distinct: int, ends: int):
    def run(docs: pa.Table, scores: pa.Table) -> pa.Table:
        kind = scores.column("kind").to_numpy()
        tables = {}
        for k in (GRAM, WORD):
            mine = scores.filter(pa.array(kind == k))
            tables[k] = Lookup(_flat(mine.column("keys")), _flat(mine.column("found")))
        base = lambda c: np.log10((c + 1.0) / (total + distinct + 1.0))
        out = []
        for batch in docs.to_batches():
            for rows, data, offsets in text_slices(batch):
                g, first = grams(data, offsets)
                w = words(data, offsets, IS_TOKEN)
                c = tables[WORD].of(w.hashes.view(np.int64))
                n = np.diff(w.first)
                new = {
                    "n_tokens": n + 1, "n_known": (_sums(c > 0, w.first) + (ends > 0)).astype(np.int64), "train_tokens": np.full(len(n), total),
                    "base_score": _sums(base(c), w.first) + base(float(ends)), "score": _sums(tables[GRAM].of(g), first), "n_bytes": np.diff(first) - 1,
                }
                out.append(pa.table([*[rows.column(x) for x in keep], *map(pa.array, new.values())], names=[*keep, *new]))
        return pa.concat_tables(out)

    return run


NEW = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"


def score(docs: DataFrame) -> DataFrame:
    """``docs`` without text: the word baseline and the model's score of every row.

    ``docs`` has ``text``, ``held_out`` and ``block`` (see ``with_block``). Rows not held out are
    learned from. Null and empty texts are just an end. With nothing to learn from, every binary
    decision has probability 1/2. Columns named as the new ones are replaced. Code length in bits
    per byte is ``-score * log2(10) / (n_bytes + 1)``.
    """
    new = [x.split()[0] for x in NEW.split(", ")]
    docs = docs.select(*[c for c in docs.columns if c not in new])
    size, ends = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    parts = max(PARTS, -(-(size or 0) // PART_BYTES))
    seen = materialise(count(docs, parts))
    totals = materialise(seen.groupBy("kind", "part").applyInArrow(_total, "kind int, part int, keys array<bigint>, n array<bigint>"))
    flat = totals.select("kind", "part", F.explode(F.arrays_zip("keys", "n")).alias("x")).select("kind", "part", F.col("x.keys").alias("key"), F.col("x.n").alias("n"))
    words_ = flat.where(F.col("kind") == WORD)
    some = words_.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, distinct = (some[0] or 0) + ends, some[1] + (ends > 0)
    values = gram_scores(flat.where(F.col("kind") == GRAM).select("key", "n"), parts).unionByName(words_.select("kind", "part", "key", F.col("n").cast("double").alias("value")))
    mine = seen.select("block", "kind", "part", "keys").groupBy("kind", "part").cogroup(values.groupBy("kind", "part")).applyInArrow(_look_back, "block bigint, kind int, keys array<bigint>, found array<double>")
    keep = [c for c in docs.columns if c not in ("text", "block")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), NEW])
    return docs.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_score(keep, total, distinct, ends), schema)


@query()
def op6_contexttree(spark, d):
    """Word baseline and context-tree score of every document."""
    docs = with_block(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    out = score(docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") * float(np.log2(10.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
