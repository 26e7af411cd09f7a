"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of its
word shingles. Texts link when their fingerprints differ in at most ``RADIUS`` bits.

Search: equal fingerprints become one. Two fingerprints at most two bits apart agree on two of
four 16-bit quarters at least, so each goes to six buckets, one for each pair of quarters. A
bucket with too many members is cut finer, exactly: what the bucket doesn't fix is halved in three
parts, of which at least one must agree; after two cuts a bucket can't hold more than 2^14 distinct
fingerprints. Inside a bucket the fingerprints lie as bit planes, 64 to a machine word: one pass
over the planes updates the distances of 64 pairs at a time in carry-save counters, and words in
which all pairs have passed the radius are left out of the remaining planes.

A bucket gives a spanning forest, never its pairs; components of those edges give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from ..plans.joins import salted_join
from ..plans.sizing import shuffle_partitions
from .arrow_text import give_back, text_slices
from .components import components
from .registry import query, table

RADIUS = 2
SHINGLE = 3
SEED = 42
CROWD = 512  # members from which a bucket is cut finer
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _of_text(raw: bytes, k: int, seed: int) -> list[int]:
    w = raw.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if len(w) < k:
        return [xxhash.xxh64_intdigest(b" ".join(w), seed)] if w else []
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(s), seed) for s in zip(*(w[i:] for i in range(k)))]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint per list: the bits set in over half of its hashes; 0 for none."""
    return majority_of(np.array([x for y in hashes for x in y], np.uint64), np.array([len(x) for x in hashes], np.int64))


def majority_of(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``majority`` of hashes that lie one list after another, ``n[i]`` of list i."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.r_[0, np.cumsum(n[some])[:-1]]
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(counts * 2 > n[some, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint(keep: list[str], k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                raw = data.tobytes()
                f = majority([_of_text(raw[a:b], k, seed) for a, b in zip(offsets[:-1], offsets[1:])])
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(f.view(np.int64))], names=[*keep, "fp"])
        give_back()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` without ``text``, with ``fp`` (a bigint with the 64 bits); an earlier ``fp`` is replaced.

    Null and empty texts have fingerprint 0. Fewer than ``shingle`` words are one shingle.
    """
    keep = [c for c in docs.columns if c not in ("text", "fp")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp bigint"])
    return docs.select(*keep, "text").mapInArrow(_fingerprint(keep, shingle, seed), schema)


# -- buckets ---------------------------------------------------------------------------------

QUARTERS = [0xFFFF << (16 * i) for i in range(4)]
FIRST = [a | b for a, b in combinations(QUARTERS, 2)]


def _thirds(mask: int) -> list[int]:
    """The bits outside ``mask`` in three parts, each added to ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // 3 for i in range(4)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spread(fps: DataFrame, masks: DataFrame | list[int]) -> DataFrame:
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return fps.select("fp", each.alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def buckets(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(mask, key, fp) of all buckets with two members at least, from distinct ``fp``."""
    masks, found = FIRST, []
    rows = _spread(fps, masks)
    for level in range(3):
        n = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if level < 2:
            fine = F.when(F.col("n") > crowd, True).otherwise(False)
        else:
            fine = F.lit(False)
        rows = checkpoint(salted_join(rows, n.withColumn("fine", fine).drop("n"), ["mask", "key"], spread_by=["fp"]))
        found.append(rows.where(~F.col("fine")).select("mask", "key", "fp"))
        rows = rows.where(F.col("fine")).select("mask", "fp")
        if level < 2:
            finer = {m: _thirds(m) for m in masks}
            pick = F.create_map(*[x for m, parts in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(p)) for p in parts]))])
            rows = rows.select("fp", F.explode(pick[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
            masks = sorted({p for parts in finer.values() for p in parts})
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# -- bit-sliced comparison -------------------------------------------------------------------


def planes_of(fps: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """64 planes of ``words`` machine words; bit ``lane[i]`` of plane b is bit b of ``fps[i]``."""
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[lane] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view("<u8").reshape(64, words)


def within(planes: np.ndarray, probes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of each word whose fingerprint differs from the word's probe in at most ``radius`` bits.

    ``planes`` is (64, words) and ``probes`` one fingerprint for each word. Distances are counted
    in carry-save form: counter bit i of all 64 lanes is one machine word, and a carry out of the
    highest one is kept as "over". Words whose lanes are all over are dropped from the rest.
    """
    size = max(1, (radius + 1).bit_length())
    n = len(probes)
    out, alive = np.zeros(n, np.uint64), np.arange(n)
    counters, over = [np.zeros(n, np.uint64) for _ in range(size)], np.zeros(n, np.uint64)
    for b in range(64):
        ask = (np.uint64(0) - (probes >> np.uint64(b) & np.uint64(1)))
        carry = planes[b][alive] ^ ask if len(alive) < planes.shape[1] else planes[b] ^ ask
        for i in range(size):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b % 8 == 7 and b < 63:
            live = (over | _above(counters, radius)) != ALL
            if live.mean() < 0.7:
                alive, probes, over = alive[live], probes[live], over[live]
                counters = [c[live] for c in counters]
                if not len(alive):
                    return out
    out[alive] = ~(over | _above(counters, radius))
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is greater than ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def _small_forest(fps: np.ndarray, group: np.ndarray, rank: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of groups with at most 64 members, one machine word each."""
    groups = len(size)
    planes = planes_of(fps, group * 64 + rank, groups)
    valid = np.where(size == 64, ALL, (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
    first = np.r_[0, np.cumsum(size)[:-1]]
    reach = np.zeros(len(fps), np.uint64)
    for j in range(int(size.max())):
        g = np.flatnonzero(size > j)
        at = first[g] + j
        reach[at] = within(planes[:, g], fps[at], radius) & valid[g]
    for j in range(int(size.max())):  # paths through member j
        through = (reach >> np.uint64(j) & np.uint64(1)).astype(bool) & (size[group] > j)
        i = np.flatnonzero(through)
        reach[i] |= reach[first[group[i]] + j]
    lowest = reach & (np.uint64(0) - reach)
    root = first[group] + np.round(np.log2(lowest.astype(np.float64))).astype(np.int64)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _large_forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of one group; memory is a bit for each pair."""
    n, width = len(fps), -(-len(fps) // 64)
    planes = planes_of(fps, np.arange(n), width)
    valid = np.packbits(np.arange(width * 64) < n, bitorder="little").view("<u8")
    links = np.zeros((n, width), np.uint64)
    step = max(1, (1 << 17) // width)
    for a in range(0, n, step):
        part = fps[a:a + step]
        wide = np.broadcast_to(planes[:, None, :], (64, len(part), width)).reshape(64, -1)
        links[a:a + step] = within(wide, np.repeat(part, width), radius).reshape(len(part), width) & valid
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            root[i] = i
            seen, front = links[i].copy(), np.array([i])
            while len(front):
                reached = np.bitwise_or.reduce(links[front], axis=0)
                new = np.flatnonzero(np.unpackbits((reached | seen).view(np.uint8), bitorder="little")[:n])
                seen |= reached
                front = new[root[new] < 0]
                root[front] = i
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def forest(fps: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of each group; groups lie one after another in ``fps``."""
    group = np.repeat(np.arange(len(size)), size)
    first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
    small = size <= 64
    mine = small[group]
    u, v = [], []
    if mine.any():
        a, b = _small_forest(fps[mine], (np.cumsum(small) - 1)[group[mine]], (np.arange(len(fps)) - first[group])[mine], size[small], radius)
        u.append(a), v.append(b)
    for g in np.flatnonzero(~small):
        a, b = _large_forest(fps[first[g]:first[g] + size[g]], radius)
        u.append(a), v.append(b)
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.uint64),) * 2


PIECE = 1 << 15  # fingerprints compared together


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of whole groups, and of the one that may go on

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.concatenate(held)
            new = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            bounds = np.r_[0, new, len(rows)]
            if not last:
                bounds = bounds[:-1]
            held[:] = [rows[bounds[-1]:]]
            size = np.diff(bounds)
            at = 0
            ends = np.cumsum(size)
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
                fps = np.ascontiguousarray(rows[bounds[at]:bounds[to], 2]).view(np.uint64)
                u, v = forest(fps, size[at:to], radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
                at = to

        n = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp")], axis=1))
            n += batch.num_rows
            if n >= PIECE:
                yield from flush(False)
                n = sum(map(len, held))
        yield from flush(True)

    return run


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v): a spanning forest of the links among distinct fingerprints ``fp``; radius 0 to 2."""
    if not 0 <= radius <= 2:
        raise ValueError("the buckets hold all pairs up to two differing bits")
    b = buckets(fps, crowd)
    b = b.repartition(shuffle_partitions(fps), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return b.mapInArrow(_links(radius), "u bigint, v bigint")


def groups(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without ``text``, with fp and component_id (the smallest key reachable).

    Texts with equal fingerprints always link, so null and empty texts are one group, linked like
    any other. Null keys belong to their group but never name it, unless it has no other. Equal
    rows stay equal rows. An empty table gives an empty result. A column component_id or fp of
    ``docs`` is replaced.
    """
    return _rooted(docs, key, **options).drop("__root")


def _rooted(docs: DataFrame, key: str, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """``groups`` with ``__root``, a fingerprint of the group that no other group has; component_id may be shared."""
    marked = checkpoint(fingerprints(docs.drop("component_id"), shingle, seed))
    per = checkpoint(marked.groupBy("fp").agg(F.min(key).alias("smallest")))
    comp = components(links(per.select("fp"), radius, crowd))
    comp = checkpoint(comp)
    named = per.join(comp, per.fp == comp.node, "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_fp = named.select("fp", "root").join(names, "root").select("fp", F.col("root").alias("__root"), "component_id")
    return salted_join(marked, by_fp, ["fp"], spread_by=[key])


def keep_one(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row of each group, whole: the one with the smallest key, then text hash, then other columns.

    Repeated rows are cut to one before the texts are shuffled, once.
    """
    named = lambda k: F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("null"))
    found = _rooted(docs.select(key, "text").withColumn("__text", F.xxhash64("text")), key, **options)
    least = F.min(F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("__text").alias("t")))
    first = found.groupBy("__root").agg(least.alias("__first")).select(named(F.col("__first.k")).alias("__id"), F.col("__first.t").alias("__t"))
    others = [F.col(c) for c in docs.columns if c not in (key, "text")]
    same = Window.partitionBy("__id", "__t").orderBy(*others, "text")
    one = docs.withColumns({"__id": named(F.col(key)), "__t": F.xxhash64("text")}).withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1)
    return one.join(first, ["__id", "__t"], "left_semi").select(*docs.columns)


@query()
def op10_simhash(spark, d):
    """Fingerprint and group of every document."""
    out = groups(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
