"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets become one node. SimHash proposes first: nodes whose 64-bit fingerprints of the set (``simhash``) differ in
at most two bits are compared, by a spanning forest of these links. A radius of two catches slight edits of long texts,
not all near copies, so min-wise hashes propose the rest. Min-wise hashes in ``BANDS`` bands of ``ROWS`` make buckets: two texts of
similarity s share one with a chance of 1 - (1 - s^ROWS)^BANDS, which is 1 - 1.3e-7 at 0.8. All pairs
of a bucket count, but they are not made:

1. The smallest node of each bucket is compared with the others, SimHash's pairs are decided beside them, and what is
   found so far is joined to groups. This links nearly all near copies, by one pair per node and smallest node.
2. Only buckets that still hold several groups are looked at again. They are cut into cells of bounded
   size, a task each. In a cell, sketches (the least hash of each of ``BINS`` ranges) tell which nodes may
   reach the similarity with one of another group; for these nodes alone the sets are fetched, and a pair
   is decided by its exact similarity, once, in the first band it shares. A cell yields one link per two groups that
   meet, so what comes out grows with nodes, not with pairs.

Groups are the connected components of all such links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpoint, materialise
from ..plans.joins import may_match, salted_join
from .arrow_text import give_back, mix, text_slices, words
from .components import components
from .simhash import links as fingerprint_links
from .simhash import majority_of

SHINGLE = 5
FIFTHS = 4  # similarity of near copies, in fifths
BANDS, ROWS = 40, 5
ROUNDS = 1
BINS = 128
CELL_NODES, CELL_SHINGLES = 1024, 500_000  # of a bucket's lane; a cell has one lane or two
LEAD_PAIRS = 1024  # of a hot smallest node, in one place
HOT = 1024  # rows of a bucket that are joined in one place

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.default_rng(51)
_TIMES = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text: sorted hashes of its ``k``-word shingles; fewer words are one shingle."""
    w = words(data, offsets, IS_WORD)
    grams = w.gram_hashes(k)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(grams[a:z - k + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(w.text(a, z))] if z > a else [], np.uint64))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(BANDS, sets) bucket keys of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.zeros((BANDS, len(sets)), np.uint64)
    for i in range(BANDS * ROWS):
        least = np.minimum.reduceat(flat * _TIMES[i] + _PLUS[i], starts)
        out[i // ROWS] = mix(out[i // ROWS] * _FOLD + least)
    return out


def _sketch(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                sets = shingles(data, offsets)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
                some = [i for i, s in enumerate(sets) if len(s)]
                size = np.array([len(s) for s in sets], np.int64)
                fp = majority_of(np.concatenate([*sets, np.zeros(0, np.uint64)]), size)
                found = bands([sets[i] for i in some]).T.ravel() if some else np.zeros(0, np.uint64)
                ends = np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(node.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), lists], names=[*keep, "node", "size", "fp", "bands"])
        give_back()

    return run


EMPTY = np.uint32(0xFFFFFFFF)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS): of each range of hashes the least one, folded to 32 bits, or ``EMPTY``. Sets are sorted, so this is a search."""
    out = np.full((len(sets), BINS), EMPTY)
    edges = np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        some = at < np.r_[at[1:], len(s)]
        out[i, some] = (mix(s[at[some]]) >> np.uint64(33)).astype(np.uint32)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            sets = shingles(data, offsets)
            lists = [_lists(sets), _lists(bands(sets).T), _lists(sketches(sets).astype(np.uint64))]
            yield pa.RecordBatch.from_arrays([rows.column("node"), *lists], names=["node", "set", "bands", "sketch"])
    give_back()


def _lists(rows) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are near copies by exact Jaccard similarity; null ends are left out, repeated pairs stay.

    A ``v`` with many pairs is spread over several places, each with a copy of its set.
    """
    per = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / LEAD_PAIRS).cast("int").alias("n"))
    spread = salted_join(pairs, per, ["v"], spread_by=["u"]).withColumn("place", F.pmod(F.xxhash64("u"), F.col("n")).cast("int")).drop("n")
    side = sets.select(F.col("node").alias("v"), F.col("set").alias("b")).join(per, "v").select("v", "b", F.explode(F.expr("sequence(0, n - 1)")).alias("place"))
    both = spread.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(side, ["v", "place"])
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * 5 >= (F.size("a") + F.size("b") - shared) * FIFTHS).select("u", "v")


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * FIFTHS


BUCKET = ["band", "h"]


def _with_bucket(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (band, h, node, ...) with the columns of ``per``, one row per bucket with its ``n``; others are dropped.

    Buckets are nearly as many as rows, so ``per`` is sorted, not broadcast, and repeated for hot buckets only: these, at
    most one for ``HOT`` rows, are known to all tasks.
    """
    places = F.ceil(F.col("n") / HOT).cast("int")
    hot = per.where(F.col("n") > HOT).select(*BUCKET, places.alias("__places"))
    left = rows.join(F.broadcast(hot), BUCKET, "left").withColumn("__place", F.pmod(F.xxhash64("node"), F.coalesce("__places", F.lit(1))).cast("int")).drop("__places")
    right = per.withColumn("__place", F.explode(F.sequence(F.lit(0), places - 1))).drop("n")
    return left.join(right.hint("merge"), [*BUCKET, "__place"]).drop("__place")


def _led(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two nodes at least, with the smallest ``at`` of the bucket as ``lead``."""
    return _with_bucket(rows, materialise(rows.groupBy(*BUCKET).agg(F.min("at").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes (node, fp) with equal fingerprints, or linked by SimHash; a node of each fingerprint stands for it."""
    rep = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    equal = nodes.join(rep.hint("merge"), "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    end = lambda c: rep.select(F.col("fp").alias(c), F.col("rep").alias(f"__{c}")).hint("merge")
    apart = fingerprint_links(rep.select("fp")).join(end("u"), "u").join(end("v"), "v").select(F.col("__u").alias("u"), F.col("__v").alias("v"))
    return equal.unionByName(apart)


def leading_links(buckets: DataFrame, sets: DataFrame, rounds: int, proposed: DataFrame | None = None) -> DataFrame:
    """(u, v): near copies of the smallest node of their bucket; in further rounds, of the smallest of those left.

    ``buckets`` has band, h, node, and ``at``, a struct that orders the nodes and has their ``size``. Pairs ``proposed`` (u, v) are decided with those of the first round.
    """
    rows, found = _led(buckets).where(F.col("at") != F.col("lead")), None
    for i in range(max(rounds, 1)):
        pairs = rows.where(_sizes_allow(F.col("at.size"), F.col("lead.size"))).select(F.col("at.node").alias("u"), F.col("lead.node").alias("v"))
        if i == 0 and proposed is not None:
            pairs = pairs.unionByName(proposed) if rounds else proposed
        good = checkpoint(similar(materialise(pairs.distinct()), sets))  # written, as the plan has them three times
        found = good if found is None else found.unionByName(good)
        if i + 1 >= rounds:
            break
        taken = good.withColumnsRenamed({"u": "node", "v": "__lead"})
        left = rows.withColumn("__lead", F.col("lead.node")).join(taken, ["node", "__lead"], "left_anti").select(*BUCKET, "node", "at")
        rows = checkpoint(_led(left).where(F.col("at") != F.col("lead")))
        if rows.isEmpty():
            break
    return found


class _Cell:
    """Nodes of one cell; only pairs of different groups count, and of different lanes if the cell has two."""

    def __init__(self, t: pa.Table) -> None:
        column = lambda c: t.column(c).combine_chunks()
        self.band = t.column("band")[0].as_py()
        self.node, root, self.size, self.lane = (column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "size", "lane"))
        self.label = np.unique(root, return_inverse=True)[1]
        self.sketch = np.asarray(column("sketch").flatten()).view(np.uint64).astype(np.uint32).reshape(len(t), BINS)
        self.two = t.column("a")[0].as_py() != t.column("b")[0].as_py()
        self.filled = self.sketch != EMPTY
        self.bins = self.filled.sum(1)

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, partners of i that may be near copies in another group); each pair comes once."""
        common = np.bincount(self.label).argmax()
        place = np.empty(len(self.node), np.int64)
        asked = np.flatnonzero(self.label != common)
        place[:] = len(asked)
        place[asked] = np.arange(len(asked))
        for i in asked.tolist():
            ok = (self.label != self.label[i]) & (place > place[i])
            ok &= np.minimum(self.size, self.size[i]) * 5 >= np.maximum(self.size, self.size[i]) * FIFTHS
            if self.two:
                ok &= self.lane != self.lane[i]
            j = np.flatnonzero(ok)
            if len(j):
                same = ((self.sketch[j] == self.sketch[i]) & self.filled[i]).sum(1)
                either = self.bins[j] + self.bins[i] - (self.filled[j] & self.filled[i]).sum(1)
                # five standard deviations below the similarity asked for
                j = j[same >= FIFTHS / 5 * either - 5 * np.sqrt(either * 0.16)]
                if len(j):
                    yield i, j


CELL = ["band", "h", "a", "b"]


def _hopeful(t: pa.Table) -> pa.Table:
    """The nodes of a cell that have a possible partner."""
    cell = _Cell(t)
    kept = np.zeros(len(t), bool)
    for i, j in cell.partners():
        kept[i] = True
        kept[j] = True
    return t.filter(pa.array(kept)).select([*CELL, "lane", "node", "root", "size"])


def _link(t: pa.Table) -> pa.Table:
    """Links of a cell: enough to join the groups that have near copies in it."""
    cell = _Cell(t)
    values, ends = (np.asarray(x) for x in (t.column("set").combine_chunks().flatten(), t.column("set").combine_chunks().offsets))
    values, ends = values.view(np.uint64), ends - ends[0]
    keys = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(len(t), BANDS)[:, :cell.band]
    found = []
    for i, j in cell.partners():
        j = j[~(keys[j] == keys[i]).any(1)] if cell.band else j  # else decided in an earlier band
        if not len(j):
            continue
        own = values[ends[i]:ends[i + 1]]
        others = np.concatenate([values[ends[k]:ends[k + 1]] for k in j])
        hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        shared = np.add.reduceat(hit, np.r_[0, np.cumsum(cell.size[j])[:-1]], dtype=np.int64)
        for k in j[shared * 5 >= (cell.size[i] + cell.size[j] - shared) * FIFTHS]:
            if cell.label[k] != cell.label[i]:
                found.append((cell.node[i], cell.node[k]))
                cell.label[cell.label == cell.label[k]] = cell.label[i]
    u, v = zip(*found) if found else ([], [])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def crossing_links(buckets: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): near copies that share a bucket but no group yet; ``groups`` (node, root) may leave out nodes that are their own."""
    rows = buckets.join(groups, "node", "left").select("band", "h", "node", F.col("at.size").alias("size"), F.coalesce("root", "node").alias("root"))
    per = rows.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.greatest(F.count(F.lit(1)) / CELL_NODES, F.sum("size") / CELL_SHINGLES)).cast("int").alias("lanes"))
    mixed = _with_bucket(rows, materialise(per.where("low <> high").select(*BUCKET, "n", "lanes")))
    lane = mixed.withColumn("lane", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int"))
    cells = lane.withColumn("other", F.explode(F.expr("sequence(0, lanes - 1)"))).select("band", "h", F.least("lane", "other").alias("a"), F.greatest("lane", "other").alias("b"), "lane", "node", "root", "size")
    names = "band int, h bigint, a int, b int, lane int, node bigint, root bigint, size bigint"
    hopeful = materialise(cells.join(sets.select("node", "sketch"), "node").groupBy(*CELL).applyInArrow(_hopeful, names))
    return hopeful.join(sets, "node").groupBy(*CELL).applyInArrow(_link, "u bigint, v bigint")


def links(buckets: DataFrame, sets: DataFrame, rounds: int = ROUNDS, proposed: DataFrame | None = None) -> DataFrame:
    """(u, v): enough links to join near copies that share a bucket or are ``proposed`` into their groups; groups known early come as stars."""
    groups = checkpoint(components(leading_links(buckets, sets, rounds, proposed)))
    more = checkpoint(crossing_links(buckets, sets, groups))
    return groups.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v").unionByName(more)


def keep_one(docs: DataFrame, key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row of each group of near copies, whole: the one with the smallest key, then text hash, then other columns.

    Null keys come last and name nothing. Texts without a word are one group. Groups are chains of near copies.
    Repeated rows and equal texts are one group each; no rows give no rows. Other columns may have any names but those that begin with two underscores.
    """
    named = lambda k: F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("null"))
    slim = docs.select(F.col(key).alias("k"), "text", F.xxhash64("text").alias("t"))
    schema = f"k {docs.schema[key].dataType.simpleString()}, t bigint, node bigint, size bigint, fp bigint, bands array<bigint>"
    marked = slim.mapInArrow(_sketch(["k", "t"]), schema)
    order = F.struct(F.col("k").isNull().alias("n"), "k", "t", "node", "size")
    nodes = materialise(marked.groupBy("node").agg(F.min(order).alias("at"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    proposed = materialise(fingerprint_pairs(nodes.where("at.size > 0").select("node", "fp")))

    # forty rows a node: all are shuffled to be counted, but only those that may share a bucket to meet it
    b = nodes.select("node", F.struct("node", "at.size").alias("at"), F.posexplode("bands").alias("band", "h"))
    shared = materialise(b.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    buckets = materialise(_with_bucket(may_match(b, shared, BUCKET).where("__may").drop("__may"), shared))

    # one row of each node, with its text: texts are shuffled here only
    ends = proposed.select(F.explode(F.array("u", "v")).alias("node"))
    asked = buckets.select("node").unionByName(ends).distinct().withColumn("asked", F.lit(True))
    first = nodes.select(named(F.col("at.k")).alias("__id"), F.col("at.t").alias("__t"), F.col("node").alias("__node")).join(asked.withColumnRenamed("node", "__node"), "__node", "left")
    others = [F.col(c) for c in docs.columns if c not in (key, "text")]
    same = Window.partitionBy("__id", "__t").orderBy(*others, "text")
    one = docs.withColumns({"__id": named(F.col(key)), "__t": F.xxhash64("text")}).withColumn("__n", F.row_number().over(same)).where(F.col("__n") == 1)
    one = materialise(one.join(first, ["__id", "__t"]).select(*docs.columns, "__node", F.coalesce("asked", F.lit(False)).alias("__asked")))

    sets = materialise(one.where("__asked").select(F.col("__node").alias("node"), "text").mapInArrow(_sets, "node bigint, set array<bigint>, bands array<bigint>, sketch array<bigint>"))
    comp = components(links(buckets, sets, rounds, proposed))
    member = comp.join(nodes.select("node", "at"), "node")
    least = member.groupBy("root").agg(F.min("at").alias("least"))
    dropped = materialise(member.join(least, "root").where(F.col("at") != F.col("least")).select(F.col("node").alias("__node")))
    told = may_match(one, dropped, ["__node"])
    kept = told.where("__may").join(dropped, "__node", "left_anti").select(*docs.columns)
    return told.where("not __may").select(*docs.columns).unionByName(kept)
