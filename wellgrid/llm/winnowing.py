"""Benchmark decontamination by winnowing.

Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters. A benchmark item
is cut into windows of 13 consecutive words; an item of fewer words is one window. Seven-word
grams are hashed, and each run of seven consecutive grams (which spans exactly 13 words) keeps its
minimum as fingerprint. A shared span of 13 words therefore always shares a fingerprint. Where a
document's fingerprint is one of the benchmark's, the hit is extended: the window's 13 words are
compared with the benchmark windows of the same hash, as text. Items of fewer than 13 words have
the hash of the whole item as their fingerprint.

The benchmark's windows are broadcast in blocks of bounded size (``BLOCK_WINDOWS``); the documents
are read once for each block, and never shuffled while one block is enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checkpoint
from .arrow_text import Words, give_back, text_slices, words
from .registry import query, table

WINDOW = 13
GRAM = 7
BLOCK_WINDOWS = 200_000  # about 25 MB with their texts
SHARE = 20  # contaminated from one hit word in so many

IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


def window_minima(w: Words, k: int = GRAM, span: int = WINDOW) -> np.ndarray:
    """Smallest hash among the k-word grams inside the ``span`` words from each word on."""
    g = w.gram_hashes(k)
    low, have, need = g, 1, span - k + 1
    while have < need:  # doubling: the minimum of 1, 2, 4, ... grams, then what is still missing
        by = min(have, need - have)
        low = np.minimum(low, np.r_[low[by:], np.full(min(by, len(low)), np.iinfo(np.uint64).max, np.uint64)])
        have += by
    return low


def _room(w: Words) -> np.ndarray:
    """Words left in the text from each word on, itself included."""
    n = len(w.hashes)
    return np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)


def _benchmark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_slices(batch):
            w = words(data, offsets, IS_WORD)
            low, full = window_minima(w), w.gram_hashes(WINDOW)
            out: dict[str, list] = {"item_id": [], "n": [], "fp": [], "whole": [], "words": []}
            for i, item in enumerate(rows.column("item_id").to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = min(WINDOW, b - a)
                for s in range(a, b - n + 1) if n else ():
                    whole = int(full[s]) if n == WINDOW else int(w.gram_hashes(n)[s])
                    for c, v in zip(out, (item, n, int(low[s]) if n == WINDOW else whole, whole, w.text(s, s + n)), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(np.array(out["fp"], np.uint64).view(np.int64)), pa.array(np.array(out["whole"], np.uint64).view(np.int64)), pa.array(out["words"], pa.binary())],
                names=list(out),
            )


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, fp, whole, words) of every window of every item; null texts and ids give none."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    return items.mapInArrow(_benchmark_windows, "item_id string, n int, fp bigint, whole bigint, words binary")


class Fingerprints:
    """One block of benchmark windows, as sorted arrays."""

    def __init__(self, rows: list) -> None:
        self.short = sorted({r.n for r in rows if r.n < WINDOW})
        self.fps = {n: np.unique(np.array([r.fp for r in rows if r.n == n], np.int64).view(np.uint64)) for n in {r.n for r in rows}}
        self.items: dict[tuple[int, bytes], list[str]] = {}
        for r in rows:
            self.items.setdefault((r.n, bytes(r.words)), []).append(r.item_id)

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every window in ``w`` that the benchmark has."""
        room = _room(w)
        for n, fps in self.fps.items():
            found = window_minima(w) if n == WINDOW else w.gram_hashes(n)
            at = np.minimum(np.searchsorted(fps, found), len(fps) - 1)
            for s in np.flatnonzero((fps[at] == found) & (room >= n)):
                if items := self.items.get((n, w.text(s, s + n))):
                    yield int(s), n, items


OUT = "n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"


def _find(fingerprints, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = fingerprints.value
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                w = words(data, offsets, IS_WORD)
                spans: list[list[dict]] = [[] for _ in range(rows.num_rows)]
                items: list[set[str]] = [set() for _ in range(rows.num_rows)]
                for s, n, got in sorted(marks.hits(w)):
                    i = int(np.searchsorted(w.first, s, side="right")) - 1
                    a = s - int(w.first[i])
                    if spans[i] and spans[i][-1]["b"] >= a:
                        spans[i][-1]["b"] = max(spans[i][-1]["b"], a + n)
                    else:
                        spans[i].append({"a": a, "b": a + n})
                    items[i].update(got)
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in keep], pa.array(np.diff(w.first)), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[*keep, "n_words", "spans", "items"],
                )
        give_back()

    return run


def find_passages(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS, carry_text: bool = False) -> DataFrame:
    """``docs`` without ``text`` (unless ``carry_text``), with n_words, spans (word positions a <= i < b) and items.

    ``docs`` has ``text``; its other columns are carried along, apart from those named n_words,
    spans or items, which are replaced. ``items`` has item_id and text. Null and empty texts have no words; an empty
    benchmark hits nothing; repeated rows are looked at one by one; repeated item ids count once.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items") and (carry_text or c != "text")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), OUT])
    docs = docs.select(*dict.fromkeys([*keep, "text"]))
    windows = checkpoint(benchmark_windows(items))
    blocks = max(1, -(-windows.count() // block_windows))
    if blocks > 1:
        docs = checkpoint(docs.withColumn("__row", F.monotonically_increasing_id()))
        keep, schema = [*keep, "__row"], schema.replace(OUT, "__row bigint, " + OUT)
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        marks = spark.sparkContext.broadcast(Fingerprints(windows.where(F.col("block") == b).collect()))
        found.append(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_find(marks, keep), schema))
    if blocks == 1:
        return found[0]
    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    kept = [c for c in keep if c != "__row"]
    merged = parts.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in kept], F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )  # one row per block and document
    return merged.drop("__row")


def hit_words(spans: str = "spans"):
    """Number of words inside sorted spans, overlaps counted once."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["upto"]))).cast("bigint").alias("n"), F.greatest(acc["upto"], s["b"]).alias("upto"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS, carry_text: bool = False) -> DataFrame:
    """``find_passages`` with n_hit, n_items, items_sha256 and contaminated."""
    out = find_passages(docs, items, block_windows, carry_text).withColumn("n_hit", hit_words())
    ids = F.array_join(F.array_sort("items"), ",")
    return out.withColumns({
        "n_items": F.size("items").cast("bigint"), "items_sha256": F.sha2(ids.cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")),
    })


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their columns and whole texts."""
    own = {c: f"__own_{i}" if c != "text" else c for i, c in enumerate(docs.columns)}
    out = contamination(docs.select(*[F.col(c).alias(own[c]) for c in docs.columns]), items, carry_text=True).where(~F.col("contaminated"))
    return out.select(*[F.col(own[c]).alias(c) for c in docs.columns])


@query(f"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM bw WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dg JOIN win USING (n, t)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {SHARE} >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op5_winnowing(spark, d):
    """Words, benchmark hits and verdict of every document."""
    out = contamination(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
