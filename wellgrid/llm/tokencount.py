"""Token counts that follow edits.

A tokenizer of this kind cuts a text into pre-tokens by a pattern and encodes each alone, so a
text's count is the sum over its pre-tokens. Each document keeps a segment tree of those counts.
For an edit, pre-tokens are cut anew from a boundary a few characters before it until the new
boundaries meet an old one behind it; from there on both cuts agree, because the pattern looks at
what follows only. The counts of the region replace the old leaves, and the sums above them are
updated. Nothing else of the document is encoded again.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .spans import match_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BEFORE = 4  # a pre-token's cut depends on no character this far behind its end or start
AHEAD = 64  # characters looked at behind an edit, doubled as needed
CACHE = 400_000  # pre-tokens a worker remembers


class Counter(dict):
    """Pre-token to number of tokens; forgets all when full."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import regex
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


class CountTree:
    """Segment tree of counts, with one spare leaf at the end for text behind the last pre-token."""

    def __init__(self, counts: list[int]) -> None:
        self.size = 1 << len(counts).bit_length()
        self.sums = np.zeros(2 * self.size, np.int64)
        self.sums[self.size:self.size + len(counts)] = counts
        self._raise(0, len(counts) + 1)

    def _raise(self, a: int, b: int) -> None:
        """Sums above leaves a..b-1."""
        lo, hi = a + self.size, b - 1 + self.size
        while lo > 1:
            lo, hi = lo >> 1, hi >> 1
            self.sums[lo:hi + 1] = self.sums[2 * lo:2 * hi + 2:2] + self.sums[2 * lo + 1:2 * hi + 2:2]

    def replace(self, a: int, b: int, total: int) -> None:
        """Leaves a..b-1 now hold ``total`` together; without a leaf, it adds to leaf a."""
        if a == b:
            self.sums[self.size + a] += total
            b = a + 1
        else:
            self.sums[self.size + a:self.size + b] = 0
            self.sums[self.size + a] = total
        self._raise(a, b)

    @property
    def total(self) -> int:
        return int(self.sums[1])


class Document:
    """A text with its pre-token boundaries and count tree."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter = text, counter
        pieces = counter.cut(text)
        self.bounds = [0, *np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))).tolist()]
        self.tree = CountTree(counter.counts(pieces))

    def edit(self, edits: list[tuple[int, int, str]]) -> int:
        """Apply edits (from, to, new text) given in positions of the first text; returns characters cut anew."""
        bounds, text = self.bounds, self.text
        fresh, i = 0, 0
        while i < len(edits):
            first = self._before(edits[i][0])
            start = bounds[first]
            region, at = [], start
            while True:
                s, e, new = edits[i]
                region += [text[at:s], new]
                at = e
                i += 1
                if i < len(edits) and self._restart(i, edits) < at:
                    continue
                head = "".join(region)
                limit = len(text) if i == len(edits) else bounds[self._before(edits[i][0])]
                met = self._meet(head, at, limit)
                # an insertion that meets its own start is held by the leaf there, so no other region may begin at it
                if met is not None and not (met[1] == first and i < len(edits) and self._before(edits[i][0]) == first):
                    break
            total, last, length = met
            self.tree.replace(first, last, total)
            fresh += length
        return fresh

    def _before(self, position: int) -> int:
        """Boundary from which to cut anew for an edit at ``position``."""
        return max(0, bisect_right(self.bounds, position - BEFORE) - 1)

    def _restart(self, i: int, edits: list) -> int:
        return self.bounds[self._before(edits[i][0])]

    def _meet(self, head: str, at: int, limit: int) -> tuple[int, int, int] | None:
        """Cut ``head`` and the old text from ``at`` on until an old boundary up to ``limit`` is met.

        (tokens, leaf at that boundary, characters cut), or None if the next edit must join.
        """
        ahead = AHEAD
        while True:
            stop = min(len(self.text), at + ahead)
            whole = head + self.text[at:stop]
            pieces = self.counter.cut(whole)
            end, used = 0, []
            for p in ["", *pieces]:
                end += len(p)
                used.append(p)
                old = end - len(head) + at
                if old > limit or (end + 2 > len(whole) and stop < len(self.text)):
                    break
                if old >= at:
                    leaf = bisect_left(self.bounds, old)
                    if leaf < len(self.bounds) and self.bounds[leaf] == old:
                        return sum(self.counter.counts(used[1:])), leaf, end
            if old > limit or stop == len(self.text):
                return None
            ahead *= 2


def clean_edits(edits: list | None, length: int) -> list[tuple[int, int, str]]:
    """Sorted edits inside the text; of overlapping ones the later begins where the earlier ends."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(((x["s"] or 0, x["e"] or 0, x["new"] or "") for x in edits or [] if x is not None)):
        low = max(0, out[-1][1] if out else 0)
        s = min(max(e[0], low), length)
        out.append((s, min(max(e[1], s), length), e[2]))
    return out


_counters: dict[tuple[int, str], Counter] = {}


def _count(sent, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pattern = sent.value
        key = hash(vocabulary), pattern
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(vocabulary, pattern)
        counter = _counters[key]
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for text, edits in zip(batch.column("text"), batch.column("edits")):
                doc = Document(text.as_py() or "", counter)
                before, todo = doc.tree.total, clean_edits(edits.as_py(), len(doc.text))
                out.append((len(todo), before, doc.edit(todo), doc.tree.total))
            new = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x, pa.int64()) for x in new]], names=[*keep, *NEW])

    return run


NEW = ["n_edits", "n_tokens", "n_rescanned", "n_tokens_edited"]


def count_edited(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without text and edits: tokens before and after the edits, and characters cut anew.

    ``docs`` has ``text`` and ``edits`` (array of structs s, e, new: replace code points s to e-1).
    Null and empty texts have no tokens; null edits are none; a null text part is empty. Edits lie
    in the old text: positions outside it are moved to its ends, and of overlapping edits the later
    begins where the earlier ends. Columns named as the new ones are replaced. The vocabulary is
    read on the driver and sent (a fixed size, under 1 MB).
    """
    keep = [c for c in docs.columns if c not in ("text", "edits", *NEW)]
    sent = docs.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), pattern))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in NEW)])
    return docs.select(*keep, "text", "edits").mapInArrow(_count(sent, keep), schema)


def attach_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the edits of an edit table (key, s, e, new) as a column; a document without any has null."""
    per = edits.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("s", "e", "new")).alias("edits"))
    return docs.drop("edits").join(per, key, "left")


MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
NUMBER = r"[0-9][0-9.]{4,}[0-9]"


def masking_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with edits that a cleaning step would make: a source tag in front, addresses and long numbers masked."""
    mask = lambda pattern, new: F.transform(match_spans(F.col("text"), pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(new).alias("new")))
    tag = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.concat(F.lit("["), F.coalesce("source", F.lit("unknown")), F.lit("] ")).alias("new")))
    return docs.withColumn("edits", F.when(F.col("text").isNull(), tag).otherwise(F.concat(tag, mask(MAIL, "<email>"), mask(NUMBER, "<number>"))))


@query()
def op9_tokencount(spark, d):
    """Tokens of every document before and after masking."""
    return count_edited(masking_edits(table(spark, d, "documents").select("doc_id", "text", "source")).drop("source"))
