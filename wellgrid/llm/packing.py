"""Packing token sequences: large pieces are matched in pairs, small ones fill the gaps best-fit.

Only lengths matter for a packing, and lengths are whole numbers up to the capacity. So the plan is made from
the number of pieces of each length: pieces above a third of the capacity, of which at most two share a sequence,
are matched greedily (the largest with the largest that fits beside it); smaller ones go, in falling
length, where the smallest gap holds them, and into new sequences when none does. Equal pieces are dealt with
together, so the plan is a list of rules "of this length, from this rank on, so many go to these
sequences at this offset". A sequence holds at most about √(2·capacity) different lengths, hence at most some 260,000
rules for 2,048 tokens whatever the corpus; a few thousand are usual. Every piece then finds its place
by its rank among pieces of its length, all over the corpus. No task packs a share of its own, so
nothing is lost at borders.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import materialise
from .arrow_text import give_back
from .registry import query, table

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY, END_ID = 2048, 0
CHUNK = 1 << 20  # characters encoded together; words are never cut
CACHE, CACHE_CHARS = 400_000, 4_000_000  # words, and pre-tokens, a worker remembers


class _Slots(dict):
    """Key to number; ``fresh`` are those without ids yet. The ids of all stand one after another."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.chars = self.used = 0
        self.flat, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        self.chars += len(key)
        return n

    def full(self) -> bool:
        return len(self) > CACHE or self.chars > CACHE_CHARS

    def put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of the fresh keys."""
        first, self.fresh = len(self) - len(self.fresh), []
        while len(self.ends) < len(self) + 1:
            self.ends = np.r_[self.ends, np.zeros_like(self.ends)]
        while len(self.flat) < self.used + len(ids):
            self.flat = np.r_[self.flat, np.empty_like(self.flat)]
        self.ends[first + 1:len(self) + 1] = self.used + np.cumsum(lengths)
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys with these numbers, and how many each has."""
        starts = self.ends[numbers]
        n = self.ends[numbers + 1] - starts
        total = np.cumsum(n)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + n, n)], n


class Encoder:
    """Ids of whole texts. The tokenizer drops white space and joins nothing across it, so each word is encoded once.

    Most words are new for long, so a word of common characters is cut into pre-tokens here, and these
    are remembered too; new ones are encoded together, each ended by a token that ends a word. The normaliser
    does no more to such words than to lower their letters. Other words go through the whole tokenizer.
    """

    PLAIN = r"[\x20-\x7e\xa1-\xff]*"  # no white space but the blank, nothing to compose

    def __init__(self, vocabulary: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of work
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        shape = json.loads(vocabulary)
        steps = [x["type"] for x in shape["normalizer"]["normalizers"]]
        cut, level = shape["pre_tokenizer"]["pretokenizers"]
        suffix = shape["model"]["end_of_word_suffix"]
        if steps != ["NFC", "Replace", "Lowercase"] or (cut["type"], cut["behavior"], cut["invert"], level["type"]) != ("Split", "Removed", True, "ByteLevel") or not suffix:
            raise ValueError("not a vocabulary of lower-case words with word ends")
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.pieces_only = Tokenizer.from_str(vocabulary.decode())
        self.pieces_only.normalizer = None
        self.pieces_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.cut = regex.compile(cut["pattern"]["Regex"]).findall
        self.cut_all = regex.compile(cut["pattern"]["Regex"] + "| ").findall
        self.plain = regex.compile(self.PLAIN).fullmatch
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in shape["added_tokens"]) or r"(?!)").search
        self.words, self.pieces = _Slots(), _Slots()

    def _numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of the fresh words, and how many each word has."""
        fresh, number = self.words.fresh, self.pieces.__getitem__
        joined = " ".join(fresh)
        if self.plain(joined) and not self.special(joined):
            found = self.cut_all(joined.lower())
            numbers = np.fromiter(map(number, found), np.int64, len(found))
            gaps = np.flatnonzero(numbers == self.pieces[" "])
            return np.delete(numbers, gaps), np.diff(np.r_[-1, gaps, len(numbers)]) - 1
        numbers: list[int] = []
        bounds = [0]
        for w in fresh:
            if self.plain(w) and not self.special(w):
                numbers.extend(map(number, self.cut(w.lower())))
            else:
                numbers.append(number(" " + w))  # no piece begins with a space
            bounds.append(len(numbers))
        return np.array(numbers, np.int64), np.diff(bounds)

    def _learn(self) -> None:
        """Ids of the fresh words, by their pieces."""
        if self.pieces.full():
            self.pieces = _Slots()
        numbers, counts = self._numbers()
        if fresh := self.pieces.fresh:
            odd = np.fromiter((p[0] == " " for p in fresh), bool, len(fresh))
            plain = " ".join([p for p in fresh if p[0] != " "])
            ids = np.array(self.pieces_only.encode_batch_fast([plain], add_special_tokens=False)[0].ids, np.uint32)
            lengths = np.zeros(len(fresh), np.int64)
            lengths[~odd] = np.diff(np.r_[0, np.flatnonzero(self.ends_word[ids]) + 1])
            if odd.any():
                others = [x.ids for x in self.tokenizer.encode_batch([fresh[k] for k in np.flatnonzero(odd)], add_special_tokens=False)]
                lengths[odd] = [len(x) for x in others]
                of = np.repeat(odd, lengths)
                both = np.empty(len(of), np.uint32)
                both[~of], both[of] = ids, [i for x in others for i in x]
                ids = both
            self.pieces.put(ids, lengths)
        ids, n = self.pieces.gather(numbers)
        total = np.r_[0, np.cumsum(n)]
        self.words.put(ids, np.diff(total[np.r_[0, np.cumsum(counts)]]))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words.full():
            self.words = _Slots()
        words: list[str] = []
        bounds = [0]
        for t in texts:
            words += t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            bounds.append(len(words))
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.fresh:
            self._learn()
        ids, n = self.words.gather(at)
        return np.split(ids, np.r_[0, np.cumsum(n)][bounds[1:-1]])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Short ones are held together, a text of over ``CHUNK`` characters is taken part by part."""
        if not texts:
            return []
        if sum(map(len, texts)) <= CHUNK:
            return self._encode(texts)
        return [self._encode([t])[0] if len(t) <= CHUNK else np.concatenate([self._encode([part])[0] for part in _parts(t)]) for t in texts]


def _parts(text: str) -> Iterator[str]:
    """Consecutive parts of about ``CHUNK`` characters that end before a space, or at the end."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + CHUNK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


_encoders: dict[int, Encoder] = {}
NEW = ["piece", "start", "length", "ids_crc32"]


def _cut(sent, keep: list[str], capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value)
        encoder, part = _encoders[key], TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < batch.num_rows:
                first, some, size = at, [], 0
                while at < batch.num_rows and (not some or size < CHUNK // 2):
                    some.append(texts[at].as_py() or "")
                    size += len(some[-1])
                    at += 1
                row, new, ids = [], [], []
                for i, found in enumerate(encoder.ids(some)):
                    all_ids = np.r_[found, np.uint32(end_id)].astype("<u4")
                    for k, a in enumerate(range(0, len(all_ids), capacity)):
                        one = all_ids[a:a + capacity]
                        row.append(first + i)
                        new.append((k, a, len(one), zlib.crc32(one.tobytes()), part, seen[len(one)]))
                        seen[len(one)] += 1
                        if with_ids:
                            ids.append(one)
                columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in keep] + [pa.array(x, t) for x, t in zip(zip(*new), [pa.int32(), *[pa.int64()] * 5])]
                if with_ids:
                    flat = np.concatenate(ids).view(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *NEW, "__part", "__rank", *["ids"] * with_ids])
        give_back()

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rules (length, first rank, pieces, first sequence, pieces per sequence, offset of the first) for so many pieces of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used = [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, sequences) by room left
    rules: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        if n:
            rules.append((length, used[length], n, first, per, offset))
            used[length] += n
            left[length] -= n

    partner = capacity
    for a in range(capacity, capacity // 3, -1):
        if not left[a]:
            continue
        if 2 * a <= capacity:
            pairs = left[a] // 2
            if pairs:
                put(a, 2 * pairs, sequences, 2, 0)
                gaps[capacity - 2 * a].append((sequences, pairs))
                sequences += pairs
        partner = min(a - 1, capacity - a)
        while left[a] and partner > capacity // 3:
            n = min(left[a], left[partner])
            if n:
                put(a, n, sequences, 1, 0)
                put(partner, n, sequences, 1, a)
                gaps[capacity - a - partner].append((sequences, n))
                sequences += n
            partner -= 1
        if left[a]:
            n = left[a]
            put(a, n, sequences, 1, 0)
            gaps[capacity - a].append((sequences, n))
            sequences += n

    for a in range(capacity // 3, 0, -1):
        room = a
        while left[a]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                n = -(-left[a] // (capacity // a))
                gaps[capacity].append((sequences, n))
                sequences += n
                room = capacity
            first, n = gaps[room].pop()
            per = room // a
            take = min(left[a], per * n)
            full, rest = divmod(take, per)
            put(a, full * per, first, per, capacity - room)
            put(a, rest, first + full, max(rest, 1), capacity - room)
            for size, at, to in ((full, room - per * a, first), (bool(rest), room - rest * a, first + full), (n - full - bool(rest), room, first + full + bool(rest))):
                if size:
                    gaps[at].append((to, int(size)))
    return np.array(rules, np.int64).reshape(-1, 6)


def _place(sent, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
        begins = np.searchsorted(rules[:, 0], np.arange(rules[:, 0].max(initial=0) + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            rule = np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = length == n
                a, z = begins[n], begins[n + 1]
                rule[at] = a + np.searchsorted(rules[a:z, 1], rank[at], side="right") - 1
            r = rules[rule]
            k = rank - r[:, 1]
            new = [pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=[*keep, "sequence_id", "offset"])

    return run


def _schema(df: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row per piece of a document: its other columns, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``, and its place (``sequence_id``, ``offset``).

    A document's ids are those of its text and ``end_id``; null and empty texts have ``end_id`` alone. Longer documents
    are cut into pieces of ``capacity`` ids. Each sequence is gapless from 0. Keys may be null or repeat: each row
    is packed on its own. Which of equally long pieces takes which place follows the order the rows were read in.
    Columns named as the new ones are replaced. ``with_ids=False`` leaves the ids out (their checksum stays).
    The vocabulary (under 2 MB) is read on the driver and sent. The driver gets the number of pieces of each
    length (``capacity`` rows at most); tasks get the rules, whose number the capacity bounds.
    """
    spark = docs.sparkSession
    ids = ["ids"] * with_ids
    keep = [c for c in docs.columns if c not in ("text", "ids", "sequence_id", "offset", "__part", "__rank", *NEW)]
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    schema = ", ".join([*_schema(docs, keep), "piece int, start bigint, length bigint, ids_crc32 bigint, __part bigint, __rank bigint", *["ids array<int>"] * with_ids])
    cut = materialise(docs.select(*keep, "text").mapInArrow(_cut(sent, keep, capacity, end_id, with_ids), schema))

    per = cut.groupBy("__part", "length").agg((F.max("__rank") + 1).alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    rules = spark.sparkContext.broadcast(plan(counts, capacity))

    ranked = cut.join(per.select("__part", "length", "__before"), ["__part", "length"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    out = [*keep, *NEW, *ids]
    return ranked.select(*out, "__rank").mapInArrow(_place(rules, out), ", ".join([*_schema(cut, out), "sequence_id bigint, offset bigint"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed token sequences; a group is one sequence, so its size is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))


@query()
def op11_packing(spark, d):
    """Every document's pieces and their places in sequences of 2,048 tokens."""
    return pack(table(spark, d, "documents").select("doc_id", "text"), with_ids=False)
