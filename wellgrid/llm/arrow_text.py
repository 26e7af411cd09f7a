"""Arrow batches of texts as byte arrays: slices of bounded size, and vectorised word tables.

Used inside ``mapInArrow`` tasks. Texts are UTF-8; null reads as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text bytes looked at together; one longer text is a slice of its own


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets) with at most ``limit`` text bytes, or one row."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        part = batch.slice(at, to - at)
        yield part, *text_bytes(part.column(column))
        at = to


def lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and where each text begins (one more entry than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    kept = pa.concat_arrays([texts])  # drops what lies outside the slice
    offsets = np.frombuffer(kept.buffers()[1], np.int64)[kept.offset:kept.offset + len(kept) + 1]
    data = kept.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task; workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 22:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _power_tables(base, len(values) + 1)
    total = np.r_[np.uint64(0), np.cumsum(values * up[:len(values)])]
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and for each text where its words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def gram_hashes(self, k: int) -> np.ndarray:
        """Hash of the ``k`` words from each word on; meaningless where fewer follow in the text."""
        n = len(self.hashes)
        at = np.arange(n)
        return _spans_hash(self.hashes, at, np.minimum(at + k, n), _WORD_BASE)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes for which ``is_word`` (a table of 256) holds, after lower-casing A-Z."""
    data = LOWER[data]
    inside = is_word[data]
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before = np.r_[False, inside[:-1]] if n else inside
    starts = np.flatnonzero(inside & (~before | begins[:n]))
    after = np.r_[inside[1:], False] if n else inside
    ends = np.flatnonzero(inside & (~after | begins[1:])) + 1
    return Words(data, starts, ends, _spans_hash(_BYTE_VALUE[data], starts, ends, _BYTE_BASE), np.searchsorted(starts, offsets))
