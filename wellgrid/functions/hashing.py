"""Seeded draws and stable fingerprints.

Every random choice in this package is a rank over ``md5('seed|key…')``: the draw depends
only on the seed and the row key, so a retried task, another partitioning or another
cluster size picks the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: str | Column) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def fingerprint(*cols: str, length: int = 12) -> Column:
    """Leading hex digits of the SHA-256 of the canonical JSON of ``cols`` (name order)."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))), 256), 1, length)


def stable_id(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)
