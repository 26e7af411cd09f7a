"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: a first slot
and a step, both from a hash of its name. The shards take turns; each takes its next preferred
slot that is still free, until the table is full. A row's key hashes to a slot, and the slot names
the shard. When a shard leaves or joins, most slots keep their owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
SLOTS = 5003  # prime; more than a hundred slots for each shard keep the shares within one per cent
HASH_DIGITS = 13  # hex digits of an md5: 52 bits


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[str]:
    """Owner of each slot. The work is bounded by the table, whatever the data.

    Takes a prime number of slots and distinct, non-empty shard names; anything else is an error.
    The order of ``shards`` is the order of turns.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, no smaller than the number of shards")
    place = [_hash(f"{s}/first") % slots for s in shards]
    step = [_hash(f"{s}/step") % (slots - 1) + 1 for s in shards]
    owner: list[str | None] = [None] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[place[i]] is not None:
            place[i] = (place[i] + step[i]) % slots
        owner[place[i]] = shards[i]
    return owner  # type: ignore[return-value]


def slot_of(key: Column, content: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; rows without a key are spread by their content."""
    text = F.coalesce(key.cast("string"), F.concat(F.lit("null/"), F.coalesce(content.cast("string"), F.lit(""))))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", content: str = "text", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard``, without a shuffle.

    The lookup table travels as one literal array of ``slots`` names, so a placement is one array
    access. Rows with the same key meet in the same shard; null keys are spread by ``content``
    (null counts as empty). Earlier columns ``slot`` and ``shard`` are replaced. An empty table
    stays empty.
    """
    names = F.split(F.lit(",".join(str(shards.index(o)) for o in lookup_table(shards, slots))), ",")
    spread = slot_of(F.col(key), F.col(content), slots)
    found = F.element_at(F.array(*[F.lit(s) for s in shards]), F.element_at(names, F.col("slot") + 1).cast("int") + 1)
    return docs.withColumn("slot", spread).withColumn("shard", found)


def _sql_table(shards: Sequence[str], slots: int) -> str:
    digest = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""shards(i, name) AS (VALUES {names}),
pref AS (SELECT i, name, {digest.format("name || '/first'")} % {slots} AS first, {digest.format("name || '/step'")} % {slots - 1} + 1 AS step FROM shards),
prefs AS (SELECT list(name ORDER BY i) AS names, list(first ORDER BY i) AS firsts, list(step ORDER BY i) AS steps FROM pref),
fill AS (
  SELECT 0 AS turn, firsts[1] AS slot, 0 AS i, set_bit(repeat('0', {slots})::BIT, CAST(firsts[1] AS INTEGER), 1) AS taken FROM prefs
  UNION ALL
  SELECT turn + 1, free, (turn + 1) % {len(shards)}, set_bit(taken, CAST(free AS INTEGER), 1)
  FROM (SELECT turn, taken, list_filter(list_transform(range({slots}), lambda j: (firsts[(turn + 1) % {len(shards)} + 1] + j * steps[(turn + 1) % {len(shards)} + 1]) % {slots}),
               lambda s: get_bit(taken, CAST(s AS INTEGER)) = 0)[1] AS free
        FROM fill, prefs WHERE turn < {slots - 1})),
owners AS (SELECT slot, name AS shard FROM fill JOIN shards USING (i))"""


@query(f"""WITH RECURSIVE {_sql_table(SHARDS, SLOTS)},
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null/' || coalesce(text, ''))), 1, 13) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, shard FROM d JOIN owners USING (slot)""")
def op2_sharding(spark, d):
    """Shard of every document."""
    return assign_shards(table(spark, d, "documents")).select("doc_id", "slot", "shard")
