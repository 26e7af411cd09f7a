"""Merkle manifest of a dataset: a hash tree per source, one above the sources, and a proof for each row.

Trees are built by time-forward processing. A node's label is (level, position); a queue ordered by label
delivers the digests of up to ``ARITY`` children to their parent, which sends its own digest on. The queue is external:
Spark's shuffle carries what crosses a block of consecutive nodes, and within a block a heap holds the
messages that are on their way. Blocks are whole subtrees, so each block yields one node of the next tier, and
tiers are few (two for half a million rows of a source, four for 10^11). A second sweep runs in reversed order, from the root down: each
node hands its children the proof suffix from there to the root, and blocks get theirs through one join per tier.

A proof is text: for each level from the leaf to the root, ``left|right`` (the digests of the siblings on either side, joined),
levels joined by ``;``. A row that is alone in the whole tree has the empty proof.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialise
from ..plans.ranking import ranged_rank
from .registry import query, table

ARITY = 3
LEVELS = 6  # of a block: 729 nodes


def field(c: Column, as_text: Column | None = None) -> Column:
    """A value with its length in bytes in front, ``-`` for null."""
    text = c.cast("string") if as_text is None else as_text
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the fields of a row, in lowercase hex."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(n: int, most: int) -> int:
    """Levels that a block takes in a tree whose tier has ``n`` nodes."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digest of each label (level, position) above consecutive leaves; messages wait in a heap ordered by label."""
    nodes: dict[tuple[int, int], str] = {}
    queue = [(0, i, i, d) for i, d in enumerate(digests)]  # already in order
    while queue:
        level, at = queue[0][:2]
        got = []
        while queue and queue[0][:2] == (level, at):
            got.append(heapq.heappop(queue)[3])
        nodes[level, at] = digest = got[0] if level == 0 else _hash(got)
        if level < levels:
            heapq.heappush(queue, (level + 1, at // ARITY, at, digest))
    return nodes


def sweep_down(nodes: dict[tuple[int, int], str], n: int, levels: int, suffix: str | None) -> list[str | None]:
    """Proof of each of ``n`` leaves, given the suffix from their top to the root; labels are taken in falling order."""
    waiting = {(levels, 0): suffix}
    out: list[str | None] = [None] * n
    for level, at in sorted(nodes, reverse=True):
        own = waiting.pop((level, at))
        if level == 0:
            out[at] = own
            continue
        first = at * ARITY
        run = [nodes[level - 1, k] for k in range(first, first + ARITY) if (level - 1, k) in nodes]
        for k in range(len(run)):
            step = f"{''.join(run[:k])}|{''.join(run[k + 1:])}"
            waiting[level - 1, first + k] = step if own is None else f"{step};{own}"
    return out


def _up(most: int):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("i")
        n = nodes.column("n")[0].as_py()
        levels = _levels(n, most)
        top = sweep_up(nodes.column("digest").to_pylist(), levels)[levels, 0]
        return nodes.slice(0, 1).select(["key", "block"]).append_column("m", pa.array([-(-n // ARITY**most)], pa.int64())).append_column("top", pa.array([top]))

    return run


def _down(most: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("i")
        digests, levels = nodes.column("digest").to_pylist(), _levels(nodes.column("n")[0].as_py(), most)
        proofs = sweep_down(sweep_up(digests, levels), len(digests), levels, above.column("proof")[0].as_py())
        out = nodes.append_column("proof", pa.array(proofs, pa.string()))
        for c in above.column_names[3:]:  # the same for all nodes of a tree
            out = out.append_column(c, pa.array([above.column(c)[0].as_py()] * len(digests), pa.string()))
        return out

    return run


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """Root of each tree over ``nodes`` (key, i from 0, n nodes, digest, …): (key, digest), and the nodes of each tier for the way down."""
    tiers = []
    while True:
        blocks = nodes.withColumn("block", F.expr(f"i div {ARITY**levels}"))
        tiers.append(blocks)
        slim = blocks.select("key", "block", "i", "n", "digest")
        tops = materialise(slim.groupBy("key", "block").applyInArrow(_up(levels), "key string, block bigint, m bigint, top string"))
        nodes = tops.select("key", F.col("block").alias("i"), F.col("m").alias("n"), F.col("top").alias("digest"))
        if nodes.where("n > 1").isEmpty():
            return nodes.select("key", "digest"), tiers


def descend(tiers: list[DataFrame], roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The first tier's nodes with ``proof`` and what ``roots`` (key, proof, …) says of their tree; its proof leads on from the tree's root, null is the end."""
    carried = roots.columns[2:]
    above = roots.select("key", F.lit(0).cast("bigint").alias("block"), "proof", *carried)
    for blocks in reversed(tiers):
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema), "proof string", *(f"{c} string" for c in carried)])
        nodes = blocks.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(_down(levels), schema)
        above = nodes.select("key", F.col("i").alias("block"), "proof", *carried)
    return nodes


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """``leaves`` (any columns and ``leaf``) with ``subroot`` of its group, ``root`` of all, and ``proof`` from leaf to root.

    Leaves of a group ascend by ``order``, nulls first; equal ones by ``leaf``. Groups ascend by name, the null
    group first. While several nodes remain, every three in a row become one; what is left over (even one) too.
    Repeated rows are leaves of their own; a null leaf is not allowed (``row_digest`` gives none). All columns
    given travel, so leave texts out. A group of any size is dealt out by ranges; no task needs more of a tree
    than a block. No rows give no rows. Columns named as the new ones are replaced.
    """
    keep = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # the null group is not the empty one
    rows = leaves.select(named.alias("key"), F.struct(*keep).alias("row"), F.col(order).alias("at"), F.col("leaf").alias("digest"), F.monotonically_increasing_id().alias("tie"))
    ranked = ranged_rank(rows, ["key"], ["at", "digest", "tie"], "i", "n")
    subroots, tiers = climb(materialise(ranked.select("key", (F.col("i") - 1).alias("i"), "n", "digest", "row")), levels)
    ranked = ranged_rank(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["key"], ["group"], "i", "n")
    top, upper = climb(materialise(ranked.select("key", (F.col("i") - 1).alias("i"), "n", "digest", "group")), levels)
    groups = descend(upper, top.select("key", F.lit(None).cast("string").alias("proof"), F.col("digest").alias("root")), levels)
    groups = materialise(groups.select(F.col("group").alias("key"), "proof", F.col("digest").alias("subroot"), "root"))
    return descend(tiers, groups, levels).select("row.*", "subroot", "root", F.coalesce("proof", F.lit("")).alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``."""
    steps = F.when(proof != "", F.split(proof, ";")).otherwise(F.array().cast("array<string>"))
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(F.substring_index(step, "|", 1), digest, F.substring_index(step, "|", -1)), 256))


def _tree_sql(levels: int, name: str) -> str:
    """CTEs over {name}0 (key, i, d): {name}1… up to the roots, and {name}p0… with each node's siblings left and right."""
    out = []
    for k in range(levels):
        out.append(f"""{name}p{k} AS MATERIALIZED (SELECT key, i, d, count(*) OVER (PARTITION BY key) n,
    coalesce(string_agg(d, '') OVER (PARTITION BY key, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') l,
    coalesce(string_agg(d, '') OVER (PARTITION BY key, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') r FROM {name}{k}),
{name}{k + 1} AS MATERIALIZED (SELECT key, i // 3 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END d FROM {name}p{k} GROUP BY key, i // 3)""")
    return ",\n".join(out)


def _fold_sql(levels: int, name: str, into: str) -> str:
    """CTEs that lead {into}0 (id, key, i, d, s) up the tree {name}: d folded, s siblings so far."""
    return ",\n".join(
        f"""{into}{k + 1} AS MATERIALIZED (SELECT a.id, a.key, a.i // 3 AS i, CASE WHEN p.n > 1 THEN sha256(p.l || a.d || p.r) ELSE a.d END d, CASE WHEN p.n > 1 THEN a.s || p.l || p.r ELSE a.s END s
    FROM {into}{k} a JOIN {name}p{k} p ON a.key = p.key AND a.i = p.i)""" for k in range(levels))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


# CRC-32 of the decimal id, bit by bit: a digit is mixed in, then eight shifts follow
CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda z: -1::BIGINT))))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""
DOWN, ACROSS = 13, 8  # levels: up to 3^13 rows a source, 3^8 sources

_leaf_sql = lambda text: "sha256(concat(" + ", ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
OP13_SQL = f"""WITH rows_ AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS key, {_leaf_sql('text')} AS leaf,
    CASE WHEN {CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows_),
a0 AS MATERIALIZED (SELECT key, i, leaf AS d FROM leaves),
{_tree_sql(DOWN, 'a')},
b0 AS MATERIALIZED (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, d, key AS own FROM a{DOWN}),
{_tree_sql(ACROSS, 'b')},
f0 AS MATERIALIZED (SELECT id, key, i, coalesce(changed, leaf) AS d, '' AS s FROM leaves),
{_fold_sql(DOWN, 'a', 'f')},
g0 AS MATERIALIZED (SELECT f.id, '' AS key, b0.i, f.d, f.s FROM f{DOWN} f JOIN b0 ON f.key = b0.own),
{_fold_sql(ACROSS, 'b', 'g')}
SELECT l.doc_id, l.leaf, b0.d AS subroot, r.d AS root, sha256(g.s) AS proof_sha256, g.d AS folded_root, g.d = r.d AS verified
FROM leaves l JOIN g{ACROSS} g ON l.id = g.id JOIN b0 ON l.key = b0.own JOIN b{ACROSS} r ON r.i = g.i"""


@query(OP13_SQL)
def op13_merkle(spark, d):
    """Every document as a leaf of the manifest: its proof, and what folding a tampered text gives."""
    docs = table(spark, d, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = row_digest([*columns[:-1], F.replace("text", F.lit("\n"), F.lit(""))])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)
    leaves = docs.select("doc_id", "source", row_digest(columns).alias("leaf"), tampered.alias("tampered"))
    return manifest(leaves).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.translate("proof", "|;", ""), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
