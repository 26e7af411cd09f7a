"""Whitelists, annotation joins, key universes and naming rules over plate/well metadata."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import require_columns
from ..functions.text import GENE_STOPWORDS, GENE_SYMBOL, text_lines
from ..plans.joins import salted_join, skew_safe_semi
from ..plans.ranking import first_per_key

# -- whitelist selection ------------------------------------------------------------


def _patterns(samples: DataFrame, fields: Sequence[str]) -> list[tuple[list[str], DataFrame]]:
    """Whitelist entries by which fields they fill: at most 2^fields parts, usually two or three."""
    filled = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    tagged = samples.withColumn("__f", filled)
    kinds = [list(r[0]) for r in tagged.select("__f").distinct().collect()]
    text = {f: F.col(f).cast("string") for f in fields}
    same = lambda kind: F.col("__f") == (F.array(*[F.lit(k) for k in kind]) if kind else F.array().cast("array<string>"))
    return [(kind, tagged.where(same(kind)).drop("__f").withColumns(text)) for kind in sorted(kinds)]


def select_samples(meta: DataFrame, samples: DataFrame, fields: Sequence[str], well_key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows matching any whitelist entry, one row per well key (first by ``order``).

    An entry matches when its filled fields agree as text; empty fields are wildcards. Entries
    are grouped by their filled fields, so each group is one equality semi-join and a whitelist
    of any length works. Reads the distinct field patterns of the whitelist (one small job).
    """
    require_columns(meta, [*fields, *well_key])
    parts = []
    for kind, entries in _patterns(samples, fields):
        if not kind:
            parts.append(meta)
            continue
        keyed = meta.withColumns({f"__{f}": F.col(f).cast("string") for f in kind})
        want = entries.select(*[F.col(f).alias(f"__{f}") for f in kind])
        parts.append(skew_safe_semi(keyed, want, [f"__{f}" for f in kind]).select(*meta.columns))
    hit = reduce(lambda a, b: a.unionByName(b), parts)
    return first_per_key(hit, well_key, [*order])


def unmatched_samples(meta: DataFrame, samples: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Whitelist entries that match no row."""
    parts = []
    for kind, entries in _patterns(samples, fields):
        if kind:
            known = meta.select(*[F.col(f).cast("string").alias(f) for f in kind]).distinct()
            parts.append(entries.join(known, kind, "left_anti").select(*samples.columns))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else samples.limit(0)


def of_type(df: DataFrame, col: str, *wanted: str) -> DataFrame:
    return df.where(F.col(col).isin(list(wanted)))


def available_types(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(col)


# -- schema mapping -----------------------------------------------------------------


def map_schema(df: DataFrame, renames: dict[str, str], constants: dict[str, str]) -> DataFrame:
    out = df.withColumnsRenamed(renames)
    return out.withColumns({c: F.lit(v).cast("string") for c, v in constants.items()})


def fill_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absent or null metadata becomes the empty string, everything is a string."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        for c in columns
    })


# -- joins --------------------------------------------------------------------------


def well_table(plates: DataFrame, wells: DataFrame, on: Sequence[str] = ("Metadata_Source", "Metadata_Plate")) -> DataFrame:
    """Inner join; keys are compared as strings because the inputs disagree on their type."""
    cast = lambda d: d.withColumns({c: F.col(c).cast("string") for c in on})
    return cast(wells).join(cast(plates), list(on), "inner")


def annotate_by_priority(wells: DataFrame, tables: Sequence[DataFrame], key: str, columns: Sequence[str], order: Sequence[str] = (), null_safe: bool = False) -> DataFrame:
    """Left join with the union of annotation tables; the earlier table wins per key."""
    ranked = [
        t.select(key, *[F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in columns])
        .withColumn("__p", F.lit(i))
        for i, t in enumerate(tables)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = first_per_key(union, [key], ["__p", *(order or columns)]).drop("__p")
    if null_safe:
        side = best.withColumnRenamed(key, "__key")
        return wells.join(side, wells[key].eqNullSafe(side["__key"]), "left").drop("__key")
    return salted_join(wells, best, [key], "left")


def expand_to_sites(wells: DataFrame, listing: DataFrame, keys: Sequence[str], site: str) -> DataFrame:
    """Wells joined with their per-site listing on string-cast keys."""
    require_columns(listing, [*keys, site])
    cast = lambda d: d.withColumns({c: F.col(c).cast("string") for c in keys})
    return cast(listing).join(cast(wells), list(keys), "inner")


def lookup_or_missing(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with a lookup table and a ``missing`` flag; rows never multiply.

    Of several values of a key the smallest counts.
    """
    side = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    return salted_join(df, side, [key], "left").withColumn("missing", F.col(value).isNull())


def assert_lookup(df: DataFrame, key: str, value: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Runs a job; the error names at most five keys without a value or with one out of range."""
    bad = F.col(value).isNull()
    if low is not None:
        bad = bad | (F.col(value) < low)
    if high is not None:
        bad = bad | (F.col(value) > high)
    rows = df.where(bad).select(key, value).distinct().limit(5).collect()
    if rows:
        raise ValueError(f"lookup of {value!r} failed for {[tuple(r) for r in rows]}")
    return df


def missing_keys(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(key).distinct(), key, "left_anti")


def rekey_sirna(df: DataFrame, mapping: DataFrame, sirna: str, out: str = "perturbation") -> DataFrame:
    """siRNA id -> gene; negative controls become ``EMPTY``; unresolved rows are dropped."""
    genes = mapping.where(F.col("gene_symbol").isNotNull() & (F.col("gene_symbol") != "")).select(
        F.col("sirna_id").alias(sirna),
        F.when(F.col("gene_symbol") == "NEGATIVE_CONTROL", "EMPTY").otherwise(F.col("gene_symbol")).alias("__gene"),
    )
    genes = genes.groupBy(sirna).agg(F.max("__gene").alias("__gene"))
    joined = salted_join(df, genes, [sirna], "left")
    gene = F.when(F.col(sirna) == "EMPTY", F.lit("EMPTY")).otherwise(F.col("__gene"))
    return joined.withColumn(out, gene).where(F.col(out).isNotNull()).drop("__gene")


def resolve_wells(wells: DataFrame, mapping: DataFrame, sirna: str, keep_controls: bool = False) -> DataFrame:
    """Wells whose siRNA resolves to a gene; the literal text ``NA`` is a gene like any other."""
    controls = wells.where(F.col(sirna) == "EMPTY").withColumn("perturbation", F.lit("EMPTY"))
    treated = rekey_sirna(wells.where(F.coalesce(F.col(sirna), F.lit("")) != "EMPTY"), mapping, sirna)
    treated = treated.where(F.col("perturbation") != "EMPTY")
    return treated.unionByName(controls) if keep_controls else treated


def annotate_drugs(df: DataFrame, samples: DataFrame, drugs: DataFrame, inchikey: str, name: str, order: Sequence[str]) -> DataFrame:
    """InChIKey -> sample name (first per key) -> drug record."""
    one = first_per_key(samples.select(inchikey, name, *[o for o in order if o not in (inchikey, name)]), [inchikey], [*order])
    return salted_join(df, one.select(inchikey, name).join(drugs, name, "left"), [inchikey], "left")


def on_plates_with_control(df: DataFrame, plate: Sequence[str], is_control: Column, anti: bool = False) -> DataFrame:
    """Treatment rows whose plate also holds a control well (``anti``: the excluded ones)."""
    keys = df.where(is_control).select(*plate)
    return skew_safe_semi(df.where(~is_control), keys, plate, anti=anti)


# -- perturbation rules ---------------------------------------------------------------

CONTROL = "CONTROL"  # fixed value: published control label


def published_perturbation(df: DataFrame, kind: str, inchikey: str, plate_type: str, smiles: str, out: str = "Metadata_Perturbation") -> DataFrame:
    """Published label: SMILES, siRNA id or gene symbol, controls collapsed where they have no own key."""
    rule = {
        "compound": F.col(smiles),
        "sirna": F.when(F.col(plate_type) == "treatment", F.col(inchikey)).otherwise(CONTROL),
        "crispr": F.when(F.col(inchikey) == "EMPTY_control", F.lit(CONTROL)).otherwise(F.col(inchikey)),
    }
    if kind not in rule:
        raise ValueError(f"kind must be one of {sorted(rule)}")
    return df.withColumn(out, rule[kind])


def canonical_labels(df: DataFrame, kind: str, inchikey: str, inchi: str, source: str, plate: str, mapping: DataFrame | None = None) -> DataFrame:
    """Adds ``perturbation``, ``treatment`` and ``batch`` by data kind."""
    if kind == "sirna":
        return rekey_sirna(df, mapping, inchikey).withColumns({"treatment": F.col(inchikey), "batch": F.col(source)})
    if kind == "crispr":
        return df.withColumns({
            "perturbation": F.when(F.col(inchikey) == "EMPTY_control", "EMPTY").otherwise(F.col(inchikey)),
            "treatment": F.col(inchi),
            "batch": F.concat(F.lit("plate_"), F.col(plate).cast("string")),
        })
    return df.withColumns({"perturbation": F.col(inchikey), "treatment": F.lit(""), "batch": F.col(source)})


def allowlisted(df: DataFrame, allow: DataFrame, key: str, is_treatment: Column) -> DataFrame:
    """Treatment rows need an allowed key; other rows always stay."""
    flagged = salted_join(df, allow.select(key).distinct().withColumn("__ok", F.lit(True)), [key], "left")
    return flagged.where(~is_treatment | F.coalesce(F.col("__ok"), F.lit(False))).select(*df.columns)


def include_exclude(df: DataFrame, key: str, include: DataFrame | None = None, exclude: DataFrame | None = None, controls: Sequence[str] = ()) -> DataFrame:
    out = df
    if exclude is not None:
        out = skew_safe_semi(out, exclude, [key], anti=True)
    if include is not None:
        keep = include.select(key)
        if controls:
            extra = df.sparkSession.createDataFrame([(c,) for c in controls], keep.schema)
            keep = keep.unionByName(extra)
        out = skew_safe_semi(out, keep, [key])
    return out


def restrict_to(df: DataFrame, picked: DataFrame, keys: Sequence[str] = ("source", "plate", "well")) -> DataFrame:
    return skew_safe_semi(df, picked, keys)


# -- key universes --------------------------------------------------------------------


def key_universe(df: DataFrame, key: str, drop: Sequence[str] = ()) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull() & ~F.col(key).isin(list(drop))).distinct().orderBy(key)


def universe_sizes(a: DataFrame, b: DataFrame, discard: Sequence[str] = ()) -> DataFrame:
    """One row with |a|, |b|, |a∩b|, |a∪b|, each without the discarded keys."""
    name = a.columns[0]
    left = a.select(F.col(name).alias("k")).distinct().withColumn("a", F.lit(1))
    right = b.select(F.col(b.columns[0]).alias("k")).distinct().withColumn("b", F.lit(1))
    both = left.join(right, "k", "full").where(~F.col("k").isin(list(discard)) if discard else F.lit(True))
    return both.agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"),
        F.count(F.lit(1)).alias("n_either"),
    )


def best_hit(hits: DataFrame, symbol: str, primary: str, rank: str) -> DataFrame:
    """First hit whose primary name equals the symbol (any case), else the first hit."""
    exact = (F.upper(primary) == F.upper(symbol)).cast("int")
    return first_per_key(hits, [symbol], [F.coalesce(exact, F.lit(0)).desc(), F.col(rank)])


# -- text scans -----------------------------------------------------------------------


def genes_on_pages(pages: DataFrame, page_id: str, wanted: str, text: str, reach: int = 7, symbol: str = GENE_SYMBOL, stopwords: Sequence[str] = tuple(GENE_STOPWORDS)) -> DataFrame:
    """First gene-like line within ``reach`` non-empty lines after a line equal to the id.

    Works inside the row with array functions: no explode, no shuffle, whole texts.
    """
    genelike = lambda x: x.rlike(symbol) & ~x.isin(list(stopwords))

    def first_gene(page: Column) -> Column:
        none = F.array().cast("array<string>")
        after = F.transform(
            page["lines"], lambda line, i: F.when(F.upper(line) == page["wanted"], F.slice(page["lines"], i + 2, F.lit(reach))).otherwise(none)
        )
        return F.get(F.filter(F.flatten(after), genelike), F.lit(0))

    # bound once as a lambda argument; inlined expressions would run once per line
    page = F.struct(text_lines(text).alias("lines"), F.upper(F.col(wanted)).alias("wanted"))
    found = F.get(F.transform(F.array(page), first_gene), F.lit(0))
    return pages.select(page_id, found.alias("gene")).where(F.col("gene").isNotNull())


def tagged_values(df: DataFrame, text: str, pattern: str, group: int = 1, out: str = "value") -> DataFrame:
    """Distinct regular-expression captures found anywhere in a text column."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias(out)).distinct()


def sequence_records(df: DataFrame, record: str, order: Sequence[str] = ()) -> DataFrame:
    """``(gene, sequence)`` from FASTA records without their ``>``; untagged ones are dropped.

    A gene is the whole word after ``GN=``. Of several records of a gene the last one counts, in
    the order of ``order`` (file and position, say), then of the header and the sequence.
    """
    header = F.substring_index(F.col(record), "\n", 1)
    gene = F.nullif(F.regexp_extract(header, r"\bGN=(\S+)", 1), F.lit(""))
    body = F.regexp_replace(F.substring(F.col(record), F.length(header) + 2, F.lit(2147483647)), r"\s", "")
    rows = df.select(gene.alias("gene"), header.alias("header"), body.alias("sequence"), *order).where("gene is not null and sequence <> ''")
    last = [F.col(c).desc_nulls_last() for c in (*order, "header", "sequence")]
    return first_per_key(rows, ["gene"], last).select("gene", "sequence")
