"""Image blobs as rows: normalise, crop, mask, mark, resize, label, embed, featurise.

Blobs are C-order bytes with the shape next to them. Jobs are scalar Arrow UDFs over the blob
columns only, so metadata never leaves the JVM; cap ``spark.sql.execution.arrow.maxRecordsPerBatch``
(or ``maxBytesPerBatch``) for large images. NumPy works on ``PIECE`` rows of an Arrow batch at a time, and what
they give is kept as Arrow arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import in_bounds

PIECE = 256  # rows that are Python objects at once
BYTES, LONGS, BYTE_LISTS = pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())


def _as_arrow(made: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([_as_arrow(made[f.name], f.type) for f in kind], fields=list(kind))
    return pa.array(made, kind, from_pandas=True)


def in_pieces(run: Callable[..., pd.Series | pd.DataFrame], kind: pa.DataType = BYTES) -> Callable[..., pa.Array]:
    """``run`` on Arrow columns, of which it gets ``PIECE`` rows at a time as Pandas series."""

    def whole(*columns: pa.Array) -> pa.Array:
        parts = [_as_arrow(run(*[c.slice(at, PIECE).to_pandas() for c in columns]), kind) for at in range(0, len(columns[0]), PIECE)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return whole


def _blob_udf(run: Callable[..., pd.Series | pd.DataFrame], returns: str = "binary", kind: pa.DataType = BYTES) -> Callable[..., Column]:
    return F.arrow_udf(in_pieces(run, kind), returns)


# -- pixel scaling ------------------------------------------------------------------------


def stretch(stack: np.ndarray, low: float, high: float) -> np.ndarray:
    """(C,H,W) to uint8 by per-channel quantiles; a constant channel is 0; fractions are cut."""
    flat = stack.reshape(len(stack), -1).astype(np.float64)
    lo, hi = np.quantile(flat, low, axis=1)[:, None], np.quantile(flat, high, axis=1)[:, None]
    span = np.where(hi > lo, hi - lo, np.inf)
    return np.clip((flat - lo) / span * 255.0, 0, 255).astype(np.uint8).reshape(stack.shape)


def sixteen_to_eight(stack: np.ndarray) -> np.ndarray:
    return (stack.astype(np.float64) / 257.0).astype(np.uint8)


def normalise_fov(df: DataFrame, pixels: str = "pixels", scheme: str = "per_fov_percentile", low: float = 0.001, high: float = 0.999, out: str | None = None) -> DataFrame:
    """uint16 stacks (shape in columns c, h, w) to uint8 stacks."""
    if scheme not in ("per_fov_percentile", "naive"):
        raise ValueError("scheme: per_fov_percentile | naive")

    def run(p: pd.Series, c: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        stacks = (np.frombuffer(b, "<u2").reshape(*s) for b, *s in zip(p, c, h, w))
        fn = (lambda s: stretch(s, low, high)) if scheme == "per_fov_percentile" else sixteen_to_eight
        return pd.Series([fn(s).tobytes() for s in stacks], dtype=object)

    return df.withColumn(out or pixels, _blob_udf(run)(pixels, "c", "h", "w"))


# -- stacking and cropping -------------------------------------------------------------------


def stack_channels(planes: DataFrame, fov: str, channel: str, pixels: str, n_channels: int) -> DataFrame:
    """One row per FOV with its planes joined in channel order: ``fov, c, h, w, pixels, problem``.

    ``problem`` names a missing channel or a shape mismatch. The group is bounded by the number
    of channels of an instrument.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(channel), F.col(pixels).alias("p"))))
    out = planes.groupBy(fov).agg(
        F.countDistinct(channel).cast("int").alias("c"), F.min("h").alias("h"), F.min("w").alias("w"),
        F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["p"])).alias("pixels"),
        (F.countDistinct("h", "w") > 1).alias("__shape"), F.count(F.lit(1)).alias("__n"),
    )
    problem = F.when(F.col("__shape"), "shapes differ").when((F.col("c") != n_channels) | (F.col("__n") != n_channels), "channel count")
    return out.withColumn("problem", problem).drop("__shape", "__n")


def extract_crops(cells: DataFrame, fovs: DataFrame, fov: str, patch: int, height: int, width: int, scheme: str = "per_fov_percentile", low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Square crops around in-bounds cell centroids: ``fov, id_local, cell, mask``.

    ``cells``: fov, id_local, cyto_cent_row, cyto_cent_col. ``fovs``: fov, c, h, w, pixels (uint16)
    and labels (2,H,W uint32: nucleus, cell). Cells are gathered per FOV as small structs before
    the join, so each image crosses the network once and is normalised once. FOVs missing on
    either side drop out; a cell list is bounded by the pixels of its FOV.
    """
    ok = in_bounds(cells, "cyto_cent_row", "cyto_cent_col", height, width, patch)
    wanted = ok.groupBy(fov).agg(F.sort_array(F.collect_list(F.struct(
        F.col("id_local").cast("bigint").alias("id"), F.col("cyto_cent_row").cast("int").alias("r"), F.col("cyto_cent_col").cast("int").alias("c")
    ))).alias("wanted"))
    joined = fovs.join(wanted, fov)
    half = patch // 2

    def cut(pixels: pd.Series, labels: pd.Series, c: pd.Series, h: pd.Series, w: pd.Series, ids: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.DataFrame:
        cell_lists, mask_lists = [], []
        for p, lab, ci, hi, wi, i, r, k in zip(pixels, labels, c, h, w, ids, rows, cols):
            raw = np.frombuffer(p, "<u2").reshape(ci, hi, wi)
            img = stretch(raw, low, high) if scheme == "per_fov_percentile" else sixteen_to_eight(raw)
            lab = np.frombuffer(lab, "<u4").reshape(2, hi, wi)
            boxes = [(slice(None), slice(y - half, y + half), slice(x - half, x + half)) for y, x in zip(r, k)]
            cell_lists.append([img[b].tobytes() for b in boxes])
            mask_lists.append([((lab[b] == j) * np.uint8(255)).astype(np.uint8).tobytes() for j, b in zip(i, boxes)])
        return pd.DataFrame({"cell": cell_lists, "mask": mask_lists})

    field = lambda n: F.transform("wanted", lambda s: s[n])
    udf = _blob_udf(cut, "cell array<binary>, mask array<binary>", pa.struct({"cell": BYTE_LISTS, "mask": BYTE_LISTS}))
    made = joined.withColumn("m", udf("pixels", "labels", "c", "h", "w", field("id"), field("r"), field("c")))
    rows = made.select(fov, F.explode(F.arrays_zip(field("id").alias("id_local"), F.col("m.cell").alias("cell"), F.col("m.mask").alias("mask"))).alias("x"))
    return rows.select(fov, "x.id_local", "x.cell", "x.mask")


def border_drops(cells: DataFrame, fov: str, patch: int, height: int, width: int) -> DataFrame:
    """Cells per FOV too close to the border."""
    half = patch // 2
    ok = (
        (F.col("cyto_cent_row") >= half) & (F.col("cyto_cent_row") < height - half)
        & (F.col("cyto_cent_col") >= half) & (F.col("cyto_cent_col") < width - half)
    )
    return cells.groupBy(fov).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(~ok).alias("n_dropped"))


# -- crop variants ------------------------------------------------------------------------


def _decode(blobs: pd.Series, shape: Sequence[int], what: str) -> np.ndarray:
    size = int(np.prod(shape))
    bad = [i for i, b in enumerate(blobs) if len(b) != size]
    if bad:
        raise ValueError(f"{what} row {bad[0]}: {len(blobs.iloc[bad[0]])} bytes, expected {size} for {tuple(shape)}")
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), *shape)


def _encode(stack: np.ndarray) -> pd.Series:
    return pd.Series([x.tobytes() for x in stack], dtype=object)


def mask_channels(df: DataFrame, shape: Sequence[int], cell: str = "cell", mask: str = "mask") -> DataFrame:
    """Segmented variant: channel 0 keeps nucleus pixels, the other channels keep cell pixels."""
    c, h, w = shape

    def run(x: pd.Series, m: pd.Series) -> pd.Series:
        img, seg = _decode(x, shape, cell), _decode(m, (2, h, w), mask) != 0
        which = np.minimum(np.arange(c), 1)
        return _encode(img * seg[:, which])

    return df.withColumn(cell, _blob_udf(run)(cell, mask))


def corner_mask(h: int, w: int, size: int, pad: int) -> np.ndarray:
    """True in the four squares of ``size`` that lie ``pad`` inside each corner."""
    if min(h, w) < pad + size:
        raise ValueError(f"patch {size} with pad {pad} does not fit {h}×{w}")

    def edge(n: int) -> np.ndarray:
        from_side = np.minimum(np.arange(n), np.arange(n)[::-1])
        return (from_side >= pad) & (from_side < pad + size)

    return np.outer(edge(h), edge(w))


def mark_density(df: DataFrame, shape: Sequence[int], size: int, pad: int, cell: str = "cell", density: str = "n_cells_scaled") -> DataFrame:
    """Density variant: the corner squares of every channel hold the scaled count as one byte.

    The byte is the count cut to a whole number between 0 and 255; a missing count is 0.
    """
    _, h, w = shape
    marked = corner_mask(h, w, size, pad)
    x = F.col(density).cast("double")
    level = F.when(x.isNull() | F.isnan(x), 0).when(x >= 255, 255).when(x <= 0, 0).otherwise(F.floor(x)).cast("int")

    def run(blobs: pd.Series, levels: pd.Series) -> pd.Series:
        images = _decode(blobs, shape, cell)
        return _encode(np.where(marked, levels.to_numpy(np.uint8)[:, None, None, None], images))

    return df.withColumn(cell, _blob_udf(run)(cell, level))


def all_variants(crops: DataFrame, shape: Sequence[int], size: int, pad: int) -> dict[str, DataFrame]:
    """C (crop), S (segmented), CD and SD (with density marks; marks go on after masking)."""
    seg = mask_channels(crops, shape)
    return {"C": crops, "S": seg, "CD": mark_density(crops, shape, size, pad), "SD": mark_density(seg, shape, size, pad)}


def variant_mismatches(a: DataFrame, b: DataFrame, key: str, compare: Sequence[str], image: str = "cell") -> DataFrame:
    """One row comparing two variants: missing keys, repeated keys, differing metadata, differing images."""
    shape = lambda d, t: d.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"n{t}"), F.min(F.hash(*compare)).alias(f"m{t}"), F.min(F.xxhash64(image)).alias(f"i{t}")
    )
    j = shape(a, "a").join(shape(b, "b"), key, "full")
    return j.agg(
        F.count_if(F.col("na").isNull() | F.col("nb").isNull()).alias("n_missing"),
        F.count_if((F.col("na") > 1) | (F.col("nb") > 1)).alias("n_repeated"),
        F.count_if(F.col("ma") != F.col("mb")).alias("n_metadata_differs"),
        F.count_if(F.col("ia") != F.col("ib")).alias("n_image_differs"),
        F.count(F.lit(1)).alias("n_keys"),
    )


def resize(df: DataFrame, shape: Sequence[int], to: tuple[int, int], blob: str = "cell", nearest: bool | Sequence[int] = False) -> DataFrame:
    """Align-corners resize of (C,H,W) uint8: bilinear for images, nearest for masks.

    ``nearest`` says so for all channels, or lists the mask channels of a stack that also holds images.
    """
    c, h, w = shape
    masks = list(range(c)) if nearest is True else sorted(nearest or ())
    if (h, w) == tuple(to):
        return df
    ys = np.linspace(0, h - 1, to[0])
    xs = np.linspace(0, w - 1, to[1])

    def run(x: pd.Series) -> pd.Series:
        img = _decode(x, shape, blob)
        yi, xi = np.floor(ys + 0.5).astype(int), np.floor(xs + 0.5).astype(int)
        if len(masks) == c:
            return _encode(np.ascontiguousarray(img[:, :, yi][:, :, :, xi]))
        y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
        y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
        fy, fx = (ys - y0)[:, None], xs - x0
        f = img.astype(np.float64)
        rows = f[:, :, y0] * (1 - fy) + f[:, :, y1] * fy
        out = np.clip(rows[..., x0] * (1 - fx) + rows[..., x1] * fx + 1e-9, 0, 255).astype(np.uint8)
        out[:, masks] = img[:, masks][:, :, yi][:, :, :, xi]
        return _encode(out)

    return df.withColumn(blob, _blob_udf(run)(blob))


# -- label images -------------------------------------------------------------------------


def _label_moments(lab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels > 0 of an image with their area and centroid row/column."""
    ids, inv, area = np.unique(lab, return_inverse=True, return_counts=True)
    r, c = np.divmod(np.arange(lab.size), lab.shape[1])
    inv = inv.ravel()
    row, col = np.bincount(inv, weights=r) / area, np.bincount(inv, weights=c) / area
    keep = ids > 0
    return ids[keep], area[keep], row[keep], col[keep]


def drop_border_labels(df: DataFrame, labels: str = "labels", out: str | None = None) -> DataFrame:
    """Clear labels that touch the image border ((H,W) uint32, shape in h, w)."""

    def run(x: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        made = []
        for b, hi, wi in zip(x, h, w):
            lab = np.frombuffer(b, "<u4").reshape(hi, wi)
            inner = np.zeros_like(lab, dtype=bool)
            inner[1:-1, 1:-1] = True
            made.append(np.where(np.isin(lab, lab[~inner]), 0, lab).astype("<u4").tobytes())
        return pd.Series(made, dtype=object)

    return df.withColumn(out or labels, _blob_udf(run)(labels, "h", "w"))


def _relabel(img: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Replace labels ``old`` by ``new``; any other label becomes 0."""
    if len(old) == 0:
        return np.zeros(img.shape, "<u4")
    order = np.argsort(old)
    at = np.minimum(np.searchsorted(old[order], img), len(old) - 1)
    return np.where(old[order][at] == img, new[order][at], 0).astype("<u4")


def match_labels(df: DataFrame, nucleus: str = "nucleus", cell: str = "cell_labels") -> DataFrame:
    """Pair each nucleus with the cell under its centroid and renumber pairs 1..N by nucleus label.

    A cell takes the nucleus with the smallest label; anything unpaired is cleared. Adds
    ``matched`` = struct(nucleus, cell, nucleus_ids, cell_ids).
    """

    def run(n: pd.Series, x: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for nb, cb, hi, wi in zip(n, x, h, w):
            nuc, cyt = (np.frombuffer(b, "<u4").reshape(hi, wi) for b in (nb, cb))
            ids, _, r, c = _label_moments(nuc)
            under = cyt[r.astype(int), c.astype(int)] if len(ids) else np.empty(0, cyt.dtype)
            hit = np.nonzero(under > 0)[0]
            first = np.sort(hit[np.unique(under[hit], return_index=True)[1]])
            pair_n, pair_c = ids[first], under[first]
            new_id = np.arange(1, len(first) + 1)
            new_n, new_c = _relabel(nuc, pair_n, new_id), _relabel(cyt, pair_c, new_id)
            rows.append((new_n.tobytes(), new_c.tobytes(), pair_n.astype(np.int64), pair_c.astype(np.int64)))
        return pd.DataFrame(rows, columns=["nucleus", "cell", "nucleus_ids", "cell_ids"])

    returns = "nucleus binary, cell binary, nucleus_ids array<bigint>, cell_ids array<bigint>"
    kind = pa.struct({"nucleus": BYTES, "cell": BYTES, "nucleus_ids": LONGS, "cell_ids": LONGS})
    return df.withColumn("matched", _blob_udf(run, returns, kind)(nucleus, cell, "h", "w"))


def cell_stats(df: DataFrame, fov: str) -> DataFrame:
    """One row per matched cell: areas, centroids, nucleus/cell area ratio (0 without cytoplasm)."""

    def run(n: pd.Series, x: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for nb, cb, hi, wi in zip(n, x, h, w):
            a, b = (_label_moments(np.frombuffer(v, "<u4").reshape(hi, wi)) for v in (nb, cb))
            count = int(a[0].max()) if len(a[0]) else 0
            table = np.zeros((count, 6))
            for (ids, area, r, c), at in ((a, 0), (b, 3)):
                if len(ids):
                    table[ids.astype(int) - 1, at : at + 3] = np.stack([area, r, c], axis=1)
            out.append(table.tolist())
        return pd.Series(out, dtype=object)

    m = _blob_udf(run, "array<array<double>>", pa.list_(pa.list_(pa.float64())))("matched.nucleus", "matched.cell", "h", "w")
    # outer, as Spark asks for the size of an inner one's array by calling all functions below once more
    each = F.posexplode_outer("__s").alias("i", "v")
    rows = df.withColumn("__s", m).select(fov, F.col("matched.nucleus_ids").alias("ni"), F.col("matched.cell_ids").alias("ci"), F.size("__s").alias("n"), each).where("i is not null")
    v = lambda i: F.col("v")[i]
    return rows.select(
        F.col(fov), (F.col("i") + 1).cast("bigint").alias("id_local"), F.get("ni", F.col("i")).alias("nuc_id_global"), F.get("ci", F.col("i")).alias("cell_id_global"),
        v(4).alias("cyto_cent_row"), v(5).alias("cyto_cent_col"), v(1).alias("nuc_cent_row"), v(2).alias("nuc_cent_col"),
        v(0).cast("bigint").alias("nuc_area"), v(3).cast("bigint").alias("cyto_area"),
        F.when(v(3) > 0, v(0) / v(3)).otherwise(0.0).alias("nuc_cyto_ratio"), F.col("n").cast("bigint").alias("n_cells_in_fov"),
    )


# -- inference and features ------------------------------------------------------------------

Encoder = Callable[[np.ndarray], np.ndarray]
ENCODERS: dict[str, Callable[..., Encoder]] = {}


def encoder(name: str):
    """Register a factory ``(shape, **options) -> (n,C,H,W float32 in [0,1]) -> (n,d)``."""

    def add(factory):
        ENCODERS[name] = factory
        return factory

    return add


@encoder("linear")
def linear_projection(shape: Sequence[int], dim: int = 16, seed: int = 0) -> Encoder:
    """Fixed random projection; stands in for a trained model."""
    weight = np.random.default_rng(seed).standard_normal((int(np.prod(shape)), dim)).astype(np.float32)
    return lambda x: x.reshape(len(x), -1) @ weight


@encoder("channel_mean")
def channel_mean(shape: Sequence[int]) -> Encoder:
    return lambda x: x.mean(axis=(2, 3), dtype=np.float64)


def embed(df: DataFrame, shape: Sequence[int], name: str = "linear", cell: str = "cell", out: str = "embedding", **options) -> DataFrame:
    """Decode, scale to [0,1], encode and L2-normalise; the encoder is built once per task."""
    factory = ENCODERS[name]

    def run(batches):
        model = factory(shape, **options)
        for x in batches:
            if len(x) == 0:
                yield pd.Series([], dtype=object)
                continue
            e = np.asarray(model(_decode(x, shape, cell).astype(np.float32) / np.float32(255.0)), dtype=np.float64)
            n = np.linalg.norm(e, axis=1, keepdims=True)
            yield pd.Series(list(np.divide(e, n, out=np.zeros_like(e), where=n > 0).astype(np.float32)))

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(cell))


Measure = Callable[[np.ndarray, np.ndarray], dict[str, float]]


def intensity(img: np.ndarray, region: np.ndarray) -> dict[str, float]:
    """Area of the region and mean/std/min/max of every channel inside it."""
    out = {"AreaShape_Area": float(region.sum())}
    for i, ch in enumerate(img.astype(np.float64)):
        px = ch[region]
        for stat in ("mean", "std", "min", "max"):
            out[f"Intensity_{stat.capitalize()}_{i}"] = float(getattr(px, stat)())
    return out


def channel_correlation(img: np.ndarray, region: np.ndarray) -> dict[str, float]:
    px = img.astype(np.float64)[:, region]
    with np.errstate(all="ignore"):
        r = np.corrcoef(px) if len(px) > 1 else np.ones((1, 1))
    return {f"Correlation_Correlation_{i}_{j}": float(r[i, j]) for i in range(len(px)) for j in range(i)}


def featurise(df: DataFrame, shape: Sequence[int], measures: Sequence[Measure] = (intensity, channel_correlation), cell: str = "cell", mask: str = "mask", out: str = "features") -> DataFrame:
    """Map of feature name to value for nucleus and cell regions; a failing measurement gives null."""
    _, h, w = shape
    blank = np.zeros(shape, np.uint8)
    blank[:, 0, 0] = 1
    names = [list(m(blank, np.ones((h, w), bool))) for m in measures]

    def run(x: pd.Series, m: pd.Series) -> pd.Series:
        rows = []
        for img, seg in zip(_decode(x, shape, cell), _decode(m, (2, h, w), mask) != 0):
            row: dict[str, float] = {}
            for part, region in zip(("Nuclei", "Cells"), seg):
                for fn, keys in zip(measures, names):
                    try:
                        got = fn(img, region)
                    except Exception:
                        got = dict.fromkeys(keys, float("nan"))
                    row |= {f"{part}_{k}": float(v) for k, v in got.items()}
            rows.append(list(row.items()))
        return pd.Series(rows, dtype=object)

    return df.withColumn(out, _blob_udf(run, "map<string,double>", pa.map_(pa.string(), pa.float64()))(cell, mask))
