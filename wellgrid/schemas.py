"""Fixed table schemas (one StructType per table that crosses a job boundary)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BinaryType()

WELL = _struct(
    Metadata_Source=S, Metadata_Batch=S, Metadata_Plate=S, Metadata_Well=S,
    Metadata_PlateType=S, Metadata_JCP2022=S, Metadata_InChIKey=S, Metadata_InChI=S,
    Metadata_SMILES=S,
)
SIRNA_MAP = _struct(sirna_id=S, gene_symbol=S, ncbi_gene_id=S, source=S)
FOV_PIXELS = _struct(fov_id=S, c=T.IntegerType(), h=T.IntegerType(), w=T.IntegerType(), pixels=B)
CELL_STATS = _struct(
    fov_id=S, id_local=L, nuc_id_global=L, cell_id_global=L,
    cyto_cent_row=D, cyto_cent_col=D, nuc_cent_row=D, nuc_cent_col=D,
    nuc_area=L, cyto_area=L, nuc_cyto_ratio=D, n_cells_in_fov=L,
)
CROP = _struct(
    row_key=S, source=S, plate=S, well=S, tile=S, id_local=L, nuc_area=L, cyto_area=L,
    nuc_cyto_ratio=D, n_cells_in_fov=L, n_cells_scaled=D, Metadata_JCP2022=S,
    Metadata_InChIKey=S, Metadata_PlateType=S, perturbation=S, batch=S, treatment=S,
    mask=B, cell=B,
)
PUBLISHED_CROP = T.StructType(CROP.fields + [T.StructField("Metadata_Perturbation", S, True)])
LOOKUP = _struct(key=S, vector=T.ArrayType(T.FloatType(), False))
EMBEDDING = _struct(row_key=S, embedding=T.ArrayType(T.FloatType(), False))
