"""Naming rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second name token -> feature family.
TEXTURE_TOKENS = [
    "AngularSecondMoment", "Contrast", "Correlation", "DifferenceEntropy", "DifferenceVariance",
    "Entropy", "InfoMeas1", "InfoMeas2", "InverseDifferenceMoment", "SumAverage", "SumEntropy",
    "SumVariance", "Variance",
]
AREASHAPE_TOKENS = [
    "BoundingBoxMaximum", "BoundingBoxMinimum", "Center", "CentralMoment", "Compactness",
    "ConvexArea", "Eccentricity", "EquivalentDiameter", "EulerNumber", "Extent", "FormFactor",
    "HuMoment", "InertiaTensor", "InertiaTensorEigenvalues", "Location", "MajorAxisLength",
    "MaximumRadius", "MedianRadius", "MinFeretDiameter", "MinorAxisLength", "NormalizedMoment",
    "Orientation", "Solidity", "SpatialMoment",
]
FAMILIES = ["Intensity", "Texture", "Granularity", "RadialDistribution", "AreaShape", "Zernike", "Other"]

# A gene symbol as printed on a result page, and words that only look like one.
GENE_SYMBOL = r"^[A-Z][A-Z0-9\-\.]{1,14}$"
GENE_STOPWORDS = [
    "SELECT", "VALIDATED", "PRE", "DESIGNED", "AMBION", "THERMO", "FISHER", "SILENCER", "SIRNA",
    "RNA", "CELL", "FOR", "THE", "AND", "OR", "NOT", "IN", "AT", "BY", "US", "ADD", "ORDER",
    "PRODUCT", "GENE", "HUMAN", "CODING", "STEALTH", "SEARCH", "COMPARE", "EMAIL", "EXPORT",
    "PRICE", "EACH", "VIEW", "SAVE", "CART", "RESULTS", "SPECIES", "ASSAY", "INVITROGEN",
    "APPLIED", "BIOSYSTEMS", "GIBCO", "SCIENTIFIC", "SWITCH", "MIRNA", "VIVO",
]


BLANKS = " \t\x0b\x0c\xa0"  # stripped from both ends of a line


def text_lines(text: str | Column) -> Column:
    """Stripped non-empty lines of a text."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    return F.filter(lines, lambda x: x != "")


def feature_family(name: str | Column) -> Column:
    token = F.try_element_at(F.split(F.col(name) if isinstance(name, str) else name, "_"), F.lit(2))
    return (
        F.when(token.isin("Intensity", "Granularity", "RadialDistribution", "Zernike"), token)
        .when(token.isin(TEXTURE_TOKENS), "Texture")
        .when(token.isin(AREASHAPE_TOKENS), "AreaShape")
        .otherwise("Other")
    )


def position_in(col: str | Column, order: list[str]) -> Column:
    """Rank of a category in a custom order; unknown values sort last."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col) if isinstance(col, str) else col)
    return F.when(pos > 0, pos).otherwise(len(order) + 1)
