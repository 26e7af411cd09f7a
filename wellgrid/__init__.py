"""Spark operators for high-content-imaging profiles: plates, wells, cells, vectors."""

__version__ = "0.1.0"
