"""Reusable plan shapes: skew-safe joins, ranks, quantiles, blocked similarity."""
