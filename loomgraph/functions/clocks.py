"""Vector clocks as ``MAP<STRING, INT>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all_le(left: Column, right: Column) -> Column:
    checks = F.map_zip_with(
        left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) <= F.coalesce(b, F.lit(0))
    )
    return F.forall(F.map_values(checks), lambda ok: ok)


def compare(left: Column, right: Column) -> Column:
    """How ``left`` relates to ``right``: before, after, equal or concurrent."""
    below, above = _all_le(left, right), _all_le(right, left)
    return (
        F.when(below & above, F.lit("equal"))
        .when(below, F.lit("before"))
        .when(above, F.lit("after"))
        .otherwise(F.lit("concurrent"))
    )


def merge(left: Column, right: Column) -> Column:
    """Per-node maximum."""
    return F.map_zip_with(
        left, right, lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    )
