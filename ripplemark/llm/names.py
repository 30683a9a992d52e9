"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_prefix(docs: DataFrame) -> str:
    """A beginning of names that no column has."""
    start = "_own"
    while any(c.lower().startswith(start) for c in docs.columns):
        start += "_"
    return start
