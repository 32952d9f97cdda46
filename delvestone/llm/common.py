"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.lineage import materialise
from ..sources.tables import table

__all__ = ["bounded", "materialise", "require", "table"]


def require(df: DataFrame, *names: str) -> None:
    """Fail early, with a clear message, if a column is missing or ambiguous."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"column {name!r} must occur exactly once; the input has {df.columns}")


def bounded(rows: list, limit: int, what: str) -> list:
    """Check the size of what goes to the driver or into a broadcast."""
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the limit or pass them in blocks")
    return rows
