"""Entity metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach_dimension(df: DataFrame, dimension: DataFrame, on: str = "city",
                     cols: Sequence[str] | None = None) -> DataFrame:
    """Dimension columns on every row, NULL for entities the dimension lacks.

    Join strategy is Spark's: a dimension below the broadcast threshold is broadcast by its
    measured size, a larger one is merge-joined with skewed entities split at run time.
    """
    chosen = dimension if cols is None else dimension.select(on, *[c for c in cols if c != on])
    return df.join(chosen, on, "left")
