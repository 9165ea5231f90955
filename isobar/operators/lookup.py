"""Joins of a small keyed frame onto many rows, safe when it is not small and when keys are hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.session import materialize

# A lookup of up to this many bytes, as counted, is broadcast.
BROADCAST_BYTES = 8 << 20


def counted_bytes(table: DataFrame) -> int:
    """Bytes of the values of a written table, from one pass over it."""
    widths = [F.octet_length(F.col(f"`{c}`").cast("string")) + 8 if kind == "string"
              or kind.startswith(("array", "struct", "map")) else F.lit(16)
              for c, kind in table.dtypes]
    size = widths[0]
    for w in widths[1:]:
        size = size + F.coalesce(w, F.lit(8))
    return table.agg(F.sum(size)).first()[0] or 0


def sized(lookup: DataFrame) -> tuple[DataFrame, bool]:
    """The frame as a written table, and whether its counted bytes are few enough to broadcast."""
    table = materialize(lookup, "lookup")
    return table, counted_bytes(table) <= BROADCAST_BYTES


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a one-row-per-key frame.

    The lookup is computed and measured first: a small one is broadcast, so that the rows are not
    shuffled at all. A large one is joined by a shuffle of both sides, in which adaptive execution
    splits the partitions of hot keys.
    """
    table, small = sized(lookup)
    return rows.join(F.broadcast(table) if small else table, list(keys), "left")
