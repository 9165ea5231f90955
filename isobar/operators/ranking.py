"""Exact order statistics without putting a group into one task.

``percentile`` keeps a value-to-count map of a whole group in one aggregation buffer, and a running
sum over a group sorts it in one task. Both are replaced here by two levels: values are cut into
slices, slices are summed (map-side), a prefix over the few slice totals gives the offset of each
slice, and ordering happens inside a slice only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.session import materialize

# Rank error of percentile_approx is at most n / ACCURACY. A bracket of 4 / ACCURACY on both sides
# of a quantile must contain it; groups up to FULL_GROUP rows are ranked whole, so that the
# bracket is always several rows wide.
ACCURACY = 2_000
MARGIN = 4.0 / ACCURACY
FULL_GROUP = 2_000
# Parts of a bracket, and rows of a range of counted values.
SLICES = 64
SLICE_ROWS = 200_000


def same_keys(keys: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """Equality of keys in which NULL equals NULL."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def cumulative(df: DataFrame, by: Sequence[str], slice_col: str, order: Sequence[Column],
               sums: Mapping[str, str]) -> DataFrame:
    """Running totals per ``by`` group in ``(slice_col, *order)`` order, two-level.

    ``sums`` maps output names to summed columns. ``slice_col`` must grow with the order. NULL is
    a group like any other.
    """
    keys = [*by, slice_col]
    spread = df.repartition(*keys)
    totals = spread.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = spread.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    joined = running.alias("l").join(offsets.alias("r"), same_keys(keys))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns],
                         *[(F.col(f"r._o_{n}") + F.col(f"l._r_{n}")).alias(n) for n in sums])


def by_ranges(df: DataFrame, order: Sequence[str], rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` as a written table with ``_slice``, its range of the order, of about ``rows`` rows.

    The number of ranges follows from a count, so a range does not grow with the table. Written,
    since a range is the partition that a sample of the rows has put a row in.
    """
    counted = materialize(df, "counted")
    ranges = max(1, -(-counted.count() // rows))
    placed = counted if ranges == 1 else counted.repartitionByRange(ranges, *order)
    number = F.lit(0) if ranges == 1 else F.spark_partition_id()
    return materialize(placed.withColumn("_slice", number), "ranges")


def as_map(frame: DataFrame, key: Column, value: Column) -> Column:
    """A small keyed frame as a map-valued scalar subquery.

    For keys whose number is fixed by the schema, not by the data: classes of a model, features
    of a contract. The subquery runs once; rows look the value up without a join.
    """
    entries = F.collect_list(F.struct(key.alias("k"), value.alias("v")))
    return frame.agg(F.map_from_entries(entries).alias("m")).scalar()


def _bracket(value: str, probs: Sequence[float]) -> Column:
    """Row count and, for each quantile, a value below and a value above it."""
    ends = [p for q in probs for p in (max(0.0, q - MARGIN), min(1.0, q + MARGIN))]
    return F.struct(F.count(value).alias("n"),
                    F.percentile_approx(value, ends, ACCURACY).alias("ends"))


def _compress(rows: DataFrame, by: Sequence[str], value: str, n_probs: int) -> DataFrame:
    """(value, count) rows inside the brackets, one counted row for each gap between them.

    A gap row is anchored at the bracket end below it, so that ``(_at, _gap)`` sorts like the
    values do. Each bracket is cut into equal-width slices for the running totals.
    """
    v, n = F.col(value), F.col("_b.n")
    lows = [F.col("_b.ends")[2 * i] for i in range(n_probs)]
    highs = [F.col("_b.ends")[2 * i + 1] for i in range(n_probs)]
    whole = n <= FULL_GROUP
    inside = reduce(lambda a, b: a | b, [v.between(a, b) for a, b in zip(lows, highs)], whole)
    ends_below = [F.when(high < v, high) for high in highs]
    anchor = ends_below[0] if n_probs == 1 else F.greatest(*ends_below)
    keyed = rows.withColumns({"_n": n, "_gap": ~inside, "_at": F.when(inside, v).otherwise(anchor)})
    place = F.when(whole, F.lit(0))
    for i in reversed(range(n_probs)):
        width = F.nullif(highs[i] - lows[i], F.lit(0.0))
        share = F.coalesce((F.col("_at") - lows[i]) / width, F.lit(0.0))
        step = F.floor(F.least(share, F.lit(1.0)) * (SLICES - 1)).cast("int")
        place = place.when(F.col("_at") >= lows[i], i * SLICES + step)
    keyed = keyed.withColumn("_slice", place.otherwise(F.lit(-1)))
    return keyed.groupBy(*by, "_n", "_slice", "_at", "_gap").agg(F.count(F.lit(1)).alias("_count"))


def _interpolate(counted: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Linear interpolation between the values around rank ``q * (n - 1)``.

    Raises if a rank falls into the counted rows outside the bracket, which the error bound of the
    sketch rules out.
    """
    ranked = cumulative(counted, by, "_slice", [F.col("_at"), F.col("_gap")], {"_cum": "_count"})
    parts, outs = [], []
    for i, (name, q) in enumerate(probs.items()):
        rank = F.lit(float(q)) * (F.col("_n") - 1)
        for side, end in (("a", F.floor(rank)), ("z", F.ceil(rank))):
            parts.append(F.min(F.when(F.col("_cum") > end, F.struct("_cum", "_at", "_gap")))
                         .alias(f"_{side}{i}"))
        parts.append(F.max(rank - F.floor(rank)).alias(f"_w{i}"))
        low, high, weight = F.col(f"_a{i}._at"), F.col(f"_z{i}._at"), F.col(f"_w{i}")
        missed = F.col(f"_a{i}._gap") | (F.col(f"_z{i}._gap") & (weight > 0))
        value = F.when(low == high, low).otherwise(low + (high - low) * weight)
        outs.append(F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")))
                    .when(weight == 0, low).otherwise(value).alias(name))
    return ranked.groupBy(*by).agg(*parts).select(*by, *outs)


def group_quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str],
                    spread: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """Quantiles of ``value`` per group, one column per entry of ``probs`` (ascending).

    NULL and NaN are ignored. ``exact`` interpolates linearly between ranks; ``approx`` returns an
    element of the group from a bounded sketch. No job runs here: adaptive execution broadcasts the
    brackets if they turn out small and splits the partitions of large groups otherwise. ``spread``
    names columns that tell the rows of one group apart.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    spread = list(spread or [value])
    rows = clean.select(*dict.fromkeys([*by, *spread]), F.col(value).cast("double").alias("_v"))
    if method == "approx":
        return rows.groupBy(*by).agg(*[
            F.percentile_approx("_v", q, ACCURACY).alias(name) for name, q in probs.items()])
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")
    qs = list(probs.values())
    brackets = rows.groupBy(*by).agg(_bracket("_v", qs).alias("_b"))
    counted = _compress(rows.join(brackets, list(by), "left"), by, "_v", len(qs))
    return _interpolate(counted, by, probs)


def column_quantiles(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """The exact quantile of each column as rows ``(feature, value)``; all-NULL columns are absent.

    All brackets come from one pass over the columns; only values inside a bracket are sorted.
    """
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    clean = clean.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    wide = clean.agg(*[_bracket(c, [q]).alias(c) for c in cols])
    per_column = wide.select(F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c) for c in cols])).alias("m"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_v")) for c in cols])
    rows = (clean.select(F.inline(pairs)).where(F.col("_v").isNotNull())
            .withColumn("_b", F.try_element_at(per_column.scalar(), F.col("feature"))))
    return _interpolate(_compress(rows, ["feature"], "_v", 1), ["feature"], {"value": q})
