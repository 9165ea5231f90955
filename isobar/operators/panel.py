"""Per-entity time series operators: lags, rolling statistics, streaks, next-period targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from isobar.operators.chunks import CHUNK, Stage, chunk_window, over_chunks, with_chunk
from isobar.schemas import LAGS, ROLL_WINDOWS


def _require(df: DataFrame, cols: Sequence[str], skip_missing: bool) -> list[str]:
    missing = [c for c in cols if c not in df.columns]
    if missing and not skip_missing:
        raise ValueError(f"missing columns: {missing}")
    return [c for c in cols if c in df.columns]


def lag_columns(spec: WindowSpec, cols: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(spec) for c in cols for k in lags}


def rolling_columns(spec: WindowSpec, cols: Sequence[str], windows: Sequence[int],
                    include_current: bool = False) -> dict[str, Column]:
    """Mean and sample standard deviation (0 below two values) of the last ``w`` rows.

    The current row is left out by default, so that a statistic never sees the value it is used
    to predict.
    """
    out = {}
    for w in windows:
        frame = spec.rowsBetween(-(w - 1), 0) if include_current else spec.rowsBetween(-w, -1)
        for c in cols:
            out[f"{c}_roll_mean_{w}"] = F.avg(c).over(frame)
            out[f"{c}_roll_std_{w}"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
    return out


def consecutive(spec: WindowSpec, condition: Column, n: int) -> Column:
    """1 from the n-th row of a run of rows that meet the condition."""
    held = F.coalesce(condition, F.lit(False)).cast("int")
    return (F.sum(held).over(spec.rowsBetween(-(n - 1), 0)) >= n).cast("int")


def lag_features(df: DataFrame, cols: Sequence[str], lags: Sequence[int] = LAGS,
                 entity: str = "city", time: str = "time", unit: str = "year",
                 skip_missing: bool = False) -> DataFrame:
    cols = _require(df, cols, skip_missing)
    return over_chunks(df, [lambda w: lag_columns(w, cols, lags)], back=max(lags),
                       entity=entity, time=time, unit=unit, reads=cols)


def rolling_stats(df: DataFrame, cols: Sequence[str], windows: Sequence[int] = ROLL_WINDOWS,
                  include_current: bool = False, entity: str = "city", time: str = "time",
                  unit: str = "year", skip_missing: bool = False) -> DataFrame:
    cols = _require(df, cols, skip_missing)
    return over_chunks(df, [lambda w: rolling_columns(w, cols, windows, include_current)],
                       back=max(windows), entity=entity, time=time, unit=unit, reads=cols)


def lead_target(df: DataFrame, col: str, out: str = "label", periods: int = 1,
                entity: str = "city", time: str = "time", unit: str = "year",
                stages: Sequence[Stage] = (), back: int = 0,
                reads: Sequence[str] | None = None) -> DataFrame:
    """The value ``periods`` rows on; rows without one are dropped.

    ``stages`` may make the column first, from up to ``back`` rows before and the columns
    ``reads``, so that both share one shuffle.
    """
    led = over_chunks(df, [*stages, lambda w: {out: F.lead(col, periods).over(w)}], back=back,
                      ahead=periods, entity=entity, time=time, unit=unit,
                      reads=[col] if reads is None else reads)
    return led.where(F.col(out).isNotNull())


def streak_length(df: DataFrame, condition: Column, out: str = "streak",
                  gap_breaks: bool = False, entity: str = "city", time: str = "time",
                  unit: str = "year") -> DataFrame:
    """Number of consecutive rows up to this one that meet the condition, 0 where it fails.

    A run may span any number of chunks. Inside a chunk the length counts from the last reset; a
    row before the first reset adds the run that reaches the chunk's border, which is a prefix
    over one summary row per chunk. With ``gap_breaks`` a missing day also ends a run.
    """
    held = F.coalesce(condition, F.lit(False))
    chunked = with_chunk(df, entity, time, unit)
    spec = chunk_window(entity, time)
    upto = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = chunked.withColumns({"_held": held, "_rank": F.row_number().over(spec),
                                  "_previous": F.lag(time).over(spec)})
    # Position of the last row not counted: the row itself if it fails, the row before a gap.
    reset = F.when(~F.col("_held"), F.col("_rank"))
    if gap_breaks:
        gap = F.datediff(F.col(time), F.col("_previous")) > 1
        reset = reset.when(gap, F.col("_rank") - 1)
    marked = (ranked.withColumn("_reset", reset)
              .withColumn("_base", F.max("_reset").over(upto)))

    summary = marked.groupBy(entity, CHUNK).agg(
        F.count(F.lit(1)).alias("_size"), F.max("_reset").alias("_last"),
        F.min(time).alias("_from"), F.max(time).alias("_to"))
    across = Window.partitionBy(entity).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.datediff(F.col("_from"), F.lag("_to").over(across)) > 1
    border = (F.coalesce(apart, F.lit(False)) if gap_breaks else F.lit(False))
    placed = summary.withColumns({
        "_offset": F.coalesce(F.sum("_size").over(earlier), F.lit(0)), "_border": border})
    absolute = (F.when(F.col("_last").isNotNull(), F.col("_offset") + F.col("_last"))
                .when(F.col("_border"), F.col("_offset")))
    carried = placed.withColumn("_absolute", absolute).select(
        entity, CHUNK,
        F.when(F.col("_border"), F.lit(0)).otherwise(
            F.col("_offset") - F.coalesce(F.max("_absolute").over(earlier), F.lit(0))
        ).alias("_carry"))

    length = F.when(F.col("_base").isNotNull(), F.col("_rank") - F.col("_base")).otherwise(
        F.col("_rank") + F.col("_carry"))
    helpers = ["_held", "_rank", "_previous", "_reset", "_base", "_carry", CHUNK]
    return (marked.join(carried, [entity, CHUNK], "left")
            .withColumn(out, length.cast("int")).drop(*helpers))


def trailing_full_mean(df: DataFrame, col: str, out: str, periods: int = 12,
                       entity: str = "city", time: str = "month") -> DataFrame:
    """Mean of the last ``periods`` rows, NULL until that many exist.

    For series already reduced to one row per month, whose length the calendar bounds.
    """
    frame = Window.partitionBy(entity).orderBy(time).rowsBetween(-(periods - 1), 0)
    full = F.count(col).over(frame) == periods
    return df.withColumn(out, F.when(full, F.avg(col).over(frame)))
