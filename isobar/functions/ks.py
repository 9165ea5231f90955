"""p-values of the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = 100


def asymptotic_p(statistic: Column, n_ref: Column, n_cur: Column) -> Column:
    """Kolmogorov's limit series ``2 * sum (-1)^(k-1) exp(-2 k^2 x^2)``, as SQL expressions."""
    n_ref, n_cur = n_ref.cast("double"), n_cur.cast("double")
    x = statistic * F.sqrt(n_ref * n_cur / (n_ref + n_cur))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    # The truncated series has not settled for tiny x, where the limit is 1.
    return F.when(x < 0.1, F.lit(1.0)).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)),
                                                         F.lit(1.0)))


def exact_p_value(statistic: float, n: int, m: int) -> float:
    """Chance that two samples of one continuous distribution differ at least this much.

    Orderings of the pooled sample are lattice paths from (0, 0) to (n, m). The chance that a
    path keeps ``|i/n - j/m|`` below the statistic is carried along the anti-diagonals: from a
    path at (i, j) the next pooled value is from the first sample with chance
    ``(n - i) / (n + m - i - j)``.
    """
    bound = int(round(statistic * n * m))
    if bound <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for total in range(n + m):
        left = n + m - total
        first = np.clip((n - i) / left, 0.0, 1.0)
        moved = inside * (1.0 - first)
        moved[1:] += (inside * first)[:-1]
        j = total + 1 - i
        allowed = (j >= 0) & (j <= m) & (np.abs(i * m - j * n) < bound)
        inside = np.where(allowed, moved, 0.0)
    return float(min(max(1.0 - inside[n], 0.0), 1.0))


@F.pandas_udf(DoubleType())
def exact_p(statistic: pd.Series, n_ref: pd.Series, n_cur: pd.Series) -> pd.Series:
    """Exact p-value per row; meant for reduced frames of one row per feature."""
    rows = zip(statistic, n_ref, n_cur)
    return pd.Series([None if pd.isna(d) else exact_p_value(float(d), int(n), int(m))
                      for d, n, m in rows], dtype="float64")


def p_value(statistic: Column, n_ref: Column, n_cur: Column, method: str) -> Column:
    """``exact``, whose work grows with the product of the sample sizes, or ``asymptotic``."""
    if method == "asymptotic":
        return asymptotic_p(statistic, n_ref, n_cur)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    return exact_p(statistic, n_ref, n_cur)
