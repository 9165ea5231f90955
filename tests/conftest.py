from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from isobar.session import build_session  # noqa: E402

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", master="local[4]", shuffle_partitions=4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as dictionaries, in the given order."""
    return [r.asDict() for r in df.orderBy(*order).collect()]


def panel(spark, series: dict[str, list], start="2023-12-20", col="temp_max", step="1D"):
    """One row per (city, day) from a list of values per city."""
    parts = []
    for city, values in series.items():
        days = pd.date_range(start, periods=len(values), freq=step)
        parts += [(city, d.date(), None if v is None else float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(parts, f"city string, time date, {col} double")
