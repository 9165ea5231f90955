"""Drift reports kept up to date while the prediction log grows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isobar.operators.drift import LAST, drift_report
from isobar.schemas import PREDICTION_LOG
from isobar.sources.sinks import overwrite_touched

ORDER = ("timestamp", "id")
STATE = "places array<struct<at:bigint,id:bigint>>, features array<string>"
WINDOW = "model_name string, at bigint, id bigint, features string"


def _newest(last: int):
    """Keeps the ``last`` newest rows of a model as its state, and returns them.

    A model's new rows come in parts; only so many rows are held at a time, whatever the model's
    share of the log is.
    """
    def place(row: tuple) -> tuple:
        return tuple((x is not None, x if x is not None else 0) for x in row[:2])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = []
        if state.exists:
            places, features = state.get
            held = [(p["at"], p["id"], f) for p, f in zip(places, features)]
        for part in parts:
            columns = [[None if pd.isna(x) else int(x) for x in part[c]] for c in ("at", "id")]
            held = heapq.nlargest(last, held + list(zip(*columns, part["features"])), key=place)
        state.update(([{"at": a, "id": i} for a, i, _ in held], [f for _, _, f in held]))
        out = pd.DataFrame(held, columns=["at", "id", "features"], dtype=object)
        out.insert(0, "model_name", key[0])
        yield out

    return run


def windows(log: DataFrame, last: int = LAST) -> DataFrame:
    """From a streamed log, the newest ``last`` rows of every model that got rows."""
    # Numbers travel as text: JSON keeps NaN apart from null that way.
    rows = log.select("model_name", F.unix_micros("timestamp").alias("at"), "id",
                      F.to_json(F.transform_values("features", lambda _, v: v.cast("string")))
                      .alias("features"))
    return rows.groupBy("model_name").applyInPandasWithState(
        _newest(last), WINDOW, STATE, "update", GroupStateTimeout.NoTimeout)


def stream_drift(spark: SparkSession, log: str, reports: str, checkpoint: str, last: int = LAST,
                 method: str = "exact", max_files: int | None = None) -> StreamingQuery:
    """Bring the reports of all models up to date with the log at ``log``, then stop.

    The state is the window of every model, so a micro-batch reads new files only. The table at
    ``reports`` holds one report per model, in a partition of its own; the reports of the models of
    a micro-batch are replaced, also when it is repeated after a failure.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        features = F.transform_values(F.from_json("features", "map<string,string>"),
                                      lambda _, v: v.try_cast("double"))
        window = batch.select("model_name", F.timestamp_micros("at").alias("timestamp"), "id",
                              features.alias("features"))
        report = drift_report(window, method=method, last=last, order=ORDER)
        overwrite_touched(report.withColumn("epoch", F.lit(epoch)), reports, ["model_name"])

    reader = spark.readStream.schema(PREDICTION_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (windows(reader.parquet(log), last).writeStream.outputMode("update")
            .foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
