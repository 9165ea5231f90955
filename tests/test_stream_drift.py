"""Reports of the streamed log against the report over the whole log, micro-batch by micro-batch."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from isobar.operators.drift import drift_report
from isobar.schemas import PREDICTION_LOG
from isobar.streaming.drift import ORDER, stream_drift


def logged(rng, model, first, n, shift=0.0):
    out = []
    for k in range(n):
        at = None if k == 3 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=first + k)
        values = {"a": rng.gauss(shift, 1), "b": rng.choice([None, float("nan"), 1.0, 2.0]),
                  "c": rng.uniform(0, 1)}
        out.append((first + k, model, at, None if k % 17 == 5 else values, "x"))
    return out


def told(reports):
    return sorted((tuple(str(r[c]) for c in ("model_name", "samples", "status", "message",
                                             "total_features", "drifted_features", "alert",
                                             "drift_score", "features")) for r in reports))


@pytest.mark.parametrize("last", [60, 500])
def test_reports_follow_the_log(spark, tmp_path, last):
    rng = random.Random(last)
    log, reports, checkpoint = (str(tmp_path / x) for x in ("log", "reports", "checkpoint"))
    batches = [logged(rng, "heat", 0, 90) + logged(rng, "rain", 0, 12),
               logged(rng, "heat", 90, 300, 3.0),
               logged(rng, "rain", 12, 40) + logged(rng, None, 0, 30),
               logged(rng, "heat", 20, 25, 9.0)]  # late rows, older than the window's newest
    for batch in batches:
        spark.createDataFrame(batch, PREDICTION_LOG).coalesce(1).write.mode("append").parquet(log)
        stream_drift(spark, log, reports, checkpoint, last).awaitTermination()  # starts anew each time
        want = drift_report(spark.read.schema(PREDICTION_LOG).parquet(log), last=last, order=ORDER)
        assert told(spark.read.parquet(reports).collect()) == told(want.collect())
    before = told(spark.read.parquet(reports).collect())
    stream_drift(spark, log, reports, checkpoint, last).awaitTermination()  # nothing new
    assert told(spark.read.parquet(reports).collect()) == before


def test_reports_of_the_query_do_not_grow_with_the_files(spark, monkeypatch, tmp_path):
    from isobar.plans import queries

    made, plain = [], queries.stream_drift

    def counted(*args, **kwargs):
        query = plain(*args, **kwargs)
        query.awaitTermination()
        made.append(sum(p["numInputRows"] > 0 for p in query.recentProgress))
        return query

    for no in range(4):
        spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(f"event_id % 4 = {no}") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "stream_drift", counted)
    monkeypatch.setattr(queries.sinks, "append", lambda df, path: df.repartition(4).write.mode(
        "append").parquet(path))
    got = queries.QUERIES["drift_report_stream"](spark, str(tmp_path))
    assert made == [1, 1, 1]
    want = queries.QUERIES["drift_report"](spark, str(tmp_path))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
