"""Ingest of landed files as a stream that stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from isobar.plans.ingest import as_observations, split_keyed, upsert_into
from isobar.schemas import STATION
from isobar.session import materialize
from isobar.sources.files import read_station_csv
from isobar.sources.sinks import overwrite_touched


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_landed(spark: SparkSession, landed: str, table: str, checkpoint: str, quarantine: str,
                  schema: T.StructType = STATION,
                  max_files: int | None = None) -> StreamingQuery:
    """Upsert every landed CSV not seen before, then stop.

    The stream's checkpoint remembers which files were taken, in place of a hand-kept resume
    point; only their names are streamed, and a micro-batch reads its files by header like a
    batch. A micro-batch that is repeated after a failure merges the same keys again, which
    changes nothing. Rows without a complete key go to the quarantine table, in the partition of
    their micro-batch.
    """
    def merge(batch: DataFrame, epoch: int) -> None:
        names = [r["path"] for r in batch.select("path").collect()]
        if not names:
            return
        session = batch.sparkSession
        raw, _ = read_station_csv(session, names, schema, landed_at="_landed_at")
        stamped = as_observations(raw, f"stream-{epoch}", F.col("_landed_at"))
        good, bad = split_keyed(materialize(stamped, "landed"))
        overwrite_touched(bad, quarantine, ["batch_id"])
        upsert_into(session, table, good)

    reader = (spark.readStream.format("binaryFile").schema(FILES)
              .option("pathGlobFilter", "*.csv"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.load(landed).select("path")
    return (files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
