"""Readers for landed station and track files."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.functions.columns import normalise_nulls, project_available, to_number, to_time
from isobar.schemas import DAILY_VARIABLES, STATION, TRACK_COLUMNS, TRACKS
from isobar.sources.archives import read_zipped_csv

CORRUPT = "_corrupt_record"
# Columns of a processed table that are no numbers.
TEXT_COLUMNS = ("city", "state", "zone")


def _typed(col_name: str, kind: T.DataType):
    col = F.col(col_name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return to_number(col).cast(kind).alias(col_name)
    if isinstance(kind, T.TimestampType):
        return to_time(col).alias(col_name)
    return col.try_cast(kind).alias(col_name)


def header_groups(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The given paths, or their files by header line if these differ.

    Spark applies one header to all files of a read, by position. The first lines are found by tasks:
    the first row of a file in the partition that holds its start. Only the distinct headers come to
    the driver; files are named one by one only if there are several. Empty files have no header
    and are left out then.
    """
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), "value").where(
        F.col("_metadata.file_block_start") == 0)
    first = lines.groupBy("file").agg(F.first("value").alias("header"))
    headers = first.select("header").distinct()
    if headers.limit(2).count() < 2:
        return [list(paths)]
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # Paths of the metadata are encoded as URIs.
    return [[unquote(f) for f in r["files"]] for r in grouped.orderBy("header").collect()]


def read_text_csv(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8",
                  keep_corrupt: bool = False, landed_at: str | None = None) -> DataFrame:
    """CSV files with a header, every column as text, matched by name.

    Files with different headers are read apart and joined by column name; a column that some
    files lack is NULL there. With ``keep_corrupt`` lines with a wrong number of fields keep their
    text in ``_corrupt_record``. ``landed_at`` names a column for the time a file was written.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("mode", "PERMISSIVE"))

    def read(group: Sequence[str]) -> DataFrame:
        out = reader.csv(list(group))
        if keep_corrupt:
            schema = T.StructType([T.StructField(c, T.StringType())
                                   for c in [*out.columns, CORRUPT]])
            out = (spark.read.option("header", True).option("encoding", encoding)
                   .option("mode", "PERMISSIVE").schema(schema)
                   .option("columnNameOfCorruptRecord", CORRUPT).csv(list(group)))
        if landed_at:
            out = out.withColumn(landed_at, F.col("_metadata.file_modification_time"))
        return out

    return union_by_name([read(group) for group in header_groups(spark, paths)])


def read_station_csv(spark: SparkSession, path: str | Sequence[str],
                     schema: T.StructType = STATION, encoding: str = "UTF-8",
                     landed_at: str | None = None) -> tuple[DataFrame, list[str]]:
    """Raw station columns by name with their declared types, and the names the files lack.

    ``path`` may be a glob or a list. A value that does not parse becomes NULL; there is no
    pass over the data to infer types. ``landed_at`` adds the time a file was written.
    """
    text = read_text_csv(spark, path, encoding, landed_at=landed_at)
    available, missing = project_available(text, schema.names)
    typed = [_typed(c, schema[c].dataType) for c in available.columns]
    return text.select(*typed, *([landed_at] if landed_at else [])), missing


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column some frames lack is NULL there."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def read_tracks_csv(spark: SparkSession, path: str | Sequence[str],
                    encoding: str = "ISO-8859-1") -> DataFrame:
    """Track archive as text columns; ``prepare_tracks(dated_only=True)`` drops the units line."""
    return project_available(read_text_csv(spark, path, encoding), TRACK_COLUMNS)[0]


def read_tracks_zip(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """All track CSVs inside zip archives, by column name, one member per task, in batches."""
    return read_zipped_csv(spark, path, TRACKS, encoding)


def parse_daily_json(df: DataFrame, json_col: str = "value",
                     variables: Sequence[str] = DAILY_VARIABLES) -> DataFrame:
    """Station responses with one array per variable as one row per day.

    A response is ``{"city", "latitude", "longitude", "start", "end", "interval", "daily": {name:
    [values]}}`` with epoch seconds; the time grid is half-open. A variable that is missing or
    too short gives NULLs.
    """
    schema = ("city string, latitude double, longitude double, start long, end long, "
              "interval long, daily map<string,array<double>>")
    parsed = df.select(F.from_json(json_col, schema).alias("r")).select("r.*")
    last = F.col("end") - F.col("interval")
    grid = F.when(F.col("start") <= last, F.sequence("start", last, "interval"))
    days = parsed.select("city", "latitude", "longitude", "daily",
                         F.posexplode(grid).alias("pos", "epoch"))
    values = [F.get(F.try_element_at("daily", F.lit(v)), F.col("pos")).alias(v) for v in variables]
    return normalise_nulls(days.select(
        "city", F.timestamp_seconds("epoch").alias("time"), "latitude", "longitude", *values))


def read_processed_or_raw(spark: SparkSession, processed: str | None, raw: str,
                          dimension: DataFrame) -> DataFrame:
    """The processed CSV if there is one, with zones looked up where absent; else the raw files
    with short-named copies of their columns."""
    from isobar.schemas import SHORT_NAMES
    from isobar.sources.sinks import path_exists

    if processed is not None and path_exists(spark, processed):
        table = read_text_csv(spark, processed)
        kinds = {"time": to_time} | {c: to_number for c in table.columns
                                     if c not in TEXT_COLUMNS and c != "time"}
        table = table.withColumns({c: f(F.col(c)) for c, f in kinds.items() if c in table.columns})
        if "city" in table.columns and "zone" not in table.columns:
            table = table.join(dimension.select("city", "zone"), "city", "left")
        return table
    table, _ = read_station_csv(spark, raw)
    wanted = ("temp_max", "temp_min", "temp_mean", "precipitation")
    copies = {new: F.col(old) for old, new in SHORT_NAMES.items()
              if new in wanted and old in table.columns and new not in table.columns}
    return table.withColumns(copies)
