"""Writers of Parquet and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.functions.columns import normalise_nulls
from isobar.operators.chunks import CHUNK, with_chunk


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_partitioned(df: DataFrame, path: str, entity: str = "city", time: str = "time",
                      unit: str = "year", mode: str = "overwrite") -> None:
    """Snappy Parquet partitioned by entity, rows of a file in time order.

    Rows are spread by (entity, chunk), so a large entity is written by several tasks.
    """
    spread = df if CHUNK in df.columns else with_chunk(df, entity, time, unit)
    (spread.sortWithinPartitions(entity, time).drop(CHUNK)
     .write.mode(mode).partitionBy(entity).parquet(path))


def overwrite_touched(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files, each with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    """Append rows to a log or ledger table."""
    df.write.mode("append").parquet(path)


def json_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as a JSON object: NaN and NULL as null, times in ISO form."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}
    return normalise_nulls(df).select(F.to_json(F.struct("*"), options).alias(out))
