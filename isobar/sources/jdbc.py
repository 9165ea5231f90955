"""Full-table pulls from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def page_options(url: str, table: str, column: str, lower: object, upper: object,
                 pages: int, fetch_size: int = 1000) -> dict[str, str]:
    """Options of a read split into ``pages`` ranges of ``column``, fetched 1000 rows at a time."""
    return {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(pages), "fetchsize": str(fetch_size)}


def read_table(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**page_options(**options)).load()
