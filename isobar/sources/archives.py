"""Zip archives of CSV files, read by several tasks per archive."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_PER_BATCH = 50_000
# Tasks of an archive, if its members come to less than so many compressed bytes a task.
TASKS, TASK_BYTES = 16, 8 << 20


def placed(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path, of any kind that Arrow reaches, and the name in it."""
    plain = path[len("file:"):] if path.startswith("file:") and "://" not in path else path
    return pyarrow.fs.FileSystem.from_uri(plain)


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    store, name = placed(path)
    return store.open_input_file(name)


def tables(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """The CSV members in the order of the directory."""
    return [m for m in archive.infolist() if m.filename.lower().endswith(".csv")]


@dataclass
class Members(InputPartition):
    archive: str
    first: int
    until: int


class ZippedCsvReader(DataSourceReader):
    """Plans from the central directories; a task inflates its members as streams, in batches.

    Of an archive with more than ``TASKS`` members, neighbours are read together, so that the directory
    is not read once per member and small members need no task each.
    """

    def __init__(self, schema: T.StructType, archives: list[str], encoding: str):
        self.schema, self.archives, self.encoding = schema, archives, encoding

    def partitions(self) -> list[Members]:
        found = []
        for path in self.archives:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                sizes = [m.compress_size for m in tables(archive)]
            if not sizes:
                raise ValueError(f"no CSV in {path}")
            first, size = 0, 0
            most = 0 if len(sizes) <= TASKS else min(TASK_BYTES, -(-sum(sizes) // TASKS))
            for no, own in enumerate(sizes):
                if no > first and size + own > most:
                    found.append((size, path, first, no))
                    first, size = no, 0
                size += own
            found.append((size, path, first, len(sizes)))
        return [Members(*x) for _, *x in sorted(found, reverse=True)]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        with opened(partition.archive) as file, zipfile.ZipFile(file) as archive:
            for info in tables(archive)[partition.first:partition.until]:
                with archive.open(info) as member:
                    yield from self.batches(member, schema)

    def batches(self, member: zipfile.ZipExtFile, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        try:
            parts = pd.read_csv(member, dtype=str, encoding=self.encoding, chunksize=ROWS_PER_BATCH)
        except pd.errors.EmptyDataError:
            return
        for part in parts:
            text = part.reindex(columns=self.schema.names).astype(object)
            text = text.where(text.notna(), None)
            yield pa.RecordBatch.from_pandas(text, schema=schema, preserve_index=False)


class ZippedCsv(DataSource):
    """``format("zipped_csv")``: option ``path`` (archives, one per line) and ``encoding``.

    All columns of the schema are text and matched by name; one that a member lacks is NULL there.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: T.StructType) -> ZippedCsvReader:
        if any(not isinstance(f.dataType, T.StringType) for f in schema.fields):
            raise ValueError("columns of zipped CSV files are text")
        return ZippedCsvReader(schema, self.options["path"].split("\n"),
                               self.options.get("encoding", "UTF-8"))


def read_zipped_csv(spark: SparkSession, path: str, schema: T.StructType,
                    encoding: str = "UTF-8") -> DataFrame:
    """All CSV members of the archives that match ``path``, as text columns."""
    archives = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    if not archives:
        raise ValueError(f"no archive at {path}")
    spark.dataSource.register(ZippedCsv)
    return (spark.read.format("zipped_csv").schema(schema).option("path", "\n".join(archives))
            .option("encoding", encoding).load())


def write_zipped_csv(df: DataFrame, folder: str, encoding: str = "UTF-8",
                     rows_per_member: int = 1_000_000) -> int:
    """One archive per partition, with a CSV member per ``rows_per_member`` rows; returns their number.

    An archive is named after its partition, so a task that is repeated replaces its own.
    """
    store, name = placed(folder)
    store.create_dir(name)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        store, name = placed(folder)
        with store.open_output_stream(f"{name}/part-{no:05d}.zip") as out, \
                zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            rows, number, member = 0, 0, None
            for batch in batches:
                for at in range(0, batch.num_rows, rows_per_member):
                    part = batch.slice(at, rows_per_member).to_pandas()
                    fresh = member is None or rows + len(part) > rows_per_member
                    if fresh:
                        if member is not None:
                            member.close()
                        member = archive.open(f"m{number:05d}.csv", "w")
                        rows = 0
                        number += 1
                    rows += len(part)
                    member.write(part.to_csv(index=False, header=fresh, columns=columns)
                                 .encode(encoding))
            if member is not None:
                member.close()
        yield pa.RecordBatch.from_arrays([pa.array([no])], ["no"])

    return df.mapInArrow(run, "no bigint").count()
