"""Shared column expressions and helpers of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.session import new_path

# The space and the control characters 9 to 13, as a regular expression.
WHITESPACE = r"[ \t\n\x0B\f\r]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once.

    Spark evaluates an expression again for every use inside a lambda; a lambda variable it does not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than the space and the control characters 9 to 13."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITESPACE), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, and shuffles that no plan holds.

    Spark removes the files of a shuffle once the driver has collected it as garbage, which may be
    long after the last job that reads it.
    """
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


# A table of up to this many narrow rows (some megabytes) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch of texts end to end, and where each starts and the last one ends."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:][:len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def beside(docs: DataFrame, text_col: str, keep: Sequence[str] | None = None,
           **more: Column) -> tuple[DataFrame, Callable[[pa.RecordBatch], pa.Array], str]:
    """Rows for an Arrow function: the kept columns in a struct ``doc``, the text, ``more``.

    A struct keeps the columns of the caller apart from the function's own, whatever their names.
    The text travels once: as a field of ``doc`` if it is kept, else as a column ``text``. Returns
    the rows, a function that finds the text in a batch, and the type of ``doc``.
    """
    keep = list(docs.columns if keep is None else keep)
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    own = [] if text_col in keep else [F.col(f"`{text_col}`").alias("text")]
    rows = docs.select(doc, *own, *[v.alias(k) for k, v in more.items()])
    at = keep.index(text_col) if text_col in keep else None

    def text_of(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("text") if at is None else batch.column("doc").field(at)

    return rows, text_of, rows.schema["doc"].dataType.simpleString()


def slices(texts: pa.Array, limit: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of rows, as (first, number), of at most ``limit`` bytes or of a single text."""
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(cuts.tolist(), np.diff(cuts, append=len(part)).tolist()))
