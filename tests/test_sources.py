"""Archives and paged sources: all rows once, in several tasks, also after failures."""

from __future__ import annotations

import os
import zipfile

import pyarrow.parquet as pq
import pytest
from conftest import TINY
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isobar.sources.archives import ZippedCsvReader, read_zipped_csv, write_zipped_csv
from isobar.sources.files import header_groups, read_text_csv
from isobar.sources import paged
from isobar.sources.paged import PagedReader, Stride, read_pages

TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def test_members_are_partitions(spark, tmp_path):
    want = []
    for no in range(3):
        with zipfile.ZipFile(tmp_path / f"x{no}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            for k in range(4):
                head = ("b,a", "a,b", "a,z", "a,b")[k]
                rows = [f"{no}.{k}.{i},é{i}" for i in range(30 * k)]  # the first one is a bare header
                archive.writestr(f"deep/m{k}.CSV", "\n".join([head, *rows]).encode("latin-1"))
                for r in rows:
                    x, y = r.split(",")
                    want.append({"b,a": (y, x), "a,b": (x, y), "a,z": (x, None)}[head] + (None,))
            archive.writestr("empty.csv", b"")
            archive.writestr("note.txt", b"a,b\n1,2")
    df = read_zipped_csv(spark, str(tmp_path / "*.zip"), TEXT, "latin-1")
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    assert df.rdd.getNumPartitions() == 15


def test_archives_are_written_and_read(spark, tmp_path):
    rows = [(str(k), None if k % 7 == 0 else f"é,{k}", '"') for k in range(1_000)]
    df = spark.createDataFrame(rows, TEXT).repartition(3)
    write_zipped_csv(df, str(tmp_path / "out"), "latin-1", rows_per_member=150)
    got = read_zipped_csv(spark, str(tmp_path / "out"), TEXT, "latin-1")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    assert len(os.listdir(tmp_path / "out")) == 3 and got.rdd.getNumPartitions() == 9


def test_members_are_read_in_batches(tmp_path):
    path = str(tmp_path / "big.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.csv", "a\n" + "1\n" * 120_000)
    reader = ZippedCsvReader(TEXT, [path], "UTF-8")
    assert [b.num_rows for b in reader.read(reader.partitions()[0])] == [50_000, 50_000, 20_000]
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("note.txt", "")
    with pytest.raises(ValueError, match="no CSV"):
        reader.partitions()


@pytest.fixture
def orders():
    """Pages of the given table, as an endpoint would hand them out."""
    path = f"{TINY}/orders.parquet"

    def fetch(offset, limit):
        table = pq.read_table(path, columns=["o_orderkey", "o_custkey"])
        return [tuple(r.values()) for r in table.slice(offset, limit).to_pylist()]

    return fetch


@pytest.mark.parametrize("limit,tasks,offset", [(100, 4, 0), (1_500, 3, 0), (7_000, 5, 0),
                                                (125, 3, 700), (100, 2, 10 ** 6), (1, 1, 1_495)])
def test_pages_are_read_once(spark, orders, limit, tasks, offset):
    given = spark.read.parquet(f"{TINY}/orders.parquet").select("o_orderkey", "o_custkey")
    got = read_pages(spark, orders, given.schema, limit, offset, tasks)
    assert sorted(map(tuple, got.collect())) == sorted(orders(offset, 10 ** 9))


def test_failed_pages_are_asked_for_again(spark, orders, tmp_path):
    marks = str(tmp_path)

    def flaky(offset, limit):
        mark = os.path.join(marks, str(offset))
        if offset % 300 == 0 and not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("try again")
        return orders(offset, limit)

    got = read_pages(spark, flaky, "o_orderkey bigint, o_custkey bigint", 100, tasks=3)
    assert sorted(map(tuple, got.collect())) == sorted(orders(0, 10 ** 9))

    def broken(offset, limit):
        raise ConnectionError("never")

    with pytest.raises(ConnectionError):
        list(PagedReader(broken, 0, 10, 1, 2).read(Stride(0)))
    with pytest.raises(ValueError):
        read_pages(spark, orders, "a bigint", limit=0)


def test_headers_are_found_by_tasks(spark, tmp_path):
    for k in range(40):
        head = "a,b" if k % 2 else "b,a"
        (tmp_path / f"part {k}%.csv").write_text(f"{head}\n{k},{k + 100}\n" if k else "")
    groups = header_groups(spark, [str(tmp_path)])
    assert sorted(map(len, groups)) == [19, 20]
    got = read_text_csv(spark, str(tmp_path)).select(F.col("a").cast("int"), F.col("b").cast("int"))
    assert sorted(map(tuple, got.collect())) == sorted(
        (k, k + 100) if k % 2 else (k + 100, k) for k in range(1, 40))
    one = tmp_path / "one"
    one.mkdir()
    (one / "x.csv").write_text("a,b\n1,2\n")
    assert header_groups(spark, [str(one)]) == [[str(one)]]


def test_small_members_share_tasks_and_a_directory(spark, tmp_path):
    rows = [(str(k), None, "x") for k in range(600)]
    write_zipped_csv(spark.createDataFrame(rows, TEXT).repartition(1), str(tmp_path / "out"),
                     rows_per_member=5)
    got = read_zipped_csv(spark, str(tmp_path / "out"), TEXT)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert 8 <= got.rdd.getNumPartitions() <= 20  # 120 members


def test_a_page_reads_its_row_groups_only(tmp_path):
    import pyarrow as pa

    (tmp_path / "t").mkdir()
    for no, (lo, hi) in enumerate(((0, 1_000), (1_000, 1_000), (1_000, 2_500))):
        pq.write_table(pa.table({"a": range(lo, hi), "b": [str(k) for k in range(lo, hi)]}),
                       tmp_path / "t" / f"{no}.parquet", row_group_size=200)
    fetch, seen = paged.ParquetPages(str(tmp_path / "t"), ["b", "a"]), []
    plain = fetch.read
    fetch.read = lambda group: seen.append(group) or plain(group)
    pages = [fetch(at, 70) for at in range(0, 2_600, 70)]
    assert [r for page in pages for r in page] == [(str(k), k) for k in range(2_500)]
    assert len(pages[-3]) == 50 and pages[-1] == pages[-2] == [] and fetch(10 ** 6, 5) == []
    assert len(seen) == len(set(seen)) <= 14  # one of a file without rows
