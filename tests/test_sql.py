"""The library in SQL, and the log of what operators read."""

import io
import zipfile

import pytest

from foliant import sql
from foliant.operators import runlog


@pytest.fixture(scope="module")
def files(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("b.txt", "three")
    sql.register(spark)
    rows = [("x.csv", bytearray(b'id;note\n1;"a\nb"\n')), ("y.zip", bytearray(raw.getvalue())), ("bad.zip", bytearray(b"no archive")), ("none", None)]
    spark.createDataFrame(rows, "path string, content binary").createOrReplaceTempView("files")


def test_table_functions(spark, files):
    got = spark.sql("SELECT l.line, l.delimiter, l.cells FROM (SELECT * FROM files WHERE path LIKE '%.csv') f, LATERAL csv_lines(f.content) l ORDER BY line").collect()
    assert [tuple(r) for r in got] == [(0, ";", ["id", "note"]), (1, ";", ["1", "a\nb"])]
    got = spark.sql("SELECT f.path, e.entry, e.size, e.problem.status FROM (SELECT * FROM files WHERE path LIKE '%.zip') f, LATERAL archive_entries(f.content) e ORDER BY ALL").collect()
    assert [tuple(r) for r in got] == [("bad.zip", None, None, 422), ("y.zip", "a.txt", 3, None), ("y.zip", "b.txt", 5, None)]
    assert [r.size for r in spark.sql("SELECT e.size FROM files f, LATERAL archive_entries(f.content, 'b.txt') e WHERE f.path = 'y.zip'").collect()] == [5]
    assert [r.status for r in spark.sql("SELECT l.problem.status FROM files f, LATERAL csv_lines(f.content) l WHERE f.path = 'none'").collect()] == [422]


def test_a_filter_below_the_lateral_join_reaches_the_scan(spark, files, tmp_path):
    spark.table("files").write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    got = spark.sql("SELECT l.* FROM (SELECT * FROM {stored} WHERE path = 'x.csv') f, LATERAL csv_lines(f.content) l", stored=stored)
    assert "EqualTo(path,x.csv)" in got._jdf.queryExecution().executedPlan().toString() and got.count() == 2


def test_functions_over_texts(spark, files):
    got = spark.sql(r"SELECT is_number('$1,200.5'), is_number('x'), is_integer(' 12 '), is_integer('1.5'), collapsed(' a \n\t b'), collapsed(NULL), share_secret('t', 'p')").first()
    assert tuple(got)[:6] == (True, False, True, False, " a b", "") and len(got[6]) == 64


def test_run_log_counts_what_was_written(spark, tmp_path):
    log = runlog.RunLog(spark)
    read = log.watch(spark.createDataFrame([("a",), ("bc",), (None,)], "t string"), "read", "t")
    log.write(read.where("t IS NOT NULL"), "kept", str(tmp_path / "kept"))
    log.write(spark.range(0), "none", str(tmp_path / "none"))
    got = log.records().collect()
    assert [(r.operator, r.rows, r.bytes) for r in got] == [("read", 3, 3), ("kept", 2, None), ("none", 0, None)] and all(r.elapsed_ms > 0 and r.started for r in got)
    with pytest.raises(Exception):  # the folder is there
        log.write(spark.range(1), "again", str(tmp_path / "kept"))
    assert len(log.seen) == 3
