"""Queries over archives and delimited files. The files are made from table rows, so that SQL can say what is in
them, and are of a bounded size, so that no group of rows grows with a table."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant import sql
from foliant.functions import content, pages
from foliant.operators import profile
from foliant.sources import delimited, files
from foliant.sources.tables import shared_folder, table


#: Rows that a file is made from, at most.
CUSTOMERS, TURNS = 10_000, 200
#: Rows whose files a task makes, about, and files that are made at once.
TASK_ROWS, AT_ONCE = 20_000, 16
#: The files' names in SQL.
NATION_FILE = f"(c_nationkey || '-' || (c_custkey // {CUSTOMERS}))"
TURN_FILE = f"(conv_id || '-' || (turn // {TURNS}))"


def by_file(rows: DataFrame, file: Column) -> DataFrame:
    """rows with the name of their file, dealt by it to as many tasks as the rows ask for: those of a file are small, so
    that an adaptive plan would leave all the making and reading of files to a few tasks."""
    return rows.withColumn("file", file).repartition(max(1, -(-rows.count() // TASK_ROWS)), "file")


def by_turns(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """(file, turns): the turns of conversations, at most TURNS in a file."""
    rows = by_file(table(spark, sf, "conversations"), F.concat_ws("-", "conv_id", F.floor(F.col("turn") / TURNS).cast("string")))
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("turn", *columns))).alias("turns"))


def some_at_once(batches):
    """Batches of AT_ONCE rows at most."""
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def packed(batches):
    """(file, content): an archive of turns."""
    for batch in some_at_once(batches):
        out = []
        for turns in batch.column(1).to_pylist():
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
                for t in turns:
                    archive.writestr(zipfile.ZipInfo(f"turn-{t['turn']}.txt", (2024, 1, 2, 3, 4, 6)), (t["text"] or "").encode())
            out.append(raw.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["file", "content"])


def zip_inspect(spark: SparkSession, sf: str) -> DataFrame:
    archives = by_turns(spark, sf, "text").mapInArrow(packed, "file string, content binary")
    rows = files.contents(archives, "zip", "file").where("problem IS NULL")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("size"), F.min("modified").alias("modified"), F.max("entry").alias("last_entry"))


ZIP_INSPECT = f"""SELECT {TURN_FILE} AS file, count(*) AS entries, sum(octet_length(encode(text)))::BIGINT AS size, '2024-01-02T03:04:06' AS modified, max('turn-' || turn || '.txt') AS last_entry FROM conversations GROUP BY 1"""


def _csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """(file, content): customers of a nation, with quotes, delimiters and line ends in cells. Nations differ in their
    head: two columns of one name, none at all, a short row, other line ends, or nothing in particular."""
    note = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('\"a;', char(10), '\"\"b\"') WHEN 1 THEN 'plain' ELSE '' END")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment", note)
    name = F.concat_ws("-", "c_nationkey", F.floor(F.col("c_custkey") / CUSTOMERS).cast("string")).alias("file")
    c = table(spark, sf, "customer").select(name, (F.col("c_nationkey") % 5).alias("kind"), "c_custkey", line.alias("l"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "l"))), lambda x: x["l"]), "\n")
    head = F.expr("CASE kind WHEN 0 THEN 'id;segment;Segment\n' WHEN 1 THEN '' WHEN 2 THEN 'id;segment;note\n7;x\n' WHEN 3 THEN 'id;segment;note\r\n' ELSE 'id;segment;note\n' END")
    mark = F.when(F.col("kind") == 4, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    return c.groupBy("file", "kind").agg(rows.alias("body")).select("file", F.concat(mark, F.concat(head, "body").cast("binary")).alias("content"))


def csv_inspect(spark: SparkSession, sf: str) -> DataFrame:
    made = _csv_files(spark, sf)
    told = profile.inspection(made, files.contents(made, "csv", "file"), "file")
    found = F.array_join(F.transform("issues", lambda i: F.concat(i["check"], F.lit(":"), i["severity"])), " ")
    return told.select("file", "row_count", "data_row_count", "column_count", "ragged_rows", "first_ragged", "delimiter", "has_header", "has_bom", "line_ending", F.array_join("headers", ",").alias("headers"), found.alias("issues"))


CSV_INSPECT = f"""
WITH c AS (SELECT {NATION_FILE} AS file, c_nationkey % 5 AS kind, c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_nationkey, c_custkey // {CUSTOMERS}) AS n FROM customer),
f AS (SELECT file, kind, n, arg_min(c_custkey, c_custkey) AS first_key, max((c_custkey % 3 = 0)::INT) AS broken FROM c GROUP BY ALL)
SELECT file, n + (CASE kind WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END) AS row_count, n + (kind = 2)::INT AS data_row_count, 3::INT AS column_count, (kind = 2)::BIGINT AS ragged_rows,
  CASE WHEN kind = 2 THEN 2::INT END AS first_ragged, ';' AS delimiter, kind <> 1 AS has_header, kind = 4 AS has_bom,
  CASE WHEN kind = 3 AND (n > 1 OR broken = 1) THEN 'mixed' WHEN kind = 3 THEN 'crlf' WHEN kind = 1 AND n = 1 AND broken = 0 THEN 'none' ELSE 'lf' END AS line_ending,
  CASE kind WHEN 0 THEN 'id,segment,Segment' WHEN 1 THEN 'column1,column2,column3' ELSE 'id,segment,note' END AS headers,
  CASE WHEN kind = 0 THEN 'header:warning' WHEN kind = 1 THEN 'header:info' WHEN kind = 2 THEN 'ragged_rows:error' WHEN kind = 3 AND (n > 1 OR broken = 1) THEN 'line_endings:warning' ELSE '' END AS issues FROM f"""


def csv_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of every file."""
    told = profile.profile_files(files.contents(_csv_files(spark, sf), "csv", "file"), "file", 3)
    return told.select("file", "position", "name", "non_empty", "empty", "distinct_count", "inferred_type", "min_value", "max_value", F.array_join("samples", ",").alias("samples"))


CSV_PROFILE = f"""
WITH c AS (SELECT {NATION_FILE} AS file, c_nationkey % 5 AS kind, c_custkey AS k, c_mktsegment AS s, CASE c_custkey % 3 WHEN 0 THEN 'a;' || chr(10) || '"b' WHEN 1 THEN 'plain' ELSE '' END AS note FROM customer),
r AS (SELECT file, kind, k, s, note FROM c UNION ALL SELECT DISTINCT file, kind, -7, 'x', '' FROM c WHERE kind = 2),
v AS (SELECT file, kind, k, 0 AS position, abs(k)::VARCHAR AS value FROM r UNION ALL SELECT file, kind, k, 1, s FROM r UNION ALL SELECT file, kind, k, 2, note FROM r)
SELECT file, position::INT AS position, CASE WHEN kind = 1 THEN 'column' || (position + 1) WHEN position = 0 THEN 'id' WHEN position = 1 THEN 'segment' WHEN kind = 0 THEN 'Segment' ELSE 'note' END AS name,
  count(*) FILTER (value <> '') AS non_empty, count(*) FILTER (value = '') AS empty, least(count(DISTINCT value) FILTER (value <> ''), 10000) AS distinct_count,
  CASE WHEN max(value) = '' THEN 'empty' WHEN position = 0 THEN 'integer' ELSE 'string' END AS inferred_type,
  CASE WHEN position = 0 THEN min(try_cast(value AS BIGINT))::VARCHAR ELSE (min(length(value)) FILTER (value <> ''))::VARCHAR END AS min_value,
  CASE WHEN position = 0 THEN max(try_cast(value AS BIGINT))::VARCHAR ELSE (max(length(value)) FILTER (value <> ''))::VARCHAR END AS max_value,
  coalesce(array_to_string(list(value ORDER BY k) FILTER (value <> '')[1:3], ','), '') AS samples
FROM v GROUP BY file, kind, position"""


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first three rows of every file, and what stands for an empty one."""
    made = _csv_files(spark, sf).union(spark.createDataFrame([("none", bytearray())], "file string, content binary"))
    rows = profile.data_rows(files.contents(made, "csv", "file"), 3, "file")
    return rows.select("file", "row", F.size("cells").alias("width"), F.element_at("cells", 1).alias("first"), F.col("problem.status").alias("status"))


CSV_ROWS = f"""
WITH c AS (SELECT {NATION_FILE} AS file, c_nationkey % 5 AS kind, c_custkey AS k FROM customer),
r AS (SELECT file, kind, k, 3 AS width FROM c UNION ALL SELECT DISTINCT file, kind, -7, 2 FROM c WHERE kind = 2),
n AS (SELECT file, (row_number() OVER (PARTITION BY file ORDER BY k) - 1)::INT AS row, width, abs(k)::VARCHAR AS first FROM r)
SELECT file, row, width::INT AS width, first, NULL::INT AS status FROM n WHERE row < 3 UNION ALL SELECT 'none', NULL, NULL, NULL, 422"""


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of documents written as delimited files, with quotes and line ends in cells, and read back by byte ranges."""
    folder = shared_folder(spark)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "n_chars")] + [quoted(F.col(c)) for c in ("lang", "source", "text")]
    table(spark, sf, "documents").select(F.concat_ws(",", *cells)).write.text(f"{folder}/documents")
    return delimited.read_delimited(spark, f"{folder}/documents", glob="part-*").rows.where("problem IS NULL")


def csv_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as its file's row gives it."""
    cell = lambda n: F.element_at("cells", n)
    return _exported(spark, sf).select(cell(1).cast("long").alias("doc_id"), F.size("cells").alias("width"), cell(3).alias("lang"), F.sha2(cell(5).cast("binary"), 256).alias("sha256"))


CSV_RANGES = "SELECT doc_id, 5::INT AS width, coalesce(lang, '') AS lang, sha256(coalesce(text, '')) AS sha256 FROM documents"


def csv_ranges_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of all files together."""
    cells = _exported(spark, sf).select(F.posexplode("cells").alias("position", "value"))
    told = profile.profile(cells.select("position", F.concat(F.lit("column"), (F.col("position") + 1).cast("string")).alias("name"), "value"))
    return told.select("position", "non_empty", "empty", "distinct_count", "inferred_type", "min_value", "max_value")


CSV_RANGES_PROFILE = """
WITH v AS (SELECT 0 AS position, doc_id::VARCHAR AS value, doc_id AS n FROM documents UNION ALL SELECT 1, n_chars::VARCHAR, n_chars FROM documents
  UNION ALL SELECT 2, lang, NULL FROM documents UNION ALL SELECT 3, source, NULL FROM documents UNION ALL SELECT 4, text, NULL FROM documents)
SELECT position::INT AS position, count(*) FILTER (trim(value) <> '') AS non_empty, count(*) FILTER (trim(coalesce(value, '')) = '') AS empty, least(count(DISTINCT value) FILTER (trim(value) <> ''), 10000) AS distinct_count,
  CASE WHEN position < 2 THEN 'integer' ELSE 'string' END AS inferred_type, CASE WHEN position < 2 THEN min(n) ELSE min(length(value)) FILTER (trim(value) <> '') END::VARCHAR AS min_value,
  CASE WHEN position < 2 THEN max(n) ELSE max(length(value)) FILTER (trim(value) <> '') END::VARCHAR AS max_value FROM v GROUP BY position"""


def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files in a folder for each language, scanned with all folders below and read as text; the
    names, endings and sizes are those that the scan tells."""
    folder = shared_folder(spark)
    table(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").option("lineSep", "\x1e").text(f"{folder}/texts")
    found = files.scan(spark, f"{folder}/texts", glob="part-*").where("problem IS NULL")
    lang = F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")
    told = found.groupBy(lang, "ext").agg(F.sum("length").alias("bytes"), F.sum(F.length(files.decode(F.col("content")))).alias("chars"), F.bool_and(F.startswith("file_name", F.lit("part-"))).alias("named"))
    over = files.scan(spark, f"{folder}/texts", most_bytes=1, glob="part-*").groupBy(lang).agg(F.max("problem.status").alias("over"), F.count("content").alias("read"))
    return told.join(over, "lang").select("lang", "ext", "bytes", "chars", "named", "over", "read")


FILE_SCAN = """
SELECT coalesce(lang, 'none') AS lang, 'txt' AS ext, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, sum(length(coalesce(text, '')) + 1)::BIGINT AS chars, true AS named, 413::INT AS over, 0::BIGINT AS read
FROM documents GROUP BY 1"""


def chunk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into chunks and put together again."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    cut = d.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("raw") / 1000).cast("int"))).alias("seq"))
    cut = cut.select("doc_id", "seq", F.substring("raw", F.col("seq") * 1000 + 1, F.lit(1000)).alias("data"))
    return files.reassemble(cut, "doc_id").select("doc_id", F.sha2("content", 256).alias("sha256"))


CHUNK_STREAM = "SELECT doc_id, sha256(text) AS sha256 FROM documents"

#: Documents of a call, and bytes of a chunk.
CALL, CHUNK = 100, 4_000


def chunk_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of calls, in chunks that come in three batches and out of order. Files of even numbers say where
    they end, others end where the next one begins, and the last of a call may never end."""
    from foliant.streaming import state

    folder = shared_folder(spark)
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    pieces = F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("raw") / CHUNK).cast("int") - 1, F.lit(0)))).alias("k", "_")
    cut = d.select("doc_id", "raw", F.greatest(F.ceil(F.octet_length("raw") / CHUNK), F.lit(1)).alias("n"), pieces)
    call = F.floor(F.col("doc_id") / CALL)
    seq = F.row_number().over(Window.partitionBy(call).orderBy("doc_id", "k")) - 1
    rows = cut.select(
        call.alias("call_id"), seq.cast("long").alias("seq"), F.col("doc_id").cast("string").alias("name"), F.substring("raw", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("data"),
        ((F.col("doc_id") % 2 == 0) & (F.col("k") == F.col("n") - 1)).alias("last"),
    )
    end = spark.range(1).selectExpr("-1L AS call_id", "0L AS seq", "'end' AS name", "CAST('' AS binary) AS data", "true AS last", "TIMESTAMP '2100-01-01 00:00:00' AS ts")
    kept = rows.withColumns({"ts": F.lit("2024-01-01 00:00:00").cast("timestamp"), "batch": F.pmod(F.xxhash64("call_id", "seq"), F.lit(3))})
    kept.write.partitionBy("batch").parquet(f"{folder}/chunks")
    kept = spark.read.schema(kept.schema).parquet(f"{folder}/chunks")
    schema = end.schema
    for batch in (*[kept.where(F.col("batch") == k).drop("batch") for k in range(3)], end):
        batch.write.mode("append").parquet(f"{folder}/in")
        done = state.chunk_files(spark.readStream.schema(schema).parquet(f"{folder}/in"), "1 hour")
        where = state.written(done, folder)
    files_ = spark.read.schema(done.schema).parquet(where).where("call_id >= 0")
    return files_.select(F.col("name").cast("long").alias("doc_id"), F.sha2("content", 256).alias("sha256"), F.col("problem.status").alias("status"))


CHUNK_ISLANDS = f"""
WITH d AS (SELECT doc_id, text, doc_id % 2 = 1 AND doc_id = max(doc_id) OVER (PARTITION BY doc_id // {CALL}) AS open FROM documents)
SELECT doc_id, CASE WHEN NOT open THEN sha256(coalesce(text, '')) END AS sha256, CASE WHEN open THEN 408::INT END AS status FROM d"""


def sql_archive(spark: SparkSession, sf: str) -> DataFrame:
    """In SQL: the second turn of each conversation's archive, by a table function that reads the entry asked for."""
    sql.register(spark)
    archives = by_turns(spark, sf, "text").mapInArrow(packed, "file string, content binary")
    return spark.sql("SELECT a.file, e.entry, e.size FROM {archives} a, LATERAL archive_entries(a.content, 'turn-1.txt') e WHERE e.problem IS NULL", archives=archives)


SQL_ARCHIVE = f"SELECT {TURN_FILE} AS file, 'turn-' || turn || '.txt' AS entry, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE turn = 1"


def sql_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """In SQL: the cells of delimited files, summed up by what they look like."""
    sql.register(spark)
    made = _csv_files(spark, sf)
    return spark.sql(
        """SELECT file, count(*) AS lines, sum(CAST(is_integer(cells[0]) AS INT)) AS numbered, count_if(size(cells) <> 3) AS ragged
        FROM (SELECT f.file, l.* FROM {files} f, LATERAL csv_lines(f.content) l) GROUP BY file""",
        files=made,
    )


SQL_CSV_LINES = f"""
WITH c AS (SELECT {NATION_FILE} AS file, c_nationkey % 5 AS kind, count(*) AS n FROM customer GROUP BY ALL)
SELECT file, n + (CASE kind WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END) AS lines, n + (kind = 2)::INT AS numbered, (kind = 2)::BIGINT AS ragged FROM c"""


def data_uris(spark: SparkSession, sf: str) -> DataFrame:
    png = F.concat(F.unhex(F.lit("89504E47")), F.col("c_name").cast("binary"))
    raw = F.when(F.col("c_custkey") % 2 == 0, png).otherwise(F.col("c_name").cast("binary"))
    return table(spark, sf, "customer").select("c_custkey", content.data_uri(raw).alias("uri"))


DATA_URIS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'data:image/png;base64,' || base64(from_hex('89504E47' || hex(c_name))) ELSE 'data:application/octet-stream;base64,' || base64(encode(c_name)) END AS uri FROM customer"""


def page_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations split into parts, joined again with a blank one between."""
    turns = by_turns(spark, sf, "role")
    p = F.transform("turns", lambda x: x["role"])
    parts = pages.split(p, F.lit("1; 1-2"))
    flat = lambda a: F.array_join(a, ",")
    return turns.select("file", F.array_join(F.transform(parts, flat), ";").alias("parts"), flat(pages.merge(p, p)).alias("merged"), flat(pages.insert_blank(p, F.lit(1), 2)).alias("blanks"))


PAGE_SPLITS = f"""
WITH t AS (SELECT {TURN_FILE} AS file, list(role ORDER BY turn) AS p FROM conversations GROUP BY 1)
SELECT file, CASE WHEN len(p) >= 2 THEN p[1] || ';' || p[1] || ',' || p[2] END AS parts, array_to_string(list_concat(p, p), ',') AS merged, ',,' || array_to_string(p, ',') AS blanks FROM t"""

QUERIES = {f.__name__: (f, sql) for f, sql in ((zip_inspect, ZIP_INSPECT), (csv_inspect, CSV_INSPECT), (csv_profile, CSV_PROFILE), (csv_rows, CSV_ROWS), (csv_ranges, CSV_RANGES), (csv_ranges_profile, CSV_RANGES_PROFILE), (file_scan, FILE_SCAN), (chunk_stream, CHUNK_STREAM), (chunk_islands, CHUNK_ISLANDS), (sql_archive, SQL_ARCHIVE), (sql_csv_lines, SQL_CSV_LINES), (data_uris, DATA_URIS), (page_splits, PAGE_SPLITS))}
