"""Queries over rows and books: profiles, sinks, quotas, jobs, shares, formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import content, pages
from foliant.operators import books, profile, runlog, sinks
from foliant.sources.tables import shared_folder, table

# ---- profiles

PROFILED = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_orderstatus", "o_orderpriority", "order_day"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "ship_day", "sparse"),
}


def _profiled(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = table(spark, sf, name)
    if name == "orders":
        df = df.withColumn("order_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    if name == "lineitem":
        df = df.withColumns({"ship_day": F.date_format("l_shipdate", "yyyy-MM-dd"), "sparse": F.expr("CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'yes' ELSE '0' END ELSE ' ' END")})
    return df


def _profile_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return profile.profile(profile.cells(_profiled(spark, sf, name), *PROFILED[name]))

    run.__name__ = f"column_profile_{name}"
    return run


def _profile_sql(name: str) -> str:
    extra = {"orders": ", strftime(o_orderdate, '%Y-%m-%d') AS order_day", "lineitem": ", strftime(l_shipdate, '%Y-%m-%d') AS ship_day, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'yes' ELSE '0' END ELSE ' ' END AS sparse"}
    one = lambda i, c: f"""
SELECT {i}::INT AS position, '{c}' AS name, count(*) FILTER (trim(v) <> '') AS non_empty, count(*) FILTER (trim(v) = '') AS empty,
  least(count(DISTINCT v) FILTER (trim(v) <> ''), {profile.MOST_DISTINCT}) AS distinct_count,
  CASE WHEN count(*) FILTER (trim(v) <> '') = 0 THEN 'empty' WHEN bool_and(regexp_matches(v, '^[0-9]+$')) FILTER (trim(v) <> '') THEN 'integer'
    WHEN bool_and(v IN ('0', 'yes')) FILTER (trim(v) <> '') THEN 'boolean' WHEN bool_and(regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) FILTER (trim(v) <> '') THEN 'date' ELSE 'string' END AS inferred_type,
  min(try_cast(v AS BIGINT)) AS ln, max(try_cast(v AS BIGINT)) AS hn, min(v) FILTER (trim(v) <> '') AS ls, max(v) FILTER (trim(v) <> '') AS hs, min(length(v)) FILTER (trim(v) <> '') AS ll, max(length(v)) FILTER (trim(v) <> '') AS hl
FROM (SELECT {c}::VARCHAR AS v FROM t)"""  # noqa: E731
    parts = " UNION ALL ".join(one(i, c) for i, c in enumerate(PROFILED[name]))
    edge = lambda n, s, k: f"CASE inferred_type WHEN 'integer' THEN {n}::VARCHAR WHEN 'date' THEN {s} || 'T00:00:00' WHEN 'string' THEN {k}::VARCHAR END"
    return f"WITH t AS (SELECT *{extra.get(name, '')} FROM {name}) SELECT position, name, non_empty, empty, distinct_count, inferred_type, {edge('ln', 'ls', 'll')} AS min_value, {edge('hn', 'hs', 'hl')} AS max_value FROM ({parts})"


def header_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The words of every document's first line as a header."""
    rows = table(spark, sf, "documents").select("doc_id", F.split(F.regexp_extract("text", r"\A[^\n]*", 0), " ", -1).alias("c")).where("c IS NOT NULL")
    return rows.select("doc_id", profile.header_like(F.col("c")).alias("has_header"), F.array_join(profile.duplicate_headers(F.col("c")), ";").alias("duplicates"))


HEADER_CHECKS = f"""
WITH h AS (SELECT doc_id, string_split(regexp_extract(text, '^[^\n]*'), ' ') AS c FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, list_transform(c, lambda x: lower(x)) AS low FROM h)
SELECT doc_id, len(list_filter(c, lambda x: x = '' OR (regexp_matches(x, '{profile.NUMBER}') AND regexp_matches(x, '[0-9]')))) = 0 AS has_header,
  array_to_string(list_filter(c, lambda x, i: x <> '' AND list_position(low, lower(x)) = i AND len(list_filter(low, lambda y: y = lower(x))) > 1), ';') AS duplicates FROM l"""


def ragged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as a file of lines; every seventh order has a cell more."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr("IF(o_orderkey % 7 = 0, array(o_orderstatus, 'x', 'y'), array(o_orderstatus, 'x'))").alias("cells"))
    lines = o.withColumn("line", F.col("o_orderkey").cast("long"))
    return profile.inspect(lines.select("o_custkey", "line", "cells"), "o_custkey").select("o_custkey", "row_count", "column_count", "ragged_rows", "first_ragged", "has_header")


RAGGED_ROWS = """
WITH l AS (SELECT o_custkey, o_orderkey AS line, CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END AS w FROM orders),
f AS (SELECT o_custkey, arg_min(w, line) AS column_count FROM l GROUP BY 1)
SELECT o_custkey, count(*) AS row_count, any_value(column_count)::INT AS column_count, count(*) FILTER (w <> column_count) AS ragged_rows, min(line + 1) FILTER (w <> column_count) AS first_ragged, true AS has_header
FROM l JOIN f USING (o_custkey) GROUP BY 1"""


# ---- sinks


def markdown_table(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("n_name", F.concat(F.substring("n_name", 1, 3), F.lit("|\n"), F.substring("n_name", 4, 50)))
    return sinks.markdown_rows(n, "n_nationkey", "n_name", "n_regionkey").select("n_nationkey", "markdown")


MARKDOWN_TABLE = r"SELECT n_nationkey, '| ' || n_nationkey || ' | ' || substring(n_name, 1, 3) || '\| ' || substring(n_name, 4) || ' | ' || n_regionkey || ' |' AS markdown FROM nation"


def csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("note", F.expr("CASE p_size % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN concat('say ', char(34), 'x', char(34)) WHEN 2 THEN concat('two', char(10), 'lines') END"))
    return sinks.csv_rows(p, "p_partkey", "note", "p_brand").select("p_partkey", "csv")


CSV_ESCAPE = """SELECT p_partkey, p_partkey || ',' || CASE p_size % 4 WHEN 0 THEN '"a,b"' WHEN 1 THEN '"say ""x""' || chr(34) WHEN 2 THEN '"two' || chr(10) || 'lines"' ELSE '' END || ',' || p_brand AS csv FROM part"""


def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_rows(table(spark, sf, "region"), "r_regionkey", "r_name").select("r_regionkey", "json")


JSON_ROWS = """SELECT r_regionkey, '{"r_regionkey":"' || r_regionkey || '","r_name":"' || r_name || '"}' AS json FROM region"""


# ---- books

LIMIT = 2


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def quota_daily(spark: SparkSession, sf: str) -> DataFrame:
    return books.quota(_events(spark, sf), LIMIT, "user_id", "ts", "event_id").where("allowed").select("event_id", "user_id", F.col("nth").cast("int").alias("nth"))


_QUOTA = "SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id)::INT AS nth FROM events"
QUOTA_DAILY = f"SELECT event_id, user_id, nth FROM ({_QUOTA}) WHERE nth <= {LIMIT}"


def quota_rejections(spark: SparkSession, sf: str) -> DataFrame:
    asked = books.quota(_events(spark, sf), LIMIT, "user_id", "ts", "event_id")
    return asked.groupBy("day").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(~F.col("allowed"), 1)).alias("rejected")).withColumn("day", F.col("day").cast("string"))


QUOTA_REJECTIONS = f"SELECT day::VARCHAR AS day, count(*) AS requests, count(*) FILTER (nth > {LIMIT}) AS rejected FROM ({_QUOTA}) GROUP BY 1"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a job log: a job is a user, its status the type of the event."""
    return _events(spark, sf).select(F.col("user_id").alias("job_id"), "event_id", "ts", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))


def job_latest(spark: SparkSession, sf: str) -> DataFrame:
    last = books.latest(_jobs(spark, sf), "job_id", "ts", "event_id")
    asked = _jobs(spark, sf).select((F.col("job_id") * 2).alias("job_id")).distinct()
    return asked.join(last, "job_id", "left").select("job_id", "event_id", books.poll(F.col("status")).alias("code"))


JOB_LATEST = """
WITH l AS (SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1),
s AS (SELECT job_id, event_id, event_type FROM l JOIN events USING (event_id)), a AS (SELECT DISTINCT user_id * 2 AS job_id FROM events)
SELECT job_id, event_id, CASE WHEN event_type IS NULL THEN 404 WHEN event_type IN ('click', 'processing') THEN 202 ELSE 200 END::INT AS code FROM a LEFT JOIN s USING (job_id)"""


def job_eviction(spark: SparkSession, sf: str) -> DataFrame:
    return books.newest(books.latest(_jobs(spark, sf), "job_id", "ts", "event_id"), 50, "ts", "event_id").select("job_id", "event_id")


JOB_EVICTION = "SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 ORDER BY max((ts, event_id)) DESC LIMIT 50"


def share_access(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as share links, some of them expired, protected or restricted; events as attempts to open them."""
    key = F.col("c_custkey")
    shares = table(spark, sf, "customer").select(
        key.alias("token"),
        F.when(key % 5 == 0, F.lit("2024-01-10 00:00:00").cast("timestamp")).alias("expires"),
        F.when(key % 3 == 0, books.secret(key.cast("string"), F.lit("open"))).alias("stored"),
        F.when(key % 4 == 0, F.array(F.lit("a@x.org"))).alias("recipients"),
    )
    tries = _events(spark, sf).select("event_id", "ts", F.col("user_id").alias("token"), F.when(F.col("event_id") % 2 == 0, books.secret(F.col("user_id").cast("string"), F.lit("open"))).alias("given"), F.expr("IF(event_id % 3 = 0, 'a@x.org', 'b@x.org')").alias("who"))
    joined = tries.join(shares.withColumn("found", F.lit(True)), "token", "left")
    status = books.share_status(F.coalesce("found", F.lit(False)), F.col("ts"), F.col("expires"), F.col("stored"), F.col("given"), F.col("recipients"), F.col("who"))
    return joined.select("event_id", status.alias("code"))


SHARE_ACCESS = """
SELECT event_id, CASE WHEN c_custkey IS NULL THEN 404 WHEN c_custkey % 5 = 0 AND ts >= TIMESTAMP '2024-01-10 00:00:00' THEN 410 WHEN c_custkey % 3 = 0 AND event_id % 2 <> 0 THEN 401
  WHEN c_custkey % 4 = 0 AND event_id % 3 <> 0 THEN 403 ELSE 200 END::INT AS code FROM events LEFT JOIN customer ON user_id = c_custkey"""


def share_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each share was opened."""
    opened = share_access(spark, sf).where("code = 200").join(_events(spark, sf).select("event_id", "user_id"), "event_id")
    return opened.groupBy(F.col("user_id").alias("token")).agg(F.count(F.lit(1)).alias("access_count"))


SHARE_COUNTS = f"SELECT user_id AS token, count(*) AS access_count FROM ({SHARE_ACCESS}) JOIN events USING (event_id) WHERE code = 200 GROUP BY 1"


def _share_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of shares: a third creates the user's share, a tenth deletes it, the others open it."""
    action = F.expr("CASE WHEN event_id % 3 = 0 THEN 'create' WHEN event_id % 10 = 1 THEN 'delete' ELSE 'open' END")
    offset = F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")
    expires = F.when(F.col("event_id") % 6 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset))
    return _events(spark, sf).select(F.col("user_id").alias("token"), action.alias("action"), "ts", "event_id", (F.col("user_id") % 7).alias("job_id"), F.lit("body").alias("report"), expires.alias("expires_at"))


def shares_list(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of one job that its log leaves, without those that expired by noon of 2024-01-15."""
    shares = books.shares_now(_share_log(spark, sf), "token", "ts", "event_id")
    left = books.purge(shares, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return books.shares_of(left.withColumn("job_id", F.col("job_id").cast("string")), "3", created="ts").select("token", "event_id", "expires_at", "access_count")


SHARES_LIST = """
WITH l AS (SELECT user_id AS token, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'create' WHEN event_id % 10 = 1 THEN 'delete' ELSE 'open' END AS action,
  CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '+02:00' ELSE 'Z' END END AS expires_at,
  CASE WHEN event_id % 6 = 0 THEN date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS expires FROM events WHERE user_id % 7 = 3),
m AS (SELECT token, max((ts, event_id)) FILTER (action = 'create') AS made, max((ts, event_id)) FILTER (action = 'delete') AS gone FROM l GROUP BY token)
SELECT l.token, l.event_id, l.expires_at, (SELECT count(*) FROM l o WHERE o.token = l.token AND o.action = 'open' AND (o.ts, o.event_id) > m.made) AS access_count
FROM m JOIN l ON l.token = m.token AND (l.ts, l.event_id) = m.made WHERE made IS NOT NULL AND (gone IS NULL OR gone < made) AND (l.expires IS NULL OR l.expires > TIMESTAMP '2024-01-15 12:00:00')"""


def share_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a log of shares by their users: made, deleted and opened as they were at the time of each attempt."""
    k = F.col("event_id")
    action = F.expr("CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 10 = 1 THEN 'delete' ELSE 'open' END")
    word = lambda x: books.secret(F.col("user_id").cast("string"), x)
    log = _events(spark, sf).select(
        F.col("user_id").alias("token"), action.alias("action"), "ts", "event_id", F.when(k % 5 == 0, F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("expires"), F.when(k % 3 == 0, word(F.lit("open"))).alias("stored"),
        F.when(k % 4 == 0, F.array(F.lit("a@x.org"))).alias("recipients"), F.when(k % 2 == 0, word(F.lit("open"))).alias("given"), F.expr("IF(event_id % 3 = 0, 'a@x.org', 'b@x.org')").alias("who"),
    )
    return books.share_attempts(log, "token", ("ts", "event_id"), "ts", "given", "who").select("event_id", "code", F.col("access_count").cast("long").alias("access_count"))


SHARE_ATTEMPTS = """
WITH l AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS k, CASE WHEN event_id % 7 = 0 THEN 'create' WHEN event_id % 10 = 1 THEN 'delete' ELSE 'open' END AS action FROM events),
j AS (SELECT o.event_id, o.ts, o.k, o.user_id, s.event_id AS made, s.action AS last, s.ts AS made_at
  FROM (SELECT * FROM l WHERE action = 'open') o ASOF LEFT JOIN (SELECT * FROM l WHERE action <> 'open') s ON o.user_id = s.user_id AND o.k >= s.k),
c AS (SELECT *, CASE WHEN coalesce(last, 'delete') = 'delete' THEN 404 WHEN made % 5 = 0 AND ts >= made_at + INTERVAL 12 HOUR THEN 410 WHEN made % 3 = 0 AND event_id % 2 <> 0 THEN 401
  WHEN made % 4 = 0 AND event_id % 3 <> 0 THEN 403 ELSE 200 END::INT AS code FROM j)
SELECT event_id, code, CASE WHEN code = 200 THEN row_number() OVER (PARTITION BY user_id, made, code ORDER BY k) END AS access_count FROM c"""


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: their records by method, and what failed."""
    e = _events(spark, sf)
    k = F.col("event_id")
    requests = e.select(
        F.element_at(F.array(*[F.lit(x) for x in ("GET", "POST", "PUT", "PATCH")]), (k % 4 + 1).cast("int")).alias("method"), F.lit("/x").alias("path"), F.lit(None).cast("string").alias("file_name"),
        F.when(k % 2 == 0, k).alias("size"), F.lit(5).cast("long").alias("content_length"), F.when(k % 5 == 0, 422).otherwise(200).alias("status"),
        F.col("ts").alias("started"), (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, 0.25)")).alias("ended"), F.when(k % 25 == 0, "Refused: x").alias("error"),
    )
    return books.audit(requests).groupBy("method", "status", "failure").agg(F.count(F.lit(1)).alias("requests"), F.sum("size").alias("bytes"), F.max("elapsed_ms").alias("slowest_ms"))


AUDIT_LOG = """
WITH e AS (SELECT event_id AS k, ['GET', 'POST', 'PUT', 'PATCH'][event_id % 4 + 1] AS method, CASE WHEN event_id % 5 = 0 THEN 422 ELSE 200 END::INT AS status FROM events)
SELECT method, status, CASE WHEN k % 25 = 0 THEN 'Refused: x' WHEN status >= 400 THEN 'HTTP 422' END AS failure, count(*) AS requests, sum(CASE WHEN k % 2 = 0 THEN k ELSE 5 END)::BIGINT AS bytes, 250.0::DOUBLE AS slowest_ms
FROM e WHERE method <> 'GET' GROUP BY ALL"""


def batch_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as the files of a batch."""
    files = table(spark, sf, "customer").select(F.col("c_name").alias("file_name"))
    return books.batch(files, "hash").select("operation", "file", "status", F.length("batch_id").alias("id_length"))


BATCH_PENDING = "SELECT 'hash' AS operation, c_name AS file, 'pending' AS status, 16::INT AS id_length FROM customer"


def batch_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of texts, hashed."""
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_name"), F.col("text").cast("binary").alias("content"))
    return books.run_batch(files, "hash")


BATCH_HASHES = """SELECT doc_id::VARCHAR AS file, '{"sha256":"' || sha256(text) || '","md5":"' || md5(text) || '","sha1":"' || sha1(text) || '"}' AS result FROM documents"""


#: Events that a shard of users has.
SHARD_EVENTS = 500_000


def _user_shards(spark: SparkSession, sf: str) -> int:
    return max(16, -(-table(spark, sf, "events").count() // SHARD_EVENTS))


def quota_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of requests, counted with state and written to the shared folder."""
    from foliant.streaming import flows, state

    kinds = table(spark, sf, "events").select("event_id", "user_id", "ts").schema
    stream = spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    where = shared_folder(spark)
    counted = flows.quota_stream(stream, 2, shards=_user_shards(spark, sf))
    return spark.read.schema(counted.schema).parquet(state.written(counted, where)).select("event_id", "day", "nth", "allowed")


QUOTA_STREAM = """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth,
row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM events"""


def _in_bands(spark: SparkSession, sf: str, folder: str, days: int = 10):
    """Appends events to a folder in bands of some days and yields after each; a row comes up to a day late, so that it may
    come after rows of later days. The last band is a row of 2100, behind which nothing waits."""
    e = _events(spark, sf).select("event_id", "user_id", "event_type", "ts")
    comes = F.col("ts") + F.expr("make_dt_interval(0, CAST(event_id % 24 AS int))")
    banded = e.withColumn("band", F.floor(F.unix_micros(comes) / (days * 86_400_000_000)))
    first, last = banded.agg(F.min("band"), F.max("band")).first()
    for band in range(first, last + 1) if first is not None else ():
        banded.where(F.col("band") == band).drop("band").write.mode("append").parquet(folder)
        yield
    spark.range(1).selectExpr("-1L AS event_id", "-1L AS user_id", "'close' AS event_type", "TIMESTAMP '2100-01-01 00:00:00' AS ts").write.mode("append").parquet(folder)
    yield


def _band_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").parquet(folder)


def quota_late(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that come out of order over several micro-batches, numbered in order."""
    from foliant.streaming import state

    where, shards = shared_folder(spark), _user_shards(spark, sf)
    for _ in _in_bands(spark, sf, f"{where}/events"):
        rows = state.written(state.quota_in_order(_band_stream(spark, f"{where}/events"), LIMIT, "25 hours", shards), where)
    return spark.read.schema("event_id long, user_id long, day string, nth long, allowed boolean").parquet(rows)


QUOTA_LATE = f"""SELECT event_id, user_id, strftime(day, '%Y-%m-%d') AS day, nth::BIGINT AS nth, nth <= {LIMIT} AS allowed FROM ({_QUOTA})"""


def job_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The store of the 50 newest jobs, filled by a stream in several micro-batches and read from its state."""
    from foliant.streaming import state

    where = shared_folder(spark)
    for _ in _in_bands(spark, sf, f"{where}/events"):
        settings = _band_stream(spark, f"{where}/events").where("event_id >= 0").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.when(F.col("event_type") == "click", "processing").otherwise(F.col("event_type")).alias("status"))
        state.written(state.job_store(settings, 50), where)
    return state.jobs_held(spark, f"{where}/state", 50).select("job_id", "event_id", books.poll(F.col("status")).alias("code"))


JOB_STREAM = """
WITH l AS (SELECT user_id AS job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1 ORDER BY max((ts, event_id)) DESC LIMIT 50)
SELECT job_id, event_id, CASE WHEN event_type IN ('click', 'processing') THEN 202 ELSE 200 END::INT AS code FROM l"""


def _over_bands(spark: SparkSession, sf: str, make, schema: str) -> DataFrame:
    """What a stream over the bands of events has given when nothing waits any more."""
    from foliant.streaming import state

    where = shared_folder(spark)
    for _ in _in_bands(spark, sf, f"{where}/events"):
        rows = state.written(make(_band_stream(spark, f"{where}/events")), where)
    return spark.read.schema(schema).parquet(rows)


def request_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Requests joined with their ends within five minutes, as two streams; some never end, some too late."""
    from foliant.streaming import flows

    k = F.col("event_id")
    ends = lambda e: e.where(k % 5 != 0).select("event_id", (F.col("ts") + F.expr("make_dt_interval(0, 0, CAST(event_id % 7 AS int))")).alias("ended"), F.when(k % 3 == 0, 422).otherwise(200).alias("status"))
    shards = _user_shards(spark, sf)
    log = _over_bands(spark, sf, lambda e: flows.request_log(e.select("event_id", "user_id", "ts"), ends(e), late="25 hours", shards=shards), "event_id long, user_id long, ts timestamp, status int, elapsed_ms double")
    return log.where("event_id >= 0").select("event_id", "user_id", "status", "elapsed_ms")


REQUEST_STREAM = """
SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <= 5 THEN CASE WHEN event_id % 3 = 0 THEN 422 ELSE 200 END END::INT AS status,
  CASE WHEN event_id % 5 <> 0 AND event_id % 7 <= 5 THEN (event_id % 7) * 60000.0 END::DOUBLE AS elapsed_ms FROM events"""


def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users in a stream whose rows come late."""
    from foliant.streaming import flows

    made = _over_bands(spark, sf, lambda e: flows.sessions(e.where("event_id >= 0 OR event_type = 'close'"), "6 hours", "25 hours"), "user_id long, started timestamp, ended timestamp, requests long")
    return made.where("user_id >= 0").select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "requests")


SESSION_STREAM = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(t) AS started, max(t) + 21600000000 AS ended, count(*) AS requests FROM s GROUP BY user_id, n"""


def sliding_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type in windows of a day, two of which overlap at any time, in a stream whose rows come late."""
    from foliant.streaming import flows

    made = _over_bands(spark, sf, lambda e: flows.sliding_counts(e, "event_type", late="25 hours"), "started timestamp, event_type string, requests long")
    return made.where("event_type <> 'close'").select(F.unix_micros("started").alias("started"), "event_type", "requests")


SLIDING_STREAM = """
WITH e AS (SELECT event_type, (epoch_us(ts) // 43200000000) * 43200000000 AS t FROM events)
SELECT started, event_type, count(*) AS requests FROM (SELECT unnest([t, t - 43200000000]) AS started, event_type FROM e) GROUP BY ALL"""


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and bytes that operators have read and given, observed while their results were written."""
    log, folder = runlog.RunLog(spark), shared_folder(spark)
    docs = log.watch(table(spark, sf, "documents"), "documents", "text")
    log.write(docs.select("doc_id", content.hashes(F.col("text").cast("binary")).alias("h")), "hashes", f"{folder}/hashes")
    log.write(table(spark, sf, "pages").select("page_id", F.upper("url").alias("url")), "urls", f"{folder}/urls", "url")
    return log.records().select("operator", "rows", "bytes", (F.col("elapsed_ms") >= 0).alias("timed"))


RUN_LOG = """
SELECT 'documents' AS operator, count(*) AS rows, sum(octet_length(encode(text)))::BIGINT AS bytes, true AS timed FROM documents
UNION ALL SELECT 'hashes', count(*), NULL, true FROM documents UNION ALL SELECT 'urls', count(*), sum(octet_length(encode(upper(url))))::BIGINT, true FROM pages"""


# ---- spreadsheets and formats


def a1_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", pages.column_letters(F.col("p_partkey") + 1).alias("letters"))
    return rows.withColumn("back", pages.column_index(F.col("letters")))


A1_COLUMNS = """
WITH p AS (SELECT p_partkey, p_partkey + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 26 THEN chr((64 + n)::INT) WHEN n <= 702 THEN chr((64 + (n - 1) // 26)::INT) || chr((65 + (n - 1) % 26)::INT)
  ELSE chr((64 + (n - 703) // 676 + 1)::INT) || chr((65 + ((n - 703) // 26) % 26)::INT) || chr((65 + (n - 1) % 26)::INT) END AS letters, n AS back FROM p"""

#: What stands before and behind a document's text, and what the whole is then.
WRAPPED = (
    ("%PDF-1.7\n", "", "pdf"), ("{\\rtf1 ", "", "rtf"), ("AT&TFORM\0\0\0\1DJVM", "", "djvu"), ("PK\3\4", "", "zip"), ("PK\3\4" + "\0" * 26 + "mimetypeapplication/epub+zip", "", "epub"), ("", "", "unknown"),
    ("PK\3\4", "word/document.xml", "docx"), ("\0" * 60 + "BOOKMOBI" + "\0" * 10, "", "mobi"), ("PK\3\4", "META-INF/container.xml", "epub"), ("\0" * 60 + "TEXtREAd" + "\0" * 10, "", "palmdoc"),
)
ENDINGS = ("pdf", "doc", "docx", "epub", "mobi", "rtf", "txt")


def format_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """Documents wrapped as files of every format, under names that often say another one."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("doc_id") % n + 1).cast("int"))
    whole = F.concat(pick([w[0] for w in WRAPPED], 10), F.coalesce("text", F.lit("")), pick([w[1] for w in WRAPPED], 10)).cast("binary")
    told = table(spark, sf, "documents").select("doc_id", content.sniff(whole).alias("detected"), content.declared_format(F.concat(F.lit("x."), pick(ENDINGS, 7))).alias("declared"))
    return told.withColumn("mismatch", content.is_mismatch(F.col("detected"), F.col("declared")))


FORMAT_SNIFF = f"""
WITH d AS (SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) + {[len(w[0]) + len(w[1]) for w in WRAPPED]}[doc_id % 10 + 1] < 8 THEN 'unknown' ELSE {[w[2] for w in WRAPPED]}[doc_id % 10 + 1] END AS detected,
  {[e if e != "txt" else "unknown" for e in ENDINGS]}[doc_id % 7 + 1] AS declared FROM documents)
SELECT doc_id, detected, declared, detected <> 'unknown' AND declared <> 'unknown' AND detected <> declared AND NOT (detected = 'palmdoc' AND declared = 'mobi') AS mismatch FROM d"""

QUERIES = {f"column_profile_{n}": (_profile_query(n), _profile_sql(n)) for n in PROFILED} | {
    f.__name__: (f, sql)
    for f, sql in (
        (header_checks, HEADER_CHECKS), (ragged_rows, RAGGED_ROWS), (markdown_table, MARKDOWN_TABLE), (csv_escape, CSV_ESCAPE), (json_rows, JSON_ROWS), (quota_daily, QUOTA_DAILY),
        (quota_rejections, QUOTA_REJECTIONS), (job_latest, JOB_LATEST), (job_eviction, JOB_EVICTION), (share_access, SHARE_ACCESS), (share_counts, SHARE_COUNTS), (shares_list, SHARES_LIST), (share_attempts, SHARE_ATTEMPTS), (audit_log, AUDIT_LOG), (batch_pending, BATCH_PENDING), (batch_hashes, BATCH_HASHES), (quota_stream, QUOTA_STREAM), (quota_late, QUOTA_LATE), (job_stream, JOB_STREAM), (request_stream, REQUEST_STREAM), (session_stream, SESSION_STREAM), (sliding_stream, SLIDING_STREAM), (run_log, RUN_LOG), (a1_columns, A1_COLUMNS), (format_sniff, FORMAT_SNIFF),
    )
}
