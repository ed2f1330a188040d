from datetime import datetime, timedelta

from foliant.operators import books
from foliant.streaming import flows, state

EVENT = "event_id long, user_id long, ts timestamp, status string"


def at(hour, minute=0):
    return datetime(2024, 1, 1) + timedelta(hours=hour, minutes=minute)


def in_batches(spark, folder, batches, make):
    """Appends each batch and runs the stream over what is new."""
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        state.written(make(spark.readStream.schema(EVENT).parquet(f"{folder}/in")), folder)
    return spark.read.schema(make(spark.readStream.schema(EVENT).parquet(f"{folder}/in")).schema).parquet(f"{folder}/rows").collect()


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_quota_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(flows.quota_stream(stream, 1), "quota")
    got = {(r.event_id, r.nth, r.allowed) for r in spark.table("quota").collect()}
    want = {(r.event_id, r.nth, r.allowed) for r in books.quota(events, 1, "user_id", "ts", "event_id").collect()}
    assert got == want


def test_days_are_those_of_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_micros(x * 1000000L) AS ts, x AS id, 1 AS u FROM VALUES (0L), (86399L), (86400L), (-1L) AS t(x)")
        got = {r.id: (str(r.day), r.nth) for r in books.quota(df, 1, "u", "ts", "id").collect()}
        assert got == {0: ("1970-01-01", 1), 86399: ("1970-01-01", 2), 86400: ("1970-01-02", 1), -1: ("1969-12-31", 1)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_pii_stream(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a@b.org c@d.org' AS text UNION ALL SELECT TIMESTAMP '2024-01-02 00:00:00', 'none'")
    rows.write.parquet(str(tmp_path / "in"))
    run(flows.pii_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "pii")
    assert [(r.pii_type, r.matches) for r in spark.table("pii").collect()] == [("email", 2)]


def test_file_stream(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    run(flows.file_stream(spark, str(tmp_path)).select("file_name", "length"), "files")
    assert [tuple(r) for r in spark.table("files").collect()] == [("x.bin", 3)]


def test_quota_in_order_with_late_rows(spark, tmp_path):
    """Row 2 comes after row 3 and counts before it; row 9 comes when the watermark is past it and is dropped; each
    day and user counts alone, and a day that is over is forgotten."""
    batches = [
        [(1, 7, at(1), "x"), (3, 7, at(3), "x"), (4, 8, at(3), "x"), (6, 7, at(23), "x")],
        [(2, 7, at(2), "x"), (5, 7, at(3), "x"), (7, 7, at(25), "x")],
        [(8, 7, at(26), "x"), (10, None, at(27), "x"), (11, 7, at(200), "x")],
        [(9, 7, at(4), "x"), (12, 7, at(900), "x")],
        [(99, 0, at(9000), "x")],
    ]
    got = in_batches(spark, str(tmp_path), batches, lambda s: state.quota_in_order(s, 2, "24 hours"))
    by = {r.event_id: (r.user_id, r.day, r.nth, r.allowed) for r in got}
    one, two = "2024-01-01", "2024-01-02"
    want = {1: (7, one, 1, True), 2: (7, one, 2, True), 3: (7, one, 3, False), 5: (7, one, 4, False), 6: (7, one, 5, False), 4: (8, one, 1, True), 7: (7, two, 1, True), 8: (7, two, 2, True)}
    assert {k: by[k] for k in want} == want and 9 not in by and 99 not in by and by[11][2] == by[12][2] == 1 and by[10][0] is None and len(got) == len(by)


def test_job_store_evicts_and_refreshes(spark, tmp_path):
    """With one shard of two jobs: 1 is set again and stays, 2 goes; an older setting of 1 changes nothing."""
    batches = [[(1, 1, at(1), "a"), (2, 2, at(2), "a")], [(3, 1, at(3), "b"), (4, 3, at(4), "a")], [(0, 1, at(0), "old")]]
    got = in_batches(spark, str(tmp_path), batches, lambda s: state.job_store(s.withColumnRenamed("user_id", "job_id"), 2, shards=1))
    assert sorted((r.job_id, r.status, r.evicted) for r in got) == [(1, "a", False), (1, "b", False), (2, "a", False), (2, "a", True), (3, "a", False)]
    held = state.jobs_held(spark, f"{tmp_path}/state", 2).collect()
    assert [(r.job_id, r.event_id, r.status) for r in sorted(held)] == [(1, 3, "b"), (3, 4, "a")]
    assert [r.job_id for r in state.jobs_held(spark, f"{tmp_path}/state", 1).collect()] == [3]


CHUNK = "call_id long, seq long, name string, data binary, last boolean, ts timestamp"


def test_chunks_become_files(spark, tmp_path):
    """Call 1: a file that says it ends, one that the next name ends, one of the same name again, one that never ends.
    Call 2 comes out of order and twice; call 3 is too large; call 4 never has its first chunk."""
    c = lambda call, seq, name, data, last=False, hour=0: (call, seq, name, bytearray(data), last, at(hour))
    batches = [
        [c(1, 0, "a", b"x"), c(2, 2, "c", b"3"), c(3, 0, "big", b"12345"), c(4, 1, "lost", b"?"), c(5, 0, "e", b"", True)],
        [c(1, 1, "a", b"y", True), c(1, 2, "a", b"z"), c(2, 0, "b", b"1"), c(2, 2, "c", b"again"), c(3, 1, "big", b"6789"), c(3, 2, "big", b"0", True)],
        [c(1, 3, "b", b"w"), c(2, 1, "b", b"2"), c(2, 3, "c", b"4", True), c(2, 0, "b", b"again")],
        [c(9, 0, "end", b"", True, 50)],
        [c(9, 1, "end", b"", True, 51)],
    ]
    folder = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        made = state.chunk_files(spark.readStream.schema(CHUNK).parquet(f"{folder}/in"), "1 hour", most_bytes=8)
        state.written(made, folder)
    got = sorted((r.call_id, r.nth, r.name, r.content and bytes(r.content), r.chunks, r.problem and r.problem.status) for r in spark.read.schema(made.schema).parquet(f"{folder}/rows").where("call_id < 9").collect())
    assert got == [
        (1, 0, "a", b"xy", 2, None), (1, 1, "a", b"z", 1, None), (1, 2, "b", None, 1, 408), (2, 0, "b", b"12", 2, None), (2, 1, "c", b"34", 2, None), (3, 0, "big", None, 3, 413), (4, 0, "lost", None, 1, 408),
        (5, 0, "e", bytearray(b""), 1, None),
    ]


def test_requests_meet_their_ends(spark, tmp_path):
    """Request 1 ends in time, 2 too late, 3 never, 4 before it begins; the end of 1 comes in a later batch."""
    starts = [[(1, 7, at(1)), (2, 7, at(1)), (3, None, at(1))], [(4, 8, at(2))], [(9, 9, at(90))], [(9, 9, at(91))]]
    ends = [[(2, at(1, 6), 200)], [(1, at(1, 5), 422), (4, at(1, 59), 200)], [(8, at(90), 200)], [(8, at(91), 200)]]
    folder = str(tmp_path)
    for a, b in zip(starts, ends, strict=True):
        spark.createDataFrame(a, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/starts")
        spark.createDataFrame(b, "event_id long, ended timestamp, status int").coalesce(1).write.mode("append").parquet(f"{folder}/ends")
        made = flows.request_log(spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{folder}/starts"), spark.readStream.schema("event_id long, ended timestamp, status int").parquet(f"{folder}/ends"))
        state.written(made, folder)
    got = sorted((r.event_id, r.status, r.elapsed_ms) for r in spark.read.schema(made.schema).parquet(f"{folder}/rows").where("event_id < 9").collect())
    assert got == [(1, 422, 300_000.0), (2, None, None), (3, None, None), (4, None, None)]


def quota_rows(users):
    return [(k, None if u % 50 == 3 else u, at(0) + timedelta(seconds=(k * 7919) % 80_000), "x") for k, u in enumerate(users)]


def by_user(rows):
    """nth of each event, counted in Python."""
    order, seen, nth = sorted(rows, key=lambda r: (r[2], r[0])), {}, {}
    for event, user, _, _ in order:
        nth[event] = seen[user] = seen.get(user, 0) + 1
    return nth


def test_quota_calls_are_shards_and_not_users(spark, tmp_path):
    """Many users of a day share a few rows of state; those without an id count as one."""
    rows = quota_rows([k % 400 for k in range(1200)])
    got = in_batches(spark, f"{tmp_path}/a", [rows], lambda s: flows.quota_stream(s.select("event_id", "user_id", "ts"), 2, shards=3))
    assert {r.event_id: r.nth for r in got} == by_user(rows) and {r.event_id: r.user_id for r in got} == {r[0]: r[1] for r in rows} and all(r.allowed == (r.nth <= 2) for r in got)
    assert spark.read.format("statestore").load(f"{tmp_path}/a/state").count() <= 4
    got = in_batches(spark, f"{tmp_path}/b", [rows[:700], rows[700:], [(-1, 0, at(9000), "x")], [(-2, 0, at(9001), "x")]], lambda s: state.quota_in_order(s, 2, "2 days", shards=3))
    assert {r.event_id: r.nth for r in got if r.event_id >= 0} == by_user(rows) and {r.event_id: r.user_id for r in got if r.event_id >= 0} == {r[0]: r[1] for r in rows}


def test_quota_stream_goes_on_and_keeps_ids(spark, tmp_path):
    """Counts go on in a later batch; an event without an id leaves large ids beside it as they are."""
    big = 2**62 + 1
    batches = [[(big, 1, at(1), "x"), (None, 1, at(2), "x"), (7, 2, at(3), "x")], [(big + 1, 1, at(4), "x"), (8, None, at(4), "x")], [(9, None, at(5), "x")]]
    got = in_batches(spark, str(tmp_path), batches, lambda s: flows.quota_stream(s.select("event_id", "user_id", "ts"), 2, shards=1))
    assert {(r.event_id, r.user_id, r.nth, r.allowed) for r in got} == {(big, 1, 1, True), (None, 1, 2, True), (7, 2, 1, True), (big + 1, 1, 3, False), (8, None, 1, True), (9, None, 2, True)}


def test_requests_wait_as_shards(spark, tmp_path):
    """Requests and ends, repeated or without an id, meet as in a join; while they wait, a shard of ids is a value of state."""
    starts = [(k % 150 if k % 40 else None, k if k % 9 else None, at(1) + timedelta(seconds=(k * 7919) % 4000)) for k in range(300)]
    ends = [(k % 200 if k % 30 else None, at(1) + timedelta(seconds=(k * 6007) % 4300), k if k % 4 else None) for k in range(600)]
    batches = [(starts[::2], ends[1::2]), (starts[1::2], ends[::2]), ([(-1, 0, at(99))], [(-1, at(99, 30), 0)]), ([(-1, 0, at(100))], [(-1, at(100, 30), 0)])]
    folder, kinds = str(tmp_path), {"starts": "event_id long, user_id long, ts timestamp", "ends": "event_id long, ended timestamp, status int"}
    for n, pair in enumerate(batches):
        for (name, kind), rows in zip(kinds.items(), pair, strict=True):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        made = flows.request_log(*[spark.readStream.schema(kind).parquet(f"{folder}/{name}") for name, kind in kinds.items()], "5 minutes", "3 hours", shards=3)
        state.written(made, folder)
        if n == 1:
            for name in kinds:
                assert 0 < spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/state").count() <= 4
    want = []
    for i, user, ts in starts:
        met = [(s, (e - ts).total_seconds() * 1000) for j, e, s in ends if i is not None and i == j and timedelta(0) <= e - ts <= timedelta(minutes=5)]
        want += [(i, user, ts, *m) for m in met or [(None, None)]]
    got = [tuple(r) for r in spark.read.schema(made.schema).parquet(f"{folder}/rows").where("event_id IS NULL OR event_id >= 0").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(w[4] is not None for w in want)
