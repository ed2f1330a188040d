import hashlib
import struct

import duckdb
import pytest
import zstandard

from foliant.llm import queries, url_reputation, warc_zstd

PAGES = [
    (1, "http://A.Example.com/en/7x?q", "a" * 1500), (2, "http://x.example.com/en/8", "a" * 1500), (3, None, None), (4, "no scheme", ""), (5, "https://example.net/de/8#t", "short"), (6, "https://example.net/de/1", "short"),
    (7, "ftp://h.org/es/", "é" * 600), (7, "ftp://h.org/es/", "é" * 600), (None, "http://h.org?x", "a" * 1500), (8, "a://", "\r\n\r\n" * 300), (9, "x://y.example.com:80/fr", "WARC/1.1"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS verdict", "1 AS n")


def test_rules_and_hosts(spark, pages):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.url_verdicts(spark, pages).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("x.example.com", "/en/8", "com/en/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None)
    assert got[5] == ("example.net", "/de/8", "example.net/de/8", "block") and got[6] == ("example.net", "/de/1", "net/de/", "allow")
    assert got[7] == ("h.org", "/es/", "org/es/", "block") and got[None][:3] == ("h.org", "", None)
    assert got[8][:3] == ("", "", None) and got[9][:2] == ("y.example.com:80", "/fr")


def test_reputation_shrinks(spark):
    rows = [(k, "http://bad.example.com/en/1") for k in range(40)] + [(100, "http://bad.example.com/x"), (101, "http://fresh.example.com/x"), (102, "http://other.org/x")]
    rows += [(200 + k, f"http://h{k}.example.net/de/1") for k in range(40)]
    got = {r.page_id: r for r in url_reputation.url_verdicts(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[100].verdict == "block" and got[102].verdict == "allow" and got[0].bound is None
    assert got[100].bound > got[101].bound > got[102].bound


def test_url_empty(spark, pages):
    assert url_reputation.url_verdicts(spark, pages.where("false")).count() == 0


def test_warc_round_trip(spark, pages):
    got = sorted(warc_zstd.warc_round_trip(spark, pages).collect(), key=repr)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        main = max((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None) if len(raw) >= 1000 else None
        revisit = main is not None and main != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", main if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc_zstd.warc_round_trip(spark, pages.where("false")).count() == 0


def archive(records):
    frame, made = warc_zstd.dictionary_frame(records)
    packer = zstandard.ZstdCompressor(dict_data=made)
    return frame + b"".join(packer.compress(r) for r in records)


def test_reader_checks_what_it_reads():
    good = [warc_zstd.record(k, "http://x", "response", b"payload %d" % k * 50, hashlib.sha1(b"payload %d" % k * 50).hexdigest(), None) for k in range(300)]
    raw = archive(good)
    assert [warc_zstd.parse_record(x)[0] for x in warc_zstd.frames_of(raw)] == list(range(300))
    assert struct.unpack("<I", raw[:4])[0] == warc_zstd.DICT_MAGIC and len(raw) > 8
    for broken in (raw[:-3], raw[:10], raw + b"xy", b"junk" + raw):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc_zstd.frames_of(broken))
    assert "as long" in warc_zstd.parse_record(good[0].replace(b"Content-Length: 450", b"Content-Length: 449"))[-1]
    assert "digest" in warc_zstd.parse_record(good[0].replace(b"payload 0payload", b"payload 1payload", 1))[-1]
    assert warc_zstd.parse_record(b"nothing")[-1] == "no WARC header"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf1, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf1}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf1)
    result = con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({queries.ORACLE_SQL[name]})")
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize(("host", "domain", "suffix"), [
    ("a.b.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("com", "com", "com"), ("a.shop.co.uk:8080", "shop.co.uk", "co.uk"), ("shop.co.uk", "shop.co.uk", "co.uk"),
    ("10.1.2.3", "10.1.2.3", "10.1.2.3"), ("10.1.2.3:80", "10.1.2.3", "10.1.2.3"), ("[::1]:80", "[::1]", "[::1]"), ("", "", ""), ("x.y.example.net:443", "example.net", "net"),
])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(host,)], "host string")
    assert tuple(df.select(*url_reputation.domain_and_suffix(F.col("host"))).first()) == (domain, suffix)


def test_op1_equals_its_sql_on_hosts_of_every_kind(spark, tmp_path):
    hosts = ("a.example.com", "b.example.com:80", "x.shop.co.uk", "y.shop.co.uk", "10.1.2.3", "10.1.2.3:8080", "[::1]:1", "org", "h.org", "")
    rows = [(k, f"http://{hosts[k % 10]}/{('en', 'de', 'es', 'x')[k % 4]}/{k % 9}" + "p" * (100_000 * (k == 77))) for k in range(400)] + [(None, None), (7, "none"), (7, "none")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(repr(tuple(r)) for r in queries.op1_url_reputation(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(repr(tuple(r)) for r in con.sql(url_reputation.oracle()).fetchall())
