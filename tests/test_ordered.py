"""Joins and counts in order against brute force, with keys that lie in many parts."""

import random

import pytest

from foliant.operators import books, ordered


def rows(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(4)
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), draw.choice([None, *range(200)]), n) for n in range(600)]
    right = [(k, t, f"v{n}") for n, (k, t) in enumerate({(key(), draw.choice([None, *range(200)])) for _ in range(150)})]
    left += left[:5]
    return left, right, spark.createDataFrame(left, "k string, t int, id int").repartition(3), spark.createDataFrame(right, "k string, t int, v string")


@pytest.mark.parametrize("parts", [1, 9])
def test_asof_join(spark, sides, parts):
    left, right, a, b = sides
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = lambda t: -1 if t is None else t
        want = []
        for k, t, n in left:
            seen = [(order(u), v) for j, u, v in right if j == k and order(u) <= order(t)]
            want.append((k, t, n, max(seen)[1] if seen else None, bool(seen)))
        got = ordered.asof_join(a.selectExpr("*", "'x' AS part", "'y' AS v"), b, ["k"], ["t"], ["v"])
        assert got.columns == ["k", "t", "id", "part", "v", "found"] and rows(got, "k", "t", "id", "v", "found") == sorted(map(repr, want))
        assert ordered.asof_join(a, b.where("false"), ["k"], ["t"], ["v"]).where("found").count() == 0
        assert ordered.asof_join(a.where("false"), b, ["k"], ["t"], ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_lies_in_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr("'hot' AS k", "id AS t")
        parts = ordered.dealt(df, ["k"], ["t"], "part").groupBy("part").count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 10_000
        got = ordered.running_count(df.withColumn("part", df.t % 3), ["k"], ["t"])
        assert got.where("nth <> t + 1").count() == 0 and got.count() == 20_000 and got.columns == ["k", "t", "part", "nth"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_attempts_at_a_share_that_comes_and_goes(spark):
    log = [
        (1, "open"), (2, "create"), (3, "open"), (4, "open"), (5, "delete"), (6, "open"), (7, "create"), (8, "open"),
    ]
    df = spark.createDataFrame([("s", a, n, None, None, None, None, None) for n, a in log] + [(None, "open", 9, None, None, None, None, None)], "token string, action string, n int, expires int, stored string, recipients array<string>, given string, who string")
    got = books.share_attempts(df, "token", ("n",), "n", "given", "who")
    assert [tuple(r) for r in got.select("n", "code", "access_count").orderBy("n").collect()] == [(1, 404, None), (3, 200, 1), (4, 200, 2), (6, 404, None), (8, 200, 1), (9, 404, None)]
