import hashlib
import heapq
import itertools
import os
import random
import zlib

import duckdb
import pytest

from foliant.llm import prefix_trie, queries, reply_trees, turn_repair, turns

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "<s>[INST] \\ </s> \\\\<s>"), (1, 1, "assistant", "<s>[INST] \\ </s> \\\\<s>"), (2, None, None, None), (2, 5, "", ""), (3, 2, "tool", "x" * 200_000), (3, None, "user", " \t"),
    (None, 0, "user", "No id."), (None, None, None, "Null."), (4, 0, "[/INST]", "[/INST]"), (4, 0, "a", "b"), (100, 0, "user", "Hi."), (100, 1, "assistant", "Oh!"), (100, 1, "user", "é漢😀"), (101, 0, "user", "one"),
    (103, 0, "user", "one"), (103, 7, "assistant", "two"), (-3, 0, "system", "Be."), (-3, 1, "user", "Ok?"), (-3, 2, "assistant", "Yes"),
]
NAMES = ("op11_reply_trees", "op12_turn_repair", "op13_prefix_trie")


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns that carry the names of results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", "'x' AS tree", "1 AS place", "'y' AS path", "2 AS part", "'z' AS node", "0 AS depth", "'q' AS conv", "3 AS audit", "1 AS cost")


@pytest.fixture(scope="module")
def drawn(spark):
    """Conversations of few words, so that faults and shared turns abound; the longest has 300 turns."""
    draw = random.Random(5)
    rows = []
    for conv in [*range(90), *range(100, 160), 700, 701]:
        for turn in range(300 if conv == 700 else draw.randrange(1, 9)):
            rows.append((conv, turn if draw.random() < 0.9 else turn + 3, draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), draw.choice(["Yes.", "No", "Why?", "  ", "Well. Yes!"])))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def by_sql(name, given):
    con = duckdb.connect()
    con.register("given", given.select("conv_id", "turn", "role", "text").toArrow())
    con.sql(f"CREATE TABLE conversations AS SELECT * FROM given")
    result = con.execute(f"SELECT * FROM ({queries.ORACLE_SQL[name]})")
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


RUNS = {
    "op11_reply_trees": lambda spark, df: reply_trees.conversation_digests(spark, df),
    "op12_turn_repair": lambda spark, df: turn_repair.damage_and_repair(spark, df),
    "op13_prefix_trie": lambda spark, df: prefix_trie.prefix_trie(spark, df, rebuild=True),
}


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, name):
    assert rows(queries.QUERIES[name](spark, sf)) == by_sql(name, spark.read.parquet(f"{sf}/conversations.parquet"))


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("which", ["odd_turns", "drawn"])
def test_equals_sql_on_odd_rows(spark, name, which, request):
    given = request.getfixturevalue(which)
    assert rows(RUNS[name](spark, given)) == by_sql(name, given)


def test_empty(spark, odd_turns):
    none = odd_turns.where("false")
    assert [r.conv_id for r in RUNS["op11_reply_trees"](spark, none).collect()] == [-7]
    assert RUNS["op12_turn_repair"](spark, none).count() == RUNS["op13_prefix_trie"](spark, none).count() == 0


def test_crc32_in_sql():
    for x in ("", "0", "12:7", "-5: "):
        assert duckdb.execute(f"SELECT {turns.crc32_sql('?')}", [x]).fetchone()[0] == zlib.crc32(x.encode())


# ---- reply trees


def test_escapes_are_reversible(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice(["<", "/", "s", ">", "[", "INST", "]", "\\", "</s>", "[/INST]", "é", "\n", "$"]) for _ in range(draw.randrange(12))) for _ in range(3000)]
    t = reply_trees.Template()
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", t.escaped(df.text).alias("safe")).collect():
        assert reply_trees.plain(r.safe) == r.text and not any(c in r.safe for c in t.controls)
    with pytest.raises(ValueError):
        reply_trees.Template(controls=("abab",))


#: A tree with three branches, a second root, a ring, an answer to nothing, and a repeated id.
TREE = [
    ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 0.5), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 3, "user", "c", 0.1), ("t", 5, 2, "user", "d", None), ("t", 6, 1, "assistant", "e", 1.0),
    ("u", 1, None, "user", "other", 0.0), ("u", 1, None, "user", "same id", 0.0), ("u", 2, 1, "assistant", "under the first", 9.0), ("u", 7, 99, "user", "lost", 0.0),
    ("r", 1, 2, "user", "x", 0.0), ("r", 2, 1, "user", "y", 0.0), ("r", 3, 1, "user", "z", 0.0), (None, 1, None, "user", "no tree", 0.0),
]


def test_branches_and_their_ranks(spark):
    df = spark.createDataFrame(TREE, "thread string, id long, reply_to long, role string, text string, score double").coalesce(1)

    def texts(best):
        parts = reply_trees.format_trees(spark, df, "thread", "id", "reply_to", "role", "text", "score", best)
        return sorted((str(r.tree), [m[1] for m in reply_trees.Template().turn().findall(r.formatted)]) for r in parts.collect())

    assert texts(1) == [("None", ["no tree"]), ("t", ["q", "e"]), ("u", ["other", "under the first"])]
    assert texts(2) == [("None", ["no tree"]), ("t", ["q", "b", "c"]), ("t", ["q", "e"]), ("u", ["other", "under the first"]), ("u", ["same id"])]
    assert len(texts(None)) == 7


def test_parts_of_long_conversations(spark, monkeypatch):
    df = spark.createDataFrame([(c, i, "assistant" if i % 2 else "user", f"text {c} {i} </s>") for c in (1, 2) for i in range(1000)], SCHEMA)
    want = rows(reply_trees.conversation_digests(spark, df))
    monkeypatch.setattr(reply_trees, "PART_CHARS", 500)
    parts = reply_trees.format_conversations(spark, df)
    assert parts.count() > 50 and parts.selectExpr("max(length(formatted))").first()[0] <= 500
    assert rows(reply_trees.conversation_digests(spark, df)) == want


# ---- repair


def cheapest(symbols):
    """All strings of edits in order of cost and text, until one is well formed."""
    arcs, ends = turn_repair.SYSTEM_THEN_PAIRS.arcs, turn_repair.SYSTEM_THEN_PAIRS.ends
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q, audit) in seen:
            continue
        seen.add((i, q, audit))
        if i == len(symbols) and q in ends:
            return cost, audit
        for x in "ua":
            if x in arcs[q]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, arcs[q][x]))
        if i < len(symbols):
            initial, fault = symbols[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault in (0, 3):
                more = fault // 3
                if initial in arcs[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, arcs[q][initial]))
                for x in "ua":
                    if x in arcs[q]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, arcs[q][x]))


def test_cheapest_edits_equal_an_exhaustive_search():
    import pyarrow as pa

    every = [list(x) for n in range(4) for x in itertools.product(itertools.product("suat", range(4)), repeat=n)]
    draw = random.Random(1)
    every += [[(draw.choice("suaaut"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randrange(4, 8))] for _ in range(300)]
    back = [(n, None, *x) for n, symbols in enumerate(every) for x in reversed(symbols)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*back), (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], ["conv", "turn", "initial", "fault"])
    found = {r[0]: r[6:] for r in turn_repair._audited(turn_repair.SYSTEM_THEN_PAIRS, [batch])}
    assert all(found[n] == cheapest(symbols) for n, symbols in enumerate(every) if symbols)


def test_repaired_rows(spark):
    given = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What?"), (1, 2, "user", "What?"), (1, 3, "tool", "That."), (2, 0, "user", "Bye"), (3, 0, "system", "")]
    got = turn_repair.repair(spark, spark.createDataFrame(given, SCHEMA), with_rows=True).collect()
    by = {c: [(r.role, r.text) for r in sorted(got, key=lambda r: r.nth) if r.conv_id == c] for c in (1, 2, 3)}
    assert by == {1: [("user", ""), ("assistant", "Hello."), ("user", "What?"), ("assistant", "That.")], 2: [], 3: []}  # deleting a row that is cut costs what keeping it does, and D comes before K
    audits = {r.conv_id: (r.cost, r.audit, r.duplicate, r.truncated) for r in turn_repair.repair(spark, spark.createDataFrame(given, SCHEMA)).collect()}
    assert audits == {1: (7, "IKKDR", 1, 0), 2: (3, "D", 0, 1), 3: (3, "D", 0, 0)}


# ---- trie


def brute_trie(given):
    own = {}
    for conv, turn, role, text in sorted((r for r in given if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    made = {}
    for conv, said in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        made[conv] = tuple(own.get(conv - conv % 100, [])[:h] + said[h:])
    members = {}
    for conv, said in made.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(conv)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = 0 if kids.get(p) else 1, (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    for p, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if made[c] == p)))
        yield min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()


@pytest.mark.parametrize("most", [1, 5, 40, 200_000])
def test_trie_equals_brute_force_however_groups_split(spark, drawn, monkeypatch, most):
    monkeypatch.setattr(prefix_trie, "TRIE_TURNS", most)
    monkeypatch.setattr(prefix_trie, "CALL_TURNS", max(2, most // 2))
    monkeypatch.setattr(prefix_trie, "CHAIN", 7)
    draw = random.Random(9)
    opening = [(0, i, "user", f"shared {i}") for i in range(20)]
    given = [(c, i, r, t) for c in range(300, 340) for _, i, r, t in opening[: draw.randrange(1, 20)]] + [(c, i, r, t) for c in (340, 341) for _, i, r, t in opening]
    given += [(c, 99, "assistant", draw.choice(["a", "b", ""])) for c in range(300, 342)]
    if most > 1:
        given = given + [tuple(r) for r in drawn.where("conv_id < 160").collect()]
    df = spark.createDataFrame(given, SCHEMA)
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark, df, rebuild=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_trie(given)))
