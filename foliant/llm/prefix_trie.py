"""The trie of the prefixes that conversations share.

Equal conversations become one sequence first. Sequences are dealt by the digest of their first turn; groups of
bounded size are built as pointer dictionaries inside applyInPandas, several of them in a call, and summed up in
postorder without recursion. A group that is too large is split by its next turn: what all of its sequences share is a
chain of nodes, which sums describe, and the sequences go on to groups of the turn that follows. Sums of the
subtries go up through the splits in as many rounds as there were.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, shards_for
from foliant.llm.turns import TIE, arrow_schema, batches_of, crc32_sql, ordered, rows_of, with_stretch

#: Turns of a group that is built as one dictionary, of the groups that a call gets on average, and of a block of a chain.
TRIE_TURNS, CALL_TURNS, CHAIN = 200_000, 100_000, 10_000
#: Conversations of a hundred begin with the first turns of one, fewer than so many.
FAMILY, SHARED = 100, 6
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_of long"
#: A node on the way: the group's key, the key of the split above, and whether the group begins with it.
_BUILT = f"{NODES}, p1 long, p2 long, top boolean"


def digested(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """(conv, depth from 1, e1, e2, chars): each turn as two hashes of role, text and depth, and its code points. Rows
    go by turn, nulls first, those of one turn by role, the text's first characters and its hash."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, TIE).alias("tie"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit(1), role).alias("h2"), F.length(text).cast("long").alias("chars"))
    kept = ordered(scratch, rows.where("conv IS NOT NULL"), "turns", "h1")
    nth = F.col("before") + F.col("place") - F.col("first")
    return with_stretch(kept).select("conv", (nth + 1).alias("depth"), "h1", "h2", "chars")


def families(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv, depth, h1, h2, chars) rebuilt, and (conv) of all: a conversation begins with the first
    crc32(conv) mod SHARED turns of conv - conv mod FAMILY, where its own would be."""
    turns = scratch.save(turns, "own")
    every = scratch.save(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "every")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("depth") < SHARED)).withColumnRenamed("conv", "base")
    lent = every.select("conv", base.alias("base"), head.alias("head")).join(heads, "base").where("depth <= head").select("conv", "depth", "h1", "h2", "chars")
    sizes = every.where(F.col("conv") % FAMILY == 0).selectExpr("conv AS base", "n AS has")
    own = turns.withColumns({"base": base, "head": head}).where("depth > head").join(sizes, "base", "left")
    own = own.select("conv", (F.col("depth") - F.col("head") + F.least("head", F.coalesce("has", F.lit(0)))).alias("depth"), "h1", "h2", "chars")
    return lent.union(own), every.select("conv")


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the groups of a call as rows of _BUILT. A row is a turn of a sequence from its group's depth on."""
    pdf = pdf.sort_values(["low", "depth"], kind="stable")
    tops: dict[tuple[int, int], int] = {}
    children: list[dict[tuple[int, int], int]] = []
    depth, low, n, chars, above, group, ends = [], [], [], [], [], [], []
    at = -1
    columns = ("k1", "k2", "k", "low", "w", "length", "depth", "e1", "e2", "chars", "p1", "p2", "above")
    for k1, k2, k, seq, w, length, d, e1, e2, size, p1, p2, parent in zip(*[pdf[c].tolist() for c in columns], strict=True):
        known, key = (tops, (k1, k2)) if d == k else (children[at], (e1, e2))
        node = known.get(key)
        if node is None:
            node = known[key] = len(depth)
            children.append({})
            depth.append(d)
            low.append(seq)
            n.append(0)
            chars.append(size)
            above.append(-1 if d == k else at)
            group.append((p1, p2, parent))
            ends.append(None)
        n[node] += w
        low[node] = min(low[node], seq)
        if d == length:
            ends[node] = seq
        at = node
    leaves, saved = [0] * len(depth), [0] * len(depth)
    for top in tops.values():
        open_ = [(top, iter(children[top].values()))]
        while open_:
            node, rest = open_[-1]
            child = next(rest, None)
            if child is not None:
                open_.append((child, iter(children[child].values())))
                continue
            open_.pop()
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * chars[node]
            if open_:
                leaves[open_[-1][0]] += leaves[node]
                saved[open_[-1][0]] += saved[node]
    parents = [group[i][2] if up < 0 else low[up] for i, up in enumerate(above)]
    made = {"conv_id": low, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved}
    made |= {"ends_of": pd.array(ends, "Int64"), "p1": [g[0] for g in group], "p2": [g[1] for g in group], "top": [up < 0 for up in above]}
    return pd.DataFrame(made)


def _tries(rows: DataFrame) -> DataFrame:
    """The nodes of groups that are small enough. A call gets the groups of a bucket of their digests."""
    buckets = shards_for(rows.count(), CALL_TURNS)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: _built(pdf), _BUILT)


def prefix_nodes(scratch: Scratch, sequences: DataFrame, rows: DataFrame) -> DataFrame:
    """NODES of sequences(low, w, length), low being its name and its smallest member and w its members, and their
    turns rows(low, depth, e1, e2, chars). ends_of names the sequence that ends at a node. The root comes first of
    all; without sequences there is none."""
    key = ["k1", "k2"]
    told = sequences.agg(F.min("low").alias("conv_id"), F.sum("w").alias("n_convs"), F.min(F.when(F.col("length") == 0, F.col("low"))).alias("ends_of")).first()
    active = sequences.where("length > 0").select("low", "w", "length", *[F.lit(0).cast("long").alias(c) for c in ("d1", "d2", "d")], F.lit(told.conv_id).cast("long").alias("above"))
    found: list[DataFrame] = []
    splits: list[tuple[DataFrame, DataFrame]] = []
    tops: list[DataFrame] = []
    for turn in range(1 << 30):
        step = active.withColumn("depth", F.col("d") + 1).join(rows, ["low", "depth"])
        deal = step.select("low", "w", "length", "above", F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.expr("d1 ^ e1").alias("k1"), F.expr("d2 ^ e2").alias("k2"), F.col("depth").alias("k"))
        deal = scratch.save(deal, f"deal{turn}")
        groups = deal.groupBy(*key).agg(F.sum(F.col("length") - F.col("k") + 1).alias("turns"), F.count(F.lit(1)).alias("seqs"), F.sum("w").alias("members"), F.min("low").alias("least"))
        groups = scratch.save(groups, f"groups{turn}").select(*key, "turns", "seqs", "members", "least")
        large = groups.where(F.col("turns") > TRIE_TURNS).drop("turns")
        held = scratch.save(deal.join(groups.where(F.col("turns") <= TRIE_TURNS).select(*key), key).join(rows, "low").where("depth >= k"), f"held{turn}")
        nodes = scratch.save(_tries(held), f"nodes{turn}")
        scratch.drop(f"held{turn}")
        found.append(nodes.drop("p1", "p2", "top"))
        tops.append(nodes.where("top").selectExpr("p1", "p2", "n_leaves", "saved_tokens"))
        if large.isEmpty():
            break
        members = scratch.save(deal.join(large, key), f"members{turn}")
        level = members.join(rows, "low").where("depth >= k").groupBy(*key, "k", "p1", "p2", "above", "seqs", "members", "least", "depth")
        same = [F.min(c) == F.max(c) for c in ("e1", "e2")]
        level = scratch.save(level.agg((same[0] & same[1] & (F.count(F.lit(1)) == F.col("seqs"))).alias("all"), *[F.min(c).alias(c) for c in ("e1", "e2", "chars")]), f"level{turn}")
        last = level.groupBy(*key).agg(F.min(F.when(~F.col("all"), F.col("depth"))).alias("parts"), F.max("depth").alias("most"))
        last = scratch.save(last.select(*key, F.coalesce(F.col("parts") - 1, F.col("most")).alias("d")), f"last{turn}")
        chain = level.join(last, key).where("depth <= d")
        # the key of the chain's last node
        onward = chain.groupBy(*key, "d").agg(*[F.expr(f"coalesce(bit_xor(CASE WHEN depth > k THEN e{i} END), 0)").alias(f"x{i}") for i in (1, 2)])
        onward = scratch.save(onward.select(*key, "d", F.expr("k1 ^ x1").alias("d1"), F.expr("k2 ^ x2").alias("d2")), f"onward{turn}")
        going = members.join(onward, key)
        ends = going.where("length = d").select("d1", "d2", F.col("low").alias("ends_of"))
        splits.append((scratch.save(chain.join(onward.drop("d"), key).join(ends, ["d1", "d2"], "left").drop("e1", "e2", "all", "seqs"), f"chain{turn}"), onward))
        active = scratch.save(going.where("length > d").select("low", "w", "length", "d1", "d2", "d", F.col("least").alias("above")), f"active{turn}")
        for name in ("members", "level", "last"):
            scratch.drop(f"{name}{turn}")
    for turn in reversed(range(len(splits))):
        sums = tops[turn + 1].groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        nodes = scratch.save(_chain_nodes(splits[turn][0].join(sums, ["d1", "d2"], "left")), f"split{turn}")
        found.append(nodes.drop("p1", "p2", "top"))
        tops[turn] = tops[turn].union(nodes.where("top").select("p1", "p2", "n_leaves", "saved_tokens"))
    below = tops[0].agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).first()
    sums = (told.conv_id, 0, None, told.n_convs, below.n_children, below.leaves or 1, below.saved or 0, told.ends_of)
    root = sequences.sparkSession.createDataFrame([] if told.conv_id is None else [sums], NODES)
    for more in found:
        root = root.unionByName(more)
    return root


def _chain_nodes(chain: DataFrame) -> DataFrame:
    """Rows of _BUILT for the nodes that all sequences of a large group share. Their characters are summed up from
    below by blocks, so that a chain of any length is many tasks' work."""
    group = ["k1", "k2"]
    block = F.floor(F.col("depth") / CHAIN)
    sums = chain.groupBy(*group, block.alias("block")).agg(F.sum("chars").alias("chars"))
    behind = Window.partitionBy(*group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "block", F.coalesce(F.sum("chars").over(behind), F.lit(0)).alias("later"))
    inside = Window.partitionBy(*group, "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = chain.withColumn("block", block).join(sums, [*group, "block"]).withColumn("upto", F.sum("chars").over(inside) + F.col("later"))
    last, first = F.col("depth") == F.col("d"), F.col("depth") == F.col("k")
    return rows.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(first, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("below", F.lit(0)) + (F.col("members") - 1) * F.col("upto")).alias("saved_tokens"),
        F.when(last, F.col("ends_of")).alias("ends_of"),
        "p1",
        "p2",
        first.alias("top"),
    )


def _ends(of: DataFrame) -> DataFrame:
    """(low, ends_sha256) of rows (low, conv): the members of a sequence pass in order, none is kept."""

    def run(batches):
        for low, members in groupby(rows_of(batches), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for n, (_, conv) in enumerate(members):
                digest.update(f",{conv}".encode() if n else str(conv).encode())
            yield low, digest.hexdigest()

    given = arrow_schema(of.schema["low"], "ends_sha256 string")
    rows = of.select("low", "conv").repartition("low").sortWithinPartitions("low", "conv")
    return rows.mapInArrow(lambda b: batches_of(run(b), given), "low long, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """A row for each node of the trie of conversations(conv_id, turn, role, text): conv_id, its smallest member;
    depth; parent_conv_id; n_convs, n_children, n_leaves, saved_tokens, and ends_sha256 of the members that end there.
    If rebuild is set conversations begin with turns of another one (families).

    Rows without a conv_id belong to no conversation and are left out. Rows go by turn, nulls first, those of one turn
    by role, the text's first characters and its hash; repeated rows are turns of their own. Null roles and texts count
    as empty; turns are told apart by 128 bits; texts of any length are hashed whole and cross no shuffle. An empty
    table gives no node. Other columns are left out, whatever their names."""
    scratch = Scratch(spark)
    turns = digested(scratch, conversations)
    if rebuild:
        turns, every = families(scratch, turns)
    else:
        turns = scratch.save(turns, "own")
        every = turns.select("conv").distinct()
    made = turns.select("conv", "depth", F.xxhash64(F.lit(1), "depth", "h1", "h2").alias("e1"), F.xxhash64(F.lit(2), "depth", "h1", "h2").alias("e2"), "chars")
    made = scratch.save(made, "made")
    # a conversation is the set of its turns, which tell their depths
    sums = made.groupBy("conv").agg(F.expr("bit_xor(e1)").alias("s1"), F.expr("bit_xor(e2)").alias("s2"), F.count(F.lit(1)).alias("length"))
    known = scratch.save(every.join(sums, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("s1", "s2", "length")]), "known")
    sequences = scratch.save(known.groupBy("s1", "s2", "length").agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("w")), "sequences")
    rows = scratch.save(made.join(sequences.select(F.col("low").alias("conv")), "conv").withColumnRenamed("conv", "low"), "rows")
    nodes = scratch.save(prefix_nodes(scratch, sequences.select("low", "w", "length"), rows), "nodes")
    several = known.join(sequences.where("w > 1").select("s1", "s2", "length", "low"), ["s1", "s2", "length"])
    alone = sequences.where("w = 1").select("low", F.sha2(F.col("low").cast("string").cast("binary"), 256).alias("ends_sha256"))
    ends = _ends(several).union(alone).withColumnRenamed("low", "ends_of")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends, "ends_of", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


ORACLE = f"""
WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id::VARCHAR")} % {SHARED} AS h FROM own),
made AS (SELECT c.conv_id, 0 AS mine, n, role, text FROM c JOIN own o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL SELECT conv_id, 1, n, role, text FROM own JOIN c USING (conv_id) WHERE n > h),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mine, n) AS depth FROM made),
paths AS (SELECT conv_id, depth, length(text) AS chars,
  sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM paths GROUP BY ALL),
ups AS (SELECT DISTINCT p.node, q.node AS up FROM paths p JOIN paths q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1),
kids AS (SELECT up AS node, count(*) AS n_children FROM ups GROUP BY up),
under AS (SELECT DISTINCT p.node, q.node AS low FROM paths p JOIN paths q ON q.conv_id = p.conv_id AND q.depth >= p.depth),
sums AS (SELECT u.node, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves
  FROM under u JOIN nodes n ON n.node = u.low LEFT JOIN kids k ON k.node = u.low GROUP BY u.node),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM paths p
  WHERE depth = (SELECT max(depth) FROM paths q WHERE q.conv_id = p.conv_id) GROUP BY node)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ups USING (node) LEFT JOIN nodes above ON above.node = ups.up LEFT JOIN ends USING (node)"""
