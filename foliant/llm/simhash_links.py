"""SimHash near-dedup with BK-trees.

Fingerprints are dealt to shards by the values of their bands; each shard has a BK-tree, whose
children are keyed by their integer Hamming distance to the parent, and every fingerprint of the
shard follows only the edges within the radius. The shards' trees grow with the input, so a shuffle
brings them to the tasks that search them; a broadcast of all of them would have no size bound.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliant.llm.common import Scratch, column_bytes, components, free_names, fresh, mix64, numbered, ranges, roots, shards_for, small_batches, whole

SEED = 42
#: The contract's fingerprint and links: 64 bits of three-word shingles, 3 differing bits.
SHINGLE, RADIUS = 3, 3
#: Near copies: sets of shingles of five words, 256 bits. Sets with a Jaccard similarity of 0.8 agree in
#: 84.9 % of the bits and differ in 39 with a deviation of 5.7, so that 4 deviations more are candidates.
#: The sets themselves decide: COPY_SHARE is their similarity.
COPY_SHINGLE, COPY_WORDS, COPY_RADIUS, COPY_SHARE = 5, 4, 62, (4, 5)
COPY_AGREE, COPY_RECALL, LEAST_BANDS = 0.849, 0.998, 40
#: Strangers that a shard holds whatever the number of rows; of links by pigeonhole, where trees prune, more.
STRANGERS, PRUNED_STRANGERS = 64, 2048
#: Rows of bands a task handles, distances computed at once, and fingerprints of a tree: a larger shard
#: is dealt out as pairs of blocks.
SHARD_ROWS, AT_ONCE, BLOCK = 300_000, 2_000_000, 250_000
#: Shingles of a block of candidates; a larger group of candidates is dealt out as pairs of blocks.
SET_BLOCK = 1_000_000


def exact_bands(rows: int) -> list[np.ndarray]:
    """Bits of each band, so that fingerprints at RADIUS differing bits agree in one band at least: of m
    blocks of bits RADIUS are hit at most, and every choice of m - RADIUS blocks is a band. More rows
    have more blocks and so wider bands."""
    for m in range(RADIUS + 1, RADIUS + 5):
        blocks = np.array_split(np.arange(64), m)
        bands = [np.concatenate(x) for x in combinations(blocks, m - RADIUS)]
        if rows >> min(map(len, bands)) <= PRUNED_STRANGERS:
            break
    return bands


def copy_bands(rows: int) -> list[np.ndarray]:
    """Bits of each band of fingerprints of sets: so many that a shard has STRANGERS, and as many bands,
    drawn from all bits, as find COPY_RECALL of the pairs at the limit."""
    width = max(8, math.ceil(math.log2(max(rows, 1) / STRANGERS)))
    count = max(LEAST_BANDS, math.ceil(math.log(1 - COPY_RECALL) / math.log1p(-(COPY_AGREE**width))))
    draw = np.random.default_rng([3, width])
    return [np.sort(draw.choice(64 * COPY_WORDS, width, replace=False)) for _ in range(count)]


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none for a text without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash_(line, SEED)], np.uint64)
    starts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[size - 1 :].tolist()
    return np.array([hash_(line[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 bits a word, big-endian; a bit is 1 if it is set in over half of the hashes. Words after the
    first take their bits from the hashes mixed with the word's number."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = hashes[at : at + (1 << 15)]
        each = np.stack([h if k == 0 else mix64(h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) for k in range(words)], axis=1)
        ones += np.unpackbits(each.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(shingle_hashes(x, shingle), words) for x in column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


class Forest:
    """A BK-tree for each shard, all of them grown level by level: the first fingerprint of a subtree
    is its node, and the others go below it by their distance, as inserting one by one would do."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray, radius: int) -> None:
        self.fps, self.radius, n = fps, radius, len(fps)
        self.parent, self.edge, levels = np.full(n, -1), np.zeros(n, np.int64), []
        active, below = np.arange(n), np.unique(shard, return_inverse=True)[1]
        self.root = np.zeros(n, np.int64)
        while len(active):
            order = np.argsort(below, kind="stable")
            active, below = active[order], below[order]
            first = np.r_[True, below[1:] != below[:-1]]
            node = active[first][np.cumsum(first) - 1]
            levels.append(active[first])
            if len(levels) == 1:
                self.root[active] = node
            active, node = active[~first], node[~first]
            d = self.distance(active, node)
            self.parent[active], self.edge[active] = node, d
            below = np.unique(node * 1024 + d, return_inverse=True)[1]
        inner = np.flatnonzero(self.parent >= 0)
        key = self.parent[inner] * 1024 + self.edge[inner]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], inner[order]
        near = inner[self.edge[inner] <= radius]
        self.label = roots(n, near, self.parent[near])
        # a subtree whose fingerprints are all linked already needs no visit from one of them
        low, high = self.label.copy(), self.label.copy()
        for nodes in reversed(levels[1:]):
            np.minimum.at(low, self.parent[nodes], low[nodes])
            np.maximum.at(high, self.parent[nodes], high[nodes])
        self.uniform = low == high

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1, dtype=np.int64)

    def linked(self) -> np.ndarray:
        """The first member of each fingerprint's group of links."""
        n, r = len(self.fps), self.radius
        widest = int(np.bincount(self.root, minlength=1).max()) if n else 1
        step, found = max(1, AT_ONCE // widest), []
        for at in range(0, n, step):
            query = np.arange(at, min(n, at + step))
            node = self.root[query]
            while len(query):
                useful = ~(self.uniform[node] & (self.label[node] == self.label[query]))
                query, node = query[useful], node[useful]
                d = self.distance(query, node)
                hit = (d <= r) & (self.label[query] != self.label[node])
                found.append((query[hit], node[hit]))
                low = np.searchsorted(self.key, node * 1024 + np.maximum(d - r, 0))
                high = np.searchsorted(self.key, node * 1024 + np.minimum(d + r, 1023), side="right")
                query, node = np.repeat(query, high - low), self.child[ranges(low, high - low)]
        a = np.concatenate([np.arange(n), *[x for x, _ in found]])
        b = np.concatenate([self.label, *[x for _, x in found]])
        return roots(n, a, b)


def _bands(words: int, bands: list[np.ndarray]):
    """(shard, node, fp): a row for each band."""

    def run(batches):
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8)).reshape(-1, 64 * words)
            for k, at in enumerate(bands):
                shard = bits[:, at] @ (1 << np.arange(len(at))[::-1]) | k << 40
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1)], ["shard", "node", "fp"])

    return run


def _in_blocks(scratch: Scratch, rows: DataFrame, key: str, size: str, most: int, name: str) -> DataFrame:
    """rows with low and high: a key whose rows sum up to more than most is dealt out as pairs of blocks, of
    which each row is in those with its own block."""
    large = rows.groupBy(key).agg(F.sum(F.expr(size)).alias("total")).where(F.col("total") > most)
    large = scratch.save(large.selectExpr(key, f"CAST(ceil(total / {most}) AS int) AS blocks"), name)
    if large.isEmpty():
        return rows.withColumns({"low": F.lit(0), "high": F.lit(0)})
    # Spark broadcasts the keys by their size, or splits the join of two plain shuffles
    dealt = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumns({"own": F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "own", "other")


def _links(words: int, radius: int):
    def run(batches):
        table = whole(batches)  # SHARD_ROWS rows or so
        if table is None:
            return
        shard, low, high, node = (table.column(k).to_numpy() for k in ("shard", "low", "high", "node"))
        fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
        order = np.lexsort((node, high, low, shard))
        key = np.stack([shard[order], low[order], high[order]])
        same = (key[:, 1:] == key[:, :-1]).all(axis=0)
        some = np.r_[False, same] | np.r_[same, False]
        unit, order = np.cumsum(np.r_[True, ~same])[some], order[some]
        node, fps = node[order], fps[order]
        if len(node):
            first = Forest(unit, fps, radius).linked()
            moved = np.flatnonzero(first != np.arange(len(first)))
            pairs = np.unique(np.stack([node[moved], node[first[moved]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _candidates(spark: SparkSession, scratch: Scratch, nodes: DataFrame, words: int, radius: int, bands_for) -> DataFrame:
    """(node, root) of the nodes(node, fp) that links within the radius join to a smaller one."""
    count = nodes.count()
    bands = bands_for(count)
    met = nodes.select("node", "fp").mapInArrow(_bands(words, bands), "shard long, node long, fp binary")
    if count > BLOCK:  # else no shard can be larger
        met = _in_blocks(scratch, met, "shard", "1L", BLOCK, "large_shards")
    else:
        met = met.withColumns({"low": F.lit(0), "high": F.lit(0)})
    dealt = met.repartition(shards_for(count * len(bands), SHARD_ROWS), "shard", "low", "high")
    return components(spark, scratch, dealt.mapInArrow(_links(words, radius), "a long, b long"))


def _by_node(scratch: Scratch, nodes: DataFrame, roots_of: DataFrame) -> DataFrame:
    """The nodes that are linked, with component_id, the smallest id of the component."""
    both = roots_of.union(roots_of.select("root", "root").distinct())
    linked = scratch.save(nodes.drop("fp", "n").join(both, "node"), "linked")
    # all written: a join of two plain shuffles is one that Spark splits where a component is hot
    groups = scratch.save(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return scratch.save(linked.join(groups, "root").drop("root", "least"), "by_node")


def simhash_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row of docs(doc_id, text).

    Texts are lower-cased in A-Z and split at ASCII white space; fewer words than a shingle are one
    shingle; null texts and texts without words have fingerprint zero and are linked like any other;
    a text of any length counts whole. Rows of one fingerprint, repeated rows among them, are one node,
    so that no group of copies is compared with itself. component_id is the smallest id that links
    reach, null ids left out (null where all are). An empty table gives an empty result; other columns
    are left out."""
    scratch = Scratch(spark)
    # XXH64 of eight bytes is one to one: no two fingerprints share a node
    rows = scratch.save(fingerprints(docs, SHINGLE, 1).withColumn("node", F.xxhash64("fp")), "fingerprints")
    nodes = scratch.save(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")), "nodes")
    linked = _by_node(scratch, nodes, _candidates(spark, scratch, nodes, 1, RADIUS, exact_bands))
    alone = nodes.join(linked.select("node"), "node", "left_anti").select("node", F.col("least").alias("component_id"))
    by_node = scratch.save(linked.select("node", "component_id").union(alone), "components")
    return rows.join(by_node, "node").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Of every row's set of five-word shingles: doc_id, h and g (its hash of 128 bits), fp and n (its size)."""

    def run(batches):
        for batch in fresh(batches):
            hashes, fps, sizes = [], [], []
            for x in column_bytes(batch.column(1)):
                own = np.unique(shingle_hashes(x, COPY_SHINGLE))
                hashes.append(node_of(own))
                fps.append(fingerprint(own, COPY_WORDS))
                sizes.append(len(own))
            h, g = np.array(hashes, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h), pa.array(g), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "h", "g", "fp", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, g long, fp binary, n long")


def node_of(own: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes(), SEED), np.int64).tolist())


def copies(sets: list[np.ndarray]) -> np.ndarray:
    """The first member of each set's group, of links between sets whose similarity is COPY_SHARE or more.

    One set is compared with all at a time. That is needed only for sets outside the largest group, as a
    link between two groups is found from either end, so that a dense group costs a few comparisons."""
    count, label, led = len(sets), np.arange(len(sets)), np.zeros(len(sets), bool)
    size = np.array([len(x) for x in sets], np.int64)
    code, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(count), size)
    ends, held = np.cumsum(size), np.zeros(len(code), bool)
    over, under = COPY_SHARE
    while True:
        waiting = np.flatnonzero(~led)
        largest = np.bincount(label[waiting]).argmax() if len(waiting) else 0
        waiting = waiting[label[waiting] != largest]
        if not len(waiting):
            return label
        i = waiting[0]
        own = code[ends[i] - size[i] : ends[i]]
        held[own] = True
        both = np.bincount(owner[held[code]], minlength=count)
        held[own] = False
        near = np.unique(label[(under * both >= over * (size + size[i] - both)) & (both > 0) | (np.arange(count) == i)])
        label[np.isin(label, near)] = near[0]
        led[i] = True


def _sets(batches):
    """(root, node, n, shingles) of candidates (root, node, h, g, text). Ids may repeat: texts of another node are left out."""
    for batch in fresh(batches):
        out = []
        for root, node, h, g, text in zip(*(batch.column(k).to_pylist() for k in range(4)), column_bytes(batch.column(4)), strict=True):
            own = np.unique(shingle_hashes(text, COPY_SHINGLE))
            if node_of(own) == (h, g):
                out.append((root, node, len(own), own.tobytes()))
            if len(out) >= 500:  # sets are long
                yield _dealt(out)
                out = []
        if out:
            yield _dealt(out)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["root", "node", "n", "shingles"])


def _checked(batches):
    """(a, b): links between candidates whose sets are similar."""
    table = whole(fresh(batches))  # SET_BLOCK * 2 shingles or so
    if table is None:
        return
    root, low, high, node = (table.column(k).to_numpy() for k in ("root", "low", "high", "node"))
    order = np.lexsort((node, high, low, root))
    key = np.stack([root[order], low[order], high[order]])
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        members = order[at:end]
        members = members[np.r_[True, node[members[1:]] != node[members[:-1]]]]
        first = copies([np.frombuffer(x, np.uint64) for x in table.column("shingles").take(pa.array(members)).to_pylist()])
        moved = np.flatnonzero(first != np.arange(len(first)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(node[members[moved]]), pa.array(node[members[first[moved]]])], ["a", "b"])


def near_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the near copies of a document with a smaller id.

    Near copies are linked at a Jaccard similarity of 0.8 or more of their sets of five-word shingles.
    256-bit fingerprints of the sets bring candidates together, the sets themselves decide. Equal sets
    are one node; so are null texts and texts without words, whose set is empty: the one with the
    smallest id stays. Rows without an id stay and link nothing; rows that share the id that stays all
    stay. Of rows that share another id but not their text each goes or stays by its own set. A text of any length counts whole; an empty table gives an empty result; columns stay as they are."""
    named, scratch = docs.where("doc_id IS NOT NULL"), Scratch(spark)
    with small_batches(spark):
        rows = scratch.save(shingle_sets(named), "sets")
    nodes = rows.groupBy("h", "g").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    nodes = numbered(scratch, nodes, "nodes")
    found = _candidates(spark, scratch, nodes, COPY_WORDS, COPY_RADIUS, copy_bands)
    members = found.union(found.select("root", "root").distinct()).join(nodes.select("node", "h", "g", "least"), "node")
    members = scratch.save(members, "members")
    texts = named.select("doc_id", "text").join(members.withColumnRenamed("least", "doc_id"), "doc_id").select("root", "node", "h", "g", "text")
    sets = scratch.save(texts.mapInArrow(_sets, "root long, node long, n long, shingles binary"), "shingles")
    total = sets.agg(F.sum("n")).first()[0] or 0
    dealt = _in_blocks(scratch, sets, "root", "n", SET_BLOCK, "large_groups") if total > SET_BLOCK else sets.withColumns({"low": F.lit(0), "high": F.lit(0)})
    dealt = dealt.repartition(shards_for(total, SET_BLOCK), "root", "low", "high")
    linked = _by_node(scratch, nodes, components(spark, Scratch(spark), dealt.mapInArrow(_checked, "a long, b long")))
    scratch.drop("shingles")
    alone = nodes.where("copies > 1").join(linked.select("node"), "node", "left_anti").withColumn("component_id", F.col("least"))
    told = scratch.save(linked.select("h", "g", "component_id").union(alone.select("h", "g", "component_id")), "told")
    away = rows.join(told, ["h", "g"]).where("doc_id <> component_id").groupBy("doc_id", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    away = scratch.save(away, "gone")
    gone = away.groupBy("doc_id").agg(F.sum("n").alias("n"))
    shared = rows.select("doc_id").join(gone, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("all"), F.first("n").alias("n")).where("`all` > n")
    shared = scratch.save(shared.select("doc_id"), "shared")
    kept = docs.join(gone.select("doc_id").join(shared, "doc_id", "left_anti"), "doc_id", "left_anti").select(*docs.columns)
    if shared.isEmpty():
        return kept
    # ids of several rows, of which some stay: each of these rows goes by its own set
    own, h, g, same = free_names(docs, "own_set", "set_h", "set_g", "same_id")
    asked = kept.join(shared, "doc_id", "left_semi").withColumn(own, set_hash(F.col("text")))
    sets = away.select(F.col("doc_id").alias(same), F.col("h").alias(h), F.col("g").alias(g))
    stays = asked.join(sets, (F.col("doc_id") == F.col(same)) & (F.col(own)["h"] == F.col(h)) & (F.col(own)["g"] == F.col(g)), "left_anti")
    return kept.join(shared, "doc_id", "left_anti").select(*docs.columns).union(stays.select(*docs.columns))


@F.arrow_udf(StructType([StructField("h", LongType()), StructField("g", LongType())]))
def set_hash(text: pa.Array) -> pa.Array:
    """The hash of a text's set of shingles, as shingle_sets gives it."""
    found = np.array([node_of(np.unique(shingle_hashes(x, COPY_SHINGLE))) for x in column_bytes(text)], np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["h", "g"])
