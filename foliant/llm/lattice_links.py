"""Embedding near-dedup by lattice hashing.

In each of several tables two random projections to eight dimensions are decoded to the nearest point
of the E8 lattice; the two points are the vector's cell, and cells with the next nearest point of
either are probed as well. Vectors that share a cell are compared by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, components, mix64, numbered, ranges, roots, shards_for, whole

#: Least cosine of a link.
COSINE = 0.9
#: Tables, cells of each (its own and the two probed ones), and lattice units that the unit sphere's
#: radius is long: at a cosine of 0.9 the tables meet 98.9 % of pairs, at 0.95 all but one in 10,000.
#: Measured by tests/llm/test_lattice_links.py.
TABLES, CELLS, SCALE = 14, 3, 0.5
#: Sign bits that sort out strangers who share a cell by chance: pairs at a cosine of 0.9 differ in
#: 36.8 of 256 bits with a deviation of 5.6, so that 70 loses one pair in a billion.
SIGN_WORDS, SIGN_RADIUS = 4, 70
#: Members of a cell that are compared at once (larger cells are dealt out as pairs of blocks), rows
#: of cells for a task, and pairs in one step.
BLOCK, TASK_ROWS, STEP = 1024, 200_000, 1_000_000


def e8_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest and the next nearest point of E8 (doubled, so that they are integers) and their squared
    distances. E8 is D8 (integers with an even sum) and D8 moved by a half."""
    points, far = [], []
    rows = np.arange(len(x))
    for half in (0.0, 0.5):
        base = np.rint(x - half)
        error = x - half - base
        order = np.argsort(-np.abs(error), axis=1)
        odd = base.sum(axis=1) % 2 != 0
        step = np.where(error >= 0, 1.0, -1.0)
        best, other = base.copy(), base.copy()
        a, b = order[:, 0], order[:, 1]
        # an odd sum is mended at the coordinate that loses least; next best is at another one, or at two
        best[rows[odd], a[odd]] += step[rows[odd], a[odd]]
        other[rows[odd], b[odd]] += step[rows[odd], b[odd]]
        even = ~odd
        for k in (a, b):
            other[rows[even], k[even]] += step[rows[even], k[even]]
        for p in (best, other):
            points.append(p + half)
            far.append(((x - p - half) ** 2).sum(axis=1))
    far_, points_ = np.stack(far), np.stack(points)
    order = np.argsort(far_, axis=0, kind="stable")[:2]
    first, second = points_[order[0], rows], points_[order[1], rows]
    return (2 * first).astype(np.int64), (2 * second).astype(np.int64), far_[order[0], rows], far_[order[1], rows]


def _hash_points(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), salt, np.uint64)
    for k in range(points.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + points[:, k].astype(np.int64).view(np.uint64))
    return h


def cells(unit: np.ndarray) -> np.ndarray:
    """Codes of the cells of each unit vector, CELLS for each table; the low six bits tell the table."""
    n, d = unit.shape
    out = np.empty((n, TABLES * CELLS), np.uint64)
    for t in range(TABLES):
        draw = np.random.default_rng([7, t, d])
        ends = []
        for block in range(2):
            first, second, _, _ = e8_points(unit @ (draw.standard_normal((d, 8)) * SCALE) + draw.random(8))
            ends.append([_hash_points(p, d * 1000 + t * 10 + block) for p in (first, second)])
        for k, (i, j) in enumerate(((0, 0), (1, 0), (0, 1))):
            out[:, t * CELLS + k] = mix64(ends[0][i] ^ mix64(ends[1][j] + np.uint64(1))) & np.uint64(2**64 - 64) | np.uint64(t)
    return out.view(np.int64)


def signs(unit: np.ndarray) -> np.ndarray:
    draw = np.random.default_rng([11, unit.shape[1]])
    return np.packbits(unit @ draw.standard_normal((unit.shape[1], 64 * SIGN_WORDS)) > 0, axis=1).view(np.uint64)


def unit_vector(x: list | None) -> bytes | None:
    """x in double precision, divided by its length; None where no cosine is defined."""
    if not x or any(v is None for v in x):
        return None
    v = np.array(x, np.float64)
    most = np.abs(v).max() if np.isfinite(v).all() else 0.0
    if not most:
        return None
    v = v / most  # so that no square overflows or vanishes
    return (v / np.sqrt(v @ v)).tobytes()


def _by_dimension(units: list[bytes]):
    """(numbers, matrix) of the vectors of each dimension."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, np.frombuffer(b"".join(units[i] for i in at.tolist()), np.float64).reshape(len(at), -1)


def _unit_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unit_vector(x) for x in batch.column(1).to_pylist()], pa.binary())], ["vec_id", "unit"])


def _node_rows(batches):
    for batch in batches:
        for at, unit in _by_dimension(batch.column("unit").to_pylist()):
            code, sign, held = cells(unit), signs(unit), batch.take(pa.array(at))
            blob = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
            yield pa.RecordBatch.from_arrays([*held.columns, blob(code), blob(sign)], [*held.schema.names, "cells", "signs"])


def _cell_rows(batches):
    for batch in batches:
        code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(batch), -1)
        # a vector whose two nearest points are alike may have a cell twice
        for t in range(TABLES):
            part = np.sort(code[:, t * CELLS : (t + 1) * CELLS], axis=1)
            new = np.c_[np.ones(len(part), bool), part[:, 1:] != part[:, :-1]]
            row, k = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(part[row, k]), batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))], ["cell", "node", "signs"])


def _sorted_units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (cell, low, high, node), and where each unit begins, with the end."""
    cell, low, high, node = (table.column(k).to_numpy() for k in ("cell", "low", "high", "node"))
    order = np.lexsort((node, high, low, cell))
    key = np.stack([cell[order], low[order], high[order]])
    new = np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)] if len(order) else np.zeros(0, bool)
    return order, np.r_[np.flatnonzero(new), len(order)]


def _likely(batches):
    """Rows that have a likely partner in their unit."""
    table = whole(batches)  # TASK_ROWS or so
    if table is None:
        return
    order, begin = _sorted_units(table)
    sign = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint64).reshape(-1, SIGN_WORDS)[order]
    block = table.column("block").to_numpy()[order]
    apart = (table.column("low").to_numpy() != table.column("high").to_numpy())[order]
    end = np.repeat(begin[1:], np.diff(begin))
    partners = end - np.arange(len(order)) - 1
    likely, at = np.zeros(len(order), bool), 0
    upto = np.cumsum(partners)
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, side="right")))
        rows = np.arange(at, to)
        a, b = np.repeat(rows, partners[at:to]), ranges(rows + 1, partners[at:to])
        near = (np.bitwise_count(sign[a] ^ sign[b]).sum(axis=1) <= SIGN_RADIUS) & (~apart[a] | (block[a] != block[b]))
        likely[a[near]] = likely[b[near]] = True
        at = to
    kept = table.take(pa.array(order[likely])).select(["cell", "low", "high", "block", "node"])
    yield from kept.combine_chunks().to_batches()


def _first_meeting(cell: int, a: np.ndarray, b: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether this cell is the first one that vectors a and b share, by table and then by code."""
    table = cell & 63
    alive = np.arange(len(a))
    for t in range(table):
        x, y = (codes[i[alive], t * CELLS : (t + 1) * CELLS] for i in (a, b))
        alive = alive[~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))]
    x, y = (codes[i[alive], table * CELLS : (table + 1) * CELLS] for i in (a, b))
    common = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int64).max).min(axis=1)
    first = np.zeros(len(a), bool)
    first[alive[common == cell]] = True
    return first


def _compared(batches):
    """(node, links, root): links that are counted in a unit, and the unit's first member that the node is linked to."""
    table = whole(batches)
    if table is None:
        return
    order, begin = _sorted_units(table)
    table = table.take(pa.array(order))
    node, block, copies, cell = (table.column(k).to_numpy() for k in ("node", "block", "copies", "cell"))
    apart = table.column("low").to_numpy() != table.column("high").to_numpy()
    codes = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.int64).reshape(len(table), -1)
    units = table.column("unit").to_pylist()
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        links, root = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
        for at, x in _by_dimension(units[lo:hi]):
            close = np.triu(x @ x.T >= COSINE, 1)
            if apart[lo]:
                close &= block[lo + at][:, None] != block[lo + at][None, :]
            a, b = (at[k] for k in np.nonzero(close))
            if not len(a):
                continue
            root = roots(hi - lo, np.r_[np.arange(hi - lo), a], np.r_[root, b])
            new = _first_meeting(int(cell[lo]), lo + a, lo + b, codes)
            np.add.at(links, a[new], copies[lo + b[new]])
            np.add.at(links, b[new], copies[lo + a[new]])
        some = np.flatnonzero((links > 0) | (root != np.arange(hi - lo)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[lo + some]), pa.array(links[some]), pa.array(node[lo + root[some]])], ["node", "links", "root"])


def lattice_links(spark: SparkSession, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept, a row for each row of vectors.

    Pairs that share a cell are linked at a cosine of COSINE or more; no other pair is. Equal vectors
    count once each in n_links and are one node. Vectors that are null, empty or zero, or hold null,
    NaN or infinite components, link with nothing and are their own component; so do vectors of
    different dimensions with each other. Null ids are left out of component_id (null where all are).
    Cells of any size are compared whole, in blocks of BLOCK members; an empty table gives an empty
    result; other columns are left out."""
    scratch = Scratch(spark)
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding)).mapInArrow(_unit_rows, f"vec_id {kind}, unit binary")
    # 128 bits tell vectors apart; a number stands for them from then on
    rows = scratch.save(rows.withColumns({"h": F.xxhash64("unit"), "g": F.xxhash64(F.lit(1), "unit")}), "rows")
    nodes = rows.where("unit IS NOT NULL").groupBy("h", "g").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    nodes = nodes.mapInArrow(_node_rows, f"h long, g long, unit binary, copies long, least {kind}, cells binary, signs binary")
    nodes = numbered(scratch, nodes, "nodes")

    # both sides written: a join of two plain shuffles is one that Spark splits where a cell is hot
    met = scratch.save(nodes.select("node", "cells", "signs").mapInArrow(_cell_rows, "cell long, node long, signs binary"), "met")
    sizes = met.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").selectExpr("cell", f"CAST(ceil(n / {BLOCK}) AS int) AS blocks")
    sizes = scratch.save(sizes, "sizes")
    # a cell of many members becomes pairs of blocks, each a unit of its own
    met = met.join(sizes, "cell").withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "signs")
    shards = shards_for(nodes.count() * TABLES * CELLS, TASK_ROWS)
    likely = met.repartition(shards, "cell", "low", "high").mapInArrow(_likely, "cell long, low int, high int, block int, node long")
    likely = scratch.save(likely, "likely")
    units = likely.join(nodes.select("node", "unit", "copies", "cells"), "node")
    shards = shards_for(likely.count(), TASK_ROWS // 8)
    found = units.repartition(shards, "cell", "low", "high").mapInArrow(_compared, "node long, links long, root long")
    found = scratch.save(found, "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(spark, scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.select("node", "h", "g", "copies", "least").join(links, "node", "left").join(joined, "node", "left")
    told = scratch.save(told.withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1}), "told")
    groups = scratch.save(told.groupBy("root").agg(F.min("least").alias("component")), "roots")
    told = scratch.save(told.join(groups, "root").select("h", "g", "links", "component"), "by_node")
    valid = rows.where("unit IS NOT NULL").join(told, ["h", "g"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x"""
