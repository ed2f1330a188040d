import numpy as np
import pytest

from foliant.llm import lattice_links
from foliant.llm.common import roots


def spread(draw, n, cosine, d=64):
    a = draw.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = draw.normal(size=(n, d))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize(("cosine", "least"), [(0.9, 0.97), (0.95, 0.998), (0.99, 1.0)])
def test_recall(cosine, least):
    a, b = spread(np.random.default_rng(1), 2000, cosine)
    x, y = (lattice_links.cells(v).reshape(2000, lattice_links.TABLES, lattice_links.CELLS) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= least


def test_nearest_points():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 8)) * 2
    first, second, near, far = lattice_links.e8_points(x)
    for p in (first, second):
        assert (p.sum(axis=1) % 4 == 0).all() and ((p % 2 == p[:, :1] % 2).all())
    assert (near <= 1 + 1e-9).all() and (near <= far).all()  # the covering radius of E8 is 1


def test_links_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    a, b = spread(draw, 300, 0.93, 16)
    group, _ = spread(draw, 1, 1.0, 16)
    hot = group + draw.normal(size=(1500, 16)) * 0.03  # more than a block
    x = np.concatenate([a, b, hot, 3 * a[:20], a[:5]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS n_links", "1 AS node")
    got = {r.vec_id: r for r in lattice_links.lattice_links(spark, df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = np.triu(unit @ unit.T >= 0.9, 1)
    n, label = close.sum(axis=0) + close.sum(axis=1), roots(len(x), *np.nonzero(close))
    mine = np.array([got[k].n_links for k in range(len(x))])
    assert (mine <= n).all() and mine.sum() >= 0.99 * n.sum()
    assert np.mean([got[k].component_id == label[k] for k in range(len(x))]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e300, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in lattice_links.lattice_links(spark, df).collect()), key=repr)
    linked = [(7, 4, 7), (8, 4, 7), (8, 4, 7), (None, 4, 7), (10, 4, 7)]
    assert got == sorted([*((k, 0, k) for k in (1, 2, 3, 4, 5, 6, 9)), *linked, (None, 0, None)], key=repr)
    assert lattice_links.lattice_links(spark, df.where("false")).count() == 0
