import numpy as np
import pytest

from catalift.llm import lattice
from tests.llm.plain import component_of

SCHEMA = "vec_id long, embedding array<float>, label int, n string, key int, component string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def _ok(v, label):
    return label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def _check(rows, got):
    """All links at the threshold, counts and components of a plain comparison."""
    links = []
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a == b and _ok(v, a) and _ok(w, b) and len(v) == len(w):
                x, y = (np.array(u, np.float32).astype(float) for u in (v, w))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= lattice.COSINE:
                    links.append((i, j))
    want = component_of(len(rows), links)
    counts = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    got = {r.vec_id: r for r in got}
    for i, (vec, _, _) in enumerate(rows):
        assert got[vec].n_links == counts[i]
        assert got[vec].component_id == rows[want[i]][0]
        assert got[vec].kept == (want[i] == i)
    return links


def _vectors(seed=3, n=60, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            v = (base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.2, 0.4])).astype(np.float32)
            rows.append((len(rows), v.tolist(), int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("cell", [4096, 4])
def test_links_equal_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(lattice, "CELL", cell)
    rows = _vectors()
    hot = [(1000 + i, [1.0 + i / 300, *[2.0] * 15], 1) for i in range(30)] + [(2000 + i, [5.0] * 16, 2) for i in range(50)]
    links = _check(rows + hot, lattice.near_vectors(_frame(spark, rows + hot).repartition(4)).collect())
    assert len(links) > 1500


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1)]
    rows += [(7, [0.0, 0.0], 1), (8, [0.0, 0.0], 1), (9, [1.0, nan], 1), (10, [1.0, nan], 1), (11, [inf, 1.0], 1)]
    rows += [(12, [1.0, None], 1), (13, [1.0, 0.0, 0.0], 1)]
    _check(rows, lattice.near_vectors(_frame(spark, rows)).collect())
    no_id = lattice.near_vectors(_frame(spark, [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)])).collect()
    assert sorted(map(tuple, no_id), key=str) == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)], key=str)


def test_empty(spark):
    assert lattice.near_vectors(_frame(spark, [])).count() == 0


def test_decoded_points_are_the_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    own = lattice.decode(y)
    double = np.rint(2 * own)
    assert np.allclose(double, 2 * own) and np.all(double.sum(axis=1) % 4 == 0)
    assert np.all(np.ptp(double % 2, axis=1) == 0)
    around = lattice.neighbours()
    assert around.shape == (240, 8) and np.allclose((around**2).sum(axis=1), 2)
    d0 = ((y - own) ** 2).sum(axis=1)
    assert np.all(d0[:, None] <= (((y - own)[:, None, :] - around[None]) ** 2).sum(axis=2) + 1e-12)


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.93 meet in some table."""
    rng = np.random.default_rng(7)
    n, dim = 2000, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=(n, dim))
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = lattice.COSINE * x + np.sqrt(1 - lattice.COSINE**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    met = np.zeros(n, bool)
    for _ in range(lattice.TABLES):
        a = rng.normal(size=(dim, 8)) / lattice.WIDTH
        cx, cy = lattice.cells(x @ a), lattice.cells(y @ a)
        met |= (cx[:, :1] == cy).all(axis=2).any(axis=1) | (cy[:, :1] == cx).all(axis=2).any(axis=1)
    assert met.mean() > 0.99
