"""Distances over all rows against brute force."""

from collections import Counter

import numpy as np
import pytest

from flowmill.plans import neighbours


def brute(query, base):
    base = [b for b in base if b is not None and len(b) == 4 and all(x is not None and np.isfinite(x) for x in b)]
    out = []
    for key, q in query:
        if q is None or len(q) != 4 or not all(x is not None and np.isfinite(x) for x in q):
            out.append((key, None, None))
            continue
        d = sorted(float(np.sqrt(((np.array(q) - np.array(b)) ** 2).sum())) for b in base)
        out.append((key, *(d + [None, None])[:2]))
    return out


def same(got, want):
    text = lambda rows: Counter((k, None if a is None else f"{a:.9f}", None if b is None else f"{b:.9f}") for k, a, b in rows)
    assert text(got) == text(want)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    clusters = rng.normal(size=(6, 4)) * 20
    base = [*(clusters[rng.integers(0, 6, 400)] + rng.normal(size=(400, 4)) * 0.2).tolist(),
            *(rng.normal(size=(300, 4)) * 1e-3).tolist(),  # one dense cell
            *[[1.0, 2.0, 3.0, 4.0]] * 200, [1e6, -1e6, 0.0, 0.0], [1e6, -1e6, 0.0, 1e-3]]
    query = [(i, x) for i, x in enumerate((clusters[rng.integers(0, 6, 150)] + rng.normal(size=(150, 4)) * 0.3).tolist())]
    query += [(200 + i, x) for i, x in enumerate((rng.normal(size=(120, 4)) * 2e-3).tolist())]
    query += [(400, base[3]), (400, base[3]), (None, base[5]), (401, [1.0, 2.0, 3.0, 4.0]), (402, [1e6, -1e6, 0.0, 2e-3]),
              (403, None), (404, [None, 1.0, 1.0, 1.0]), (405, [float("nan")] * 4), (406, [1.0]), (None, None)]
    odd = [None, [1.0], [float("inf")] * 4, [None] * 4]
    return query, base + odd


@pytest.mark.parametrize("block_bytes", [200, 3000, 1 << 20])
def test_all_rows_as_brute_force(spark, rows, block_bytes):
    query, base = rows
    q = spark.createDataFrame(query, "id long, v array<double>").repartition(3)
    b = spark.createDataFrame([(x,) for x in base], "v array<double>").repartition(4)
    same([tuple(r) for r in neighbours.nearest_two(q, b, block_bytes=block_bytes).collect()], brute(query, base))


def test_few_and_no_base_rows(spark, rows):
    query = rows[0][-14:]
    q = spark.createDataFrame([(str(k), v) for k, v in query], "name string, v array<double>")
    for base in ([], [None], [[0.0] * 4], [[0.0] * 4] * 2, [[0.0] * 4, [1.0] * 4]):
        b = spark.createDataFrame([(x,) for x in base], "v array<double>")
        got = [tuple(r) for r in neighbours.nearest_two(q, b, "v", "name").collect()]
        same(got, brute([(str(k), v) for k, v in query], base) if base not in ([], [None]) else [(str(k), None, None) for k, _ in query])
    assert neighbours.nearest_two(q.limit(0), b, "v", "name").count() == 0


def test_rings_out_of_reach_are_not_visited():
    rng = np.random.default_rng(7)
    groups = rng.normal(size=(50, 3)) * 100
    points = groups[rng.integers(0, 50, 3000)] + rng.normal(size=(3000, 3))
    pivots = points[:100]
    apart = np.sqrt(((pivots[:, None] - pivots) ** 2).sum(2))
    cell = ((points[:, None] - pivots) ** 2).sum(2).argmin(1)
    dist = np.sqrt(((points - pivots[cell]) ** 2).sum(1))
    rows = groups[0] + rng.normal(size=(200, 3))
    best = neighbours.two_nearest(rows, points, np.ones(len(points), int))
    cells, low, high = neighbours.rings_in_reach(rows, best, pivots, apart)
    assert len(cells) < 20
    ring = {c: (a, b) for c, a, b in zip(cells.tolist(), low, high)}
    every = np.sqrt(((rows[:, None] - points) ** 2).sum(2))
    for p in set(np.nonzero(every <= best[:, 1:] * (1 + 1e-12))[1].tolist()):
        assert ring[cell[p]][0] <= dist[p] <= ring[cell[p]][1]
