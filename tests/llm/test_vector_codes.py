"""Product codes against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from flowmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error string"


def plain(rows, parts, entries, rounds):
    width = max((len(v) for _, v, _ in rows if v), default=0)
    kept = [(i, [int(np.floor(256 * x)) for x in v], l) for i, v, l in rows
            if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    w = width // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[list(cut[k][p]) for k in order[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(books[p], c[p])[1], []).append(c[p])
            for k, group in groups.items():
                books[p][k] = [sum(x) // len(group) for x in zip(*group)]
    out, totals = [], Counter()
    for (i, _, l), c in zip(kept, cut):
        near = [nearest(books[p], c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), l))
        totals[l] += out[-1][2]
    return Counter((*r, totals[r[3]]) for r in out), ",".join(str(x) for b in books for e in b for x in e)


def vectors(n, width, seed, step):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1) / step) * step for _ in range(width)], rng.choice(["a", "b", None])) for i in range(n)]
    odd = [(None, [0.5] * width, "a"), (3, [0.25] * width, "b"), (3, [0.25] * width, "b"), (900, None, "a"), (901, [], "a"),
           (902, [0.5] * (width - 1), "a"), (903, [None] + [0.5] * (width - 1), "a"), (904, [float("nan")] * width, None),
           (905, [float("-inf")] * width, "c"), (906, [-1000.0] * width, "far")]
    return rows + odd


@pytest.mark.parametrize("n, width, parts, entries, step, bits, most",
                         [(300, 8, 4, 16, 0.01, 5, 8192), (200, 6, 2, 64, 0.5, 3, 8192), (200, 4, 4, 8, 0.25, 7, 3), (5, 4, 2, 64, 0.1, 5, 8192)])
def test_codes_are_those_of_plain_assignment(spark, n, width, parts, entries, step, bits, most):
    rows = vectors(n, width, n, step)
    table = spark.createDataFrame([(*r, "given", "given") for r in rows], SCHEMA).repartition(3)
    coded, books = vector_codes.compress(table, parts=parts, entries=entries, bits=bits, most_cells=most, block=50)
    want, text = plain(rows, parts, entries, 2)
    assert books.text() == text
    assert Counter((r.vec_id, r.code, r.error, r.label, r.label_error) for r in coded.collect()) == want


def test_colliding_cells_evaluate_every_entry():
    rng = np.random.default_rng(2)
    book, points = rng.integers(-200, 200, (32, 3)), rng.integers(-200, 200, (500, 3))
    cells = vector_codes.Cells(book, 5, 100)
    cells.weights[:] = 0  # all cells share one hash
    index, distance = cells.nearest(points)
    every = ((points[:, None] - book) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_cells_prune():
    rng = np.random.default_rng(3)
    book = rng.integers(-100, 100, (64, 4))
    cells = vector_codes.Cells(book, 5, 8192)
    cells.nearest(rng.integers(-100, 100, (2000, 4)))
    assert cells.masks.sum(1).mean() < 40


def test_refused(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 3, "a")], "vec_id long, embedding array<double>, label string"))
