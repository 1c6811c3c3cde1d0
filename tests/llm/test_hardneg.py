"""Hard negatives against brute force, and what the tree leaves closed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hardneg

SCHEMA = "id long, v array<double>, label int"


def brute(rows, positives=5, negatives=10, every=10):
    fine = [(i, [math.floor(256 * c) for c in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, y) in enumerate(fine):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, z) for m, (j, w, z) in enumerate(fine) if m != n)
        for s, j, _ in [t for t in scored if t[2] == y][:positives]:
            mine = [t for t in scored if t[2] != y and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(mine)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("row", F.lit("clash")).withColumn("leaf", F.lit(0))
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, "id", "v", "label", F.col("id") % 10 == 0, **kw).collect())


def clustered(seed, n, dim=6, centres=5):
    rng = random.Random(seed)
    c = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(c)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("leaf,cell,slot,sample", [(1024, 8192, 4096, 8192), (8, 5, 3, 100), (16, 1000, 7, 40)])
def test_against_brute_force(spark, monkeypatch, leaf, cell, slot, sample):
    for name, value in (("LEAF", leaf), ("CELL", cell), ("SLOT", slot), ("SAMPLE", sample), ("LEAST", 2), ("FIRST", 2)):
        monkeypatch.setattr(hardneg, name, value)
    rows = clustered(leaf, 240)
    rows += [(300 + i, rows[5][1], i % 3) for i in range(40)]  # equal vectors: ties by id, a leaf that cannot be halved
    rows += [(7, [1.0] * 6, 1), (7, [1.0] * 6, 1), (10, rows[10][1], 2), (10, rows[10][1], 2)]  # repeated ids and rows
    rows += [(400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 2), (410, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(420, [2.0, 1.0], 1), (430, [], 2), (440, [0.0] * 6, 1), (450, [-1.0] * 6, 3)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0, 0.0], 1)]) == []
    rows = [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [0.5, 0.5], 2), (13, [-1.0, 0.0], 2)]
    assert run(spark, rows) == brute(rows) == [(10, 11, 1, 12, 65536, 32768)]
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchor


def test_large_components(spark):
    rows = [(i, [float((i * 7919) % 4001 - 2000) * 60, float((i * 104729) % 3001 - 1500) * 60], i % 3) for i in range(60)]
    assert run(spark, rows) == brute(rows)  # products beyond 2^53 are added as whole numbers
    with pytest.raises(ValueError):
        run(spark, [(10, [1e9], 1), (11, [1.0], 1)])


def test_the_tree_routes_and_bounds_truly():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.2, (200, 5)) for c in (-3, 0, 3)])
    most = float((points**2).sum(axis=1).max())
    rows = hardneg._augmented(points, most)
    tree = hardneg.fit(rows, 8)
    leaf, far = tree.route(rows)
    n = len(tree.paths)
    assert n > 20 and set(leaf) <= set(range(n))
    least = [np.min([far[i] for i in np.flatnonzero(leaf == k)], axis=0).tolist() if (leaf == k).any() else [math.inf] * len(tree.paths[k]) for k in range(n)]
    greatest = [np.max([far[i] for i in np.flatnonzero(leaf == k)], axis=0).tolist() if (leaf == k).any() else [-math.inf] * len(tree.paths[k]) for k in range(n)]
    leaves = hardneg.Leaves(tree, np.bincount(leaf, minlength=n).tolist(), least, greatest, most, 5)
    low, high = leaves.bounds(points)
    true = np.sqrt(((np.concatenate((points, np.zeros((600, 1))), axis=1)[:, None] - rows[None]) ** 2).sum(axis=2))
    for k in range(n):
        assert (low[:, k, None] <= true[:, leaf == k] + 1e-6).all() and (high[:, k, None] >= true[:, leaf == k] - 1e-6).all()
    # anchors at the norm bound reach only part of the leaves once their k-th score is known
    lo, hi, reached = [[-(10**9)]] * 600, [[10**9]] * 600, [[float(np.sort(points @ p)[-10])] for p in points]
    opened = [set(a) | set(b) for a, b in zip(leaves.to_open(points, lo, hi, None), leaves.to_open(points, lo, hi, reached))]
    assert sum(map(len, opened)) < 0.6 * 600 * n
    for p, o in zip(points, opened):
        assert set(leaf[np.argsort(-(points @ p), kind="stable")[:10]]) <= o


def test_a_tree_of_equal_points_is_one_leaf():
    tree = hardneg.fit(np.ones((100, 3)), 2)
    assert tree.paths == [[]] and not tree.points
    assert (tree.route(np.zeros((4, 3)))[0] == 0).all()
