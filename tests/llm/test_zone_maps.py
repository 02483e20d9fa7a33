import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import zone_maps


def plain(rows, k=40, rounds=5, dim=64):
    """(id, cluster, distance) of rows (id, vector), with Python's whole numbers, and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return [(i, c, min(d, 2**63 - 1)) for i, c, d in found], cents


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("taken")).withColumn("v", F.lit(1))


def check(spark, rows):
    want, cents = plain(rows)
    got = zone_maps.report(table(spark, rows)).collect()
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    for r in got:
        assert r.cluster_inertia == min(per[r.cluster], 2**63 - 1) and r.inertia == min(sum(per.values()), 2**63 - 1)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()


def test_equal_to_plain_rounds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 64)) + 2 * rng.normal(size=(9, 64)).repeat(100, 0)
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_ties_copies_and_rows_without_a_place(spark):
    one = [1.0, -0.003] + [0.0] * 62
    rows = [(i, [float((i >> (j % 5)) & 1) for j in range(64)]) for i in range(200)] + [(7, one)] * 300 + [(None, one), (None, None), (1, None), (2, one[:63]), (3, [float("nan")] * 64), (4, [float("inf")] * 64), (5, [None] * 64), (6, []), (8, [-1e-30] * 64)]
    check(spark, rows)


def test_few_rows_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    check(spark, rows)
    assert zone_maps.report(table(spark, rows).limit(0)).collect() == []
    assert zone_maps.report(table(spark, [(1, None)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(1)
    check(spark, [(i, (v * 10.0 ** (i % 20)).tolist()) for i, v in enumerate(rng.normal(size=(60, 64)))])


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), -1).reshape(-1, axes)
    key = zone_maps.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_leave_out_centroids_and_never_the_nearest():
    rng = np.random.default_rng(2)
    cents = np.floor(rng.normal(size=(40, 64)) * 256)
    shares = []
    for _ in range(200):
        x = np.floor(cents[rng.integers(40)] + 40 * rng.normal(size=(128, 64)))
        which = zone_maps.candidates(x.min(0), x.max(0), cents)
        d = ((x[:, None] - cents) ** 2).sum(2)
        assert set(d.argmin(1).tolist()) <= set(which.tolist())
        shares.append(len(which) / 40)
    assert np.mean(shares) < 0.5
