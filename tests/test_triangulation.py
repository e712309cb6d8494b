"""Triangulations made in parts: the same as one of all points at once, and no task that has all of them."""

import numpy as np
import pytest

from tesserax.operators import triangulation as T

R = np.random.default_rng(7)
KINDS = {
    "random": R.random((3000, 2)) * 7,
    "lattice": 120 + R.integers(0, [70, 60], (3000, 2)) / 64.0,
    "decimal": np.round(R.random((2500, 2)) * 2, 2),
    "clusters": np.concatenate([R.normal(0, 0.01, (1500, 2)), R.normal(5, 1, (1500, 2)), R.normal(5.5, 0.001, (500, 2))]),
    "ring": np.column_stack([np.cos(np.arange(900)), np.sin(np.arange(900))]) + np.repeat([[0, 0], [5, 1], [2, 9]], 300, axis=0),
    "line": np.column_stack([np.arange(500.0), np.arange(500.0)]),
}




def test_parts_make_the_same_triangulation(spark):
    groups = {k: np.unique(p, axis=0) for k, p in KINDS.items()}
    points = spark.createDataFrame([(None if k == "random" else k, float(x), float(y)) for k, p in groups.items() for x, y in p], "species string, lon double, lat double")
    rows = T.triangulated(points, few=60, cell=300).collect()
    for k, p in groups.items():
        mine = [r for r in rows if (r.species or "random") == k]
        got = sorted(((r.x1, r.y1), (r.x2, r.y2), (r.x3, r.y3)) for r in mine if r.x3 is not None)
        assert got == sorted(tuple(map(tuple, t)) for t in T.corners(p, T.delaunay(p)).tolist()), k
        assert all(t[2] == min(t) for t in got)
        edges, around = np.unique(np.sort(T.delaunay(p)[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2), axis=1), axis=0, return_counts=True)
        side = p[edges[around == 1]]
        want = [] if k == "line" else [(pytest.approx(np.hypot(*(side[:, 0] - side[:, 1]).T).sum()), len(side))]
        assert [(r.x1, r.y1) for r in mine if r.x3 is None] == want


def test_no_task_has_all_points(spark, monkeypatch):
    """Of 30,000 points the last task, which triangulates step by step, has those around the species only."""
    from pyspark.sql import DataFrame

    p = np.unique(120 + R.integers(0, [700, 600], (30_000, 2)) / 64.0, axis=0)
    points = spark.createDataFrame([("a", float(x), float(y)) for x, y in p], "species string, lon double, lat double")
    stored, keep = [], T.materialise
    monkeypatch.setattr(T, "materialise", lambda df: stored.append(keep(df)) or stored[-1])
    out = T.triangulated(points, few=500, cell=8000)
    assert isinstance(out, DataFrame) and out.filter("x3 is not null").count() == len(T.delaunay(p))
    left = [x.filter("x3 is null").count() for x in stored if "x3" in x.columns][:-1]  # the last table is the last task's
    assert len(left) > 1 and left[0] < 6000 and left[-1] < 3000


@pytest.mark.parametrize("kind", ["random", "lattice", "decimal", "clusters", "ring"])
def test_stars_of_points(kind):
    p = np.unique(KINDS[kind], axis=0)
    whole = T.delaunay(p)
    done, *t = T.stars(p[:, 0], p[:, 1], np.ones(len(p), dtype=bool), 1.0)
    want = {tuple(x) for x in np.sort(whole[done[whole].any(axis=1)], axis=1).tolist()}
    assert {tuple(x) for x in np.sort(np.column_stack(t), axis=1).tolist()} == want
    assert done.mean() > 0.8 or kind == "ring"
