"""Polygons that meet, lie in each other or are invalid: cell by cell, known cases, and outlines of many edges."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tesserax.operators import topology as T

RINGS = "pid int, part int, ring int, xs array<double>, ys array<double>"


def rings(spark, *polygons):
    """rings of (pid, [ring, ...]) or (pid, [[ring, hole, ...], ...]) of points."""
    rows = []
    for pid, parts in polygons:
        parts = parts if isinstance(parts[0][0], list) else [parts]
        rows += [(pid, p, k, [float(x) for x, _ in r], [float(y) for _, y in r]) for p, own in enumerate(parts) for k, r in enumerate(own)]
    return spark.createDataFrame(rows, RINGS)


def skyline(r):
    """(outline, cells) of columns of unit cells on a common base, some turned by a right angle."""
    x0, y0, heights = r.randrange(8), r.randrange(8), [r.randrange(1, 5) for _ in range(r.randrange(1, 5))]
    points, cells = [(x0, y0)], set()
    for k, h in enumerate(heights):
        points += [(x0 + k, y0 + h), (x0 + k + 1, y0 + h)]
        cells |= {(x0 + k, y0 + j) for j in range(h)}
    points.append((x0 + len(heights), y0))
    if r.random() < 0.5:
        points, cells = [(y, x) for x, y in points], {(y, x) for x, y in cells}
    clean = [p for k, p in enumerate(points) if p != points[k - 1]]
    return [*clean, clean[0]], cells


def test_skylines_cell_by_cell(spark):
    r = random.Random(2)
    own = {k: skyline(r) for k in range(60)}
    df = rings(spark, *((k, [o]) for k, (o, _) in own.items()))
    touch = lambda a, b: any((x + i, y + j) in b for x, y in a for i in (-1, 0, 1) for j in (-1, 0, 1))
    want = {(i, j) for i, (_, a) in own.items() for j, (_, b) in own.items() if touch(a, b)}
    assert {tuple(x) for x in T.objects_intersecting(df, df).collect()} == want and len(want) < 3600
    want = {(i, j) for i, (_, a) in own.items() for j, (_, b) in own.items() if a <= b}
    assert {tuple(x) for x in T.objects_within(df, df).collect()} == want and len(want) > 70
    assert T.invalid_polygons(df).count() == 0


def box(x, y, w, h):
    return [(x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y)]


def test_holes_bays_and_chords(spark):
    frame = [box(0, 0, 10, 10), box(2, 2, 6, 6)]
    bay = [(0, 0), (0, 10), (3, 10), (3, 4), (7, 4), (7, 10), (10, 10), (10, 0), (0, 0)]
    outer = rings(spark, (1, frame), (2, [bay]), (3, [[box(0, 0, 4, 4)], [box(6, 6, 4, 4)]]))
    inner = rings(
        spark, (10, [box(3, 3, 1, 1)]), (11, [box(0, 0, 2, 2)]), (12, [box(2, 2, 6, 6)]), (13, [[(3, 10), (7, 10), (5, 2), (3, 10)]]), (14, [[(0, 10), (3, 10), (0, 0), (0, 10)]]),
        (15, [box(0, 0, 10, 10)]), (16, [[box(1, 1, 1, 1)], [box(8, 8, 1, 1)]]), (17, [[(3, 10), (3, 4), (7, 4), (7, 10), (3, 10)]]), (18, [frame[0], frame[1]]),
    )
    got = {tuple(x) for x in T.objects_within(inner, outer).collect()}
    assert got == {(11, 1), (11, 2), (11, 3), (10, 2), (10, 3), (14, 2), (16, 1), (16, 2), (16, 3), (18, 1)}
    met = {tuple(x) for x in T.objects_intersecting(inner, outer).collect()}
    assert (10, 1) not in met and (12, 1) in met and {(15, k) for k in (1, 2, 3)} <= met and (17, 2) in met


def test_valid_and_invalid(spark):
    cases = {
        1: [box(0, 0, 4, 4)], 2: [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]], 3: [box(0, 0, 4, 4), box(6, 6, 1, 1)], 4: [box(0, 0, 4, 4), [(0, 2), (1, 3), (1, 1), (0, 2)]],
        5: [box(0, 0, 4, 4), box(1, 1, 2, 2), [(1.5, 1.5), (2, 2.5), (2.5, 1.5), (1.5, 1.5)]], 6: [[box(0, 0, 4, 4)], [box(4, 4, 2, 2)]], 7: [[box(0, 0, 4, 4)], [box(1, 1, 1, 1)]],
        8: [[box(0, 0, 9, 9), box(2, 2, 5, 5)], [box(3, 3, 1, 1)]], 9: [[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]], 10: [[(0, 0), (4, 0), (2, 0), (0, 0)]], 11: [[(0, 0), (4, 0), (4, 4)]],
        12: [[(0, 0), (4, 0), (4, 4), (0, 4)]], 13: [[box(0, 0, 4, 4)], [box(4, 1, 2, 2)]], 14: [box(0, 0, 4, 4), box(2, 2, 4, 1)], 15: [[(0, 0), (4, 0), (4, 4), (4, 0), (0, 4), (0, 0)]],
        16: [box(0, 0, 8, 8), box(1, 1, 2, 2), box(3, 3, 2, 2)],
    }
    found = {}
    for r in T.invalid_polygons(rings(spark, *cases.items())).collect():
        found.setdefault(r.pid, set()).add(r.fault)
    assert set(cases) - set(found) == {1, 4, 6, 8, 16}
    assert found[2] == {"flat"} | found[2] and "cross" in found[2] and found[3] == {"loose"} and found[5] == {"nested"} and found[7] == {"nested"} and found[9] == {"touch"}
    assert "flat" in found[10] and found[11] >= {"open"} and found[12] == {"open"} and found[13] == {"cross"} and "cross" in found[14] and "cross" in found[15]


def star(n, cx, cy, r, phase):
    at = [2 * math.pi * k / n + phase for k in range(n)]
    d = [r * (1 + 0.0002 * (k % 2)) for k in range(n)]
    pts = [(cx + a * math.cos(t), cy + a * math.sin(t)) for a, t in zip(d, at, strict=True)]
    return [*pts, pts[0]]


@pytest.mark.parametrize("n", [100_000])
def test_outlines_of_many_edges(spark, n):
    a, b, c = star(n, 0, 0, 5, 0), star(n, 4, 0, 5, 0.1), star(n, 0, 0, 4.5, 0.2)
    one, two = rings(spark, (1, [a])), rings(spark, (2, [b]), (3, [c]))
    began = time.time()
    pairs = T.edge_pairs(T.numbered_edges(one), T.numbered_edges(two)).count()
    assert pairs < 20 * n and time.time() - began < 120
    assert {x.pid2 for x in T.contacts(T.numbered_edges(one), T.numbered_edges(two)).select("b.pid").withColumnRenamed("pid", "pid2").distinct().collect()} == {2}


def test_levels_lose_no_pair(spark):
    r = random.Random(7)
    seg = lambda: (x := r.uniform(-9, 9), y := r.uniform(-9, 9), x + r.choice([0, 1]) * r.gauss(0, 10 ** r.uniform(-5, 1)), y + r.gauss(0, 10 ** r.uniform(-5, 1)))
    a, b = [(k, *map(float, seg())) for k in range(300)], [(k, *map(float, seg())) for k in range(300)]
    a += [(900, 1.0, 1.0, 1.0, 1.0), (901, -180.0, -90.0, 180.0, 90.0), (902, 0.0, 0.0, 0.5, 0.0)]
    b += [(900, 1.0, 1.0, 1.0, 1.0), (901, 0.5, 0.0, 1.0, 1.0)]
    df = lambda rows: spark.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double")
    got = [(x.a.k, x.b.k) for x in T.edge_pairs(df(a), df(b)).collect()]
    ends = lambda e: (min(e[1], e[3]), min(e[2], e[4]), max(e[1], e[3]), max(e[2], e[4]))
    meet = lambda p, q: p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    assert sorted(got) == sorted((p[0], q[0]) for p in a for q in b if meet(ends(p), ends(q)))
    assert T.edge_pairs(df(a).limit(0), df(b)).count() == 0 and T.edge_pairs(df(a), df(b).filter(F.lit(False))).count() == 0
