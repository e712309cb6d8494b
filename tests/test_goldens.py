"""Known results on small inputs, invariants, and cases at the edges."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserax.functions import geo
from tesserax.operators import aggregates as A
from tesserax.operators import catalogue as C
from tesserax.operators import legends as L
from tesserax.operators import models as M
from tesserax.operators import overlay as O
from tesserax.operators import spatial as S
from tesserax.operators import topology as T
from tesserax.sources.headers import parse_header

# latitude and longitude as the known result has them: out of range, but its areas follow from them
THREE = [("a", -15.0, 120.0), ("a", -25.0, 154.0), ("a", -40.0, 140.0)]


def test_range_sizes_of_three_points(spark):
    occ = spark.createDataFrame(THREE, "species string, lon double, lat double")
    assert A.area_of_occupancy(occ, 0.02).first().km2 == pytest.approx(12)
    assert M.extent_of_occurrence(occ).first().km2 == pytest.approx(2956614, abs=1)


def test_occupied_cells_of_five_records(spark):
    rows = [("species1", 131.0, -22.0), ("species2", 121.0, -19.0), ("species3", 131.0, -23.0), ("species1", 141.0, -22.0), ("species1", 131.0, -30.0)]
    sites = A.sites_by_species(spark.createDataFrame(rows, "species string, lon double, lat double"), 120.0, -40.0, 1.0)
    assert sites.count() == 5 and sites.agg(F.sum("n")).first()[0] == 5
    assert sites.select("row", "col").distinct().count() == 5


def test_snap_moves_negative_multiples_down(spark):
    got = spark.createDataFrame([(-15.0,), (-0.01,), (0.01,), (-15.01,)], "x double").select(geo.snap("x", 0.5)).collect()
    assert [r[0] for r in got] == [-15.5, 0.0, 0.0, -15.5]


def test_edges_and_vertices_are_inside(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0, 0.0)))
    points = [(0.0, 0.0, True), (2.0, 4.0, True), (4.0, 1.0, True), (2.0, 2.0, True), (5.0, 2.0, False), (2.0, -1.0, False)]
    df = spark.createDataFrame(points, "x double, y double, want boolean").select(geo.in_ring("x", "y", xs, ys).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def edges_of(*rings):
    return np.array([[*p, *q] for r in rings for p, q in itertools.pairwise(r)], dtype=float)


def test_overlay_of_slanted_polygons():
    square = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    diamond = [(1, -0.5), (2.5, 1), (1, 2.5), (-0.5, 1), (1, -0.5)]
    hole = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]
    assert O.common_area(edges_of(square), edges_of(diamond)) == pytest.approx(3.5)
    assert O.common_area(edges_of(square, hole), edges_of(square)) == pytest.approx(3)
    assert sum(O.common_area(edges_of(square), edges_of(diamond), k, k + 0.7) for k in (0, 0.7, 1.4)) == pytest.approx(3.5)
    area = lambda how: sum((hi - lo) * (b0 - a0 + b1 - a1) / 2 for lo, hi, a0, b0, a1, b1 in O.trapezoids(edges_of(square), edges_of(diamond), how))
    assert area("union") == pytest.approx(4 + 4.5 - 3.5) and area("intersection") == pytest.approx(3.5)


def test_overlay_of_many_edges_is_not_quadratic():
    import time

    n = 20_000
    at = np.linspace(0, 2 * np.pi, n, endpoint=False)

    def ring(x, r):
        p = np.stack([x + r * np.cos(at), r * np.sin(at)], axis=1)
        return np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)

    began = time.time()
    area = O.common_area(ring(0.0, 1.0), ring(1.0, 1.0))
    assert area == pytest.approx(2 * np.pi / 3 - np.sqrt(3) / 2, rel=1e-6) and time.time() - began < 60
    rng = np.random.default_rng(4)
    for _ in range(20):
        def shape():
            t, r = np.sort(rng.random(90)) * 2 * np.pi, rng.integers(5, 40, 90)
            p = np.stack([r * np.cos(t) + rng.integers(0, 9), r * np.sin(t)], axis=1)
            return np.concatenate([p, np.roll(p, -1, axis=0)], axis=1)

        a, b = shape(), shape()
        for how in ("intersection", "union"):
            size = lambda: sum((hi - lo) * (b0 - a0 + b1 - a1) / 2 for lo, hi, a0, b0, a1, b1 in O.trapezoids(a, b, how))
            whole, O.LEAF = (O.LEAF, 10**9)
            flat, O.LEAF = size(), whole
            assert size() == pytest.approx(flat, rel=1e-9)


@pytest.mark.parametrize("size", [0.3, 1.0, 7.0])
def test_points_in_many_cornered_polygons(spark, size):
    """A star with a hole, and a polygon of two parts: by buckets as by the whole rings, edges and vertices included."""
    import math

    star = [(5 + (3 if k % 2 else 1.2) * math.cos(k * math.pi / 9), 5 + (3 if k % 2 else 1.2) * math.sin(k * math.pi / 9)) for k in range(18)]
    box = lambda x, y, w: [(x, y), (x, y + w), (x + w, y + w), (x + w, y)]
    rings = [(1, 0, 0, star), (1, 0, 1, box(4.5, 4.5, 1)), (2, 0, 0, box(1, 1, 2)), (2, 1, 0, box(6, 2, 3)), (3, 0, 0, box(0, 0, 10))]
    rows = [(p, part, ring, [float(x) for x, _ in [*r, r[0]]], [float(y) for _, y in [*r, r[0]]]) for p, part, ring, r in rings]
    df = spark.createDataFrame(rows, "pid int, part int, ring int, xs array<double>, ys array<double>")
    r = random.Random(2)
    points = [(r.uniform(-1, 11), r.uniform(-1, 11)) for _ in range(1500)] + [(k / 2, j / 2) for k in range(22) for j in range(22)] + star
    pts = spark.createDataFrame(points, "lon double, lat double")
    whole = pts.distinct().join(F.broadcast(S.shapes(df))).filter(S.in_shape("lon", "lat", "shape")).select("lon", "lat", "pid")
    want = set(map(tuple, whole.collect()))
    assert set(map(tuple, S.points_in_polygons(pts, df, size).collect())) == want
    first = {(x.lon, x.lat): x.pid for x in S.first_polygon(pts, df, size).collect()}
    assert first == {p: min((k for x, y, k in want if (x, y) == p), default=None) for p in points}


def test_within_a_concave_polygon(spark):
    bay = [(0, 0), (0, 10), (5, 3), (10, 10), (10, 0), (0, 0)]
    rings = lambda d: spark.createDataFrame([(p, 0, k, [float(x) for x, _ in r], [float(y) for _, y in r]) for p, k, r in d], "pid int, part int, ring int, xs array<double>, ys array<double>")
    inner = rings([(1, 0, [(1, 1), (1, 2), (2, 2), (1, 1)]), (2, 0, [(1, 7), (9, 7), (5, 1), (1, 7)]), (3, 0, [(0, 0), (0, 10), (5, 3), (0, 0)]), (4, 0, [(6, 0.5), (9, 0.5), (7, 2.5), (6, 0.5)])])
    outer = rings([(10, 0, bay), (11, 0, [(0, 0), (0, 3), (10, 3), (10, 0), (0, 0)]), (11, 1, [(7, 0.8), (7.2, 0.8), (7.1, 1), (7, 0.8)])])
    assert {tuple(x) for x in T.objects_within(inner, outer).collect()} == {(1, 10), (1, 11), (3, 10), (4, 10)}


def test_hulls_leave_out_what_has_no_place(spark):
    rows = [("a", 0.0, 0.0), ("a", 0.0, 2.0), ("a", 2.0, 0.0), ("a", 0.0, 1.0), ("a", None, 50.0), ("a", 50.0, float("nan")), (None, 1.0, 1.0), (None, 2.0, 3.0), ("b", None, None)]
    occ = spark.createDataFrame(rows, "species string, lon double, lat double").repartition(3)
    got = {r.species: r for r in M.extent_of_occurrence(occ).collect()}
    half = 2 * 6378137.0 * np.arcsin(np.sin(np.radians(1)))  # half of a side of two degrees, in metres times two
    assert got["a"].points == 3 and got["a"].km2 == pytest.approx(half**2 / 2 / 1e6, rel=1e-3)
    assert (got[None].points, got[None].km2, got["b"].points, got["b"].km2) == (2, 0.0, 0, 0.0)
    alpha = {r.species: r for r in M.alpha_hull(occ).collect()}
    assert alpha["a"].triangles == 2 and alpha["a"].km2 == pytest.approx(got["a"].km2, rel=1e-6)
    assert (alpha[None].triangles, alpha["b"].km2) == (0, 0.0)


def test_alpha_hull_tests_every_edge_or_two(spark):
    # a far point: its triangles have long edges, which the mean of the distinct edges leaves out
    rows = [("a", float(x), float(y)) for x in range(4) for y in range(4)] + [("a", 30.0, 1.5)]
    occ = spark.createDataFrame(rows, "species string, lon double, lat double")
    three, two = (M.alpha_hull(occ, 2.0, n).first() for n in (3, 2))
    assert three.triangles == 18 and two.triangles >= three.triangles
    square = [x for x in M.alpha_triangles(occ).collect()]
    assert sum(abs((t.xs[1] - t.xs[0]) * (t.ys[2] - t.ys[0]) - (t.ys[1] - t.ys[0]) * (t.xs[2] - t.xs[0])) for t in square) / 2 == pytest.approx(9)


def test_outlines_of_cells_that_touch_at_corners(spark):
    from tesserax.operators import rasters as R
    from tesserax.operators.overlay import planar_area

    picture = ["######.#", "#.#..#..", "##.#.###", "#..###.#", "######.#", "......##", "##......", "##.#...."]
    cells = [(r, c, 1) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"]
    labelled = R.regions(spark.createDataFrame(cells, "row int, col int, value int"))
    rings = R.region_rings(labelled, 0.0, 8.0, 1.0).withColumn("a", planar_area("xs", "ys")).collect()
    size = {r.region: r["count"] for r in labelled.groupBy("region").count().collect()}
    assert sum(size.values()) == len(cells)
    for region, n in size.items():
        own = sorted((x for x in rings if x.region == region), key=lambda x: x.ring)
        assert own[0].a - sum(x.a for x in own[1:]) == pytest.approx(n)
        for x in own:  # corners only
            steps = [(b - a, d - c) for a, b, c, d in zip(x.xs, x.xs[1:], x.ys, x.ys[1:], strict=False)]
            assert all((p[0] == 0) != (q[0] == 0) for p, q in zip(steps, steps[1:] + steps[:1], strict=True))
        # a region's rings: two less its Euler number, which is cells less pairs side by side plus full squares of four
        mine = {(r.row, r.col) for r in labelled.filter(F.col("region") == region).collect()}
        pairs = sum((r + dr, c + dc) in mine for r, c in mine for dr, dc in ((0, 1), (1, 0)))
        squares = sum({(r, c + 1), (r + 1, c), (r + 1, c + 1)} <= mine for r, c in mine)
        assert len(own) == 2 - (n - pairs + squares)
    assert max(sum(x.region == region for x in rings) for region in size) > 1


def test_nearest_resolution_that_is_no_coarser():
    from tesserax.operators.rasters import resolution_for

    assert [resolution_for(x, [0.1, 0.25, 1.0]) for x in (0.05, 0.1, 0.3, 1.0, 5.0)] == [0.1, 0.1, 0.25, 1.0, 1.0]


def test_triangulation_fills_the_hull():
    p = np.random.default_rng(1).random((60, 2))
    t = p[M.delaunay(p)]
    area = np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])).sum() / 2
    h = M.hull(p)
    x, y = h[:, 0], h[:, 1]
    assert area == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2, rel=1e-6)


@pytest.mark.parametrize("kind", ["random", "lattice", "line and a point", "line"])
def test_triangulation_has_empty_circles(kind):
    r = np.random.default_rng(3)
    p = {"random": r.random((120, 2)), "lattice": np.unique(r.integers(0, 14, (150, 2)) / 64.0, axis=0), "line and a point": np.array([[k, k] for k in range(9)] + [[2, 5]], float), "line": np.array([[k, 2 * k] for k in range(9)], float)}[kind]
    p = p[r.permutation(len(p))]
    n, a = M.delaunay(p), 0.0
    for i, j, k in n.tolist():
        (x1, y1), (x2, y2) = p[j] - p[i], p[k] - p[i]
        d, a = 2 * (x1 * y2 - x2 * y1), a + (x1 * y2 - x2 * y1) / 2
        c = p[i] + np.array([y2 * (x1**2 + y1**2) - y1 * (x2**2 + y2**2), x1 * (x2**2 + y2**2) - x2 * (x1**2 + y1**2)]) / d
        assert d > 0 and (np.hypot(*(p - c).T) >= np.hypot(*(p[i] - c)) - 1e-9).all()
    h = M.hull(p)
    x, y = h[:, 0], h[:, 1]
    assert a == pytest.approx(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2, abs=1e-9)


def test_alpha_hull_takes_the_points_themselves(spark):
    """Distinct points of a 51 x 51 lattice of 1/64 degree: two triangles a square, and more than 2000 places."""
    rows = [("a", 120 + i / 64, -20 + j / 64) for i in range(51) for j in range(51)]
    got = M.alpha_hull(spark.createDataFrame(rows + rows[:9], "species string, lon double, lat double")).first()
    sphere = 6378137.0**2 * np.radians(50 / 64) * (np.sin(np.radians(-20 + 50 / 64)) - np.sin(np.radians(-20))) / 1e6
    assert got.triangles == 5000 and got.km2 == pytest.approx(sphere, rel=1e-5)


def test_point_radius_area_takes_records_of_all_years(spark):
    from tesserax.plans import registry
    from tesserax.plans.views import Views

    sf = "/root/testdata/sf0.001"
    got = {r.species: r.km2 for r in registry.queries()["agg29_point_radius_area"](spark, sf).collect()}
    own = Views(spark, sf).occurrences
    assert {r.species for r in own.select("species").distinct().collect()} == set(got)
    one = M.point_radius_area(own.filter("species = 'sp5'"), 40_000.0, 0.5, 0.125).first()
    assert got["sp5"] == pytest.approx(one.km2)


def test_winding_region_is_one(spark):
    """A serpentine through a grid of 140 x 160 cells, beside it single cells of another value."""
    from tesserax.operators import rasters as R

    path = lambda r, c: r % 2 == 0 or c == (159 if r % 4 == 1 else 0)
    cells = [(r, c, 1) for r in range(140) for c in range(160) if path(r, c)] + [(r, 80, 2) for r in range(1, 140, 2)]
    got = R.regions(spark.createDataFrame(cells, "row int, col int, value int")).groupBy("value").agg(F.countDistinct("region").alias("n"), F.count("*").alias("cells")).collect()
    assert {(r.value, r.n, r.cells) for r in got} == {(1, 1, len(cells) - 70), (2, 70, 70)}


def test_facets(spark):
    rows = list(itertools.product(["a", "b c", None], [1, 5, None]))
    df = spark.createDataFrame(rows, "s string, n int")
    count = lambda t: df.filter(C.facet(t)).count()
    assert count('s:"b c"') == 3 and count("-s:a") == 6 and count("n:[2 TO *] AND s:*") == 2
    assert count("(s:a OR n:5) AND -n:1") == 4


def test_equal_area_gives_frequent_values_their_own_class(spark):
    def cuts(counts, n):
        df = spark.createDataFrame([(v, k) for v, k in counts], "x double, k int").select("x", F.explode(F.sequence(F.lit(1), F.col("k"))))
        return [(r.idx, r.cut) for r in L.equal_area(df, "x", n).orderBy("idx").collect()]

    assert cuts([(float(k), 10) for k in range(100)], 10) == list(enumerate(float(k) for k in range(9, 100, 10)))
    assert cuts([(1.0, 1), (2.0, 1000), (3.0, 1), (4.0, 1)], 3) == [(0, 1.0), (1, 2.0), (2, 4.0)]
    assert cuts([(1.0, 1), (2.0, 500), (3.0, 1), (4.0, 500), (5.0, 1)], 3) == [(0, 2.0), (1, 4.0), (2, 5.0)]
    assert cuts([], 3) == []


@pytest.mark.parametrize("parts", [4, 8, 33])
def test_numbers_are_gapless_and_in_order(spark, parts):
    from tesserax.plans import registry
    from tesserax.sources import records as R

    customers = spark.read.parquet("/root/testdata/sf0.01/customer.parquet")
    got = [(r.c_custkey, r.k) for r in R.numbered(customers, "c_custkey", "k", parts=parts).select("c_custkey", "k").collect()]
    assert [k for _, k in sorted(got)] == list(range(1, len(got) + 1))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        own = registry.queries()
        for name, key, number, start in (("src5_species_dictionary", "species", "species_id", 0), ("win4_row_numbers", "s_suppkey", "spcode", 5_000_000), ("agg47_name_index", "name_lower", "name_id", 1)):
            rows = sorted((r[key], r[number]) for r in own[name](spark, "/root/testdata/sf0.01").collect())
            assert [k for _, k in rows] == list(range(start, start + len(rows))), name
        for name, number, start in (("src16_upload_ingest", "occurrenceID", 1), ("src17_track_harvest", "spcode", 5_000_000)):
            assert sorted(r[number] for r in own[name](spark, "/root/testdata/sf0.01").collect())[0] == start, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_grid_header_rescale():
    text = "[General]\n[GeoReference]\nColumns=4\nRows=2\nMinX=0\nMaxX=2\nMinY=0\nMaxY=1\n[Data]\nDataType=SHORT\nByteOrder=MSB\nNoDataValue=-9\nUnits=1/10 C\n"
    h = parse_header(text)
    assert h["dtype"] == ">i2" and h["scale"] == pytest.approx(0.1) and h["res"] == 0.5 and h["nodata"] == -9


def test_focal_window_of_one_is_plain(spark):
    cells = spark.createDataFrame([(0, 0, 4), (1, 1, 2)], "row int, col int, n long")
    assert {(r.row, r.col, r.value) for r in A.focal_mean(cells, 1, 2, 2).collect()} == {(0, 0, 4.0), (1, 1, 2.0)}
    with pytest.raises(ValueError):
        A.focal_mean(cells, 2, 2, 2)


def test_occupancy_is_monotone_in_resolution(spark):
    random.seed(1)
    occ = spark.createDataFrame([("s", random.uniform(112, 150), random.uniform(-44, -11)) for _ in range(500)], "species string, lon double, lat double")
    cells = [A.area_of_occupancy(occ, r).first().cells for r in (0.25, 0.5, 1.0, 4.0)]
    assert cells == sorted(cells, reverse=True)


def test_empty_and_null_records(spark):
    empty = spark.createDataFrame([], "species string, lon double, lat double, year int")
    assert A.world_counts(empty, 1).count() == 0 and A.binned(empty, "lon").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)], "species string, lon double, lat double, year int")
    rings = S.boxes_to_rings(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "pid int, minx double, miny double, maxx double, maxy double"))
    assert S.points_in_polygons(nulls, rings).count() == 0
    assert S.first_polygon(nulls, rings).first().pid is None


def test_streaming_sampling(spark, tmp_path):
    from tesserax.streaming.sampling import sample_stream

    points = spark.createDataFrame([(1, 112.1, -10.1), (2, 113.9, -11.9), (3, 0.0, 0.0)], "id int, lon double, lat double")
    points.write.parquet(str(tmp_path / "in"))
    cells = spark.createDataFrame([(0, 0, 7.0)], "row int, col int, value double")
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = sample_stream(stream, {"el1": cells}, west=112.0, north=-10.0, res=1.0, rows=2, cols=2).writeStream.format("memory").queryName("sampled").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.el1) for r in spark.table("sampled").collect()} == {(1, 7.0), (2, None), (3, None)}


#: Published lines on the spheroid: Flinders Peak to Buninyong, Wellington to Salamanca, near antipodes, and quarters of the world.
LINES = [
    (144 + 25 / 60 + 29.5244 / 3600, -(37 + 57 / 60 + 3.7203 / 3600), 143 + 55 / 60 + 35.3839 / 3600, -(37 + 39 / 60 + 10.1561 / 3600), 54972.271),
    (174.81, -41.32, -5.50, 40.96, 19959679.267), (0.0, 0.0, 179.5, 0.5, 19936288.579), (0.0, 0.0, 179.7, 0.5, 19944127.421), (0.0, 0.0, 1.0, 0.0, 111319.491),
    (0.0, 0.0, 180.0, 0.0, 20003931.459), (0.0, 90.0, 0.0, -90.0, 20003931.459), (10.0, 30.0, -170.0, -30.0, 20003931.459), (7.0, 0.0, 7.0, 90.0, 10001965.729), (10.0, 20.0, 10.0, 20.0, 0.0),
]


def test_lines_on_the_spheroid(spark):
    df = spark.createDataFrame(LINES, "a double, b double, c double, d double, metres double")
    for r in df.select("metres", geo.spheroid_distance("a", "b", "c", "d").alias("there"), geo.spheroid_distance("c", "d", "a", "b").alias("back")).collect():
        assert abs(r.there - r.metres) < 1e-3 and abs(r.back - r.metres) < 1e-3
    assert spark.createDataFrame([(None, 1.0)], "x double, y double").select(geo.spheroid_distance("x", "y", "y", "y").alias("d")).first().d is None


def test_finer_cells_name_coarser_ones(spark):
    fine, coarse = A.Lattice(0.0, 4.0, 0.5, 8, 8), A.Lattice(1.0, 3.5, 1.25, 2, 2)
    cells = lambda g: spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(g.rows) for c in range(g.cols)], "row int, col int, value double")
    got = {(r.row, r.col): (r.a, r.b) for r in A.common_cells(cells(fine), cells(coarse), fine, coarse).collect()}
    want = {}
    for r, c in itertools.product(range(8), range(8)):
        x, y = (c + 0.5) * 0.5, 4 - (r + 0.5) * 0.5
        if 1.0 <= x <= 3.5 and 1.0 <= y <= 3.5:
            want[r, c] = float(10 * r + c), float(10 * min(1, int((3.5 - y) / 1.25)) + min(1, int((x - 1) / 1.25)))
    assert got == want and len(want) == 25
    back = {(r.row, r.col): (r.b, r.a) for r in A.common_cells(cells(coarse), cells(fine), coarse, fine).collect()}
    assert back == want
    apart = A.Lattice(50.0, 60.0, 0.25, 8, 8)
    assert A.layer_distance(cells(fine), cells(apart), fine, apart).first().distance is None
