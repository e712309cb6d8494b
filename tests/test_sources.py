"""Sources that split: grids by rows, polygon files by records; paths of files that tasks open themselves."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserax.sources import grid_source as B
from tesserax.sources import polygon_source as P
from tesserax.sources.files import qualified, store
from tesserax.sources.headers import parse_header


def test_a_grid_of_over_two_gigabytes_is_many_splits(spark, tmp_path):
    rows, cols = 24_000, 25_000
    with open(tmp_path / "big.gri", "wb") as f:
        f.truncate(rows * cols * 4)  # zeros, which are no cells here
        for row, col in ((0, 0), (12_345, 678), (12_346, 24_999), (23_999, 24_999)):
            f.seek((row * cols + col) * 4)
            f.write(struct.pack("<f", row + 0.5))
    (tmp_path / "big.grd").write_text(f"[GeoReference]\nColumns={cols}\nRows={rows}\nMinX=0\nMaxX={cols / 100}\nMinY=0\nMaxY={rows / 100}\n[Data]\nDataType=FLOAT\nNoDataValue=0\n")
    path = tmp_path.as_uri()
    reader = B.GridReader({"path": path})
    splits = reader.partitions()
    assert sum(p.size for p in splits) == rows * cols * 4 > 2**31 and len(splits) > 70 and max(p.size for p in splits) <= B.SPLIT
    grid = B.read_grids(spark, path)
    assert grid.rdd.getNumPartitions() == len(splits)
    north = B.read_grids(spark, path, lat=(116.535, 116.555))
    assert [(r.row, r.col, r.value) for r in north.orderBy("row").collect()] == [(12345, 678, 12345.5), (12346, 24999, 12346.5)]
    assert north.rdd.getNumPartitions() == 1
    assert sum(p.size for p in B.GridReader({"path": path, "wanted": '{"lat": [116.535, 116.555]}'}).partitions()) <= 8 * cols * 4
    assert B.read_grids(spark, path, row=(23_999, 23_999), col=(20_000, 99_999)).count() == 1
    assert B.GridReader({"path": path, "wanted": '{"layers": ["other"]}'}).partitions() == []


@pytest.mark.parametrize(("part", "split"), [(1 << 20, 1 << 20), (4 * 37 * 10, 4 * 37 * 3), (1, 1)])
def test_grids_come_back(spark, tmp_path, part, split):
    rng = np.random.default_rng(5)
    cells = [(layer, int(r), int(c), float(np.float32(v))) for layer in ("a", "b") for (r, c), v in zip(np.argwhere(rng.random((53, 37)) < 0.2), rng.normal(size=2000), strict=False) if r < 20 or r > 41]
    df = spark.createDataFrame(cells, "layer string, row int, col int, value double").repartition(5)
    B.write_grids(df, str(tmp_path / "g"), {"a": (10.0, 5.0, 0.5, 53, 37), "b": (0.0, 0.0, 1.0, 53, 37), "empty": (0.0, 0.0, 1.0, 4, 4)}, part=part)
    back = B.read_grids(spark, str(tmp_path / "g"), split=split)
    assert sorted((r.layer, r.row, r.col, r.value) for r in back.collect()) == sorted(cells)
    assert {(r.row, r.col, r.lon, r.lat) for r in back.filter("layer = 'a'").collect()} == {(r, c, 10 + (c + 0.5) * 0.5, 5 - (r + 0.5) * 0.5) for x, r, c, _ in cells if x == "a"}
    own = [v for x, _, _, v in cells if x == "b"]
    text = (tmp_path / "g" / "b.grd").read_text()
    assert f"MinValue={min(own)}" in text and f"MaxValue={max(own)}" in text and parse_header(text)["rows"] == 53
    for wanted in ({"row": (15, 44), "col": (0, 8)}, {"lon": (13.0, 1e9), "lat": (-1e9, -2.25)}, {"lat": (100.0, 101.0)}, {"row": (19, 19), "layers": ("b",)}, {"lon": (12.25, 12.25), "lat": (1.25, 4.75)}):
        names = wanted.get("layers", ("a", "b"))
        lon_lat = lambda x, r, c: {"a": (10 + (c + 0.5) * 0.5, 5 - (r + 0.5) * 0.5), "b": (c + 0.5, -r - 0.5)}[x]
        at = lambda x, r, c: dict(zip(("row", "col", "lon", "lat"), (r, c, *lon_lat(x, r, c)), strict=True))
        fits = lambda x, r, c: x in names and all(e[0] <= at(x, r, c)[k] <= e[1] for k, e in wanted.items() if k != "layers")
        own = B.read_grids(spark, str(tmp_path / "g"), split=split, **wanted)
        assert sorted((r.layer, r.row, r.col, r.value) for r in own.collect()) == sorted(x for x in cells if fits(*x[:3]))


def test_short_grid_is_an_error(spark, tmp_path):
    (tmp_path / "s.gri").write_bytes(b"\0" * 40)
    (tmp_path / "s.grd").write_text("[GeoReference]\nColumns=4\nRows=4\nMinX=0\nMaxX=4\nMinY=0\nMaxY=4\n[Data]\nDataType=FLOAT\n")
    with pytest.raises(Exception, match="shorter than its header"):
        B.read_grids(spark, str(tmp_path)).collect()


def square(x, y, w, hole=False):
    xs, ys = [x, x, x + w, x + w, x], [y, y + w, y + w, y, y]
    return (xs[::-1], ys[::-1]) if hole else (xs, ys)


@pytest.fixture
def features(spark, tmp_path):
    rows = []
    for k in range(400):
        if k % 9 == 4:
            rows.append((k, None, None, None, None, f"n{k}"))
            continue
        for part in range(1 + k % 3):
            rows.append((k, part, 0, *square(k + 0.0, 100.0 * part, 8.0), f"n{k}"))
            rows += [(k, part, 1 + h, *square(k + 1.0 + 3 * h, 100.0 * part + 1, 2.0, True), f"n{k}") for h in range(k % 2 + (k % 5 == 0))]
    df = spark.createDataFrame(rows, "pid long, part int, ring int, xs array<double>, ys array<double>, name string").repartition(4)
    numbers = P.write_polygons(df, str(tmp_path / "p"), 3, [("name", 10)]).collect()
    return tmp_path / "p", rows, {(r.file, r.feature): r.pid for r in numbers}


@pytest.mark.parametrize("records", [7, 20_000])
def test_features_with_parts_holes_and_null_shapes(spark, features, records):
    path, rows, numbers = features
    found = P.read_polygons(spark, str(path), records)
    got = sorted(((numbers[r.file, r.feature], r.part, r.ring, r.xs, r.ys, r.attributes["name"]) for r in found.collect()), key=str)
    assert got == sorted(rows, key=str)
    splits = P.PolygonReader({"path": path.as_uri(), "records": str(records)}).partitions()
    assert len(splits) == sum(-(-sum(f == name for f, _ in numbers) // records) for name in {f for f, _ in numbers})
    (path / "0.shx").unlink()  # without an index: one split, the same rows
    assert P.read_polygons(spark, str(path), records).count() == len(rows)
    one = P.read_polygons(spark, str(path / "1.shp"), 5)
    assert {r.file for r in one.select("file").distinct().collect()} == {"1.shp"}


def test_headers_of_polygon_files(features):
    path, rows, _ = features
    for name in ("0.shp", "1.shx"):
        data = (path / name).read_bytes()
        assert struct.unpack(">i", data[:4])[0] == 9994 and struct.unpack(">i", data[24:28])[0] * 2 == len(data)
        assert struct.unpack("<2i", data[28:36]) == (1000, 5)
        x0, y0, x1, y1 = struct.unpack("<4d", data[36:68])
        assert x0 < x1 and y0 == 0 and y1 == 208


def test_holes_go_to_the_smallest_ring_around_them():
    outer, island = square(0.0, 0.0, 100.0), square(40.0, 40.0, 20.0)
    body = struct.pack("<i4d2i", 5, 0, 0, 100, 100, 4, 20) + struct.pack("<4i", 0, 5, 10, 15)
    rings = [outer, island, square(30.0, 30.0, 40.0, True), square(45.0, 45.0, 5.0, True)]
    body += b"".join(np.column_stack(r).astype("<f8").tobytes() for r in rings)
    found = [(part, ring, x[0]) for part, ring, x, _ in P._rings(body)]
    assert found == [(0, 0, 0.0), (1, 0, 40.0), (0, 1, 30.0), (1, 1, 45.0)]


def test_deleted_lines_leave_their_features_out(spark, features):
    path, rows, numbers = features
    data = bytearray((path / "2.dbf").read_bytes())
    head, width = struct.unpack("<HH", data[8:12])
    data[head + 3 * width] = ord("*")
    (path / "2.dbf").write_bytes(bytes(data))
    found = {(r.file, r.feature) for r in P.read_polygons(spark, str(path), 2).collect()}
    assert set(numbers) - found == {("2.shp", 4)}


def test_paths_without_a_scheme_are_on_the_default_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, str(tmp_path)).startswith("file:/")
    try:
        conf.set("fs.defaultFS", "hdfs://localhost:9")
        assert qualified(spark, "/a/b") == "hdfs://localhost:9/a/b" and qualified(spark, f"file://{tmp_path}").startswith("file:/")
    finally:
        conf.set("fs.defaultFS", before)
    with pytest.raises(ValueError, match="qualify"):
        store("/a/b")
    assert math.isclose(store(tmp_path.as_uri())[0].get_file_info(str(tmp_path)).mtime.timestamp(), tmp_path.stat().st_mtime, abs_tol=1)
