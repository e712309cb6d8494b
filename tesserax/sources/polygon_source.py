"""Polygon shape files as a Python data source: the record index (.shx) cuts a file into splits, and the table (.dbf) beside it is
read by the same ranges of records.

A split reads its slice of the index, then its bytes of the shapes and its lines of the table, so nothing of a file but its size
passes through the driver. Features have any number of parts; a hole goes to the smallest outer ring of its feature that holds it.
Null shapes have one row without a ring, features of other types too. A file without an index is one split, gone through record by record.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserax.sources.files import folder, listed, qualified, store

SCHEMA = "file string, feature int, part int, ring int, xs array<double>, ys array<double>, attributes map<string, string>"
#: Records in a split; bytes read at a time.
RECORDS, BLOCK = 20_000, 16 << 20
#: Fixed values of the format: its mark and version, polygons without and with heights or measures.
MARK, VERSION, POLYGONS = 9994, 1000, (5, 15, 25)


@dataclass
class Records(InputPartition):
    """Records first to last (not included) of a file, from 0; last is -1 where there is no index."""

    path: str
    first: int
    last: int


class PolygonReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.records = options["path"], int(options.get("records", RECORDS))

    def partitions(self) -> list[Records]:
        index, found = {p[:-4]: size for p, size in listed(self.path, ".shx")} if not self.path.endswith(".shp") else {}, []
        for path, _ in listed(self.path, ".shp"):
            if self.path.endswith(".shp"):
                index |= {p[:-4]: size for p, size in listed(self.path[:-4] + ".shx", ".shx") if size}
            n = (index[path[:-4]] - 100) // 8 if path[:-4] in index else None
            found += [Records(path, 0, -1)] if n is None else [Records(path, k, min(k + self.records, n)) for k in range(0, n, self.records)]
        return found

    def read(self, p: Records | None) -> Iterator[tuple]:
        if p is None:
            return
        where, _ = store(self.path)
        name = p.path.rsplit("/", 1)[-1]
        table = Table(where, p.path[:-4] + ".dbf")
        for number, body in _indexed(where, p) if p.last >= 0 else _scanned(where, p.path):
            attributes = table.row(number - 1)
            if attributes is DELETED:
                continue
            rings = list(_rings(body))
            for part, ring, x, y in rings or [(None, None, None, None)]:
                yield name, number, part, ring, x, y, attributes


def _indexed(where, p: Records):
    """(number, body) of the records of a split, read in blocks of neighbours."""
    with where.open_input_file(p.path[:-4] + ".shx") as f:
        f.seek(100 + 8 * p.first)
        at = np.frombuffer(f.read(8 * (p.last - p.first)), ">i4").reshape(-1, 2).astype("i8") * 2
    with where.open_input_file(p.path) as f:
        k = 0
        while k < len(at):
            z = k + 1
            while z < len(at) and at[z, 0] >= at[z - 1, 0] and at[z, 0] + 8 + at[z, 1] - at[k, 0] <= BLOCK:
                z += 1
            f.seek(int(at[k, 0]))
            data = f.read(int(at[z - 1, 0] + 8 + at[z - 1, 1] - at[k, 0]))
            for j in range(k, z):
                a = int(at[j, 0] - at[k, 0]) + 8
                yield p.first + j + 1, data[a : a + int(at[j, 1])]
            k = z


def _scanned(where, path: str):
    with where.open_input_stream(path) as f:
        f.read(100)
        number = 0
        while len(head := f.read(8)) == 8:
            number += 1
            yield number, f.read(2 * struct.unpack(">i", head[4:])[0])


def _rings(body: bytes):
    """(part, ring, xs, ys) of a polygon record: outer rings are ring 0 of their part, in order; then their holes."""
    if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in POLYGONS:
        return
    n_parts, n_points = struct.unpack("<ii", body[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
    xy = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
    rings = [(xy[a:b, 0], xy[a:b, 1]) for a, b in zip(starts, starts[1:], strict=False)]
    areas = [float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2 for x, y in rings]
    outer = [k for k, a in enumerate(areas) if a < 0] or [0]
    count = [1] * len(outer)
    for part, k in enumerate(outer):
        yield part, 0, rings[k][0].tolist(), rings[k][1].tolist()
    for k in sorted(set(range(len(rings))) - set(outer)):
        holding = [part for part, o in enumerate(outer) if _holds(*rings[o], *rings[k])]
        part = min(holding, key=lambda p: -areas[outer[p]], default=max((p for p, o in enumerate(outer) if o < k), default=0))
        yield part, count[part], rings[k][0].tolist(), rings[k][1].tolist()
        count[part] += 1


def _holds(x, y, hx, hy) -> bool:
    """Whether a ring holds another, by the first of its corners that is not on the ring's own corners."""
    corners = set(zip(x.tolist(), y.tolist(), strict=True))
    px, py = next(((a, b) for a, b in zip(hx, hy, strict=True) if (a, b) not in corners), (hx[0], hy[0]))
    cross = (y[:-1] > py) != (y[1:] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = px < x[:-1] + (py - y[:-1]) * (x[1:] - x[:-1]) / (y[1:] - y[:-1])
    return bool((cross & right).sum() % 2)


DELETED = object()


class Table:
    """Lines of a table by number, a block at a time; null where there is no table, DELETED for deleted lines."""

    def __init__(self, where, path: str):
        self.file = where.open_input_file(path) if where.get_file_info(path).is_file else None
        self.first, self.lines, self.columns = 0, b"", []
        if self.file is None:
            return
        self.count, self.head, self.width = struct.unpack("<4xIHH", self.file.read(12))
        fields, start = self._at(32, self.head - 32), 1
        for at in range(0, len(fields) - 31, 32):
            if fields[at] == 0x0D:
                break
            name, size = fields[at : at + 11].split(b"\0")[0].decode("latin-1"), fields[at + 16]
            self.columns.append((name, start, start + size))
            start += size

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def row(self, k: int):
        if self.file is None or k >= self.count:
            return None
        at = (k - self.first) * self.width
        if not 0 <= at < len(self.lines):
            n = max(1, (1 << 20) // self.width)
            self.first, at = k, 0
            self.lines = self._at(self.head + k * self.width, min(n, self.count - k) * self.width)
        line = self.lines[at : at + self.width]
        return DELETED if line[:1] == b"*" else {n: line[a:b].decode("utf-8", "replace").strip() or None for n, a, b in self.columns}


class PolygonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tesserax_polygons"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PolygonReader:
        return PolygonReader(dict(self.options))


def read_polygons(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(file, feature, part, ring, xs, ys, attributes) of a folder of polygon files or one; ring 0 is the outer ring of its part."""
    spark.dataSource.register(PolygonSource)
    return spark.read.format("tesserax_polygons").option("path", qualified(spark, path)).option("records", str(records)).load()


def _polygon(rings: list) -> bytes:
    """The record body of a feature: outer rings clockwise, each followed by its holes the other way; a null shape without rings."""
    if not rings:
        return struct.pack("<i", 0)
    own = []
    for ring, xs, ys in rings:
        x, y = np.asarray(xs, "<f8"), np.asarray(ys, "<f8")
        clockwise = (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0
        own.append((x, y) if clockwise == (ring == 0) else (x[::-1], y[::-1]))
    x, y = (np.concatenate([r[k] for r in own]) for k in (0, 1))
    starts = np.cumsum([0, *(len(r[0]) for r in own[:-1])]).astype("<i4")
    return struct.pack("<i4d2i", 5, x.min(), y.min(), x.max(), y.max(), len(own), len(x)) + starts.tobytes() + np.column_stack([x, y]).tobytes()


def _head(bytes_: int, box: tuple) -> bytes:
    return struct.pack(">7i", MARK, 0, 0, 0, 0, 0, bytes_ // 2) + struct.pack("<2i4d", VERSION, 5, *box) + bytes(32)


def _table(columns: list[tuple[str, int]], rows: list[tuple]) -> bytes:
    """A table of text columns (name, width)."""
    out = [struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(columns), 1 + sum(w for _, w in columns))]
    out += [struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in columns]
    out.append(b"\r")
    for r in rows:
        out.append(b" " + b"".join(("" if v is None else str(v)).encode()[:w].ljust(w) for v, (_, w) in zip(r, columns, strict=True)))
    return b"".join(out) + b"\x1a"


def write_polygons(rings: DataFrame, path: str, files: int, columns: list[tuple[str, int]] = ()) -> DataFrame:
    """(file, feature, pid): features (pid, part, ring, xs, ys, ...) encoded within tasks: shapes, index and a table of the text
    columns (name, width), for each of `files` ranges of pid. A pid whose rows all lack xs is a null shape. Files are written when
    the result is, into a folder that executors share; a repeated task writes the same file again."""
    spark = rings.sparkSession
    path, names = qualified(spark, path), [n for n, _ in columns]
    listed_ = F.sort_array(F.collect_list(F.when(F.col("xs").isNotNull(), F.struct("part", "ring", "xs", "ys"))))
    whole = rings.groupBy("pid").agg(listed_.alias("rings"), *(F.min(n).alias(n) for n in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shapes, index, rows, pids, at, boxes = [], [], [], [], 100, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                body = _polygon([(x["ring"], x["xs"], x["ys"]) for x in r.rings])
                shapes.append(struct.pack(">2i", len(pids) + 1, len(body) // 2) + body)
                index.append(struct.pack(">2i", at // 2, len(body) // 2))
                at += len(shapes[-1])
                pids.append(r.pid)
                rows.append(tuple(getattr(r, n) for n in names))
                if len(body) > 36:
                    boxes.append(struct.unpack("<4d", body[4:36]))
        if not pids:
            return
        b = np.array(boxes or [(0, 0, 0, 0)])
        box = (*b[:, :2].min(0), *b[:, 2:].max(0))
        name = str(TaskContext.get().partitionId())
        where, inner = folder(path)
        found = {"shp": _head(at, box) + b"".join(shapes), "shx": _head(100 + 8 * len(index), box) + b"".join(index)}
        if columns:
            found["dbf"] = _table(list(columns), rows)
        for ending, data in found.items():
            with where.open_output_stream(f"{inner}/{name}.{ending}") as out:
                out.write(data)
        yield pd.DataFrame({"file": f"{name}.shp", "feature": range(1, len(pids) + 1), "pid": pids})

    return whole.repartitionByRange(files, "pid").sortWithinPartitions("pid").mapInPandas(run, "file string, feature int, pid long")
