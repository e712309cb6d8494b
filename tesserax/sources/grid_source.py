"""Binary grids as a Python data source whose splits are ranges of rows, read by offset, and a writer of the same.

A grid is a header (.grd, text) and its cells by rows from the north (.gri). A grid is cut into splits of some megabytes, whatever
the file's size; the layers, rows, columns and extent asked for leave out files and rows before a byte of them is read. They are
options of the source, not filters that Spark pushes: a DataFrame of a Python source keeps the filters once pushed into it, so
that another query on it would miss rows (Spark 4.1).
Cells without a value give no rows. Written grids may have their cells in parts of some rows each, as the header says, so that no
task holds a grid; the header is written when all parts are there, and a grid without a header is not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tesserax.sources.files import folder, listed, qualified, store, whole
from tesserax.sources.headers import header_text, parse_header

SCHEMA = "layer string, row int, col int, lon double, lat double, value double"
#: Bytes of cells in a split and in a part, at most (a row at least).
SPLIT = 32 << 20
#: Cells that are decoded at a time.
BATCH = 1 << 20


@dataclass
class Rows(InputPartition):
    """Rows first to last (not included) of a layer's part, from `offset` on."""

    layer: str
    path: str
    offset: int
    first: int
    last: int
    columns: tuple[int, int]
    header: dict

    @property
    def size(self) -> int:
        return (self.last - self.first) * self.header["cols"] * np.dtype(self.header["dtype"]).itemsize


@dataclass
class Written(WriterCommitMessage):
    #: Least and greatest value by layer.
    ends: dict


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        wanted = json.loads(options.get("wanted", "{}"))
        self.layers = None if wanted.get("layers") is None else set(wanted["layers"])
        #: (least, greatest) by column
        self.ends = {c: wanted.get(c) or (-math.inf, math.inf) for c in ("row", "col", "lon", "lat")}

    def _window(self, g: dict) -> tuple[int, int, int, int]:
        """Rows and columns that can pass; a cell more on each side than the coordinates say, since their arithmetic rounds."""
        bound = lambda x, n: int(min(max(x, 0), n))
        (low_row, high_row), (low_col, high_col), (low_lon, high_lon), (low_lat, high_lat) = (self.ends[c] for c in ("row", "col", "lon", "lat"))
        top = max(low_row, (g["maxy"] - high_lat) / g["res"] - 1.5)
        bottom = min(high_row, (g["maxy"] - low_lat) / g["res"] + 0.5)
        west = max(low_col, (low_lon - g["minx"]) / g["res"] - 1.5)
        east = min(high_col, (high_lon - g["minx"]) / g["res"] + 0.5)
        cut = lambda x, f: f(x) if math.isfinite(x) else x
        return bound(cut(top, math.floor), g["rows"]), bound(cut(bottom, math.ceil) + 1, g["rows"]), bound(cut(west, math.floor), g["cols"]), bound(cut(east, math.ceil) + 1, g["cols"])

    def partitions(self) -> list[Rows]:
        found = []
        for name, _ in listed(self.path, ".grd"):
            layer = name.rsplit("/", 1)[-1][:-4]
            if self.layers is not None and layer not in self.layers:
                continue
            g = parse_header(whole(self.path, name).decode())
            top, bottom, west, east = self._window(g)
            line = g["cols"] * np.dtype(g["dtype"]).itemsize
            step, part = max(1, self.split // line), g["part_rows"] or g["rows"]
            if west >= east:
                continue
            for start in range(0, g["rows"], part):
                at, end = max(top, start), min(bottom, start + part, g["rows"])
                data = f"{name[:-4]}@{start}.gri" if g["part_rows"] else f"{name[:-4]}.gri"
                found += [Rows(layer, data, (r - start) * line, r, min(r + step, end), (west, east), g) for r in range(at, end, step)]
        return found

    def read(self, p: Rows) -> Iterator[pa.RecordBatch]:
        if p is None:  # a source without splits
            return
        g, (west, east) = p.header, p.columns
        where, _ = store(self.path)
        kind = np.dtype(g["dtype"])
        line = g["cols"] * kind.itemsize
        if g["part_rows"] and where.get_file_info(p.path).size in (None, -1):
            return  # no cell in the part
        with where.open_input_file(p.path) as f:
            f.seek(p.offset)
            step = max(1, BATCH // g["cols"])
            for first in range(p.first, p.last, step):
                n = min(step, p.last - first)
                data = f.read(n * line)
                if len(data) != n * line:
                    raise ValueError(f"{p.path} is shorter than its header says")
                v = np.frombuffer(data, kind).reshape(n, g["cols"])[:, west:east].astype("f8")
                row, col = np.nonzero(~(np.isnan(v) | (v == g["nodata"])))
                value = (v[row, col] * g["scale"]).astype("f4").astype("f8")
                row, col = row + first, col + west
                columns = [pa.array([p.layer] * len(row), pa.string()), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(g["minx"] + (col + 0.5) * g["res"]), pa.array(g["maxy"] - (row + 0.5) * g["res"]), pa.array(value)]
                yield pa.RecordBatch.from_arrays(columns, ["layer", "row", "col", "lon", "lat", "value"])


class GridWriter(DataSourceArrowWriter):
    """Parts from tasks, whose rows come by layer and part; headers on commit."""

    def __init__(self, options: dict):
        self.path, self.sizes = options["path"], json.loads(options["sizes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, inner = folder(self.path)
        ends, name, held = {}, None, None

        def flush():
            if held is not None:
                with where.open_output_stream(f"{inner}/{name[0]}@{name[1]}.gri") as out:
                    out.write(held.tobytes())

        for b in iterator:
            layers, rows, cols, values = (b.column(k) for k in range(4))
            rows, cols, values = (x.to_numpy(zero_copy_only=False) for x in (rows, cols, values))
            layers = np.array(layers.to_pylist(), dtype=object)
            starts = np.array([r - r % self.sizes[x][5] for x, r in zip(layers, rows, strict=True)], dtype="i8")
            change = np.flatnonzero((layers[1:] != layers[:-1]) | (starts[1:] != starts[:-1])) + 1
            for a, z in zip([0, *change], [*change, len(rows)], strict=True):
                if a == z:
                    continue
                layer, start = layers[a], int(starts[a])
                if (layer, start) != name:
                    flush()
                    name, (_, _, _, n, width, part) = (layer, start), self.sizes[layer]
                    held = np.full((min(part, n - start), width), np.nan, dtype="<f4")
                held[rows[a:z] - start, cols[a:z]] = values[a:z]
                low, high = ends.get(layer, (math.inf, -math.inf))
                ends[layer] = min(low, float(np.float32(values[a:z].min()))), max(high, float(np.float32(values[a:z].max())))
        flush()
        return Written(ends)

    def commit(self, messages: list[Written | None]) -> None:
        where, inner = folder(self.path)
        for layer, (minx, maxy, res, rows, cols, part) in self.sizes.items():
            own = [m.ends[layer] for m in messages if m is not None and layer in m.ends]
            low, high = min((x for x, _ in own), default=math.nan), max((x for _, x in own), default=math.nan)
            with where.open_output_stream(f"{inner}/{layer}.grd") as out:
                out.write(header_text(minx, maxy - rows * res, minx + cols * res, maxy, rows, cols, low, high, part).encode())

    def abort(self, messages) -> None:
        """Parts without a header are no grid; a later write makes them again."""


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tesserax_grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(dict(self.options))


def read_grids(spark: SparkSession, path: str, split: int = SPLIT, layers: Iterable[str] | None = None, **ends: tuple[float, float]) -> DataFrame:
    """(layer, row, col, lon, lat, value) of a folder of grids or one header: of these layers, if given, and of the cells whose row, col,
    lon and lat are between these ends, both included. Only their rows are read."""
    spark.dataSource.register(GridSource)
    wanted = json.dumps({"layers": None if layers is None else sorted(layers), **ends})
    found = spark.read.format("tesserax_grid").option("path", qualified(spark, path)).option("splitBytes", str(split)).option("wanted", wanted).load()
    for c, (low, high) in ends.items():
        found = found.filter(F.col(c).between(low, high))
    return found


def write_grids(cells: DataFrame, path: str, sizes: dict[str, tuple[float, float, float, int, int]], part: int = SPLIT) -> None:
    """Writes grids(layer, row, col, value) of sizes (minx, maxy, res, rows, cols) into a folder, in parts of so many bytes at most."""
    spark = cells.sparkSession
    spark.dataSource.register(GridSource)
    full = {k: (*s, max(1, min(s[3], part // (4 * s[4])))) for k, s in sizes.items()}
    rows_of = F.create_map(*(F.lit(x) for k, s in full.items() for x in (k, s[5])))
    own = cells.filter(F.col("layer").isin(*full)).select("layer", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    start = F.col("row") - F.col("row") % rows_of[F.col("layer")]
    dealt = own.withColumn("part", start).repartition("layer", "part").sortWithinPartitions("layer", "part").drop("part")
    dealt.write.format("tesserax_grid").mode("append").option("path", qualified(spark, path)).option("sizes", json.dumps(full)).save()
