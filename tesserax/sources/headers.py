"""Headers of binary grids."""

from __future__ import annotations

import configparser

TYPES = {"BYTE": "i1", "UBYTE": "u1", "SHORT": "i2", "INT": "i4", "LONG": "i8", "FLOAT": "f4", "DOUBLE": "f8"}


def parse_header(text: str) -> dict:
    """Extent, size, type, byte order, nodata and rescale of a grid's INI header; units `1/n x` divide, `nx y` multiply;
    the rows in a part, 0 where all are in one file."""
    ini = configparser.ConfigParser(strict=False)
    ini.read_string(text)
    g = {k.lower(): v for s in ini.sections() for k, v in ini[s].items()}
    units, scale = g.get("units", ""), 1.0
    if units.startswith("1/") and " " in units:
        scale = 1 / float(units[2 : units.index(" ")])
    elif "x " in units and units[: units.index("x ")].replace(".", "", 1).isdigit():
        scale = float(units[: units.index("x ")])
    order = "<" if g.get("byteorder", "LSB").upper() == "LSB" else ">"
    return {"minx": float(g["minx"]), "maxy": float(g["maxy"]), "res": (float(g["maxx"]) - float(g["minx"])) / int(g["columns"]), "rows": int(g["rows"]), "cols": int(g["columns"]),
            "dtype": order + TYPES[g["datatype"].upper()], "nodata": float(g.get("nodatavalue", "nan")), "scale": scale, "part_rows": int(g.get("partrows", 0))}


def header_text(minx: float, miny: float, maxx: float, maxy: float, rows: int, cols: int, low: float, high: float, part_rows: int = 0) -> str:
    """The header of a grid of floats, whose cells are in parts of so many rows unless that is 0."""
    lines = ["[General]", "[GeoReference]", f"Columns={cols}", f"Rows={rows}", f"MinX={minx}", f"MaxX={maxx}", f"MinY={miny}", f"MaxY={maxy}", "[Data]", "DataType=FLOAT", f"MinValue={low}", f"MaxValue={high}", "NoDataValue=nan", "ByteOrder=LSB"]
    lines += [f"PartRows={part_rows}"] if part_rows else []
    return "\n".join(lines) + "\n"
