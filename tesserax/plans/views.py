"""Views over the given tables that stand for records, areas, grids and catalogues.

Each is one SQL text that Spark and DuckDB both run; names in braces are the tables and views it reads. Coordinates are
dyadic with odd numerators, so both engines get the same doubles and no point lies on an edge.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

VIEWS = {
    "occurrences": """select concat('sp', cast(l_partkey % 97 as string)) as species,
        112 + (2 * ((l_orderkey * 31 + l_linenumber * 7) % 2560) + 1) / cast(128 as double) as lon,
        -45 + (2 * ((l_orderkey * 17 + l_suppkey * 13) % 2240) + 1) / cast(128 as double) as lat,
        cast(year(l_shipdate) as int) as year, l_orderkey as rec_order, l_linenumber as rec_line from {lineitem}""",
    "areas": """select n_nationkey as pid, n_name as name, 'cl1' as fid,
        cast(112 + 8 * (n_nationkey % 5) as double) as minx, cast(-45 + 7 * floor(n_nationkey / 5) as double) as miny,
        cast(120 + 8 * (n_nationkey % 5) as double) as maxx, cast(-38 + 7 * floor(n_nationkey / 5) as double) as maxy from {nation}""",
    "areas2": """select pid + 100 as pid, concat('b', name) as name, 'cl2' as fid, least(minx + cast(2.5 as double), cast(152 as double)) as minx,
        least(miny + cast(1.75 as double), cast(-10 as double)) as miny, least(maxx + cast(2.5 as double), cast(152 as double)) as maxx,
        least(maxy + cast(1.75 as double), cast(-10 as double)) as maxy from {areas}""",
    "corners": """select s_suppkey as pid, cast(112 + (s_suppkey * 5) % 34 as double) as ax, cast(-45 + (s_suppkey * 3) % 30 as double) as ay,
        cast(118 + (s_suppkey * 5) % 34 as double) as bx, -45 + (s_suppkey * 3) % 30 + cast(0.25 as double) as b_y,
        112 + (s_suppkey * 5) % 34 + cast(2.5 as double) as cx, cast(-40 + (s_suppkey * 3) % 30 as double) as cy from {supplier}""",
    "tri_edges": """select pid, 0 as part, 0 as ring, ax as x1, ay as y1, bx as x2, b_y as y2 from {corners}
        union all select pid, 0, 0, bx, b_y, cx, cy from {corners} union all select pid, 0, 0, cx, cy, ax, ay from {corners}""",
    "halves": """select pid, name, minx as ax, miny as ay, minx as bx, maxy as b_y, maxx as cx, miny as cy from {areas}""",
    "half_edges": """select pid, 0 as part, 0 as ring, ax as x1, ay as y1, bx as x2, b_y as y2 from {halves}
        union all select pid, 0, 0, bx, b_y, cx, cy from {halves} union all select pid, 0, 0, cx, cy, ax, ay from {halves}""",
    "dart": """select k, cast(x1 as double) as x1, cast(y1 as double) as y1, cast(x2 as double) as x2, cast(y2 as double) as y2 from (values (1, 113.3, -44.7, 150.3, -41.9), (2, 150.3, -41.9, 139.1, -12.3), (3, 139.1, -12.3, 131.7, -33.3), (4, 131.7, -33.3, 113.3, -44.7)) as t(k, x1, y1, x2, y2)""",
    "nested": """select pid, 0 as ring, minx, miny, maxx, maxy from {areas}
        union all select pid, 1 as ring, minx + 2 as minx, miny + 1.75 as miny, maxx - 2 as maxx, maxy - 1.75 as maxy from {areas}""",
    "cells_el1": """select row, col, 112 + (2 * col + 1) / cast(8 as double) as lon, -10 - (2 * row + 1) / cast(8 as double) as lat, value from (
        select cast((o_orderkey * 37) % 140 as int) as row, cast((o_orderkey * 91 + o_custkey) % 160 as int) as col,
          max((o_orderkey * 13 + o_custkey * 7) % 256) / cast(4 as double) as value from {orders} group by 1, 2) t where (row + col) % 17 <> 0""",
    "cells_el2": """select row, col, 112 + (2 * col + 1) / cast(8 as double) as lon, -10 - (2 * row + 1) / cast(8 as double) as lat, value from (
        select cast((l_orderkey * 53 + l_linenumber) % 140 as int) as row, cast((l_partkey * 29) % 160 as int) as col,
          max((l_suppkey * 11 + l_linenumber * 5) % 256) / cast(4 as double) as value from {lineitem} group by 1, 2) t where (row + col) % 19 <> 0""",
    "cells_coarse": """select cast(floor((cast(-12.75 as double) - lat) / cast(0.625 as double)) as int) as row, cast(floor((lon - cast(115.125 as double)) / cast(0.625 as double)) as int) as col,
        max(value) as value from {cells_el2} where lon >= 115.125 and lon < 146.375 and lat <= -12.75 and lat > -37.75 group by 1, 2""",
    "cells_cl3": """select row, col, lon, lat, cast(floor(row / 20) * 8 + floor(col / 20) as int) as value,
        concat('class', cast(cast(floor(row / 20) * 8 + floor(col / 20) as int) as string)) as name from {cells_el1}""",
    "layers": """select p_partkey as id, p_name as displayname, concat(p_name, ' ', p_brand) as name, p_type as type, p_brand as keywords,
        case p_partkey % 4 when 0 then 'Terrestrial' when 1 then 'Marine' when 2 then 'Terrestrial,Marine' end as domain,
        p_partkey % 7 <> 0 as enabled from {part}""",
    "fields": """select concat(case p_partkey % 3 when 0 then 'el' else 'cl' end, cast(p_partkey as string)) as id, p_name as name,
        concat(p_type, ' field') as description, p_partkey as spid, case p_partkey % 3 when 0 then 'e' when 1 then 'c' else 'a' end as type,
        p_partkey % 5 <> 0 as enabled, p_partkey % 2 = 0 as indb, p_partkey % 3 <> 2 as intersects from {part}""",
    "objects": """select p_partkey as pid, concat('cl', cast(p_size % 5 as string)) as fid, p_name as name, concat(p_brand, ' ', p_type) as descr,
        p_size % 3 <> 0 as namesearch from {part}""",
    "point_objects": """select c_custkey as pid, concat('cl', cast(c_nationkey % 5 as string)) as fid,
        112 + (2 * ((c_custkey * 31) % 2560) + 1) / cast(128 as double) as lon, -45 + (2 * ((c_custkey * 17) % 2240) + 1) / cast(128 as double) as lat from {customer}""",
    "log": """select ts as created, case when value > 100 then 'Tool' else 'Area' end as category1, event_type as category2, props as data,
        user_id * 10 + event_id % 10 as session_id, user_id, event_id from {events}""",
    "distributions": """select s_suppkey as spcode, concat('lsid:', cast(s_suppkey % 40 as string)) as lsid, concat('family', cast(s_nationkey as string)) as family,
        concat('genus', cast(s_suppkey % 17 as string)) as genus, concat('dr', cast(s_suppkey % 6 as string)) as data_resource,
        case s_suppkey % 3 when 0 then 'e' when 1 then 'c' else 't' end as type, case s_suppkey % 4 when 0 then 'likely range' when 1 then 'maybe range' else 'core' end as area_name,
        case when s_suppkey % 5 = 0 then cast(null as double) else s_acctbal end as area_km, s_suppkey as geom_idx, concat('map', cast(s_suppkey % 11 as string)) as wmsurl,
        s_suppkey * 2 as gid from {supplier}""",
    "article_points": """select o_custkey as id, o_orderkey as loc, 112 + (2 * ((o_orderkey * 31) % 2560) + 1) / cast(128 as double) as lon,
        -45 + (2 * ((o_orderkey * 17) % 2240) + 1) / cast(128 as double) as lat, o_orderkey % 5 = 0 as missing from {orders}""",
    "hits": """select o.species, o.lon, o.lat, o.year, o.rec_order, o.rec_line, a.pid, a.name from {occurrences} o join {areas} a
        on o.lon between a.minx and a.maxx and o.lat between a.miny and a.maxy""",
    "near_point": """select c.pid, min(d) as d, sum(case when (x1 > 130) <> (x2 > 130) and -30 < y1 + (130 - x1) * (y2 - y1) / (x2 - x1) then 1 else 0 end) % 2 = 1 as inside from (
        select pid, x1, y1, x2, y2, sqrt(pow(130 - (x1 + t * (x2 - x1)), 2) + pow(-30 - (y1 + t * (y2 - y1)), 2)) as d from (
        select pid, x1, y1, x2, y2, greatest(cast(0 as double), least(cast(1 as double), ((130 - x1) * (x2 - x1) + (-30 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as t from {tri_edges}) a) c group by c.pid""",
    "task_inputs": """select o_orderkey as id, case when o_orderkey % 3 = 0 then 'Model' else 'Tabulate' end as kind,
        concat('{{"layers":[', cast(o_custkey % 120 as string), ',', cast(o_orderkey % 90 as string), ']}}') as inputs from {orders}""",
    "overlay": """select a.pid as pid1, b.pid as pid2, a.name as name1, b.name as name2, greatest(a.minx, b.minx) as minx, greatest(a.miny, b.miny) as miny,
        least(a.maxx, b.maxx) as maxx, least(a.maxy, b.maxy) as maxy from {areas} a join {areas2} b
        on a.minx < b.maxx and b.minx < a.maxx and a.miny < b.maxy and b.miny < a.maxy""",
    "samples": """select o.rec_order, o.rec_line, o.species, o.lon, o.lat, o.year, e.value as el1, f.value as el2 from {occurrences} o
        left join {cells_el1} e on e.row = cast(floor((-10 - o.lat) / 0.25) as int) and e.col = cast(floor((o.lon - 112) / 0.25) as int)
        left join {cells_el2} f on f.row = cast(floor((-10 - o.lat) / 0.25) as int) and f.col = cast(floor((o.lon - 112) / 0.25) as int)""",
}


class Views:
    """The tables and views of one folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                sql = VIEWS[name]
                self._made[name] = self._spark.sql(sql, **{x: getattr(self, x) for x in needed(sql)})
        return self._made[name]


def needed(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def oracle(sql: str) -> str:
    """DuckDB text: sql, which names views in braces, after a WITH clause that defines them."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needed(text):
            if name not in TABLES and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
    views = [f"{name} as ({plain(VIEWS[name])})" for name in order]
    body = plain(sql).strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join([*views, body[15:]])
    if body.lower().startswith("with "):
        views, body = [*views, body[5:]], ""
        return "with " + ",\n".join(views)
    return ("with " + ",\n".join(views) + "\n" if views else "") + body


def boxes(v: Views, *rows: tuple) -> DataFrame:
    """(pid, minx, miny, maxx, maxy) of boxes that a query names."""
    return v._spark.createDataFrame(list(rows), "pid int, minx double, miny double, maxx double, maxy double")


class Registry:
    """Queries by name and, where SQL can express them, their DuckDB text."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")

        def add(f):
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                self.sql[name] = oracle(sql)
            return f

        return add
