"""Overlay of polygons: exact planar area and shape of what overlapping pairs share, by bands and slabs.

Candidates come from boxes through buckets. A polygon's edges are dealt to bands of latitude, so a pair is worked on band by
band, with the edges there only, however large the polygons are. Within a band heights are halved until few edges are left in each
part, which an edge is in only where it runs, so a band's work grows with its edges and slabs and not with their product. There a pair is
cut at the heights of all vertices and crossings; within such a slab edges do not cross, so each polygon is a list of trapezoids
and the common width is linear between the slab's two sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.operators.spatial import boxes_overlap, ring_edges, shapes

#: Edges of one polygon compared with the other's at once.
CHUNK = 256
#: Edges of a pair that are not divided further.
LEAF = 64


def _upwards(edges: np.ndarray) -> np.ndarray:
    """(n, 4) of x1, y1, x2, y2 with y1 < y2, level edges left out."""
    e = np.where((edges[:, 1] <= edges[:, 3])[:, None], edges, edges[:, [2, 3, 0, 1]])
    return e[e[:, 1] < e[:, 3]]


def _at(edges: np.ndarray, y: float, lo: float, hi: float) -> np.ndarray:
    """(n, 2, 2): of the spans inside at height y, left and right side, at the heights lo and hi."""
    e = edges[(edges[:, 1] < y) & (edges[:, 3] > y)]
    x = lambda h: e[:, 0] + (h - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    order = np.argsort(x(y), kind="stable")
    return np.stack([x(lo)[order], x(hi)[order]], axis=1).reshape(-1, 2, 2)


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a and b cross."""
    out = []
    for at in range(0, len(a), CHUNK):
        p = a[at : at + CHUNK]
        q = b[(b[:, 1] < p[:, 3].max()) & (b[:, 3] > p[:, 1].min())]
        d, f = p[:, 2:] - p[:, :2], q[:, 2:] - q[:, :2]
        cross = d[:, None, 0] * f[None, :, 1] - d[:, None, 1] * f[None, :, 0]
        off = q[None, :, :2] - p[:, None, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[..., 0] * f[None, :, 1] - off[..., 1] * f[None, :, 0]) / cross
            u = (off[..., 0] * d[:, None, 1] - off[..., 1] * d[:, None, 0]) / cross
        i, j = np.nonzero((t > 0) & (t < 1) & (u > 0) & (u < 1))
        out.append(p[i, 1] + t[i, j] * d[i, 1])
    return np.concatenate(out or [np.zeros(0)])


def _leaves(a: np.ndarray, b: np.ndarray, low: float, high: float) -> Iterator[tuple[np.ndarray, np.ndarray, float, float]]:
    """Upward edges of two polygons by ranges of height, from the lowest on, each with the edges that are in it; ranges end at vertices."""
    ys = np.concatenate([a[:, [1, 3]].ravel(), b[:, [1, 3]].ravel()])
    if not len(ys):
        return
    todo = [(a, b, max(low, ys.min()), min(high, ys.max()))]
    while todo:
        a, b, low, high = todo.pop()
        a, b = (e[(e[:, 1] < high) & (e[:, 3] > low)] for e in (a, b))
        ys = np.concatenate([a[:, [1, 3]].ravel(), b[:, [1, 3]].ravel()])
        ys = ys[(ys > low) & (ys < high)]
        if len(a) + len(b) <= LEAF or not len(ys):
            yield a, b, low, high
            continue
        mid = np.partition(ys, len(ys) // 2)[len(ys) // 2]
        todo += [(a, b, mid, high), (a, b, low, mid)]


def trapezoids(a: np.ndarray, b: np.ndarray, how: str = "intersection", low: float = -np.inf, high: float = np.inf) -> Iterator[tuple[float, float, float, float, float, float]]:
    """(lo, hi, left and right at lo, left and right at hi) of what both polygons (intersection) or either (union) hold between two heights.

    Polygons are edges x1, y1, x2, y2; holes and parts count by the even-odd rule.
    """
    a, b = (_upwards(np.asarray(e, dtype=float).reshape(-1, 4)) for e in (a, b))
    for p, q, lo, hi in _leaves(a, b, low, high):
        yield from _slabs(p, q, how, lo, hi)


def _slabs(a: np.ndarray, b: np.ndarray, how: str, low: float, high: float):
    ys = np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], _crossings(a, b), [low, high]])
    ys = np.unique(ys[(ys >= low) & (ys <= high)])
    for lo, hi in zip(ys[:-1].tolist(), ys[1:].tolist(), strict=True):
        mid = (lo + hi) / 2
        if not lo < mid < hi:  # no number between: no area
            continue
        x, y = (_at(e, mid, lo, hi) for e in (a, b))
        if how == "intersection":
            # spans of one polygon are apart and in order, so those of the other that meet one are neighbours
            mx, my = x.sum(axis=-1), y.sum(axis=-1)
            first, end = np.searchsorted(my[:, 1], mx[:, 0], "right"), np.searchsorted(my[:, 0], mx[:, 1], "left")
            n = np.maximum(0, end - first)
            i = np.repeat(np.arange(len(x)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            left, right = np.maximum(x[i, 0], y[j, 0]), np.minimum(x[i, 1], y[j, 1])
            keep = right.sum(axis=-1) > left.sum(axis=-1)
            spans = zip(left[keep].tolist(), right[keep].tolist(), strict=True)
        else:
            spans, both = [], sorted(np.concatenate([x, y]).tolist(), key=lambda s: sum(s[0]))
            for p, q in both:
                if spans and sum(p) <= sum(spans[-1][1]):
                    spans[-1] = (spans[-1][0], max(spans[-1][1], q, key=sum))
                else:
                    spans.append((p, q))
        for p, q in spans:
            yield lo, hi, p[0], q[0], p[1], q[1]


def common_area(a: np.ndarray, b: np.ndarray, low: float = -np.inf, high: float = np.inf) -> float:
    """Planar area that two polygons share between two heights."""
    return sum((hi - lo) * (b0 - a0 + b1 - a1) / 2 for lo, hi, a0, b0, a1, b1 in trapezoids(a, b, "intersection", low, high))


def banded_edges(rings: DataFrame, size: float, pid: str, name: str) -> DataFrame:
    """(pid, band, edges): a polygon's edges in each band of latitude that they meet."""
    e = ring_edges(rings)
    band = F.sequence(F.floor(F.least("y1", "y2") / size).cast("int"), F.floor(F.greatest("y1", "y2") / size).cast("int"))
    return e.select(F.col("pid").alias(pid), F.explode(band).alias("band"), F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("e")).groupBy(pid, "band").agg(F.collect_list("e").alias(name))


def banded_pairs(rings_a: DataFrame, rings_b: DataFrame, size: float) -> DataFrame:
    """(pid1, pid2, band, e1, e2): pairs whose boxes overlap, once for each band, with both polygons' edges there."""
    pairs = boxes_overlap(shapes(rings_a), shapes(rings_b), size)
    bands = F.sequence(F.floor(F.col("miny") / size).cast("int"), F.floor(F.col("maxy") / size).cast("int"))
    own = pairs.select("pid1", "pid2", F.explode(bands).alias("band"))
    return own.join(banded_edges(rings_a, size, "pid1", "e1"), ["pid1", "band"]).join(banded_edges(rings_b, size, "pid2", "e2"), ["pid2", "band"])


def overlay_area(rings_a: DataFrame, rings_b: DataFrame, size: float = 4.0) -> DataFrame:
    """(pid1, pid2, area) of all pairs that share an area, in square degrees."""

    @F.pandas_udf("double")
    def area(band: pd.Series, e1: pd.Series, e2: pd.Series) -> pd.Series:
        return pd.Series([common_area(np.stack(x), np.stack(y), k * size, (k + 1) * size) for k, x, y in zip(band, e1, e2, strict=True)], dtype=float)

    parts = banded_pairs(rings_a, rings_b, size).select("pid1", "pid2", area("band", "e1", "e2").alias("a"))
    return parts.groupBy("pid1", "pid2").agg(F.sum("a").alias("area")).filter("area > 0")


def overlay_shapes(rings_a: DataFrame, rings_b: DataFrame, size: float = 4.0) -> DataFrame:
    """(pid1, pid2, xs, ys): what pairs share, as closed trapezoids that meet at their edges only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for p, q, k, e1, e2 in zip(x["pid1"], x["pid2"], x["band"], x["e1"], x["e2"], strict=True):
                rows += [(p, q, *_ring(t)) for t in trapezoids(np.stack(e1), np.stack(e2), "intersection", k * size, (k + 1) * size)]
            yield pd.DataFrame(rows, columns=["pid1", "pid2", "xs", "ys"])

    pairs = banded_pairs(rings_a, rings_b, size).select("pid1", "pid2", "band", "e1", "e2")
    types = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"pid1 {types['pid1']}, pid2 {types['pid2']}, xs array<double>, ys array<double>")


def merged(rings_a: DataFrame, rings_b: DataFrame, how: str, size: float = 4.0) -> DataFrame:
    """(pid, xs, ys): the union or the intersection of the two areas of each pid, as closed trapezoids, band by band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for pid, k, e1, e2 in zip(x["pid"], x["band"], x["e1"], x["e2"], strict=True):
                e1, e2 = (np.stack(e) if e is not None and len(e) else np.zeros((0, 4)) for e in (e1, e2))
                rows += [(pid, *_ring(t)) for t in trapezoids(e1, e2, how, k * size, (k + 1) * size)]
            yield pd.DataFrame(rows, columns=["pid", "xs", "ys"])

    bands = banded_edges(rings_a, size, "pid", "e1").join(banded_edges(rings_b, size, "pid", "e2"), ["pid", "band"], "full" if how == "union" else "inner")
    return bands.select("pid", "band", "e1", "e2").mapInPandas(run, f"pid {dict(bands.dtypes)['pid']}, xs array<double>, ys array<double>")


def as_rings(pieces: DataFrame, pid) -> DataFrame:
    """rings(pid, part, ring, xs, ys) of pieces that meet at their edges only, numbered as parts of a polygon."""
    part = F.row_number().over(Window.partitionBy("pid").orderBy("ys", "xs"))
    return pieces.select(pid.alias("pid"), "xs", "ys").select("pid", part.alias("part"), F.lit(0).alias("ring"), "xs", "ys")


def _ring(t: tuple[float, ...]) -> tuple[list[float], list[float]]:
    lo, hi, a0, b0, a1, b1 = t
    return [a0, a1, b1, b0, a0], [lo, hi, hi, lo, lo]


def planar_area(xs, ys):
    """Square degrees of a closed ring."""
    xs, ys = (F.col(c) if isinstance(c, str) else c for c in (xs, ys))
    at = F.sequence(F.lit(1), F.size(xs) - 1)
    return F.abs(F.aggregate(at, F.lit(0.0), lambda acc, i: acc + F.get(xs, i - 1) * F.get(ys, i) - F.get(xs, i) * F.get(ys, i - 1))) / 2
