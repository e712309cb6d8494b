"""Delaunay triangulations of groups of points: stars of points cell by cell, what no cell can settle in wider cells, the rest at once."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.sources.scratch import materialise

ROWS = "species string, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, open boolean"
#: A cell is 32 times as wide as the widest circle that is looked at in it, and so has points from a sixteenth around it.
WIDE = 32.0
#: Error of a product of two differences of doubles, as a share of the squares of what is multiplied.
EPS = 2.0**-49


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of (n, 2), anticlockwise, without the first point again."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for z in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (z[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (z[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(tuple(z))
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def delaunay(p: np.ndarray) -> np.ndarray:
    """(m, 3) vertex numbers of a Delaunay triangulation of distinct points, by divide and conquer over quad edges.

    Coordinates become integers of one power of two, so that every test is exact: points on a line or on a circle need no shift. Points
    on one circle are all joined with the least of them (by x, then y), so each part of a triangulation is that of the points near it.
    """
    order = np.lexsort((p[:, 1], p[:, 0]))
    if len(p) < 3:
        return np.zeros((0, 3), dtype=np.int64)
    exact = [(x.as_integer_ratio(), y.as_integer_ratio()) for x, y in p[order].tolist()]
    unit = max(max(x[1], y[1]) for x, y in exact)
    xs, ys = ([z[k][0] * (unit // z[k][1]) for z in exact] for k in (0, 1))
    org, nxt, prv = array("q"), array("q"), array("q")  # edge e starts at org[e]; e ^ 1 is its other direction
    live = bytearray()

    def edge(a: int, b: int) -> int:
        e = len(org)
        for x in (org, nxt, prv):
            x.extend((a, b) if x is org else (e, e + 1))
        live.append(1)
        return e

    def splice(a: int, b: int) -> None:
        if a != b:
            prv[nxt[a]], prv[nxt[b]] = b, a
            nxt[a], nxt[b] = nxt[b], nxt[a]

    def connect(a: int, b: int) -> int:
        e = edge(org[a ^ 1], org[b])
        splice(e, prv[a ^ 1])
        splice(e ^ 1, b)
        return e

    def delete(e: int) -> None:
        splice(e, prv[e])
        splice(e ^ 1, prv[e ^ 1])
        live[e >> 1] = 0

    def side(k: int, e: int) -> int:
        """Positive where point k is on one side of the edge, negative on the other."""
        a, b, x, y = org[e], org[e ^ 1], xs[k], ys[k]
        return (xs[a] - x) * (ys[b] - y) - (ys[a] - y) * (xs[b] - x)

    def inside(a: int, b: int, c: int, d: int) -> bool:
        x, y = xs[d], ys[d]
        a1, a2, b1, b2, c1, c2 = xs[a] - x, ys[a] - y, xs[b] - x, ys[b] - y, xs[c] - x, ys[c] - y
        bc, ca, ab = b1 * c2 - b2 * c1, a2 * c1 - a1 * c2, a1 * b2 - a2 * b1
        found = (a1 * a1 + a2 * a2) * bc + (b1 * b1 + b2 * b2) * ca + (c1 * c1 + c2 * c2) * ab
        if found == 0:  # the least point counts as a trifle further in
            least = min(a, b, c, d)
            found = bc + ca + ab if least == d else -bc if least == a else -ca if least == b else -ab
        return found < 0

    def made(lo: int, hi: int) -> tuple[int, int]:
        if hi - lo == 2:
            a = edge(lo, lo + 1)
            return a, a ^ 1
        if hi - lo == 3:
            a, b = edge(lo, lo + 1), edge(lo + 1, lo + 2)
            splice(a ^ 1, b)
            turn = side(lo + 2, a)
            if turn == 0:
                return a, b ^ 1
            c = connect(b, a)
            return (a, b ^ 1) if turn > 0 else (c ^ 1, c)
        mid = (lo + hi + 1) // 2
        (left_out, left), (right, right_out) = made(lo, mid), made(mid, hi)
        while True:
            if side(org[right], left) > 0:
                left = nxt[left ^ 1]
            elif side(org[left], right) < 0:
                right = prv[right ^ 1]
            else:
                break
        base = connect(left ^ 1, right)
        left_out = base if org[left] == org[left_out] else left_out
        right_out = base ^ 1 if org[right] == org[right_out] else right_out
        while True:
            r, q = nxt[base ^ 1], prv[base]
            on_r, on_q = side(org[r ^ 1], base) > 0, side(org[q ^ 1], base) > 0
            if not (on_r or on_q):
                return left_out, right_out
            if on_r:
                while side(org[nxt[r] ^ 1], base) > 0 and inside(org[base ^ 1], org[base], org[r ^ 1], org[nxt[r] ^ 1]):
                    t = nxt[r]
                    delete(r)
                    r = t
            if on_q:
                while side(org[prv[q] ^ 1], base) > 0 and inside(org[base ^ 1], org[base], org[q ^ 1], org[prv[q] ^ 1]):
                    t = prv[q]
                    delete(q)
                    q = t
            if not on_r or on_q and inside(org[r ^ 1], org[r], org[q], org[q ^ 1]):
                base = connect(q, base ^ 1)
            else:
                base = connect(base ^ 1, r ^ 1)

    made(0, len(p))
    start, before = np.frombuffer(org, dtype=np.int64), np.frombuffer(prv, dtype=np.int64)
    e = np.flatnonzero(np.repeat(np.frombuffer(live, dtype=np.uint8), 2))
    second = before[e ^ 1]
    third = before[second ^ 1]
    t = np.column_stack([start[e], start[second], start[third]])
    t = t[(before[third ^ 1] == e) & (t[:, 0] < t[:, 1]) & (t[:, 0] < t[:, 2])]
    turns = [(xs[b] - xs[a]) * (ys[c] - ys[a]) - (ys[b] - ys[a]) * (xs[c] - xs[a]) for a, b, c in t.tolist()]
    return order[t[np.array([x < 0 for x in turns], dtype=bool)][:, ::-1]]


def settled(x: np.ndarray, y: np.ndarray, v: int, u: int, cs: list[int]) -> int:
    """Of the points cs left of the edge from v to u the one that makes a Delaunay triangle with it, in integers; -1 if none is left of it."""
    exact = [(float(x[k]).as_integer_ratio(), float(y[k]).as_integer_ratio()) for k in (v, u, *cs)]
    unit = max(max(a[1], b[1]) for a, b in exact)
    (vx, vy), (ux, uy), *own = [(a[0] * (unit // a[1]), b[0] * (unit // b[1])) for a, b in exact]
    ux, uy = ux - vx, uy - vy
    best: list = []
    for k, (px, py) in zip(cs, own, strict=True):
        px, py = px - vx, py - vy
        den, dot = ux * py - uy * px, px * ux + py * uy
        if den > 0:
            num = px * px + py * py - dot
            order = num * best[0][2] - best[0][1] * den if best else -1
            if order <= 0:
                best = [*(best if order == 0 else []), (k, num, den, dot)]
    if not best:
        return -1
    least = min(v, u, *(b[0] for b in best))
    turn = best[0]
    for b in best:
        ahead = b[3] * turn[2] - turn[3] * b[2]  # positive where b comes before turn, as seen from v
        if (least == v and ahead > 0) or (least == u and ahead < 0):
            turn = b
    return turn[0] if least in (v, u) else least


def wrapped(x, y, v, near, reach, exact):
    """(done, v, u, w): whether the star of each of v is found among its row of `near` (v itself is none), and the triangles of those stars.

    From a point's nearest neighbour on, the next is the point left of the edge whose circle has no other in it; of several on the circle,
    as `delaunay` does. A star counts if it closes with circles no wider than reach, within which a row must have every point.
    """
    px, py = x[near] - x[v][:, None], y[near] - y[v][:, None]
    n2 = px * px + py * py
    far = (px == 0) & (py == 0)
    ok = ~far.all(axis=1) & ~(~far & (n2 < 1e-200)).any(axis=1)
    first = np.where(far, np.inf, n2).argmin(axis=1)
    row = np.flatnonzero(ok)  # of v; the arrays have a row for each of these
    px, py, n2, near, start = px[row], py[row], n2[row], near[row], first[row]
    at, live, made = start.copy(), np.ones(len(row), dtype=bool), []
    while live.any():
        if live.sum() < 0.7 * len(live):
            row, px, py, n2, near, start, at = (z[live] for z in (row, px, py, n2, near, start, at))
            live = np.ones(len(row), dtype=bool)
        every = np.arange(len(row))
        ux, uy, u2, u = px[every, at][:, None], py[every, at][:, None], n2[every, at], near[every, at]
        den, dot = ux * py - uy * px, ux * px + uy * py
        num = n2 - dot
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = np.where(den > 0, num / den, np.inf)
            if exact:
                to = t.argmin(axis=1)
                chosen = t[every, to]
                tied = t == chosen[:, None]
                several = np.flatnonzero(live & np.isfinite(chosen) & (tied.sum(axis=1) > 1))
                if len(several):
                    tie, ids = tied[several], near[several]
                    mine = np.where(tie, ids, len(x))
                    least, a, b = mine.min(axis=1), v[row[several]], u[several]
                    turn = dot[several] / den[several]
                    ahead, behind = np.where(tie, turn, -np.inf).argmax(axis=1), np.where(tie, turn, np.inf).argmin(axis=1)
                    to[several] = np.where(a < np.minimum(b, least), ahead, np.where(b < np.minimum(a, least), behind, mine.argmin(axis=1)))
                sure = np.isfinite(chosen)
            else:
                off = EPS * (n2 + u2[:, None])
                low = np.where(num > off, (num - off) / (den + off), np.where(den > off, (num - off) / (den - off), -np.inf))
                high = np.where(den > off, np.where(num + off > 0, (num + off) / (den - off), (num + off) / (den + off)), np.inf)
                out = (den < -off) | ((px == 0) & (py == 0)) | (near == u[:, None])
                low, high = np.where(out, np.inf, low), np.where(out, np.inf, high)
                may = (low <= high.min(axis=1)[:, None]) & ~out
                to = may.argmax(axis=1)
                sure = may.any(axis=1)
                for k in np.flatnonzero(live & (may.sum(axis=1) > 1)).tolist():
                    own = np.flatnonzero(may[k])
                    c = settled(x, y, int(v[row[k]]), int(u[k]), near[k, own].tolist())
                    sure[k] = c >= 0
                    to[k] = own[(near[k, own] == c).argmax()]
                sure &= den[every, to] > 1024 * off[every, to]
                chosen = t[every, to]
            sure &= u2 * (1 + chosen * chosen) <= reach * reach
        ok[row[live & ~sure]] = False
        live &= sure
        made.append((row[live], u[live], near[every, to][live]))
        at = to
        live &= at != start
    k, u, w = (np.concatenate(z) if made else np.zeros(0, dtype=np.int64) for z in (zip(*made, strict=True) if made else ((), (), ())))
    keep = ok[k]
    return ok, v[k[keep]], u[keep], w[keep]


def stars(x, y, want, reach):
    """(done, v, u, w): for each point whether its star was found, and the anticlockwise triangles of each star found, from its point on.

    x, y: distinct points in ascending order; want: the points looked at, which have every point within `reach` about them here. A star
    is found if none of its circles is wider. A point is first compared with the few in 5 x 5 small buckets, then with those in buckets 1.4 times as wide, and so on.
    """
    done, out, left = np.zeros(len(x), dtype=bool), [], np.flatnonzero(want)
    span = max(np.ptp(x), np.ptp(y)) if len(x) else 0.0
    sizes = [reach / 2]

    def dealt(size):
        bx, by = np.floor((x - x.min()) / size).astype(np.int64), np.floor((y - y.min()) / size).astype(np.int64)
        key = (bx + 2) * (by.max() + 5) + by + 2
        order = np.argsort(key, kind="stable")
        return key, order, key[order], by.max() + 5

    while len(left) and span / sizes[-1] < 2**26 and np.diff(np.flatnonzero(np.diff(dealt(sizes[-1])[2], prepend=-1, append=-1))).max() > 8:
        sizes.append(sizes[-1] / 2**0.5)
    whole = np.concatenate([x, y]) if len(x) else np.zeros(1)
    for size in sizes[::-1]:
        if not len(left):
            break
        key, order, sorted_key, high = dealt(size)
        block = (key[left][:, None] + np.arange(-2, 3) * high)
        lo, hi = np.searchsorted(sorted_key, block - 2, "left"), np.searchsorted(sorted_key, block + 2, "right")
        total = (hi - lo).sum(axis=1)
        tried = np.flatnonzero(total >= (40 if size < sizes[0] else 0))
        tried = tried[np.argsort(total[tried], kind="stable")]
        within = 2 * size * (1 - 1e-6)
        scale = 2.0 ** np.floor(10 - np.log2(5 * size))  # of units of which a block has at most 2^11
        exact = bool((whole * scale == np.floor(whole * scale)).all())
        at, upto = 0, total[tried].cumsum()
        while at < len(tried):
            end = max(at + 1, int(np.searchsorted(upto, 2**16 + (upto[at - 1] if at else 0), "right")))
            own = tried[at:end]
            at = end
            n, rows, mine = (hi - lo)[own].ravel(), total[own], left[own]
            flat = order[np.repeat(lo[own].ravel() - (n.cumsum() - n), n) + np.arange(rows.sum())]
            of = np.repeat(np.arange(len(own)), rows)
            px, py = x[flat] - x[mine][of], y[flat] - y[mine][of]
            inner = px * px + py * py <= within * within
            of, flat = of[inner], flat[inner]
            rows = np.bincount(of, minlength=len(own))
            near = np.repeat(mine[:, None], rows.max(), axis=1)
            near[of, np.arange(len(of)) - np.repeat(rows.cumsum() - rows, rows)] = flat
            ok, *found = wrapped(x, y, mine, near, within, exact)
            done[left[own[ok]]] = True
            out.append(found)
        left = left[~done[left]]
    return done, *(np.concatenate(z) if out else np.zeros(0, dtype=np.int64) for z in (zip(*out, strict=True) if out else ((), (), ())))


def table(species, points, opened, corners) -> pa.Table:
    """Rows of ROWS: points that are left, with `opened`, and triangles by their (m, 3, 2) corners."""
    n, m = len(points), len(corners)
    flat = corners.reshape(m, 6)
    none = pa.nulls(n, pa.float64())
    columns = [pa.concat_arrays([pa.array(points[:, k]) if k < 2 else none, pa.array(np.ascontiguousarray(flat[:, k]))]) for k in range(6)]
    names = ["species", "x1", "y1", "x2", "y2", "x3", "y3", "open"]
    return pa.table([pa.repeat(pa.scalar(species, pa.string()), n + m), *columns, pa.concat_arrays([pa.array(opened, pa.bool_()), pa.nulls(m, pa.bool_())])], names)


def corners(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(m, 3, 2) corners of triangles of vertex numbers in ascending order of points, turned so that the least comes last."""
    last = t.argmin(axis=1)
    return p[np.take_along_axis(t, (last[:, None] + np.arange(1, 4)) % 3, axis=1)]


def settle_cell(key: tuple[pa.Scalar, ...], points: pa.Table) -> pa.Table:
    """Triangles of a cell's points whose stars are found, and those of its points that wider cells need: others, and what is beside them.

    A triangle is put out where the least of its points with a new star lies; triangles of closed points were put out before.
    """
    columns = {c: points[c].to_numpy() for c in ("lon", "lat", "own", "near", "open", "reach")}
    order = np.lexsort((columns["lat"], columns["lon"]))
    x, y, own, near, opened = (columns[c][order] for c in ("lon", "lat", "own", "near", "open"))
    done, v, u, w = stars(x, y, near, columns["reach"][0])
    new = done & opened
    later = lambda k: opened[k] & (~new[k] | (k > v))
    put = own[v] & new[v] & later(u) & later(w)
    beside = np.zeros(len(x), dtype=bool)
    beside[v[opened[u] & ~done[u]]] = True  # each neighbour is u once
    rest = own & (~done | beside)
    p = np.column_stack([x, y])
    return table(key[0].as_py(), p[rest], (opened & ~done)[rest], corners(p, np.column_stack([v, u, w])[put]))


def settle_rest(key: tuple[pa.Scalar, ...], points: pa.Table) -> pa.Table:
    """The other triangles, and a row of the length and number of the edges around all, marked by `open`."""
    p = np.column_stack([points["lon"].to_numpy(), points["lat"].to_numpy()])
    order = np.lexsort((p[:, 1], p[:, 0]))
    p, opened = p[order], points["open"].to_numpy()[order]
    t = delaunay(p)
    around, count = hull(p), 2 * len(p) - 2 - len(t)
    length = np.hypot(*(around - np.roll(around, -1, axis=0)).T).sum()
    return table(key[0].as_py(), np.array([[length, count]]) if len(t) else np.zeros((0, 2)), [True] if len(t) else [], corners(p, t[opened[t].all(axis=1)]))


def triangulated(points: DataFrame, few: int = 4000, cell: int = 80_000) -> DataFrame:
    """Stored ROWS of a Delaunay triangulation of each species' distinct points (species, lon, lat): its triangles, anticlockwise with the least
    point last, and a row whose x1 and y1 are the length and number of the edges around them, with `open` set.

    A species' square is cut into cells of about `cell` points. There the stars of points are found whose circles are small against the
    cell; the points left, and their neighbours, go to cells four times as wide, and so on. What is left at the end, or below `few`
    points, is one task's work: the points around the species, or around large gaps. An edge between kept points stays Delaunay without
    the others, so a point that has all its neighbours keeps its star.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = F.col("species").eqNullSafe(F.col("_s"))
    rest = materialise(points)
    state = rest.groupBy(F.col("species").alias("_s")).agg(
        F.count("*").alias("n"), F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat")).alias("span")
    )
    parts = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / cell) / F.log(F.lit(4.0)))).cast("int")
    state = materialise(state.withColumn("level", F.when((F.col("n") <= few) | (F.col("span") == 0), -1).otherwise(parts)))
    side = F.col("span") / F.pow(F.lit(2.0), F.col("level"))
    at = lambda c, low: F.floor((F.col(c) - F.col(low)) / side)
    while True:  # denser parts: smaller cells
        deep = rest.join(F.broadcast(state.filter(f"level >= 0 and level < 24 and n > {3 * cell}")), same).groupBy("_s", "level", at("lon", "x0"), at("lat", "y0")).count()
        deep = deep.groupBy(F.col("_s").alias("d")).agg(F.max("count").alias("most")).filter(F.col("most") > 3 * cell)
        deep = materialise(deep)
        if deep.isEmpty():
            break
        state = materialise(state.join(F.broadcast(deep), F.col("_s").eqNullSafe(F.col("d")), "left").withColumn("level", F.when(F.col("most").isNull(), F.col("level")).otherwise(F.col("level") + 1)).drop("d", "most"))
    rest, found, last = rest.withColumn("open", F.lit(True)), [], []
    while True:
        here = rest.join(F.broadcast(state), same)
        last.append(here.filter("level < 0").select("species", "lon", "lat", "open"))
        if state.filter("level >= 0").isEmpty():
            break
        here = here.filter("level >= 0").withColumns({"side": side, "px": (F.col("lon") - F.col("x0")) / side, "py": (F.col("lat") - F.col("y0")) / side})
        halo = 2.001 / WIDE
        span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - halo), F.floor(F.col(c) + halo)))
        here = here.withColumn("cx", span("px")).withColumn("cy", span("py"))
        out = lambda c, p: F.greatest(F.col(c) - F.col(p), F.col(p) - F.col(c) - 1)
        own = (F.floor("px") == F.col("cx")) & (F.floor("py") == F.col("cy"))
        here = here.select("species", "cx", "cy", "lon", "lat", own.alias("own"), (F.greatest(out("cx", "px"), out("cy", "py")) <= 1.0005 / WIDE).alias("near"), "open", (F.col("side") / WIDE).alias("reach"))
        made = materialise(here.repartition(tasks, "species", "cx", "cy").groupBy("species", "cx", "cy").applyInArrow(settle_cell, ROWS))
        found.append(made.filter("x3 is not null"))
        rest = made.filter("x3 is null").select("species", F.col("x1").alias("lon"), F.col("y1").alias("lat"), "open")
        left = rest.groupBy(F.col("species").alias("d")).agg(F.count("*").alias("left"))
        up = F.when((F.col("left") <= few) | (F.col("level") == 0), -1).otherwise(F.greatest(F.col("level") - 2, F.lit(0)))
        state = materialise(state.filter("level >= 0").join(F.broadcast(left), F.col("_s").eqNullSafe(F.col("d"))).withColumn("level", up).drop("d", "left"))
    ends = last[0]
    for x in last[1:]:
        ends = ends.unionByName(x)
    out = materialise(ends.repartition(tasks, "species").groupBy("species").applyInArrow(settle_rest, ROWS))
    for x in found:
        out = out.unionByName(x)
    return out
