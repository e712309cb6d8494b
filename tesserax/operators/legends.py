"""Legends: cut points of numeric values, counts of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.sources.records import numbered


def category_legend(df: DataFrame, column: str) -> DataFrame:
    """(value, n, rank): categories by descending count, ties by value. Ranks are counted over ranges, not in one sort."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return numbered(n, [F.col("n").desc(), F.col("value").asc()], "rank").withColumn("rank", F.col("rank").cast("int"))


def cut_points(values: DataFrame, column: str, n: int = 10, kind: str = "even") -> DataFrame:
    """(idx, cut): upper bounds of n classes. even: equal steps; log, log10: equal steps of the logarithm of values shifted to 1 or more;
    size: equal numbers of distinct values. The last is the maximum. Without values, no row."""
    v = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    if kind == "size":
        ranks = numbered(v.distinct(), "v", "k", 0)
        low, more = (F.floor(F.col("total") / n), F.col("total") % n)  # the first `more` classes have one value more
        idx = F.when(F.col("k") < more * (low + 1), F.floor(F.col("k") / (low + 1))).otherwise(more + F.floor((F.col("k") - more * (low + 1)) / F.greatest(low, F.lit(1))))
        ranks = ranks.join(F.broadcast(ranks.agg(F.count("*").alias("total"))))
        return ranks.groupBy(idx.cast("int").alias("idx")).agg(F.max("v").alias("cut"))
    e = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo is not null").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part = (F.col("idx") + 1) / n
    if kind == "even":
        at = F.col("lo") + (F.col("hi") - F.col("lo")) * part
    else:
        shift = F.when(F.col("lo") < 1, 1 - F.col("lo")).otherwise(0.0)
        f, g = (F.log, F.exp) if kind == "log" else (F.log10, lambda x: F.pow(F.lit(10.0), x))
        at = g(f(F.col("lo") + shift) + (f(F.col("hi") + shift) - f(F.col("lo") + shift)) * part) - shift
    return e.select("idx", F.when(F.col("idx") == n - 1, F.col("hi")).otherwise(at).alias("cut"))


def group_sizes(values: DataFrame, column: str, cuts: DataFrame) -> DataFrame:
    """(idx, n_values, n_cells): distinct values and rows with cut before < value <= cut; NaN as idx -1."""
    bounds = cuts.withColumn("prev", F.lag("cut").over(Window.orderBy("idx"))).select("idx", "cut", "prev")
    rows = values.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    own = rows.filter(~F.isnan("v")).join(F.broadcast(bounds), (F.col("v") <= F.col("cut")) & (F.col("prev").isNull() | (F.col("v") > F.col("prev"))))
    sizes = own.groupBy("idx").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_cells"))
    missing = rows.filter(F.isnan("v")).agg(F.lit(-1).alias("idx"), F.lit(0).cast("long").alias("n_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells")).filter("n_cells > 0")
    full = cuts.select("idx").join(sizes, "idx", "left").na.fill(0, ["n_values", "n_cells"])
    return full.unionByName(missing)


def score(values: DataFrame, column: str, n: int = 10, kinds: tuple[str, ...] = ("even", "log", "log10")) -> DataFrame:
    """(kind, score, chosen): population deviation of class sizes, in distinct values, of each kind of legend; the lowest is
    chosen, of equal ones the first kind."""
    out = None
    for k, kind in enumerate(kinds):
        sizes = group_sizes(values, column, cut_points(values, column, n, kind)).filter("idx >= 0")
        one = sizes.agg(F.stddev_pop("n_values").alias("score")).select(F.lit(k).alias("k"), F.lit(kind).alias("kind"), "score")
        out = one if out is None else out.unionByName(one)
    best = F.broadcast(out.agg(F.min_by("k", F.struct("score", "k")).alias("best")))  # one row
    return out.join(best).select("kind", "score", (F.col("k") == F.col("best")).alias("chosen"))


def equal_area(values: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(idx, cut): at most n classes of nearly equal numbers of rows, by their upper bounds.

    A value that has a share (rows / n) or more to itself is a class, and so is what lies between two such, as far as there
    are classes; those left over are dealt to the stretches between by their rows, a stretch of k classes being cut where
    its running count passes the next k-th of its rows. All counts run over range partitions, so every number of values takes the same way; what
    is gathered is one row a stretch: there are at most 2 n + 1.
    """
    v = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = numbered(v.groupBy("v").agg(F.count("*").alias("n")), "v", "k")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return values.sparkSession.createDataFrame([], "idx int, cut double")
    heavy = [r.k for r in counts.filter(F.col("n") >= total / n).orderBy("k").collect()]  # n at most
    # stretch 2 i lies before the i-th heavy value, 2 i + 1 is that value
    k = F.col("k")
    stretch = sum((F.when(k > h, 2).when(k == h, 1).otherwise(0) for h in heavy), F.lit(0)).cast("int")
    counts = counts.withColumn("s", stretch)
    held = {r.s: (r.rows, r.values) for r in counts.groupBy("s").agg(F.sum("n").alias("rows"), F.count("*").alias("values")).collect()}
    light = {s: x for s, x in held.items() if s % 2 == 0}
    # too many: the smallest stretches go to the heavy value after them; the last one, which has none, fits without
    before = sorted((x[0], s) for s, x in light.items() if s + 1 in held)[: max(0, len(held) - n)]
    joined = {s for _, s in before}
    share, spare = {s: 1 for s in light if s not in joined}, n - len(held) + len(joined)
    while spare > 0 and (open_ := [s for s in share if share[s] < light[s][1]]):
        s = max(open_, key=lambda s: (light[s][0] / share[s], -s))
        share[s], spare = share[s] + 1, spare - 1
    if joined:
        counts = counts.withColumn("s", F.when(F.col("s").isin(*joined), F.col("s") + 1).otherwise(F.col("s")))
    part = F.lit(1).cast("long")
    for s, c in share.items():
        part = F.when(F.col("s") == s, F.ceil(F.col("upto") * c / light[s][0])).otherwise(part)
    cuts = running_sum(counts, "s", "k", "n", "upto").groupBy("s", part.alias("part")).agg(F.max("v").alias("cut"))
    return numbered(cuts, "cut", "idx", 0).select(F.col("idx").cast("int"), "cut")


def running_sum(df: DataFrame, group: str, order: str, of: str, name: str, width: int = 10_000) -> DataFrame:
    """df with the sum of a column up to each row within its group, in the order of gapless numbers: by blocks of those, then within each."""
    own = df.withColumn("_b", F.floor(F.col(order) / width))
    sums = own.groupBy(group, "_b").agg(F.sum(of).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(of).over(Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn(name, inside).join(sums.select(group, "_b", before.alias("_o")), [group, "_b"]).withColumn(name, F.col(name) + F.col("_o")).drop("_b", "_o")


def decade_legend(df: DataFrame, column: str = "year") -> DataFrame:
    """(lo, hi, n) by decades of ten years from a multiple of ten."""
    lo = (F.floor(F.col(column) / 10) * 10).cast("int")
    return df.groupBy(lo.alias("lo")).agg(F.count("*").alias("n")).select("lo", (F.col("lo") + 9).alias("hi"), "n")


def field_legend(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(label, n): equal-area classes of a numeric column by upper bound, else categories by count."""
    if dict(df.dtypes)[column] == "string":
        return category_legend(df, column).select(F.col("value").alias("label"), "n")
    cuts = equal_area(df, column, n)
    return group_sizes(df, column, cuts).join(cuts, "idx").select(F.col("cut").cast("string").alias("label"), F.col("n_cells").alias("n"))


def tail_rolled_up(df: DataFrame, column: str, keep: int) -> DataFrame:
    """(label, n): the first `keep` categories, the rest as one `k more` with their sum; without zero counts."""
    ranked = category_legend(df, column)
    rest = ranked.filter(F.col("rank") > keep).agg(F.concat(F.count("*").cast("string"), F.lit(" more")).alias("label"), F.sum("n").alias("n")).filter("n > 0")
    return ranked.filter(F.col("rank") <= keep).select(F.col("value").alias("label"), "n").unionByName(rest)
