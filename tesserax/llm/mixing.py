"""Mixing sources to target weights: tokens per source give a repetition rate; a document is taken floor(rate) times, and
once more if a seeded hash of its id, read as a number in [0, 1), is below the rate's fraction.

All of it is DataFrame operations: one partial aggregate by source, a handful of rows of arithmetic, and a join back of one
row per source. Rows whose id is null or not their own draw by id, text, source, their other columns and their number among rows
equal in all of these, so that they draw apart; which of such rows has which number makes no difference. So what is taken depends
neither on partitioning nor on the order of rows, and reruns agree. A source of few or long documents may miss its target by the luck of
single draws: its expected number of words is the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import WORD, fresh, materialise

#: Repeats of a document that a mix may take at most.
MAX_RATE = 3
WEIGHTS = (5, 2, 1)
#: Rows of the per-source table up to which it is broadcast.
FEW_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    """Words of ASCII white-space separated text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_draw(docs: DataFrame, name: str, seed: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a number in [0, 1): of the id where it is one row's own, else of id, text, source, other columns and the row's number
    among rows equal in all. Only ids are shuffled for that, and the rows that share one; equal rows are counted by partition
    first, so many of them are no one task's work."""
    ids = docs.select(F.col(doc_id).alias("id"))
    shared = materialise(ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select("id"), "shared_ids")
    own = docs.withColumn(name, unit_hash(F.lit(str(seed)), F.col(doc_id).cast("string")))
    if shared.isEmpty():
        return own
    key, h, part, k, before = fresh(docs, "key", "h", "part", "k", "before")
    alone = own.filter(F.col(doc_id).isNotNull()).join(shared.select(F.col("id").alias(key)), F.col(doc_id) == F.col(key), "left_anti")
    # each id as text with a mark, so that null is a value like others
    keyed = docs.withColumn(key, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    several = keyed.join(shared.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias(key)), key, "left_semi")
    marked = lambda c: F.md5(F.coalesce(F.concat(F.lit("t"), F.col(c).cast("string")), F.lit("n")).cast("binary"))
    rest = [c for c in docs.columns if c not in (doc_id, text, "source")]
    parts = [marked(c) for c in (text, "source") if c in docs.columns] + ([F.md5(F.to_json(F.struct(*rest)).cast("binary"))] if rest else [])
    several = materialise(several.withColumns({h: F.concat_ws(":", *parts), part: F.spark_partition_id()}), "repeated")
    sizes = several.groupBy(key, h, part).agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy(key, h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = several.withColumn(k, F.row_number().over(Window.partitionBy(key, h, part).orderBy(key)))
    number = number.join(sizes.select(key, h, part, offset.alias(before)), [key, h, part])
    several = number.withColumn(name, unit_hash(F.lit(str(seed)), key, h, (F.col(k) + F.col(before)).cast("string")))
    return alone.unionByName(several.select(*own.columns))


def source_targets(sizes: DataFrame, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): sources by code point, null last, weigh `weights` in turn.

    Targets share the total by weight but stop at max_rate times the source's size; what is cut off is shared by weight
    among the others until none is above. In closed form: with sources in order of cap / weight, the first k are cut off,
    where k is the least with (total - caps so far) / weight left x own weight <= own cap for the next.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_rate)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total, used = F.sum("source_size").over(every), F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumns({"rest": total - used, "left": F.sum("weight").over(after)})
    cut = F.col("rest") * F.col("weight") > F.col("cap") * F.col("left")
    first = F.min(F.when(~cut, F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("source").isNull().alias("b"), F.col("source").alias("c"), "rest", "left"))).over(every)
    per = per.withColumn("_first", first)
    share = F.col("_first.rest").cast("double") * F.col("weight").cast("double") / F.col("_first.left").cast("double")
    return per.select("source", "source_size", F.when(cut, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _rated(docs: DataFrame, seed: int, max_rate: int, weights: tuple[int, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with size, source_size, target and copies, under names that docs has not, and those names."""
    names = ("size", "source_size", "target", "copies", "draw", "source")
    as_ = dict(zip(names, fresh(docs, *names), strict=True))
    sizes = docs.select("source", word_count().alias("size"))
    targets = materialise(source_targets(sizes, max_rate, weights), "targets")
    few = targets.count() <= FEW_SOURCES
    targets = targets.select(F.col("source").alias(as_["source"]), F.col("source_size").alias(as_["source_size"]), F.col("target").alias(as_["target"]))
    rate = F.when(F.col(as_["source_size"]) > 0, F.col(as_["target"]) / F.col(as_["source_size"])).otherwise(0.0)
    sized = with_draw(docs, as_["draw"], seed).withColumn(as_["size"], word_count())
    out = sized.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col(as_["source"])))
    copies = F.floor(rate) + (F.col(as_["draw"]) < rate - F.floor(rate)).cast("long")
    return out.withColumn(as_["copies"], copies.cast("long")).drop(as_["source"], as_["draw"]), as_


def mix(docs: DataFrame, seed: int = 17, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target, copies (0 to max_rate) and taken (copies x size); columns of these names are replaced, all others kept.

    Null texts and texts without a word have size 0 and are still taken by their source's rate (rate 0 in a source without
    words). Null sources are one source. Repeated rows and null ids count and draw each. An empty table gives no row.
    """
    new = ("size", "source_size", "target", "copies")
    out, as_ = _rated(docs, seed, max_rate, weights)
    kept = [F.col(c) for c in docs.columns if c.lower() not in (*new, "taken")]
    return out.select(*kept, *(F.col(as_[c]).alias(c) for c in new), (F.col(as_["copies"]) * F.col(as_["size"])).alias("taken"))


def mixed_copies(docs: DataFrame, seed: int = 17, max_rate: int = MAX_RATE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs as they are."""
    out, as_ = _rated(docs, seed, max_rate, weights)
    (copy,) = fresh(out, "copy")
    out = out.filter(F.col(as_["copies"]) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(as_["copies"]).cast("int")))).select(*docs.columns)
