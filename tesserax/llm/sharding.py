"""Sharding by Karmarkar-Karp differencing: indivisible groups of equal texts into shards of nearly equal bytes.

A partial partition is a list of shard sums. The two with the largest spread are combined in opposite order, largest sum
with smallest, until one is left. Large groups, at most shards * LARGE of them by their size, are differenced first, in
one place; all others in chunks by a hash of the group, each starting from its part of the large groups' sums, so that
every chunk fills the same shards up. Rows join their group's shard; slots are numbered within buckets of each shard and
shifted by the counts of the buckets before, so no shard is sorted in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import materialise

#: Groups in a chunk, about.
CHUNK = 4096
#: A group is large if it has over 1 / LARGE of a shard's mean bytes: there are fewer than shards * LARGE of them.
LARGE = 64
#: Rows of a shard numbered in one window, about.
SLOTS = 10_000
OVERHEAD = 16


def differenced(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> np.ndarray:
    """The shard of each size, by differencing together with a partial partition `start`, whose shards keep their numbers."""
    start = np.zeros(shards, dtype=np.int64) if start is None else start
    heap, count = [], 0
    # members: for each shard sum, None, a leaf or a pair of such; a leaf >= 0 is a size, -1 - s is start's shard s
    by = np.argsort(-start, kind="stable")
    heap.append((-int(start.max() - start.min()), count, start[by], [-1 - int(s) for s in by]))
    for i in np.argsort(-sizes, kind="stable").tolist():
        count += 1
        sums = np.zeros(shards, dtype=np.int64)
        sums[0] = sizes[i]
        heap.append((-int(sizes[i]) if shards > 1 else 0, count, sums, [i, *[None] * (shards - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, am = heapq.heappop(heap)
        _, _, b, bm = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums, order = sums[order], order.tolist()
        bm = bm[::-1]
        members = [(am[k], bm[k]) if am[k] is not None and bm[k] is not None else am[k] if bm[k] is None else bm[k] for k in order]
        count += 1
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), count, sums, members))
    out = np.zeros(len(sizes), dtype=np.int32)
    for tree in heap[0][3]:
        leaves, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                leaves.append(x)
        shard = next(-1 - x for x in leaves if x < 0)
        out[[x for x in leaves if x >= 0]] = shard
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) with law `bytes`.

    size: UTF-8 bytes of the text (null: none) plus 16. Equal texts (null ones too, apart from empty ones) share a shard, so
    a group larger than a mean shard makes that shard as large as itself. Repeated and null ids are rows like any other;
    an empty table gives no row. grown_shard is null: only the law `key` defines it.
    """
    t = F.col(text)
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long")
    group = F.coalesce(F.unhex(F.md5(t.cast("binary"))), F.lit(b"").cast("binary"))
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), group.alias("g")), "rows")
    groups = materialise(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_groups, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = total / (shards * LARGE)
    large = groups.filter(F.col("bytes") > limit).select("g", "bytes").orderBy(F.col("bytes").desc(), "g").collect()  # fewer than shards * LARGE
    at = differenced(np.array([r["bytes"] for r in large], dtype=np.int64), shards)
    start = np.bincount(at, weights=[r["bytes"] for r in large], minlength=shards).astype(np.int64)
    chunks = max(1, -(-n_groups // CHUNK))
    rest = max(1, total - int(start.sum()))

    def chunk(x: pa.Table) -> pa.Table:
        x = x.sort_by([("bytes", "descending"), ("g", "ascending")])
        sizes = x.column("bytes").to_numpy()
        share = np.floor(start * (sizes.sum() / rest)).astype(np.int64)
        return pa.table({"g": x.column("g"), "shard": pa.array(differenced(sizes, shards, share), pa.int32())})

    spark = docs.sparkSession
    small = groups.filter(F.col("bytes") <= limit).select("g", "bytes", F.pmod(F.xxhash64("g"), F.lit(chunks)).cast("int").alias("chunk"))
    placed = small.groupBy("chunk").applyInArrow(chunk, "g binary, shard int")
    fixed = spark.createDataFrame([(bytes(r["g"]), int(s)) for r, s in zip(large, at, strict=True)], "g binary, shard int")
    placed = rows.join(placed.unionByName(fixed), "g").drop("g")
    return with_slots(placed, shards, n_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(rows: DataFrame, shards: int, n_rows: int) -> DataFrame:
    """rows with slot: gapless from 0 within each shard, by bucket, doc_id and contents."""
    buckets = max(16, n_rows // (shards * SLOTS))
    rows = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")), "placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("k", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.col("k")).cast("long"))
