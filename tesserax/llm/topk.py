"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector's terms are its non-zero components, its weights floor(scale * x). Candidates are packed into blocks with
postings by term; queries into blocks of sparse rows. A task takes a block of each: for every query row it walks the row's
terms and adds weight x posting into a dense score array over the block's candidates, then partitions off the k best.
Partial lists are merged by rank. Candidates are shuffled once, into groups of blocks; query blocks are sent once to each
group and stream through it, so neither side is gathered in one place and no pair of rows is written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import materialise

#: Rows in a block of candidates and of queries, about; a task's score array has 8 bytes for each of the former.
CANDIDATES, QUERIES = 2048, 512
#: Candidate blocks that share one copy of a query block.
SHARE = 4


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, w): integer weights of the vectors without null or non-finite components; others take no part."""
    x = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.filter(finite).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("w"))


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, ids, dims, cells) and the number of blocks: rows dealt in turn, `size` to a block on average, as bytes of int64."""
    n = max(1, -(-rows.count() // size))

    def pack(t: pa.Table) -> pa.Table:
        w = t.column("w").combine_chunks()
        w = w.combine_chunks() if isinstance(w, pa.ChunkedArray) else w
        parts = (t.column("vec_id").to_numpy(), np.diff(w.offsets.to_numpy()), w.flatten().to_numpy(zero_copy_only=False))
        return pa.table({"block": t.column("block").slice(0, 1), **{k: pa.array([x.astype(np.int64).tobytes()]) for k, x in zip(("ids", "dims", "cells"), parts, strict=True)}})

    # equal rows part, however many there are
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, dims binary, cells binary"), n


def postings(dims: np.ndarray, cells: np.ndarray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """term: (candidates with a non-zero weight, their weights)."""
    row = np.repeat(np.arange(len(dims)), dims)
    term = np.arange(len(cells)) - np.repeat(np.cumsum(dims) - dims, dims)
    full = np.flatnonzero(cells)
    full = full[np.argsort(term[full], kind="stable")]
    if not len(full):
        return {}
    cuts = np.flatnonzero(np.diff(term[full])) + 1
    return {int(term[x[0]]): (row[x] if len(x) < len(dims) else slice(None), cells[x]) for x in np.split(full, cuts)}


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    near = np.arange(len(score))
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _accumulate(r: dict, k: int) -> list[np.ndarray]:
    """query_id, vec_id, score: the k best of one candidate block for each query of one query block."""
    unpack = lambda *names: (np.frombuffer(r[x], dtype=np.int64) for x in names)
    ids, dims, cells = unpack("ids", "dims", "cells")
    q_ids, q_dims, q_cells = unpack("q_ids", "q_dims", "q_cells")
    terms, ends, out = postings(dims, cells), np.cumsum(q_dims), []
    for query, end, dim in zip(q_ids, ends, q_dims, strict=True):
        row, score = q_cells[end - dim : end], np.zeros(len(ids), dtype=np.int64)
        for t in np.flatnonzero(row).tolist():
            if t in terms:
                at, w = terms[t]
                score[at] += row[t] * w
        others = np.flatnonzero(ids != query)
        top = others[best(ids[others], score[others], k)]
        out.append((np.full(len(top), query), ids[top], score[top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k highest integer inner products, ties to the smaller vec_id.

    A row with the query's own id is no candidate. Components that only one vector has count as 0 in the other. Queries
    without a candidate and null or non-finite ones give no row; of repeated candidate rows each may be returned, repeated
    query rows merge into one list. Extra columns are dropped; an empty table gives no row.
    """
    c, n_c = _blocks(usable(vectors, scale), CANDIDATES)
    q, _ = _blocks(usable(queries, scale).dropDuplicates(["vec_id"]), QUERIES)
    groups = -(-n_c // SHARE)
    c = c.withColumn("share", (F.col("block") % groups).cast("int"))
    q = q.select(*(F.col(x).alias(f"q_{x}") for x in ("ids", "dims", "cells")))
    q = materialise(q, "queries").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = q.join(c.repartition(max(1, min(groups, 100_000)), "share"), "share").select("ids", "dims", "cells", "q_ids", "q_dims", "q_cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = _accumulate(b.slice(i, 1).to_pylist()[0], k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
