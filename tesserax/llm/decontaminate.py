"""Benchmark decontamination: rare word n-grams of test items seed, Smith-Waterman alignment decides.

1. An item's seeds are, of every STRETCH n-grams in a row, the one that fewest items have, counted over the whole benchmark:
   so each passage of an item has seeds, the rarest it offers, however many items share it.
2. Documents are read once. A Bloom filter of the seeds, of bounded size, goes to the tasks; what passes leaves a document's
   word hashes with the places of its candidate n-grams. Exact copies of a text are one from here on.
3. Candidates join the seeds, and each pair of text and item is aligned, word by word, around its seeds; pairs that have too
   few words in common to reach the score are not aligned. The score is the alignment's over the item's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import fresh, materialise, partitions

WIDTH = 5
STRETCH = 8
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 1, -1, 1
#: Bits of the filter for each seed, and its least and greatest size: 128 MB at most.
SEED_BITS, FEWEST_BITS, MOST_BITS = 64, 1 << 16, 1 << 30
#: Rows of found texts up to which they are broadcast.
FEW_FOUND = 500_000
SEPARATOR = r"[^\pL\pN]+"
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and numbers, lower-cased) of some texts, and where each text's begin and end."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), SEPARATOR)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    index = coded.indices.to_numpy()
    full = np.array([len(x) > 0 for x in names], dtype=bool)[index]
    ends = np.r_[0, np.cumsum(full)][lists.offsets.to_numpy()]
    return hashes[index[full]], ends.astype(np.int64)


def grams(words: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of every `width` words in a row; of a shorter text, of all its words together."""
    size, none = np.diff(ends), np.zeros(0, dtype=np.int64)
    h = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width if len(h) else 0):
        h += _mixed(words[k : k + len(h)] ^ _POWERS[k % 5]) * _POWERS[k % 5]
    of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words)) - np.repeat(ends[:-1], size)
    whole = np.flatnonzero(place[: len(h)] + width <= size[of[: len(h)]]) if len(h) else none
    texts, places, found = [of[whole]], [place[whole]], [_mixed(h[whole])]
    for t in np.flatnonzero((size > 0) & (size < width)).tolist():
        own = words[ends[t] : ends[t + 1]]
        texts.append(np.array([t]))
        places.append(np.array([0]))
        found.append(_mixed((_mixed(own ^ _POWERS[: len(own)]) * _POWERS[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
    return np.concatenate(texts), np.concatenate(places), np.concatenate(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences of words, and where in the passage it ends."""
    slope = GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, dtype=np.int64), 0, 0
    for w in item:
        up = np.maximum(row - GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(up + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def aligned(own: np.ndarray, words: np.ndarray, places: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(score, first and end word) at the best place of an item in a text, around the places of its seeds; None under `least`."""
    n, best, seen = len(own), (0, 0, 0), set()
    at = np.sort(places)
    cuts = np.flatnonzero(np.diff(at) > 2 * n) + 1
    for some in np.split(at, cuts):
        lo, hi = max(0, int(some[0]) - 2 * n), min(len(words), int(some[-1]) + WIDTH + 2 * n)
        passage = words[lo:hi]
        if (key := passage.tobytes()) in seen or np.isin(own, passage).sum() < least * n:
            continue
        seen.add(key)
        score, end = smith_waterman(own, passage)
        best = max(best, (score, -(lo + max(0, end - n)), -(lo + end)))
    return (best[0] / (MATCH * n), -best[1], -best[2]) if best[0] >= least * MATCH * n else None


def _key(text: str = "text") -> Column:
    return F.md5(F.col(text).cast("binary"))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, grams): every different item with a word, its word hashes and its n-grams' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends = word_hashes(b.column(2))
            text, _, found = grams(words, ends)
            order = np.argsort(text, kind="stable")
            starts = np.searchsorted(text[order], np.arange(b.num_rows + 1))
            as_lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_lists(ends, words), as_lists(starts, found[order])], names=["item", "item_id", "words", "grams"])

    own = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    own = own.select(F.concat_ws(":", F.col("item_id").cast("string"), _key()).alias("item"), "item_id", "text")
    return own.mapInArrow(run, "item string, item_id long, words array<long>, grams array<long>").filter("size(words) > 0")


def seeds(items: DataFrame) -> DataFrame:
    """(item, gram): of every STRETCH n-grams in a row of an item that which fewest items have."""
    each = items.select("item", F.posexplode("grams").alias("at", "gram"))
    often = each.select("item", "gram").distinct().groupBy("gram").agg(F.count("*").alias("items"))
    ranked = each.join(often, "gram").groupBy("item", F.floor(F.col("at") / STRETCH).alias("stretch"))
    return ranked.agg(F.min(F.struct("items", "gram")).alias("s")).select("item", F.col("s.gram").alias("gram")).distinct()


def _bloom(found: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Packed bits of a filter of n seeds, made by Spark and gathered word by word, and their number as a power of two."""
    power = int(min(MOST_BITS, max(FEWEST_BITS, SEED_BITS * n))).bit_length() - 1
    at = F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("gram", k), 64 - power) for k in (0, 20, 34)))).alias("at")
    words = found.select(at).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    bits = np.zeros(1 << (power - 6), dtype=np.int64)
    for x in words.toPandas().itertuples(index=False):
        bits[x.w] = x.b
    return bits.view(np.uint64), power


def _passes(bits: np.ndarray, power: int, gram: np.ndarray) -> np.ndarray:
    out = np.arange(len(gram))
    for k in (0, 20, 34):
        at = gram[out] << np.uint64(k) >> np.uint64(64 - power)
        out = out[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1]
    return out


def found_texts(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(key, item_id, score, seeds, first_word, end_word) for each different text (key: its md5) and item that align with min_score or more."""
    spark = docs.sparkSession
    items = materialise(_items(benchmark), "items")
    seed = materialise(seeds(items), "seeds")
    shipped = spark.sparkContext.broadcast(_bloom(seed.select("gram").distinct(), seed.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, power = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                words, ends = word_hashes(some.column(1))
                text, place, found = grams(words, ends)
                hit = _passes(bits, power, found)
                if not len(hit):
                    continue
                hit = hit[np.argsort(text[hit], kind="stable")]
                docs_, first = np.unique(text[hit], return_index=True)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.r_[first, len(hit)], pa.int32()), pa.array(x))
                size = ends[docs_ + 1] - ends[docs_]
                own = np.concatenate([words[ends[d] : ends[d + 1]] for d in docs_.tolist()])
                own = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(docs_)), own, lists(found[hit].view(np.int64)), lists(place[hit])], names=["key", "words", "grams", "places"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    texts = docs.filter("text is not null").select(_key().alias("key"), "text")
    texts = texts.mapInArrow(run, "key string, words array<long>, grams array<long>, places array<long>").dropDuplicates(["key"])
    texts = materialise(texts, "texts")
    hits = texts.select("key", F.inline(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("place"))))
    pairs = hits.join(seed, "gram").groupBy("key", "item").agg(F.collect_set("place").alias("places"))
    pairs = pairs.join(texts.select("key", "words"), "key").join(items.select("item", "item_id", F.col("words").alias("own")), "item")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                key, item_id, places, words, own = (b.column(k)[r] for k in range(5))
                places, words, own = (np.asarray(x.values) for x in (places, words, own))
                if found := aligned(own, words, places, min_score):
                    rows.append((key.as_py(), item_id.as_py(), found[0], len(places), *found[1:]))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types, strict=True)], names=["key", "item_id", "score", "seeds", "first_word", "end_word"])

    pairs = pairs.select("key", "item_id", "places", "words", "own").repartition(partitions(spark))
    return materialise(pairs.mapInArrow(align, "key string, item_id long, score double, seeds int, first_word int, end_word int"), "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, seeds, first_word, end_word) for each document and item that align with min_score or more.

    Null and empty texts hold nothing; items of under WIDTH words are found only in documents of the same words, those
    without a word nowhere. Repeated documents each have their rows, repeated items one; extra columns are dropped; an empty
    table on either side gives no row.
    """
    found = found_texts(docs, benchmark, min_score)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key")).join(found, "key").drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that no item aligns with; all columns are kept as they are, rows are judged one by one."""
    found = found_texts(docs, benchmark, min_score).select("key").distinct()
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.coalesce(_key(), F.lit("")))
    found = F.broadcast(found) if found.count() <= FEW_FOUND else found
    return keyed.join(found.withColumnRenamed("key", key), key, "left_anti").select(*docs.columns)
