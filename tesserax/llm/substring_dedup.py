"""Removal of 50-byte strings that an earlier document also has, by suffix arrays over shards of candidate places.

1. Every window of LENGTH bytes has one anchor: the leftmost place in it with the least hash of ANCHOR bytes. Equal
   windows have equal anchors at equal offsets, so windows can be shared only under anchors that several documents have.
   Documents send their anchors' codes to shards by hash; a shard tells each bucket of documents which codes are shared.
2. Buckets cut the places under shared anchors out of their texts, once for equal places, and send them to shards by code.
   A code in over HOT documents is split: each of its windows goes by the window's own hash, so no shard gathers it.
3. A shard joins those windows of its distinct places whose hash comes again to one text, builds the suffix array by
   induced sorting and from it the common prefixes; windows equal over LENGTH bytes form classes, each with its smallest
   doc_id. Runs of windows with a smaller one go back to their bucket as spans.
4. Buckets unite the spans, remove them and hash what is left.

Rows between steps are packed arrays (zstandard), one for each bucket and shard. Buckets and shards grow in number with
the bytes of text, so their sizes stay the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import partitions
from tesserax.llm.suffix_array import Substrings, permuted_common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 16
#: Bytes of text of a bucket and, about, for a shard.
BUCKET_BYTES, SHARD_BYTES = 8_000_000, 6_000_000
#: Documents with a code from which on its windows are dealt one by one.
HOT = 10_000
#: Bytes worked on at once in a bucket, and windows whose anchors are sought at once: few enough for a processor's cache.
SLICE, CHUNK = 2_000_000, 1 << 16
NULL_ID = 2**63 - 1


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(data, "<i8", len(types) + 1)[1:]
    ends = 8 * (len(types) + 1) + np.cumsum(sizes)
    return [np.frombuffer(data, t, n // np.dtype(t).itemsize, e - n) for t, n, e in zip(types, sizes.tolist(), ends.tolist(), strict=True)]


_ODD = 0x7FB5D329728EA185


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return h ^ (h >> np.uint64(27))


def _two_bytes() -> np.ndarray:
    """The hash of each two bytes, by 256 times the first and the second."""
    one = _mixed(np.arange(1, 257, dtype=np.uint64))
    return _mixed((one * np.uint64(_FACTOR))[:, None] + one).ravel()


_FACTOR = 0x9E3779B97F4A7C15 + 2
_TWO = _two_bytes()
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, code): runs of windows under one anchor, in documents raw[offsets[k]:offsets[k + 1]]."""
    none = np.zeros(0, dtype=np.int64)
    n = len(raw) - LENGTH + 1
    if n < 1:
        return none, none, none, none.astype(np.uint64)
    anchor, h = np.empty(n, dtype=np.int32), np.empty(len(raw) - ANCHOR + 1, dtype=np.uint64)
    numbers, choices = np.arange(CHUNK + LENGTH, dtype=np.uint64), LENGTH - ANCHOR + 1
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        part = raw[a : b + LENGTH - 1]
        x, k = _TWO[(part[:-1].astype(np.uint16) << 8) | part[1:]], 2
        while k < ANCHOR:
            y = x[:-k] * np.uint64(_FACTOR - 2 + 2 * k)
            y += x[k:]
            y ^= y >> np.uint64(31)
            y *= np.uint64(_ODD)
            y ^= y >> np.uint64(27)
            x, k = y, 2 * k
        h[a : a + len(x)] = x
        least, k = (x & ~_LOW) | numbers[: len(x)], 1
        while 2 * k <= choices:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if choices > k:
            least = np.minimum(least[: k - choices], least[choices - k :])
        anchor[a:b] = (least & _LOW).astype(np.int32) + np.int32(a)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        anchor[max(a, b - LENGTH + 1) : b] = -1  # so documents' windows never touch
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    runs, anchor = np.diff(np.r_[start, n]), anchor[start]
    start, runs, anchor = (x[anchor >= 0] for x in (start, runs, anchor))
    return np.searchsorted(offsets, start, side="right") - 1, start, runs, h[anchor]


def _shard_and_code(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return (_mixed(h) % np.uint64(shards)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slices(texts: pa.Array):
    """(first row, bytes, offsets) of consecutive rows with about SLICE bytes together; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    encoded = [x.as_buffer() if x.is_valid else b"" for x in texts.cast(pa.large_binary())]
    first, held, size = 0, [], 0
    for k, x in enumerate(encoded):
        held.append(np.frombuffer(x, dtype=np.uint8))
        size += len(x)
        if size >= SLICE or k + 1 == len(encoded):
            yield first, np.concatenate(held), np.r_[0, np.cumsum([len(y) for y in held])].astype(np.int64)
            first, held, size = k + 1, [], 0


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _codes(shards: int):
    """Step 1 in a task: (shard, data) with the distinct codes of each document."""

    def run(batches):
        for b in batches:
            ids, buckets = b.column(0).to_numpy(), b.column(1).to_numpy()
            for first, raw, offsets in _slices(b.column(2)):
                doc, _, _, h = anchors(raw, offsets)
                shard, code = _shard_and_code(h, shards)
                order = np.lexsort((code, doc, shard))
                shard, doc, code = shard[order], doc[order] + first, code[order]
                new = np.r_[True, (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])] if len(doc) else np.zeros(0, bool)
                shard, doc, code = shard[new], doc[new], code[new]
                at, rows = _cuts(shard), []
                for x, y in zip(at, np.r_[at[1:], len(shard)], strict=True):
                    d = _cuts(doc[x:y])
                    own = doc[x:y][d]
                    rows.append((int(shard[x]), _pack(ids[own], buckets[own].astype(np.int32), np.diff(np.r_[d, y - x]).astype(np.uint32), code[x:y])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])

    return run


def _shared():
    """Step 1 in a shard: (bucket, shard, data) with the codes of at least two documents, and whether each is hot."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py(), "<i8", "<i4", "<u4", "<u4") for x in t.column("data")]
        doc, bucket = (np.concatenate([np.repeat(p[k], p[2]) for p in parts]) for k in (0, 1))
        code = np.concatenate([p[3] for p in parts])
        order = np.argsort(code, kind="stable")
        doc, bucket, code = doc[order], bucket[order], code[order]
        at = _cuts(code)
        n = np.diff(np.r_[at, len(code)])
        several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        keep, hot = np.repeat(several, n), np.repeat(n > HOT, n)
        bucket, code, hot = bucket[keep], code[keep], hot[keep]
        order = np.lexsort((code, bucket))
        bucket, code, hot = bucket[order], code[order], hot[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])] if len(code) else np.zeros(0, bool)
        bucket, code, hot = bucket[new], code[new], hot[new]
        at = _cuts(bucket)
        ends = np.r_[at[1:], len(bucket)]
        shard = t.column("shard")[0].as_py()
        return pa.table({
            "bucket": pa.array(bucket[at], pa.int32()), "shard": pa.array(np.full(len(at), shard), pa.int32()),
            "data": pa.array([_pack(code[x:y], hot[x:y].astype(np.uint8)) for x, y in zip(at, ends, strict=True)], pa.binary()),
        })

    return run


def _in_order(docs: pa.Table) -> pa.Table:
    """A bucket's documents in an order that a second run finds again."""
    return docs.sort_by([("id", "ascending"), ("text", "ascending")])


def _places(shards: int):
    """Step 2 in a bucket: (shard, bucket, data) with the distinct places under shared codes and where they are."""

    def run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "bucket": [], "data": []}
        schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
        if not docs.num_rows or not codes.num_rows:
            return pa.table(out, schema=schema)
        known = [(s, *_unpack(d, "<u4", "u1")) for s, d in zip(codes.column("shard").to_pylist(), codes.column("data").to_pylist(), strict=True)]
        key = np.concatenate([(np.uint64(s) << np.uint64(32)) | c.astype(np.uint64) for s, c, _ in known])
        hot = np.concatenate([x for _, _, x in known])
        order = np.argsort(key)
        key, hot = key[order], hot[order].astype(bool)
        docs = _in_order(docs)
        ids = docs.column("id").to_numpy()
        bucket = docs.column("bucket")[0].as_py()
        for first, raw, offsets in _slices(docs.column("text")):
            doc, start, runs, h = anchors(raw, offsets)
            shard, code = _shard_and_code(h, shards)
            own = (shard.astype(np.uint64) << np.uint64(32)) | code
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hit = np.flatnonzero(key[at] == own)
            doc, start, runs, own, split = doc[hit], start[hit], runs[hit], own[hit], hot[at[hit]]
            # windows of hot codes become places of their own
            each = np.where(split, runs, 1)
            part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            doc, own, split = np.repeat(doc, each), np.repeat(own, each), np.repeat(split, each)
            start, runs = np.repeat(start, each) + part, np.where(split, 1, np.repeat(runs, each))
            if not len(doc):
                continue
            size = runs + LENGTH - 1
            digest = Substrings(raw)(start, start + size)
            own = np.where(split, _mixed(digest), own)
            to = np.where(split, _mixed(own ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards), own >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((doc, digest, own, to))
            to, own, digest, doc, start, size = to[order], own[order], digest[order], doc[order], start[order], size[order]
            new = np.r_[True, (to[1:] != to[:-1]) | (own[1:] != own[:-1]) | (digest[1:] != digest[:-1])]
            at = _cuts(to)
            for x, y in zip(at, np.r_[at[1:], len(to)], strict=True):
                d = np.flatnonzero(new[x:y]) + x
                take = np.repeat(start[d] - (np.cumsum(size[d]) - size[d]), size[d]) + np.arange(size[d].sum())
                out["shard"].append(int(to[x]))
                out["bucket"].append(bucket)
                out["data"].append(_pack(own[d], size[d].astype(np.uint32), np.diff(np.r_[d, y]).astype(np.uint32), raw[take], ids[doc[x:y] + first], (doc[x:y] + first).astype(np.uint32), (start[x:y] - offsets[doc[x:y]]).astype(np.uint32)))
        return pa.table(out, schema=schema)

    return run


def least_documents(raw: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window of the places (raw's consecutive parts of the sizes), the smallest `least` of the places that hold it."""
    n, total = len(size), int(size.sum())
    runs = size - LENGTH + 1
    # letters from 2; 1 ends a place, 0 the text
    text = np.ones(total + n + 1, dtype=np.uint16)
    begin = np.cumsum(size + 1) - size - 1
    text[np.arange(total) + np.repeat(np.arange(n), size)] = raw.astype(np.uint16) + 2
    text[-1] = 0
    windows = np.repeat(begin - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    number = np.full(len(text), -1, dtype=np.int64)
    number[windows] = np.arange(len(windows))
    in_order = number[suffix_array(text, LENGTH)]
    in_order = in_order[in_order >= 0]
    place = np.arange(len(windows)) + np.repeat(np.arange(n) * (LENGTH - 1), runs)
    common = permuted_common_prefixes(raw, place, in_order, LENGTH)
    at = np.flatnonzero(common[in_order] < LENGTH)
    of_class = np.minimum.reduceat(np.repeat(least, runs)[in_order], at)
    out = np.empty(len(windows), dtype=np.int64)
    out[in_order] = np.repeat(of_class, np.diff(np.r_[at, len(in_order)]))
    return out


def found_again(hashes: Substrings, begin: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window in it, windows): runs of windows whose hash another window has too, in places with so many windows from
    `begin` on. Equal windows have equal hashes, so every other window is in one place only."""
    at = np.repeat(begin - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    h = hashes(at, at + LENGTH)
    order = np.argsort(h)
    h = h[order]
    same = h[1:] == h[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[order[np.r_[False, same] | np.r_[same, False]]] = True
    first = np.cumsum(runs) - runs
    breaks = np.zeros(len(h), dtype=bool)
    breaks[first] = True
    number = np.flatnonzero(again & (breaks | ~np.r_[False, again[:-1]]))
    stop = np.flatnonzero(again & (np.r_[breaks[1:], True] | ~np.r_[again[1:], False]))
    place = np.searchsorted(first, number, side="right") - 1
    return place, number - first[place], stop + 1 - number


def _spans():
    """Step 3 in a shard: (bucket, data) with the spans of windows that a smaller document has."""

    def run(t: pa.Table) -> pa.Table:
        parts = [_unpack(x, "<u8", "<u4", "<u4", "u1", "<i8", "<u4", "<u4") for x in t.column("data").to_pylist()]
        key, size, n, raw, doc, row, start = (np.concatenate([p[k] for p in parts]) for k in range(7))
        size, n = size.astype(np.int64), n.astype(np.int64)
        bucket = np.repeat(np.array(t.column("bucket").to_pylist(), dtype=np.int64), [len(p[4]) for p in parts])
        begin = np.cumsum(size) - size
        hashes = Substrings(raw)
        digest = hashes(begin, begin + size)
        # equal places of several buckets are one
        order = np.lexsort((digest, key))
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])]
        place = np.empty(len(key), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        pick = order[new]
        of = np.repeat(place, n)
        least = np.full(len(pick), NULL_ID, dtype=np.int64)
        np.minimum.at(least, of, doc)
        size, key = size[pick], key[pick]
        runs = size - LENGTH + 1
        low = np.repeat(least, runs)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[which] > 1)
        if len(some):
            # only windows that come again are sorted, in the parts of places that hold them
            owner, inside, n_windows = found_again(hashes, begin[pick][some], runs[some])
            part, at = n_windows + LENGTH - 1, begin[pick][some][owner] + inside
            take = np.repeat(at - (np.cumsum(part) - part), part) + np.arange(part.sum())
            first = np.cumsum(runs) - runs
            where = first[some][owner] + inside
            where = np.repeat(where - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
            if len(part):
                low[where] = least_documents(raw[take], part, least[some][owner])
        # documents after a place's first lose all of it; the first, runs of windows that others have earlier
        later = doc > least[of]
        b, r, s, e = [bucket[later]], [row[later]], [start[later]], [start[later] + size[of[later]]]
        own = np.repeat(least, runs)
        lost = low < own
        if lost.any():
            owner = np.repeat(np.arange(len(pick)), runs)
            inside = np.arange(len(lost)) - np.repeat(np.cumsum(runs) - runs, runs)
            edge = np.flatnonzero(lost & ~(np.r_[False, lost[:-1]] & (inside > 0)))
            stop = np.flatnonzero(lost & ~(np.r_[lost[1:], False] & (np.r_[inside[1:], 0] > 0)))
            pieces, lo, hi = owner[edge], inside[edge], inside[stop] + LENGTH
            per = np.bincount(pieces, minlength=len(pick))
            at = np.cumsum(per) - per
            firsts = np.flatnonzero(~later & (per[of] > 0))
            k = per[of[firsts]]
            index = np.repeat(at[of[firsts]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            f = np.repeat(firsts, k)
            b, r, s, e = [*b, bucket[f]], [*r, row[f]], [*s, start[f] + lo[index]], [*e, start[f] + hi[index]]
        b, r, s, e = (np.concatenate(x) for x in (b, r, s, e))
        order = np.lexsort((s, r, b))
        b, r, s, e = b[order], r[order].astype(np.uint32), s[order].astype(np.uint32), e[order].astype(np.uint32)
        at = _cuts(b)
        return pa.table({"bucket": pa.array(b[at], pa.int32()), "data": pa.array([_pack(r[x:y], s[x:y], e[x:y]) for x, y in zip(at, np.r_[at[1:], len(b)], strict=True)], pa.binary())})

    return run


def _removed():
    """Step 4 in a bucket: the result's rows, and the kept bytes."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs = _in_order(docs)
        parts = [_unpack(x, "<u4", "<u4", "<u4") for x in spans.column("data").to_pylist()]
        row, start, end = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.argsort(row, kind="stable")
        row, start, end = row[order], start[order], end[order]
        out: list[tuple] = []
        for first, raw, offsets in _slices(docs.column("text")):
            a, b = np.searchsorted(row, [first, first + len(offsets) - 1])
            base = offsets[row[a:b] - first]
            edge = np.bincount(base + start[a:b], minlength=len(raw) + 1) - np.bincount(base + end[a:b], minlength=len(raw) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            begins = gone & ~np.r_[False, gone[:-1]]
            begins[offsets[:-1][offsets[:-1] < len(raw)]] = gone[offsets[:-1][offsets[:-1] < len(raw)]]
            runs = np.r_[0, np.cumsum(begins)]
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                lost = int(total[y] - total[x])
                kept = raw[x:y] if not lost else raw[x:y][~gone[x:y]]
                out.append((y - x, lost, int(runs[y] - runs[x]), hashlib.sha256(kept).hexdigest()))
        n, lost, n_spans, sha = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Rows with one doc_id take nothing from each other; null ids come after all others; null texts are empty; texts under
    LENGTH bytes lose nothing. Extra columns are dropped; an empty table gives no row.
    """
    spark = docs.sparkSession
    n_bytes = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(partitions(spark), -(-n_bytes // BUCKET_BYTES)) | 1
    shards = max(partitions(spark), -(-n_bytes // SHARD_BYTES))
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), id_.alias("id"), F.col(text).alias("text"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int")).repartition(_tasks(buckets), "bucket")
    codes = rows.select("id", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "text").mapInArrow(_codes(shards), "shard int, data binary")
    shared = codes.repartition(_tasks(shards), "shard").groupBy("shard").applyInArrow(_shared(), "bucket int, shard int, data binary")
    places = dealt.groupBy("bucket").cogroup(shared.repartition(_tasks(buckets), "bucket").groupBy("bucket")).applyInArrow(_places(shards), "shard int, bucket int, data binary")
    spans = places.repartition(_tasks(shards), "shard").groupBy("shard").applyInArrow(_spans(), "bucket int, data binary")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.groupBy("bucket").cogroup(spans.repartition(_tasks(buckets), "bucket").groupBy("bucket")).applyInArrow(_removed(), result)


def _tasks(groups: int) -> int:
    """Partitions for so many groups: they grow with the input, so that a task has one or two of them."""
    return max(1, min(groups, 200_000))
