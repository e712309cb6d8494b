"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint has 64 bits; two documents link when theirs differ in at most `radius` bits. Of `blocks` bit blocks two
linked fingerprints share at least blocks - radius, so each fingerprint is sent once for each choice of that many blocks,
keyed by their bits: the index's top nodes, spread over the cluster. Below a top node fingerprints are sorted by Gray rank
of the other bits, upper nodes hold the bit patterns their members share, and pairs of nodes are followed downwards
together: differences accumulate level by level, and a pair over the radius is dropped with everything below it.

At a wider similarity fingerprints differ in more bits than blocks can hold apart. Then texts may also meet under top nodes
of another kind, bands of least hashes of the same shingles, below which fingerprints are indexed in the same way at a
wider radius. All such links must agree in enough of the least hashes, so that chance neighbours, of which a large corpus has
many, do not link; and each link that leaves a task is then confirmed by the two texts' whole sets of shingles.

Fingerprints, or texts where bands are asked for, are made distinct first, so groups of exact copies have one entry. A top node of
over HOT entries is cut into chunks, every two of which meet in a task of their own. What leaves a task is a spanning forest of its
links, not the pairs, made of the likeliest links first where they are to be confirmed, so that a wrong one seldom stands for a right
one; components then come from alternating star contraction over shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserax.llm.common import fresh, materialise, partitions
from tesserax.operators.components import components

SEED = 42
RADIUS = 3
BLOCKS = 5
#: Bands of least hashes, where they are asked for, have so many each: at a similarity of 0.8, 16 bands miss 2 pairs in 10,000.
ROWS = 4
#: Least hashes of bands are remembered by 4 bits each; linked texts must have so many equal: at a similarity of 0.8 99 in 100 have.
AGREE = 0.7
#: Links of so many equal least hashes are made before others.
SURE = 0.85
#: Where all of a tree agree in so many with its least text, its links are those to that text, which most of its bands' trees have.
STAR = 0.92
#: Hashes of linked texts, of 8 bytes each, up to which they are broadcast.
FEW_ENDS = 1_000_000
#: Entries of a top node that one task takes.
HOT = 100_000
#: Bits by which a node's children are longer.
STEP = 6
#: Pairs of nodes followed at once; more are halved and followed one half after the other.
FRONTIER = 1 << 18
#: Entries worked on at once, about.
BATCH = 200_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, A-Z lower-cased; of fewer words, of all of them together."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(b" ".join(words), SEED)], dtype=np.uint64)
    return np.array([hashed(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)], dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles; null and texts without a word: 0."""
    return simhash(shingles(text, width))


def simhash(hashes: np.ndarray) -> int:
    h, ones = hashes.astype(">u8"), np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    shift, odd = (r.integers(0, 1 << 64, (n, 1), dtype=np.uint64) for _ in range(2))
    return shift, odd | np.uint64(1)


def sketch(hashes: np.ndarray, bands: int) -> tuple[list[int], list[int]]:
    """Keys, as signed longs, of bands of ROWS least hashes each, and four bits of every least hash, 16 to a long; none without a shingle."""
    if not len(hashes):
        return [], []
    shift, odd = _functions(bands * ROWS)
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[None, at : at + (1 << 12)] ^ shift) * odd).min(axis=1))
    bits = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63) for x in least.reshape(bands, ROWS)]
    return keys, np.bitwise_or.reduce(bits, axis=1).view(np.int64).tolist()


def equal_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many groups of four bits are equal in rows of longs."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return 16 * a.shape[1] - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bands: int = 0) -> DataFrame:
    """(doc_id, h, fp[, keys, sketch]): hash of the text (null: 42's own), fingerprint as signed long, keys of bands of least hashes, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys, sketches = np.zeros(b.num_rows, dtype=np.uint64), [], []
            for k, x in enumerate(b.column(2)):  # one text at a time: a batch's shingles are many times its texts
                own = shingles(x.as_py(), width)
                fp[k] = simhash(own)
                if bands:
                    for held, part in zip((keys, sketches), sketch(own, bands), strict=True):
                        held.append(part)
            out = {"doc_id": b.column(0), "h": b.column(1), "fp": pa.array(fp.view(np.int64))}
            if bands:
                out |= {"keys": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return own.mapInArrow(run, "doc_id long, h long, fp long" + ", keys array<long>, sketch array<long>" * bool(bands))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each code word in Gray order; codes with common leading bits stay together."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class Forest:
    """Union by smallest member over 0..n-1, whole arrays of links at a time; `made` has the links that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.made: list[np.ndarray] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p, own = self.parent, np.stack([a, b])
        while len(a):
            a, b = p[own[0]], p[own[1]]
            apart = a != b
            own, a, b = own[:, apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(p, high, low)
            won = np.flatnonzero(p[high] == low)
            self.made.append(own[:, won[np.unique(high[won], return_index=True)[1]]])
            while (q := p[p]).tobytes() != p.tobytes():
                p[:] = q


def _star_or_tree(forest: Forest, ids: np.ndarray, close) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest: of a tree whose members are all close to that of the least id, to that one, otherwise as they were made."""
    least, root = np.full(len(ids), np.iinfo(np.int64).max), forest.parent
    np.minimum.at(least, root, ids)
    head = np.zeros(len(ids), dtype=np.int64)
    first = np.flatnonzero(ids == least[root])
    head[root[first]] = first
    member = np.flatnonzero(np.bincount(root, minlength=len(ids))[root] > 1)
    member = member[member != head[root[member]]]
    far = np.zeros(len(ids), dtype=bool)
    far[root[member[~close(head[root[member]], member)]]] = True
    star, made = member[~far[root[member]]], np.concatenate(forest.made, axis=1)
    made = made[:, far[root[made[0]]]]
    return np.concatenate([head[root[star]], made[0]]), np.concatenate([star, made[1]])


def _follow(levels: list, k: int, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest, agree) -> None:
    """Pairs (a, b), a <= b, of nodes on level k: prune, then their children's pairs; on the last level, link.

    Pairs whose members are all in one tree of the forest already need not be followed.
    """
    while True:
        code, first, starts = levels[k]
        low, high = np.minimum.reduceat(forest.parent, starts), np.maximum.reduceat(forest.parent, starts)
        near = np.bitwise_count(code[a] ^ code[b]) <= radius
        near &= (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        a, b = a[near], b[near]
        if k == len(levels) - 1:
            near = agree(a, b)
            forest.link(a[near], b[near])
            return
        if len(a) > FRONTIER:
            half = len(a) // 2
            _follow(levels, k, a[:half], b[:half], radius, forest, agree)
            a, b = a[half:], b[half:]
            continue
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        if len(a) > 1 and (na * nb).sum() > 8 * FRONTIER:
            half = len(a) // 2
            _follow(levels, k, a[:half], b[:half], radius, forest, agree)
            a, b = a[half:], b[half:]
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        a, b = first[a][pair] + at // nb[pair], first[b][pair] + at % nb[pair]
        once = a <= b if k + 1 < len(levels) - 1 else a < b
        a, b, k = a[once], b[once], k + 1


def linked(key: np.ndarray, rest: np.ndarray, bits: int, radius: int, *agrees) -> tuple[np.ndarray, Forest]:
    """Order of the entries and, in that order, the forest of their links through others of their key.

    key: the top node of each; rest: its other bits, `bits` of them; agrees: of arrays of entries a and b, whether they may link, the
    strictest first.
    """
    rank = gray_rank(rest)
    order = np.lexsort((rank, key))
    key, rank, rest = key[order], rank[order], rest[order]
    n, levels = len(key), []
    depths = [0, *range(bits % STEP or STEP, bits + 1, STEP)]
    new_key = np.r_[True, key[1:] != key[:-1]]
    for d in depths:
        r = rank >> np.uint64(bits - d) if d else np.zeros_like(rank)
        starts_here = np.flatnonzero(new_key | np.r_[True, r[1:] != r[:-1]])
        levels.append([starts_here, rest >> np.uint64(bits - d) if d else np.zeros_like(rest)])
    levels.append([np.arange(n), rest])
    tree = []
    for k, (starts, code) in enumerate(levels):
        below = levels[k + 1][0] if k + 1 < len(levels) else None
        first = np.r_[np.searchsorted(below, starts), len(below)] if below is not None else None
        tree.append((code[starts], first, starts))
    forest = Forest(n)
    tops = np.arange(len(levels[0][0]))
    tops = tops[np.diff(np.r_[levels[0][0], n]) > 1]
    for agree in agrees:
        agree_ = lambda a, b, agree=agree: agree(order[a], order[b])
        # neighbours in Gray order first: large groups of near copies are mostly one tree before pairs are followed
        for gap in (1, 2, 3, 4, 8, 16):
            a = np.arange(max(0, n - gap))
            b = a + gap
            near = (key[a] == key[b]) & (np.bitwise_count(rest[a] ^ rest[b]) <= radius)
            near[near] = agree_(a[near], b[near])
            forest.link(a[near], b[near])
        _follow(tree, 0, tops, tops, radius, forest, agree_)
    return order, forest


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, band_radius: int = 64, hot: int = HOT) -> DataFrame:
    """(a, b): a spanning forest, by top nodes, of the links among distinct fingerprints, classes(fp), or texts, classes(fp, id, keys, sketch).

    With keys of bands, texts that share one link as well if fp differs in at most band_radius bits, and all links need sketches that
    are equal in AGREE of their least hashes; then a and b are the ids of two such texts. Without, they are fp, and in one tree only.
    """
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    choices = list(combinations(range(blocks), blocks - radius))
    mask = lambda i: ((1 << int(edges[i + 1] - edges[i])) - 1) << int(edges[i])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(mask(i) for i in c)) for c in choices]
    widths = [64 - int(sum(edges[i + 1] - edges[i] for i in c)) for c in choices]
    banded = "keys" in classes.columns
    own = ["fp", "sketch", "id"] if banded else ["fp"]
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))
    rows = classes.select(*own, F.posexplode(F.concat(keys, F.col("keys")) if banded else keys).alias("choice", "key"))
    # chunks of a hot top node meet two by two
    many = materialise(rows.groupBy("choice", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot), "hot")
    rows = rows.withColumn("pair", F.lit(0))
    if not many.isEmpty():
        n_chunks = F.ceil(F.col("n") / hot).cast("int")
        chunk = F.pmod(F.xxhash64(*own), n_chunks).cast("int")
        met = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda c: F.least(c, chunk) * n_chunks + F.greatest(c, chunk))
        split = rows.drop("pair").join(many, ["choice", "key"], "left").select(*own, "choice", "key", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(met)).alias("pair"))
        rows = split

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        fp, choice, key, pair = (t.column(c).to_numpy() for c in ("fp", "choice", "key", "pair"))
        ids_ = t.column("id" if banded else "fp").to_numpy()
        if banded:
            held = t.column("sketch").combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            size = np.diff(held.offsets.to_numpy())
            sketches = np.zeros((len(fp), int(size.max(initial=0))), dtype=np.uint64)
            sketches[size > 0] = held.flatten().to_numpy().view(np.uint64).reshape(int((size > 0).sum()), sketches.shape[1])
            enough = [e * 16 * sketches.shape[1] for e in (SURE, AGREE)]
        # one number for a node, whatever its pair of chunks
        node = np.cumsum(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        for c in np.unique(choice):
            x = np.flatnonzero(choice == c)
            if len(x) < 2:
                continue
            if banded:
                agrees = [lambda a, b, x=x, e=e: equal_hashes(sketches[x[a]], sketches[x[b]]) >= e for e in enough]
            else:
                agrees = [lambda a, b: np.ones(len(a), dtype=bool)]
            bits, rest = fp[x].view(np.uint64), np.zeros(len(x), dtype=np.uint64)
            if c >= len(choices):
                order, forest = linked(node[x], bits, 64, band_radius, *agrees)
            else:
                at = 0
                for i in set(range(blocks)) - set(choices[c]):
                    rest |= ((bits >> np.uint64(edges[i])) & np.uint64((1 << int(edges[i + 1] - edges[i])) - 1)) << np.uint64(at)
                    at += int(edges[i + 1] - edges[i])
                order, forest = linked(node[x], rest, widths[c], radius, *agrees)
            ids = ids_[x][order]
            below = np.flatnonzero(forest.parent != np.arange(len(x)))
            a, b = forest.parent[below], below
            if banded and len(below):
                a, b = _star_or_tree(forest, ids, lambda p, q, x=x[order]: equal_hashes(sketches[x[p]], sketches[x[q]]) >= STAR * 16 * sketches.shape[1])
            if len(below):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            if sum(x.num_rows for x in kept) < BATCH:
                continue
            # all but the last node, if it began in this batch
            last = [b.column(b.schema.names.index(c)).to_numpy() for c in ("choice", "key", "pair")]
            other = np.flatnonzero(np.any([x != x[-1] for x in last], axis=0))
            if len(other):
                cut = int(other[-1]) + 1
                yield from out(pa.Table.from_batches([*kept[:-1], b.slice(0, cut)]))
                kept = [b.slice(cut)]
        if kept:
            yield from out(pa.Table.from_batches(kept))

    by = ("choice", "key", "pair")
    dealt = rows.repartition(partitions(classes.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def confirmed(found: DataFrame, docs: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Of links (a, b) between hashes of texts, those whose sets of shingles have a Jaccard similarity of so much; two texts without a
    word are alike. Texts go to their links by joins, so a text with many links is on as many tasks as its links are. Up to FEW_ENDS
    hashes of linked texts are broadcast, so that the other texts are not shuffled; the result is the same with more."""
    texts = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    ends = materialise(found.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "ends")
    few = ends.count() <= FEW_ENDS
    own = materialise(texts.join(F.broadcast(ends) if few else ends, "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")), "linked")
    side = lambda x: own.select(F.col("h").alias(x), F.col("t").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, last, x = np.zeros(b.num_rows, dtype=bool), None, None
            for k, (a, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True)):
                if a != last:
                    last, x = a, np.unique(shingles(ta.as_py(), width))
                y = np.unique(shingles(tb.as_py(), width))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield b.select([0, 1]).filter(pa.array(keep))

    return found.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS, blocks: int = BLOCKS, bands: int = 0, band_radius: int = 64, similarity: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, h, fp) of every row, h a hash of its text; (node, root) of every node with a link: the least one that links reach.

    Nodes are fingerprints. With bands they are texts, h; those that share one of so many bands of least hashes link within band_radius
    bits too, and links are confirmed at this similarity of the texts' sets of shingles.
    """
    fps = materialise(fingerprints(docs, doc_id, text, width, bands), "fingerprints")
    if not bands:
        return fps.withColumn("node", F.col("fp")), components(links(materialise(fps.select("fp").distinct(), "classes"), radius, blocks))
    classes = materialise(fps.groupBy(F.col("h").alias("id")).agg(*(F.first(c).alias(c) for c in ("fp", "sketch", "keys"))), "classes")
    found = materialise(links(classes, radius, blocks, band_radius), "links")
    return fps.withColumn("node", F.col("h")), components(materialise(confirmed(found, docs, text, width, similarity), "confirmed"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of at most `radius` bits.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows and ties share a component; extra
    columns are dropped; an empty table gives no row; where only rows with a null id are reachable, component_id is null.
    """
    fps, roots = groups(docs, doc_id, text, **how)
    least = materialise(_with_root(fps.groupBy("node").agg(F.min("doc_id").alias("m")), roots), "roots")
    of = least.join(least.groupBy("root").agg(F.min("m").alias("component_id")), "root").select("node", "component_id")
    return fps.join(of, "node").select("doc_id", "fp", "component_id")


def _with_root(by_node: DataFrame, roots: DataFrame) -> DataFrame:
    return by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs without near copies: of each group the one with the smallest doc_id, a null id last, then the least
    hash of the text, then the least of the other columns (which must have an order). All columns are kept as they are.
    """
    fps, roots = groups(docs, doc_id, text, **how)
    key = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")
    first = fps.groupBy("node").agg(F.min(key).alias("k"))
    first = _with_root(first, roots).groupBy("root").agg(F.min("k").alias("k"))
    first = first.select(F.col("k.doc_id").alias("first_id"), F.col("k.h").alias("first_h"))
    id_, h = fresh(docs, "id", "h")
    own = docs.withColumns({id_: F.col(doc_id).cast("long"), h: F.xxhash64(text)})
    kept = own.join(first, own[id_].eqNullSafe(first.first_id) & (own[h] == first.first_h), "left_semi")
    rows = kept.groupBy(id_, h).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return rows.select("row.*")
