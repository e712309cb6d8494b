"""Token-ID output: per shard one file holding a wavelet matrix of its ids.

Documents are tokenized in doc_id order. Every SHARD_TOKENS ids, about, become a file in the shared folder: a JSON header, then sections packed
with zstandard: doc ids, document starts, and one bit-plane for each bit of an id, highest first, each stably sorted by the
bits above. A directory of ones before every 512 bits gives rank; searching it gives select; so single tokens, counts of
an id before a position and its k-th occurrence come from the planes without unpacking ids.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserax.llm.common import file_system, materialise, shared_dir

MAGIC = b"WMTOK1\n"
END_ID = 2
#: Ids of a shard, about: a document is never split.
SHARD_TOKENS = 1_000_000
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 24_000_000
#: Shard files a task reads, about.
READ_SHARDS = 4
WORD_BITS = 512
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once, about.
SLAB = 2_000_000


class WaveletMatrix:
    """Bit-planes of ids below 2 ** planes; rank and select on each."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self.ones, self.zeros = [], []
        for p in planes:
            words = np.zeros(-(-n // WORD_BITS) * WORD_BITS // 8, dtype=np.uint8)
            words[: len(p)] = p
            per = np.bitwise_count(words.view(np.uint64)).reshape(-1, WORD_BITS // 64).sum(axis=1, dtype=np.int64) if n else np.zeros(0, np.int64)
            self.ones.append(np.r_[0, np.cumsum(per)])
            self.zeros.append(n - int(self.ones[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes = []
        for k in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << k)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            ids = np.concatenate([ids[~one], ids[one]])
        return cls(len(ids), planes)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7) & 1)

    def _rank1(self, k: int, i: int) -> int:
        block = i // WORD_BITS
        part = np.unpackbits(self.planes[k][block * WORD_BITS // 8 : -(-i // 8)], bitorder="little")
        return int(self.ones[k][block]) + int(part[: i - block * WORD_BITS].sum())

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) `bit` of plane k."""
        counts = self.ones[k] if bit else np.minimum(np.arange(len(self.ones[k])) * WORD_BITS, self.n) - self.ones[k]
        block = int(np.searchsorted(counts, j, side="right")) - 1
        part = np.unpackbits(self.planes[k][block * WORD_BITS // 8 : (block + 1) * WORD_BITS // 8], bitorder="little")[: self.n - block * WORD_BITS]
        return block * WORD_BITS + int(np.flatnonzero(part == bit)[j - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(len(self.planes)):
            bit, one = self._bit(k, i), self._rank1(k, i)
            value = value * 2 + bit
            i = self.zeros[k] + one if bit else i - one
        return value

    def rank(self, symbol: int, i: int) -> int:
        """How often the id stands before position i."""
        a, b = self._range(symbol, i)
        return b - a

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        if symbol >> len(self.planes):
            return 0, 0
        a, b = 0, i
        for k in range(len(self.planes)):
            a1, b1 = self._rank1(k, a), self._rank1(k, b)
            a, b = (self.zeros[k] + a1, self.zeros[k] + b1) if symbol >> (len(self.planes) - 1 - k) & 1 else (a - a1, b - b1)
        return a, b

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, j: int) -> int:
        """Position of the id's j-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(symbol, self.n)
        if not 0 <= j < b - a:
            return -1
        i = a + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order: the planes' sorts undone from the lowest up."""
        values = np.zeros(self.n, dtype=np.uint32 if len(self.planes) > 16 else np.uint16)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            out = np.empty_like(values)
            out[~one] = values[: self.zeros[k]]
            out[one] = values[self.zeros[k] :] | values.dtype.type(1 << (len(self.planes) - 1 - k))
            values = out
        return values


def image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard's file: magic, header length, header, sections."""
    matrix, pack = WaveletMatrix.build(ids, bits), zstandard.ZstdCompressor(level=1).compress
    starts = np.cumsum(lengths) - lengths
    sections = [pack(x.tobytes()) for x in (doc_ids.astype("<i8"), starts.astype("<i8"), *matrix.planes)]
    header = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "bits": bits, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections])


def read_image(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """doc ids, starts and the wavelet matrix of a shard's file."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    at = len(MAGIC) + 4
    size = int.from_bytes(data[len(MAGIC) : at], "little")
    header, at, parts = json.loads(data[at : at + size]), at + size, []
    for n in header["sections"]:
        parts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + n]), dtype=np.uint8))
        at += n
    return parts[0].view("<i8"), parts[1].view("<i8"), WaveletMatrix(header["tokens"], parts[2:])


class Encoder:
    """The library's ids of whole texts, looked up by piece.

    A byte-level pre-tokenizer cuts before a space that a word follows, around a line's end and before a mark that ends a
    word. So a text is cut there; pieces are made distinct by Arrow, their ids gathered from a pool by numpy, and only pieces
    not met before go to the library, many in one call: the bytes of each token tell where one piece's ids end. Texts with
    longer runs of white space or other white space beside it, with added tokens, and all texts of tokenizers of another
    kind, go to the library whole.
    """

    #: Begins a piece that has no space before it.
    GLUE = "\x01"
    # Unicode white space besides the space and the line's end, letters and marks of which the latter are cut off.
    OTHER_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    MARKED = r"([A-Za-z0-9À-ɏ])([.,;:!?])( |\n|$)"

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this worker one core
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        vocabulary = self.tokenizer.get_vocab()
        self.bits = max(1, max(*vocabulary.values(), END_ID).bit_length())
        self.dtype = np.dtype("<u4" if self.bits > 16 else "<u2")
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        pre, added = how.get("pre_tokenizer") or {}, how.get("added_tokens") or []
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        self.cuts = how.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and how["model"].get("type") == "BPE" and plain
        odd = [self.GLUE, "[ \\n]{3}", "[ \\n]{2}$", f"(?:^|[ \\n]){self.OTHER_SPACE}", f"{self.OTHER_SPACE}(?:$|[ \\n])"]
        self.odd = "|".join([*odd, *(re.escape(t["content"]) for t in added)])
        # a byte-level token has a letter for each byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.forget()

    def forget(self) -> None:
        """Slots 0 to 3: nothing, the end id, a space and a line's end alone."""
        self.known = {self.GLUE: 0, "": 2, "\n": 3}
        own = [[], [END_ID], *(self.whole(x).tolist() for x in (" ", "\n"))]
        self.pool, self.count = np.array(sum(own, []), self.dtype), np.array([len(x) for x in own], dtype=np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self, texts: list[str], lead: int) -> None:
        """New slots, in order, for texts that each begin with white space, without each one's first `lead` ids."""
        found, counts = [self.pool], [self.count]
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            ids, ends = self.whole("".join(some)), np.cumsum([len(t.encode()) for t in some])
            reached = np.cumsum(self.sizes[ids])
            if len(ids) and reached[-1] == ends[-1]:
                count = np.diff(np.r_[0, np.searchsorted(reached, ends) + 1])
            else:  # bytes that the vocabulary lacks
                each = [self.whole(t) for t in some]
                ids, count = np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
            if lead:
                begin = np.cumsum(count) - count
                ids, count = np.delete(ids, (begin[:, None] + np.arange(lead)).ravel()), count - lead
            found.append(ids)
            counts.append(count)
        self.pool, self.count = np.concatenate(found), np.concatenate(counts)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        """Slots of distinct pieces, new ones learned."""
        if len(self.known) > self.remembered:
            self.forget()
        slots = list(map(self.known.get, pieces))
        new = [p for p, s in zip(pieces, slots, strict=True) if s is None]
        if new:
            spaced, glued = ([p for p in new if (p[0] == self.GLUE) == want] for want in (False, True))
            self.known.update(zip(spaced + glued, range(len(self.count), len(self.count) + len(new)), strict=True))
            self._learn([" " + p for p in spaced], 0)
            self._learn(["\n" + p[1:] for p in glued], int(self.count[3]))
            slots = list(map(self.known.get, pieces))
        return np.array(slots, dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; how many each text has); null is the empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd) if self.cuts else pa.array([True] * len(texts), pa.bool_())
        large = lambda x: pa.scalar(x, pa.large_string())
        plain = pc.if_else(odd, large(""), texts)
        plain = pc.replace_substring_regex(plain, self.MARKED, rf"\1 {self.GLUE}\2\3")
        plain = pc.replace_substring(pc.binary_join_element_wise(large(self.GLUE), plain, large("")), "\n", f" \n {self.GLUE}")
        lists = pc.split_pattern(plain, " ")
        offsets, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        pieces = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        pool, count, bad = self.pool, self.count, np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(bad):
            whole = [self.whole(t) for t in texts.take(pa.array(bad)).to_pylist()]
            pieces[offsets[bad]] = len(count) + np.arange(len(bad))
            pool, count = np.concatenate([pool, *whole]), np.r_[count, np.array([len(x) for x in whole], dtype=np.int64)]
        start, pieces, out = np.cumsum(count) - count, np.insert(pieces, offsets[1:], 1), [pool[:0]]
        for at in range(0, len(pieces), 1 << 19):
            some = pieces[at : at + (1 << 19)]
            c = count[some]
            out.append(pool[np.repeat(start[some] - (np.cumsum(c) - c), c) + np.arange(c.sum())])
        return np.concatenate(out), np.add.reduceat(count[pieces], offsets[:-1] + np.arange(len(texts))) if len(texts) else offsets[:-1]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows with about SLAB bytes of text together; a longer text alone."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // SLAB)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield b.slice(at, end - at)


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, seq, first_doc, docs, tokens, file): shard files in the shared folder, in ascending doc_id order.

    Rows with equal ids keep together by text; null ids come first and are stored as the least long. Null and empty texts
    are an end id. Extra columns are dropped; an empty table gives no shard. A file's name holds the attempt that wrote it,
    so a task that runs again leaves the first one's file unread.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(-(-size // RANGE_BYTES) * 2, 100_000))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    folder = f"{shared_dir(docs.sparkSession)}/tesserax/{uuid.uuid4().hex}/tokens"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get()
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        part, seq = task.partitionId(), 0
        held: list[tuple] = []  # (doc ids, lengths, ids)

        def out(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{task.taskAttemptId()}.wm"
            with fs.open_output_stream(f"{path}/{name}") as f:
                f.write(image(doc_ids, lengths, ids, encode.bits))
            row = [[part], [seq], [int(doc_ids[0])], [len(doc_ids)], [len(ids)], [name]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, types, strict=True)], names=["part", "seq", "first_doc", "docs", "tokens", "file"])

        for b in _slabs(batches):
            ids, lengths = encode(b.column(1))
            held.append((b.column(0).to_numpy(), lengths, ids))
            if sum(len(x[2]) for x in held) < shard_tokens:
                continue
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.cumsum(lengths)
            at = 0
            while ends[-1] - (ends[at - 1] if at else 0) >= shard_tokens:
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + shard_tokens)) + 1
                yield out(doc_ids[at:to], lengths[at:to], ids[before : int(ends[to - 1])])
                seq, at = seq + 1, to
                if at == len(ends):
                    break
            held = [(doc_ids[at:], lengths[at:], ids[int(ends[at - 1]) if at else 0 :])] if at < len(ends) else []
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        pa.default_memory_pool().release_unused()  # the worker lives on

    shards = rows.select("doc_id", "text").mapInArrow(run, "part int, seq int, first_doc long, docs long, tokens long, file string")
    return materialise(shards, "shards").withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def read_back(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq) of every document in the shard files.

    start counts the ids of all documents before it: shards before in its part, parts before, documents before in its shard.
    """
    sizes = shards.select("part", "seq", "tokens")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    offsets = shards.withColumn("own", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(parts, "part")
    offsets = offsets.select("part", "seq", "file", (F.col("base") + F.col("own")).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = file_system(r["file"])
                with fs.open_input_stream(path) as f:
                    doc_ids, starts, matrix = read_image(f.read())
                ids = matrix.ids().astype("<u4")
                ends = np.r_[starts[1:], matrix.n]
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                same = lambda x: pa.array(np.full(len(starts), x, dtype=np.int32))
                columns = [pa.array(doc_ids), pa.array(starts + r["base"]), pa.array(ends - starts), pa.array(crc, pa.int64()), same(r["part"]), same(r["seq"])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq"])
        pa.default_memory_pool().release_unused()

    n = max(1, min(shards.count(), 100_000) // READ_SHARDS)
    found = offsets.repartition(n, "part", "seq").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs' ids as shard files and return what the files say of each document."""
    return read_back(write_shards(docs, tokenizer))
