"""Token ids in shards that are wavelet matrices."""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic.llm.bpe import Remembered, byte_letters, packed
from limnetic.llm.common import arrow_batches, whole

MAGIC = b"WVM2"
# Bits of one block: it is compressed alone, and one sample counts the ones before it.
BLOCK = 1 << 15
# Blocks that an open shard keeps inflated.
INFLATED = 256
# A shard is closed once it holds so many ids; a document is never split.
SHARD_IDS = 1 << 21
# Pieces between white space, and words, that one worker remembers.
PIECES, WORDS = 700_000, 600_000
# Bytes of text whose distinct pieces are looked up together.
LOOKUP_BYTES = 16 << 20
# ASCII marks that never join the letters before them, and the letters.
MARKS = b"!#$%&*+,-./:;=?@^_`|~\"()[]{}"
LETTERS = string.ascii_letters


class WaveletMatrix:
    """A sequence of ids as bit planes from the highest bit down.

    Each plane lists one bit of every id, in the order in which the planes above have put
    them: zeros before ones, else as they were. ``samples[level, block]`` counts the ones
    before a block; ``block(level, i)`` gives its bytes, from memory or from a file.
    """

    def __init__(self, n: int, zeros: np.ndarray, samples: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.samples, self.block = n, zeros, samples, block
        self.levels, self.blocks = samples.shape

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n, levels = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        blocks, width = n // BLOCK + 1, BLOCK // 8
        planes, zeros, samples = np.zeros((levels, blocks * width), np.uint8), np.zeros(levels, np.int64), np.zeros((levels, blocks), np.uint32)
        order = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels):
            bits = (order >> order.dtype.type(levels - 1 - level)) & order.dtype.type(1) != 0
            packed_bits = np.packbits(bits)
            planes[level, : len(packed_bits)] = packed_bits
            ones = np.bitwise_count(planes[level].reshape(blocks, width).view(np.uint64)).sum(1, dtype=np.int64)
            samples[level, 1:] = np.cumsum(ones)[:-1]
            zeros[level] = n - int(ones.sum())
            order = np.concatenate([np.compress(~bits, order), np.compress(bits, order)])
        return cls(n, zeros, samples, lambda level, i: planes[level, i * width : (i + 1) * width])

    def bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, inside = divmod(i, BLOCK)
        ones = int(self.samples[level, block])
        if inside:
            bits = self.block(level, block)
            ones += int(np.bitwise_count(bits[: inside >> 3]).sum(dtype=np.int64))
            if inside & 7:
                ones += (int(bits[inside >> 3]) >> (8 - (inside & 7))).bit_count()
        return ones

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit of the kind ``bit`` in a plane, by halving the samples."""

        def before(block: int) -> int:
            ones = int(self.samples[level, block])
            return ones if bit else block * BLOCK - ones

        low, high = 0, self.blocks - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if before(middle) <= k else (low, middle - 1)
        bits = np.unpackbits(self.block(level, low))
        return low * BLOCK + int(np.flatnonzero(bits == bit)[k - before(low)])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self.bit(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + self.rank(level, i) if bit else i - self.rank(level, i)
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among positions a to b end up below the last plane."""
        if value < 0 or value >> self.levels:
            return 0, 0
        for level in range(self.levels):
            if a == b:
                return a, b
            ra, rb = self.rank(level, a), self.rank(level, b)
            one = value >> (self.levels - 1 - level) & 1
            a, b = (int(self.zeros[level]) + ra, int(self.zeros[level]) + rb) if one else (a - ra, b - rb)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        a, b = self._range(value, a, self.n if b is None else b)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``value``."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.levels)):
            one = value >> (self.levels - 1 - level) & 1
            i = self.select(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        order = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = np.concatenate([self.block(level, i) for i in range(self.blocks)])
            bits = np.unpackbits(plane, count=self.n).view(bool)
            above = np.empty_like(order)
            zeros = int(self.zeros[level])
            above[np.flatnonzero(~bits)] = order[:zeros]
            above[np.flatnonzero(bits)] = order[zeros:] | order.dtype.type(1 << (self.levels - 1 - level))
            order = above
        return order.astype(np.uint32)


class Shard:
    """The ids of consecutive documents: their keys, where each ends, and the wavelet matrix.

    In bytes: a head, the matrix's zeros and samples, the sizes of the parts, and the parts,
    each compressed alone: first keys and ends, then the blocks of the planes. An open shard
    reads the head and then only the parts that are asked for.
    """

    def __init__(self, keys: list[int | None], ends: np.ndarray, matrix: WaveletMatrix):
        self.keys, self.ends, self.matrix = keys, ends, matrix

    def to_bytes(self) -> bytes:
        m, squeeze = self.matrix, zstandard.ZstdCompressor(level=1).compress
        there = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], "<i8")
        parts = [squeeze(there.tobytes() + keys.tobytes() + self.ends.astype("<i8").tobytes())]
        parts += [squeeze(m.block(level, i).tobytes()) for level in range(m.levels) for i in range(m.blocks)]
        head = np.array([len(keys), m.n, m.levels, m.blocks], "<i8")
        sizes = np.array(list(map(len, parts)), "<u4")
        return b"".join([MAGIC, head.tobytes(), m.zeros.astype("<i8").tobytes(), m.samples.astype("<u4").tobytes(), sizes.tobytes(), *parts])

    @classmethod
    def from_bytes(cls, data) -> Shard:
        view = memoryview(data)
        return cls.open(lambda at, size: view[at : at + size])

    @classmethod
    def open(cls, read: Callable[[int, int], bytes]) -> Shard:
        """The shard whose ``size`` bytes from ``at`` on are ``read(at, size)``."""
        if bytes(read(0, 4)) != MAGIC:
            raise ValueError("not a wavelet shard")
        docs, n, levels, blocks = map(int, np.frombuffer(read(4, 32), "<i8"))
        at = 36
        zeros = np.frombuffer(read(at, 8 * levels), "<i8")
        at += 8 * levels
        samples = np.frombuffer(read(at, 4 * levels * blocks), "<u4").reshape(levels, blocks)
        at += 4 * levels * blocks
        count = 1 + levels * blocks
        ends = at + 4 * count + np.cumsum(np.r_[0, np.frombuffer(read(at, 4 * count), "<u4").astype(np.int64)])

        def part(i: int) -> bytes:
            return zstandard.ZstdDecompressor().decompress(read(int(ends[i]), int(ends[i + 1] - ends[i])))

        @lru_cache(maxsize=INFLATED)
        def block(level: int, i: int) -> np.ndarray:
            return np.frombuffer(part(1 + level * blocks + i), np.uint8)

        return _Opened(docs, part, WaveletMatrix(n, zeros, samples, block))


class _Opened(Shard):
    """A shard that reads its documents when they are asked for."""

    def __init__(self, docs: int, part: Callable[[int], bytes], matrix: WaveletMatrix):
        self.docs, self.part, self.matrix = docs, part, matrix

    @cached_property
    def _documents(self) -> tuple[list[int | None], np.ndarray]:
        data, n = self.part(0), self.docs
        keys = np.frombuffer(data, "<i8", n, n)
        return [int(k) if t else None for k, t in zip(keys, data[:n])], np.frombuffer(data, "<i8", n, 9 * n)

    @property
    def keys(self) -> list[int | None]:
        return self._documents[0]

    @property
    def ends(self) -> np.ndarray:
        return self._documents[1]


class LibraryEncoder:
    """Ids by the tokenizers library, which is asked once for each word that is not remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge, self.normal = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str
        self.letters = dict(enumerate(byte_letters()))
        self.pieces = Remembered(self.cut, PIECES)
        self.words, self.others = Remembered(self.merged, WORDS), Remembered(self.asked, WORDS)
        self.plain = Remembered(self.letters_only, WORDS)

    def merged(self, word: bytes) -> bytes:
        """Ids of a normalised word of letters, which the library's splitter leaves whole."""
        letters = word.decode("latin-1")
        return packed([x.id for x in self.merge(letters if letters.isascii() else letters.translate(self.letters))])

    def asked(self, piece: bytes) -> bytes:
        return packed(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)

    def cut(self, piece: bytes) -> bytes:
        """Ids of a piece; letters and the ASCII marks behind them are apart by the vocabulary's pattern."""
        word = piece.rstrip(MARKS)
        if word.isalpha():  # ASCII letters
            ids = self.words[word.lower()]
        else:
            text = word.decode()
            if not text.isalpha() or not (normal := self.normal(text)).isalpha():
                return self.others[piece]
            ids = self.words[normal.encode()]
        return ids + self.others[piece[len(word) :]] if len(word) < len(piece) else ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8 as little-endian 32-bit numbers; no id reaches over ASCII white space."""
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def letters_only(self, word: str) -> bytes:
        """Ids of a word of small ASCII letters."""
        return array("I", [x.id for x in self.merge(word)]).tobytes()

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in one row, and how many each has.

        A piece of ASCII letters and marks behind them is a word and a tail, which few others
        share; they are told apart for all pieces at once. Other pieces go to ``cut`` each.
        """
        core = pc.ascii_rtrim(pieces, characters=MARKS.decode())
        plain = pc.ascii_is_alpha(core)
        word = pc.ascii_lower(core.filter(plain)).dictionary_encode()
        tail = pc.ascii_ltrim(pieces.filter(plain), characters=LETTERS).dictionary_encode()
        rest = pieces.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist()
        words = list(map(self.plain.__getitem__, word.dictionary.to_pylist()))
        tails = [self.others[t.encode()] if t else b"" for t in tail.dictionary.to_pylist()]
        others = [self.pieces[p] if p else b"" for p in rest]
        # Parts in one row: of all words, all tails and all other pieces.
        parts = words + tails + others
        ids, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        is_plain = plain.to_numpy(zero_copy_only=False)
        first, second = np.empty(len(pieces), np.int64), np.full(len(pieces), len(parts))
        first[is_plain] = word.indices.to_numpy()
        first[~is_plain] = len(words) + len(tails) + np.arange(len(rest))
        second[is_plain] = len(words) + tail.indices.to_numpy()
        order = np.stack([first, second], 1).ravel()
        sizes = np.r_[sizes, 0]
        return gathered(ids, sizes, order), sizes[first] + sizes[second]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, UTF-8) in one row, and how many each text has.

        Every distinct piece of the texts is looked up once; the ids are then gathered by number.
        """
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        ids, sizes = self.distinct(coded.dictionary)
        place = coded.indices.to_numpy()
        bounds = np.r_[0, np.cumsum(sizes[place])][words.offsets.to_numpy() - words.offsets[0].as_py()]
        return gathered(ids, sizes, place), np.diff(bounds)


def gathered(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Stretches of ``ids``, which lie one after the other with these sizes, put in another order."""
    begins, n = np.cumsum(sizes) - sizes, sizes[order]
    upto = np.cumsum(n)
    return ids[np.repeat(begins[order] - (upto - n), n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_shards(
    docs: DataFrame, folder: str, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS
) -> None:
    """Encode whole texts, in ascending order of an integer key, into wavelet shards below ``folder``.

    ``path`` is the vocabulary file on every executor; ``end_id`` ends each document. Each
    row of the Parquet files is one shard: part (in ascending order of
    the keys), part_at (ids of the part before it), n_docs, n_ids, and ``shard``, the bytes of one compressed file that ``Shard`` opens.

    Defined results: a missing or empty text has the end id only; rows without a key come
    first; rows of one key are written each, in order of a hash of their texts; an empty
    table gives no shards. A text longer than a shard has a shard of its own.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(text).cast("binary").alias("text"))
    # The hash deals out rows that share a key or have none.
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = library_encoder(path), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        waiting: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def shard(size: int) -> pa.RecordBatch:
            ids, ends = np.concatenate(waiting), np.cumsum(np.concatenate(counts))
            data = Shard(keys, ends, WaveletMatrix.of(ids)).to_bytes()
            return pa.RecordBatch.from_pydict({"part": [part], "part_at": [done], "n_docs": [len(keys)], "n_ids": [size], "shard": [data]})

        size = 0
        for batch in arrow_batches(batches, LOOKUP_BYTES):
            ids, n = encoder.encode_all(batch["text"])
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            ends, own, a = np.cumsum(n), batch["key"].to_pylist(), 0
            while a < len(n):
                # The documents that still go into the open shard: up to the one that fills it.
                begin = int(ends[a] - n[a])
                b = min(int(np.searchsorted(ends, begin + shard_ids - size)) + 1, len(n))
                keys += own[a:b]
                waiting.append(ids[begin : ends[b - 1]])
                counts.append(n[a:b])
                size += len(waiting[-1])
                if size >= shard_ids:
                    yield shard(size)
                    done += size
                    keys, waiting, counts, size = [], [], [], 0
                a = b
        if keys:
            yield shard(size)

    shards = rows.mapInArrow(run, "part long, part_at long, n_docs long, n_ids long, shard binary")
    shards.write.option("compression", "none").parquet(folder)


def read_shards(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document of a folder of shards, with ``ids`` if asked for.

    ``start`` counts the ids of all documents before it. The sums of the parts, one row
    for each task that wrote, are accumulated and broadcast.
    """
    shards = spark.read.parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part")) - F.col("part_ids")).alias("before"))
    placed = shards.join(F.broadcast(parts), "part").select((F.col("before") + F.col("part_at")).alias("shard_start"), "shard")

    fields = [(key, T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields + [("ids", T.BinaryType())] * ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch["shard_start"].to_pylist(), batch["shard"]):
                shard = Shard.from_bytes(data.as_buffer())
                values = memoryview(shard.matrix.ids().astype("<u4").tobytes())
                begins = np.r_[0, shard.ends[:-1]]
                each = [values[4 * a : 4 * b] for a, b in zip(begins.tolist(), shard.ends.tolist())]
                columns = [
                    pa.array(shard.keys, pa.int64()), pa.array(begins + at), pa.array(shard.ends - begins),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, each), pa.binary())] * ids, names=schema.names)

    return placed.mapInArrow(run, schema)


def token_counts(spark: SparkSession, folder: str, tokens: Sequence[int]) -> DataFrame:
    """part, part_at, token and n: how often each of a few tokens occurs in each shard.

    Nothing is decoded: a count reads the zeros and samples of a shard and no more than one
    block of a plane. A token that no shard has is counted as 0; no shards give no rows.
    """
    asked = sorted(set(map(int, tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in zip(batch["part"].to_pylist(), batch["part_at"].to_pylist(), batch["shard"]):
                matrix = Shard.from_bytes(data.as_buffer()).matrix
                n = [matrix.count(t) for t in asked]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(n), "part_at": [at] * len(n), "token": asked, "n": n})

    shards = spark.read.parquet(folder).select("part", "part_at", "shard")
    return shards.mapInArrow(run, "part long, part_at long, token long, n long")
