"""Packing of token ids into windows of one capacity by minimum bin slack."""

from __future__ import annotations

import base64
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from limnetic.llm.common import arrow_batches, whole

CAPACITY = 2048
# Windows' worth of remainders that wait in one task before half of them are packed.
POOL_WINDOWS = 512
# Bytes of ids of one batch of pieces.
BATCH_BYTES = 8 << 20

# The splitting pattern of the byte vocabulary, and its one special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
# Characters whose class has been the same in all versions of Unicode that the two libraries know.
STABLE = re.compile(
    "[\x00-Ƞɐ-ʭΈ-ΊΎ-ΡΣ-ώЀ-ҁҐ-ӄ‐-‧‰-⁆"
    "€ぁ-ゔァ-ヺ一-龥가-힣]*"
)
# A run longer than this goes to the library that merges in less than quadratic time.
LONG_RUN = 512
BLANKS = re.compile(r"\s{%d}" % LONG_RUN)
# No token reaches over a blank between two letters, digits or low lines.
CHUNK = 1 << 18
BETWEEN = re.compile(r"(?<=\w) (?=\w)")


class ByteEncoder:
    """Ids of the byte vocabulary, as the tokenizers library gives them.

    ``ranks`` names the same vocabulary as ranks. Texts of characters of stable classes are
    merged by it, which is several times as fast; all others, texts that spell the special
    token, and texts with very long words or blanks go to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    def chunk(self, text: str) -> np.ndarray:
        plain = self.fast and SPECIAL not in text and STABLE.fullmatch(text) and not BLANKS.search(text)
        if plain and max(map(len, text.split()), default=0) <= LONG_RUN:
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; a long one is cut where no token can reach over."""
        if len(text) <= CHUNK:
            return self.chunk(text)
        found, at = [], 0
        while at < len(text):
            cut = BETWEEN.search(text, at + CHUNK)
            stop = cut.start() if cut else len(text)
            found.append(self.chunk(text[at:stop]))
            at = stop
        return np.concatenate(found)


@lru_cache(maxsize=2)
def byte_encoder(path: str, ranks: str | None) -> ByteEncoder:
    return ByteEncoder(path, ranks)


def closest_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The lengths, with how often each is taken, whose sum is the largest within ``target``.

    Bit i of ``reach`` tells whether some of the lengths seen so far sum to i; a length that
    is there c times is entered as 1, 2, 4, ... copies. The sums before each entry are kept,
    and walking back through them gives the counts.
    """
    reach, mask, steps = 1, (1 << target + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], target // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> target:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> best & 1:
            best -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


class Piece:
    """Ids ``start`` to ``start + len(ids)`` of a document."""

    __slots__ = ("key", "start", "ids", "total")

    def __init__(self, key, start: int, ids: np.ndarray, total: int):
        self.key, self.start, self.ids, self.total = key, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.ids[:n], self.total), Piece(self.key, self.start + n, self.ids[n:], self.total)


class SlackPacker:
    """Turns documents into sequences of at most ``capacity`` ids.

    A document fills whole windows of its own as far as it goes. Its remainder waits in a
    pool, as a multiset of lengths. A window takes the longest remainder and the multiset of
    others that comes closest to the capacity; one pattern serves as many windows as the
    counts allow. If no multiset fills the window, the slack is cut from the longest
    remainder left. Ids that do not fill a window at the end go to sequences of powers of
    two, so nothing is padded.
    """

    def __init__(self, capacity: int):
        self.capacity, self.waiting, self.counts, self.size = capacity, {}, {}, 0

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.waiting.setdefault(n, deque()).append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.size += n

    def take(self, length: int) -> Piece:
        self.counts[length] -= 1
        self.size -= length
        piece = self.waiting[length].popleft()
        if not self.counts[length]:
            del self.counts[length], self.waiting[length]
        return piece

    def add(self, key, ids: np.ndarray) -> Iterator[list[Piece]]:
        piece = Piece(key, 0, ids, len(ids))
        while len(piece.ids) >= self.capacity:
            full, piece = piece.cut(self.capacity)
            yield [full]
        if len(piece.ids):
            self.put(piece)
        if self.size > POOL_WINDOWS * self.capacity:
            yield from self.windows(POOL_WINDOWS * self.capacity // 2)

    def windows(self, rest: int) -> Iterator[list[Piece]]:
        """Full windows until at most ``rest`` ids wait, or less than a window."""
        while self.size >= max(rest, self.capacity):
            longest = max(self.counts)
            others = dict(self.counts)
            others[longest] -= 1
            chosen = closest_fill({n: c for n, c in others.items() if c}, self.capacity - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(n * c for n, c in chosen.items())
            times = 1 if slack else min(self.counts[n] // c for n, c in chosen.items())
            for _ in range(times):
                pieces = [self.take(n) for n, c in sorted(chosen.items(), reverse=True) for _ in range(c)]
                if slack:
                    head, tail = self.take(max(self.counts)).cut(slack)
                    pieces.append(head)
                    self.put(tail)
                yield pieces

    def finish(self) -> Iterator[list[Piece]]:
        yield from self.windows(0)
        last = [p for n in sorted(self.waiting, reverse=True) for p in self.waiting[n]]
        room, pieces = 1 << max(self.size.bit_length() - 1, 0), []
        while last:
            piece = last.pop(0)
            if len(piece.ids) > room:
                piece, tail = piece.cut(room)
                last.insert(0, tail)
            pieces.append(piece)
            self.size -= len(piece.ids)
            room -= len(piece.ids)
            if not room:
                yield pieces
                room, pieces = 1 << max(self.size.bit_length() - 1, 0), []
        self.waiting, self.counts = {}, {}


def pack_windows(
    docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of whole documents, placed in sequences of at most ``capacity`` ids.

    key, start (ids of the document before the piece), length, ids (little-endian unsigned
    32-bit numbers), doc_tokens (with the end id), sequence_id, offset (in the sequence,
    gapless from 0). ``path`` is the vocabulary file on every executor, ``ranks`` the same
    vocabulary as ranks where there is one.

    Every task packs the rows of its partition, without a shuffle, and holds the remainders
    of at most ``POOL_WINDOWS`` windows besides the document at hand. Sequences are numbered
    by partition and place in it. Sequences have ``capacity`` ids, but for a few powers of
    two at the end of each partition.

    Defined results: a missing or empty text has the end id only; a missing key stays
    missing; rows that share a key are packed each; other columns are not read; an empty
    table gives no rows. A very long text is encoded in chunks.
    """
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, number = byte_encoder(path, ranks), SlackPacker(capacity), TaskContext.get().partitionId() << 32
        end, kind, made, size = np.array([end_id], "<u4"), None, [], 0

        def batch_of() -> pa.RecordBatch:
            columns = [
                pa.array([m[0] for m in made], kind), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)),
                pa.array([m[3] for m in made], pa.binary()), *(pa.array([m[i] for m in made], pa.int64()) for i in (4, 5, 6)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def sequences() -> Iterator[list[Piece]]:
            nonlocal kind
            for batch in arrow_batches(batches):
                kind = batch.schema.field(0).type
                for k, words in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                    yield from packer.add(k, np.concatenate([encoder.encode(words), end]))
            yield from packer.finish()

        for pieces in sequences():
            offset = 0
            for p in pieces:
                made.append((p.key, p.start, len(p.ids), p.ids.tobytes(), p.total, number, offset))
                offset += len(p.ids)
            number, size = number + 1, size + 4 * offset
            if size >= BATCH_BYTES:
                yield batch_of()
                made, size = [], 0
        if made:
            yield batch_of()

    return docs.select(docs[key].alias("key"), whole(text).alias("text")).mapInArrow(run, schema)
