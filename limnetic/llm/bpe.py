"""Byte-pair encoding and decoding with a public vocabulary, by contiguous rank arrays."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from limnetic.llm.common import arrow_batches, whole

NONE = 1 << 30
# Words of up to so many parts are merged by scanning their rank array, longer ones by a queue.
SHORT = 64
# Pieces and words remembered by one worker; the older half of them goes when they are too many.
REMEMBERED = 150_000
# Texts of these characters are cut and put in lower case here: Latin letters and common signs, whose classes all
# versions of Unicode share, without the letter whose lower case is two characters. Others go to the library.
LATIN = re.compile("[\0-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
# White space of the vocabulary's pattern up to there, as fixed values.
WHITE = "\\t-\\r \\x85\\xa0"


def characters(kind: str) -> str:
    """Ranges, for a character class, of the Latin code points whose category begins with ``kind``."""
    inside = np.array([unicodedata.category(chr(c))[0] == kind for c in range(0x180)])
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False])).reshape(-1, 2)
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Remembered(dict):
    """Values by key, made when missing, with a bound on their number."""

    def __init__(self, make, limit: int = REMEMBERED):
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordBpe:
    """Encoder and decoder of one vocabulary file with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        pairs = ((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"])
        # A pair of ids, as one number, to its rank; a rank to the merged id.
        merges = [(a << 20 | b, c) for a, b, c in pairs]
        self.rank = {pair: r for r, (pair, _) in reversed(list(enumerate(merges)))}
        self.merged = [c for _, c in merges]
        self.token = {i: t for t, i in {**vocab, **added}.items()}
        self.added = {t: packed([i]) for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in x)
        for name, inside in ((r"\s", WHITE), (r"\p{L}", characters("L")), (r"\p{N}", characters("N"))):
            split = split.replace(name, inside)
        self.words = re.compile(split)
        self.path, self.library = path, None
        self.letters = dict(enumerate(letters))
        self.byte = {x: b for b, x in enumerate(letters)}
        self.remembered, self.remembered_words = Remembered(self.piece), Remembered(self.word)

    def merge_short(self, parts: list[int]) -> list[int]:
        """Scan for the least adjacent rank, delete that boundary, refresh the ranks beside it."""
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 20 | parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: least ranks from a queue, boundaries in a linked list."""
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], NONE)) < NONE]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 20 | parts[j], NONE) != r:
                continue
            parts[i], parts[j] = self.merged[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (s := rank(parts[a] << 20 | parts[b], NONE)) < NONE:
                    heapq.heappush(queue, (s, a))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit numbers of a word in the vocabulary's byte letters."""
        data = list(map(self.byte.__getitem__, word))
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.last[data[-1]])
        return packed(self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts))

    def piece(self, piece: bytes) -> bytes:
        """The ids of a text without ASCII white space."""
        known = self.remembered_words.__getitem__
        if piece.isalpha():  # ASCII letters
            return known(piece.lower().decode())
        text, out = piece.decode(), []
        for part in self.special.split(text) if "<" in text else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif LATIN.fullmatch(part):
                out.extend(known(w.encode().decode("latin-1").translate(self.letters)) for w in self.words.findall(part.lower()))
            else:
                # Lower case, normal form and classes of characters are the library's, whatever Unicode it knows.
                self.library = self.library or Tokenizer.from_file(self.path)
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out.extend(known(w) for w, _ in cut)
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8. Neither words nor normal forms reach over ASCII white space."""
        return b"".join(map(self.remembered.__getitem__, text.split()))

    def forget(self) -> None:
        """Free what was remembered; the worker may go on with other work."""
        self.library = None
        for known in (self.remembered, self.remembered_words):
            known.clear()
            known.older = {}

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decode: bool = True
) -> DataFrame:
    """key, ids (binary: little-endian unsigned 32-bit numbers), n_tokens and decoded of every whole text.

    ``path`` is the vocabulary file on every executor; no special tokens are added.
    ``decoded`` is left out without ``decode``.

    Defined results: a missing or empty text has no ids and decodes to an empty text;
    strings of special tokens in a text are those tokens; rows without a key and repeated
    rows are encoded like others; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), whole(text).cast("binary").alias("text"))
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        # Its pieces are freed with the task: a reused worker would hold them in other stages.
        for batch in arrow_batches(batches):
            ids = [bpe.encode(t) for t in batch["text"].to_pylist()]
            columns = {key: batch["key"], "n_tokens": [len(x) // 4 for x in ids], "ids": pa.array(ids, pa.binary())}
            if decode:
                columns["decoded"] = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()

    return rows.mapInArrow(run, schema)
