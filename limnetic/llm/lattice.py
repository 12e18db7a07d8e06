"""Language-model scores by subword lattices: the probability of a text over all its segmentations."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.bpe import byte_letters
from limnetic.llm.common import arrow_batches, whole
from limnetic.session import written

# Rounds of expectation and maximisation over the words of the training texts.
ROUNDS = 2
# Added to each piece's expected count.
SMOOTHING = 0.1
# Bytes of words that one lattice holds, and words that one task counts before it hands them on.
LATTICE_BYTES = 1 << 18
COUNTED_WORDS = 250_000
# Texts are scored in blocks of about so many bytes, each with the words it uses.
BLOCK_BYTES = 16 << 20
FACTOR, LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
# Slots of the table in which pieces are found.
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
LN10 = float(np.log(10))


class Pieces:
    """The pieces of a vocabulary file with word-end marks, found by a hash of their bytes.

    A piece with the mark closes a word; any other stands before another piece.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, byte_of = model["end_of_word_suffix"], {x: b for b, x in enumerate(byte_letters())}
        # In order of the ids: bytes, then merges from the first on.
        tokens = sorted(model["vocab"], key=model["vocab"].get)
        self.data = [(bytes(byte_of[x] for x in t.removesuffix(end)), t.endswith(end)) for t in tokens]
        self.longest = max(len(b) for b, _ in self.data)
        keys = np.zeros(len(self.data), np.uint64)
        for i, (piece, last) in enumerate(self.data):
            h = 0
            for b in piece:
                h = (h * int(FACTOR) + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = (h + int(LAST) * last) & 0xFFFFFFFFFFFFFFFF
        self.slots, self.ids = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        for i, at in enumerate(self.slot(keys).tolist()):
            while self.ids[at] >= 0:
                at = (at + 1) % SLOTS
            self.slots[at], self.ids[at] = keys[i], i

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * LAST) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        at = self.slot(keys)
        ids = self.ids[at]
        wrong = np.flatnonzero((ids >= 0) & (self.slots[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % SLOTS
            ids[wrong] = self.ids[at[wrong]]
            wrong = wrong[(ids[wrong] >= 0) & (self.slots[at[wrong]] != keys[wrong])]
        return ids

    def start(self) -> np.ndarray:
        """Scores of the vocabulary itself: the probability falls with a piece's rank in it."""
        weight = 1 / (np.arange(len(self.data)) + 10.0)
        return np.log(weight / weight.sum())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All segmentations of a batch of words, position by position.

    Words are in order of falling length, so that those with a position ``t`` come first.
    ``ids[t]`` and ``scores[t]`` have, by length and word, the piece that ends there.
    """

    def __init__(self, vocabulary: Pieces, words: list[bytes], scores: np.ndarray):
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        self.order = np.array(order, np.int64)
        lengths = np.array([len(words[i]) for i in order], np.int64)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.uint64) + np.uint64(1)
        longest = int(lengths[0]) if len(words) else 0
        self.active = np.searchsorted(-lengths, -np.arange(1, longest + 2), "right")
        self.ids, self.scores = [], []
        known = np.append(scores, -np.inf)
        keys = np.zeros((0, len(words)), np.uint64)
        for t in range(longest):
            n, going_on = self.active[t], self.active[t + 1]
            here = text[starts[:n] + t]
            keys = np.vstack([here[None], keys[: vocabulary.longest - 1, :n] * FACTOR + here])
            found = keys.copy()
            found[:, going_on:] += LAST
            self.ids.append(vocabulary.find(found.reshape(-1)).reshape(found.shape))
            self.scores.append(known[self.ids[-1]])

    def _before(self, t: int, size: int, n: int) -> np.ndarray:
        """Log probability of what stands before a piece of ``size`` bytes that ends at ``t``."""
        return self.alpha[t - size][:n] if size <= t else np.zeros(n)

    def forward(self) -> np.ndarray:
        """Log probability of each word, in the lattice's order: of all segmentations up to its end."""
        self.alpha: list[np.ndarray] = []
        total = np.zeros(len(self.order))
        for t, scores in enumerate(self.scores):
            n = scores.shape[1]
            self.alpha.append(summed(np.array([scores[s - 1] + self._before(t, s, n) for s in range(1, len(scores) + 1)])))
            total[self.active[t + 1] : n] = self.alpha[-1][self.active[t + 1] :]
        return total

    def probabilities(self) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = self.forward()
        return out

    def expected(self, counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """How often each piece is used in all words, their segmentations weighted by probability."""
        total, counts = self.forward(), counts[self.order]
        uses = np.zeros(n_pieces)
        beta = [np.full(s.shape[1], -np.inf) for s in self.scores]
        for t in reversed(range(len(self.scores))):
            n = self.scores[t].shape[1]
            beta[t][self.active[t + 1] :] = 0.0
            for s in range(1, len(self.scores[t]) + 1):
                ids = self.ids[t][s - 1]
                there = np.flatnonzero(ids >= 0)
                after = self.scores[t][s - 1][there] + beta[t][there]
                used = np.exp(self._before(t, s, n)[there] + after - total[there]) * counts[there]
                uses += np.bincount(ids[there], used, n_pieces)
                if s <= t:
                    beta[t - s][there] = np.logaddexp(beta[t - s][there], after)
        return uses


def summed(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each column; a column has a finite number."""
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(0))


def word_slices(words: list[bytes]) -> Iterator[slice]:
    """Slices of about ``LATTICE_BYTES``; a longer word is alone."""
    at, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) > LATTICE_BYTES:
            yield slice(at, i)
            at, size = i, 0
        size += len(w)
    if at < len(words):
        yield slice(at, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Words with ASCII letters in lower case, between ASCII white space."""
    return text.lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64).view(np.int64)


def word_table(docs: DataFrame) -> DataFrame:
    """h, word, c: every word, its hash, and its count in the rows with ``training``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_pydict({"h": hashes_of(words), "word": pa.array(words, pa.binary()), "c": pa.array(list(counts.values()), pa.int64())})

        for batch in arrow_batches(batches):
            for text, training in zip(batch["text"].to_pylist(), batch["training"].to_pylist()):
                if training:
                    counts.update(words_of(text))
                else:
                    for w in words_of(text):
                        counts.setdefault(w, 0)
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts.clear()
        if counts:
            yield out()

    counted = docs.select("text", "training").mapInArrow(run, "h long, word binary, c long")
    return counted.groupBy("h", "word").agg(F.sum("c").alias("c"))


def expected_pieces(words: DataFrame, path: str, scores: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over the counted words; a row for each piece reaches the driver."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = pieces(path), np.zeros(len(scores))
        for batch in batches:
            found, counts = batch["word"].to_pylist(), batch["c"].to_numpy().astype(float)
            for part in word_slices(found):
                total += Lattice(vocabulary, found[part], shared.value).expected(counts[part], len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": used, "uses": total[used]})

    uses = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    out = np.zeros(len(scores))
    for row in uses.toLocalIterator():
        out[row["piece"]] = row["uses"]
    return out


def scored_words(words: DataFrame, path: str, scores: np.ndarray) -> DataFrame:
    """h, c and the log10 probability of each word."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            found = batch["word"].to_pylist()
            parts = [Lattice(vocabulary, found[p], shared.value).probabilities() / LN10 for p in word_slices(found)]
            yield pa.RecordBatch.from_pydict({"h": batch["h"], "c": batch["c"], "p": np.concatenate([np.zeros(0), *parts])})

    return words.select("h", "word", "c").mapInArrow(run, "h long, c long, p double")


def lattice_scores(docs: DataFrame, training: Column, path: str, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Log10 probabilities of every whole text, learned from the rows where ``training`` holds.

    ``path`` is a vocabulary file on every executor. Its pieces start with scores by rank
    and are estimated anew on all words of the training rows. A word's probability is the
    sum over all its segmentations; a text's that of its words and of one end. Returns
    key, training, n_tokens, n_known, train_tokens, base_score (add-one word unigrams)
    and score (the lattices').

    Words are counted and scored once in the whole corpus; texts then meet the words of
    their block, told apart by 64-bit hashes, so no task or driver holds all words.

    Defined results: a missing or empty text is its end alone; ``training`` counts as
    false where it is null; without training rows all counts are 0 and the pieces keep
    their first scores; repeated rows are scored alike; an empty table gives an empty one.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), whole(text).cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    sizes = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.sum(F.col("training").cast("long")).alias("ends")).first()
    ends = sizes["ends"] or 0
    words = written(word_table(rows), "lattice-words")
    sums = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    train_tokens, distinct = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)

    scores, end_score = pieces(path).start(), np.log(1e-3)
    for _ in range(rounds if train_tokens else 0):
        uses = expected_pieces(words, path, scores) + SMOOTHING
        total = np.log(uses.sum() + ends + SMOOTHING)
        scores, end_score = np.log(uses) - total, np.log(ends + SMOOTHING) - total
    scored = written(scored_words(words, path, scores), "lattice-scored")

    blocks = max(1, -(-(sizes["size"] or 0) // BLOCK_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int").alias("block"), "key", "training", "text")

    def used(block: pa.Table) -> pa.Table:
        parts = [hashes_of(words_of(t)) for b in arrow_batches(block.to_batches()) for t in b["text"].to_pylist()]
        h = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))
        return pa.table({"block": pa.array(np.full(len(h), block["block"][0].as_py()), pa.int32()), "h": h})

    log_all = float(np.log10(train_tokens + distinct + 1))
    end_base, end_log = float(np.log10(ends + 1)) - log_all, float(end_score) / LN10

    def judged(block: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["h"].to_numpy())
        h, c, p = (known[x].to_numpy()[order] for x in ("h", "c", "p"))
        base = np.log10(c + 1.0) - log_all
        parts = []
        for batch in arrow_batches(block.to_batches()):
            split = [words_of(t) for t in batch["text"].to_pylist()]
            at = np.searchsorted(h, hashes_of([w for x in split for w in x]))
            stops = np.cumsum([len(x) for x in split])
            over = lambda x: np.diff(np.r_[0, np.r_[0, np.cumsum(x[at])][stops]]) if len(h) else np.zeros(len(split))  # noqa: B023, E731
            parts.append(pa.table({
                key: batch["key"], "training": batch["training"], "n_tokens": pa.array([len(x) + 1 for x in split], pa.int64()),
                "n_known": pa.array(over((c > 0).astype(np.int64)).astype(np.int64) + (ends > 0)), "train_tokens": pa.array([train_tokens] * len(split), pa.int64()),
                "base_score": over(base) + end_base, "score": over(p) + end_log,
            }))
        return pa.concat_tables(parts)

    needed = dealt.groupBy("block").applyInArrow(used, "block int, h long").join(scored, "h").select("block", "h", "c", "p")
    schema = f"`{key}` {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(judged, schema)
