"""Collocations: n-grams counted in quotient filters that lose nothing, scored by their weakest cut."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import arrow_batches
from limnetic.operators.ordered import numbered
from limnetic.session import written

LONGEST = 4
# The dictionary of word ids that is broadcast: the most frequent words, of so many bytes at most.
DICTIONARY_WORDS, WORD_BYTES = 1 << 20, 64
# Digests of frequent words outside the dictionary are broadcast up to this number.
DIGESTS = 1 << 20
# Frequent pairs are broadcast as a bitmap up to this number; it only spares longer n-grams.
PAIRS, PAIR_BITS = 1 << 21, 27
# Distinct words of one task's counters, and n-grams of one of its filters.
COUNTERS, FILTER_KEYS = 1 << 18, 1 << 20
# Bytes of text that are words at once.
WORDS_BYTES = 1 << 20
# Keys of one slice over all tasks, and keys that a slice of one filter has at least if filters are full.
SLICE_KEYS, LEAST_RUN = 1 << 21, 64

# Lower case for A-Z, a line feed for what ends a piece, a blank for what ends a word.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
# A byte that no UTF-8 text has stands between pieces.
BREAK = b"\xff"

U = np.uint64


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of the texts in order, with ``BREAK`` between pieces."""
    return b"\n".join(texts).translate(FOLDED).replace(b"\n", b" \xff ").split()


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in arrow_batches(batches, WORDS_BYTES):
        texts = defaultdict(list)
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            texts[lang].append(text)
        for lang, group in texts.items():
            yield lang, words_of(group)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed function of 64-bit numbers whose high bits depend on all bits."""
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)


class Permutation:
    """Packs n-grams of word ids of ``width`` bits and permutes the packed numbers, invertibly.

    The first words are the left half, the rest the right one. Each round adds (xor) a mix of one
    half to the other, which the same round undoes. The permuted number of ``bits`` bits is
    held as its first 64 bits at most, and the rest where it has more.
    """

    ROUNDS = 4

    def __init__(self, length: int, width: int):
        if length * width > 128 or 2 * width > 64:
            raise ValueError("the word ids are too wide")
        self.length, self.width, self.bits = length, width, length * width
        self.first = (length + 1) // 2
        self.left, self.right = self.first * width, (length - self.first) * width
        self.low = max(0, self.bits - 64)

    def _round(self, i: int, half: np.ndarray, bits: int) -> np.ndarray:
        return mixed(half + U(i + 1)) >> U(64 - bits)

    def permute(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        halves = []
        for part in (words[: self.first], words[self.first :]):
            half = part[0]
            for w in part[1:]:
                half = half << U(self.width) | w
            halves.append(half)
        a, b = halves
        for i in range(0, self.ROUNDS, 2):
            a = a ^ self._round(i, b, self.left)
            b = b ^ self._round(i + 1, a, self.right)
        if not self.low:
            return a << U(self.right) | b, np.zeros(0, np.uint64)
        return a << U(self.right - self.low) | b >> U(self.low), b & U((1 << self.low) - 1)

    def words(self, high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """The word ids behind permuted numbers."""
        if not self.low:
            a, b = high >> U(self.right), high & U((1 << self.right) - 1)
        else:
            shift = self.right - self.low
            a, b = high >> U(shift), (high & U((1 << shift) - 1)) << U(self.low) | low
        for i in reversed(range(0, self.ROUNDS, 2)):
            b = b ^ self._round(i + 1, a, self.right)
            a = a ^ self._round(i, b, self.left)
        found, mask = [], U((1 << self.width) - 1)
        for half, n in ((a, self.first), (b, self.length - self.first)):
            found += [half >> U(self.width * (n - 1 - i)) & mask for i in range(n)]
        return found


class Run:
    """Distinct permuted numbers in ascending order, with their counts."""

    __slots__ = ("high", "low", "counts")

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.high, self.low, self.counts = high, low, counts

    def __len__(self) -> int:
        return len(self.high)

    @classmethod
    def summed(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> Run:
        """Equal numbers become one; runs that are in order already are merged, not sorted."""
        order = np.argsort(high, kind="quicksort" if counts is None else "stable")
        h, l = high[order], low[order] if len(low) else low  # noqa: E741
        if len(low) and ((h[1:] == h[:-1]) & (l[1:] != l[:-1])).any():
            order = np.lexsort((low, high))
            h, l = high[order], low[order]  # noqa: E741
        new = h[1:] != h[:-1]
        if len(low):
            new |= l[1:] != l[:-1]
        at = np.flatnonzero(np.r_[True, new]) if len(h) else np.zeros(0, np.int64)
        sums = np.diff(np.r_[at, len(h)]) if counts is None else np.add.reduceat(counts[order], at) if len(h) else counts
        return cls(h[at], l[at] if len(low) else l, sums)

    @classmethod
    def merged(cls, runs: list[Run]) -> Run:
        return cls.summed(*(np.concatenate([getattr(r, f) for r in runs]) for f in cls.__slots__))


class QuotientFilter:
    """A run as a counting quotient filter of one slice: the bytes of its runs of remainders.

    A number without its slice's bits is a quotient, which has a bit if it occurs, and a
    remainder kept in full, in a slot that has a bit if it is the last of its quotient. The
    quotient has as many bits as make the remainders whole bytes. Counters are a byte, or
    eight bytes at the end where that is too small.
    """

    @staticmethod
    def pack(run: Run, bits: int, low: int) -> bytes:
        """``bits``: of the numbers without the slice's; ``low``: how many of them ``run.low`` holds."""
        n = len(run)
        quotient = max(n.bit_length() - 4, 0)
        quotient = min(bits - low, quotient + (bits - quotient) % 8)
        rest = bits - quotient
        in_high = rest - low  # bits of the remainder in run.high
        quotients = (run.high >> U(in_high) if in_high < 64 else np.zeros(n, np.uint64)).astype(np.int64)
        occupied = np.zeros(1 << quotient, bool)
        occupied[quotients] = True
        ends = np.r_[quotients[1:] != quotients[:-1], True]
        high = run.high & U((1 << in_high) - 1)
        if low:
            carried = high >> U(64 - low) if low < 64 else high
            words = [carried, (high << U(low) if low < 64 else U(0)) | run.low]
        else:
            words = [high]
        slots = np.stack(words, 1).astype(">u8").view(np.uint8).reshape(n, -1)[:, -(-(-rest // 8)) :] if rest else np.zeros((n, 0), np.uint8)
        small = np.minimum(run.counts, 255).astype(np.uint8)
        large = run.counts[run.counts >= 255].astype("<i8")
        head = np.array([n, bits, low, quotient], "<i4")
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(ends), np.ascontiguousarray(slots), small, large))

    @staticmethod
    def unpack(data: bytes) -> Run:
        n, bits, low, quotient = map(int, np.frombuffer(data, "<i4", 4))
        rest, at = bits - quotient, 16
        size = -(-(1 << quotient) // 8)
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=1 << quotient)
        at += size
        ends = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n)
        at += -(-n // 8)
        width = -(-rest // 8)
        padded = np.zeros((n, 16), np.uint8)
        if width:
            padded[:, 16 - width :] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        words = padded.view(">u8").astype(np.uint64)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", int((counts == 255).sum()), at + n)
        quotients = np.flatnonzero(occupied).astype(np.uint64)[np.cumsum(ends) - ends]
        in_high = rest - low
        if low:
            high = words[:, 1] >> U(low) if low < 64 else np.zeros(n, np.uint64)
            high |= words[:, 0] << U(64 - low) if low < 64 else words[:, 0]
            lows = words[:, 1] & U((1 << low) - 1)
        else:
            high, lows = words[:, 1], np.zeros(0, np.uint64)
        return Run(quotients << U(in_high) | high if in_high < 64 else high, lows, counts)


def pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(mixed(a) + b) >> U(64 - PAIR_BITS)


def windows(ids: np.ndarray, length: int, bitmap: np.ndarray | None) -> list[np.ndarray]:
    """Word ids of the n-grams of dictionary words; with ``bitmap``, only where all pairs may be frequent."""
    n = len(ids) - length + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * length
    there = ids != 0
    if bitmap is None or length == 2:
        go = there[:n].copy()
        for i in range(1, length):
            go &= there[i : n + i]
    else:
        slots = pair_slots(ids[:-1], ids[1:])
        pairs = there[:-1] & there[1:] & (bitmap[(slots >> U(3)).astype(np.int64)] >> (slots & U(7)).astype(np.uint8) & 1).astype(bool)
        go = pairs[:n].copy()
        for i in range(1, length - 1):
            go &= pairs[i : n + i]
    at = np.flatnonzero(go)
    return [ids[at + i] for i in range(length)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(BREAK, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.binary()), "n": pa.array(c.values(), pa.int64())})

        for lang, words in by_language(batches):
            counts[lang].update(words)
            if sum(map(len, counts.values())) > COUNTERS:
                yield from rows()
                counts.clear()
        yield from rows()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def counted_phrases(docs: DataFrame, shared, lengths: list[int], width: int, bitmap, least: int, keys: int) -> DataFrame:
    """(lang, phrase, m, a) of the n-grams of dictionary words that occur ``least`` times.

    ``shared`` holds the dictionary by language and in order of the ids. Each task turns its
    n-grams into filters, cut into slices by their first bits; a slice's filters of all tasks
    meet and their runs are merged. ``keys`` bounds the n-grams of a length in all rows.
    """
    most = (FILTER_KEYS // LEAST_RUN).bit_length() - 1
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slice_bits = min(max((keys // SLICE_KEYS).bit_length(), (2 * partitions).bit_length()), most, 2 * width)
    kinds = {m: Permutation(m, width) for m in lengths}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, flags = shared.value[0], bitmap.value if bitmap else None
        waiting: dict[int, list] = {m: [] for m in lengths}

        def filters(m: int) -> pa.RecordBatch:
            p = kinds[m]
            run = Run.summed(np.concatenate([x[0] for x in waiting[m]]), np.concatenate([x[1] for x in waiting[m]]), None)
            waiting[m].clear()
            inside = p.bits - p.low - slice_bits  # bits of the first part behind the slice's
            slices = (run.high >> U(inside)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]])
            made = []
            for a, b in zip(cuts, [*cuts[1:], len(run)]):
                part = Run(run.high[a:b] & U((1 << inside) - 1), run.low[a:b], run.counts[a:b])
                made.append(QuotientFilter.pack(part, p.bits - slice_bits, p.low))
            return pa.RecordBatch.from_pydict({"m": pa.array([m] * len(cuts), pa.int32()), "slice": slices[cuts], "filter": pa.array(made, pa.binary())})

        sizes = dict.fromkeys(lengths, 0)
        for lang, words in by_language(batches):
            ids = np.array(list(map(ids_of[lang].get, words, (0,) * len(words))) if lang in ids_of else [], np.uint64)
            for m in lengths:
                found = windows(ids, m, flags)
                if len(found[0]):
                    waiting[m].append(kinds[m].permute(found))
                    sizes[m] += len(found[0])
                if sizes[m] > FILTER_KEYS:
                    yield filters(m)
                    sizes[m] = 0
        for m in lengths:
            if waiting[m]:
                yield filters(m)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, runs, at, size = shared.value[1], [], None, 0

        def frequent() -> pa.RecordBatch:
            m, number = at
            run, p = Run.merged(runs), kinds[m]
            go = run.counts >= least
            inside = p.bits - p.low - slice_bits
            high = run.high[go] | U(number << inside)
            ids = np.stack([w.astype(np.int64) for w in p.words(high, run.low[go] if p.low else run.low)], 1) - 1
            phrases = [(names[row[0]][0], b" ".join([names[i][1] for i in row])) for row in ids.tolist()]
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([x for x, _ in phrases], pa.string()), "phrase": pa.array([x for _, x in phrases], pa.binary()),
                "m": pa.array([m] * len(phrases), pa.int32()), "a": pa.array(run.counts[go], pa.int64()),
            })

        for batch in batches:
            for m, number, data in zip(batch["m"].to_pylist(), batch["slice"].to_pylist(), batch["filter"]):
                if at != (m, number):
                    if runs:
                        yield frequent()
                    runs, at, size = [], (m, number), 0
                runs.append(QuotientFilter.unpack(data.as_buffer()))
                size += len(runs[-1])
                if size > 2 * max(SLICE_KEYS, len(runs[0])):  # what waits is merged as soon as it outgrows what is merged
                    runs = [Run.merged(runs)]
                    size = len(runs[0])
        if runs:
            yield frequent()

    parts = docs.mapInArrow(build, "m int, slice long, filter binary")
    placed = parts.repartition("m", "slice").sortWithinPartitions("m", "slice")
    return placed.mapInArrow(merge, "lang string, phrase binary, m int, a long")


def digest(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def other_phrases(docs: DataFrame, shared, others: frozenset[int] | None, least: int) -> DataFrame:
    """(lang, phrase, m, a) of the frequent n-grams with a word outside the dictionary, counted as text."""
    known_others = docs.sparkSession.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, wanted = shared.value[0], known_others.value
        for lang, words in by_language(batches):
            known = ids_of.get(lang, {})
            # 0: breaks a phrase, 1: in the dictionary, 2: perhaps a frequent word outside
            kind = [1 if w in known else 0 if w == BREAK or (wanted is not None and digest(w) not in wanted) else 2 for w in words]
            counts: dict[int, Counter] = {m: Counter() for m in range(2, LONGEST + 1)}
            done = -1
            for i in (i for i, x in enumerate(kind) if x == 2):
                for m, c in counts.items():
                    # n-grams that begin at or before the word, and behind the outside word before it
                    for a in range(max(done + 1, i - m + 1, 0), i + 1):
                        if a + m <= len(words) and all(kind[a : a + m]):
                            c[b" ".join(words[a : a + m])] += 1
                done = i
            for m, c in counts.items():
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(c), pa.string()), "phrase": pa.array(list(c), pa.binary()),
                    "m": pa.array([m] * len(c), pa.int32()), "a": pa.array(c.values(), pa.int64()),
                })

    found = docs.mapInArrow(run, "lang string, phrase binary, m int, a long")
    return found.groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def pair_bitmap(pairs: DataFrame, shared) -> np.ndarray:
    """One bit for the slot of each pair; other pairs may share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value[0]
        for batch in batches:
            both = [[ids_of[lang][w] for w in phrase.split(b" ")] for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist())]
            ids = np.array(both, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"slot": pair_slots(ids[:, 0], ids[:, 1]).astype(np.int64)})

    slots = pairs.select("lang", "phrase").mapInArrow(run, "slot long").toArrow()["slot"].to_numpy()
    flags = np.zeros(1 << PAIR_BITS - 3, np.uint8)
    np.bitwise_or.at(flags, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return flags


def all_phrases(docs: DataFrame, least: int, dictionary_words: int = DICTIONARY_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a) of all phrases of up to four words that occur ``least`` times, and (lang, n)."""
    sc = docs.sparkSession.sparkContext
    words = written(word_counts(docs), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    short = frequent.where(F.octet_length("word") <= WORD_BYTES)
    chosen = short.orderBy(F.desc("n"), "lang", "word").limit(dictionary_words).select("lang", "word").toArrow()
    names = list(zip(chosen["lang"].to_pylist(), chosen["word"].to_pylist()))
    ids_of: dict[str, dict[bytes, int]] = defaultdict(dict)
    for i, (lang, word) in enumerate(names, 1):
        ids_of[lang][word] = i
    shared = sc.broadcast((dict(ids_of), names))
    width = max(len(names).bit_length(), 8)
    counts = frequent.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    n_others, keys = counts["words"] - len(names), counts["n"] or 0
    pairs = written(counted_phrases(docs, shared, [2], width, None, least, keys), "pairs")
    bitmap = None
    if pairs.count() <= PAIRS:
        bitmap = sc.broadcast(pair_bitmap(pairs, shared))
    longer = counted_phrases(docs, shared, list(range(3, LONGEST + 1)), width, bitmap, least, keys)
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("m"), F.col("n").alias("a"))
    parts = single.unionByName(pairs).unionByName(longer)
    if n_others:
        others = None
        if n_others <= DIGESTS:

            def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = shared.value[0]
                for batch in batches:
                    words = [w for lang, w in zip(batch["lang"].to_pylist(), batch["word"].to_pylist()) if w not in known.get(lang, {})]
                    yield pa.RecordBatch.from_pydict({"digest": pa.array(map(digest, words), pa.int64())})

            found = frequent.select("lang", "word").mapInArrow(digests, "digest long").toArrow()
            others = frozenset(found["digest"].to_pylist())
        parts = parts.unionByName(other_phrases(docs, shared, others, least))
    return written(parts.withColumn("phrase", F.col("phrase").cast("string")), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``first`` phrases of each language, as op13's contract has them.

    Words are counted first; those that occur ``least`` times get ids by frequency. Pairs
    and, where all their pairs may be frequent, longer n-grams of ids are counted in quotient
    filters. Frequent words beyond the dictionary's bound are counted as text, exactly too.

    Defined results: a missing text is empty; a missing language is ``und``; rows that repeat
    count each; equal scores go by count, then by the bytes of the phrase; other columns are
    not read; an empty table, or one without frequent phrases, gives no rows. A text may be
    long: its words are held at once, with texts of about 1 MB at a time else.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    phrases, totals = all_phrases(rows, least)
    split = F.split("phrase", " ", -1)
    longer = phrases.where("m > 1").withColumn("words", split)
    joined = lambda a, n: F.concat_ws(" ", F.slice("words", a, n))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    # Decimals of 38 digits hold the products.
    score = F.expr("cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as decimal(20,0)) as long)").alias("score")
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).groupBy("lang", "phrase", "a")
    scored = scored.agg(F.min(F.struct(score, "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    inside = longer.where("m > 2").select("lang", "a", "m", "words", F.explode(F.expr("sequence(2, m - 1)")).alias("size"))
    inside = inside.withColumn("at", F.explode(F.expr("sequence(1, m - size + 1)")))
    inside = inside.groupBy("lang", joined(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("top"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("top is null or 100 * cast(top as decimal(20,0)) < 80 * cast(a as decimal(20,0))")
    # Rows are numbered by range, so that no language is sorted in one task; a rank counts from its language's first row.
    ordered = numbered(kept, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "number")
    begins = ordered.groupBy("lang").agg(F.min("number").alias("begin"))
    ranked = ordered.join(begins, "lang").withColumn("rank", F.col("number") - F.col("begin") + 1).where(F.col("rank") <= first).join(totals, "lang")
    return ranked.select(F.col("lang").alias(lang), "rank", "phrase", "a", "l", "r", "n", "score")
