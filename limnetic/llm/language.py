"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import arrow_batches, hashed

SIZE = 3
# The fit reads about so many training rows of each language, chosen by a hash of the key.
SAMPLE_ROWS = 2000
# An n-gram belongs to a language in which it is at least this share as frequent as where it
# is most frequent, and occurs so many times in the sample.
LEAST_SHARE = 0.05
LEAST_COUNT = 3
BITS_PER_GRAM = 16
HASHES = 3
SPACE_CODE = 32
# Texts handled at once, in characters.
SLICE_CHARS = 1 << 20


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Lower-case code point of every letter; a space for everything else."""
    codes = np.full(0x110000, SPACE_CODE, np.uint32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams inside words padded by a space, and the number of them in each text."""
    joined = " ".join(texts) + " "
    codes = letter_codes()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
    blank = codes == SPACE_CODE
    blank[1:] &= blank[:-1].copy()  # a space after a space
    ends = np.cumsum([len(t) + 1 for t in texts])
    kept = np.cumsum(~blank)[ends - 1]
    codes = np.r_[np.uint32(SPACE_CODE), codes[~blank]].astype(np.uint64)
    n = max(0, len(codes) - SIZE + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(SIZE):
        mixed = mixed * np.uint64(0x100000001B3) + codes[j : j + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    # An n-gram is of the text of its second letter; one that crosses a space inside is none.
    inside = np.ones(n, bool)
    for j in range(1, SIZE - 1):
        inside &= codes[j : j + n] != SPACE_CODE
    upto = np.r_[0, np.cumsum(inside)]
    counts = np.diff(np.r_[0, upto[np.minimum(kept, n)]])
    return mixed[inside], counts


@dataclass
class LanguageFilters:
    """Rows of bits, one bit for each language: the AND of an n-gram's rows is its languages."""

    languages: list[str]
    rows: np.ndarray  # (rows, words of 64 languages)
    false_rate: np.ndarray  # of each language: share of unseen n-grams that its filter returns

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((hashes + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)

    @classmethod
    def of(cls, found: dict[str, np.ndarray]) -> LanguageFilters:
        languages = sorted(found)
        most = max((len(x) for x in found.values()), default=1)
        size = 1 << max(10, int(np.ceil(np.log2(BITS_PER_GRAM * most + 1))))
        rows = np.zeros((size, (len(languages) + 63) // 64 or 1), np.uint64)
        for i, language in enumerate(languages):
            for at in cls.places(found[language], size):
                rows[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([(rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, rows, fill**HASHES)

    def popcounts(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each text, the n-grams that each language's filter returns."""
        out = np.zeros((len(counts), len(self.languages)), np.float64)
        there = np.flatnonzero(counts)
        starts = np.r_[0, np.cumsum(counts)][there]
        if not len(there):
            return out
        places = list(self.places(hashes, len(self.rows)))
        for word in range(self.rows.shape[1]):
            column = np.ascontiguousarray(self.rows[:, word])
            bits = column[places[0]]
            for at in places[1:]:
                bits &= column[at]
            for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                hit = (bits >> np.uint64(i % 64) & np.uint64(1)).astype(np.int32)
                out[there, i] = np.add.reduceat(hit, starts)
        return out

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """language, score and coverage; see ``identify``."""
        hashes, counts = grams([t or "" for t in texts])
        n = len(texts)
        result = pd.DataFrame({"language": ["und"] * n, "score": np.zeros(n), "coverage": np.zeros(n)})
        if not self.languages or not n:
            return result
        found = (self.popcounts(hashes, counts) - counts[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        found = np.clip(found, 0, None)
        best = found.argmax(1)
        top = found[np.arange(n), best]
        second = np.sort(found, 1)[:, -2] if found.shape[1] > 1 else np.zeros(n)
        letters = counts > 0
        result["language"] = np.where(letters, np.array(self.languages, object)[best], "und")
        result["score"] = np.where(letters & (top > 0), top / np.maximum(top + second, 1e-9), 0.0)
        result["coverage"] = np.where(letters, np.minimum(top / np.maximum(counts, 1), 1.0), 0.0)
        return result


def fit_filters(
    docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> LanguageFilters:
    """Filters from the rows where ``training`` holds and neither text nor language is missing.

    About ``sample_rows`` rows of each language are read, chosen by a hash of the key; the
    n-grams of so many rows bound what the driver receives.
    """
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    if not sizes:
        return LanguageFilters.of({})
    rate = F.lit(0.0)
    for name, size in sizes.items():
        rate = F.when(F.col(lang) == name, F.lit(min(1.0, sample_rows / size))).otherwise(rate)
    chosen = rows.where((hashed("language", F.col(key)) + 0.5) / F.lit(float(1 << 52)) < rate)
    chosen = chosen.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            frame = batch.to_pandas()
            for language, group in frame.groupby("lang"):
                values, counts = np.unique(grams(list(group["text"]))[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [language] * len(values), "gram": values.view(np.int64), "n": counts})

    counted = chosen.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frame = counted.where(F.col("n") >= LEAST_COUNT).toPandas()
    frame["rate"] = frame["n"] / frame.groupby("lang")["n"].transform("sum")
    frame = frame[frame["rate"] >= LEAST_SHARE * frame.groupby("gram")["rate"].transform("max")]
    found = {language: np.zeros(0, np.uint64) for language in sizes}
    found |= {language: group["gram"].to_numpy(np.int64).view(np.uint64) for language, group in frame.groupby("lang")}
    return LanguageFilters.of(found)


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text", into: str = "language_id") -> DataFrame:
    """``docs`` with a struct ``into``: language, score, coverage of every whole text.

    All languages whose filters hold an n-gram come from one AND of bit rows. Per
    language the hits are counted and corrected for the filter's false positives; the
    largest count decides, the first language in order on a tie. ``score`` is that count
    over the sum of it and the second, ``coverage`` its share of all n-grams.

    Defined results: a missing text or one without a letter is ``und`` with score 0; so is
    every text if no row could be learned from. A text of which no language knows an
    n-gram is of the first language, with score 0. Repeated rows are judged alike; an
    empty table gives an empty one; an input column named ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("language string, score double, coverage double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        parts, at, size = [], 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= SLICE_CHARS or i == len(texts):
                parts.append(shared.value.judge(list(texts[at:i])))
                at, size = i, 0
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"language": [], "score": [], "coverage": []})

    return docs.withColumn(into, judged(F.col(text).cast("string")))
