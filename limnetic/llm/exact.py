"""Exact duplicates by counting quotient filters and byte verification."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import SPACE, free_names, small_join, whole
from limnetic.session import written

# Quotients of one slice of the filters; the number of slices follows the rows.
QUOTIENT_BITS = 15


def counted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, with the sums of their counts."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")  # merges runs that are in order already
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[first], np.add.reduceat(counts, first)


class QuotientFilter:
    """Counts of the fingerprints of one slice, as runs of sorted remainders.

    ``occupied`` has a bit for each quotient, ``ends`` a bit for each slot that closes the
    run of its quotient; slots hold remainders in order, with their counts.
    """

    def __init__(self, bits: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.ends, self.remainders, self.counts = bits, occupied, ends, remainders, counts

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """``values``: fingerprints without the slice's bits, ``bits`` wide, in any order."""
        values, counts = counted(values, counts)
        low = np.uint64(bits - QUOTIENT_BITS)
        quotients = (values >> low).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotients] = True
        ends = np.r_[quotients[1:] != quotients[:-1], True] if len(values) else np.zeros(0, bool)
        return cls(bits, occupied, ends, values & ((np.uint64(1) << low) - np.uint64(1)), counts)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, with their counts; nothing is lost."""
        run = np.r_[0, np.cumsum(self.ends)[:-1]] if len(self.ends) else np.zeros(0, int)
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        return (quotients << np.uint64(self.bits - QUOTIENT_BITS)) | self.remainders, self.counts

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        items = [f.items() for f in filters]
        return cls.of(np.concatenate([v for v, _ in items]), np.concatenate([c for _, c in items]), filters[0].bits)

    def to_bytes(self) -> bytes:
        return zlib.compress(b"".join((
            np.array([self.bits, len(self.remainders)], "<i8").tobytes(), np.packbits(self.occupied).tobytes(),
            np.packbits(self.ends).tobytes(), self.remainders.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes(),
        )), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        data = zlib.decompress(data)
        bits, n = map(int, np.frombuffer(data, "<i8", 2))
        at = 16
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (1 << QUOTIENT_BITS) // 8, at)).astype(bool)
        at += (1 << QUOTIENT_BITS) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        return cls(bits, occupied, ends, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n))


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in column ``fp`` of ``prints``."""
    slice_bits = max(0, (rows >> QUOTIENT_BITS).bit_length())
    bits = 64 - slice_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def settled() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([values, *waiting])
            ones = np.ones(len(every) - len(values), np.int64)
            return counted(every, np.concatenate([counts, ones]))

        for batch in batches:
            waiting.append(batch["fp"].to_numpy(np.int64).view(np.uint64))
            if sum(map(len, waiting)) > max(1 << 18, len(values)):
                values, counts = settled()
                waiting = []
        values, counts = settled()
        slices = (values >> np.uint64(bits)).astype(np.int64) if slice_bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(values) else []
        for a, b in zip(cuts, [*cuts[1:], len(values)]):
            inside = values[a:b] & ((np.uint64(1) << np.uint64(bits)) - np.uint64(1)) if slice_bits else values[a:b]
            yield pd.DataFrame({"slice": [slices[a]], "filter": [QuotientFilter.of(inside, counts[a:b], bits).to_bytes()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, counts = QuotientFilter.merged([QuotientFilter.from_bytes(x) for x in group["filter"]]).items()
        values, counts = values[counts > 1], counts[counts > 1]
        if slice_bits:
            values = values | (np.uint64(key[0]) << np.uint64(bits))
        return pd.DataFrame({"fp": values.view(np.int64), "n": counts})

    filters = prints.select("fp").mapInPandas(build, "slice long, filter binary")
    return filters.groupBy("slice").applyInPandas(merge, "fp long, n long")


def normalised(text: str) -> Column:
    return F.regexp_replace(whole(text), SPACE, " ")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space is one space; a missing
    text is empty. A fingerprint of every text goes into a counting quotient filter per
    partition; the filters are merged slice by slice, and only texts whose fingerprint
    occurs more than once are compared byte by byte. A group's row with the smallest key
    stays.

    Defined results: rows without a key come after all keys; of rows with both key and
    text alike one stays and all count in ``group_size``; an empty table gives an empty one.
    """
    clean = normalised(text)
    prints = docs.select(F.col(key).alias("id"), F.xxhash64(clean).alias("fp"), F.sha2(clean, 256).alias("sha"))
    prints = written(prints.withColumn("row", F.monotonically_increasing_id()), "exact-prints")
    repeated = written(repeated_fingerprints(prints, prints.count()), "exact-repeated").select("fp")
    routed = prints.join(repeated, "fp", "left_semi")
    # Byte verification: the routed rows' texts, fetched by their keys.
    ids = routed.select(F.col("id").alias("routed")).distinct()
    texts = docs.select(F.col(key).alias("id"), clean.alias("clean")).join(ids, F.col("id").eqNullSafe(F.col("routed")), "left_semi")
    classes = texts.groupBy(F.xxhash64("clean").alias("fp"), F.sha2("clean", 256).alias("sha"), "clean").agg(F.lit(1).alias("one"))
    verified = classes.groupBy("fp", "sha").agg(F.sum("one").alias("texts"))
    groups = routed.groupBy("fp", "sha").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count("*").alias("size")
    )
    one_text = F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share one digest")))
    groups = groups.join(verified, ["fp", "sha"]).select("fp", "sha", "first", one_text.alias("size"))
    # Written, so that the join's sides are both dealt out alone and hot groups can be split.
    groups = written(groups, "exact-classes")
    return prints.join(groups, ["fp", "sha"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep; all columns stay.

    Of rows alike in key and text one stays, whatever their other columns: the one whose
    columns hash to the smallest number, so that a repeated task keeps the same.
    """
    found = written(exact_groups(docs, key, text), "exact-groups")
    gone = found.where(~F.col("kept"))
    again = gone.where(F.col(key).eqNullSafe(F.col("keep_id")))
    own, digest, row = free_names(docs.columns, "_id", "_sha", "_row")
    dropped = gone.where(~F.col(key).eqNullSafe(F.col("keep_id"))).select(F.col(key).alias(own), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(normalised(text), 256)
    same = (sha == F.col(digest)) & F.col(key).eqNullSafe(F.col(own))
    rest = small_join(docs, dropped, same, 96 * dropped.count(), "left_anti")
    if again.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = F.min_by(F.struct(*columns), F.struct(F.xxhash64(*columns), F.hash(*columns)))
    rows = rest.withColumn(digest, sha).groupBy(F.col(key).alias(own), digest).agg(first.alias(row))
    return rows.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
