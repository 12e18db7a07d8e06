"""Ranked lexical search: short lists summed into accumulators, long lists skipped through."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic.llm.common import arrow_batches, whole
from limnetic.session import written

# Text of the items that are searched for at once; their terms and weights are broadcast.
ITEM_BYTES = 4 << 20
# A segment of the index is closed once it holds so many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 15, 1 << 21
# Documents are visited in order, so many at a time; bounds are kept for each such window.
WINDOW = 1 << 11
# A list with postings for fewer than one in so many documents of its segment is short.
SHORT_SHARE = 64

# Bytes of a UTF-8 text to terms: ASCII letters in lower case, digits, and all beyond ASCII.
TERMS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


SEGMENT = T.StructType([
    T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("keys", T.BinaryType()),
    T.StructField("absent", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("terms", T.ArrayType(T.BinaryType())),
    T.StructField("df", T.ArrayType(T.LongType())), T.StructField("places", T.BinaryType()), T.StructField("tf", T.BinaryType()),
])


def _segment(n_docs: int, n_terms: int, docs: list[tuple[int | None, int]], lists: dict[bytes, tuple[list, list]]) -> pa.RecordBatch:
    """One row: documents in order of their keys, missing keys last, and a posting list for each term."""
    absent = np.array([k is None for k, _ in docs], np.uint8)
    keys, sizes = np.array([k or 0 for k, _ in docs], "<i8"), np.array([n for _, n in docs], "<i8")
    order = np.lexsort((keys, absent))
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs))
    places, tfs = [], []
    for at, tf in lists.values():
        at, tf = place[at], np.array(tf, "<i8")
        by = np.argsort(at)
        places.append(at[by].astype("<u4"))
        tfs.append(tf[by])
    df = [len(x) for x in places]
    joined = lambda parts, kind: np.concatenate(parts).tobytes() if parts else np.zeros(0, kind).tobytes()
    return pa.RecordBatch.from_pydict({
        "n_docs": [n_docs], "n_terms": [n_terms], "keys": [keys[order].tobytes()], "absent": [absent[order].tobytes()],
        "sizes": [sizes[order].tobytes()], "terms": pa.array([list(lists)], pa.list_(pa.binary())), "df": pa.array([df], pa.list_(pa.int64())),
        "places": [joined(places, "<u4")], "tf": [joined(tfs, "<i8")],
    })


def index_segments(docs: DataFrame, vocabulary: frozenset[bytes] | None, key: str, text: str) -> DataFrame:
    """Inverted lists of the terms of ``vocabulary`` (None: all) in segments, one row each.

    ``n_docs`` counts the documents with any term and ``n_terms`` their terms with repeats;
    documents without a listed term count there, but are not stored.
    """
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        n_docs = n_terms = postings = 0
        found: list[tuple[int | None, int]] = []
        lists: dict[bytes, tuple[list, list]] = {}
        for batch in arrow_batches(batches):
            for k, words in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                terms = terms_of(words)
                if not terms:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                counts = Counter(terms)
                listed = counts.keys() if wanted is None else counts.keys() & wanted
                for term in listed:
                    at, tf = lists.setdefault(term, ([], []))
                    at.append(len(found))
                    tf.append(counts[term])
                if listed:
                    found.append((k, len(terms)))
                    postings += len(listed)
                if len(found) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield _segment(n_docs, n_terms, found, lists)
                    n_docs = n_terms = postings = 0
                    found, lists = [], {}
        if n_docs:
            yield _segment(n_docs, n_terms, found, lists)

    rows = docs.select(F.col(key).cast("long").alias("key"), whole(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, SEGMENT)


def impacts(tf: np.ndarray, sizes: np.ndarray, weight: int, n: int, length: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 8 m)) with m = 25 + (75 size n) div length, in integers."""
    top = int(sizes.max(initial=0))
    if 75 * top * n < 1 << 63:
        m = 25 + 75 * sizes * n // length
    else:
        m = np.array([25 + 75 * int(s) * n // length for s in sizes], np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class PostingList:
    """Places in ascending order with what each adds to a score, and the most of any window."""

    def __init__(self, places: np.ndarray, adds: np.ndarray, docs: int):
        self.places, self.adds = places, adds
        windows = -(-docs // WINDOW)
        self.cuts = np.searchsorted(places, np.arange(windows + 1) * WINDOW)
        self.bounds = np.zeros(windows, np.int64)
        there = self.cuts[1:] > self.cuts[:-1]
        if there.any():
            self.bounds[there] = np.maximum.reduceat(adds, self.cuts[:-1][there])

    def slice(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.cuts[window], self.cuts[window + 1]
        return self.places[a:b] - window * WINDOW, self.adds[a:b]


class Best:
    """The k highest scores so far of one item, equal ones by key, a missing key last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.absent, self.keys = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        # A score below this is not among the k; equal scores may be, by their key.
        self.least = 1

    def put(self, scores: np.ndarray, absent: np.ndarray, keys: np.ndarray) -> None:
        scores, absent, keys = np.r_[self.scores, scores], np.r_[self.absent, absent], np.r_[self.keys, keys]
        order = np.lexsort((keys, absent, -scores))[: self.k]
        self.scores, self.absent, self.keys = scores[order], absent[order], keys[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def accumulated(lists: list[tuple[PostingList, int]], docs: int) -> PostingList | None:
    """Short lists, with how often their term is asked for, summed term at a time into one list."""
    if not lists:
        return None
    places = np.concatenate([x.places for x, _ in lists])
    adds = np.concatenate([x.adds * q for x, q in lists])
    order = np.argsort(places, kind="stable")
    places, adds = places[order], adds[order]
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, np.int64)
    return PostingList(places[first], np.add.reduceat(adds, first) if len(first) else adds, docs)


def search_segment(asked: list[tuple[PostingList, int]], docs: int, best: Best, absent: np.ndarray, keys: np.ndarray) -> None:
    """Bring the best documents of a segment into ``best``.

    The accumulators are one list with bounds like the long ones. Documents are visited in
    order: a window whose bounds do not sum to the least score wanted is skipped in all
    lists. Inside, lists are read from the highest bound down; once what is left cannot
    lift an unseen document, only documents that can still reach the least score go on.
    """
    short = [x for x in asked if len(x[0].places) * SHORT_SHARE < docs]
    lists = [x for x in asked if len(x[0].places) * SHORT_SHARE >= docs]
    if summed := accumulated(short, docs):
        lists.append((summed, 1))
    if not lists:
        return
    bounds = np.array([x.bounds * q for x, q in lists])
    total = bounds.sum(0)
    for window in np.flatnonzero(total):
        if total[window] < best.least:
            continue
        order = np.argsort(-bounds[:, window], kind="stable")
        rest, scores, alive = int(total[window]), np.zeros(WINDOW, np.int64), None
        for i in order:
            bound = int(bounds[i, window])
            if not bound:
                break
            if alive is None and rest < best.least:  # a document in none of the lists so far cannot be wanted
                alive = scores > 0
            if alive is not None:
                alive &= scores + rest >= best.least
                if not alive.any():
                    break
            places, adds = lists[i][0].slice(window)
            if alive is not None:
                go = alive[places]
                places, adds = places[go], adds[go]
            scores[places] += adds * lists[i][1]
            rest -= bound
        found = np.flatnonzero(scores >= best.least)
        if len(found):
            at = found + window * WINDOW
            best.put(scores[found], absent[at], keys[at])


def _search_block(docs: DataFrame, items: list[tuple[Row, bytes]], k: int, key: str, text: str) -> list[tuple]:
    """Segments of one block of items, with what the search in them needs on every executor."""
    asked = [(row, Counter(terms_of(words))) for row, words in items]
    vocabulary = frozenset().union(*(c.keys() for _, c in asked))
    segments = written(index_segments(docs, vocabulary, key, text), "segments")
    totals = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, length = totals[0] or 0, totals[1] or 0
    pairs = segments.select(F.explode(F.arrays_zip("terms", "df")).alias("x"))
    # At most one row for each term of the block.
    df = {bytes(r["term"]): r["df"] for r in pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = [[(t, q) for t, q in c.items() if weights.get(t, 0) > 0] for _, c in asked]
    return segments, docs.sparkSession.sparkContext.broadcast((queries, weights, n, length))


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item, rank, key and score of the ``k`` highest-scoring documents of each item, over all documents.

    Scores are those of the contract of ``op12_hybrid_search``. Items are taken in blocks of
    ``ITEM_BYTES`` of text, whose terms are broadcast; for each block the documents are
    turned into segments of inverted lists, which are written once. Each task keeps the best
    ``k`` of every item over its segments; only those are shuffled.

    Defined results: a missing or empty text, or one of marks only, has no terms: such a
    document is not counted, such an item has no rows. Rows that share a key are documents
    each and can both be ranked. Equal scores go by ascending key, a missing key last. Rows
    that repeat an item share the item's ranks, by key. Other columns are not read. An empty
    table on either side gives no rows.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    found_schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.LongType())])
    # An item that stands in several rows is searched for once per text.
    source = items.select(F.col(item).alias("item"), whole(item_text).cast("binary").alias("text")).distinct()

    def blocks() -> Iterator[list[tuple[Row, bytes]]]:
        block, size = [], 0
        for row in source.toLocalIterator():
            words = bytes(row["text"])
            if size + len(words) > ITEM_BYTES and block:
                yield block
                block, size = [], 0
            block.append((row["item"], words))
            size += len(words)
        if block:
            yield block

    def found_in(segments: DataFrame, shared, names: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries, weights, n, length = shared.value
            best = [Best(k) for _ in queries]
            for batch in batches:
                for row in batch.to_pylist():
                    keys, absent, sizes = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["absent"], "u1"), np.frombuffer(row["sizes"], "<i8")
                    places, tf = np.frombuffer(row["places"], "<u4").astype(np.int64), np.frombuffer(row["tf"], "<i8")
                    ends = np.cumsum([0, *row["df"]])
                    lists = {
                        t: PostingList(places[a:b], impacts(tf[a:b], sizes[places[a:b]], weights[t], n, length), len(keys))
                        for t, a, b in zip(row["terms"], ends, ends[1:]) if weights[t] > 0
                    }
                    for wanted, top in zip(queries, best):
                        asked = [(lists[t], q) for t, q in wanted if t in lists]
                        search_segment(asked, len(keys), top, absent, keys)
            columns = [(i, None if a else int(x), int(s)) for i, b in enumerate(best) for s, a, x in zip(b.scores, b.absent, b.keys)]
            yield pa.RecordBatch.from_pylist([dict(zip(found_schema.names, c)) for c in columns], schema=pa.schema(
                [("no", pa.int64()), ("key", pa.int64()), ("score", pa.int64())]
            ))

        return segments.mapInArrow(run, found_schema).join(F.broadcast(names), "no").select("item", "key", "score")

    parts = []
    for block in blocks():
        segments, shared = _search_block(docs, block, k, key, text)
        schema = T.StructType([T.StructField("no", T.LongType()), T.StructField("item", kind)])
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], schema)
        parts.append(found_in(segments, shared, names))
    if not parts:
        nothing = T.StructType([T.StructField("item", kind), *found_schema.fields[1:]])
        parts = [spark.createDataFrame([], nothing)]
    every = reduce(DataFrame.unionByName, parts)
    order = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
