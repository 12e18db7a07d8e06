"""Near duplicates by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnetic.llm.common import arrow_batches, small_join, whole
from limnetic.session import written

# A pair at the least similarity is missed by all bands with at most this chance.
MISS = 1e-6
# Signatures have at most so many coordinates; the rows of a band are as many as that allows.
COORDINATES = 192
# The bands that are looked at first, to unite most of each family of near copies.
FIRST_BANDS = 4
# Set elements that one block of a group holds; larger groups are cut into blocks.
BLOCK_ELEMENTS = 1 << 21
# Values hashed together, so that they stay in a core's cache.
BLOCK = 1 << 14


def banding(least: float) -> tuple[int, int]:
    """Bands, and rows of a band, that miss a pair of similarity ``least`` with a chance of ``MISS``."""
    bands = lambda rows: math.ceil(math.log(MISS) / math.log1p(-(least**rows)))
    rows = max((r for r in range(1, 9) if r * bands(r) <= COORDINATES), default=1)
    return bands(rows), rows


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, ASCII letters in lower case.

    A text of fewer words is one shingle, one without words has none.
    """
    found = list(map(xxhash.xxh3_64_intdigest, text.lower().split()))
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.array(found, np.uint64)
    size = min(words, len(found))
    runs = np.full(len(found) - size + 1, size, np.uint64)
    for j in range(size):
        runs = mixed64(runs + hashes[j : j + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(runs)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """The signature of each non-empty set: (sets, coordinates).

    A first permutation scatters the hashes over a circle of 2^32 places. Coordinate k is
    the least value that a second permutation has over the places turned by k.
    """
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):
        stop, size = at, 0
        while stop < len(sets) and (stop == at or size + len(sets[stop]) <= BLOCK):
            size += len(sets[stop])
            stop += 1
        starts = np.cumsum([0] + [len(x) for x in sets[at : stop - 1]])
        places = (mixed64(np.concatenate(sets[at:stop])) >> np.uint64(32)).astype(np.uint32)
        value, shifted = np.empty_like(places), np.empty_like(places)
        for k in range(coordinates):
            np.subtract(places, np.uint32(k), out=value)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(value, np.uint32(shift), out=shifted)
                np.bitwise_xor(value, shifted, out=value)
                np.multiply(value, np.uint32(factor), out=value)
            np.right_shift(value, np.uint32(16), out=shifted)
            np.bitwise_xor(value, shifted, out=value)
            out[at:stop, k] = np.minimum.reduceat(value, starts)
        at = stop
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, its number included: (sets, bands)."""
    values = signatures(sets, bands * rows).reshape(len(sets), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), values.shape[:2])
    for j in range(rows):
        key = mixed64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, j])
    return key


def _listed(keys: np.ndarray) -> pa.Array:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """key, n, the digest of the set as two numbers, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            sets = [shingles(t, words) for t in batch["text"].to_pylist()]
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            keys = np.zeros((len(sets), bands), np.uint64)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                keys[full] = band_keys([sets[i] for i in full], bands, rows)
            yield pa.RecordBatch.from_pydict({
                "key": batch["key"], "n": pa.array([len(s) for s in sets], pa.int64()), "set_a": digests[:, 0].copy(), "set_b": digests[:, 1].copy(),
                "bands": _listed(keys),
            })

    return docs.mapInArrow(run, "key long, n long, set_a long, set_b long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, set: the full sets of the wanted documents."""
    size = 16 * wanted.count()
    texts = small_join(docs, wanted, F.col("key") == F.col("rep"), size, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            sets = [shingles(t, words).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"rep": batch["key"], "set": pa.array(sets, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "rep long, set array<long>")


def united(labels: np.ndarray, sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """(label, smallest label) of the labels that links between the full sets unite.

    From one label's members the search goes on to all that any of them is linked with;
    only sets that are not yet reached are compared, and all sets of a label are reached
    together.
    """
    part, whole_ = least
    sizes = np.array([len(x) for x in sets])
    _, elements = np.unique(np.concatenate(sets), return_inverse=True)
    stops = np.cumsum(sizes)
    own = [elements[b - n : b] for b, n in zip(stops, sizes)]
    marked = np.zeros(int(elements.max()) + 1, bool)
    by_label: dict[int, list[int]] = {}
    for i, label in enumerate(labels.tolist()):
        by_label.setdefault(label, []).append(i)
    left, out = dict(by_label), []
    for seed in sorted(by_label):
        if seed not in left:
            continue
        reached, frontier = [seed], list(left.pop(seed))
        rest = None
        while frontier and left:
            if rest is None:
                rest = np.array([i for members in left.values() for i in members])
                packed = np.concatenate([own[i] for i in rest])
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            x = frontier.pop()
            marked[own[x]] = True
            both = np.add.reduceat(marked[packed], starts, dtype=np.int64)
            marked[own[x]] = False
            linked = rest[whole_ * both >= part * (sizes[x] + sizes[rest] - both)]
            for label in sorted({int(labels[i]) for i in linked}):
                reached.append(label)
                frontier.extend(left.pop(label))
                rest = None
        out += [(label, min(reached)) for label in reached if label != min(reached)]
    return out


def _united(rows: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """a, b: labels that links inside a group unite, the sets of a group compared in one task.

    A group of many elements is cut into blocks by a hash, and each pair of blocks is a
    task of its own, so that every two members still meet.
    """
    blocks = rows.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("own")
    dealt = rows.join(blocks, "group").select("group", "rep", "label", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    place = ("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    ready = dealt.join(sets, "rep").select(*place, "label", "set")
    ready = ready.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, labels, found = None, [], []

        def edges() -> list[tuple[int, int]]:
            return united(np.array(labels), found, least) if len(set(labels)) > 1 else []

        for batch in arrow_batches(batches):
            out = []
            for *key, label, values in zip(*(batch[c].to_pylist() for c in ("group", "i", "j", "label")), batch["set"]):
                if key != task:
                    out += edges()
                    task, labels, found = key, [], []
                labels.append(label)
                found.append(values.values.to_numpy())
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
        out = edges()
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return ready.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges (a, b) reach, by propagation and pointer jumping."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "component-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "component-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        lower = written(lower, "component-lower")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("jumped"))
        after = written(lower.join(jump, F.col("label") == F.col("at")).select("node", F.col("jumped").alias("label"), "old"), "component-labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


def _relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Labels after more edges, of all nodes that any edge has met."""
    edges = written(edges.select("a", "b").distinct(), "near-united")
    if labels is not None:
        ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        ends = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        edges = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    edges = written(edges.select("a", "b"), "near-edges")
    if edges.isEmpty():
        return labels
    fresh = components(edges)
    if labels is None:
        return fresh
    moved = labels.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    return written(moved.union(fresh.join(labels, "node", "left_anti")), "near-labels")


def _linked_components(members: DataFrame, docs: DataFrame, words: int, least: tuple[int, int], extra: DataFrame) -> DataFrame | None:
    """Labels of the members of buckets, so that no link inside a bucket is lost.

    The members of a bucket belong to the group of the smallest label among them, and are
    compared there on their full sets; a member stands once in a group, however many
    buckets it shares with it. The first bands unite most of each family, after which
    buckets in one component are left out and the others have few groups.
    """
    sets = written(_sets(docs, members.select("rep").distinct(), words), "near-sets")
    labels = _relabelled(None, extra)
    for rows in (members.where(F.col("band") < FIRST_BANDS), members):
        if labels is not None:
            rows = rows.join(labels, rows.rep == labels.node, "left").withColumn("label", F.coalesce("label", "rep"))
        else:
            rows = rows.withColumn("label", F.col("rep"))
        several = rows.groupBy("bucket").agg(F.min("label").alias("group"), F.max("label").alias("high")).where("group < high")
        groups = rows.join(several.select("bucket", "group"), "bucket").select("group", "rep", "label", "n").distinct()
        labels = _relabelled(labels, _united(written(groups, "near-groups"), sets, least))
    return labels


def _in_buckets(dealt: DataFrame) -> DataFrame:
    """The members of buckets that have more than one."""
    shared = dealt.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    return dealt.join(shared.select("bucket"), "bucket")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: tuple[int, int] = (80, 100)
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word
    shingles is ``least[0] / least[1]`` or more, which is confirmed on the full sets;
    ``component_id`` is the smallest key that links reach and ``kept`` marks its row.
    Equal sets are one class, compared once. The bands miss a pair at the least
    similarity with a chance of ``MISS``, more similar ones with less.

    Defined results: a missing text or one without words has no shingle and no link; a
    text of fewer words is one shingle; rows without a key are linked with nothing, have
    no component and are kept; rows of one integer key are one document and share a
    component; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    bands, rows = banding(least[0] / least[1])
    narrow = docs.select(F.col(key).cast("long").alias("key"), whole(text).cast("binary").alias("text"))
    signed = written(_signed(narrow, words, bands, rows), "near-signed")
    keyed = signed.where(F.col("key").isNotNull() & (F.col("n") > 0))
    classes = written(keyed.groupBy("set_a", "set_b", "n", "bands").agg(F.min("key").alias("rep")), "near-classes")
    reps = signed.drop("bands").join(classes.select("set_a", "set_b", F.col("n").alias("n_"), "rep"), ["set_a", "set_b"], "left")
    reps = written(reps.select("key", "n", F.when(F.col("key").isNotNull(), F.coalesce("rep", "key")).alias("rep")), "near-reps")
    twice = reps.where("key is not null").groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    extra = reps.join(twice, "key").select(F.col("rep").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    members = written(_in_buckets(classes.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))), "near-members")
    labels = _linked_components(members, narrow, words, least, extra)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    found = reps.join(labels, reps.rep == labels.node, "left").withColumn("component", F.coalesce("label", "rep"))
    return found.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )
