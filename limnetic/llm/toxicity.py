"""Toxicity by a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import BROADCAST_BYTES, arrow_batches, hashed, whole
from limnetic.operators.ordered import prefix_sums
from limnetic.session import shared_path, written

# The driver fits up to so many labelled rows of each class, and bytes of text, by itself;
# beyond, tasks fit all rows.
DRIVER_POSITIVE, DRIVER_NEGATIVE, DRIVER_BYTES = 2500, 5000, 64 << 20
# Where tasks fit, hashes are taken by this, which bounds the model.
BUCKETS = 1 << 18
# Bytes of a broadcast row of a labelled key.
LABEL_BYTES = 32
DIMENSIONS = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
EPOCHS = 4
BATCH = 32
RATE = 0.05
# A hash has an embedding once it is in so many documents of the sample.
LEAST_DOCUMENTS = 3
# A language has a threshold of its own once the calibration rows hold so many of each class.
LEAST_CALIBRATION = 8
CLEAN_SHARE = 0.75
# Bytes of a word's beginning that are hashed besides the whole word.
PREFIXES = (4, 5, 6)
# One worker remembers the hashes of so many words.
REMEMBERED = 200_000

# Lower case, and a space for every other ASCII character that is no letter or digit.
FOLDED = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def codes_of(word: bytes) -> tuple[int, ...]:
    """Hashes of the whole word and of its beginnings, each kind with a seed of its own."""
    return (zlib.crc32(word, 1), *(zlib.crc32(word[:n], n) if len(word) >= n else 0 for n in PREFIXES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Numbered(dict):
    """Words in order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


@dataclass
class ToxicityModel:
    codes: np.ndarray  # hashes that have an embedding, in order
    embedding: np.ndarray  # (1 + codes, dimensions); row 0 is of the others, and zero
    kernels: list[np.ndarray]  # of each width: (width, dimensions, filters)
    biases: list[np.ndarray]
    output: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    language_weight: np.ndarray | None = None  # (1 + codes, languages)
    thresholds: np.ndarray | None = None
    buckets: int = 1 << 32  # hashes are taken by this
    remembered: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"remembered": {}}

    def places(self, found: np.ndarray) -> np.ndarray:
        """Embedding rows of hashes."""
        if not len(self.codes):
            return np.zeros_like(found)
        at = np.searchsorted(self.codes, found)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == found, at + 1, 0)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        """Embedding rows of the hashes of each word."""
        known = self.remembered
        if len(known) > REMEMBERED:
            known.clear()
        missing = [w for w in words if w not in known]
        if missing:
            rows = self.places(np.array([codes_of(w) for w in missing], np.int64) % self.buckets)
            known.update(zip(missing, map(tuple, rows.tolist())))
        return np.array([known[w] for w in words], np.int64).reshape(len(words), 1 + len(PREFIXES))

    def placed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts, each closed by empty words; where texts start; rows of each word number."""
        number, gap = Numbered({b"": 0}), max(WIDTHS)
        ids: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(ids))
            ids.extend(map(number.__getitem__, words_of(t)))
            ids.extend([0] * gap)
        return np.array(ids, np.int64), np.array(starts, np.int64), self.rows_of(list(number))

    def responses(self, vectors: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each width, the filters' responses at every position; a text's windows reach into its empty words."""
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            n = len(ids) - width + 1
            sums = (vectors @ kernel[0])[ids[:n]]
            for j in range(1, width):
                sums += (vectors @ kernel[j])[ids[j : j + n]]
            yield width, sums + bias

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language number of each text."""
        return self.judged(*self.placed(texts))

    def judged(self, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``logits`` of what ``placed`` returns."""
        vectors = self.embedding[rows].sum(1)
        stops = np.r_[starts[1:], len(ids)]
        pooled = []
        for width, r in self.responses(vectors, ids):
            # From each start to the last window inside the text; what lies between belongs to none.
            cuts = np.column_stack([starts, stops - width + 1]).ravel()[:-1]
            pooled.append(np.maximum.reduceat(r, cuts)[::2])
        logit = np.maximum(np.hstack(pooled), 0) @ self.output + self.offset
        if not self.languages:
            return logit, np.zeros(len(starts), np.int64)
        weight = self.language_weight[rows[:, 0]]
        return logit, np.add.reduceat(weight[ids], starts).argmax(1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit, language = self.logits(texts)
        return sigmoid(logit - self.thresholds[language])


def fit_model(texts: list[bytes], labels: np.ndarray, langs: list[str], seed: int = 7) -> ToxicityModel:
    """Train by Adagrad on the logistic loss; every fourth row calibrates the thresholds."""
    random = np.random.default_rng(seed)
    number = Numbered({b"": 0})
    ids = [np.fromiter(map(number.__getitem__, words_of(t)), np.int64) for t in texts]
    found = np.array([codes_of(w) for w in number], np.int64)
    calibration = np.arange(len(texts)) % 4 == 3
    train = np.flatnonzero(~calibration)
    codes, odds = _odds(found, [ids[i] for i in train], labels[train])
    at = np.minimum(np.searchsorted(codes, found), max(0, len(codes) - 1))
    rows = np.where(codes[at] == found, at + 1, 0) if len(codes) else np.zeros_like(found)
    model = _started(codes, odds, random)
    _train(model, rows, [ids[i] for i in train], labels[train], random)
    _fit_languages(model, rows[:, 0], [ids[i] for i in train], [langs[i] for i in train])
    held = np.flatnonzero(calibration)
    _calibrate(model, [texts[i] for i in held], labels[held])
    return model


def _odds(found: np.ndarray, ids: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in enough documents, and the log-odds of the label there, shrunk by their count."""
    pairs = [np.unique(found[np.unique(x)]) for x in ids]
    label = np.repeat(labels, [len(x) for x in pairs])
    every = np.concatenate([*pairs, np.zeros(0, np.int64)])
    codes, place = np.unique(every, return_inverse=True)
    n = np.bincount(place, minlength=len(codes))
    ones = np.bincount(place, label, len(codes))
    return _kept(codes, n, ones, labels.sum(), len(labels) - labels.sum())


def _kept(codes: np.ndarray, n: np.ndarray, ones: np.ndarray, positive: float, negative: float) -> tuple[np.ndarray, np.ndarray]:
    """``_odds`` of hashes in ``n`` documents, of which ``ones`` have the label."""
    odds = np.log((ones + 0.5) / (positive + 1)) - np.log((n - ones + 0.5) / (negative + 1))
    kept = (n >= LEAST_DOCUMENTS) & (codes != 0)
    return codes[kept], (np.clip(odds, -1, 8) / 8 * n / (n + 5))[kept]


def _started(codes: np.ndarray, odds: np.ndarray, random: np.random.Generator) -> ToxicityModel:
    """Random weights, but the first coordinate of an embedding starts at its hash's log-odds."""
    scale = 1 / np.sqrt(DIMENSIONS)
    embedding = random.normal(0, 0.1 * scale, (len(codes) + 1, DIMENSIONS)).astype(np.float32)
    embedding[1:, 0], embedding[0] = odds, 0
    kernels = [random.normal(0, 0.3 * scale, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, : FILTERS // 2] += 1.0
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    output = np.tile(np.r_[np.full(FILTERS // 2, 0.3), np.zeros(FILTERS - FILTERS // 2)], len(WIDTHS)).astype(np.float32)
    return ToxicityModel(codes, embedding, kernels, biases, output, -1.0)


def _train(model: ToxicityModel, rows: np.ndarray, ids: list[np.ndarray], labels: np.ndarray, random: np.random.Generator) -> None:
    descent = Descent(model, labels.mean())
    order = np.arange(len(ids))
    for _ in range(EPOCHS):
        random.shuffle(order)
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            descent.step(rows, [ids[i] for i in chosen], labels[chosen])


class Descent:
    """A model in training, with the sums of squared gradients that Adagrad divides by."""

    def __init__(self, model: ToxicityModel, share: float):
        self.model, self.share = model, share  # share of label 1
        self.squares = [np.full_like(x, 1e-3) for x in (*model.kernels, *model.biases, model.output)]
        self.embedding_squares, self.offset_square = np.full(len(model.embedding), 1e-3, np.float32), 1e-3

    def step(self, rows: np.ndarray, ids: list[np.ndarray], labels: np.ndarray) -> None:
        """One step on texts given as word numbers; ``rows`` has the embedding rows of each word."""
        model, gap = self.model, np.zeros(max(WIDTHS), np.int64)
        weight = np.where(labels == 1, 1 - self.share, self.share) * 2
        parts = [np.r_[x, gap] for x in ids]
        used, place = np.unique(np.concatenate(parts), return_inverse=True)
        stops = np.cumsum([len(x) for x in parts])
        starts = np.r_[0, stops[:-1]]
        vectors = model.embedding[rows[used]].sum(1)
        picked, pooled = [], []
        for width, r in model.responses(vectors, place):
            peaks = np.array([a + r[a : b - width + 1].argmax(0) for a, b in zip(starts, stops)])
            picked.append(peaks)
            pooled.append(np.take_along_axis(r, peaks, 0))
        hidden = np.maximum(np.hstack(pooled), 0)
        error = (sigmoid(hidden @ model.output + model.offset) - labels) * weight / len(labels)
        back = (error[:, None] * model.output) * (hidden > 0)
        word_grads = np.zeros_like(vectors)
        grads: list[np.ndarray] = []
        for k, (width, peaks) in enumerate(zip(WIDTHS, picked)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(model.kernels[k])
            for j in range(width):
                words = place[np.minimum(peaks + j, len(place) - 1)]
                grad[j] = np.einsum("bfd,bf->df", vectors[words], g)
                np.add.at(word_grads, words.ravel(), (g[:, :, None] * model.kernels[k][j].T[None]).reshape(-1, DIMENSIONS))
            grads.append(grad)
        grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [error @ hidden]
        for x, g, s in zip((*model.kernels, *model.biases, model.output), grads, self.squares):
            s += g * g
            x -= (RATE * g / np.sqrt(s)).astype(np.float32)
        self.offset_square += float(error.sum()) ** 2
        model.offset -= RATE * float(error.sum()) / np.sqrt(self.offset_square)
        touched = np.flatnonzero(np.abs(word_grads).sum(1))
        target = rows[used[touched]].ravel()
        step = np.repeat(word_grads[touched], rows.shape[1], 0)
        np.add.at(self.embedding_squares, target, (step * step).mean(1))
        np.add.at(model.embedding, target, -RATE * step / np.sqrt(self.embedding_squares[target])[:, None])
        model.embedding[0] = 0

    def dense(self) -> np.ndarray:
        """All numbers but the embedding's, in rows as wide as an embedding and its square."""
        model = self.model
        flat = np.concatenate([x.ravel() for x in (*model.kernels, *model.biases, model.output, *self.squares)])
        flat = np.r_[flat.astype(np.float64), model.offset, self.offset_square]
        return np.r_[flat, np.zeros(-len(flat) % (DIMENSIONS + 1))].reshape(-1, DIMENSIONS + 1)

    def change(self, since: Descent, size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of changed rows and their changes, in parts; those of ``dense`` count down from -1."""
        for start in range(0, len(self.embedding_squares), size):
            part = slice(start, start + size)
            embedding = self.model.embedding[part] - since.model.embedding[part]
            by = np.column_stack([embedding, self.embedding_squares[part] - since.embedding_squares[part]])
            there = np.flatnonzero(by.any(1))
            yield start + there, by[there].astype(np.float64)
        dense = self.dense() - since.dense()
        yield -1 - np.arange(len(dense)), dense

    def changed(self, at: np.ndarray, by: np.ndarray) -> None:
        """Apply a part of what ``change`` yields."""
        model, own = self.model, at >= 0
        model.embedding[at[own]] += by[own, :DIMENSIONS].astype(np.float32)
        self.embedding_squares[at[own]] += by[own, DIMENSIONS].astype(np.float32)
        dense = self.dense()
        dense[-1 - at[~own]] += by[~own]
        flat, start = dense.ravel(), 0
        for x in (*model.kernels, *model.biases, model.output, *self.squares):
            x[...] = flat[start : start + x.size].reshape(x.shape)
            start += x.size
        model.offset, self.offset_square = float(flat[start]), float(flat[start + 1])


def _fit_languages(model: ToxicityModel, rows: np.ndarray, ids: list[np.ndarray], langs: list[str]) -> None:
    """Naive Bayes over hashed words, by which a text itself tells whose threshold holds."""
    model.languages = sorted(set(langs))
    counts = np.zeros((len(model.codes) + 1, len(model.languages)))
    for i, lang in enumerate(model.languages):
        own = [x for x, y in zip(ids, langs) if y == lang]
        counts[:, i] = np.bincount(rows[np.concatenate(own)], minlength=len(counts))
    _weigh_languages(model, counts)


def _weigh_languages(model: ToxicityModel, counts: np.ndarray) -> None:
    share = (counts + 0.1) / (counts + 0.1).sum(0)
    share[0] = 1.0
    model.language_weight = np.log(share).astype(np.float32)
    model.thresholds = np.zeros(max(1, len(model.languages)))


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Inside the gap between neighbouring logits where the F1 of the rows is largest.

    It leaves ``CLEAN_SHARE`` of the gap to the clean side: the texts to score have many
    more clean ones, with longer tails, than the calibration rows.
    """
    order = np.argsort(-logits, kind="stable")
    found = np.cumsum(labels[order])
    f1 = 2 * found / (np.arange(1, len(order) + 1) + labels.sum())
    best = int(f1.argmax())
    below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
    return float(below + (logits[order[best]] - below) * CLEAN_SHARE)


# One block of texts: the hashes of its words (4 a word, the first word empty), the word
# numbers of its texts one after the other, and of each text the words, label and language.
BLOCK = "held boolean, words binary, ids binary, lengths array<int>, labels array<int>, langs array<string>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _held, _text, _label and _lang as blocks, apart by _held."""
    for batch in arrow_batches(batches, 1 << 20):
        frame = batch.to_pandas()
        for held, own in frame.groupby("_held"):
            number = Numbered({b"": 0})
            ids: list[int] = []
            ends = []
            for t in own["_text"]:
                ids.extend(map(number.__getitem__, words_of(t)))
                ends.append(len(ids))
            words = np.array([codes_of(w) for w in number], np.int64) % BUCKETS
            yield pa.RecordBatch.from_pydict({
                "held": [bool(held)], "words": [words.astype("<i4").tobytes()],
                "ids": [np.array(ids, "<u2" if len(number) <= 1 << 16 else "<u4").tobytes()],
                "lengths": pa.array([np.diff(ends, prepend=0)], pa.list_(pa.int32())),
                "labels": pa.array([own["_label"].tolist()], pa.list_(pa.int32())), "langs": [own["_lang"].tolist()],
            })


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    for batch in batches:
        for r in batch.to_pylist():
            lengths = np.array(r["lengths"], np.int64)
            words = np.frombuffer(r["words"], "<i4").reshape(-1, 1 + len(PREFIXES)).astype(np.int64)
            ids = np.frombuffer(r["ids"], "<u2" if len(words) <= 1 << 16 else "<u4").astype(np.int64)
            yield r["held"], words, ids, lengths, np.array(r["labels"], np.int64), r["langs"]


# Stands in for a hash in the row of a language's documents.
DOCUMENTS = -1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, documents by language; of those not held, documents of each hash and words of each language."""

    def rows(held: bool, lang: str | None, code: np.ndarray, n: np.ndarray, ones: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([held] * len(code), pa.bool_()), pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ones.astype(np.int64))], ["held", "lang", "code", "n", "ones"])

    for held, words, ids, lengths, labels, langs in _read(batches):
        text = np.repeat(np.arange(len(lengths)), lengths)
        for lang in sorted(set(langs)):
            own = np.array([x == lang for x in langs])
            yield rows(held, lang, np.array([DOCUMENTS]), np.array([own.sum()]), labels[own].sum(keepdims=True))
            if not held:
                n = np.bincount(words[ids[own[text]], 0], minlength=1)
                code = np.flatnonzero(n)
                yield rows(held, lang, code, n[code], np.zeros(len(code)))
        if not held:
            pairs = np.unique(text * len(words) + ids)
            pairs = np.unique((pairs // len(words))[:, None] * BUCKETS + words[pairs % len(words)])
            n, ones = np.bincount(pairs % BUCKETS), np.bincount(pairs % BUCKETS, labels[pairs // BUCKETS])
            code = np.flatnonzero(n)
            yield rows(held, None, code, n[code], ones[code])


def _fit_in_tasks(rows: DataFrame, seed: int = 7) -> ToxicityModel | None:
    """``fit_model`` on all of ``rows``, which stay in tasks; a hash of the key picks every fourth row.

    The texts are written once as word numbers. In each epoch as many tasks as there are
    cores each train the same weights on their rows, and the changes are averaged by rows.
    What the driver holds is bounded by the buckets and languages.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_held", hashed("calibration", F.col("_key")) % 4 == 3)
    path = shared_path(spark, "toxicity")
    blocks = rows.select("_held", F.col("_text").cast("binary").alias("_text"), "_label", "_lang").mapInArrow(_blocks, BLOCK)
    blocks.write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    counted = blocks.mapInArrow(_count, "held boolean, lang string, code long, n long, ones long")
    counted = written(counted.groupBy("held", "lang", "code").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")), "toxicity-counts")
    documents = counted.where(F.col("code") == DOCUMENTS)
    total, positive = documents.where("not held").agg(F.sum("n"), F.sum("ones")).first()
    if not total:
        return None
    # Languages with a threshold of their own; the others are one class, at the end.
    enough = documents.where("held").where(F.least("ones", F.col("n") - F.col("ones")) >= LEAST_CALIBRATION)
    languages = sorted(r["lang"] for r in enough.select("lang").collect())
    # 0 is no hash, 1 that of the empty word.
    hashes = counted.where(F.col("lang").isNull() & (F.col("code") > 1) & (F.col("n") >= LEAST_DOCUMENTS)).select("code", "n", "ones").orderBy("code").toPandas()
    codes, odds = _kept(*(hashes[c].to_numpy(np.int64) for c in ("code", "n", "ones")), positive, total - positive)
    model = _started(codes, odds, np.random.default_rng(seed))
    model.buckets = BUCKETS
    del hashes
    _train_in_tasks(blocks.where("not held"), model, total, positive / total, seed)
    model.languages = [*languages, "other"]
    named = F.when(F.col("lang").isin(languages), F.col("lang")).alias("lang")
    words = counted.where(F.col("lang").isNotNull() & ~F.col("held") & (F.col("code") != DOCUMENTS))
    counts = np.zeros((len(codes) + 1, len(languages) + 1))
    number = {x: i for i, x in enumerate(languages)}
    for batch in words.groupBy(named, "code").agg(F.sum("n").alias("n")).toArrow().to_batches():
        frame = batch.to_pandas()
        language = frame["lang"].map(number).fillna(len(languages)).to_numpy(np.int64)
        np.add.at(counts, (model.places(frame["code"].to_numpy(np.int64)), language), frame["n"].to_numpy())
    _weigh_languages(model, counts)
    _calibrate_in_tasks(blocks.where("held"), model)
    return model


def _train_in_tasks(blocks: DataFrame, model: ToxicityModel, total: int, share: float, seed: int) -> None:
    context = blocks.sparkSession.sparkContext
    columns = [f"v{i}" for i in range(DIMENSIONS + 1)]
    descent = Descent(model, share)
    for epoch in range(EPOCHS):
        shared = context.broadcast(descent)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            own, seen = copy.deepcopy(shared.value), 0
            for i, (_, words, ids, lengths, labels, _) in enumerate(_read(batches)):
                random = np.random.default_rng([seed, epoch, i])
                rows, texts = own.model.places(words), np.split(ids, np.cumsum(lengths)[:-1])
                order = random.permutation(len(texts))
                for at in range(0, len(order), BATCH):
                    chosen = order[at : at + BATCH]
                    own.step(rows, [texts[j] for j in chosen], labels[chosen])
                seen += len(texts)
            if seen:
                for at, by in own.change(shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, (by * (seen / total)).T)], ["at", *columns])

        changes = blocks.coalesce(context.defaultParallelism).mapInArrow(run, ", ".join(["at long", *(f"{c} double" for c in columns)]))
        summed = changes.groupBy("at").agg(*[F.sum(c).cast("float").alias(c) for c in columns])
        for batch in summed.toArrow().to_batches():
            descent.changed(batch["at"].to_numpy(), np.column_stack([batch[c].to_numpy() for c in columns]))
        shared.destroy()


def _calibrate_in_tasks(blocks: DataFrame, model: ToxicityModel) -> None:
    """``_calibrate`` by running sums over the logits, in order, of each language and of all."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    gap = max(WIDTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, ids, lengths, labels, _ in _read(batches):
            starts = np.r_[0, np.cumsum(lengths + gap)[:-1]]
            closed = np.zeros(len(ids) + gap * len(lengths), np.int64)
            closed[np.arange(len(ids)) + gap * np.repeat(np.arange(len(lengths)), lengths)] = ids
            logit, language = shared.value.judged(closed, starts, shared.value.places(words))
            yield pa.RecordBatch.from_pydict({"language": language, "down": -logit.astype(np.float64), "one": labels})

    judged = blocks.mapInArrow(run, "language long, down double, one long")
    cells = judged.groupBy("language", "down").agg(F.count(F.lit(1)).alias("n"), F.sum("one").alias("ones"))
    cells = written(cells, "toxicity-logits")
    every = cells.groupBy(F.lit(-1).cast("long").alias("language"), "down").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    cells = cells.unionByName(every)
    f1 = 2 * F.col("cum_ones") / (F.col("cum_n") + F.col("total_ones"))
    first = F.max(F.struct(f1.alias("f1"), (-F.col("down")).alias("logit")))["logit"].alias("best")
    summed = prefix_sums(cells, ["language"], "down", ["n", "ones"]).where("total_ones > 0").groupBy("language")
    best = summed.agg(first, F.max("total_ones").alias("positive"), F.max(F.col("total_n") - F.col("total_ones")).alias("negative"))
    below = F.max(F.when(-F.col("down") < F.col("best"), -F.col("down"))).alias("below")
    thresholds = {}
    for r in cells.join(F.broadcast(best), "language").groupBy(*best.columns).agg(below).collect():
        low = r["best"] - 1 if r["below"] is None else r["below"]
        if r["language"] < 0 or min(r["positive"], r["negative"]) >= LEAST_CALIBRATION:
            thresholds[r["language"]] = low + (r["best"] - low) * CLEAN_SHARE
    for i in range(len(model.languages)):
        model.thresholds[i] = thresholds.get(i, thresholds.get(-1, 0.0))
    shared.destroy()


def _calibrate(model: ToxicityModel, texts: list[bytes], labels: np.ndarray) -> None:
    if not len(texts) or not labels.any():
        return
    parts = [model.logits(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    logits, language = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    model.thresholds[:] = _threshold(logits, labels)
    for i in range(len(model.languages)):
        own = language == i
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_CALIBRATION:
            model.thresholds[i] = _threshold(logits[own], labels[own])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
    positive: int = DRIVER_POSITIVE, negative: int = DRIVER_NEGATIVE,
) -> ToxicityModel | None:
    """A model of all labelled rows where ``training``, a condition on the key, holds.

    The driver fits by itself up to ``positive`` and ``negative`` rows of the two classes
    in ``DRIVER_BYTES`` of text; more rows are fitted in tasks. A key labelled twice counts
    as its larger label, and of a key's texts one is read. None if a class is missing.
    """
    narrow = labels.where(training & F.col(label).isNotNull() & F.col(key).isNotNull())
    narrow = narrow.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    sizes = {r[0]: r[1] for r in narrow.groupBy("_label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    rows = _labelled(docs, narrow, sum(sizes.values()), training, key, text, lang)
    if sizes[1] > positive or sizes[0] > negative or (rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) > DRIVER_BYTES:
        return _fit_in_tasks(rows)
    rows = rows.select("_key", "_label", "_text", "_lang").toPandas()
    rows = rows.sort_values(["_key", "_text"], kind="stable").reset_index(drop=True)
    # By class, so that every fourth row of each class calibrates.
    rows = rows.sort_values("_label", kind="stable")
    if rows["_label"].nunique() < 2:
        return None
    return fit_model([t.encode() for t in rows["_text"]], rows["_label"].to_numpy(np.int64), list(rows["_lang"]))


def _labelled(docs: DataFrame, narrow: DataFrame, size: int, training: Column, key: str, text: str, lang: str) -> DataFrame:
    """_key, _label, _text and _lang of each key of ``narrow`` that ``docs`` has.

    Only the rows of repeated keys are moved to choose one of them.
    """
    docs = docs.where(training)
    times = docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_times"))
    keys = narrow.join(times, "_key")
    rows = docs.select(F.col(key).alias("_key"), whole(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"))

    def joined(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if size * LABEL_BYTES <= BROADCAST_BYTES else some, "_key")

    columns = ["_key", "_label", "_text", "_lang"]
    # One row a key, however often it is repeated: the one with the smallest hash of its text.
    first = F.min(F.struct(F.xxhash64("_text"), "_text", "_lang")).alias("_row")
    repeated = joined(keys.where("_times > 1")).groupBy("_key", "_label").agg(first).select("_key", "_label", "_row._text", "_row._lang")
    return joined(keys.where("_times = 1")).select(columns).unionByName(repeated)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into``: 0 to 1, over 0.5 where the logit is above its language's threshold.

    The language is read off the text, so only the text enters a score. Every whole text
    is scored by the largest response of each filter over all its windows.

    Defined results: a missing or empty text is scored as one of no words; without a model
    every score is 0; repeated rows score alike; an empty table gives an empty one; an
    input column named ``into`` is replaced.
    """
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for batch in arrow_batches([pa.RecordBatch.from_arrays([texts], ["t"])], 1 << 20):
            out.append(shared.value.scores(batch["t"].to_pylist()))
        return pa.array(np.concatenate(out), pa.float64())

    return docs.withColumn(into, scored(whole(text).cast("binary")))


def held_out_report(scores: pd.DataFrame) -> dict[str, float]:
    """Accuracy, precision and recall of the columns predicted and label."""
    hit = ((scores["predicted"] == 1) & (scores["label"] == 1)).sum()
    return {
        "accuracy": float((scores["predicted"] == scores["label"]).mean()),
        "precision": float(hit / max(1, (scores["predicted"] == 1).sum())),
        "recall": float(hit / max(1, (scores["label"] == 1).sum())),
    }
