"""Hybrid search against brute force on made rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from limnetic.llm import search

from test_llm_edges import SCHEMA, edge_rows, made

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField(n, k) for n, k in (("item_id", T.LongType()), ("text", T.StringType()), ("rank", T.StringType()), ("key", T.StringType()))])


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    """(item, rank, key, score) by scoring every document for every item."""
    counted = [(key, Counter(t), len(t)) for key, t in ((key, terms(text)) for key, text in docs) if t]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, size in counted:
            m = 25 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score:
                scores.append((-score, key is None, key))
        out += [(item, i, key, -s) for i, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture
def tiny_windows(monkeypatch):
    monkeypatch.setattr(search, "WINDOW", 8)
    monkeypatch.setattr(search, "SHORT_SHARE", 4)


def test_edge_rows(spark):
    docs = edge_rows()
    items = [(1, "One two, ONE!"), (2, None), (3, " ...; "), (4, made(2, 30)), (5, "not_there nothere"), (6, "İSTANBUL z 12345"), (6, "İSTANBUL z 12345"), (7, made(1, 400))]
    frame = spark.createDataFrame([(*i, "clash", "clash") for i in items], ITEMS)
    table = spark.createDataFrame(docs, SCHEMA).repartition(3)
    found = search.search(table, frame)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == brute([r[:2] for r in docs], dict(items).items(), 10)
    assert search.search(table.limit(0), frame).count() == 0
    assert search.search(table, frame.limit(0)).count() == 0


def test_blocks_of_items_and_small_segments(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i // 2, text(r.randint(0, 30))) for i in range(700)]
    docs[100:130] = [(1000 + i, docs[0][1] or "w1") for i in range(30)]  # ties
    items = [(i, text(12)) for i in range(25)]
    monkeypatch.setattr(search, "ITEM_BYTES", 200)
    monkeypatch.setattr(search, "SEGMENT_DOCS", 90)
    found = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert rows_of(found) == brute(docs, items, 7)


@pytest.mark.parametrize("seed", range(30))
def test_skipping_loses_nothing(tiny_windows, seed):
    """Segments searched one after the other find what adding up all lists finds."""
    r = np.random.default_rng(seed)
    best, expected = search.Best(5), []
    for segment in range(3):
        docs = int(r.integers(1, 120))
        lists = []
        for _ in range(r.integers(1, 9)):
            places = np.flatnonzero(r.random(docs) < r.choice([0.02, 0.2, 0.9]))
            lists.append((search.PostingList(places, r.integers(1, 6, len(places)) * int(r.choice([1, 50])), docs), int(r.integers(1, 3))))
        keys, scores = np.sort(r.integers(0, 400, docs)), np.zeros(docs, np.int64)
        for x, q in lists:
            scores[x.places] += x.adds * q
        search.search_segment(lists, docs, best, np.zeros(docs, np.uint8), keys)
        expected += [(-s, k) for s, k in zip(scores.tolist(), keys.tolist()) if s]
    assert [(-s, k) for s, k in zip(best.scores.tolist(), best.keys.tolist())] == sorted(expected)[:5]


def test_skips_windows_and_postings(tiny_windows, monkeypatch):
    docs, read = 4000, []
    plain = search.PostingList.slice
    monkeypatch.setattr(search.PostingList, "slice", lambda self, w: (read.append(w), plain(self, w))[1])
    rare, common = np.arange(10), np.arange(docs)
    asked = [(search.PostingList(rare, np.full(10, 900), docs), 1), (search.PostingList(common, np.full(docs, 5), docs), 1)]
    search.search_segment(asked, docs, search.Best(5), np.zeros(docs, np.uint8), np.arange(docs))
    assert set(read) <= {0, 1}


def test_impacts_beyond_64_bits():
    tf, sizes = np.array([1, 7]), np.array([10**9, 3])
    n, length = 10**11, 10**12
    expected = [5 * (10**9 * t // (1000 * t + 8 * (25 + 75 * s * n // length))) for t, s in ((1, 10**9), (7, 3))]
    assert search.impacts(tf, sizes, 5, n, length).tolist() == expected
