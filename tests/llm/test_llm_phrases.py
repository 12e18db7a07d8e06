"""Phrase counts in quotient filters against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from limnetic.llm import phrases

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "phrase", "word", "n", "rank", "m", "slice")])


def pieces_of(text):
    folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", folded)]


def brute(rows, least, first=2000):
    n, f = Counter(), Counter()
    for text, lang in rows:
        for w in pieces_of(text):
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    tops = Counter()
    for (lang, w), a in cand.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                tops[lang, w[i : i + s]] = max(tops[lang, w[i : i + s]], a)
    out = {}
    for (lang, w), a in cand.items():
        if 100 * tops[lang, w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, r) in enumerate(sorted(found)[:first], 1))


def made_rows():
    r = random.Random(9)
    words = [*(f"w{i}" for i in range(30)), "ÉTÉ", "a\x00b", "x" * 100, "\x1cé"]
    text = lambda n: "".join(r.choice(words[: r.choice([4, 12, 34])]) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r\n", "!"]) for _ in range(n))
    rows = [(text(r.randint(0, 60)), r.choice(["en", "en", "en", "fr", None])) for _ in range(150)]
    rows += [("New York City is big. " * 12, "en")] * 8 + [(None, "en"), ("", None), (" .,\n", "xx"), ("one", "xx"), (text(30_000), "fr")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *("clash",) * 6) for r in rows], SCHEMA).repartition(4)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_like_brute_force(docs, rows):
    expected = brute(rows, 30)
    assert len(expected) > 50 and any("new york city" in r[2] for r in expected)
    assert found(phrases.collocations(docs)) == expected


def test_first_rows(docs, rows):
    assert found(phrases.collocations(docs, least=10, first=5)) == brute(rows, 10, 5)


@pytest.mark.parametrize("dictionary, digests", [(0, 1 << 20), (6, 1 << 20), (6, 0)])
def test_words_beyond_the_dictionary(docs, rows, monkeypatch, dictionary, digests):
    monkeypatch.setattr(phrases, "DIGESTS", digests)
    every, totals = phrases.all_phrases(docs.selectExpr("coalesce(lang, 'und') lang", "cast(coalesce(text, '') as binary) text"), 30, dictionary)
    plain, _ = phrases.all_phrases(docs.selectExpr("coalesce(lang, 'und') lang", "cast(coalesce(text, '') as binary) text"), 30)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, plain.collect()))


def test_many_filters_and_wide_ids(docs, rows, monkeypatch):
    """Filters of few keys, ids of 20 bits (80 bits for four words), and no pairs to prune by."""
    plain = phrases.counted_phrases
    monkeypatch.setattr(phrases, "FILTER_KEYS", 700)
    monkeypatch.setattr(phrases, "SLICE_KEYS", 50)
    monkeypatch.setattr(phrases, "PAIRS", 0)
    monkeypatch.setattr(phrases, "counted_phrases", lambda docs, shared, lengths, width, *rest: plain(docs, shared, lengths, 20, *rest))
    assert found(phrases.collocations(docs)) == brute(rows, 30)


def test_nothing_to_find(docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**9).count() == 0


@pytest.mark.parametrize("length, width", [(2, 8), (2, 17), (3, 9), (3, 21), (4, 16), (4, 17), (4, 20), (4, 32), (3, 32), (2, 32)])
def test_permutation_and_filters_lose_nothing(length, width):
    r = np.random.default_rng(length * 100 + width)
    kind = phrases.Permutation(length, width)
    words = [r.integers(0, 1 << width, 3000).astype(np.uint64) for _ in range(length)]
    for w in words:
        w[:500] = w[0]
    high, low = kind.permute(words)
    back = kind.words(high, low)
    assert all((a == b).all() for a, b in zip(words, back))
    if kind.bits <= 64:
        assert int(high.max()).bit_length() <= kind.bits
    expected = Counter(zip(high.tolist(), low.tolist() or [0] * 3000))
    runs = []
    for at in (slice(0, 400), slice(400, 2000), slice(2000, 3000), slice(0, 1)):
        run = phrases.Run.summed(high[at], low[at], None)
        data = phrases.QuotientFilter.pack(run, kind.bits, kind.low)
        again = phrases.QuotientFilter.unpack(data)
        assert (again.high == run.high).all() and (again.low == run.low).all() and (again.counts == run.counts).all()
        runs.append(again)
    whole = phrases.Run.merged(runs[:3])
    assert dict(zip(zip(whole.high.tolist(), whole.low.tolist() or [0] * len(whole)), whole.counts.tolist())) == expected
    # Lossless in few bytes: the remainders, a counter, and about two bits and a quotient's share.
    if width < 30:
        run = phrases.Run.summed(high, low, None)
        assert len(phrases.QuotientFilter.pack(run, kind.bits, kind.low)) < len(run) * (kind.bits / 8 + 2) + 100


def test_equal_first_bits_are_told_apart():
    high = np.array([5, 5, 5, 1, 5], np.uint64)
    low = np.array([2, 1, 2, 0, 1], np.uint64)
    run = phrases.Run.summed(high, low, None)
    assert list(zip(run.high.tolist(), run.low.tolist(), run.counts.tolist())) == [(1, 0, 1), (5, 1, 2), (5, 2, 2)]
    two = phrases.Run.merged([run, run])
    assert two.counts.tolist() == [2, 4, 4]
