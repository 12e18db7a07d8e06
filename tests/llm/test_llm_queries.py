"""The dealt queries against their SQL, the tokenizers library, brute force or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import check
import corpus_pipeline
from limnetic import llm
from limnetic.llm import minhash
from limnetic.llm.common import table

MIDDLE = "/root/testdata/sf0.01"
NATIVE = {"op2_source_mixing", "op5_host_quality", "op7_secret_ledger"}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}


@pytest.mark.parametrize("key", sorted(llm.ORACLES))
def test_sql(spark, small, key):
    df = llm.QUERIES[key](spark, small)
    state, rows, note = check.compare_frame(df, check.connect(small), key)
    assert state == "ok" and not note, note
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key in NATIVE:
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_numbers_are_all_there():
    assert {int(k[2:].split("_")[0]) for k in llm.QUERIES} == set(range(1, 14))


def test_bpe(spark, small, library, texts):
    rows = llm.QUERIES["op3_word_bpe"](spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_wavelet_shards(spark, small, library, texts):
    found = {r["doc_id"]: r for r in llm.QUERIES["op8_wavelet_shards"](spark, small).collect()}
    at = 0
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 1]
        r = found.pop(key)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found


def test_lattice_base_and_model(spark, small, texts):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    words = {k: t.encode().lower().split() for k, t in texts.items()}
    counts = Counter(w for k, x in words.items() if not held[k] for w in x)
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    rows = llm.QUERIES["op10_subword_lattice"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x) + math.log10((ends + 1) / (n + v + 1))
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == n and r["n_tokens"] == len(x) + 1
        assert r["n_known"] == sum(counts[w] > 0 for w in x) + 1
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    # Reversed words are less likely than the corpus's own.
    per_token = sum(r["score"] for r in rows if r["held_out"]) / sum(r["n_tokens"] for r in rows if r["held_out"])
    assert per_token > -8


def test_language_held_out(spark):
    found = llm.QUERIES["op6_language_id"](spark, MIDDLE).where("held_out").join(table(spark, MIDDLE, "documents"), "doc_id").collect()
    assert len(found) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_held_out(spark):
    scores = llm.QUERIES["op1_toxicity_cnn"](spark, MIDDLE)
    rows = scores.collect()
    assert len(rows) == table(spark, MIDDLE, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    found = scores.join(table(spark, MIDDLE, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) / len(found) >= 0.95


def test_pipeline_against_brute_force(spark, small, library):
    """Each stage on its own input, by plain Python."""
    docs = table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, small), "test-pipeline")
        after = [r.asDict() for r in out.collect()]
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        ids, kept = [r["doc_id"] for r in before], [r["doc_id"] for r in after]
        if name == "language_id":
            assert sorted(kept) == sorted(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
            assert sorted(kept) == sorted(first.values())
        elif name == "near_dedup":
            component = brute_components({r["doc_id"]: r["text"] or "" for r in before}, 5, 80, 100)
            assert sorted(kept) == sorted(k for k in ids if component[k] == k)
        elif name == "source_mixing":
            assert set(kept) <= set(ids) and abs(len(kept) - len(ids)) < 6 * math.sqrt(len(ids))
        else:
            assert sorted(kept) == sorted(ids)
            text = {r["doc_id"]: r["text"] for r in before}
            for r in after:
                expected = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
                assert np.frombuffer(r["ids"], "<u4").tolist() == expected
                assert r["decoded"] == library.decode(expected, skip_special_tokens=False)
        docs = out


def brute_components(texts, words, part, whole):
    sets = {k: set(minhash.shingles(t.encode(), words).tolist()) for k, t in texts.items()}
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}
