"""Bin slack packing against the library, all subsets, and its own accounts."""

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limnetic.llm import QUERIES, packing
from limnetic.llm.common import table

from test_llm_edges import SCHEMA, edge_rows

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(rows, expected, capacity=2048):
    """Every id of every document lies in exactly one piece, and sequences are gapless and within the capacity."""
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(documents) == set(expected)
    for key, pieces in documents.items():
        at, ids = 0, expected[key]
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0
    return sequences


def test_query_equals_the_library(spark, small, library):
    docs = {r["doc_id"]: ids_of(library, r["text"]) for r in table(spark, small, "documents").collect()}
    rows = QUERIES["op11_bin_slack_packing"](spark, small).collect()
    sequences = check_pieces(rows, docs)
    assert sum(len(s) > 1 for s in sequences.values()) > 10
    # Cuts beyond those that full windows need are few: the last sequences, and slack that no multiset fills.
    needed = sum(-(-len(ids) // 2048) for ids in docs.values())
    assert len(rows) - needed <= 0.1 * len(docs)


def test_edge_rows(spark, library):
    rows = [r for r in edge_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(100, "a" * 40_000, *rows[0][2:]), (101, " \n" * 9_000 + "x", *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for ranks in (RANKS, None):
        found = packing.pack_windows(docs, PATH, ranks).withColumn("ids_crc32", F.crc32("ids"))
        check_pieces(found.collect(), {r[0]: ids_of(library, r[1]) for r in rows})
    every = spark.createDataFrame(edge_rows(), SCHEMA)
    counted = packing.pack_windows(every, PATH, RANKS, capacity=64)
    assert counted.where("start = 0").count() == every.count()
    assert counted.where("doc_id is null and start = 0").count() == 2
    assert packing.pack_windows(spark.createDataFrame([], SCHEMA), PATH, RANKS).count() == 0


def test_another_key(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, None)], "`text id` string, body string")
    found = packing.pack_windows(docs, PATH, RANKS, key="text id", text="body").collect()
    assert sorted((r["text id"] or "", r["length"]) for r in found) == [("", 1), ("a", 1), ("a", 2)] or len(found) == 2


def test_long_texts_are_cut_where_no_token_reaches(library):
    encoder = packing.byte_encoder(PATH, RANKS)
    text = "wörd  two,\n three 4 <|endoftext|> 's ünï 　中文 and so on. " * 6_000
    assert len(text) > packing.CHUNK
    assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    plain = "word  two,\n three 4 's it's we'LL  " * 10_000
    assert encoder.encode(plain).tolist() == library.encode(plain, add_special_tokens=False).ids


def test_stable_characters_are_alike_in_both_libraries(library):
    encoder = packing.byte_encoder(PATH, RANKS)
    stable = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and packing.STABLE.fullmatch(chr(c))]
    assert len(stable) > 30_000
    for i in range(0, len(stable), 500):
        text = " ".join(f"a{c}a1{c}1 {c}{c} {c}" for c in stable[i : i + 500])
        assert encoder.fast.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 90))
def test_closest_fill_is_the_best_of_all_subsets(lengths, target):
    chosen = packing.closest_fill(dict(Counter(lengths)), target)
    best = max(s for n in range(len(lengths) + 1) for s in map(sum, itertools.combinations(lengths, n)) if s <= target)
    assert sum(n * c for n, c in chosen.items()) == best
    assert not Counter(chosen) - Counter(lengths)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([1, 7, 64, 100]))
def test_packer_places_every_id_once(lengths, capacity):
    packer, seen = packing.SlackPacker(capacity), Counter()
    sequences = [s for k, n in enumerate(lengths) for s in packer.add(k, np.arange(n))] + list(packer.finish())
    for s in sequences:
        size = sum(len(p.ids) for p in s)
        assert size == capacity or size < capacity and size & (size - 1) == 0
        seen.update((p.key, i) for p in s for i in p.ids.tolist())
    assert seen == Counter((k, i) for k, n in enumerate(lengths) for i in range(n))
    assert sum(sum(len(p.ids) for p in s) != capacity for s in sequences) <= capacity.bit_length()
