"""Wavelet shards: ids by the library, and reads of no more than the blocks that are needed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from limnetic.llm import wavelet
from limnetic.session import shared_path

from test_llm_edges import SCHEMA, edge_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    """One by one and in a batch, over all edge texts, marks, cases and characters of many kinds."""
    r = random.Random(4)
    texts = [row[1] or "" for row in edge_rows()]
    signs = "aZéßΣσςИйǅ中あ한١²½'’\"-_.!?<|>#\t \n\x0b\x1c  　́🙂"
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += ["it's DON'T we'LL'x 12,345.6 e.g. U.S.A. a--b (word). <|startoftext|>x <|endoftext|>", "Ᲊ Ɤ x"]
    encoder = wavelet.LibraryEncoder(PATH)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() for t in texts] == expected
    ids, n = wavelet.LibraryEncoder(PATH).encode_all(pa.array([t.encode() for t in texts], pa.binary()))
    assert n.tolist() == list(map(len, expected)) and ids.tolist() == [i for x in expected for i in x]
    ids, n = encoder.encode_all(pa.array([b"", b" "], pa.binary()).slice(1))
    assert ids.tolist() == [] and n.tolist() == [0]


def test_edge_rows_equal_the_library(spark, library):
    rows = edge_rows()
    folder = shared_path(spark, "wavelet-edges")
    wavelet.write_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), folder, PATH, shard_ids=700)
    found = sorted(wavelet.read_shards(spark, folder, ids=True).collect(), key=lambda r: r["start"])
    expected = sorted((r[0] is not None, r[0] or 0, tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found]
    assert sorted(got) == expected and [g[:2] for g in got] == [e[:2] for e in expected]


def test_a_key_of_any_name(spark):
    folder = shared_path(spark, "wavelet-key")
    wavelet.write_shards(spark.createDataFrame([(2, "b"), (1, None)], "`text id` long, body string"), folder, PATH, key="text id", text="body")
    assert [(r["text id"], r["n_tokens"]) for r in wavelet.read_shards(spark, folder, key="text id").orderBy("start").collect()] == [(1, 1), (2, 2)]


def test_reads_only_what_it_needs():
    """By bytes: one access, count or occurrence inflates a block or two of each plane, not the file."""
    r = np.random.default_rng(2)
    x = r.zipf(1.3, 600_000).clip(0, 40_000).astype(np.uint32)
    x[:1000] = 40_001
    data = wavelet.Shard([1], np.array([len(x)]), wavelet.WaveletMatrix.of(x)).to_bytes()
    read = []

    def opened():
        read.clear()
        return wavelet.Shard.open(lambda at, size: (read.append(size), data[at : at + size])[1]).matrix

    matrix = opened()
    head, block = sum(read), wavelet.BLOCK // 8 + 64
    assert head < 8000 < len(data)
    assert matrix.access(123_456) == x[123_456]
    assert sum(read) - head <= matrix.levels * block
    matrix = opened()
    assert matrix.count(3, 1000, 400_000) == (x[1000:400_000] == 3).sum()
    assert sum(read) - head <= 2 * matrix.levels * block
    matrix = opened()
    assert matrix.occurrence(3, 20_000) == np.flatnonzero(x == 3)[20_000]
    assert sum(read) - head <= 3 * matrix.levels * block
    assert opened().count(40_001) == 1000 and opened().count(7) == (x == 7).sum()
    assert wavelet.Shard.open(lambda at, size: data[at : at + size]).keys == [1]


@pytest.mark.parametrize("n", [0, 1, wavelet.BLOCK - 1, wavelet.BLOCK, wavelet.BLOCK + 1, 3 * wavelet.BLOCK])
def test_sizes_around_a_block(n):
    x = np.random.default_rng(n).integers(0, 5, n)
    shard = wavelet.Shard.from_bytes(wavelet.Shard([None] * 2, np.array([0, n]), wavelet.WaveletMatrix.of(x)).to_bytes())
    assert (shard.matrix.ids() == x).all() and shard.keys == [None, None] and shard.ends.tolist() == [0, n]
    for v in range(6):
        places = np.flatnonzero(x == v)
        assert shard.matrix.count(v) == len(places)
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert shard.matrix.occurrence(v, k) == places[k]
    with pytest.raises(IndexError):
        shard.matrix.access(n)


def test_token_counts(spark, library):
    rows = [(i, "the cat and the dog " * (i % 5)) for i in range(50)]
    folder = shared_path(spark, "wavelet-counts")
    wavelet.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, shard_ids=100)
    the = library.encode("the", add_special_tokens=False).ids[0]
    found = wavelet.token_counts(spark, folder, [the, 1, 49_000]).groupBy("token").sum("n").collect()
    assert {r["token"]: r["sum(n)"] for r in found} == {the: 2 * sum(i % 5 for i in range(50)), 1: 50, 49_000: 0}
