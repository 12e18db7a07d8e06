"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from limnetic.llm import bpe, exact, language, lattice, minhash, mixing, quality, secrets, toxicity, wavelet
from limnetic.session import shared_path

from test_llm_queries import brute_components

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ("copy", "kept", "score", "label", "rep", "block", "bucket", "size", "fp", "toxicity", "language_id", "n_words", "blob", "path", "key", "h", "c",
    "_count", "_source", "_table", "_parts", "_sha", "_id", "_row", "_judged", "_dropped", "_copy", "_order", "_clean", "_words", "_windows", "_lines", "_placed", "_at", "_host", "_refused")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES),
])
WORDS = [a + b + c for a in ("ba", "do", "ti", "ren") for b in ("la", "mo", "su", "kim") for c in ("na", "ro", "vel", "s")]


def made(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_rows():
    long = made(1, 40_000)
    near = made(2, 200)
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "b"), (5, "one two", "en", "b"),
        (6, long, "en", "hot"), (7, long + " more", "en", "hot"), (8, near, "en", "hot"), (9, near.replace("  ", " ") + " end", "en", "hot"),
        (10, near.upper(), None, "hot"), (11, near.replace(" ", " \n "), "en", "hot"), (11, near.replace(" ", " \n "), "en", "hot"),
        (12, made(3, 120), "en", "hot"), (12, made(4, 120), "en", "hot"), (None, near, "en", "a"), (None, "no key", None, None),
        (13, "12345 !!! ###", "en", "b"), (14, "x" * 3000, "en", "b"), (15, "İSTANBUL <|endoftext|> ΑΣ 'LL it's 　z", "fr", "b"),
    ]
    return [(*r, len(r[1] or ""), *("clash",) * len(CLASHES)) for r in rows]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_mixing(edges, empty):
    out = mixing.mix_sources(edges, {"hot": 40.0, "b": 0.0})
    assert set(out.columns) == {*edges.columns, "shuffle_key"}
    rows = out.collect()
    assert not [r for r in rows if r["source"] == "b"]
    again = mixing.mix_sources(edges.repartition(2), {"hot": 40.0, "b": 0.0}).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(r[c] == "clash" for r in rows for c in CLASHES if c != "copy")
    assert mixing.mix_sources(empty, {"hot": 2.0}).count() == 0


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 20, "rare").otherwise("rest").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix_sources(docs, {"hot": 1, "rest": 2, "rare": 1}).groupBy("source").count().collect()}
    for name, share in (("hot", 0.25), ("rest", 0.5), ("rare", 0.25)):
        assert counts[name] / 30_000 == pytest.approx(share, abs=0.02)


def test_exact(edges, empty):
    rows = exact.exact_groups(edges).collect()
    assert len(rows) == edges.count()
    groups = {}
    for r in edge_rows():
        groups.setdefault(norm(r[1]), []).append(r[0])
    for r in rows:
        assert r["group_size"] in {len(g) for g in groups.values() if r["doc_id"] in g}
    # The blank texts, the near copies that differ in white space only, and the repeated row.
    assert sorted(len(g) for g in groups.values())[-1] == 4
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups)
    assert {r["keep_id"] for r in rows if r["doc_id"] == 11} == {8}
    assert exact.exact_groups(empty).count() == 0
    left = exact.drop_exact_duplicates(edges)
    assert left.columns == edges.columns and left.count() == len(groups)
    assert all(r[c] == "clash" for r in left.collect() for c in CLASHES)


def test_exact_keeps_the_same_of_rows_alike(spark):
    """Of rows alike in key and text but unlike elsewhere the choice does not depend on their order."""
    rows = [(1, "a  b", str(i)) for i in range(30)] + [(2, "c", "x"), (0, "a b", "y")]
    kept = {tuple(sorted(map(tuple, exact.drop_exact_duplicates(spark.createDataFrame(r, "doc_id long, text string, other string").repartition(n)).collect()))) for r, n in ((rows, 1), (rows[::-1], 5))}
    assert len(kept) == 1 and sorted((r[0], r[1]) for r in next(iter(kept))) == [(0, "a b"), (2, "c")]
    alike = {tuple(map(tuple, exact.drop_exact_duplicates(spark.createDataFrame(r, "doc_id long, text string, other string").repartition(n)).collect())) for r, n in ((rows[:30], 1), (rows[29::-1], 4))}
    assert len(alike) == 1


def verdicts(spark, hosts):
    """Hosts (name, rows, rows that fail the first rule) judged by the first rule alone."""
    rows = [(h, 10 if i < bad else 100) for h, n, bad in hosts for i in range(n)]
    measured = spark.createDataFrame(rows, "host string, n_words long").selectExpr("*", "5 * n_words word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words")
    return {r["_host"]: r["_refused"] for r in quality.host_verdicts(measured, "host")[0].collect()}


def test_prior_takes_sizes_of_hosts_into_account(spark):
    """Hosts of one row say nothing about how hosts differ, so one failing row refuses none of them."""
    ones = [(f"one{i}", 1, int(i % 10 < 3)) for i in range(400)]
    assert not any(verdicts(spark, ones).values())
    alike = [(f"large{i}", 100, 30) for i in range(10)]
    assert not any(verdicts(spark, ones[:200] + alike).values())
    # Hosts that do differ are told apart by a few rows, and bad large ones refused.
    apart = [(f"good{i}", 50, 1) for i in range(10)] + [(f"bad{i}", 50, 48) for i in range(10)] + [("new", 3, 3), ("tiny", 1, 0)]
    judged = verdicts(spark, apart)
    assert {h for h, r in judged.items() if r} == {*(f"bad{i}" for i in range(10)), "new"}


def test_measures_leave_other_columns_alone(edges):
    out = quality.text_measures(edges)
    replaced = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    assert set(out.columns) == set(edges.columns) | replaced
    assert all(r[c] == "clash" for r in out.collect() for c in CLASHES if c not in replaced)


def test_keys_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "`text id` long, body string")
    assert sorted(map(tuple, bpe.encode_decode(docs, PATH, key="text id", text="body").select("text id", "n_tokens").collect())) == [(1, 2), (2, 0)]
    scored = lattice.lattice_scores(docs.withColumnRenamed("body", "text"), F.lit(True), PATH, key="text id")
    assert sorted(r["text id"] for r in scored.collect()) == [1, 2]


def test_quotient_filters_merge_losslessly():
    r = np.random.default_rng(3)
    values = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    values[:300] = values[0]
    parts = np.array_split(r.permutation(np.r_[values, values[:1000]]), 7)
    filters = [exact.QuotientFilter.of(p, np.ones(len(p), np.int64), 64) for p in parts]
    merged = exact.QuotientFilter.merged([exact.QuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    found, counts = merged.items()
    expected = np.unique(np.concatenate(parts), return_counts=True)
    assert (found == expected[0]).all() and (counts == expected[1]).all()


def test_quality(edges, empty, spark):
    out = quality.quality(edges)
    assert out.count() == edges.count()
    measured = lambda r: (str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_repeat_words"])
    expected = []
    for row in edge_rows():
        words = (row[1] or "").encode().split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {i + o for i, g in enumerate(grams) if g in often for o in range(3)}
        expected.append((str(row[0]), len(words), sum(len(w.decode()) for w in words), len(covered)))
    assert sorted(map(measured, out.collect())) == sorted(expected)
    assert quality.quality(empty).count() == 0
    spam = [(i, "buy now $$$ " * 30 + str(i), "spam") for i in range(60)] + [(100 + i, made(i, 80), "good") for i in range(60)] + [(300, made(9, 90), "spam")]
    found = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(spam, "doc_id long, text string, source string")).collect()}
    assert not found[300]["base_failed"] and not found[300]["kept"] and found[100]["kept"]


def test_secrets(spark, edges, empty):
    text = "é token = abcdef123 AKIA" + "A1" * 10 + " " + "deadbeef" * 4 + "\npassword=token:abcdefgh passwd:'xy' API_KEY: \"zz/zz+z=\""
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (None, "secret: " + "q" * 9)], "doc_id long, text string")
    ledger = shared_path(spark, "ledger-test")
    found = secrets.scan_secrets(docs, ledger)
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    base = []
    for rank, (kind, pattern, least, group) in enumerate(secrets.RULES[:3]):
        base += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    assert rows[1] == sorted(base) == rows[2] and len(base) >= 4 and rows[3] == [] and len(rows[None]) == 1
    assert spark.read.parquet(ledger).count() == 3
    # A second version is scanned alone; findings still reach every path.
    more = docs.union(spark.createDataFrame([(4, "AKIA" + "Z" * 16)], docs.schema))
    again = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(more, ledger).collect()}
    assert spark.read.parquet(ledger).count() == 4 and len(again[4]) == 1 and len(again[1]) == len(base)
    assert secrets.scan_secrets(edges, shared_path(spark, "ledger-test")).count() == edges.count()
    assert secrets.scan_secrets(empty, shared_path(spark, "ledger-test")).count() == 0


def test_secrets_in_long_texts(spark):
    """Megabytes of digests, and of openings of tokens, take seconds: time grows little faster than the text."""
    digests = " ".join(f"{i:032x}" for i in range(300_000))
    openings, dots = "eyJ" * 350_000, "eyJabcdefgh." * 90_000
    token = "x=eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2 eyJtoo.short eyJabcdefghi.jklmnopqrs.tuvwxyz01.more eyJabcdefghi.jklmnopqrs.tuvwxyz01."
    docs = spark.createDataFrame([(1, digests), (2, openings), (3, dots), (4, token)], "doc_id long, text string").repartition(4)
    begin = time.time()
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan_secrets(docs, shared_path(spark, "ledger-long")).collect()}
    assert time.time() - begin < 60
    assert [s[0] for s in rows[1]] == list(range(0, 33 * 300_000, 33)) and rows[1][-1][3] == len(digests)
    assert rows[2] == [] and rows[3] == []
    jwt = [s for s in rows[4] if s[2] == "jwt"]
    assert [token[a:b] for a, _, _, b in jwt] == ["eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF2", "eyJabcdefghi.jklmnopqrs.tuvwxyz01."]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 1000])
def test_running_sums(spark, n):
    r = random.Random(n)
    values = [r.randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "x array<int>")
    assert df.select(secrets.running_sums(F.col("x"))).first()[0] == np.cumsum(values, dtype=int).tolist()


def test_bpe_round_trip(edges, empty):
    library = Tokenizer.from_file(PATH)
    rows = bpe.encode_decode(edges, PATH).collect()
    assert len(rows) == edges.count()
    expected = sorted((str(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows())
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in rows) == expected
    assert all(r["decoded"] == library.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in rows)
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_bpe_like_the_library():
    library, own, r = Tokenizer.from_file(PATH), bpe.word_bpe(PATH), random.Random(5)
    pool = [chr(c) for a, b in ((0x20, 0x250), (0x300, 0x345), (0x370, 0x400), (0x1F600, 0x1F610), (0x3040, 0x3060)) for c in range(a, b) if chr(c).isprintable()]
    pool += ["'s", "'LL", "<|endoftext|>", "<|end", "Σ", "\x85", "\x1c", " ", "\n", "th", "a"] * 6
    for _ in range(3000):
        text = "".join(r.choices(pool, k=r.randint(0, 25)))
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    # Every code point, alone and between letters and digits, in a few long texts.
    for a in range(0, 0x110000, 1 << 14):
        signs = [chr(c) for c in range(a, a + (1 << 14)) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"{c} a{c}a1{c}1" for c in signs)
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(a)
    for _ in range(300):  # long words, with ties
        word = "".join(r.choices(r.choice(["ab", "the", "é中a", "!?-"]), k=r.randint(50, 300)))
        assert np.frombuffer(own.encode(word.encode()), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    own.forget()
    parts = [own.inner[b] for b in r.choices(range(97, 123), k=400)] + [own.last[97]]
    assert own.merge_short(list(parts)) == own.merge_long(list(parts))


def test_wavelet(spark, edges, empty):
    x = np.random.default_rng(1).integers(0, 300, 3000)
    x[:700] = 7
    m = wavelet.Shard.from_bytes(wavelet.Shard([1, None], np.array([10, 3000]), wavelet.WaveletMatrix.of(x)).to_bytes()).matrix
    assert (m.ids() == x).all() and all(m.access(i) == x[i] for i in range(0, 3000, 37))
    for v in (7, 0, 299, 300):
        places = np.flatnonzero(x == v)
        assert m.count(v) == len(places) and m.count(v, 100, 2000) == ((places >= 100) & (places < 2000)).sum()
        assert all(m.occurrence(v, k) == places[k] for k in range(0, len(places), 9))
    folder = shared_path(spark, "wavelet-test")
    wavelet.write_shards(edges, folder, PATH, shard_ids=500)
    assert spark.read.parquet(folder).count() > 3
    rows = sorted(wavelet.read_shards(spark, folder, ids=True).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == edges.count()
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    folder = shared_path(spark, "wavelet-test")
    wavelet.write_shards(empty, folder, PATH)
    assert wavelet.read_shards(spark, folder).count() == 0


def test_near_edges(edges, empty):
    rows = minhash.near_duplicates(edges, words=3, least=(85, 100)).collect()
    assert len(rows) == edges.count()
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert of[8] == of[9] == of[10] == of[11] == {8} and of[7] == {6} and of[12] == {12} and of[1] == {1} and of[None] == {None}
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert minhash.near_duplicates(empty).count() == 0


def test_near_loses_no_link(spark):
    """Families that share passages, chains at the threshold and large buckets, against all pairs."""
    r = random.Random(11)
    texts = {}

    def add(words):
        texts[len(texts)] = " ".join(words)

    passage = made(21, 60).split()
    for _ in range(60):
        add(passage + made(r.random(), r.choice((8, 10, 12, 16))).split())
    base = made(22, 150).split()
    for i in range(60):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        add(words)
    for i in range(40):
        add(made(i, 40).split())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    whole = minhash.BLOCK_ELEMENTS
    for words, least, block in ((3, (85, 100), whole), (5, (80, 100), whole), (3, (85, 100), 900)):
        minhash.BLOCK_ELEMENTS = block
        found = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs, words=words, least=least).collect()}
        minhash.BLOCK_ELEMENTS = whole
        assert found == brute_components(texts, words, *least)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100)]
    found = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[90] == found[95] == found[100] == 90


def test_language(spark, edges, empty):
    filters = language.fit_filters(edges, F.lit(True))
    rows = language.identify(edges, filters)
    assert set(rows.columns) == set(edges.columns) and rows.count() == edges.count()
    found = {r["doc_id"]: r["language_id"] for r in rows.collect()}
    for key in (1, 2, 3, 13):
        assert found[key]["language"] == "und" and found[key]["score"] == 0
    assert found[8]["language"] == "en" and 0 <= found[8]["score"] <= 1
    nothing = language.fit_filters(empty, F.lit(True))
    assert {r["language_id"]["language"] for r in language.identify(edges, nothing).collect()} == {"und"}
    assert language.identify(empty, filters).count() == 0


def test_language_filters_return_every_language():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 4000).astype(np.uint64)
    found = {f"l{i:02}": hashes[i * 50 : i * 50 + 100] for i in range(70)}
    filters = language.LanguageFilters.of(found)
    counts = filters.popcounts(hashes[:100], np.array([100]))[0]
    assert counts[0] == 100 and counts[1] >= 50 and counts[69] <= 100 * filters.false_rate[69] + 5


def test_toxicity(spark, edges, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(edges, labels, F.lit(True))
    rows = toxicity.score_toxicity(edges, model).collect()
    assert len(rows) == edges.count() and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert toxicity.fit_toxicity(edges, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r["toxicity"] for r in toxicity.score_toxicity(edges, None).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def toxic_texts():
    texts = [f"{made(i, 6)} {'zorgly' if i % 3 == 0 else 'plain'}".encode() for i in range(120)]
    return texts, np.array([int(i % 3 == 0) for i in range(120)])


def test_toxicity_of_texts_without_words():
    texts, labels = toxic_texts()
    model = toxicity.fit_model(texts, labels, ["en"] * 120)
    for last in (b"", b" \n\t ", b"!!! ##"):
        for given in ([last], [last, last], [texts[0], last], [last, texts[0], last], [*texts, last]):
            scores = model.scores(given)
            assert len(scores) == len(given) and np.isfinite(scores).all()
            assert scores[-1] == pytest.approx(model.scores([b"", b"plain"])[0])


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours():
    texts, labels = toxic_texts()
    model = toxicity.fit_model(texts, labels, ["en"] * 120)
    mixed = [x for t in texts for x in (b"", t)]
    alone = np.array([model.scores([t, b"plain plain plain"])[0] for t in mixed])
    assert model.scores(mixed) == pytest.approx(alone, abs=1e-6)


def test_toxicity_is_fitted_on_texts_without_words():
    texts, labels = toxic_texts()
    model = toxicity.fit_model([b"" if i % 5 == 0 else t for i, t in enumerate(texts)], labels, ["en"] * 120)
    assert np.isfinite(model.scores([b"", texts[0]])).all()


def test_toxicity_of_a_partition_of_one_empty_text(spark):
    texts, labels = toxic_texts()
    model = toxicity.fit_model(texts, labels, ["en"] * 120)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "zorgly"), (4, "##")], "doc_id long, text string").repartition(4, "doc_id")
    assert toxicity.score_toxicity(docs, model).count() == 4
    assert all(0 <= r["toxicity"] <= 1 for r in toxicity.score_toxicity(docs, model).collect())


def test_toxicity_is_fitted_on_one_row_a_key(spark, monkeypatch):
    texts, labels = toxic_texts()
    rows = [(i, t.decode(), "en") for i, t in enumerate(texts)] + [(0, f"text {i}", None if i % 2 else "en") for i in range(500)]
    marks = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)], "doc_id long, toxic int")
    fitted = []
    monkeypatch.setattr(toxicity, "fit_model", lambda *given: fitted.append([list(x) for x in given]))
    for parts in (1, 7):
        toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts), marks, F.lit(True))
    assert len(fitted[0][0]) == 120 and sum(fitted[0][1]) == labels.sum() and fitted[0] == fitted[1]


def test_toxicity_learns_from_all_rows_in_tasks(spark):
    """Every toxic word is in few documents, so that a part of the rows would not show them all."""
    r = random.Random(5)
    rows, marks = [], []
    for i in range(1600):
        words = [r.choice(WORDS) for _ in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[r.randrange(30)] = f"{chr(97 + i // 4 % 20) * 3}q"
        rows.append((i, " ".join(words), ("en", "xx", None)[i % 3]))
        marks.append((i, toxic))
    rows += [(0, "again", "en"), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") < 1200, positive=20, negative=20)
    found = toxicity.score_toxicity(docs.where("doc_id >= 1200"), model).join(labels, "doc_id").collect()
    assert len(found) == 400 and all(0 <= x["toxicity"] <= 1 for x in found)
    right = [(x["toxicity"] >= 0.5) == (x["toxic"] == 1) for x in found]
    assert sum(right) / len(right) >= 0.97
    marked = [x["toxicity"] >= 0.5 for x in found if x["toxic"]]
    assert sum(marked) / len(marked) >= 0.95


def test_toxicity_learns_stems_in_each_language():
    r = random.Random(7)
    texts, labels, langs = [], [], []
    for i in range(600):
        lang = "en" if i % 2 else "xx"
        words = [r.choice(WORDS) + ("" if lang == "en" else "en") for _ in range(60)]
        if i % 5 == 0:
            words[r.randrange(60)] = ("grobmu" if lang == "en" else "zyffle") + r.choice(WORDS)
        texts.append(" ".join(words).encode())
        labels.append(int(i % 5 == 0))
        langs.append(lang)
    model = toxicity.fit_model(texts[:450], np.array(labels[:450]), langs[:450])
    predicted = model.scores(texts[450:]) >= 0.5
    assert (predicted == np.array(labels[450:], bool)).mean() >= 0.97


def test_lattice(edges, empty):
    rows = lattice.lattice_scores(edges, F.col("doc_id") != 5, PATH).collect()
    assert len(rows) == edges.count()
    end = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(end) == 1 and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert {r["n_known"] for r in rows if r["doc_id"] == 5} == {2}
    assert {r["training"] for r in rows if r["doc_id"] is None} == {False}
    assert lattice.lattice_scores(empty, F.lit(True), PATH).count() == 0
    assert lattice.lattice_scores(edges, F.lit(False), PATH).where("n_known > 0 or train_tokens > 0").count() == 0


def test_lattice_sums_over_all_segmentations():
    pieces = lattice.pieces(PATH)
    scores, number = pieces.start(), {x: i for i, x in enumerate(pieces.data)}
    words, counts = [b"then", b"onentin", b"a", "été,".encode(), b"\xff"], np.array([2.0, 3, 1, 1, 1])
    expected, total = np.zeros(len(scores)), []
    for word, count in zip(words, counts):
        paths = []

        def walk(at, used):
            if at == len(word):  # noqa: B023
                paths.append(used)  # noqa: B023
            for stop in range(at + 1, len(word) + 1):  # noqa: B023
                i = number.get((word[at:stop], stop == len(word)))  # noqa: B023
                if i is not None:
                    walk(stop, [*used, i])

        walk(0, [])
        weights = [np.exp(scores[p].sum()) for p in paths]
        total.append(np.log(sum(weights)))
        for p, w in zip(paths, weights):
            np.add.at(expected, p, count * w / sum(weights))
    assert np.allclose(lattice.Lattice(pieces, words, scores).probabilities(), total)
    assert np.allclose(lattice.Lattice(pieces, words, scores).expected(counts, len(scores)), expected)


def test_pipeline_stages_on_edges(spark, edges, empty, small):
    for docs in (edges, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, small), "edges")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            docs = out if name != "language_id" else docs
        assert docs.count() >= 0
