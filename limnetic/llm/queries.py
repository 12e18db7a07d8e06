"""The dealt operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from limnetic.llm import bpe, exact, language, lattice, minhash, mixing, packing, phrases, quality, search, secrets, toxicity, wavelet
from limnetic.llm.common import remainder, table
from limnetic.llm.register import query
from limnetic.session import shared_path

VOCABULARY = "word_bpe_49k.json"

# The target mixture: the catch-all source at three shares, every other source at one.
MIXTURE = {"src0": 3.0}


@query("op1_toxicity_cnn")
def op1(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 5)
    model = toxicity.fit_toxicity(docs, table(spark, root, "labels"), fold != 0)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity")
    return scored.select("doc_id", (fold == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


MIXING_SQL = """
WITH sources AS (
  SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source
), rates AS (
  SELECT source, (SELECT sum(n) FROM sources)::DOUBLE * w / (SELECT sum(w) FROM sources) / n AS rate FROM sources
), parts AS (
  SELECT source, ceil(rate / 16.0)::INT AS parts, rate / ceil(rate / 16.0)::INT AS mean FROM rates
), steps AS (
  SELECT source, k, exp(-mean) * product(CASE WHEN k = 0 THEN 1.0 ELSE mean / k END) OVER (PARTITION BY source ORDER BY k) AS p
  FROM parts, range(0, 97) t(k)
), table_ AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM steps
), draws AS (
  SELECT doc_id, d.source, text, lang, n_chars, part,
    (('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, 'null'), part)), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) t(part)
), counts AS (
  SELECT r.doc_id, r.source, r.text, r.lang, r.n_chars, r.part, count(c.k) AS n
  FROM draws r LEFT JOIN table_ c ON r.source IS NOT DISTINCT FROM c.source AND c.c <= r.u
  GROUP BY ALL
), totals AS (
  SELECT doc_id, source, text, lang, n_chars, sum(n)::INT AS n FROM counts GROUP BY ALL
)
SELECT doc_id, source, text, lang, n_chars, copy::INT AS copy,
  ('0x' || substr(md5(concat_ws(':', 'order-1', coalesce(doc_id::VARCHAR, 'null'), copy)), 1, 15))::BIGINT AS shuffle_key
FROM totals, range(1, n + 1) t(copy)
"""


@query("op2_source_mixing", MIXING_SQL)
def op2(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix_sources(docs, MIXTURE)


@query("op3_word_bpe")
def op3(spark, root):
    found = bpe.encode_decode(table(spark, root, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


@query("op4_exact_dedup", EXACT_SQL)
def op4(spark, root):
    return exact.exact_groups(table(spark, root, "documents"))


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM repeated, range(0, 3) t(o) GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (doc_id)
), rules AS (
  SELECT *, n_words < 50 AS few_words, 100 * n_repeat_words > 50 * n_words AS repeats,
    10 * n_symbols > word_chars AS symbols, 10 * n_dup_lines > n_words AS dup_lines,
    word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_size FROM m
), hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed::INT) AS f
  FROM (UNPIVOT rules ON few_words, repeats, symbols, dup_lines, word_size INTO NAME rule VALUE failed) GROUP BY ALL
), moments AS (
  SELECT rule, count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(f)::DOUBLE AS f, sum(n * n)::DOUBLE AS squares, sum(f::DOUBLE * f / n) AS own FROM hosts GROUP BY rule
), parts AS (
  SELECT rule, f / n AS mean, CASE WHEN k > 1 AND k < n THEN (n - squares / n) / (k - 1) END AS size,
    CASE WHEN k > 1 THEN (own - f * f / n) / (k - 1) END AS b, CASE WHEN k < n THEN (f - own) / (n - k) END AS w FROM moments
), prior AS (
  SELECT rule, mean, CASE WHEN b + (size - 1) * w > 0 AND b > w THEN (b + (size - 1) * w) / (b - w) - 1 ELSE 100 END AS z FROM parts
), verdicts AS (
  SELECT source, bool_or((f + mean * z) / (n + z) > 0.5) AS refused FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
  NOT (few_words OR repeats) AND NOT refused AS kept, r.source AS host
FROM rules r JOIN verdicts v ON r.source IS NOT DISTINCT FROM v.source
"""


@query("op5_host_quality", QUALITY_SQL)
def op5(spark, root):
    return quality.quality(table(spark, root, "documents"))


@query("op6_language_id")
def op6(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 4)
    filters = language.fit_filters(docs, fold != 2)
    judged = language.identify(docs.select("doc_id", "text"), filters)
    return judged.select(
        "doc_id", (fold == 2).alias("held_out"), F.col("language_id.language").alias("lang_pred"), F.col("language_id.score").alias("score"),
        F.col("language_id.coverage").alias("coverage"),
    )


def secrets_sql() -> str:
    """Gaps and matches as in ``secrets.kind_spans``, summed up in SQL."""
    parts = []
    for rank, (kind, pattern, least, group) in enumerate(secrets.RULES):
        pattern = pattern.replace("'", "''")
        pair = f"(?s)(.*?)({pattern})"
        tried = f"contains(t, '{secrets.HINT[kind]}')" if kind in secrets.HINT else f"regexp_matches(t, '{pattern}')"
        right = f"AND regexp_matches(found, '{secrets.WHOLE[kind]}')" if kind in secrets.WHOLE else ""
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, size, counted, found, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(g, lambda x: length(x))) AS gap,
      unnest(list_transform(m, lambda x: length(x))) AS size, unnest(m) AS found, unnest(list_transform(c, lambda x: length(x))) AS counted
    FROM (SELECT doc_id, regexp_extract_all(t, '{pair}', 1) AS g, regexp_extract_all(t, '{pair}', 2) AS m,
        regexp_extract_all(t, '{pair}', {2 + group}) AS c FROM d WHERE {tried}))
  QUALIFY counted >= {least} {right}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)}),
lines AS (SELECT doc_id, rank, kind, stop - size AS start, concat_ws(':', kind, stop - size, stop) AS s FROM spans),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(s, ',' ORDER BY start, rank) AS spans FROM lines GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)"""


@query("op7_secret_ledger", secrets_sql())
def op7(spark, root):
    docs, ledger = table(spark, root, "documents"), shared_path(spark, "secret-ledger")
    # The ledger is filled by one half of the paths first; then all paths are scanned, the other half's texts alone being new.
    secrets.scan_secrets(docs.where(remainder("doc_id", 2) == 0), ledger)
    found = secrets.scan_secrets(docs, ledger)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined_spans(F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE)))
    return found.select(
        "doc_id", *map(of, secrets.BASE), F.sha2(base, 256).alias("base_sha256"), secrets.joined_spans(F.col("spans")).alias("spans")
    )


@query("op8_wavelet_shards")
def op8(spark, root):
    folder = shared_path(spark, "wavelet-shards")
    wavelet.write_shards(table(spark, root, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return wavelet.read_shards(spark, folder)


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON a = doc_id
"""


@query("op9_circulant_minhash", NEAR_SQL)
def op9(spark, root):
    return minhash.near_duplicates(table(spark, root, "documents"), words=3, least=(85, 100))


@query("op10_subword_lattice")
def op10(spark, root):
    fold = remainder("doc_id", 7)
    scored = lattice.lattice_scores(table(spark, root, "documents"), fold != 2, public_tokenizers.path(VOCABULARY))
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_bin_slack_packing")
def op11(spark, root):
    vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.pack_windows(table(spark, root, "documents"), vocabulary, ranks)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SEARCH_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT no, doc_id, len(w) AS n FROM words WHERE len(w) > 0
), totals AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT DISTINCT item_id, text FROM benchmark) b,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t(term) GROUP BY ALL
), postings AS (
  SELECT no, term, count(*) AS tf FROM words, unnest(w) t(term) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id, no, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN docs USING (no), totals GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


@query("op12_hybrid_search", SEARCH_SQL)
def op12(spark, root):
    return search.search(table(spark, root, "documents"), table(spark, root, "benchmark"))


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS no, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), grams AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 5) t(m) WHERE len(w) >= m)
), f AS (
  SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)
), scores AS (
  SELECT c.lang, c.phrase, c.a, k, h.a AS l, t.a AS r, ((2000000::HUGEINT * c.a) // (h.a + t.a))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
), lowest AS (
  SELECT lang, phrase, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS top
  FROM (SELECT lang, w, a, m, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, 4) t(s) WHERE s < m) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT x.lang, x.phrase, a, l, r, score, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase WHERE top IS NULL OR 100 * top < 80 * a
) JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_filters", PHRASES_SQL)
def op13(spark, root):
    return phrases.collocations(table(spark, root, "documents"))
