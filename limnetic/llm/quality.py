"""Quality rules on texts and on the hosts they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import SPACE, free_names, small_join, whole
from limnetic.session import written

# A host is refused when the shrunk rate of one rule's failures exceeds this.
MAX_RATE = 0.5
# Rows that the prior counts for when the hosts do not differ.
PRIOR_ROWS = 100.0


def words_of(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Of the 3-word windows, told apart by 64-bit hashes, those that occur twice are found by
    sorting (hash, position); their positions, in order, then cover up to three words each.
    A missing text has no words. Input columns of these names are replaced.
    """
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    given, words, windows, by_line, placed_at, at_ = free_names([*docs.columns, *measures], "_clean", "_words", "_windows", "_lines", "_placed", "_at")
    clean = F.col(given)
    spaces = F.length(clean) - F.length(F.regexp_replace(clean, SPACE, ""))
    lines = F.filter(F.split(clean, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    frame = docs.withColumn(given, whole(text)).withColumn(words, words_of(clean))
    n = F.size(words)
    frame = frame.withColumns({
        windows: F.when(n >= 3, F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        )),
        by_line: lines,
    })
    # (hash, position) in order; a window whose neighbour has its hash is repeated.
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn(placed_at, F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed))
    alike = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    at = F.filter(placed_at, lambda x, j: alike(x, F.get(placed_at, j - 1)) | alike(x, F.get(placed_at, j + 1)))
    frame = frame.withColumn(at_, F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(at_, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at_, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return frame.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(clean) - spaces).cast("long"),
        "n_symbols": (F.length(clean) - F.length(F.regexp_replace(clean, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size(by_line) - F.size(F.array_distinct(by_line))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop(given, words, windows, by_line, placed_at, at_)


# Rule failures counted by host; the first two are the base.
def failures() -> dict[str, Column]:
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": words < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > chars,
        "lines": 10 * F.col("n_dup_lines") > words,
        "word_size": (chars < 2 * words) | (chars > 15 * words),
    }


def host_verdicts(measured: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """_host, _refused: hosts with a rule whose shrunk failure rate exceeds ``max_rate``.

    Of each rule a beta prior is fitted by moments that know the hosts' sizes: what the rates
    differ beyond what their rows alone make them differ gives the correlation of two rows
    of one host, rho, and the prior counts 1 / rho - 1 rows. A host's rate is shrunk to
    (failures + alpha) / (rows + alpha + beta). Where the hosts do not differ, or all have a
    single row, the prior counts ``PRIOR_ROWS`` rows.
    """
    rules = failures()
    hosts = written(
        measured.groupBy(F.col(host).cast("string").alias("_host")).agg(
            F.count("*").alias("_rows"), *(F.sum(c.cast("long")).alias(f"_{name}") for name, c in rules.items())
        ),
        "host-failures",
    )
    rows = F.col("_rows").cast("double")
    found = {name: F.col(f"_{name}").cast("double") for name in rules}
    moments = hosts.agg(
        F.sum(F.coalesce(F.octet_length("_host"), F.lit(0)) + 32).alias("size"), F.count("*").alias("hosts"),
        F.sum(rows).alias("rows"), F.sum(rows * rows).alias("squares"),
        *(F.sum(f).alias(f"{name}_sum") for name, f in found.items()), *(F.sum(f * f / rows).alias(f"{name}_within") for name, f in found.items()),
    ).first()

    def refused(name: str) -> Column:
        k, n, total, own = (moments[x] or 0 for x in ("hosts", "rows", f"{name}_sum", f"{name}_within"))
        mean, strength = total / n if n else 0.0, PRIOR_ROWS
        if 1 < k < n:
            size = (n - moments["squares"] / n) / (k - 1)
            between, within = (own - total * mean) / (k - 1), (total - own) / (n - k)
            spread = between + (size - 1) * within
            rho = (between - within) / spread if spread > 0 else 0.0
            strength = 1 / rho - 1 if rho > 0 else PRIOR_ROWS
        return (F.col(f"_{name}") + mean * strength) / (F.col("_rows") + strength) > max_rate

    any_rule = reduce(lambda a, b: a | b, (refused(name) for name in rules))
    return hosts.select("_host", any_rule.alias("_refused")), moments["size"] or 0


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, base_failed and kept of every row; see ``text_measures`` and ``host_verdicts``.

    A row is kept if it does not fail a base rule (under 50 words, or more than half of
    its words in repeated windows) and its host is not refused.

    Defined results: a missing text has no words and fails; rows without a host form one
    host; repeated rows are judged alike and all count for their host; an empty table
    gives an empty one.
    """
    narrow = docs.select(F.col(key).alias(key), F.col(host).alias("_source"), F.col(text).alias("_text"))
    measured = written(text_measures(narrow, "_text").drop("_text"), "quality-measures")
    rules = failures()
    verdicts, size = host_verdicts(measured, "_source", max_rate)
    joined = small_join(measured, verdicts, F.col("_source").cast("string").eqNullSafe(F.col("_host")), size, "left")
    failed = rules["few_words"] | rules["repeats"]
    return joined.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~F.col("_refused")).alias("kept"), F.col("_source").alias("host"),
    )
