"""Secret scans with an incremental ledger of content-addressed texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic.llm.common import whole

# Kind, pattern, least characters of the counted part, and the group counted.
# The first three are the base; the others are added by this scanner.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    ("jwt", r"[A-Za-z0-9_.-]{29,}", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
)
BASE = ("assign", "access", "hex")
# What a whole match must look like beyond its rule's pattern, and what a text must have for the rule to be tried.
# Runs are matched in full first: a pattern that could start anywhere in one would read it again from each place.
WHOLE = {"jwt": r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.*$"}
HINT = {"jwt": "eyJ"}
# To be raised whenever RULES changes: texts are then scanned again.
RULE_VERSION = 2

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule_version", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))])


def running_sums(values: Column) -> Column:
    """Sums of an array up to each element, by chunks of about the root of its length.

    Built-in functions can only append to an array by copying it; in chunks, a text with
    n matches copies n * sqrt(n) numbers at most.
    """
    none = F.array().cast(T.ArrayType(T.IntegerType()))

    def sums(chunk: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + x
            return F.struct(at.alias("at"), F.concat(acc["sums"], F.array(at)).alias("sums"))

        return F.aggregate(chunk, F.struct(start.alias("at"), none.alias("sums")), add, lambda acc: acc["sums"])

    def chunked(v: Column) -> Column:
        n = F.size(v)
        step = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda c: F.slice(v, c * step + 1, step))

    def summed(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        starts = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), sums))

    # A bound value is computed once, where a column would be computed anew in every place that names it.
    every = bound(values, lambda v: F.when(F.size(v) > 0, bound(chunked(v), summed)).otherwise(none))
    return F.coalesce(every, none)


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def kind_spans(text: Column, rank: int) -> Column:
    """Spans of one rule's matches, in code points with the end exclusive, leftmost and not overlapping.

    Consecutive pairs of (gap, match) cover the text from its start, so that the lengths
    of both, summed, are the positions. Each pair begins where the last one ended, so
    that what follows the last match is read once.
    """
    kind, pattern, least, group = RULES[rank]
    pair = rf"(?s)\G(.*?)({pattern})"
    gaps, found = (F.regexp_extract_all(text, F.lit(pair), F.lit(g)) for g in (1, 2))
    counted = found if not group else F.regexp_extract_all(text, F.lit(pair), F.lit(2 + group))
    ends = running_sums(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
    right = lambda m: F.regexp_like(m, F.lit(WHOLE[kind])) if kind in WHOLE else F.lit(True)
    kept = F.zip_with(found, counted, lambda m, c: F.when((F.length(c) >= least) & right(m), F.length(m)))
    spans = F.zip_with(
        ends, kept, lambda e, size: F.when(size.isNotNull(), F.struct((e - size).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end")))
    )
    none = F.array().cast(T.ArrayType(SPAN))
    tried = F.contains(text, F.lit(HINT[kind])) if kind in HINT else F.regexp_like(text, F.lit(pattern))
    return F.when(tried, F.filter(spans, lambda s: s.isNotNull()).cast(T.ArrayType(SPAN))).otherwise(none)


def scanned(blobs: DataFrame) -> DataFrame:
    """blob, rule_version and all spans of the texts in ``clean``, ordered by start and kind."""
    every = F.concat(*(kind_spans(F.col("clean"), r) for r in range(len(RULES))))
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), F.sort_array(every).cast(T.ArrayType(SPAN)).alias("spans"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(ledger) if there else spark.createDataFrame([], LEDGER)


def scan_secrets(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of every historical version of every path: path, blob and spans.

    A version's text is addressed by its SHA-256. Only pairs of text and rule version that
    the ledger (a Parquet folder) lacks are scanned, and then added to it; findings are
    joined back to all paths. Equal texts are scanned once.

    Defined results: a missing text is empty and has no findings; a row without a path is
    kept; repeated rows repeat; an empty table gives an empty one. Spans are structs
    (start, rank, kind, end).
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), whole(text).alias("clean")).withColumn("blob", F.sha2("clean", 256))
    blobs = rows.groupBy("blob", "clean").agg(F.lit(1).alias("one"))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == RULE_VERSION).select("blob")
    scanned(blobs.join(seen, "blob", "left_anti")).write.mode("append").parquet(ledger)
    found = read_ledger(spark, ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    # A ledger written twice for one text, by a job that was repeated, counts once.
    found = found.groupBy("blob").agg(F.max("spans").alias("spans"))
    joined = rows.select("path", "blob").join(found, "blob", "left")
    return joined.select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
