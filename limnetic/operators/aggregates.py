"""Aggregate expressions whose treatment of missing values is stated."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .joins import natural_join


def strict(fn: Callable[[Column], Column], x: Column) -> Column:
    """``fn(x)``, but NULL as soon as one value of the group is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), fn(x))


def rows() -> Column:
    return F.count(F.lit(1))


def n_distinct(*cols: Column) -> Column:
    """Distinct combinations, a missing value being a value of its own."""
    return F.count_distinct(F.struct(*cols))


def n_distinct_where(cond: Column, *cols: Column) -> Column:
    return F.count_distinct(F.when(cond, F.struct(*cols)))


def sum_where(cond: Column, x: Column) -> Column:
    """Sum over the rows that meet ``cond``; 0 when none does."""
    return F.coalesce(F.sum(F.when(cond, x)), F.lit(0))


def standard_error(x: Column) -> Column:
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))


def length_statistics(x: str, median: bool = True) -> list[Column]:
    """Count, range, mean, median, SD and SE of one measured length.

    Lengths are read to the millimetre, so the exact median keeps only a small
    table of counts per group. For continuous values use ``group_median``.
    """
    c = F.col(x)
    out = [
        rows().alias("n"),
        F.min(c).alias("min_length"),
        F.max(c).alias("max_length"),
        F.avg(c).alias("mean_length"),
        F.stddev_samp(c).alias("sd_length"),
        F.try_divide(F.stddev_samp(c), F.sqrt(rows())).alias("se_length"),
    ]
    return out + ([F.median(c).alias("median_length")] if median else [])


# A sketch's rank is off by this share of the rows at most.
RANK_ERROR = 1e-4


def median_sketch(x: str, rank_error: float = RANK_ERROR) -> Column:
    """A value whose rank is within ``rank_error`` of the rows of the middle.

    Summaries of quantiles are built beside the rows and merged, so a group costs a bounded
    buffer however many distinct values it has. A group of fewer than 1 / ``rank_error``
    rows has its lower median exactly.
    """
    return F.percentile_approx(F.col(x), 0.5, math.ceil(1 / rank_error))


def sketch_ranks(df: DataFrame, keys: Sequence[str], x: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """``median_sketch`` of each group, with its measured error.

    n, median, and rank_error: how far the middle is from the ranks that the value holds, as
    a share of the rows (0 for a median). Missing values are left out.
    """
    used = df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    sketch = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), median_sketch("_x", rank_error).alias("median"))
    placed = natural_join(used, sketch, "left", keys)
    ranks = placed.groupBy(*keys, "n", "median").agg(
        F.count_if(F.col("_x") < F.col("median")).alias("_below"), F.count_if(F.col("_x") <= F.col("median")).alias("_upto")
    )
    off = F.greatest(F.col("_below") - F.col("n") / 2, F.col("n") / 2 - F.col("_upto"), F.lit(0.0)) / F.col("n")
    return ranks.select(*keys, "n", "median", off.alias("rank_error"))


def share_within(
    df: DataFrame, within: Sequence[str], part: Sequence[str], weight: Column | None = None
) -> DataFrame:
    """Count per (within, part), its share of the ``within`` total and a percent label.

    The window runs over the counted table, one row per category.
    """
    measure = F.sum(weight) if weight is not None else rows()
    counted = df.groupBy(*within, *part).agg(measure.alias("n"))
    share = F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*within)))
    return counted.withColumn("share", share).withColumn(
        "label", F.concat(F.round((share * 100).cast("decimal(28,10)"), 1).cast("string"), F.lit("%"))
    )
