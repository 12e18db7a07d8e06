"""Running sums, row numbers and exact medians that no hot group can clog.

A running sum over a sorted group normally puts the whole group into one task.
Here the rows are range-partitioned on (group, order value), which cuts a large
group into several blocks whatever its distribution. Each block is summed, the
few block sums of a group are accumulated, and rows are only sorted within
their block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnetic.session import written

from .joins import natural_join


# Bytes of input that one block stands for at most.
BLOCK_BYTES = 256 << 20


def block_count(df: DataFrame) -> int:
    """Blocks in proportion to the files that ``df`` reads, and as many as a shuffle has at least.

    Sources of unknown size, which Spark takes for as large as can be, do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))


def prefix_sums(
    cells: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]
) -> DataFrame:
    """Add ``cum_<measure>``, the running sum up to each row, and ``total_<measure>``.

    ``cells`` holds one row per (keys, order). The blocks are written once, so
    that every later step sees the same cut even if an executor is lost.
    """
    return placed_sums(cells, keys, order, measures)[1]


def placed_sums(
    cells: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """``cells`` as they are written for ``prefix_sums``, and its result."""
    columns, keys = cells.columns, list(keys)
    ranged = cells.repartitionByRange(block_count(cells), *keys, order)
    placed = written(ranged.withColumn("_block", F.spark_partition_id()), "blocks")

    sums = placed.groupBy(*keys, "_block").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    group = W.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(group).alias(f"total_{m}") for m in measures],
    )
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = natural_join(placed, offsets, "left", [*keys, "_block"])
    out = joined.withColumns(
        {f"cum_{m}": F.col(f"_off_{m}") + F.sum(m).over(inside) for m in measures}
    )
    return placed.select(*columns), out.drop("_block", *[f"_off_{m}" for m in measures])


def group_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", weight: str | None = None
) -> DataFrame:
    """Exact median per group (mean of the two middle values) of a continuous value.

    Equal values are counted first; ``weight`` is a row's multiplicity.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    counted = (
        df.filter(F.col(value).isNotNull() & (w > 0))
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.sum(w).alias("_w"))
    )
    ranked = prefix_sums(counted, keys, "_v", ["_w"])
    upto, since = F.col("cum__w"), F.col("cum__w") - F.col("_w")
    low = F.floor((F.col("total__w") + 1) / 2)
    high = F.floor(F.col("total__w") / 2) + 1
    middle = ranked.filter((since < high) & (upto >= low))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(out))


def numbered(
    df: DataFrame, levels: Sequence[str], order: Sequence[str | Column] = (), out: str = "id"
) -> DataFrame:
    """Row numbers 1..n in the order of ``levels``, then of ``order``, missing values first.

    The rows are range-partitioned on the whole order and sorted inside their part, which
    is written once; the rows of the parts before, one number for each part, are added.
    """
    by = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in (*levels, *order)]
    ranged = df.repartitionByRange(block_count(df), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    numbers = {"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}
    placed = written(ranged.withColumns(numbers), "numbered")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")
    offsets = F.broadcast(parts.select("_part", before.alias("_before")))
    found = placed.join(offsets, "_part").withColumn(out, F.col("_before") + F.col("_place") + 1)
    return found.drop("_part", "_place", "_before")


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Cumulative sum over calendar days; a missing value voids the rest of its group.

    Give one row per (keys, day): a group is then at most a year of days.
    """
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    gaps = F.sum(F.col(value).isNull().cast("int")).over(upto)
    return df.withColumn(out, F.when(gaps == 0, F.sum(value).over(upto)))


def with_overall_mean(df: DataFrame, value: str, out: str) -> DataFrame:
    """The mean over all rows beside every row, as a scalar subquery."""
    return df.withColumn(out, df.agg(F.avg(value)).scalar())
