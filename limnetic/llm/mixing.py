"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.llm.common import free_names, hashed, small_join
from limnetic.session import written

# A mean above this is drawn as a sum of independent draws, each of a mean up to this.
PART_MEAN = 16.0
# P(X > 96) for a mean of 16 is far below the spacing of the uniform draws.
LAST_COUNT = 96
UNIT = float(1 << 52)


def source_rates(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, total: float | None = None,
    source: str = "source",
) -> tuple[DataFrame, int]:
    """Repetition rate of each source, and the bytes of that table.

    A source's rate is ``total * weight / sum of weights / rows of the source``, the sum
    taken over the sources that occur; ``total`` is the number of rows unless given. A
    source without a stated weight, and rows without a source, have ``default_weight``.
    """
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counted = written(
        docs.groupBy(F.col(source).cast("string").alias("_source")).agg(F.count("*").alias("_rows")).withColumn("_weight", weight),
        "mixing-sources",
    )
    sums = counted.agg(
        F.sum("_weight").alias("w"), F.sum("_rows").alias("n"),
        F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 32 + 8 * (LAST_COUNT + 1)).alias("size"),
    ).first()
    if not sums["n"] or not sums["w"]:
        return counted.withColumn("_rate", F.lit(0.0)), 0
    wanted = float(sums["n"] if total is None else total)
    rate = F.lit(wanted) * F.col("_weight") / F.lit(float(sums["w"])) / F.col("_rows")
    return counted.withColumn("_rate", rate), sums["size"]


def poisson_table(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... ``LAST_COUNT``."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LAST_COUNT)), start, step, lambda acc: acc["c"])


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, total: float | None = None,
    seed: int = 1, key: str = "doc_id", source: str = "source", copy: str = "copy", order: str = "shuffle_key",
) -> DataFrame:
    """Repeat every document by a Poisson draw so that sources reach target weights, in random order.

    The draw inverts the Poisson distribution at a uniform number hashed from seed, key
    and part, so it does not depend on partitioning or on retries. All columns of ``docs``
    stay; ``copy`` numbers the copies of a row from 1 and ``order`` is the hash by which
    rows are dealt to partitions and sorted inside them.

    Defined results: rows without a source form a source of their own; rows without a
    key share one draw, as do repeated rows of one key; a weight of 0 leaves a source out;
    an empty table gives an empty one; texts are not read. Input columns named like
    ``copy`` or ``order`` are replaced.
    """
    docs = docs.drop(copy, order)
    rates, size = source_rates(docs, weights, default_weight, total, source)
    # Beside the columns of the rows.
    name, parts, points, count = free_names([*docs.columns, copy, order], "_source", "_parts", "_table", "_count")
    rates = rates.withColumn("_parts", F.ceil(F.col("_rate") / PART_MEAN).cast("int")).where("_parts > 0").select(
        F.col("_source").alias(name), F.col("_parts").alias(parts),
        poisson_table(F.col("_rate") / F.greatest(F.col("_parts"), F.lit(1))).alias(points),
    )
    joined = small_join(docs, rates, F.col(source).cast("string").eqNullSafe(F.col(name)), size, "inner")

    def draw(part: Column) -> Column:
        u = (hashed(f"mix-{seed}", F.col(key), part) + 0.5) / F.lit(UNIT)
        return F.size(F.filter(points, lambda c: c <= u))

    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, part: n + draw(part))
    repeated = (
        joined.withColumn(count, drawn).where(F.col(count) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
        .drop(name, parts, points, count)
        .withColumn(order, hashed(f"order-{seed}", F.col(key), F.col(copy), digits=15))
    )
    return repeated.repartition(order).sortWithinPartitions(order, key, copy)
