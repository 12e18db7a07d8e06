"""First rows, pivots, unpivots, appends and row expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the order of ``order``, then of all other columns.

    Missing values come first. The smallest row is found by a grouped minimum,
    which combines on the map side; no task sorts a whole group.
    """
    rest = list(dict.fromkeys([c for c in order if c not in keys] + df.columns))
    rest = [c for c in rest if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.expr("min(struct(" + ", ".join(f"`{c}`" for c in rest) + "))")
    low = df.groupBy(*keys).agg(row.alias("_row"))
    return low.selectExpr(*[f"`{c}`" if c in keys else f"_row.`{c}` AS `{c}`" for c in df.columns])


def pivot_counts(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence, weight: str | None = None
) -> DataFrame:
    """Counts per id and category, one column per category, 0 where there are none.

    ``weight`` holds row multiplicities of input that is already aggregated.
    The categories being given, one grouped pass of conditional sums does it.
    """
    one = F.col(weight) if weight else F.lit(1)
    cells = [F.coalesce(F.sum(F.when(F.col(name) == v, one)), F.lit(0)).alias(str(v)) for v in values]
    return df.groupBy(*ids).agg(*cells)


def pivot_values(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence, measure: str
) -> DataFrame:
    """One column per category; NULL where the category is absent."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(F.first(measure))


def pivot_many(
    df: DataFrame, ids: Sequence[str], name: str, values: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Several measures at once; columns are named ``measure_category``."""
    wide = df.groupBy(*ids).pivot(name, list(values)).agg(*[F.first(m).alias(m) for m in measures])
    renamed = {f"{v}_{m}": f"{m}_{v}" for m in measures for v in values}
    order = [f"{m}_{v}" for m in measures for v in values]
    return wide.withColumnsRenamed(renamed).select(*ids, *order)


def unpivot_long(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str,
    value: str,
    key: Column | None = None,
) -> DataFrame:
    """Wide to long; NULL values stay, ``key`` recasts the name column."""
    long = df.unpivot(list(ids), list(columns), name, value)
    return long.withColumn(name, key) if key is not None else long


def expand_rows(df: DataFrame, count: str) -> DataFrame:
    """Repeat each row ``count`` times; rows with no positive count vanish."""
    copies = F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy")
    return df.filter(F.col(count) > 0).select("*", copies).drop("copy")


def shares(df: DataFrame, ids: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Share of each part in its row's total, long form; NULL where the total is 0."""
    total = sum((F.col(f"`{p}`") for p in parts[1:]), F.col(f"`{parts[0]}`"))
    wide = df.select(*ids, *[F.try_divide(F.col(f"`{p}`"), total).alias(p) for p in parts])
    return wide.unpivot(list(ids), list(parts), "part", "share")
