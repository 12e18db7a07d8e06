"""Joins on all shared columns, where a missing key matches a missing key.

A side is broadcast by hint only where its row count has a bound that does not
grow with the data (calendar days, fixed code lists, hot keys). Otherwise Spark
broadcasts what it measures to be small, and shuffles the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import first_per_key


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    keys: Sequence[str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Join on every column name the two sides share.

    ``keys`` states the names the caller expects; a table that gained or lost
    a shared column then fails at once instead of changing the result.
    ``bounded`` says that the right side holds one row per calendar unit or per
    code of a fixed list, however large the data: it is then broadcast.
    """
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("the tables share no column")
    if keys is not None and set(keys) != set(shared):
        raise ValueError(f"expected to join on {sorted(keys)}, tables share {sorted(shared)}")
    l, r = left.alias("l"), (F.broadcast(right) if bounded else right).alias("r")
    same = " AND ".join(f"l.`{c}` <=> r.`{c}`" for c in shared)
    key_side = "r" if how == "right" else "l"
    out = [f"{key_side if c in shared else 'l'}.`{c}`" for c in left.columns]
    out += [f"r.`{c}`" for c in right.columns if c not in shared]
    return l.join(r, F.expr(same), how).selectExpr(*out)


def lookup_join(left: DataFrame, dim: DataFrame, key: str, *columns: str) -> DataFrame:
    """Add columns of a lookup table that holds one row per key."""
    return left.join(dim.select(key, *columns), key, "left")


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Natural join of many left rows to one right row per key.

    Hot keys are split by adaptive execution (``session.tune``): a task's share of the
    left rows is cut by size, equal rows too, and the right row is read by every part.
    Nothing is counted beforehand, so both sides are computed once.
    """
    return natural_join(left, right, how, [key])


def join_chain(first: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left joins one after the other; give each input already aggregated."""
    return reduce(lambda a, b: natural_join(a, b, "left", keys), others, first)


def with_group_size(
    df: DataFrame, keys: Sequence[str], name: str = "n", bounded: bool = False
) -> DataFrame:
    """Rows per group beside every row.

    The counts are made with map-side combine and joined back, so a group that
    holds a large share of the rows is never gathered in one task. Groups of a
    fixed code list are ``bounded``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return natural_join(df, sizes, "left", keys, bounded)


def join_first(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Left join to the first right row per key; keeps the left row count."""
    return natural_join(left, first_per_key(right, keys, order), "left", keys)


def aggregate_with_first(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], order: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Aggregates per key together with the attributes of the key's first row.

    One grouped pass in place of an aggregate joined back to its own input.
    """
    first = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_first")
    out = df.groupBy(*keys).agg(*aggs, first)
    rest = [c for c in out.columns if c != "_first"]
    return out.select(*rest, *[F.col(f"_first.`{c}`").alias(c) for c in keep])
