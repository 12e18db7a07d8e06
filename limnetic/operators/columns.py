"""Column selection and column-wise edits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_positions(df: DataFrame, *positions: int | tuple[int, int]) -> DataFrame:
    """Columns by 1-based position; a pair is an inclusive range."""
    names: list[str] = []
    for p in positions:
        first, last = p if isinstance(p, tuple) else (p, p)
        names += df.columns[first - 1 : last]
    return df.select(*names)


def across(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """The same function over many columns, in place."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def level_number(value: Column, levels: Sequence[str]) -> Column:
    """Position of a value in its level order; NULL when it is no level."""
    found = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.nullif(found, F.lit(0)).cast("int")


def with_levels(df: DataFrame, column: str, levels: Sequence[str], number: str) -> DataFrame:
    """Keep only known labels and add their order beside them."""
    known = F.when(F.col(column).isin(*levels), F.col(column))
    return df.withColumns({number: level_number(F.col(column), levels), column: known})


def fill_missing_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become 0 and missing text becomes "0"."""
    subset = list(columns) if columns else None
    return df.fillna(0, subset).fillna("0", subset)
