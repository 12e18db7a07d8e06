"""A closure per group that returns a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group through a grouped map function.

    Rows are first reduced to one weighted cell per distinct x (a calendar day),
    so what a group hands to Python is bounded by the calendar, not by its rows.
    """
    cells = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"))
        .agg(F.count(y).alias("w"), F.sum(F.col(y).cast("double")).alias("sy"))
    )
    schema = cells.select(*keys).schema
    schema = schema.add("n", T.LongType()).add("intercept", T.DoubleType()).add("slope", T.DoubleType())

    def line(group: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        w, x_, sy = (cell[c].to_numpy(float) for c in ("w", "x", "sy"))
        mean_x, mean_y = np.average(x_, weights=w), sy.sum() / w.sum()
        sxx = (w * (x_ - mean_x) ** 2).sum()
        slope = ((x_ - mean_x) * (sy - w * mean_y)).sum() / sxx if sxx > 0 else None
        intercept = None if slope is None else mean_y - slope * mean_x
        return pd.DataFrame([[*group, int(w.sum()), intercept, slope]], columns=schema.names)

    return cells.groupBy(*keys).applyInPandas(line, schema)
