"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnetic.session import tune
from limnetic.sources.survey import TABLES, VIEWS, Survey

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Named steps that SQL counterparts share; filled by ``step``.
STEPS: dict[str, str] = {
    name: text.format(**{t: t for t in TABLES}) for name, text in VIEWS.items()
}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql


def _rounding(sql: str) -> str:
    """``R4(x)``: x rounded to 4 places through DECIMAL, as a double."""
    found = re.search(r"\bR(\d)\(", sql)
    if not found:
        return sql
    depth, i = 1, found.end()
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[i], 0)
        i += 1
    inner = f"CAST(round(CAST(({sql[found.end():i - 1]}) AS DECIMAL(28,10)), {found[1]}) AS DOUBLE)"
    return _rounding(sql[: found.start()] + inner + sql[i:])


def oracle(body: str) -> str:
    """The body with the steps it names, directly or not, as leading CTEs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[vo]_\w+", text)):
            if name in STEPS and name not in order:
                need(STEPS[name])
                order.append(name)

    need(body)
    ctes = ",\n".join(f"{name} AS (\n{STEPS[name]}\n)" for name in order)
    return _rounding(f"WITH {ctes}\n{body.strip()}" if ctes else body.strip())


def query(key: str, sql: str | None = None):
    def add(fn: Callable[[Survey], DataFrame]):
        QUERIES[key] = lambda spark, root: fn(Survey(tune(spark), root))
        if sql:
            ORACLES[key] = oracle(sql)
        return fn

    return add


def fixed(x: Column | str, digits: int = 4) -> Column:
    """Rounded through DECIMAL, so that the order of summation cannot show."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def fix(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """``fixed`` over the named columns, or over all doubles."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: fixed(F.col(f"`{n}`"), digits) for n in names})
