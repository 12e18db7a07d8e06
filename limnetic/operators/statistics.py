"""Regression, analysis of variance and intervals from grouped moments.

The data is read once with map-side combine; what follows works on one row per
group (or per group and level).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnetic.functions.dist import p_from_f, p_from_q, p_from_t, q_critical, stars, t975
from limnetic.functions.scalars import half_even, united

from limnetic.session import written

from .joins import natural_join


def ols(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Least-squares line per group."""
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
    )


def growth_label(df: DataFrame, group: str, slope: str = "slope") -> DataFrame:
    """``slope`` rounded half-even to 2 digits and the text "group, slope mm per day"."""
    rounded = half_even(F.col(slope), 2)
    shown = F.regexp_replace(rounded.cast("string"), r"\.?0+$", "")
    legend = united(" ", united(", ", F.col(group), shown), F.lit("mm per day"))
    return df.withColumns({"legend": legend, slope: rounded.cast("double")})


def regression_summary(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Coefficients with standard errors and t, R squared and the F statistic."""
    m = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_avgx(y, x).alias("mean_x"),
    )
    c = F.col
    m = m.withColumns(
        {"df": c("n") - 2, "ssr": F.try_divide(c("sxy") * c("sxy"), c("sxx"))}
    ).withColumn("mse", F.when(c("df") > 0, F.try_divide(c("syy") - c("ssr"), c("df"))))
    m = m.withColumns(
        {
            "slope_se": F.sqrt(F.try_divide(c("mse"), c("sxx"))),
            "intercept_se": F.sqrt(
                c("mse")
                * (F.try_divide(F.lit(1.0), c("n")) + F.try_divide(c("mean_x") * c("mean_x"), c("sxx")))
            ),
            "r_squared": F.try_divide(c("ssr"), c("syy")),
            "f": F.try_divide(c("ssr"), c("mse")),
        }
    )
    m = m.withColumns(
        {
            "slope_t": F.try_divide(c("slope"), c("slope_se")),
            "intercept_t": F.try_divide(c("intercept"), c("intercept_se")),
            "adj_r_squared": 1 - (1 - c("r_squared")) * F.try_divide(c("n") - 1, c("df")),
        }
    )
    return m.select(
        *keys, "n", "df", "intercept", "intercept_se", "intercept_t",
        "slope", "slope_se", "slope_t", "r_squared", "adj_r_squared", "f",
    )


def with_regression_p(summary: DataFrame) -> DataFrame:
    return summary.withColumns(
        {
            "slope_p": p_from_t("slope_t", "df"),
            "intercept_p": p_from_t("intercept_t", "df"),
            "f_p": p_from_f("f", F.lit(1.0), "df"),
        }
    )


def level_cells(df: DataFrame, keys: Sequence[str], factor: str, y: str) -> DataFrame:
    """Count, mean and within-level sum of squares per (group, level)."""
    return (
        df.filter(F.col(y).isNotNull() & F.col(factor).isNotNull())
        .groupBy(*keys, F.col(factor).alias("level"))
        .agg(
            F.count(y).alias("n"),
            F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(y)).alias("ss"),
        )
    )


def anova_oneway(df: DataFrame, keys: Sequence[str], factor: str, y: str) -> DataFrame:
    """One-way analysis of variance per group, with generalised eta squared."""
    cells = level_cells(df, keys, factor, y)
    group = W.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    c = F.col
    out = (
        cells.withColumn("grand", grand)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            (F.count("level") - 1).alias("dfn"),
            (F.sum("n") - F.count("level")).alias("dfd"),
            F.sum(c("n") * (c("mean") - c("grand")) * (c("mean") - c("grand"))).alias("ssb"),
            F.sum("ss").alias("ssw"),
        )
    )
    msb = F.try_divide(c("ssb"), c("dfn"))
    msw = F.try_divide(c("ssw"), c("dfd"))
    return out.select(
        *keys, "n", "dfn", "dfd",
        F.try_divide(msb, msw).alias("f"),
        F.try_divide(c("ssb"), c("ssb") + c("ssw")).alias("ges"),
    )


def anova_numeric(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """One-degree F test of a numeric predictor per group."""
    m = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_syy(y, x).alias("syy"),
    )
    c = F.col
    ssr = F.try_divide(c("sxy") * c("sxy"), c("sxx"))
    m = m.withColumns({"dfn": F.lit(1).cast("bigint"), "dfd": c("n") - 2, "ssr": ssr})
    mse = F.when(c("dfd") > 0, F.try_divide(c("syy") - c("ssr"), c("dfd")))
    return m.select(
        *keys, "n", "dfn", "dfd",
        F.try_divide(c("ssr"), mse).alias("f"),
        F.try_divide(c("ssr"), c("syy")).alias("ges"),
    )


def with_f_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p", p_from_f("f", "dfn", "dfd")).withColumn("signif", stars(F.col("p")))


def tukey_pairs(df: DataFrame, keys: Sequence[str], factor: str, y: str) -> DataFrame:
    """Differences between the level means of each group, with SE, q and df.

    The pairing is between levels (months, years), not rows; the few level rows
    are written once for its two sides.
    """
    cells = written(level_cells(df, keys, factor, y), "cells")
    group = W.partitionBy(*keys)
    cells = cells.withColumns(
        {
            "levels": F.count(F.lit(1)).over(group),
            "df": (F.sum("n").over(group) - F.count(F.lit(1)).over(group)),
            "ssw": F.sum("ss").over(group),
        }
    )
    a = cells.select(
        *keys, "levels", "df", "ssw",
        F.col("level").alias("group1"), F.col("n").alias("n1"), F.col("mean").alias("mean1"),
    )
    b = cells.select(
        *keys, F.col("level").alias("group2"), F.col("n").alias("n2"), F.col("mean").alias("mean2")
    )
    pairs = a.join(b, [*keys]) if keys else a.withColumn("_g", F.lit(0)).join(b.withColumn("_g", F.lit(0)), "_g")
    c = F.col
    pairs = pairs.filter(c("group1") < c("group2"))
    se = F.sqrt(F.try_divide(c("ssw"), c("df")) / 2 * (1.0 / c("n1") + 1.0 / c("n2")))
    pairs = pairs.withColumns({"estimate": c("mean2") - c("mean1"), "se": se})
    return pairs.select(
        *keys, "group1", "group2", "levels", "df", "estimate", "se",
        F.try_divide(F.abs("estimate"), c("se")).alias("q"),
    )


def with_tukey_p(pairs: DataFrame) -> DataFrame:
    """Adjusted p, 95 % interval and marks for the rows of ``tukey_pairs``."""
    half = q_critical(F.col("levels"), F.col("df")) * F.col("se")
    return (
        pairs.withColumn("p_adj", p_from_q("q", "levels", "df"))
        .withColumn("_half", half)
        .withColumns(
            {
                "conf_low": F.col("estimate") - F.col("_half"),
                "conf_high": F.col("estimate") + F.col("_half"),
                "signif": stars(F.col("p_adj")),
            }
        )
        .drop("_half")
    )


def mean_ci_normal(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """Mean and its 95 % t interval; one value alone has no bounds."""
    m = df.groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd")
    )
    half = t975(F.col("n") - 1) * F.try_divide(F.col("sd"), F.sqrt("n"))
    return m.select(
        *keys, "n", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper")
    )


# Cells of a resample's tree are told apart by so many bits of their hash; alike ones are split in order of value.
TREE_BITS = 32
# Bits by which nodes that hold more cells than a task splits at once are divided.
FAN_BITS, NODE_CELLS = 8, 4096
# Counts further from the mean than so many standard deviations, and as many more, are not tried.
FAR = 9.0
# Chances of counts that a task holds at once.
COUNTS_AT_ONCE = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit mix, in 64-bit numbers."""
    mask = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & mask
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & mask
    return x ^ (x >> np.uint64(16))


def uniforms(text: str, reps: int) -> np.ndarray:
    """A uniform number of 48 bits for each replicate, from the md5 of a text."""
    seeds = hashlib.md5(text.encode()).hexdigest()
    rep = np.arange(reps, dtype=np.uint64) * np.uint64(0x9E3779B9) & np.uint64(0xFFFFFFFF)
    high, low = (_mixed(np.uint64(int(seeds[i : i + 8], 16)) ^ rep) for i in (0, 8))
    return ((high << np.uint64(16) | low >> np.uint64(16)).astype(float) + 0.5) / float(1 << 48)


def binomials(draws: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each number of draws, the binomial number at the uniform number beside it.

    Chances follow from one another by a product, from the least count that is tried on, so
    a count costs a few operations; some numbers of draws are done at once.
    """
    out = np.zeros(len(draws), np.int64)
    order = np.argsort(draws, kind="stable")
    n, first = np.unique(draws[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    mean, spread = n * p, np.sqrt(n * p * (1 - p))
    low = np.maximum(0, np.floor(mean - FAR * spread - FAR)).astype(np.int64)
    high = np.minimum(n, np.ceil(mean + FAR * spread + FAR)).astype(np.int64)
    odds = p / (1 - p)
    a = 0
    while a < len(n):
        width = int((high[a:] - low[a:]).max()) + 1
        b = min(len(n), a + max(1, COUNTS_AT_ONCE // width))
        steps = np.arange(1, width)
        k = low[a:b, None] + steps
        chance = np.ones((b - a, width))
        chance[:, 1:] = np.where(k <= high[a:b, None], (n[a:b, None] - k + 1) / k * odds, 0.0)
        below = np.cumsum(np.cumprod(chance, 1), 1)
        for i in range(a, b):
            here = order[cuts[i] : cuts[i + 1]]
            at = np.searchsorted(below[i - a], u[here] * below[i - a, -1], "right")
            out[here] = np.minimum(low[i] + at, high[i])
        a = b
    return out


def split_draws(group: str, draws: np.ndarray, hashes: np.ndarray, counts: np.ndarray, values: np.ndarray, depth: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Deal ``draws`` (one number for each replicate) out to cells: (place of the cell, its draws).

    The cells hang in a binary tree by the bits of their hashes, from ``depth`` on. A node's
    draws go left by a binomial number whose chance is the left cells' share of the rows, so
    that the draws of all cells of a replicate sum up to what came in.
    """
    order = np.lexsort((values, hashes))
    stack = [(0, len(order), depth, draws)]
    while stack:
        a, b, bit, own = stack.pop()
        if b - a == 1:
            yield int(order[a]), own
            continue
        if bit < TREE_BITS:
            ones = hashes[order[a:b]] >> np.uint64(TREE_BITS - 1 - bit) & np.uint64(1)
            middle = a + int(np.searchsorted(ones, 1))
            name = f"{group}|{bit}|{int(hashes[order[a]]) >> (TREE_BITS - bit)}"
        else:
            middle, name = a + 1, f"{group}|{bit}|{int(hashes[order[a]])}|{b - a}"
        if middle in (a, b):
            stack.append((a, b, bit + 1, own))
            continue
        left = int(counts[order[a:middle]].sum())
        taken = binomials(own, left / (left + int(counts[order[middle:b]].sum())), uniforms(name, len(own)))
        stack += [(middle, b, bit + 1, own - taken), (a, middle, bit + 1, taken)]


def mean_ci_boot(df: DataFrame, keys: Sequence[str], y: str, reps: int = 1000) -> DataFrame:
    """Mean and bootstrap 95 % interval from resamples of exactly as many rows as the group has.

    Equal values of a group are counted first. The draws of all replicates are dealt out
    over a tree of the counted values' hashes by binomial numbers (``split_draws``), so they
    sum up to the group's rows without a row being drawn or moved. A node of more than
    ``NODE_CELLS`` values is divided by the next bits first, level by level, and its parts
    are other tasks' work; a task hands on one sum for each replicate. The numbers are hashes
    of group, node and replicate: they depend neither on partitions nor on retries.
    """
    keys = list(keys)
    c = F.col
    base = df.filter(c(y).isNotNull()).select(*keys, c(y).cast("double").alias("_y"))
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    cells = base.groupBy(*keys, "_y").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("_group", name).withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", "_group", c("_y").cast("string"))), 1, 8), 16, 10).cast("bigint"))
    cells = written(cells, "cells")
    plain = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum(c("_n") * c("_y")) / F.sum("_n")).alias("mean"))

    # Nodes by their first bits, with the draws of each replicate; a node without draws stands for the whole group.
    widest = cells.groupBy("_group").count().agg(F.max("count")).first()[0] or 0
    node = lambda bits: F.shiftright(c("_h"), TREE_BITS - bits)
    nodes = cells.groupBy("_group").agg(F.sum("_n").alias("_rows")).withColumns({"_node": F.lit(0).cast("bigint"), "_draws": F.array_repeat(c("_rows"), reps)})
    bits = 0
    while widest >> bits > NODE_CELLS and bits + FAN_BITS <= TREE_BITS:
        below = bits + FAN_BITS
        parts = cells.groupBy("_group", node(bits).alias("_node"), node(below).alias("_part")).agg(F.sum("_n").alias("_n"))
        nodes = written(_dealt(nodes, parts, bits, below, reps), "nodes")
        bits = below
    leaves = cells.select("_group", node(bits).alias("_node"), "_h", "_n", "_y")

    def sums(key: tuple, cell: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(reps)
        h, n, v = cell["_h"].to_numpy(np.uint64), cell["_n"].to_numpy(np.int64), cell["_y"].to_numpy(float)
        own = np.array(drawn["_draws"].iloc[0], np.int64)
        for at, taken in split_draws(key[0], own, h, n, v, bits):
            total += taken * v[at]
        return pd.DataFrame({"_group": [key[0]], "_sums": [total.tolist()]})

    by = ["_group", "_node"]
    found = leaves.groupBy(*by).cogroup(nodes.select(*by, "_draws").groupBy(*by)).applyInPandas(sums, "_group string, _sums array<double>")
    found = found.select("_group", F.posexplode("_sums").alias("_rep", "_s")).groupBy("_group", "_rep").agg(F.sum("_s").alias("_s"))
    names = cells.groupBy("_group").agg(*[F.first(k, ignorenulls=True).alias(k) for k in keys], F.sum("_n").alias("_rows"))
    means = found.join(names, "_group").withColumn("_m", c("_s") / c("_rows"))
    bounds = means.groupBy(*keys).agg(
        F.percentile("_m", F.lit(0.025)).alias("lower"), F.percentile("_m", F.lit(0.975)).alias("upper")
    )
    return natural_join(plain, bounds, "left", keys)


def _dealt(nodes: DataFrame, parts: DataFrame, bits: int, below: int, reps: int) -> DataFrame:
    """The draws of ``nodes`` dealt out to their parts, which have the next bits."""

    def deal(key: tuple, part: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        numbers, n = part["_part"].to_numpy(np.uint64), part["_n"].to_numpy(np.int64)
        own = np.array(node["_draws"].iloc[0], np.int64)
        found = list(split_draws(key[0], own, numbers << np.uint64(TREE_BITS - below), n, numbers, bits))
        return pd.DataFrame({"_group": key[0], "_node": [int(numbers[at]) for at, _ in found], "_draws": [d.tolist() for _, d in found]})

    by = ["_group", "_node"]
    return parts.groupBy(*by).cogroup(nodes.select(*by, "_draws").groupBy(*by)).applyInPandas(deal, "_group string, _node bigint, _draws array<bigint>")
