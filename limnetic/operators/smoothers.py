"""Lines, local regression and density curves behind the charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnetic.session import written

from .joins import natural_join
from .ordered import placed_sums, prefix_sums


def smooth_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The fitted line of each group at its smallest and largest x."""
    used = F.col(y).isNotNull() & F.col(x).isNotNull()
    fit = (
        df.filter(used)
        .groupBy(*keys)
        .agg(
            F.regr_slope(y, x).alias("_b"),
            F.regr_intercept(y, x).alias("_a"),
            F.array(F.min(x), F.max(x)).alias("_ends"),
        )
    )
    ends = fit.select(*keys, "_a", "_b", F.posexplode("_ends").alias("end", "x"))
    return ends.select(*keys, "end", "x", (F.col("_a") + F.col("_b") * F.col("x")).alias("fit"))


def smooth_local(
    df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.75, points: int = 80
) -> DataFrame:
    """Local quadratic regression (tricube weights) on an even grid per group.

    ``x`` is a calendar or count axis: rows are first aggregated to its distinct
    values, so the grid meets at most a few thousand cells per group. A
    neighbourhood reaches to the floor(span * n)-th nearest row. A point whose
    neighbourhood has fewer than three distinct x has no fit.
    """
    keys = list(keys)
    c = F.col
    cells = (
        df.filter(c(x).isNotNull() & c(y).isNotNull())
        .groupBy(*keys, c(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(c(y)).alias("_sy"))
        .withColumn("_g", F.lit(0))
    )
    keys = ["_g", *keys]
    axis = W.partitionBy(*keys)
    cells = cells.withColumns(
        {
            "_lo": F.min("_x").over(axis),
            "_hi": F.max("_x").over(axis),
            "_k": F.floor(F.sum("_n").over(axis) * span),
        }
    )
    grid = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", c("_lo") + (c("_hi") - c("_lo")) * c("point") / (points - 1))
    grid = grid.withColumn("_d", F.abs(c("_x") - c("x")))

    nearest = W.partitionBy(*keys, "point").orderBy("_d").rangeBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys, "point")
    grid = grid.withColumn("_near", F.sum("_n").over(nearest))
    grid = grid.withColumn("_h", F.min(F.when(c("_near") >= c("_k"), c("_d"))).over(whole))
    grid = grid.filter((c("_h") > 0) & (c("_d") < c("_h")))
    grid = grid.withColumns({"_u": (c("_x") - c("x")) / c("_h"), "_r": c("_d") / c("_h")})
    grid = grid.withColumn("_w", F.pow(1 - c("_r") * c("_r") * c("_r"), F.lit(3.0)))

    def moment(weighted: Column, power: int) -> Column:
        for _ in range(power):
            weighted = weighted * c("_u")
        return F.sum(weighted)

    sums = grid.groupBy(*keys, "point", "x").agg(
        F.count(F.lit(1)).alias("_cells"),
        *[moment(c("_w") * c("_n"), p).alias(f"s{p}") for p in range(5)],
        *[moment(c("_w") * c("_sy"), p).alias(f"t{p}") for p in range(3)],
    )

    def det(a, b, d):
        rows = [[c(k) for k in row] for row in (a, b, d)]
        (p, q, r), (s, t, u), (v, w, z) = rows
        return p * (t * z - u * w) - q * (s * z - u * v) + r * (s * w - t * v)

    top = det(("t0", "s1", "s2"), ("t1", "s2", "s3"), ("t2", "s3", "s4"))
    base = det(("s0", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"))
    fit = F.when(c("_cells") >= 3, F.try_divide(top, base))
    return sums.select(*keys[1:], "point", "x", fit.alias("fit"))


# Distances are counted in so many bins before those of one bin are sorted.
DISTANCE_BINS = 4096


def _solved(c, top_column: int) -> Column:
    """A coefficient of the weighted quadratic through the moments s0..s4, t0..t2."""
    columns = [["s0", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]

    def det(a, b, d):
        (p, q, r), (s, t, u), (v, w, z) = [[c(k) for k in row] for row in zip(a, b, d)]
        return p * (t * z - u * w) - q * (s * z - u * v) + r * (s * w - t * v)

    replaced = [["t0", "t1", "t2"] if i == top_column else col for i, col in enumerate(columns)]
    return F.try_divide(det(*replaced), det(*columns))


def smooth_interpolated(
    df: DataFrame, keys: Sequence[str], x: str, y: str, span: float = 0.75, points: int = 80, cell: float = 0.2, margin: float = 0.005
) -> DataFrame:
    """Local quadratic regression fitted at a few vertices, with cubic pieces between them.

    The rows of a group are halved by rank (a k-d tree in one dimension) until a part has at
    most floor(span * cell * n) rows; a part whose upper half has no larger x stays whole.
    The vertices are the cuts, midway between two values, and the ends of the range, widened
    by ``margin`` of it. Value and slope at a vertex are those of the local fit of
    ``smooth_local``; between two vertices runs the cubic with these values and slopes.

    Nothing here sorts a group: ranks come from ``prefix_sums``, the distance to the last
    neighbour from counts in bins and then the values of one bin, and the moments from
    partial sums. So ``x`` may be continuous. A stretch beside a vertex that has fewer than
    three distinct x in reach has no fit, nor has a group with a single x.
    """
    keys = list(keys)
    c = F.col
    cells = (
        df.filter(c(x).isNotNull() & c(y).isNotNull())
        .groupBy(*keys, c(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(c(y).cast("double")).alias("_sy"))
    )
    keys = ["_g", *keys]
    cells = written(prefix_sums(cells.withColumn("_g", F.lit(0)), keys, "_x", ["_n"]), "cells")
    ends = cells.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.max("total__n").alias("_all"))
    ends = written(ends.filter(c("_hi") > c("_lo")), "ends")

    # Parts are ranges of ranks; the first part of a group has all of them.
    largest = F.floor(c("_all") * (span * cell))
    parts, cuts = ends.select(*keys, "_all", F.lit(0).cast("bigint").alias("_from"), c("_all").alias("_to")), []
    for _ in range(max(1, math.ceil(math.log2(1 / (span * cell))) + 1)):
        wide = parts.filter(c("_to") - c("_from") > F.greatest(largest, F.lit(1)))
        inside = natural_join(cells.select(*keys, "_x", "_n", "cum__n"), wide, "inner", keys)
        inside = inside.filter((c("cum__n") > c("_from")) & (c("cum__n") <= c("_to")))
        middle = F.floor((c("_from") + c("_to") + 1) / 2)
        halves = inside.groupBy(*keys, "_all", "_from", "_to").agg(
            F.max(F.when(c("cum__n") - c("_n") < middle, F.struct("_x", "cum__n"))).alias("_left"),
            F.min(F.when(c("cum__n") - c("_n") >= middle, c("_x"))).alias("_right"),
        )
        halves = written(halves.filter(c("_right").isNotNull()), "halves")
        cuts.append(halves.select(*keys, ((c("_left._x") + c("_right")) / 2).alias("_v")))
        both = F.array(
            F.struct(c("_from").alias("a"), c("_left.cum__n").alias("b")), F.struct(c("_left.cum__n").alias("a"), c("_to").alias("b"))
        )
        parts = halves.select(*keys, "_all", F.explode(both).alias("_p")).select(*keys, "_all", c("_p.a").alias("_from"), c("_p.b").alias("_to"))
    wider = (c("_hi") - c("_lo")) * margin
    vertices = ends.select(*keys, F.explode(F.array(c("_lo") - wider, c("_hi") + wider)).alias("_v"))
    for cut in cuts:
        vertices = vertices.unionByName(cut)
    vertices = written(natural_join(vertices, ends, "inner", keys), "vertices")

    # The distance to the k-th nearest row.
    reach = F.floor(c("_all") * span)
    far = F.greatest(c("_v") - c("_lo"), c("_hi") - c("_v"))
    near = natural_join(cells.select(*keys, "_x", "_n", "_sy"), vertices.withColumns({"_k": reach, "_far": far}), "inner", keys)
    near = near.withColumn("_d", F.abs(c("_x") - c("_v")))
    near = near.withColumn("_bin", F.least(F.floor(c("_d") / c("_far") * DISTANCE_BINS), F.lit(DISTANCE_BINS - 1)))
    vertex = [*keys, "_v"]
    bins = near.groupBy(*vertex, "_k", "_bin").agg(F.sum("_n").alias("_m"))
    upto = W.partitionBy(*vertex).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_m").over(upto)).filter((c("_upto") >= c("_k")) & (c("_upto") - c("_m") < c("_k")))
    bins = written(bins.select(*vertex, "_bin", (c("_upto") - c("_m")).alias("_before")), "bins")
    ranked = natural_join(near.select(*vertex, "_k", "_bin", "_d", "_n"), bins, "inner", [*vertex, "_bin"])
    by_distance = W.partitionBy(*vertex).orderBy("_d").rangeBetween(W.unboundedPreceding, 0)
    ranked = ranked.withColumn("_near", F.sum("_n").over(by_distance) + c("_before"))
    width = written(ranked.filter(c("_near") >= c("_k")).groupBy(*vertex).agg(F.min("_d").alias("_h")), "widths")

    used = natural_join(near.select(*vertex, "_x", "_n", "_sy", "_d"), width, "inner", vertex).filter((c("_h") > 0) & (c("_d") < c("_h")))
    used = used.withColumns({"_u": (c("_x") - c("_v")) / c("_h"), "_r": c("_d") / c("_h")})
    used = used.withColumn("_w", F.pow(1 - c("_r") * c("_r") * c("_r"), F.lit(3.0)))

    def moment(weighted: Column, power: int) -> Column:
        for _ in range(power):
            weighted = weighted * c("_u")
        return F.sum(weighted)

    sums = used.groupBy(*vertex, "_h").agg(
        F.count(F.lit(1)).alias("_cells"),
        *[moment(c("_w") * c("_n"), p).alias(f"s{p}") for p in range(5)],
        *[moment(c("_w") * c("_sy"), p).alias(f"t{p}") for p in range(3)],
    )
    fits = sums.select(
        *vertex, F.when(c("_cells") >= 3, _solved(c, 0)).alias("_f"), F.when(c("_cells") >= 3, _solved(c, 1) / c("_h")).alias("_s")
    )
    fits = natural_join(vertices, fits, "left", vertex)

    # Pieces from vertex to vertex, and the points that lie in them: a few rows for each group.
    along = W.partitionBy(*keys).orderBy("_v")
    pieces = fits.withColumns({f"{n}1": F.lead(n).over(along) for n in ("_v", "_f", "_s")}).filter(c("_v1").isNotNull())
    at = c("_lo") + (c("_hi") - c("_lo")) * c("point") / (points - 1)
    placed = pieces.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", at)
    placed = placed.filter((c("x") >= c("_v")) & (c("x") < c("_v1")))
    step, t = c("_v1") - c("_v"), (c("x") - c("_v")) / (c("_v1") - c("_v"))
    fit = (
        (1 + 2 * t) * (1 - t) * (1 - t) * c("_f") + t * (1 - t) * (1 - t) * step * c("_s")
        + t * t * (3 - 2 * t) * c("_f1") + t * t * (t - 1) * step * c("_s1")
    )
    return placed.select(*keys[1:], "point", "x", fit.alias("fit"))


# Basis functions of a spline, and the shares of the data's weight that its penalty is tried at.
SPLINE_SIZE = 10
PENALTIES = tuple(10.0 ** (k / 4) for k in range(-24, 25))
# Cubic B-splines of even knots: what each of the four over an interval is in powers of the place in it.
PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6
# Rows of the largest group from which on smoothers are splines.
SPLINE_ROWS = 1000


def _roughness(size: int) -> np.ndarray:
    """Integrals of the products of second derivatives, in units of an interval."""
    second = np.array([[1, -1], [-2, 3], [1, -3], [0, 1]], float)
    powers = np.array([[1, 1 / 2], [1 / 2, 1 / 3]])
    out = np.zeros((size, size))
    for j in range(size - 3):
        out[j : j + 4, j : j + 4] += second @ powers @ second.T
    return out


def smooth_spline(
    df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 80, size: int = SPLINE_SIZE, penalties: Sequence[float] = PENALTIES
) -> DataFrame:
    """Penalised regression spline of each group on an even grid, for groups of any size.

    The basis has ``size`` cubic B-splines on even knots over the group's range of x; the
    penalty is the integral of the squared second derivative, times a factor that generalised
    cross-validation picks from ``penalties`` (as shares of the traces; of equal scores the
    larger). Each row touches four basis functions, polynomials of its place in one interval,
    so the banded normal equations follow from twelve sums for each (group, interval). Only
    these few rows reach the solver, at most ``size - 3`` a group. ``edf`` counts the fit's
    degrees of freedom. A group with a single x has no fit.
    """
    keys = list(keys)
    c = F.col
    rows = df.select(*keys, c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y")).filter(c("_x").isNotNull() & c("_y").isNotNull())
    bounds = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.avg("_y").alias("_mean"))
    bounds = written(bounds.filter(c("_hi") > c("_lo")).withColumn("_g", F.lit(0)), "bounds")
    keys = ["_g", *keys]
    n = size - 3
    placed = natural_join(rows.withColumn("_g", F.lit(0)), bounds, "inner", keys)
    placed = placed.withColumn("_at", (c("_x") - c("_lo")) / (c("_hi") - c("_lo")) * n)
    placed = placed.withColumn("_j", F.least(F.floor("_at"), F.lit(n - 1)).cast("int"))
    placed = placed.withColumns({"_u": c("_at") - c("_j"), "_c": c("_y") - c("_mean")})

    def power(k: int, times: Column | None = None) -> Column:
        out = times if times is not None else F.lit(1.0)
        for _ in range(k):
            out = out * c("_u")
        return F.sum(out)

    sums = placed.groupBy(*keys, "_lo", "_hi", "_mean", "_j").agg(
        *[power(k).alias(f"u{k}") for k in range(7)], *[power(k, c("_c")).alias(f"v{k}") for k in range(4)], F.sum(c("_c") * c("_c")).alias("yy")
    )
    schema = T.StructType([
        *(df.schema[k] for k in keys[1:]), T.StructField("point", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in ("x", "fit", "edf")),
    ])
    names, rough, grid = schema.names, _roughness(size), np.arange(points) / (points - 1)
    products = np.array([[np.convolve(a, b) for b in PIECES] for a in PIECES])
    penalties = np.array(sorted(penalties))

    def solve(group: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        xx, xy = np.zeros((size, size)), np.zeros(size)
        us, vs = cells[[f"u{k}" for k in range(7)]].to_numpy(float), cells[[f"v{k}" for k in range(4)]].to_numpy(float)
        for j, u, v in zip(cells["_j"], us, vs):
            xx[j : j + 4, j : j + 4] += products @ u
            xy[j : j + 4] += PIECES @ v
        rows, total, yy = us[:, 0].sum(), np.trace(xx) / np.trace(rough), cells["yy"].sum()
        best = None
        for share in penalties:
            hat = np.linalg.solve(xx + share * total * rough, np.c_[xy, xx])
            coefficients, edf = hat[:, 0], np.trace(hat[:, 1:])
            rss = max(yy - 2 * coefficients @ xy + coefficients @ xx @ coefficients, 0.0)
            score = math.inf if rows - edf <= 1e-6 else round(math.log(max(rows * rss, 1e-12 * (yy or 1.0)) / (rows - edf) ** 2), 8)
            if best is None or score <= best[0]:
                best = (score, coefficients, edf)
        _, coefficients, edf = best
        at = grid * n
        j = np.minimum(at.astype(int), n - 1)
        basis = np.vander(at - j, 4, increasing=True) @ PIECES.T
        fit = cells["_mean"].iloc[0] + (basis * coefficients[j[:, None] + np.arange(4)]).sum(1)
        low, high = cells["_lo"].iloc[0], cells["_hi"].iloc[0]
        found = {k: [v] * points for k, v in zip(names, group[1:])}
        return pd.DataFrame(found | {"point": np.arange(points, dtype=np.int32), "x": low + (high - low) * grid, "fit": fit, "edf": edf})[names]

    return sums.groupBy(*keys).applyInPandas(solve, schema)


def smooth(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 80) -> DataFrame:
    """The smoother that charts use by default: local regression, or a spline once the largest group has 1,000 rows."""
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    largest = used.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest < SPLINE_ROWS:
        return smooth_interpolated(df, keys, x, y, points=points)
    return smooth_spline(df, keys, x, y, points).drop("edf")


def bandwidth_nrd0(n: Column, sd: Column, q1: Column, q3: Column) -> Column:
    """Rule-of-thumb kernel bandwidth."""
    spread = F.least(sd, (q3 - q1) / 1.34)
    usable = F.when(spread > 0, spread).when(sd > 0, sd).otherwise(F.lit(1.0))
    return 0.9 * usable * F.pow(n.cast("double"), F.lit(-0.2))


def density_ridges(
    df: DataFrame,
    facet: str,
    group: str,
    x: str,
    points: int = 512,
    min_height: float = 0.01,
) -> DataFrame:
    """Gaussian density curve of each group on its facet's grid, tails cut.

    The bandwidth is the mean of the facet's group bandwidths. Values are spread
    linearly onto the grid first, so the kernel sum costs grid times grid per
    group however many rows there are. Curve points below ``min_height`` of the
    facet's highest point are left out. The group's median stands beside; it and the
    quartiles come from running sums over the counted values. The counted values and
    the group figures are written once, as several steps use them.
    """
    c = F.col
    keys = [facet, group]
    values = (
        df.filter(c(x).isNotNull())
        .groupBy(*keys, c(x).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    values, ranked = placed_sums(values, keys, "_x", ["_n"])
    shares = (0.25, 0.5, 0.75)

    def at(rank: Column) -> Column:
        """The value at a rank from 0: the first up to which more rows are counted."""
        return F.min(F.when(c("cum__n") > rank, c("_x")))

    def place(share: float, total: str) -> Column:
        return (c(total) - 1) * share

    per_group = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("_total"),
        (F.sum(c("_n") * c("_x")) / F.sum("_n")).alias("_mean"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
        F.array(*[at(F.floor(place(p, "total__n"))) for p in shares]).alias("_below"),
        F.array(*[at(F.ceil(place(p, "total__n"))) for p in shares]).alias("_above"),
    )
    between = [
        c("_below")[i] + (c("_above")[i] - c("_below")[i]) * (place(p, "_total") - F.floor(place(p, "_total")))
        for i, p in enumerate(shares)
    ]
    per_group = per_group.withColumn("_q", F.array(*between)).drop("_below", "_above")
    off = c("_x") - c("_mean")
    spread = natural_join(values, per_group.select(*keys, "_mean"), "left", keys)
    spread = spread.groupBy(*keys).agg(F.sum(c("_n") * off * off).alias("_ss"))
    sd = F.sqrt(F.try_divide(c("_ss"), F.nullif(c("_total") - 1, F.lit(0))))
    per_group = natural_join(per_group, spread, "left", keys).withColumn(
        "_bw", bandwidth_nrd0(c("_total"), F.coalesce(sd, F.lit(0.0)), c("_q")[0], c("_q")[2])
    )
    per_group = written(per_group, "groups")
    panel = per_group.groupBy(facet).agg(
        F.avg("_bw").alias("_h"), F.min("_lo").alias("_min"), F.max("_hi").alias("_max")
    )
    panel = panel.select(
        facet, "_h", (c("_min") - 3 * c("_h")).alias("_from"),
        ((c("_max") - c("_min") + 6 * c("_h")) / (points - 1)).alias("_step"),
    )

    placed = natural_join(values, panel, "left", [facet]).withColumn(
        "_pos", (c("_x") - c("_from")) / c("_step")
    )
    placed = placed.withColumn("_cell", F.floor("_pos").cast("int"))
    part = c("_pos") - c("_cell")
    both = F.array(
        F.struct(c("_cell").alias("i"), (c("_n") * (1 - part)).alias("m")),
        F.struct((c("_cell") + 1).alias("i"), (c("_n") * part).alias("m")),
    )
    mass = (
        placed.select(*keys, "_h", "_from", "_step", F.explode(both).alias("_s"))
        .groupBy(*keys, "_h", "_from", "_step", c("_s.i").alias("_i"))
        .agg(F.sum("_s.m").alias("_m"))
    )
    curve = mass.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (c("point") - c("_i")) * c("_step") / c("_h")
    kernel = F.exp(-z * z / 2) / (c("_h") * math.sqrt(2 * math.pi))
    curve = curve.groupBy(*keys, "_from", "_step", "point").agg(F.sum(c("_m") * kernel).alias("_k"))
    sizes = per_group.select(*keys, "_total", c("_q")[1].alias("median"))
    curve = natural_join(curve, sizes, "left", keys).withColumn("density", c("_k") / c("_total"))
    curve = curve.withColumn("_peak", F.max("density").over(W.partitionBy(facet)))
    return curve.filter(c("density") >= min_height * c("_peak")).select(
        facet, group, "point", (c("_from") + c("point") * c("_step")).alias("x"), "density", "median"
    )
