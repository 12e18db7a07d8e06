"""Ellipsoidal distance and the inverse map projection, as native columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# WGS84 / GRS80 ellipsoids and the UTM zone 16N parameters.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_K0, UTM_FALSE_EASTING, UTM16_MERIDIAN = 0.9996, 500000.0, -87.0

# The inlet that distances are measured to (longitude, latitude).
INLET = (-89.570, 47.999)


def with_geodesic_distance(
    df: DataFrame, lon: str, lat: str, target=INLET, out: str = "distance", rounds: int = 6
) -> DataFrame:
    """Metres from each point to ``target`` on WGS84 (Vincenty's inverse formula).

    A fixed number of rounds replaces the convergence test; six are enough
    for points that are not nearly antipodal.
    """
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    u2 = math.atan((1 - f) * math.tan(math.radians(target[1])))
    sin_u2, cos_u2 = math.sin(u2), math.cos(u2)
    c = F.col
    keep = df.columns
    df = df.withColumns(
        {
            "_l": F.radians(F.lit(target[0]) - c(lon)),
            "_u1": F.atan((1 - f) * F.tan(F.radians(c(lat)))),
        }
    )
    df = df.withColumns({"_s1": F.sin("_u1"), "_c1": F.cos("_u1"), "_lam": c("_l")})
    for _ in range(rounds):
        df = df.withColumns({"_sl": F.sin("_lam"), "_cl": F.cos("_lam")})
        df = df.withColumns(
            {
                "_ss": F.sqrt(
                    F.pow(cos_u2 * c("_sl"), 2)
                    + F.pow(c("_c1") * sin_u2 - c("_s1") * cos_u2 * c("_cl"), 2)
                ),
                "_cs": c("_s1") * sin_u2 + c("_c1") * cos_u2 * c("_cl"),
            }
        )
        df = df.withColumns(
            {
                "_sig": F.atan2("_ss", "_cs"),
                "_sa": F.coalesce(
                    F.try_divide(c("_c1") * cos_u2 * c("_sl"), c("_ss")), F.lit(0.0)
                ),
            }
        )
        df = df.withColumn("_c2a", 1 - c("_sa") * c("_sa"))
        df = df.withColumns(
            {
                "_c2m": F.coalesce(
                    c("_cs") - F.try_divide(2 * c("_s1") * sin_u2, c("_c2a")), F.lit(0.0)
                ),
                "_k": f / 16 * c("_c2a") * (4 + f * (4 - 3 * c("_c2a"))),
            }
        )
        df = df.withColumn(
            "_lam",
            c("_l")
            + (1 - c("_k"))
            * f
            * c("_sa")
            * (
                c("_sig")
                + c("_k")
                * c("_ss")
                * (c("_c2m") + c("_k") * c("_cs") * (2 * c("_c2m") * c("_c2m") - 1))
            ),
        )
    df = df.withColumn("_u", c("_c2a") * ((a * a - b * b) / (b * b)))
    df = df.withColumns(
        {
            "_ka": 1 + c("_u") / 16384 * (4096 + c("_u") * (-768 + c("_u") * (320 - 175 * c("_u")))),
            "_kb": c("_u") / 1024 * (256 + c("_u") * (-128 + c("_u") * (74 - 47 * c("_u")))),
        }
    )
    square = 2 * c("_c2m") * c("_c2m")
    shift = (
        c("_kb")
        * c("_ss")
        * (
            c("_c2m")
            + c("_kb")
            / 4
            * (
                c("_cs") * (square - 1)
                - c("_kb") / 6 * c("_c2m") * (4 * c("_ss") * c("_ss") - 3) * (2 * square - 3)
            )
        )
    )
    return df.withColumn(out, b * c("_ka") * (c("_sig") - shift)).select(*keep, out)


def with_lonlat(
    df: DataFrame, x: str, y: str, lon: str = "long", lat: str = "lat", meridian=UTM16_MERIDIAN
) -> DataFrame:
    """Inverse transverse Mercator (Krueger's series to the fourth order)."""
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    c = F.col
    keep = df.columns
    df = df.withColumns(
        {
            "_xi": c(y) / (UTM_K0 * radius),
            "_eta": (c(x) - UTM_FALSE_EASTING) / (UTM_K0 * radius),
        }
    )
    xi, eta = c("_xi"), c("_eta")
    for j, bj in enumerate(beta, start=1):
        xi = xi - bj * F.sin(2 * j * c("_xi")) * F.cosh(2 * j * c("_eta"))
        eta = eta - bj * F.cos(2 * j * c("_xi")) * F.sinh(2 * j * c("_eta"))
    df = df.withColumns({"_xp": xi, "_ep": eta})
    df = df.withColumn("_chi", F.asin(F.sin("_xp") / F.cosh("_ep")))
    phi = c("_chi")
    for j, dj in enumerate(delta, start=1):
        phi = phi + dj * F.sin(2 * j * c("_chi"))
    lam = F.atan2(F.sinh("_ep"), F.cos("_xp"))
    return df.withColumns({lon: meridian + F.degrees(lam), lat: F.degrees(phi)}).select(*keep, lon, lat)
