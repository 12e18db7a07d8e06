"""Row-level arithmetic, labels and recodes. NULL is the only missing value."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feet per mile, net width in feet, square feet per hectare.
FEET_PER_MILE = 5280
NET_WIDTH_FEET = 6.56168
SQUARE_FEET_PER_HECTARE = 107639.1

# Genomic code to name.
GENETIC_NAMES = {
    202: "Cisco",
    203: "Lake Whitefish",
    204: "Bloater",
    206: "Kiyi",
    208: "Shortnose Cisco",
    210: "Pygmy Whitefish",
    217: "unidentified ciscoe",
    218: "ciscoe hybrid",
}

# Fixed values: (ship code, genomic code) to comparison label.
PAIR_LABELS = {
    (202, 202): "Cisco/Cisco",
    (202, 204): "Cisco/Bloater",
    (202, 206): "Cisco/Kiyi",
    (202, 208): "Cisco/Shortnose",
    (202, 218): "Cisco/Unknown",
    (204, 202): "Bloater/Cisco",
    (204, 204): "Bloater/Bloater",
    (204, 206): "Bloater/Kiyi",
    (204, 208): "Bloater/Shortnose",
    (204, 218): "Bloater/hybrid",
    (206, 202): "Kiyi/Cisco",
    (206, 204): "Kiyi/Bloater",
    (206, 206): "Kiyi/Kiyi",
    (206, 208): "Kiyi/Shortnose",
    (206, 218): "Kiyi/hybrid",
}

# Trawl designs by gear.
BOTTOM_DESIGNS = (4, 5, 25, 26, 27, 44)
MIDWATER_DESIGNS = (21, 22, 28, 41, 45)

# States by country, after the Ontario recode.
COUNTRIES = {"WI": "USA", "MN": "USA", "MI": "USA", "ONT.E": "Canada", "ONT.W": "Canada"}

# Colour-scale breaks of the density map.
DENSITY_BREAKS = (1, 100, 1000, 25000, 75000)


def mapped(code: Column, table: dict) -> Column:
    """Constant lookup; an unknown code gives NULL."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def genetic_name(code: Column) -> Column:
    return mapped(code, GENETIC_NAMES)


def pair_label(ship: Column, genomic: Column) -> Column:
    table = {f"{a}/{b}": label for (a, b), label in PAIR_LABELS.items()}
    return mapped(F.concat(ship.cast("string"), F.lit("/"), genomic.cast("string")), table)


def match_flag(a: Column, b: Column) -> Column:
    return F.when(a == b, "Yes").when(a != b, "No")


def gear(design: Column) -> Column:
    return F.when(design.isin(*BOTTOM_DESIGNS), "Bottom trawl").when(
        design.isin(*MIDWATER_DESIGNS), "Mid-water trawl"
    )


def country(state: Column) -> Column:
    return mapped(state, COUNTRIES)


def clean_state(state: Column) -> Column:
    """Ontario halves are recoded on the raw text, then blanks are trimmed."""
    return F.trim(F.when(state == "E", "ONT.E").when(state == "W", "ONT.W").otherwise(state))


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def either(a: Column, b: Column) -> Column:
    """``a``, or ``b`` where ``a`` is missing."""
    return F.coalesce(a, b)


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def row_sum(*cols: Column) -> Column:
    return reduce(add, cols)


def row_mean(*cols: Column) -> Column:
    """Mean of the values present; NULL when there are none."""
    total = row_sum(*[F.coalesce(c, F.lit(0.0)) for c in cols])
    present = row_sum(*[c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def fish_per_hectare(fish: Column, miles: Column) -> Column:
    area = miles * FEET_PER_MILE * NET_WIDTH_FEET / SQUARE_FEET_PER_HECTARE
    return F.try_divide(fish, area)


def percent_of_pair(a: Column, b: Column) -> Column:
    return F.try_divide(a, a + b) * 100


def log_value(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def break_interval(x: Column, breaks=DENSITY_BREAKS) -> Column:
    """How many breaks lie at or below ``x``; NULL where the log scale has no value."""
    return F.when(x > 0, row_sum(*[(x >= b).cast("int") for b in breaks]))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x.cast("decimal(38,6)"), digits)


def united(sep: str, *cols: Column) -> Column:
    """Join columns to text; a missing part prints as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])
