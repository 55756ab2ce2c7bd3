"""Place, presence and interaction features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casekit.functions.time import flag

# --- fixed values (category names and thresholds used by the reference's features) ---
BOROUGHS = ["BRONX", "BROOKLYN", "MANHATTAN", "QUEENS", "STATEN ISLAND"]
HIGH_RISK_BOROUGHS = ["BRONX", "BROOKLYN"]
LOCATIONS = {
    "Park": "Park/Playground",
    "Subway": "Subway Station",
    "Street": "Street/Sidewalk",
    "Store": "Store/Commercial",
    "Residential": "Residential Building/House",
}
HIGH_RISK_LOCATIONS_4 = ["Park/Playground", "Subway Station", "Street/Sidewalk", "Store/Commercial"]
HIGH_RISK_LOCATIONS_3 = ["Park/Playground", "Subway Station", "Street/Sidewalk"]
HIGH_RISK_HOURS = [0, 2, 5, 7, 20]
HIGH_LATITUDE = 40.7318
CENTRAL_LATITUDE = (40.65, 40.8)
ZIP_FILL_ZERO = 0
ZIP_FILL_CITY = 11000
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:  # G1
    return _col(c).isNotNull().cast("int")


def both_present(a, b) -> Column:  # G2
    return (_col(a).isNotNull() & _col(b).isNotNull()).cast("int")


def zip_region(z, fill: float = ZIP_FILL_ZERO) -> Column:  # G3: floor division by 100
    return F.floor(F.coalesce(_col(z), F.lit(float(fill))) / 100).cast("long")


def zip_district(z, fill: float = ZIP_FILL_CITY) -> Column:  # G4: floor division by 10
    return F.floor(F.coalesce(_col(z), F.lit(float(fill))) / 10).cast("long")


def equals_flag(c, value) -> Column:  # G5-G7
    return flag(_col(c) == F.lit(value))


def in_set_flag(c, values) -> Column:  # G8
    return flag(_col(c).isin(list(values)))


def interaction(a, b) -> Column:  # G9: AND of two 0/1 flags
    return (_col(a) * _col(b)).cast("int")


def above_flag(c, threshold: float = HIGH_LATITUDE) -> Column:  # G10
    return flag(_col(c) > threshold)


def between_flag(c, lo: float = CENTRAL_LATITUDE[0], hi: float = CENTRAL_LATITUDE[1]) -> Column:  # G10
    return flag(_col(c).between(lo, hi))
