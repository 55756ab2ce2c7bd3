"""Label mappings (P1-P4) as Column expressions.

All lookups are ``CASE WHEN`` chains: they stay inside whole-stage codegen and
need no join. Unlisted keys (and NULL) map to NULL unless a default is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's class names and groupings) ---
CRITICAL = "CRITICO"
NON_CRITICAL = "NO_CRITICO"
DESCRIPTORS = [
    "Tortured", "Chained", "Neglected", "No Shelter", "In Car",
    "Noise, Barking Dog (NR5)", "Other (complaint details)",
]
PRIORITY_GROUPS = {
    "CRITICO": ["Tortured", "Chained"],
    "NO_CRITICO": ["Neglected", "No Shelter", "In Car", "Noise, Barking Dog (NR5)", "Other (complaint details)"],
}
SEVERITY_GROUPS = {
    "SEVERO": ["Tortured", "Chained"],
    "MODERADO": ["Neglected", "No Shelter"],
    "LEVE": ["In Car", "Noise, Barking Dog (NR5)", "Other (complaint details)"],
}
SEASON_MONTHS = {
    "Invierno": [12, 1, 2],
    "Primavera": [3, 4, 5],
    "Verano": [6, 7, 8],
    "Otoño": [9, 10, 11],
}
HIGH_RISK_SEASONS = ["Otoño", "Verano"]
# --- end of fixed values ---


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_groups(col, groups: dict, default=None) -> Column:
    """group -> [keys] inverted lookup; first listed group wins."""
    c = _col(col)
    out = None
    for g, keys in groups.items():
        out = (F.when(c.isin(list(keys)), F.lit(g)) if out is None
               else out.when(c.isin(list(keys)), F.lit(g)))
    if default is not None:
        out = out.otherwise(F.lit(default))
    return out


def binary_priority(col="descriptor") -> Column:
    """Tortured/Chained -> CRITICO, other five -> NO_CRITICO, else NULL."""
    return map_groups(col, PRIORITY_GROUPS)


def severity(col="descriptor") -> Column:
    """Three severity levels, unlisted -> NULL."""
    return map_groups(col, SEVERITY_GROUPS)


def severity_group(col="descriptor", groups: dict | None = None, default: str = "UNKNOWN") -> Column:
    """Same grouping but unlisted keys, NULL included, -> ``default``."""
    return map_groups(col, groups or SEVERITY_GROUPS, default=default)


def season(month_col) -> Column:
    """Month number -> season name, NULL month -> NULL."""
    return map_groups(month_col, SEASON_MONTHS)


def is_high_risk_season(season_col) -> Column:
    """T15."""
    return F.coalesce(_col(season_col).isin(HIGH_RISK_SEASONS), F.lit(False)).cast("int")
