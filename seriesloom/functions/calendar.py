"""Calendar and season columns of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import as_column

# Seasons by month number.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "autumn": (9, 10, 11),
}


def calendar_columns(ts) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), month, day of year, weekend flag, cyclic codes."""
    ts = as_column(ts)
    hour, weekday = F.hour(ts), F.weekday(ts)
    day_angle = hour * F.lit(2 * math.pi / 24)
    week_angle = (weekday * 24 + hour) * F.lit(2 * math.pi / 168)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "month": F.month(ts),
        "day_of_year": F.dayofyear(ts),
        "weekend": (weekday >= 5).cast("int"),
        "sin24": F.sin(day_angle),
        "cos24": F.cos(day_angle),
        "sin168": F.sin(week_angle),
        "cos168": F.cos(week_angle),
    }


def season_name(ts) -> Column:
    month = F.month(as_column(ts))
    name = F.lit(None).cast("string")
    for season, months in SEASON_MONTHS.items():
        name = F.when(month.isin(*months), F.lit(season)).otherwise(name)
    return name


def season_columns(ts, dummies: bool = True) -> dict[str, Column]:
    """Quarter plus either the season name or one 0/1 column per season.

    All four season columns always exist, so the schema does not depend on which
    months the data covers.
    """
    ts = as_column(ts)
    out = {"quarter": F.quarter(ts)}
    if not dummies:
        return out | {"season": season_name(ts)}
    month = F.month(ts)
    for season, months in SEASON_MONTHS.items():
        out[f"season_{season}"] = month.isin(*months).cast("tinyint")
    return out
