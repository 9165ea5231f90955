"""Clean-up of storm track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions.columns import date_parts, drop_all_null, first_present, to_number, to_time
from isobar.functions.events import cyclone_category

# Accepted source columns, best first, and the storm natures kept.
TIME_COLUMNS = ["ISO_TIME", "iso_time", "time"]
NATURE_COLUMNS = ["NATURE", "nature"]
WIND_COLUMNS = ["WMO_WIND", "USA_WIND", "wind"]
PRESSURE_COLUMNS = ["WMO_PRES", "USA_PRES", "pres"]
LAT_COLUMNS = ["LAT", "lat"]
LON_COLUMNS = ["LON", "lon"]
LAND_COLUMNS = ["DIST2LAND", "dist2land"]
TROPICAL = "TS|MX"


def is_tropical(nature: Column, pattern: str = TROPICAL) -> Column:
    return F.coalesce(F.upper(nature).rlike(pattern), F.lit(False))


def filter_nature(df: DataFrame, pattern: str = TROPICAL) -> DataFrame:
    nature = first_present(df, NATURE_COLUMNS)
    return df if nature is None else df.where(is_tropical(nature, pattern))


def _number(col: Column | None) -> Column:
    return F.lit(None).cast("double") if col is None else to_number(col)


def prepare_tracks(df: DataFrame, nature: str = TROPICAL, per_row_wind: bool = False,
                   dated_only: bool = False) -> DataFrame:
    """Tropical fixes with calendar parts, wind category, pressure, position and land distance.

    Wind comes from the first source column the frame has; ``per_row_wind`` falls back row by row
    instead. ``dated_only`` drops rows without a valid time, such as a line of units.
    """
    kept = filter_nature(df, nature)
    when = first_present(kept, TIME_COLUMNS)
    parts = ({p: F.lit(0) for p in ("year", "month", "day")} if when is None
             else date_parts(to_time(when)))
    if dated_only and when is not None:
        kept = kept.where(to_time(when).isNotNull())
    wind = first_present(kept, WIND_COLUMNS, per_row=per_row_wind)
    lat = first_present(kept, LAT_COLUMNS)
    lon = first_present(kept, LON_COLUMNS)
    land = first_present(kept, LAND_COLUMNS)
    knots = F.coalesce(_number(wind), F.lit(0.0))
    derived = {
        **parts,
        "wind_kts": knots,
        "category": cyclone_category(knots),
        "pressure_min": _number(first_present(kept, PRESSURE_COLUMNS)),
    }
    if lat is not None:
        derived |= {"lat": _number(lat), "lat_abs": F.abs(_number(lat))}
    if lon is not None:
        derived["lon"] = _number(lon)
    if land is not None:
        derived["dist_to_land"] = _number(land)
    out = kept.withColumns(derived)
    required = [c for c in ("lat", "lon", "wind_kts") if c in out.columns]
    return drop_all_null(out, required)
