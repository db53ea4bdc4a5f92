"""Typing, filling and filtering of incident rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground import schemas
from tallyground.functions.coerce import coerce_integer, coerce_numeric, coerce_timestamp, day_of_year
from tallyground.functions.geo import coordinates_ok

UNKNOWN = "UNKNOWN"


def coerce_timestamps(df: DataFrame, **targets: str) -> DataFrame:
    """Add typed time columns: ``coerce_timestamps(df, occurred="occurred_raw")``."""
    return df.withColumns({new: coerce_timestamp(F.col(old)) for new, old in targets.items()})


def coerce_numbers(df: DataFrame, **targets: str) -> DataFrame:
    return df.withColumns({new: coerce_numeric(F.col(old)) for new, old in targets.items()})


def coerce_integers(df: DataFrame, **targets: str) -> DataFrame:
    return df.withColumns({new: coerce_integer(F.col(old)) for new, old in targets.items()})


def drop_bad_dates(df: DataFrame, ts: str) -> DataFrame:
    return df.dropna(subset=[ts])


def drop_missing_coords(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """``dropna`` drops NaN as well as NULL."""
    return df.dropna(subset=[lat, lon])


def valid_coordinates(
    df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Rows on the globe; ``box`` (south, north, west, east) narrows that when asked for."""
    kept = df.filter(coordinates_ok(F.col(lat), F.col(lon)))
    if box is not None:
        south, north, west, east = box
        kept = kept.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))
    return kept


def fill_unknown_district(df: DataFrame, district: str = "district") -> DataFrame:
    """A missing district, or a missing column, becomes UNKNOWN."""
    if district not in df.columns:
        return df.withColumn(district, F.lit(UNKNOWN))
    return df.withColumn(district, F.coalesce(F.col(district), F.lit(UNKNOWN)))


def drop_if_present(df: DataFrame, names: list[str] = schemas.DROPPED_COLUMNS) -> DataFrame:
    """Drop by exact spelling, so that ``code`` in the list does not remove ``CODE``."""
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name not in names])


def cast_categoricals(df: DataFrame, names: list[str]) -> DataFrame:
    """Text form of the listed columns that exist; NULL stays NULL."""
    return df.withColumns({name: F.col(name).cast("string") for name in names if name in df.columns})


def filter_by_series(df: DataFrame, series: str, value) -> DataFrame:
    return df.filter(F.col(series) == value)


def filter_date_range(df: DataFrame, ds: str, first, last, open_start: bool = False) -> DataFrame:
    """Rows in [first, last], or in (first, last] with ``open_start``."""
    start = F.col(ds) > first if open_start else F.col(ds) >= first
    return df.filter(start & (F.col(ds) <= last))


def clean_incidents(raw: DataFrame) -> DataFrame:
    """Typed incident rows from the raw text columns of the stored schema."""
    typed = (
        drop_if_present(raw)
        .withColumns(
            {
                "OFFENSE_CODE": coerce_integer(F.col("OFFENSE_CODE")),
                "OCCURRED_ON_DATE": coerce_timestamp(F.col("OCCURRED_ON_DATE")),
                "YEAR": coerce_integer(F.col("YEAR")),
                "MONTH": coerce_integer(F.col("MONTH")),
                "HOUR": coerce_integer(F.col("HOUR")),
                "Lat": coerce_numeric(F.col("Lat")),
                "Long": coerce_numeric(F.col("Long")),
            }
        )
        .withColumn("DAY_OF_YEAR", day_of_year(F.col("OCCURRED_ON_DATE")))
    )
    typed = cast_categoricals(typed, ["DISTRICT", "DAY_OF_WEEK", "STREET"])
    return drop_missing_coords(fill_unknown_district(typed, "DISTRICT"), "Lat", "Long")
