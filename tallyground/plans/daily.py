"""Raw incidents → daily counts per district, with the quality report from the same pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyground.operators import quality
from tallyground.operators.clean import drop_bad_dates, fill_unknown_district
from tallyground.operators.series import daily_counts
from tallyground.settings import cut_lineage
from tallyground.sources import store


def daily(df: DataFrame, ts: str, district: str = "district") -> DataFrame:
    """``district, ds, y`` for the rows with a readable time."""
    return daily_counts(fill_unknown_district(drop_bad_dates(df, ts), district), ts, [district])


@dataclass(frozen=True)
class DailyResult:
    daily: DataFrame
    freshness: DataFrame
    issues: DataFrame
    metadata: DataFrame


def load(df: DataFrame, ts: str, district: str, as_of: Column) -> DailyResult:
    """Daily counts, freshness, issues and metadata from one scan.

    The rows are reduced to one per district and day and written once; all four results read that table.
    """
    return _results(cut_lineage(quality.day_table(df, ts, district if district in df.columns else None)), district, as_of)


def load_stored(spark: SparkSession, path: str, district: str, as_of: Column) -> DailyResult:
    """The same four results of a stored table from its profile, without a look at the rows."""
    return _results(store.read_profile(spark, path), district, as_of)


def _results(days: DataFrame, district: str, as_of: Column) -> DailyResult:
    profile = quality.profile_of(days)
    counts = (
        fill_unknown_district(days.dropna(subset=["ds"]), "district")
        .groupBy(F.col("district").alias(district), "ds")
        .agg(F.sum("y").alias("y"))
    )
    return DailyResult(
        daily=counts,
        freshness=quality.freshness_of(profile.select(F.col("newest").alias("latest")), as_of),
        issues=quality.quality_checks(profile).filter("fired").drop("fired"),
        metadata=quality.metadata_of(days, F.current_timestamp()),
    )
