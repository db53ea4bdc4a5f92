"""Freshness, quality checks and the dataset summary.

All of them, and the daily counts, can be read from ``day_table``, which is one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyground.functions.coerce import elapsed_days
from tallyground.operators.clean import UNKNOWN


def latest_date(df: DataFrame, ts: str) -> DataFrame:
    """One row: the latest timestamp, NULLs ignored."""
    return df.agg(F.max(ts).alias("latest"))


def data_freshness(
    df: DataFrame, ts: str, as_of: Column, info_after: int = 30, warn_after: int = 90
) -> DataFrame:
    """Latest day, its age at ``as_of`` in whole days, and the level fresh, info, warning or unknown."""
    return freshness_of(latest_date(df, ts), as_of, info_after, warn_after)


def freshness_of(latest: DataFrame, as_of: Column, info_after: int = 30, warn_after: int = 90) -> DataFrame:
    """Freshness of a one-row ``latest``."""
    age = elapsed_days(F.col("latest"), as_of)
    level = (
        F.when(F.col("days_old").isNull(), "unknown")
        .when(F.col("days_old") > warn_after, "warning")
        .when(F.col("days_old") > info_after, "info")
        .otherwise("fresh")
    )
    return (
        latest.select(F.to_date("latest").alias("latest_date"), age.alias("days_old"))
        .withColumn("level", level)
    )


def day_table(df: DataFrame, ts: str, district: str | None) -> DataFrame:
    """Rows per district and day as ``district, ds, y, oldest, newest``; missing districts and days stay NULL.

    Without a district column all rows count as UNKNOWN.
    """
    name = F.col(district) if district else F.lit(UNKNOWN)
    return df.groupBy(name.alias("district"), F.to_date(ts).alias("ds")).agg(
        F.count("*").alias("y"), F.min(ts).alias("oldest"), F.max(ts).alias("newest")
    )


def profile_of(days: DataFrame) -> DataFrame:
    """One row of counts that all checks are read from."""
    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("y"))), F.lit(0))

    return days.agg(
        rows_where(F.lit(True)).alias("n_rows"),
        rows_where(F.col("ds").isNull()).alias("invalid_dates"),
        rows_where(F.col("district").isNull()).alias("missing_districts"),
        F.count_distinct("ds").alias("unique_days"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
    ).withColumn("span_days", elapsed_days(F.col("oldest"), F.col("newest")))


def quality_profile(df: DataFrame, ts: str, district: str | None) -> DataFrame:
    return profile_of(day_table(df, ts, district))


def quality_checks(profile: DataFrame) -> DataFrame:
    """One row per check: name, severity, observed value, reference value, whether it fires, and a message."""
    n, bad, missing = F.col("n_rows"), F.col("invalid_dates"), F.col("missing_districts")
    days, span = F.col("unique_days"), F.col("span_days")
    filled = n > 0

    def check(name, severity, observed, reference, fired, message):
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(severity).alias("severity"),
            observed.cast("bigint").alias("observed"),
            reference.cast("bigint").alias("reference"),
            F.coalesce(fired, F.lit(False)).alias("fired"),
            message.alias("message"),
        )

    share = F.format_string("%.1f", F.try_divide(bad * 100.0, n))
    covered = F.format_string("%.1f", F.try_divide(days * 100.0, span))
    checks = [
        check("empty", "ERROR", n, F.lit(0), n == 0, F.lit("no rows")),
        check("dates", "WARNING", bad, n, filled & (bad > n * 0.1),
              F.concat(bad, F.lit(" of "), n, F.lit(" times are unreadable, "), share, F.lit("%"))),
        check("districts", "WARNING", missing, n, filled & (missing > 0),
              F.concat(missing, F.lit(" of "), n, F.lit(" districts are empty"))),
        check("coverage", "WARNING", days, span, (span > 0) & (days < span * 0.8),
              F.concat(days, F.lit(" days occur in a range of "), span, F.lit(", "), covered, F.lit("%"))),
        check("span", "WARNING", span, F.lit(3650), span > 3650,
              F.concat(F.lit("over ten years, from "), F.to_date("oldest"), F.lit(" until "), F.to_date("newest"))),
    ]
    return profile.select(F.inline(F.array(*checks)))


def validate_data(df: DataFrame, ts: str, district: str | None) -> DataFrame:
    """The checks that fire. An empty table yields the single ERROR row."""
    return quality_checks(quality_profile(df, ts, district)).filter("fired").drop("fired")


def metadata_of(
    days: DataFrame, last_updated: Column, data_source: str = "", resource_id: str = ""
) -> DataFrame:
    """One nested row: date range, row count and the sorted districts, each name once.

    The list of districts is one array, as large as the district dimension.
    """
    per_district = days.groupBy("district").agg(
        F.sum("y").alias("n"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest")
    )
    total_days = F.coalesce(elapsed_days(F.col("oldest"), F.col("newest")), F.lit(0))
    return per_district.agg(
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.sum("n").alias("total_records"),
        F.array_sort(F.collect_list("district")).alias("districts"),
    ).select(
        last_updated.cast("string").alias("last_updated"),
        F.struct(
            F.to_date("oldest").cast("string").alias("start"),
            F.to_date("newest").cast("string").alias("end"),
            total_days.alias("total_days"),
        ).alias("date_range"),
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        "districts",
        F.lit(data_source).alias("data_source"),
        F.lit(resource_id).alias("resource_id"),
    )


def dataset_metadata(
    df: DataFrame,
    ts: str,
    district: str,
    last_updated: Column,
    data_source: str = "",
    resource_id: str = "",
) -> DataFrame:
    return metadata_of(day_table(df, ts, district), last_updated, data_source, resource_id)
