"""Daily series per group: counting, calendars, gaps and outliers.

Counting works on raw rows and is an aggregate. Everything after it works on one row per series and
day, so a window partition holds at most the number of days in the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.functions.stats import cap_value, is_outlier


def daily_counts(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Rows per group and day as ``ds, y``; days without rows are absent."""
    return df.groupBy(*by, F.to_date(ts).alias("ds")).agg(F.count("*").alias("y"))


def calendar_join(daily: DataFrame, by: list[str]) -> DataFrame:
    """Fill the days between the first and last of each series with zero.

    Each row knows the next day that exists and emits the empty days before it, which needs one
    shuffle on the series and no join with a calendar table.
    """
    following = F.lead("ds").over(Window.partitionBy(*by).orderBy("ds"))
    gap_end = F.coalesce(F.date_sub(following, 1), F.col("ds"))
    return (
        daily.withColumn("days", F.sequence(F.col("ds"), gap_end))
        .select(*by, "y", F.posexplode("days").alias("position", "ds"))
        .select(*by, "ds", F.when(F.col("position") == 0, F.col("y")).otherwise(F.lit(0)).alias("y"))
    )


def daily_counts_dense(df: DataFrame, ts: str, by: list[str]) -> DataFrame:
    """Rows per group and day, zero on the empty days in between. Rows without a time are ignored."""
    return calendar_join(daily_counts(df.dropna(subset=[ts]), ts, by), by)


def future_calendar(daily: DataFrame, by: list[str], days: int) -> DataFrame:
    """Each series' own days followed by ``days`` more."""
    ahead = (
        daily.groupBy(*by)
        .agg(F.max("ds").alias("last"))
        .select(*by, F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", days))).alias("ds"))
    )
    return daily.select(*by, "ds").unionByName(ahead)


def series_bounds(daily: DataFrame) -> DataFrame:
    """First and last day over all series, one row."""
    return daily.agg(F.min("ds").alias("first_day"), F.max("ds").alias("last_day"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def series_mean_std(daily: DataFrame, by: list[str]) -> DataFrame:
    return daily.groupBy(*by).agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("*").alias("n")
    )


def series_stats_join(daily: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample standard deviation of the series beside every row."""
    series = Window.partitionBy(*by)
    return daily.withColumns({"mean": F.avg("y").over(series), "std": F.stddev_samp("y").over(series)})


def cap_outliers(daily: DataFrame, by: list[str], threshold: float = 3.0) -> DataFrame:
    """``y`` clamped to mean ± threshold·std of its series, with ``is_capped``."""
    y, mean, std = F.col("y").cast("double"), F.col("mean"), F.col("std")
    return (
        series_stats_join(daily, by)
        .withColumn("is_capped", is_outlier(y, mean, std, threshold))
        .withColumn("y", cap_value(y, mean, std, threshold))
        .drop("mean", "std")
    )


def outlier_counts(daily: DataFrame, by: list[str], threshold: float = 3.0) -> DataFrame:
    """Capped rows per series and their share."""
    return (
        cap_outliers(daily, by, threshold)
        .groupBy(*by)
        .agg(F.count_if("is_capped").alias("outliers"), F.avg(F.col("is_capped").cast("double")).alias("share"))
    )


def max_gap(daily: DataFrame, by: list[str], warn_after: int = 30) -> DataFrame:
    """Longest distance between neighbouring days of a series; NULL with a single day."""
    previous = F.lag("ds").over(Window.partitionBy(*by).orderBy("ds"))
    return (
        daily.withColumn("gap", F.date_diff("ds", previous))
        .groupBy(*by)
        .agg(F.max("gap").alias("max_gap"))
        .withColumn("large_gap", F.coalesce(F.col("max_gap") > warn_after, F.lit(False)))
    )


def zero_ratio(dense: DataFrame, by: list[str], sparse_above: float = 0.9) -> DataFrame:
    return (
        dense.groupBy(*by)
        .agg(F.avg((F.col("y") == 0).cast("double")).alias("zero_ratio"))
        .withColumn("very_sparse", F.col("zero_ratio") > sparse_above)
    )


def training_gate(daily: DataFrame, by: list[str], first: Column, last: Column, min_records: int = 10) -> DataFrame:
    """Rows of each series in the training window and whether that is enough to fit."""
    inside = F.col("ds").between(first, last)
    return (
        daily.groupBy(*by)
        .agg(F.count_if(inside).alias("records"))
        .withColumn("status", F.when(F.col("records") < min_records, "skipped").otherwise("ok"))
    )


def seasonality_gate(dense: DataFrame, by: list[str], min_weekly: int = 14, min_yearly: int = 730) -> DataFrame:
    """Days per series and which seasonal terms that supports."""
    days = F.col("days")
    return (
        dense.groupBy(*by)
        .agg(F.count("*").alias("days"))
        .withColumn(
            "seasonality",
            F.when(days < min_weekly, "skip").when(days < min_yearly, "weekly").otherwise("weekly+yearly"),
        )
    )
