"""Date bounds of training, test and future, and the label of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyground.functions.stats import ratio_days
from tallyground.operators.series import series_bounds
from tallyground.settings import ForecastSettings


def ratio_split(daily: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """One row of bounds from the first and last day over all series."""
    total = F.date_diff("last_day", "first_day")
    train_end = F.date_add("first_day", ratio_days(total, settings.train_ratio))
    future_start = F.date_add("last_day", settings.forecast_start_offset_days)
    return series_bounds(daily).select(
        F.col("first_day").alias("train_start"),
        train_end.alias("train_end"),
        F.date_add(train_end, ratio_days(total, settings.test_ratio)).alias("test_end"),
        future_start.alias("future_start"),
        F.date_add(future_start, settings.future_months * 30).alias("future_end"),
    )


def fixed_split(daily: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    """One row of bounds from the settings."""
    test_end = F.lit(settings.test_end)
    return daily.sparkSession.range(1).select(
        F.lit(settings.train_start).alias("train_start"),
        F.lit(settings.train_end).alias("train_end"),
        test_end.alias("test_end"),
        F.date_add(test_end, 1).alias("future_start"),
        F.date_add(test_end, 1 + settings.future_months * 30).alias("future_end"),
    )


def date_split(daily: DataFrame, settings: ForecastSettings = ForecastSettings()) -> DataFrame:
    return fixed_split(daily, settings) if settings.use_fixed_dates else ratio_split(daily, settings)


def as_literals(split: DataFrame) -> dict[str, Column]:
    """The five dates of the one-row split as literals, so that filters on them reach the scan."""
    row = split.first()
    return {name: F.lit(row[name]).cast("date") for name in split.columns}


def split_label(daily: DataFrame, split: DataFrame) -> DataFrame:
    """Add ``split``: train up to train_end, test up to test_end, buffer after it, before ahead of train_start."""
    bounds = as_literals(split)
    return daily.withColumn(
        "split",
        F.when(F.col("ds") < bounds["train_start"], "before")
        .when(F.col("ds") <= bounds["train_end"], "train")
        .when(F.col("ds") <= bounds["test_end"], "test")
        .otherwise("buffer"),
    )
