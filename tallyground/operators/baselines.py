"""Simple forecasts a model has to beat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINES = ["naive", "ma7", "ma30"]


def baseline_values(train: DataFrame, by: list[str]) -> DataFrame:
    """Per series: last value, and the mean of the last 7 and 30 observed rows."""
    newest_first = Window.partitionBy(*by).orderBy(F.desc("ds"))
    row = F.col("row")
    return (
        train.withColumn("row", F.row_number().over(newest_first))
        .groupBy(*by)
        .agg(
            F.max(F.when(row == 1, F.col("y"))).alias("naive"),
            F.avg(F.when(row <= 7, F.col("y"))).alias("ma7"),
            F.avg(F.when(row <= 30, F.col("y"))).alias("ma30"),
        )
    )


def naive_last(train: DataFrame, by: list[str]) -> DataFrame:
    return train.groupBy(*by).agg(F.max_by("y", "ds").alias("naive"))


def tail_mean(train: DataFrame, by: list[str], n: int) -> DataFrame:
    newest_first = Window.partitionBy(*by).orderBy(F.desc("ds"))
    return (
        train.withColumn("row", F.row_number().over(newest_first))
        .filter(F.col("row") <= n)
        .groupBy(*by)
        .agg(F.avg("y").alias(f"ma{n}"))
    )


def seasonal_naive(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """Test rows with the last training value of the same weekday."""
    weekday = F.dayofweek("ds")
    last = train.groupBy(*by, weekday.alias("weekday")).agg(F.max_by("y", "ds").alias("yhat"))
    return test.withColumn("weekday", weekday).join(last, [*by, "weekday"], "left").drop("weekday")


def baseline_errors(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute error of each baseline on the test rows."""
    errors = [F.avg(F.abs(F.col("y") - F.col(name))).alias(f"{name}_mae") for name in BASELINES]
    return test.join(baseline_values(train, by), by).groupBy(*by).agg(*errors)
