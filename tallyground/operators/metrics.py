"""Comparing forecasts with actual values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.functions.stats import MACHINE_EPS, improvement_pct, quality_flag

FORECAST_COLUMNS = ["yhat", "yhat_lower", "yhat_upper"]


def eval_join(actual: DataFrame, forecast: DataFrame, by: list[str]) -> DataFrame:
    """Actual rows that have a forecast."""
    keys = [*by, "ds"]
    return actual.join(forecast.select(*keys, *FORECAST_COLUMNS), keys, "inner")


def test_results_join(actual: DataFrame, forecast: DataFrame, by: list[str]) -> DataFrame:
    """All actual rows, the forecast NULL where there is none."""
    keys = [*by, "ds"]
    return actual.join(forecast.select(*keys, *FORECAST_COLUMNS), keys, "left")


def error_metrics(scored: DataFrame, by: list[str], baselines: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, MAPE in percent, interval coverage as a share, and the row count per series.

    ``baselines`` names further forecasts in the same rows; each adds its MAE.
    """
    y, yhat = F.col("y").cast("double"), F.col("yhat")
    covered = (y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper"))
    others = [F.avg(F.abs(y - F.col(name))).alias(f"baseline_{name}_mae") for name in baselines or []]
    return scored.groupBy(*by).agg(
        F.avg(F.abs(y - yhat)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - yhat, F.lit(2.0)))).alias("rmse"),
        (F.avg(F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(MACHINE_EPS))) * 100).alias("mape"),
        F.avg(covered.cast("double")).alias("coverage"),
        F.count("*").alias("test_samples"),
        *others,
    )


def evaluate_forecast(actual: DataFrame, forecast: DataFrame, by: list[str]) -> DataFrame:
    """A series without matching days has no row."""
    return error_metrics(eval_join(actual, forecast, by), by)


def fallback_metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """MAE and RMSE from saved results; rows without a forecast are skipped."""
    error = F.col("y") - F.col("yhat")
    return results.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(F.pow(error, F.lit(2.0)))).alias("rmse")
    )


def series_metrics(errors: DataFrame) -> DataFrame:
    """Errors of the model and of the baselines with the gain over the naive forecast, one row per series."""
    return errors.withColumn(
        "improvement_pct", improvement_pct(F.col("baseline_naive_mae"), F.col("mae"))
    ).withColumn("quality", quality_flag(F.col("improvement_pct")))


def summary_means(metrics: DataFrame) -> DataFrame:
    """Averages over all series; coverage in percent."""
    return metrics.agg(
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("mape").alias("mape"),
        (F.avg("coverage") * 100).alias("coverage_pct"),
        F.avg("improvement_pct").alias("improvement_pct"),
    ).withColumn("quality", quality_flag(F.col("improvement_pct")))


def best_worst_series(metrics: DataFrame, series: str) -> DataFrame:
    """Series with the smallest and the largest MAE; equal errors go to the first name."""
    name = F.col(series)
    return metrics.agg(
        F.min_by(name, F.struct(F.col("mae"), name)).alias("best_series"),
        F.min("mae").alias("best_mae"),
        F.min_by(name, F.struct(-F.col("mae"), name)).alias("worst_series"),
        F.max("mae").alias("worst_mae"),
    )


def summary_report(metrics: DataFrame, series: str) -> DataFrame:
    """Averages with the best and worst series, one row."""
    name = F.col(series)
    return metrics.agg(
        F.count("*").alias("series"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("mape").alias("mape"),
        (F.avg("coverage") * 100).alias("coverage_pct"),
        F.avg("improvement_pct").alias("improvement_pct"),
        F.min_by(name, F.struct(F.col("mae"), name)).alias("best_series"),
        F.min_by(name, F.struct(-F.col("mae"), name)).alias("worst_series"),
    )


def series_ranking(metrics: DataFrame, series: str) -> DataFrame:
    return metrics.orderBy("mae", series)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))
