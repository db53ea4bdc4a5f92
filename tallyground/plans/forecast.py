"""Forecast of every series: evaluation on the test range, then a refit and the months ahead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.operators.additive import fit_additive_sql, model_calendar, score_days
from tallyground.operators.baselines import BASELINES, baseline_values
from tallyground.operators.metrics import FORECAST_COLUMNS, error_metrics, series_metrics
from tallyground.operators.ridge import fit_additive_ridge, score_ridge
from tallyground.operators.series import cap_outliers, training_gate
from tallyground.operators.split import as_literals, date_split
from tallyground.settings import ForecastSettings, cut_lineage


@dataclass(frozen=True)
class Model:
    """How to fit rows per key, and how to score rows that hold a model and a day."""

    fit: Callable[[DataFrame, list[str], ForecastSettings], DataFrame]
    score: Callable[[DataFrame, float, list[str]], DataFrame]


def _fit_closed_form(rows: DataFrame, by: list[str], settings: ForecastSettings) -> DataFrame:
    return fit_additive_sql(rows, by, settings.yearly_seasonality, settings.include_holidays, settings.weekly_seasonality)


CLOSED_FORM = Model(_fit_closed_form, score_days)
RIDGE = Model(fit_additive_ridge, score_ridge)


@dataclass(frozen=True)
class ForecastResult:
    """Frames keyed by the series. The models are stored; the rest is computed when used."""

    status: DataFrame
    models: DataFrame
    test_results: DataFrame
    forecast: DataFrame
    future: DataFrame
    metrics: DataFrame


PHASES = ("initial", "final")


def phase_rows(
    daily: DataFrame, by: list[str], bounds: dict[str, Column], settings: ForecastSettings = ForecastSettings(),
    wanted: tuple[str, ...] = PHASES,
) -> DataFrame:
    """Training rows of the wanted fits with ``phase``, capped within each: ``initial`` from train_start to train_end, ``final``
    all rows to test_end.

    Series below the training gate are left out. The gate, the caps and the fit that follows all
    work inside a series, so one shuffle serves them.
    """
    ds = F.col("ds")
    in_training = ds.between(bounds["train_start"], bounds["train_end"])
    records = F.count_if(in_training).over(Window.partitionBy(*by))
    initial = F.when(in_training & F.lit("initial" in wanted), F.lit("initial"))
    phases = F.array_compact(F.array(initial, F.when(F.lit("final" in wanted), F.lit("final"))))
    rows = (
        daily.filter(ds <= bounds["test_end"])
        .withColumn("records", records)
        .filter(F.col("records") >= settings.min_training_records)
        .select(*by, "ds", "y", F.explode(phases).alias("phase"))
    )
    return cap_outliers(rows, [*by, "phase"], settings.outlier_threshold)


def _too_early(bounds: dict[str, Column]) -> Column:
    return F.date_diff(bounds["future_end"], bounds["test_end"]) < 1


def series_status(
    daily: DataFrame, by: list[str], bounds: dict[str, Column], settings: ForecastSettings = ForecastSettings()
) -> DataFrame:
    """One row per series: success, skipped below the training gate, or error when the future range is wrong."""
    gate = training_gate(daily, by, bounds["train_start"], bounds["train_end"], settings.min_training_records)
    skipped = F.col("status") == "skipped"
    too_early = _too_early(bounds)
    return gate.select(
        *by,
        "records",
        F.when(skipped, "skipped").when(too_early, "error").otherwise("success").alias("status"),
        F.when(skipped, "too few training days")
        .when(too_early, "the months ahead end before the test range")
        .alias("reason"),
    )


def forecast(
    daily: DataFrame,
    by: list[str],
    settings: ForecastSettings = ForecastSettings(),
    model: Model = CLOSED_FORM,
    wanted: tuple[str, ...] = PHASES,
) -> ForecastResult:
    """The whole job for all series at once. ``daily`` is read several times: hand it in stored or cut.

    With ``wanted`` only one of the fits is made: metrics, test results and ``forecast`` need the initial one, ``future`` the
    final one; frames of the other fit are empty then.
    """
    bounds = as_literals(date_split(daily, settings))
    rows = cut_lineage(phase_rows(daily, by, bounds, settings, wanted))
    models = cut_lineage(model.fit(rows, [*by, "phase"], settings))
    initial = models.filter("phase = 'initial'").drop("phase")
    final = models.filter("phase = 'final'").drop("phase")
    train = rows.filter("phase = 'initial'").select(*by, "ds", "y")
    width = settings.interval_width

    # The test days are scored beside their model, which joins on the series alone.
    test = daily.filter((F.col("ds") > bounds["train_end"]) & (F.col("ds") <= bounds["test_end"]))
    beside = initial.join(baseline_values(train, by), by)
    scored_test = model.score(test.select(*by, "ds", "y").join(beside, by), width, by)
    test_results = scored_test.select(*by, "ds", "y", *FORECAST_COLUMNS)
    metrics = series_metrics(error_metrics(scored_test, by, BASELINES))

    # A series without test rows is shown a fixed number of days ahead.
    last_test = test.groupBy(*by).agg(F.max("ds").alias("last_test"))
    horizon = F.coalesce("last_test", F.date_add("last_day", settings.fallback_days))
    shown = model_calendar(initial.join(last_test, by, "left"), F.col("t0"), horizon).drop("last_test")
    # The range ahead is the same for all series; where it is in error, none has a future.
    ahead = model_calendar(final, bounds["future_start"], bounds["future_end"]).filter(~_too_early(bounds))
    return ForecastResult(
        status=series_status(daily, by, bounds, settings),
        models=models,
        test_results=test_results,
        forecast=model.score(shown, width, by),
        future=model.score(ahead, width, by),
        metrics=metrics,
    )
