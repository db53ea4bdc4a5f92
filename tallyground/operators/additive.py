"""Additive daily model: linear trend, weekday, month and holiday effects, in closed form.

One model is one row: trend numbers plus small maps of effects (7 weekdays, 12 months, a dozen
holidays). Scoring explodes a calendar beside that row and looks the effects up, so it joins nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.functions.holidays import holiday_name
from tallyground.functions.stats import interval_factor


def _effects(level: str, effect: str) -> Column:
    """Map level → effect. The set has one entry per level since an effect is constant on its level."""
    entry = F.when(F.col(level).isNotNull(), F.struct(F.col(level), F.col(effect)))
    return F.map_from_entries(F.array_sort(F.collect_set(entry)))


def fit_additive_sql(
    rows: DataFrame,
    by: list[str],
    yearly: Column | bool = True,
    holidays: bool = True,
    weekly: bool = True,
) -> DataFrame:
    """Fit ``ds, y`` per group, one term after another on what the earlier terms leave.

    Output per group: ``t0, slope, intercept, weekly, yearly, holidays, sigma, last_day, n``. All windows share
    the group as their partition prefix, so the rows are shuffled once.
    """
    group = Window.partitionBy(*by)

    def mean_over(value: Column, level: str) -> Column:
        return F.avg(value).over(Window.partitionBy(*by, level))

    y, t = F.col("y").cast("double"), F.col("t")
    yearly = yearly if isinstance(yearly, Column) else F.lit(yearly)
    holiday = holiday_name(F.col("ds")) if holidays else F.lit(None).cast("string")
    slope = F.coalesce(F.try_divide(F.covar_pop(y, t).over(group), F.var_pop(t).over(group)), F.lit(0.0))
    return (
        rows.withColumn("t0", F.min("ds").over(group))
        .withColumn("t", F.date_diff("ds", "t0").cast("double"))
        .withColumn("slope", slope)
        .withColumn("intercept", F.avg(y).over(group) - F.col("slope") * F.avg(t).over(group))
        .withColumn("rest", y - (F.col("intercept") + F.col("slope") * t))
        .withColumn("weekday", F.when(F.lit(weekly), F.dayofweek("ds")))
        .withColumn("month", F.when(yearly, F.month("ds")))
        .withColumn("holiday", holiday)
        .withColumn("weekly_effect", F.when(F.col("weekday").isNotNull(), mean_over(F.col("rest"), "weekday")))
        .withColumn("rest", F.col("rest") - F.coalesce("weekly_effect", F.lit(0.0)))
        .withColumn("yearly_effect", F.when(F.col("month").isNotNull(), mean_over(F.col("rest"), "month")))
        .withColumn("rest", F.col("rest") - F.coalesce("yearly_effect", F.lit(0.0)))
        .withColumn("holiday_effect", F.when(F.col("holiday").isNotNull(), mean_over(F.col("rest"), "holiday")))
        .withColumn("rest", F.col("rest") - F.coalesce("holiday_effect", F.lit(0.0)))
        .groupBy(*by)
        .agg(
            F.first("t0").alias("t0"),
            F.first("slope").alias("slope"),
            F.first("intercept").alias("intercept"),
            _effects("weekday", "weekly_effect").alias("weekly"),
            _effects("month", "yearly_effect").alias("yearly"),
            _effects("holiday", "holiday_effect").alias("holidays"),
            F.stddev_samp("rest").alias("sigma"),
            F.max("ds").alias("last_day"),
            F.count("*").alias("n"),
        )
    )


def model_params(models: DataFrame, by: list[str]) -> DataFrame:
    """Long coefficient table: group, term, level, value."""
    def single(term: str) -> Column:
        return F.array(F.struct(F.lit(term).alias("term"), F.lit("").alias("level"), F.col(term).alias("value")))

    def many(term: str) -> Column:
        return F.transform(
            F.map_entries(term),
            lambda e: F.struct(F.lit(term).alias("term"), e["key"].cast("string").alias("level"), e["value"]),
        )

    terms = F.concat(
        single("slope"), single("intercept"), single("sigma"), many("weekly"), many("yearly"), many("holidays")
    )
    return models.select(*by, F.inline(terms))


def score_days(days: DataFrame, interval_width: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """Components, forecast and interval for rows that hold a model and a day ``ds``.

    The trend of this model never bends, so its interval is as wide on all days of a series, whatever ``by`` names it.
    """
    def effect(name: str, level: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(name), level), F.lit(0.0))

    trend = F.col("intercept") + F.col("slope") * F.date_diff("ds", "t0")
    model = ["t0", "slope", "intercept", "weekly", "yearly", "holidays", "sigma", "last_day", "n"]
    holiday = F.coalesce(holiday_name(F.col("ds")), F.lit(""))
    return (
        days.withColumns(
            {
                "trend": trend,
                "weekly_term": effect("weekly", F.dayofweek("ds")),
                "yearly_term": effect("yearly", F.month("ds")),
                "holidays_term": effect("holidays", holiday),
                "margin": interval_factor(interval_width) * F.coalesce("sigma", F.lit(0.0)),
            }
        )
        .drop(*model)
        .withColumnsRenamed({"weekly_term": "weekly", "yearly_term": "yearly", "holidays_term": "holidays"})
        .withColumn("yhat", F.col("trend") + F.col("weekly") + F.col("yearly") + F.col("holidays"))
        .withColumns({"yhat_lower": F.col("yhat") - F.col("margin"), "yhat_upper": F.col("yhat") + F.col("margin")})
        .drop("margin")
    )


def model_calendar(models: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every model row beside each day from ``first`` to ``last``; both may refer to columns of the model."""
    return models.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("ds"))


def predict_components(models: DataFrame, first: Column, last: Column, interval_width: float = 0.8) -> DataFrame:
    """Score every day from ``first`` to ``last``."""
    return score_days(model_calendar(models, first, last), interval_width)


def weekly_profile(forecast: DataFrame, by: list[str]) -> DataFrame:
    return forecast.groupBy(*by, F.dayofweek("ds").alias("weekday")).agg(F.avg("weekly").alias("effect"))


def yearly_profile(forecast: DataFrame, by: list[str]) -> DataFrame:
    return forecast.groupBy(*by, F.dayofyear("ds").alias("day_of_year")).agg(F.avg("yearly").alias("effect"))


def holiday_join(daily: DataFrame) -> DataFrame:
    """Daily rows with the holiday of their day, by rule, whatever the year."""
    return daily.withColumn("holiday", holiday_name(F.col("ds")))


def holiday_effects(forecast: DataFrame) -> DataFrame:
    """Forecast rows on a holiday."""
    return forecast.withColumn("holiday", holiday_name(F.col("ds"))).filter(F.col("holiday").isNotNull())
