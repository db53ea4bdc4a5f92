"""Edge cases of series, splits, baselines, metrics and models."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyground.functions.stats import improvement_pct, quality_flag
from tallyground.operators import additive, baselines, metrics, ridge, series, split
from tallyground.plans import forecast as plan
from tallyground.settings import ForecastSettings

START = dt.date(2023, 1, 1)


def daily(spark, values, name="a", start=START, step=1):
    rows = [(name, start + dt.timedelta(days=i * step), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ds date, y double")


def test_split_of_the_published_range(spark):
    bounds = split.ratio_split(spark.createDataFrame(
        [(dt.date(2023, 1, 1),), (dt.date(2025, 4, 4),)], "ds date")).first()
    assert (bounds.train_start, bounds.train_end, bounds.test_end) == (
        dt.date(2023, 1, 1), dt.date(2024, 10, 21), dt.date(2025, 2, 21))
    assert (bounds.future_start, bounds.future_end) == (dt.date(2025, 4, 5), dt.date(2025, 6, 4))


def test_split_labels_cover_all_rows(spark):
    rows = daily(spark, range(100))
    labels = split.split_label(rows, split.ratio_split(rows)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in labels} == {"train": 80, "test": 14, "buffer": 6}


def test_one_row_series_is_not_capped(spark):
    row = series.cap_outliers(daily(spark, [7]), ["series"]).first()
    assert (row.y, row.is_capped) == (7.0, False)
    gap = series.max_gap(daily(spark, [7]), ["series"]).first()
    assert gap.max_gap is None and gap.large_gap is False


def test_exactly_three_sigma_is_not_capped(spark):
    # Nine equal values and one other lie within 3 sigma of their mean; twenty and one do not.
    few = series.outlier_counts(daily(spark, [0] * 9 + [10]), ["series"]).first()
    many = series.outlier_counts(daily(spark, [0] * 20 + [10]), ["series"]).first()
    assert (few.outliers, many.outliers) == (0, 1)
    limit = spark.range(1).select(
        series.is_outlier(F.lit(16.0), F.lit(10.0), F.lit(2.0), 3.0).alias("on"),
        series.is_outlier(F.lit(16.01), F.lit(10.0), F.lit(2.0), 3.0).alias("over"),
    ).first()
    assert (limit.on, limit.over) == (False, True)


def test_capped_values_stay_within_the_limit(spark):
    values = [5] * 50 + [500, -400]
    mean, std = np.mean(values), np.std(values, ddof=1)
    got = [r.y for r in series.cap_outliers(daily(spark, values), ["series"]).collect()]
    assert max(got) <= mean + 3 * std + 1e-9 and min(got) >= mean - 3 * std - 1e-9


@pytest.mark.parametrize("step, expected", [(30, False), (31, True)])
def test_gap_warns_above_thirty_days(spark, step, expected):
    assert series.max_gap(daily(spark, [1, 1], step=step), ["series"]).first().large_gap is expected


@pytest.mark.parametrize("days, expected", [(13, "skip"), (14, "weekly"), (729, "weekly"), (730, "weekly+yearly")])
def test_seasonality_gate(spark, days, expected):
    assert series.seasonality_gate(daily(spark, [1] * days), ["series"]).first().seasonality == expected


@pytest.mark.parametrize("records, expected", [(9, "skipped"), (10, "ok")])
def test_training_gate(spark, records, expected):
    bounds = F.lit(START), F.lit(START + dt.timedelta(days=99))
    assert series.training_gate(daily(spark, [1] * records), ["series"], *bounds).first().status == expected


def test_sparse_and_dense_counts(spark):
    rows = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 5)), ("a", dt.datetime(2024, 1, 1, 6)), ("a", dt.datetime(2024, 1, 4)),
         ("b", dt.datetime(2024, 1, 2)), ("b", None)], "series string, ts timestamp_ntz")
    assert series.daily_counts(rows.dropna(), "ts", ["series"]).count() == 3
    dense = sorted((r.series, r.ds.day, r.y) for r in series.daily_counts_dense(rows, "ts", ["series"]).collect())
    assert dense == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 2, 1)]


def test_published_improvement(spark):
    row = spark.range(1).select(
        improvement_pct(F.lit(11.46), F.lit(4.68)).alias("gain"),
        improvement_pct(F.lit(0.0), F.lit(1.0)).alias("none"),
        quality_flag(F.lit(-0.9)).alias("flag"),
    ).first()
    assert round(row.gain, 1) == 59.2 and row.none is None and row.flag == "warning"


def test_constant_series_has_no_improvement(spark):
    train, test = daily(spark, [5] * 40), daily(spark, [5] * 5, start=START + dt.timedelta(days=40))
    errors = baselines.baseline_errors(train, test, ["series"])
    assert errors.first().naive_mae == 0
    scored = test.select("series", "ds", F.lit(5.0).alias("yhat"), F.lit(5.0).alias("yhat_lower"),
                         F.lit(5.0).alias("yhat_upper"))
    rows = metrics.eval_join(test, scored, ["series"]).join(baselines.baseline_values(train, ["series"]), "series")
    row = metrics.series_metrics(metrics.error_metrics(rows, ["series"], baselines.BASELINES)).first()
    assert row.improvement_pct is None and row.coverage == 1.0


def test_zero_actual_uses_machine_eps(spark):
    scored = daily(spark, [0]).selectExpr("*", "1.0D AS yhat", "0D AS yhat_lower", "2D AS yhat_upper")
    assert metrics.error_metrics(scored, ["series"]).first().mape == pytest.approx(100 / 2.220446049250313e-16)


def test_no_matching_days_gives_no_row(spark):
    test = daily(spark, [1, 2])
    scored = daily(spark, [1], start=dt.date(2030, 1, 1)).selectExpr(
        "series", "ds", "y AS yhat", "y AS yhat_lower", "y AS yhat_upper")
    assert metrics.evaluate_forecast(test, scored, ["series"]).count() == 0


def test_tail_means_use_observed_rows(spark):
    row = baselines.baseline_values(daily(spark, range(10), step=5), ["series"]).first()
    assert (row.naive, row.ma7, row.ma30) == (9.0, 6.0, 4.5)


def test_best_and_worst_ties_go_by_name(spark):
    rows = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("d", 2.0), ("c", 2.0)], "series string, mae double")
    row = metrics.best_worst_series(rows, "series").first()
    assert (row.best_series, row.worst_series) == ("a", "c")


def planted(days, weekend=6.0, slope=0.02, noise=0.5):
    rng = np.random.default_rng(7)
    out = []
    for i in range(days):
        day = START + dt.timedelta(days=i)
        season = 3 * math.sin(2 * math.pi * day.timetuple().tm_yday / 365.25)
        out.append(20 + slope * i + (weekend if day.weekday() >= 5 else 0) + season + rng.normal(0, noise))
    return out


def test_closed_form_finds_trend_and_weekend(spark):
    model = additive.fit_additive_sql(daily(spark, planted(1096)), ["series"]).first()
    weekend = (model.weekly[1] + model.weekly[7]) / 2 - sum(model.weekly[d] for d in range(2, 7)) / 5
    assert model.slope == pytest.approx(0.02, abs=0.005) and weekend == pytest.approx(6, abs=0.2)


def test_single_day_model_is_its_value(spark):
    model = additive.fit_additive_sql(daily(spark, [4]), ["series"])
    row = additive.predict_components(model, F.col("t0"), F.date_add("t0", 1)).orderBy("ds").first()
    assert row.yhat == pytest.approx(4) and row.yhat_lower == row.yhat_upper


@pytest.mark.parametrize("model", [plan.CLOSED_FORM, plan.RIDGE])
def test_models_beat_naive_and_cover(spark, model):
    rows = daily(spark, planted(900))
    result = plan.forecast(rows, ["series"], ForecastSettings(), model)
    row = result.metrics.first()
    assert row.mae < row.baseline_naive_mae and row.improvement_pct > 0
    if model is plan.RIDGE:
        assert 0.6 <= row.coverage <= 0.95 and row.mae < 1.0
    assert result.future.count() == 61
    assert result.status.first().status == "success"


def test_ridge_predicts_components_that_add_up(spark):
    model = ridge.fit_additive_ridge(daily(spark, planted(400)), ["series"])
    rows = ridge.predict_ridge(model, F.col("t0"), F.date_add("last_day", 5)).collect()
    assert len(rows) == 405
    assert all(abs(r.trend + r.weekly + r.yearly + r.holidays - r.yhat) < 1e-9 for r in rows)


def test_short_series_is_skipped_and_others_run(spark):
    rows = daily(spark, planted(200)).union(daily(spark, [1, 2, 3], name="short"))
    status = {r.series: r.status for r in plan.forecast(rows, ["series"]).status.collect()}
    assert status == {"a": "success", "short": "skipped"}
    assert [r.series for r in plan.forecast(rows, ["series"]).metrics.collect()] == ["a"]


def test_trend_changes_are_sparse_and_optimal(spark):
    """A trend with one change keeps few hinges, and the coefficients meet the conditions of the optimum."""
    rng = np.random.default_rng(3)
    days = np.arange(600)
    values = 20 + 0.02 * days + np.where(days > 300, 0.1 * (days - 300), 0) + rng.normal(0, 1, 600)
    rows = daily(spark, values)
    models = ridge.fit_additive_ridge(rows, ["series"]).collect()
    hinges = np.array(models[0].beta)[ridge.HINGE]
    assert 1 <= (hinges != 0).sum() <= 12 and abs(hinges).sum() > 0
    gap = ridge.ridge_gap(rows, ridge.fit_additive_ridge(rows, ["series"]), ["series"]).first().gap
    assert gap < 1e-6
    flat = ridge.fit_additive_ridge(daily(spark, 20 + rng.normal(0, 1, 600)), ["series"]).first()
    assert (np.array(flat.beta)[ridge.HINGE] != 0).sum() <= 3


def test_solver_against_a_plain_descent():
    rng = np.random.default_rng(5)
    x, prior = rng.normal(size=(80, 7)), np.array([5.0, 5.0, 0.05, 0.05, 0.05, 10.0, 10.0])
    y = x @ np.array([1.0, 2.0, 0.0, 3.0, 0.0, 1.0, -1.0]) + rng.normal(0, 0.1, 80)
    beta, _, noise, scale = ridge.additive_solver(prior, slice(2, 5))(x, y)

    def loss(b):
        rest, pull = y / scale - x @ b, np.abs(b) / prior
        return rest @ rest / (2 * noise) + (pull[[0, 1, 5, 6]] ** 2).sum() / 2 + pull[2:5].sum()

    best = loss(beta / scale)
    for _ in range(3000):
        assert loss(beta / scale + rng.normal(size=7) * 10 ** rng.uniform(-6, -1)) >= best - 1e-9


def test_intervals_widen_with_the_horizon(spark):
    rng = np.random.default_rng(7)
    days, rows = np.arange(700), []
    for k in range(12):
        slopes = np.zeros(700)
        for at in rng.integers(50, 640, 8):
            slopes[at:] += rng.laplace(0, 0.05)
        values = 60 + np.cumsum(slopes) + 3 * np.sin(days * 2 * np.pi / 7) + rng.normal(0, 2, 700)
        rows += [(f"s{k:02d}", START + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, values)]
    rows += [("flat", START + dt.timedelta(days=int(d)), 10.0) for d in days]
    frame = spark.createDataFrame(rows, "series string, ds date, y double")
    models = ridge.fit_additive_ridge(frame.filter(F.col("ds") < START + dt.timedelta(days=640)), ["series"])
    ahead = additive.model_calendar(models, F.date_sub("last_day", 5), F.date_add("last_day", 60))
    scored = ridge.score_ridge(ahead, 0.8, ["series"])
    got = scored.withColumn("w", F.col("yhat_upper") - F.col("yhat_lower")).join(frame, ["series", "ds"], "left").collect()
    covered = [r.yhat_lower <= r.y <= r.yhat_upper for r in got if r.y is not None and r.series != "flat" and r.ds >= START + dt.timedelta(days=640)]
    assert 0.6 <= np.mean(covered) <= 0.97
    by_series = {}
    for r in sorted(got, key=lambda r: r.ds):
        by_series.setdefault(r.series, []).append(r.w)
    for name, widths in by_series.items():
        assert np.allclose(widths[:6], widths[0])  # days of the fit
        assert widths == sorted(widths) or name == "flat"
        if name != "flat":
            assert widths[-1] > widths[6]
    assert np.mean([w[-1] / w[6] for name, w in by_series.items() if name != "flat"]) > 1.05
    again = ridge.score_ridge(ahead.repartition(7), 0.8, ["series"]).select("series", "ds", "yhat_lower").collect()
    assert sorted(again) == sorted(scored.select("series", "ds", "yhat_lower").collect())
