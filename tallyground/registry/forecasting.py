"""Daily series, splits, baselines, models and their evaluation."""

from datetime import date

from pyspark.sql import functions as F

from tallyground.functions.holidays import us_holidays as holiday_table
from tallyground.operators import additive, baselines, metrics, ridge, series, split
from tallyground.plans import forecast as plan
from tallyground.registry.catalog import query, rounded, rounds
from tallyground.registry.inputs import HOLIDAY_CASE, incident_daily, oracle, view
from tallyground.settings import ForecastSettings, cut_lineage, scratch_path
from tallyground.sources import store

SERIES = ["district"]
PHASED = ["district", "phase"]
COMPONENTS = ["trend", "weekly", "yearly", "holidays", "yhat", "yhat_lower", "yhat_upper"]
METRICS = ["mae", "rmse", "mape", "coverage", "baseline_naive_mae", "baseline_ma7_mae", "baseline_ma30_mae",
           "improvement_pct"]


def _user_daily(spark, sf_dir):
    return series.daily_counts(view(spark, sf_dir, "ev"), "ts", ["user_id"])


def _forecast(spark, sf_dir, settings=ForecastSettings(), model=plan.CLOSED_FORM, wanted=plan.PHASES):
    daily = incident_daily(spark, sf_dir)
    return plan.forecast(cut_lineage(daily), SERIES, settings, model, wanted)


def _phase_rows(spark, sf_dir):
    daily = cut_lineage(incident_daily(spark, sf_dir))
    return plan.phase_rows(daily, SERIES, split.as_literals(split.ratio_split(daily)))


# Series ----------------------------------------------------------------------------------------------------------


@query("daily_counts", oracle("SELECT district, ds, y FROM {daily}"))
def daily_counts(spark, sf_dir):
    return incident_daily(spark, sf_dir)


@query("daily_counts_dense", oracle("SELECT user_id, ds, y FROM {user_dense}"))
def daily_counts_dense(spark, sf_dir):
    return series.daily_counts_dense(view(spark, sf_dir, "ev"), "ts", ["user_id"])


@query(
    "calendar_join",
    oracle("""SELECT c.district, c.ds, coalesce(d.y, 0) AS y
              FROM (SELECT district, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
                    FROM {daily} GROUP BY district) c
              LEFT JOIN {daily} d ON c.district = d.district AND c.ds = d.ds"""),
)
def calendar_join(spark, sf_dir):
    return series.calendar_join(incident_daily(spark, sf_dir), SERIES)


@query(
    "future_calendar",
    oracle("""SELECT user_id, ds FROM {user_daily} UNION ALL
              SELECT user_id, CAST(unnest(generate_series(max(ds) + 1, max(ds) + 30, INTERVAL 1 DAY)) AS DATE) AS ds
              FROM {user_daily} GROUP BY user_id"""),
)
def future_calendar(spark, sf_dir):
    return series.future_calendar(_user_daily(spark, sf_dir), ["user_id"], 30)


@query("series_bounds", oracle("SELECT min(ds) AS first_day, max(ds) AS last_day FROM {daily}"))
def series_bounds(spark, sf_dir):
    return series.series_bounds(incident_daily(spark, sf_dir))


@query(
    "series_mean_std",
    oracle(f"""SELECT user_id, n, {rounds('mean', 'std')} FROM (
               SELECT user_id, avg(y) AS mean, stddev_samp(y) AS std, count(*) AS n FROM {{user_daily}} GROUP BY user_id)"""),
)
def series_mean_std(spark, sf_dir):
    return rounded(series.series_mean_std(_user_daily(spark, sf_dir), ["user_id"]))


@query(
    "series_stats_join",
    oracle(f"""SELECT district, ds, y, {rounds('mean', 'std')} FROM (
               SELECT *, avg(y) OVER w AS mean, stddev_samp(y) OVER w AS std FROM {{daily}}
               WINDOW w AS (PARTITION BY district))"""),
)
def series_stats_join(spark, sf_dir):
    return rounded(series.series_stats_join(incident_daily(spark, sf_dir), SERIES))


@query(
    "cap_outliers",
    oracle(f"""SELECT district, ds, is_capped, {rounds('y')} FROM (
               SELECT district, ds, abs(y - m) > 3 * s AS is_capped,
                      CASE WHEN y - m > 3 * s THEN m + 3 * s WHEN m - y > 3 * s THEN m - 3 * s ELSE y END AS y
               FROM (SELECT *, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM {{daily}}
                     WINDOW w AS (PARTITION BY district)))"""),
)
def cap_outliers(spark, sf_dir):
    return rounded(series.cap_outliers(incident_daily(spark, sf_dir), SERIES))


@query(
    "outlier_counts",
    oracle(f"""SELECT district, outliers, {rounds('share')} FROM (
               SELECT district, count(*) FILTER (abs(y - m) > 3 * s) AS outliers,
                      avg(CASE WHEN abs(y - m) > 3 * s THEN 1.0 ELSE 0.0 END) AS share
               FROM (SELECT *, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM {{daily}}
                     WINDOW w AS (PARTITION BY district)) GROUP BY district)"""),
)
def outlier_counts(spark, sf_dir):
    return rounded(series.outlier_counts(incident_daily(spark, sf_dir), SERIES))


@query(
    "max_gap",
    oracle("""SELECT user_id, CAST(max(gap) AS INT) AS max_gap, coalesce(max(gap) > 3, false) AS large_gap FROM (
              SELECT user_id, ds - lag(ds) OVER (PARTITION BY user_id ORDER BY ds) AS gap FROM {user_daily})
              GROUP BY user_id"""),
)
def max_gap(spark, sf_dir):
    return series.max_gap(_user_daily(spark, sf_dir), ["user_id"], warn_after=3)


@query(
    "zero_ratio",
    oracle(f"""SELECT user_id, {rounds('zero_ratio')}, zero_ratio > 0.5 AS very_sparse FROM (
               SELECT user_id, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio FROM {{user_dense}}
               GROUP BY user_id)"""),
)
def zero_ratio(spark, sf_dir):
    dense = series.daily_counts_dense(view(spark, sf_dir, "ev"), "ts", ["user_id"])
    return rounded(series.zero_ratio(dense, ["user_id"], sparse_above=0.5))


@query(
    "training_gate",
    oracle("""SELECT user_id, records, CASE WHEN records < 10 THEN 'skipped' ELSE 'ok' END AS status FROM (
              SELECT user_id, count(*) FILTER (ds BETWEEN DATE '2024-01-03' AND DATE '2024-01-20') AS records
              FROM {user_daily} GROUP BY user_id)"""),
)
def training_gate(spark, sf_dir):
    first, last = (F.to_date(F.lit(day)) for day in ("2024-01-03", "2024-01-20"))
    return series.training_gate(_user_daily(spark, sf_dir), ["user_id"], first, last, 10)


@query(
    "seasonality_gate",
    oracle("""SELECT series, days, CASE WHEN days < 14 THEN 'skip' WHEN days < 730 THEN 'weekly'
                                        ELSE 'weekly+yearly' END AS seasonality
              FROM (SELECT CAST(user_id AS VARCHAR) AS series, count(*) AS days FROM {user_dense} GROUP BY 1
                    UNION ALL SELECT district, max(ds) - min(ds) + 1 FROM {daily} GROUP BY 1)"""),
)
def seasonality_gate(spark, sf_dir):
    users = series.daily_counts_dense(view(spark, sf_dir, "ev"), "ts", ["user_id"])
    districts = series.calendar_join(incident_daily(spark, sf_dir), SERIES)
    both = users.select(F.col("user_id").cast("string").alias("series"), "ds", "y").unionByName(
        districts.select(F.col("district").alias("series"), "ds", "y")
    )
    return series.seasonality_gate(both, ["series"])


# Splits ----------------------------------------------------------------------------------------------------------


@query("ratio_split", oracle("SELECT train_start, train_end, test_end, future_start, future_end FROM {split}"))
def ratio_split(spark, sf_dir):
    return split.ratio_split(incident_daily(spark, sf_dir))


LABEL_SQL = """SELECT district, ds, y, CASE WHEN ds < train_start THEN 'before' WHEN ds <= train_end THEN 'train'
               WHEN ds <= test_end THEN 'test' ELSE 'buffer' END AS split FROM """


@query("split_label", oracle(LABEL_SQL + "{daily}, {split}"))
def split_label(spark, sf_dir):
    daily = cut_lineage(incident_daily(spark, sf_dir))
    return split.split_label(daily, split.ratio_split(daily))


@query(
    "fixed_split",
    oracle(LABEL_SQL + """{ev_daily}, (SELECT DATE '2024-01-05' AS train_start, DATE '2024-01-20' AS train_end,
                          DATE '2024-01-26' AS test_end)"""),
)
def fixed_split(spark, sf_dir):
    from datetime import date

    settings = ForecastSettings(
        use_fixed_dates=True,
        train_start=date(2024, 1, 5), train_end=date(2024, 1, 20), test_end=date(2024, 1, 26),
    )
    daily = series.daily_counts(view(spark, sf_dir, "ev"), "ts", SERIES)
    return split.split_label(daily, split.date_split(daily, settings))


# Baselines and metrics -------------------------------------------------------------------------------------------


@query("naive_last", oracle("SELECT district, max(y) FILTER (r = 1) AS naive FROM (SELECT *, row_number() OVER "
                            "(PARTITION BY district ORDER BY ds DESC) AS r FROM {daily}) GROUP BY district"))
def naive_last(spark, sf_dir):
    return baselines.naive_last(incident_daily(spark, sf_dir), SERIES)


def _register_tail(n: int) -> None:
    @query(
        f"tail_mean_{n}",
        oracle(f"""SELECT user_id, {rounds(f'ma{n}')} FROM (SELECT user_id, avg(y) AS ma{n} FROM (
                   SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ds DESC) AS r FROM {{user_daily}})
                   WHERE r <= {n} GROUP BY user_id)"""),
    )
    def tail(spark, sf_dir):
        return rounded(baselines.tail_mean(_user_daily(spark, sf_dir), ["user_id"], n))


_register_tail(7)
_register_tail(30)


@query(
    "seasonal_naive",
    oracle("""SELECT user_id, ds, y, yhat FROM (SELECT * FROM {user_daily} WHERE ds > DATE '2024-01-20') t
              LEFT JOIN (SELECT user_id, dayofweek(ds) AS wd, max_by(y, ds) AS yhat FROM {user_daily}
                         WHERE ds <= DATE '2024-01-20' GROUP BY ALL) s USING (user_id)
              WHERE s.wd = dayofweek(t.ds)
              UNION ALL
              SELECT user_id, ds, y, NULL FROM {user_daily} t WHERE ds > DATE '2024-01-20' AND NOT EXISTS (
                  SELECT 1 FROM {user_daily} s WHERE s.user_id = t.user_id AND s.ds <= DATE '2024-01-20'
                  AND dayofweek(s.ds) = dayofweek(t.ds))"""),
)
def seasonal_naive(spark, sf_dir):
    daily, cut = _user_daily(spark, sf_dir), F.to_date(F.lit("2024-01-20"))
    return baselines.seasonal_naive(daily.filter(F.col("ds") <= cut), daily.filter(F.col("ds") > cut), ["user_id"])


def _train_test(spark, sf_dir):
    rows = split.split_label(cut := cut_lineage(incident_daily(spark, sf_dir)), split.ratio_split(cut))
    train = series.cap_outliers(rows.filter("split = 'train'").select("district", "ds", "y"), SERIES)
    return train, rows.filter("split = 'test'").select("district", "ds", "y")


def _register_baseline(name: str, column: str) -> None:
    @query(name, oracle(f"SELECT district, {rounds(column)} FROM {{base_errors}}"))
    def baseline(spark, sf_dir):
        errors = baselines.baseline_errors(*_train_test(spark, sf_dir), SERIES)
        return rounded(errors.select("district", column))


_register_baseline("baseline_naive", "naive_mae")
_register_baseline("baseline_ma7", "ma7_mae")
_register_baseline("baseline_ma30", "ma30_mae")


def _simple_forecast(daily):
    """The mean of the series on weekdays, with the interval of its spread."""
    rows = series.series_stats_join(daily, SERIES).filter(F.weekday("ds") < 5)
    margin = 1.2815515655446004 * F.col("std")
    return rows.select(
        "district", "ds", F.col("mean").alias("yhat"),
        (F.col("mean") - margin).alias("yhat_lower"), (F.col("mean") + margin).alias("yhat_upper"),
    )


INTERVAL = rounds("yhat", "yhat_lower", "yhat_upper")


@query("eval_join", oracle(f"SELECT district, ds, y, {INTERVAL} FROM {{fc_actual}} JOIN {{fc}} USING (district, ds)"))
def eval_join(spark, sf_dir):
    daily = incident_daily(spark, sf_dir)
    return rounded(metrics.eval_join(daily, _simple_forecast(daily), SERIES))


@query("test_results_join", oracle(f"SELECT district, ds, y, {INTERVAL} FROM {{fc_actual}} LEFT JOIN {{fc}} USING (district, ds)"))
def test_results_join(spark, sf_dir):
    daily = incident_daily(spark, sf_dir)
    return rounded(metrics.test_results_join(daily, _simple_forecast(daily), SERIES))


SIMPLE_ERRORS = f"""SELECT district, test_samples, {rounds('mae', 'rmse', 'mape', 'coverage')} FROM (
    SELECT district, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
           avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape,
           avg(CASE WHEN y BETWEEN yhat_lower AND yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS test_samples
    FROM {{fc_actual}} JOIN {{fc}} USING (district, ds) GROUP BY district)"""


@query("error_metrics", oracle(SIMPLE_ERRORS))
def error_metrics(spark, sf_dir):
    daily = incident_daily(spark, sf_dir)
    return rounded(metrics.error_metrics(metrics.eval_join(daily, _simple_forecast(daily), SERIES), SERIES))


# The test range against the forecast of the model itself.
@query("evaluate_forecast", oracle(SIMPLE_ERRORS.replace("{fc_actual}", "{test}").replace("{fc}", "{scored}")))
def evaluate_forecast(spark, sf_dir):
    result = _forecast(spark, sf_dir, wanted=("initial",))
    actual = result.test_results.select("district", "ds", "y")
    return rounded(metrics.evaluate_forecast(actual, result.forecast, SERIES))


@query(
    "fallback_metrics",
    oracle(f"""SELECT district, {rounds('mae', 'rmse')} FROM (
               SELECT district, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse
               FROM {{fc_actual}} LEFT JOIN {{fc}} USING (district, ds) GROUP BY district)"""),
)
def fallback_metrics(spark, sf_dir):
    daily = incident_daily(spark, sf_dir)
    return rounded(metrics.fallback_metrics(metrics.test_results_join(daily, _simple_forecast(daily), SERIES), SERIES))


# The closed-form model -------------------------------------------------------------------------------------------

MODEL_SQL = f"SELECT district, phase, t0, last_day, n, {rounds('slope', 'intercept', 'sigma')} FROM {{fit_model}}"
PARAMS_SQL = f"""SELECT district, phase, term, level, {rounds('value')} FROM (
    SELECT district, phase, 'slope' AS term, '' AS level, slope AS value FROM {{fit_model}}
    UNION ALL SELECT district, phase, 'intercept', '', intercept FROM {{fit_model}}
    UNION ALL SELECT district, phase, 'sigma', '', sigma FROM {{fit_model}}
    UNION ALL SELECT district, phase, 'weekly', CAST(wd AS VARCHAR), we FROM {{fit_weekly}}
    UNION ALL SELECT district, phase, 'yearly', CAST(mo AS VARCHAR), ye FROM {{fit_yearly}}
    UNION ALL SELECT district, phase, 'holidays', hol, he FROM {{fit_holiday}})"""
SCORED = f"SELECT district, ds, {rounds(*COMPONENTS)} FROM "


@query("fit_additive_sql", oracle(MODEL_SQL))
def fit_additive_sql(spark, sf_dir):
    models = additive.fit_additive_sql(_phase_rows(spark, sf_dir), PHASED)
    return rounded(models.select("district", "phase", "t0", "last_day", "n", "slope", "intercept", "sigma"))


@query("retrain_full", oracle(MODEL_SQL + " WHERE phase = 'final'"))
def retrain_full(spark, sf_dir):
    models = _forecast(spark, sf_dir).models.filter("phase = 'final'")
    return rounded(models.select("district", "phase", "t0", "last_day", "n", "slope", "intercept", "sigma"))


@query("save_model_params", oracle(PARAMS_SQL))
def save_model_params(spark, sf_dir):
    path = scratch_path(spark, "params")
    store.save_model_params(additive.model_params(_forecast(spark, sf_dir).models, PHASED), path, "district")
    return rounded(store.load_series_outputs(spark, path))


@query("predict_components", oracle(SCORED + "{scored}"))
def predict_components(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir, wanted=("initial",)).forecast.select("district", "ds", *COMPONENTS))


@query(
    "prediction_interval",
    oracle(f"""SELECT t.district, t.ds, {rounds('width')}, covered FROM (
               SELECT t.district, t.ds, yhat_upper - yhat_lower AS width, y BETWEEN yhat_lower AND yhat_upper AS covered
               FROM {{test}} t JOIN {{scored}} f ON t.district = f.district AND t.ds = f.ds) t"""),
)
def prediction_interval(spark, sf_dir):
    results = _forecast(spark, sf_dir, wanted=("initial",)).test_results
    return rounded(
        results.select(
            "district", "ds", (F.col("yhat_upper") - F.col("yhat_lower")).alias("width"),
            F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).alias("covered"),
        )
    )


@query("future_forecast", oracle(SCORED + "{future}"))
def future_forecast(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir, wanted=("final",)).future.select("district", "ds", *COMPONENTS))


ALL_OUTPUTS = f"""SELECT 'future' AS output, district, ds, NULL AS y, {rounds('yhat')} FROM {{future}}
    UNION ALL SELECT 'forecast', district, ds, NULL, {rounds('yhat')} FROM {{scored}}
    UNION ALL SELECT 'test_results', t.district, t.ds, t.y, round(yhat, 6) + 0.0
              FROM {{test}} t JOIN {{scored}} f ON t.district = f.district AND t.ds = f.ds"""


def _saved_outputs(spark, sf_dir):
    """Every output of every series, saved: the future, the fitted range, the test rows and the metrics."""
    result, paths = _forecast(spark, sf_dir), {}
    outputs = {"future": result.future, "forecast": result.forecast, "test_results": result.test_results, "metrics": result.metrics}
    for name, df in outputs.items():
        paths[name] = scratch_path(spark, name)
        store.write_series_outputs(df, paths[name], "district")
    return paths


@query("write_series_outputs", oracle(ALL_OUTPUTS))
def write_series_outputs(spark, sf_dir):
    paths = _saved_outputs(spark, sf_dir)
    rows = None
    for name in ("future", "forecast", "test_results"):
        y = F.col("y") if name == "test_results" else F.lit(None)
        part = store.load_series_outputs(spark, paths[name]).select(
            F.lit(name).alias("output"), "district", "ds", y.cast("bigint").alias("y"), "yhat"
        )
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows)


@query("load_forecast", oracle(SCORED + "{future} WHERE district = 'MACHINERY'"))
def load_forecast(spark, sf_dir):
    path = scratch_path(spark, "future")
    store.write_series_outputs(_forecast(spark, sf_dir).future.select("district", "ds", *COMPONENTS), path, "district")
    return rounded(store.load_series_output(spark, path, "district", "MACHINERY"))


METRICS_SQL = f"SELECT district, test_samples, quality, {rounds(*METRICS)} FROM {{metrics}}"


@query("series_metrics", oracle(METRICS_SQL))
def series_metrics(spark, sf_dir):
    return rounded(_forecast(spark, sf_dir, wanted=("initial",)).metrics.select("district", "test_samples", "quality", *METRICS))


@query(
    "summary_means",
    oracle(f"""SELECT {rounds('mae', 'rmse', 'mape', 'coverage_pct', 'improvement_pct')}, quality FROM (
               SELECT avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape, avg(coverage) * 100 AS coverage_pct,
                      avg(improvement_pct) AS improvement_pct,
                      CASE WHEN avg(improvement_pct) > 0 THEN 'improves' ELSE 'warning' END AS quality FROM {{metrics}})"""),
)
def summary_means(spark, sf_dir):
    return rounded(metrics.summary_means(_forecast(spark, sf_dir).metrics))


@query(
    "best_worst_series",
    oracle(f"""SELECT best_series, worst_series, {rounds('best_mae', 'worst_mae')} FROM (
               SELECT (SELECT district FROM {{metrics}} ORDER BY mae, district LIMIT 1) AS best_series,
                      (SELECT district FROM {{metrics}} ORDER BY mae DESC, district LIMIT 1) AS worst_series,
                      (SELECT min(mae) FROM {{metrics}}) AS best_mae, (SELECT max(mae) FROM {{metrics}}) AS worst_mae)"""),
)
def best_worst_series(spark, sf_dir):
    return rounded(metrics.best_worst_series(_forecast(spark, sf_dir).metrics, "district"))


SUMMARY_SQL = f"""SELECT series, {rounds('mae', 'rmse', 'mape', 'coverage_pct', 'improvement_pct')}, best_series, worst_series
    FROM (SELECT count(*) AS series, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape,
                 avg(coverage) * 100 AS coverage_pct, avg(improvement_pct) AS improvement_pct,
                 (SELECT district FROM {{metrics}} ORDER BY mae, district LIMIT 1) AS best_series,
                 (SELECT district FROM {{metrics}} ORDER BY mae DESC, district LIMIT 1) AS worst_series
          FROM {{metrics}})"""


@query("summary_report", oracle(SUMMARY_SQL))
def summary_report(spark, sf_dir):
    return rounded(metrics.summary_report(_forecast(spark, sf_dir).metrics, "district"))


@query("write_summary", oracle(METRICS_SQL))
def write_summary(spark, sf_dir):
    path = scratch_path(spark, "summary")
    rows = _forecast(spark, sf_dir).metrics.select("district", "test_samples", "quality", *METRICS)
    store.write_summary(rows, path)
    return rounded(spark.read.schema(rows.schema).option("header", True).csv(path))


@query("series_ranking", oracle(f"SELECT district, {rounds('mae')} FROM {{metrics}} ORDER BY mae, district"))
def series_ranking(spark, sf_dir):
    return rounded(metrics.series_ranking(_forecast(spark, sf_dir).metrics, "district").select("district", "mae"))


STATUS_SQL = """SELECT district, count(*) FILTER (ds BETWEEN train_start AND train_end) AS records,
    CASE WHEN count(*) FILTER (ds BETWEEN train_start AND train_end) < 10 THEN 'skipped' ELSE 'success' END AS status,
    CASE WHEN count(*) FILTER (ds BETWEEN train_start AND train_end) < 10 THEN 'too few training days' END AS reason
    FROM {daily}, {split} GROUP BY district"""


@query("district_forecast", oracle(STATUS_SQL))
def district_forecast(spark, sf_dir):
    return _forecast(spark, sf_dir).status.select("district", "records", "status", "reason")


@query("status_counts", oracle(f"SELECT status, count(*) AS n FROM ({STATUS_SQL}) GROUP BY status"))
def status_counts(spark, sf_dir):
    return metrics.status_counts(_forecast(spark, sf_dir).status)


@query("horizon_error", oracle("""SELECT district, 'error' AS status, 'the months ahead end before the test range' AS reason
                                  FROM {gate}"""))
def horizon_error(spark, sf_dir):
    settings = ForecastSettings(forecast_start_offset_days=-400, future_months=0)
    return _forecast(spark, sf_dir, settings).status.filter("status = 'error'").select("district", "status", "reason")


@query(
    "fallback_horizon",
    oracle("""SELECT district, CAST(unnest(generate_series(min(ds), max(ds) + 30, INTERVAL 1 DAY)) AS DATE) AS ds
              FROM {daily} GROUP BY district"""),
)
def fallback_horizon(spark, sf_dir):
    whole = ForecastSettings(train_ratio=1.0, test_ratio=0.0, min_training_records=1)
    return _forecast(spark, sf_dir, whole).forecast.select("district", "ds")


@query(
    "weekly_profile",
    oracle(f"SELECT district, CAST(wd AS INT) AS weekday, {rounds('effect')} FROM (SELECT district, wd, we AS effect "
           f"FROM {{fit_weekly}} WHERE phase = 'initial')"),
)
def weekly_profile(spark, sf_dir):
    return rounded(additive.weekly_profile(_forecast(spark, sf_dir).forecast, SERIES))


@query(
    "yearly_profile",
    oracle(f"""SELECT district, CAST(doy AS INT) AS day_of_year, {rounds('effect')} FROM (
               SELECT district, dayofyear(ds) AS doy, avg(yearly) AS effect FROM {{scored}} GROUP BY ALL)"""),
)
def yearly_profile(spark, sf_dir):
    return rounded(additive.yearly_profile(_forecast(spark, sf_dir).forecast, SERIES))


@query(
    "holiday_effects",
    oracle(f"""SELECT district, ds, holiday, {rounds('holidays')} FROM (
               SELECT district, ds, holidays, {HOLIDAY_CASE} AS holiday FROM {{scored}}) WHERE holiday IS NOT NULL"""),
)
def holiday_effects(spark, sf_dir):
    scored = _forecast(spark, sf_dir).forecast
    return rounded(additive.holiday_effects(scored).select("district", "ds", "holiday", "holidays"))


@query(
    "us_holidays",
    oracle(f"""SELECT ds, holiday, orders FROM (SELECT ds, {HOLIDAY_CASE} AS holiday, orders FROM (
               SELECT CAST(o_orderdate AS DATE) AS ds, count(*) AS orders FROM orders GROUP BY 1))
               WHERE holiday IS NOT NULL"""),
)
def us_holidays(spark, sf_dir):
    per_day = view(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ds")).agg(F.count("*").alias("orders"))
    years = per_day.agg(F.year(F.min("ds")).alias("first"), F.year(F.max("ds")).alias("last")).first()
    return per_day.join(holiday_table(spark, years["first"], years["last"]), "ds").select("ds", "holiday", "orders")


@query("holiday_join", oracle(f"SELECT district, ds, y, {HOLIDAY_CASE} AS holiday FROM {{daily}}"))
def holiday_join(spark, sf_dir):
    return additive.holiday_join(incident_daily(spark, sf_dir)).select("district", "ds", "y", "holiday")


# The coefficients of the bending trend are no closed form in SQL. What SQL can state is that they meet the conditions of the optimum,
# that the components add up, and everything beside them.


@query(
    "fit_additive_ridge",
    oracle(f"""SELECT m.district, m.phase, m.t0, m.last_day, 0.0 AS gap, 0.0 AS sum_gap, test_samples,
                      {rounds('baseline_naive_mae', 'baseline_ma7_mae', 'baseline_ma30_mae')}
               FROM {{fit_model}} m LEFT JOIN {{metrics}} e ON m.district = e.district"""),
)
def fit_additive_ridge(spark, sf_dir):
    result = _forecast(spark, sf_dir, model=plan.RIDGE)
    gap = ridge.ridge_gap(_phase_rows(spark, sf_dir), result.models, PHASED)
    parts = F.col("yhat") - F.col("trend") - F.col("weekly") - F.col("yearly") - F.col("holidays")
    sums = result.forecast.groupBy("district").agg(F.max(F.abs(parts)).alias("sum_gap"))
    found = result.models.select(*PHASED, "t0", "last_day").join(gap, PHASED).join(sums, "district", "left")
    beside = result.metrics.select("district", "test_samples", "baseline_naive_mae", "baseline_ma7_mae", "baseline_ma30_mae")
    return rounded(found.join(beside, "district", "left"))


# The width of the drawn intervals is no closed form. SQL states for which series and days there are intervals, that they hold the
# forecast, that none is narrower on the last day than on the first one, and that all of a series widen if it has trend changes.
@query(
    "interval_growth",
    oracle("SELECT district, count(*) AS days, true AS holds, true AS grows, true AS tells_changes FROM {future} GROUP BY district"),
)
def interval_growth(spark, sf_dir):
    result = _forecast(spark, sf_dir, model=plan.RIDGE, wanted=("final",))
    changes = F.exists(F.slice("beta", ridge.HINGE.start + 1, ridge.CHANGEPOINTS), lambda b: b != 0)
    bent = result.models.filter("phase = 'final'").select("district", changes.alias("bent"))
    width = F.col("yhat_upper") - F.col("yhat_lower")
    ends = result.future.groupBy("district").agg(
        F.count("*").alias("days"), F.bool_and(F.col("yhat").between(F.col("yhat_lower"), F.col("yhat_upper"))).alias("holds"),
        F.min_by(width, "ds").alias("first"), F.max_by(width, "ds").alias("last"),
    )
    grows = F.col("last") >= F.col("first") * (1 - 1e-9)
    wider = F.col("last") > F.col("first") * (1 + 1e-9)
    return ends.join(bent, "district").select("district", "days", "holds", grows.alias("grows"), (wider == F.col("bent")).alias("tells_changes"))


# A fixed range that begins after the first rows: the final fit takes those too.
FIXED = ForecastSettings(use_fixed_dates=True, train_start=date(1996, 1, 1), train_end=date(1997, 6, 30), test_end=date(1998, 1, 31))


@query(
    "fixed_split_models",
    oracle("""SELECT district, 'initial' AS phase, min(ds) AS t0, max(ds) AS last_day, count(*) AS n FROM {daily}
              WHERE ds BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND district IN (SELECT district FROM {fixed_gate}) GROUP BY ALL
              UNION ALL SELECT district, 'final', min(ds), max(ds), count(*) FROM {daily}
              WHERE ds <= DATE '1998-01-31' AND district IN (SELECT district FROM {fixed_gate}) GROUP BY ALL"""),
)
def fixed_split_models(spark, sf_dir):
    return _forecast(spark, sf_dir, FIXED).models.select("district", "phase", "t0", "last_day", "n")


@query("forecast_all_districts", oracle(f"""SELECT m.*, s.records, s.status, f.days FROM ({METRICS_SQL}) m
    JOIN ({STATUS_SQL}) s ON m.district = s.district
    JOIN (SELECT district, count(*) AS days FROM {{future}} GROUP BY district) f ON m.district = f.district"""))
def forecast_all_districts(spark, sf_dir):
    result = _forecast(spark, sf_dir)
    days = result.future.groupBy("district").agg(F.count("*").alias("days"))
    metrics_ = rounded(result.metrics.select("district", "test_samples", "quality", *METRICS))
    return metrics_.join(result.status.select("district", "records", "status"), "district").join(days, "district")
