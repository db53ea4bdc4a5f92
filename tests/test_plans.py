"""The shape of physical plans: shuffles, pushdown and joins."""

import datetime as dt

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from tallyground.operators import merge, series
from tallyground.operators.additive import fit_additive_sql
from tallyground.plans.forecast import phase_rows
from tallyground.settings import cut_lineage

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(f"s{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), i) for i in range(300)]
    return cut_lineage(spark.createDataFrame(rows, "series string, ds date, y int"))


def test_fit_shuffles_once(spark, daily):
    days = ("2024-01-01", "2024-03-01", "2024-03-20", "2024-04-10", "2024-06-09")
    names = ("train_start", "train_end", "test_end", "future_start", "future_end")
    bounds = {name: F.to_date(F.lit(day)) for name, day in zip(names, days)}
    text = plan(fit_additive_sql(phase_rows(daily, ["series"], bounds), ["series", "phase"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "LessThanOrEqual(ds,2024-03-20)" in text


def test_counts_are_reduced_before_the_shuffle(spark):
    text = plan(series.daily_counts(spark.read.parquet(f"{SF_DIR}/events.parquet"), "ts", ["event_type"]))
    assert text.count("partial_count") == 1 and text.count("Exchange") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text


def test_dedup_needs_no_window(spark):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    text = plan(merge.dedup_keep_last(events, ["user_id", "event_type"], ["event_id"]))
    assert "Window" not in text and "partial_max_by" in text and text.count("Exchange") == 1


def test_dense_days_need_no_join(spark, daily):
    text = plan(series.calendar_join(daily, ["series"]))
    assert "Join" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", [
    "offense_lookup_join", "merge_incremental", "split_label", "series_metrics", "neighbor_join", "dbscan_clusters",
    "top_cluster_points", "holiday_join", "pages_until_short"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
