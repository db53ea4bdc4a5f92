"""Cleaning, quality, lookup, merge, storage and streaming."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyground import schemas
from tallyground.functions.coerce import (
    coerce_integer, coerce_numeric, coerce_timestamp, elapsed_days, utc_instant, utc_naive,
)
from tallyground.functions.holidays import us_holidays
from tallyground.functions.text import normalize_name
from tallyground.operators import clean, lookup, merge, quality, sampling
from tallyground.plans.daily import load
from tallyground.plans.enrich import enrich
from tallyground.plans.update import merged_table, update
from tallyground.registry.cleaning import drop_null_offense
from tallyground.settings import scratch_path, shared_folder
from tallyground.sources import landing, store
from tallyground.streaming import feeds

INCIDENT = "id string, ts timestamp_ntz, district string, code int, seq bigint"


def incidents(spark, rows):
    return spark.createDataFrame(
        [(i, dt.datetime.fromisoformat(t) if t else None, d, c, s) for i, t, d, c, s in rows], INCIDENT)


@pytest.mark.parametrize("text, number, integer", [
    ("3", 3.0, 3), ("3.0", 3.0, 3), ("3.7", 3.7, None), (" -5 ", -5.0, -5), ("1e3", 1000.0, 1000),
    ("1d", None, None), ("nan", None, None), ("", None, None), ("bad", None, None), (None, None, None)])
def test_numbers(spark, text, number, integer):
    row = spark.createDataFrame([(text,)], "s string").select(
        coerce_numeric(F.col("s")).alias("n"), coerce_integer(F.col("s")).alias("i")).first()
    assert (row.n, row.i) == (number, integer)


@pytest.mark.parametrize("text, expected", [
    ("2023-01-01 00:00:00+00", dt.datetime(2023, 1, 1)), ("2024-01-01T10:00:00Z", dt.datetime(2024, 1, 1, 10)),
    ("2024-01-01 23:00:00-05:00", dt.datetime(2024, 1, 2, 4)),
    ("2024-11-03T05:30:00.25Z", dt.datetime(2024, 11, 3, 5, 30, 0, 250000)),
    ("2024-11-03T06:30:00Z", dt.datetime(2024, 11, 3, 6, 30)), ("2024-03-10 02:30:00", dt.datetime(2024, 3, 10, 2, 30)),
    ("1969-12-31T23:59:59.5Z", dt.datetime(1969, 12, 31, 23, 59, 59, 500000)), ("+20000-01-01T00:00:00Z", None), ("2024-01-01", dt.datetime(2024, 1, 1)),
    ("2024-13-01", None), ("0001-01-01", None), ("9999-12-31", None), ("not a date", None), (None, None)])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_do_not_depend_on_the_session_zone(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(text,)], "s string").select(coerce_timestamp(F.col("s")).alias("t"))
        assert frame.first().t == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_instants_reverse_naive_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT explode(array(timestamp_ntz'2024-11-03 05:30:00.123456', "
                         "timestamp_ntz'2024-11-03 06:30:00', timestamp_ntz'1960-02-29 23:59:59.999999')) AS t")
        assert rows.filter(utc_naive(utc_instant(F.col("t"))) == F.col("t")).count() == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_elapsed_days_round_down(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' a, timestamp_ntz'2024-01-03 11:59:59' b").select(
        elapsed_days(F.col("a"), F.col("b")).alias("d")).first()
    assert row.d == 1


def test_names(spark):
    row = spark.createDataFrame([('A/B\\C:D?*"<>|E',)], "s string").select(normalize_name(F.col("s")).alias("n")).first()
    assert row.n == "A_B_C_D_E"


def test_holidays(spark):
    days = {(r.ds.isoformat(), r.holiday) for r in us_holidays(spark, 2020, 2024, observed=True).collect()}
    assert {("2024-01-15", "Martin Luther King Jr. Day"), ("2024-11-28", "Thanksgiving Day"),
            ("2023-05-29", "Memorial Day"), ("2023-01-02", "New Year's Day (observed)")} <= days
    assert not any(name.startswith("Juneteenth") and day.startswith("2020") for day, name in days)


def test_drop_list_is_case_sensitive(spark):
    assert clean.drop_if_present(spark.createDataFrame([(1, 2)], "CODE int, _id int"), ["code", "_id"]).columns == ["CODE"]


def test_missing_district_column(spark):
    assert clean.fill_unknown_district(spark.range(1)).first().district == "UNKNOWN"


def test_coordinates(spark):
    rows = spark.createDataFrame(
        [(0.0, 0.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (91.0, 0.0), (90.0, -180.0)],
        "lat double, lon double")
    assert clean.valid_coordinates(rows, "lat", "lon").count() == 2
    assert clean.valid_coordinates(rows, "lat", "lon", box=(-1, 1, -1, 1)).count() == 1


def test_lookup_duplicates_and_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "code int")
    codes = spark.createDataFrame([(1, "b"), (1, "a"), (None, "x"), (2, None)], "CODE int, NAME string")
    assert lookup.offense_lookup_join(rows, codes, "code", "CODE", "NAME").count() == 2
    first = lookup.offense_lookup_join(rows, codes, "code", "CODE", "NAME", on_duplicate="first").collect()
    assert [r.offense_type for r in first] == ["a"]
    assert lookup.unmatched_codes(rows, codes, "code", "CODE", "NAME").first().unmatched == 2


def test_incidents_without_a_type_are_dropped(spark, tmp_path):
    # Priorities 4 (a null name) and 5 (no code) have no type, order 97 has no readable code.
    orders = [(1, 1, "1-URGENT"), (2, 1, "1-URGENT"), (3, 1, "2-HIGH"), (4, 1, "4-NOT"), (5, 1, "5-LOW"), (97, 1, "1-URGENT")]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit(dt.datetime(1996, 1, 1))).write.parquet(f"{tmp_path}/orders.parquet")
    customers = spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    rows = drop_null_offense(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("1", 1, "URGENT"), ("2", 1, "URGENT"), ("3", 2, "HIGH")]


def test_enrich(spark):
    values = {"INCIDENT_NUMBER": "I1", "OFFENSE_CODE": "00301", "DISTRICT": None, "Lat": "42.3", "Long": "-71.0",
              "OCCURRED_ON_DATE": "2024-02-01 10:00:00+00", "HOUR": "10"}
    raw = spark.createDataFrame(
        [tuple(values.get(c) for c in schemas.INCIDENT_COLUMNS),
         tuple({**values, "Lat": "x"}.get(c) for c in schemas.INCIDENT_COLUMNS)], schemas.RAW_INCIDENT)
    codes = spark.createDataFrame([("301", "ROBBERY")], schemas.CODE_LOOKUP)
    row, = enrich(raw, codes).collect()
    assert (row.OFFENSE_TYPE, row.DISTRICT, row.DAY_OF_YEAR, row.HOUR) == ("ROBBERY", "UNKNOWN", 32, 10)
    assert "SHOOTING" not in row.asDict()


def test_quality_of_empty_and_bad_tables(spark):
    empty = incidents(spark, [])
    assert [r.check for r in quality.validate_data(empty, "ts", "district").collect()] == ["empty"]
    bad = incidents(spark, [("1", None, None, 1, 1)] * 3 + [("2", "2010-01-01", "A", 1, 1), ("3", "2024-01-01", "A", 1, 1)])
    issues = {r.check: r.message for r in quality.validate_data(bad, "ts", "district").collect()}
    assert set(issues) == {"dates", "districts", "coverage", "span"}
    assert issues["dates"] == "3 of 5 times are unreadable, 60.0%"
    assert quality.validate_data(bad.drop("district"), "ts", None).filter("check = 'districts'").isEmpty()


@pytest.mark.parametrize("as_of, level", [
    ("2024-01-31", "fresh"), ("2024-02-01", "info"), ("2024-03-31", "info"), ("2024-04-01", "warning")])
def test_freshness(spark, as_of, level):
    rows = incidents(spark, [("1", "2024-01-01", "A", 1, 1), ("2", None, "A", 1, 2)])
    result = load(rows, "ts", "district", F.lit(as_of).cast("timestamp_ntz"))
    assert result.freshness.first().level == level
    assert [(r.district, r.y) for r in result.daily.collect()] == [("A", 1)]
    # One of two dates is unreadable.
    assert [r.check for r in result.issues.collect()] == ["dates"]
    assert result.metadata.first().total_records == 2


def test_load_without_a_district_column(spark):
    rows = incidents(spark, [("1", "2024-01-01", None, 1, 1)]).drop("district")
    result = load(rows, "ts", "district", F.lit("2024-01-02").cast("timestamp_ntz"))
    assert [(r.district, r.y) for r in result.daily.collect()] == [("UNKNOWN", 1)]
    assert result.issues.isEmpty()


def test_metadata_of_an_empty_table(spark):
    row = quality.dataset_metadata(incidents(spark, []), "ts", "district", F.lit("x")).first()
    assert row.total_records == 0 and row.districts == [] and row.date_range.total_days == 0


STORED = [("1", "2024-01-01 10:00", "A", 1, 1), ("2", "2024-01-02 10:00", "A", 1, 2), ("3", "2024-02-01", "B", 2, 3)]
NEWER = [("2", "2024-01-02 10:00", "A", 9, 4), ("4", "2024-02-01", "B", 2, 5), (None, "2024-02-03", None, None, 6),
         (None, "2024-02-03", None, None, 7), ("5", "2024-02-04", "C", 3, 8), ("5", "2024-02-04", "C", 4, 9)]
KEYS = ["ts", "district", "code"]


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_merge_rules(spark):
    stored, newer = incidents(spark, STORED), incidents(spark, NEWER)
    assert seqs(merge.anti_join_new(newer, stored, "id")) == [5, 6, 7, 8, 9]
    merged = merge.merge_incremental(stored, newer, "id", KEYS, ["seq"])
    # 4 replaces 3 on the same keys, the two keyless rows fold into the later one, 5 keeps both codes.
    assert seqs(merged) == [1, 2, 5, 7, 8, 9]
    again = merge.merge_incremental(merged, newer, "id", KEYS, ["seq"])
    assert sorted(again.collect(), key=str) == sorted(merged.collect(), key=str)
    assert seqs(merge.merge_incremental(None, newer, "id", KEYS, ["seq"])) == [4, 5, 7, 8, 9]


def test_update_store(spark):
    path, meta = scratch_path(spark, "store"), scratch_path(spark, "meta")
    args = {"key": "id", "ts": "ts", "district": "district", "dedup_keys": tuple(KEYS), "row_order": ("seq",)}
    assert update(spark, path, meta, incidents(spark, STORED), **args)
    assert update(spark, path, meta, incidents(spark, NEWER), **args)
    assert seqs(store.read_incidents(spark, path)) == [1, 2, 5, 7, 8, 9]
    assert not update(spark, path, meta, incidents(spark, []), **args)
    info = store.load_metadata(spark, meta).first()
    assert info.total_records == 6 and info.districts == ["A", "B", "C"]


def test_dedup_keys_must_hold_the_time(spark):
    path = scratch_path(spark, "store")
    store.write_incidents(incidents(spark, STORED), path, "ts")
    with pytest.raises(ValueError):
        merged_table(spark, path, incidents(spark, NEWER), "id", ["district"], ["seq"], "ts")


@pytest.mark.parametrize("rows", [STORED, NEWER, STORED + NEWER])
def test_replay_of_any_delivery_changes_nothing(spark, rows):
    path, meta = scratch_path(spark, "store"), scratch_path(spark, "meta")
    args = {"key": "id", "ts": "ts", "district": "district", "dedup_keys": tuple(KEYS), "row_order": ("seq",)}
    # Rows of one delivery with equal dedup keys and different keys: the loser's key is never stored.
    rows = [*rows, ("8", "2024-03-01", "Z", 1, 20), ("9", "2024-03-01", "Z", 1, 21)]
    update(spark, path, meta, incidents(spark, rows), **args)
    once = sorted(map(str, store.read_incidents(spark, path).collect()))
    update(spark, path, meta, incidents(spark, rows), **args)
    assert sorted(map(str, store.read_incidents(spark, path).collect())) == once
    assert 21 in seqs(store.read_incidents(spark, path)) and 20 not in seqs(store.read_incidents(spark, path))


def test_update_leaves_other_months_alone(spark):
    path, meta = scratch_path(spark, "store"), scratch_path(spark, "meta")
    args = {"key": "id", "ts": "ts", "district": "district", "dedup_keys": tuple(KEYS), "row_order": ("seq",)}
    update(spark, path, meta, incidents(spark, STORED), **args)
    files = {r[0] for r in store.read_incidents(spark, path).select(F.input_file_name()).distinct().collect()}
    update(spark, path, meta, incidents(spark, [("7", "2024-02-09", "B", 2, 9)]), **args)
    after = {r[0] for r in store.read_incidents(spark, path).select(F.input_file_name()).distinct().collect()}
    kept = {f for f in files if "2024-01" in f}
    assert kept and kept <= after and not {f for f in files if "2024-02" in f} & after


def test_the_store_keeps_every_column(spark):
    path = scratch_path(spark, "store")
    row = {c: c.lower() for c in schemas.INCIDENT_COLUMNS}
    frame = spark.createDataFrame([tuple(row.values())], schemas.RAW_INCIDENT).withColumn(
        "OCCURRED_ON_DATE", F.lit("2024-02-03 00:00:00").cast("timestamp_ntz"))
    store.write_incidents(frame, path, "OCCURRED_ON_DATE")
    got = store.read_incidents(spark, path).first()
    assert got.MONTH == "month" and got[store.MONTH_PART] == "2024-02"
    assert set(got.asDict()) == {*schemas.INCIDENT_COLUMNS, store.MONTH_PART}
    with pytest.raises(ValueError):
        store.write_incidents(frame.withColumn("Occurred_Month_Part", F.lit(1)), path, "OCCURRED_ON_DATE")


def test_saved_results_keep_their_names(spark):
    path = scratch_path(spark, "saved")
    names = ["007", "7", "", "A/B", None, "x=y"]
    store.write_series_outputs(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, v int"), path, "name")
    assert {(r.name, r.v) for r in store.load_series_outputs(spark, path).select(F.col("name").alias("name"), "v").collect()} == {
        (n, i) for i, n in enumerate(names)}
    for i, name in enumerate(names):
        assert [r.v for r in store.load_series_output(spark, path, "name", name).collect()] == [i]


def test_missing_table_raises(spark):
    with pytest.raises(FileNotFoundError):
        landing.require_table(spark, scratch_path(spark, "absent"))


@pytest.mark.parametrize("limit", [1, 7, 60, 61, 150, 1000])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_incremental_pull_limit(spark, limit, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Three rows share each time, 40 seconds apart, over the change to summer time.
        rows = spark.range(600).selectExpr(
            "id", "timestamp_ntz'2024-03-10 01:30:00' + make_dt_interval(0, 0, 0, (id div 3) * 40) AS ts")
        start = dt.datetime(2024, 3, 10, 1, 35)
        got = [r.id for r in landing.incremental_pull(
            rows, "ts", F.lit(start.isoformat(" ")).cast("timestamp_ntz"), limit, "id").collect()]
        after = [i for i in range(600) if dt.datetime(2024, 3, 10, 1, 30) + dt.timedelta(seconds=i // 3 * 40) > start]
        assert got == after[:limit]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def page(offset, success, n, error=None):
    record = tuple([None] * len(schemas.RAW_INCIDENT))
    return (offset, success, error, ([record] * n,) if success else None)


@pytest.mark.parametrize("pages, complete, all_rows", [
    ([(0, True, 5), (5, True, 5), (10, True, 2), (12, True, 5)], 12, 17),
    ([(0, True, 5), (5, True, 0), (10, True, 5)], 5, 10),
    ([(0, True, 5), (5, False, 0), (10, True, 5)], 5, 10),
    ([(0, True, 5), (5, True, 5)], 10, 10)])
def test_paging(spark, pages, complete, all_rows):
    frame = spark.createDataFrame([page(*p) for p in pages], schemas.page_schema(schemas.RAW_INCIDENT))
    rows = landing.pages_until_short(frame, 5)
    assert (rows.filter("complete").count(), rows.count()) == (complete, all_rows)
    assert sorted(r.row_seq for r in landing.scan_api_pages(frame).collect()) == sorted(
        start + i for start, good, n in pages if good for i in range(n))


def test_page_errors(spark):
    frame = spark.createDataFrame(
        [page(0, True, 1), page(1, False, 0, '{"message": "no"}'), page(2, False, 0, "plain"), page(3, False, 0)],
        schemas.page_schema(schemas.RAW_INCIDENT))
    assert [r.error_message for r in landing.api_page_errors(frame).orderBy("offset").collect()] == [
        "no", "plain", "Unknown error"]


def test_sample_is_exact_and_repeatable(spark):
    # One group holds almost all rows.
    rows = spark.range(20000).withColumn("kind", F.when(F.col("id") < 30, "rare").when(F.col("id") < 31, "one").otherwise("hot"))
    sizes = {r.kind: r["count"] for r in sampling.sample_per_type(rows, "kind", "id", 500).groupBy("kind").count().collect()}
    assert sizes == {"rare": 30, "one": 1, "hot": 500}
    first = {r.id for r in sampling.sample_per_type(rows, "kind", "id", 500).collect()}
    assert first == {r.id for r in sampling.sample_per_type(rows.repartition(7), "kind", "id", 500).collect()}
    assert first != {r.id for r in sampling.sample_per_type(rows, "kind", "id", 500, seed=1).collect()}


def test_stream_merge_replay_changes_nothing(spark):
    path, landed = scratch_path(spark, "store"), scratch_path(spark, "landed")
    store.write_incidents(incidents(spark, STORED), path, "ts")
    incidents(spark, NEWER).coalesce(1).write.parquet(landed)
    schema = incidents(spark, []).schema
    for _ in range(2):
        stream = feeds.stream_files(spark, landed, schema)
        feeds.stream_merge(stream, path, scratch_path(spark, "progress"), "id", "ts", KEYS, ["seq"]).awaitTermination()
        assert seqs(store.read_incidents(spark, path)) == [1, 2, 5, 7, 8, 9]


def test_stream_counts_stay_current(spark):
    landed, out, progress = (scratch_path(spark, n) for n in ("landed", "out", "progress"))
    schema = incidents(spark, []).schema
    days = [("1", "2024-01-01", "A", 1, 1), ("2", "2024-01-02", "A", 1, 2), ("3", "2024-01-08", "A", 1, 3)]
    # Row 4 comes too late for its day; row 6 adds to a day that is still open.
    later = [("4", "2024-01-02 12:00", "A", 1, 4), ("6", "2024-01-08 12:00", "A", 1, 6), ("5", "2024-01-20", "A", 1, 5)]
    for delivery, want in ((days, [(1, 1), (2, 1), (8, 1)]), (later, [(1, 1), (2, 1), (8, 2), (20, 1)])):
        incidents(spark, delivery).coalesce(1).write.mode("append").parquet(landed)
        counts = feeds.stream_daily_counts(feeds.stream_files(spark, landed, schema), "ts", ["district"])
        feeds.keep_current(counts, out, progress).awaitTermination()
        assert sorted((r.ds.day, r.y) for r in feeds.read_current(spark, out, ["district"]).collect()) == want


def test_stream_dedup_drops_late_rows_and_old_state(spark):
    landed, out, progress = (scratch_path(spark, n) for n in ("landed", "out", "progress"))
    schema = incidents(spark, []).schema
    deliveries = [
        [("1", "2024-01-01", "A", 1, 1), ("1", "2024-01-01 06:00", "A", 1, 2), ("2", "2024-01-05", "A", 1, 3)],
        # 1 again behind the watermark is late; 2 again within it is known.
        [("1", "2024-01-01", "A", 1, 4), ("2", "2024-01-05", "A", 1, 5), ("3", "2024-01-20", "A", 1, 6)],
        # The state of 2 has gone by now, so a later 2 counts as new.
        [("2", "2024-01-21", "A", 1, 7), ("3", "2024-01-20", "A", 1, 8)],
    ]
    for delivery in deliveries:
        incidents(spark, delivery).coalesce(1).write.mode("append").parquet(landed)
        unique = feeds.stream_dedup(feeds.stream_files(spark, landed, schema), "ts", ["id"], "1 day")
        feeds.write_available(unique, out, progress).awaitTermination()
    got = seqs(spark.read.schema(schema).parquet(out))
    assert [s for s in got if s not in (1, 2)] == [3, 6, 7] and len(got) == 4


def files_below(path):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(path) for name in names)


def test_versions_are_folded(spark, monkeypatch):
    monkeypatch.setattr(feeds, "MOST_VERSIONS", 3)
    landed, out, progress, closed, closing = (scratch_path(spark, n) for n in ("landed", "out", "progress", "closed", "closing"))
    schema, most, final = incidents(spark, []).schema, 0, {}
    for k in range(7):
        rows = [(str(k), f"2024-01-{1 + k:02d}", "A", 1, k), (str(100 + k), f"2024-01-{1 + max(0, k - 1):02d} 06:00", "A", 1, k)]
        incidents(spark, rows).coalesce(1).write.mode("append").parquet(landed)
        counts = lambda: feeds.stream_daily_counts(feeds.stream_files(spark, landed, schema), "ts", ["district"])
        feeds.keep_current(counts(), out, progress).awaitTermination()
        feeds.write_available(counts(), closed, closing).awaitTermination()
        want = spark.read.schema(schema).parquet(landed).groupBy("district", F.to_date("ts").alias("ds")).agg(F.count("*").alias("y"))
        assert sorted(feeds.read_current(spark, out, ["district"]).collect()) == sorted(want.collect())
        most = max(most, len([n for n in os.listdir(out) if "=" in n]))
        days = {(r.district, r.ds): r.y for r in spark.read.schema(counts().schema).parquet(closed).collect()}
        assert final.items() <= days.items()
        final = days
    assert most <= 4 and any(n.startswith("base=") for n in os.listdir(out)) and len(final) == 5
    # A batch that the base holds is not written again.
    base, newer = feeds._state(spark, out)
    assert base is not None and all(n > base for n in newer) and files_below(out) <= 8 * 4


def test_stream_state_is_off_the_heap(spark):
    folder = scratch_path(spark, "landed")
    incidents(spark, STORED).coalesce(1).write.parquet(folder)
    stream = feeds.stream_files(spark, folder, incidents(spark, []).schema)
    feeds.write_available(feeds.stream_dedup(stream, "ts", ["id"]), scratch_path(spark, "out"), scratch_path(spark, "progress")).awaitTermination()
    assert "RocksDB" in spark.conf.get(feeds.STATE_STORE)


class _Session:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder():
    assert shared_folder(_Session("/shared/steps", "yarn")) == "/shared/steps"
    assert shared_folder(_Session(None, "local[8]")) == shared_folder(_Session(None, "local[8]"))
    with pytest.raises(RuntimeError):
        shared_folder(_Session(None, "yarn"))


def test_csv_fields_may_hold_line_breaks(spark):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    with open(f"{folder}/codes.csv", "w") as file:
        file.write('CODE,NAME\n1,"a\nb"\n2,"say ""c"""\n')
    assert sorted(tuple(r) for r in landing.scan_code_lookup(spark, folder).collect()) == [("1", "a\nb"), ("2", 'say "c"')]
    with open(f"{folder}/codes.csv", "w") as file:
        file.write(",".join(schemas.INCIDENT_COLUMNS) + "\n" + ",".join(['"x\ny"'] * len(schemas.INCIDENT_COLUMNS)) + "\n")
    assert [r.STREET for r in landing.scan_incidents_csv(spark, folder).collect()] == ["x\ny"]
