"""The stored table: one step per change, months and folders that are not read, profile and ledger."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from test_plans import plan
from test_tables import KEYS, NEWER, STORED, incidents, seqs

from tallyground.operators import merge, quality
from tallyground.plans import daily
from tallyground.plans import update as plans
from tallyground.settings import scratch_path
from tallyground.sources import store, versions

RULES = {"key": "id", "ts": "ts", "district": "district", "dedup_keys": tuple(KEYS), "row_order": ("seq",)}


def stored_by_month(spark):
    """Three months of rows, some without a district, one without a time."""
    rows = [(str(k), f"2024-{1 + k % 3:02d}-{1 + k % 27:02d} 0{k % 9}:30", "ABC"[k // 3 % 3] if k % 7 else None, k % 5, k) for k in range(400)]
    return incidents(spark, rows + [("x", None, "A", 1, 900)])


@pytest.fixture
def filled(spark):
    path, meta = scratch_path(spark, "store"), scratch_path(spark, "meta")
    plans.update(spark, path, meta, stored_by_month(spark), **RULES)
    return path, meta


def results(loaded):
    metadata = loaded.metadata.drop("last_updated")
    return [sorted(map(str, x.collect())) for x in (loaded.daily, loaded.freshness, loaded.issues, metadata)]


def test_profile_equals_the_full_scan(spark, filled):
    path, meta = filled
    as_of = F.lit(dt.datetime(2025, 1, 1))
    for batch in (NEWER, [("n", "2024-05-05 01:00", None, 1, 950)], [("m", None, None, None, 951)]):
        plans.update(spark, path, meta, incidents(spark, batch), **RULES)
        whole = daily.load(store.read_incidents(spark, path), "ts", "district", as_of)
        assert results(daily.load_stored(spark, path, "district", as_of)) == results(whole)
        want = quality.dataset_metadata(store.read_incidents(spark, path), "ts", "district", F.lit("x")).drop("last_updated")
        assert store.load_metadata(spark, meta).drop("last_updated").select(want.columns[0]).collect() == want.select(want.columns[0]).collect()
        assert store.latest_stored(spark, path).first() == store.read_incidents(spark, path).agg(F.max("ts")).first()


def paths_read(df):
    return {r[0].split("/")[-2] + "/" + r[0].split("/")[-3] for r in df.select(F.input_file_name()).distinct().collect()}


def test_an_update_reads_the_touched_months_and_folders_only(spark, filled):
    path, _ = filled
    batch = incidents(spark, [("7", "2024-02-09", "B", 2, 9), ("new", "2024-02-10", "B", 2, 10)])
    rows = plans.merged_table(spark, path, batch, "id", KEYS, ["seq"], "ts")
    scans = [line for line in plan(rows).splitlines() if "FileScan parquet" in line]
    pruned = [line.split("PartitionFilters: [")[1].split("], PushedFilters")[0] for line in scans]
    assert len(scans) == 2 and all(versions.RUN in p for p in pruned) and sum(", key_" in p for p in pruned) == 1
    months = {f.split(f"{versions.MONTH_PART}=")[1].split("/")[0] for f in rows.inputFiles() if "/data/" in f}
    folders = {f.split(f"{store.KEY_FOLDER}=")[1].split("/")[0] for f in rows.inputFiles() if "/keys/" in f}
    assert len(months) == 4 and len(folders) == store.KEY_FOLDERS  # what lies there
    nearby = store.read_incidents(spark, path, ["2024-02"])
    assert {r[0] for r in nearby.select(store.MONTH_PART).distinct().collect()} == {"2024-02"}
    assert all("2024-02" in f for f in paths_read(nearby))
    keys = store.stored_keys(spark, path, batch, "id")
    opened = {r[0].split(f"{store.KEY_FOLDER}=")[1].split("/")[0] for r in keys.select(F.input_file_name()).distinct().collect()}
    own = {str(r[0]) for r in batch.select(store.key_folder(F.col("id"), store.KEY_FOLDERS)).collect()}
    assert opened <= own and len(own) <= 2
    assert "7" in {r[0] for r in keys.collect()}


def test_key_folders_give_the_same_rows(spark, filled):
    path, meta = filled
    before = store.read_incidents(spark, path).drop(store.MONTH_PART)
    batch = incidents(spark, NEWER + [(str(k), "2024-03-03", "Z", k, 1000 + k) for k in range(395, 405)])
    want = merge.merge_incremental(before, batch, "id", KEYS, ["seq"])
    want = sorted(map(str, want.collect()))
    plans.update(spark, path, meta, batch, **RULES)
    assert sorted(map(str, store.read_incidents(spark, path).drop(store.MONTH_PART).collect())) == want


def test_the_key_table_follows_replaced_rows(spark):
    """A row that a newer one replaced is no longer known by its key, with the key table as without."""
    path, meta = scratch_path(spark, "store"), scratch_path(spark, "meta")
    one, two = [("1", "2024-02-01", "B", 2, 1)], [("2", "2024-02-01", "B", 2, 2)]
    for batch, want in ((one, ["1"]), (two, ["2"]), (one, ["1"])):
        plans.update(spark, path, meta, incidents(spark, batch), **RULES)
        assert [r.id for r in store.read_incidents(spark, path).collect()] == want
        stored = store.stored_keys(spark, path, incidents(spark, one + two), "id")
        assert [r[0] for r in stored.collect()] == want


@pytest.mark.parametrize("point", ["publish", "_enter"])
def test_a_job_that_ends_half_way_leaves_the_old_state(spark, filled, monkeypatch, point):
    path, meta = filled
    before = sorted(map(str, store.read_incidents(spark, path).collect()))
    profile = sorted(map(str, store.read_profile(spark, path).collect()))
    batch = incidents(spark, [("a", "2024-01-09", "B", 2, 2000), ("b", "2024-03-09", "B", 2, 2001)])
    with monkeypatch.context() as patch:
        def lost(*_):
            raise RuntimeError("the driver is lost")
        patch.setattr(*(versions, point) if point == "publish" else (store, point), lost)
        with pytest.raises(RuntimeError):
            plans.update(spark, path, meta, batch, **RULES)
    assert len(os.listdir(f"{path}/data/{store.MONTH_PART}=2024-01")) == 2  # the files are there, and nobody sees them
    assert sorted(map(str, store.read_incidents(spark, path).collect())) == before
    assert sorted(map(str, store.read_profile(spark, path).collect())) == profile
    assert "a" not in {r[0] for r in store.stored_keys(spark, path, batch, "id").collect()}
    plans.update(spark, path, meta, batch, **RULES)
    assert {2000, 2001} <= set(seqs(store.read_incidents(spark, path)))
    assert store.read_incidents(spark, path).count() == len(before) + 2


def test_a_version_is_published_once(spark, filled):
    path, _ = filled
    version = versions.current(spark, path)
    with pytest.raises(RuntimeError):
        versions.publish(spark, path, version)
    assert versions.current(spark, path) == version


def test_dead_runs_are_cleaned(spark, filled):
    path, meta = filled
    for k in range(4):
        plans.update(spark, path, meta, incidents(spark, [(f"c{k}", "2024-02-09", "B", 2, 3000 + k)]), **RULES)
    assert len(os.listdir(f"{path}/data/{store.MONTH_PART}=2024-02")) == store.KEEP_VERSIONS
    assert len([f for f in os.listdir(f"{path}/_versions") if f.endswith(".json")]) == store.KEEP_VERSIONS
    assert store.read_incidents(spark, path).filter(F.col("seq") >= 3000).count() == 1  # equal dedup keys
    store.clean(spark, path, 1)
    assert len(os.listdir(f"{path}/data/{store.MONTH_PART}=2024-02")) == 1
    assert store.read_incidents(spark, path).count() == store.read_profile(spark, path).agg(F.sum("y")).first()[0]


def test_side_tables_are_made_anew_for_other_columns(spark):
    path = scratch_path(spark, "store")
    store.write_incidents(incidents(spark, STORED), path, "ts")
    assert {r.district for r in store.read_profile(spark, path).collect()} == {"UNKNOWN"}
    assert {r.id for r in store.stored_keys(spark, path, incidents(spark, STORED), "id").collect()} == {"1", "2", "3"}
    store.write_incidents(incidents(spark, [("9", "2024-05-01", "C", 1, 9)]), path, "ts", "district", "id")
    assert sorted((r.district, r.y) for r in store.read_profile(spark, path).collect()) == [("A", 1), ("A", 1), ("B", 1), ("C", 1)]
    assert versions.current(spark, path).key == "id"
    every = incidents(spark, [*STORED, ("9", None, None, None, 1)])
    assert {r.id for r in store.stored_keys(spark, path, every, "id").collect()} == {"1", "2", "3", "9"}


def test_columns_may_be_added(spark):
    path = scratch_path(spark, "store")
    store.write_incidents(incidents(spark, STORED), path, "ts")
    more = incidents(spark, [("9", "2024-05-01", "C", 1, 9)]).withColumn("note", F.lit("n"))
    store.write_incidents(more, path, "ts")
    store.write_incidents(incidents(spark, [("8", "2024-06-01", "C", 1, 8)]), path, "ts")
    assert {(r.id, r.note) for r in store.read_incidents(spark, path).collect()} == {("1", None), ("2", None), ("3", None), ("9", "n"), ("8", None)}


def land(folder, name, rows, offset=0):
    """One page file with the given records."""
    os.makedirs(folder, exist_ok=True)
    records = [{"INCIDENT_NUMBER": i, "OCCURRED_ON_DATE": t, "DISTRICT": d, "OFFENSE_CODE": c} for i, t, d, c in rows]
    with open(f"{folder}/{name}.json", "w") as file:
        file.write(json.dumps({"offset": offset, "success": True, "result": {"records": records}}) + "\n")


def test_landed_files_are_read_once(spark, monkeypatch):
    path, meta, folder = (scratch_path(spark, n) for n in ("store", "meta", "landing"))
    opened = []
    read = plans.landing.read_pages
    monkeypatch.setattr(plans.landing, "read_pages", lambda spark, p, *a: opened.append(sorted(x.split("/")[-1] for x in p)) or read(spark, p, *a))
    numbers = lambda: sorted(r.INCIDENT_NUMBER for r in store.read_incidents(spark, path).collect())
    land(folder, "a", [("1", "2024-01-01 00:00:00", "A", "7"), ("2", "2024-01-02 00:00:00", "A", "7")])
    land(folder, "b", [("3", "2024-02-02 00:00:00", "A", "7")])
    assert plans.update_from(spark, path, meta, folder)
    assert not plans.update_from(spark, path, meta, folder)
    land(folder, "c", [("4", "2024-02-03 00:00:00", "B", "7")])
    assert plans.update_from(spark, path, meta, folder)
    land(folder, "empty", [])
    assert not plans.update_from(spark, path, meta, folder)
    assert not plans.update_from(spark, path, meta, folder)
    land(folder, "a", [("1", "2024-01-01 00:00:00", "A", "7"), ("5", "2024-01-05 00:00:00", "A", "7")], offset=10)
    assert plans.update_from(spark, path, meta, folder)
    assert opened == [["a.json", "b.json"], ["c.json"], ["empty.json"], ["a.json"]]
    assert numbers() == ["1", "2", "3", "4", "5"]
    assert plans.update_from(spark, path, meta, folder, full=True)
    assert opened[-1] == ["a.json", "b.json", "c.json", "empty.json"] and numbers() == ["1", "2", "3", "4", "5"]
    assert store.load_metadata(spark, meta).first().total_records == 5


def test_a_failed_update_reads_its_files_again(spark, monkeypatch):
    path, meta, folder = (scratch_path(spark, n) for n in ("store", "meta", "landing"))
    land(folder, "a", [("1", "2024-01-01 00:00:00", "A", "7")])
    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            plans.update_from(spark, path, meta, folder)
    with pytest.raises(FileNotFoundError):
        store.read_incidents(spark, path)
    # A version without a ledger entry of its own does not inherit the one that the lost job left.
    store.write_incidents(plans.landed_incidents(spark, folder).limit(0), path, "OCCURRED_ON_DATE")
    assert [r.path.split("/")[-1] for r in store.unread_files(spark, path, folder).collect()] == ["a.json"]
    assert plans.update_from(spark, path, meta, folder)
    assert not plans.update_from(spark, path, meta, folder)


def test_the_ledger_stays_small(spark, monkeypatch):
    monkeypatch.setattr(store, "LEDGER_WHOLE", 4)
    path, meta, folder = (scratch_path(spark, n) for n in ("store", "meta", "landing"))
    for k in range(6):
        land(folder, f"f{k}", [(str(k), f"2024-01-{k + 1:02d} 00:00:00", "A", "7")])
        assert plans.update_from(spark, path, meta, folder)
    assert versions.ledger_numbers(spark, path) == [4, 5, 6]
    assert store.unread_files(spark, path, folder).count() == 0
    assert store.read_incidents(spark, path).count() == 6
