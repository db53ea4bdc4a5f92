"""The stored incident table and the saved results.

Beside the rows the store keeps two small tables, written by the same runs and live for the same months: the rows per district and day
(``read_profile``), from which the metadata, the freshness and the checks are read, and the keys by a hash of the key
(``stored_keys``). A delivery therefore reads and writes no month but its own, and looks only into the folders of its own keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyground import schemas
from tallyground.operators.quality import dataset_metadata, day_table
from tallyground.settings import remove_path
from tallyground.sources import versions
from tallyground.sources.landing import require_table
from tallyground.sources.versions import MONTH_PART, RUN, Version

# Folders of the key table; a store keeps the number it was made with.
KEY_FOLDERS = 16
KEY_FOLDER = "key_folder"
# Versions that readers may still be working on.
KEEP_VERSIONS = 3
PROFILE = "district string, ds date, y bigint, oldest timestamp_ntz, newest timestamp_ntz"


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def key_folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(folders)).cast("int")


def write_incidents(
    df: DataFrame, path: str, ts: str, district: str | None = None, key: str | None = None,
    consumed: DataFrame | None = None, key_folders: int = KEY_FOLDERS,
) -> None:
    """Store incidents by month of occurrence, replacing the months that occur in ``df``.

    All files are staged in a run of their own; publishing the version that names it puts them in place in one step, with the
    profile, the keys and the entries of ``consumed`` in the ledger. ``df`` may be derived from the table itself.
    ``district`` and ``key`` stay what they were if not given; the first write that names others rewrites all months, since both
    side tables are made for them. REBALANCE lets AQE cut a hot month into files of even size.
    """
    if {name.lower() for name in df.columns} & {MONTH_PART, RUN}:
        raise ValueError(f"{MONTH_PART!r} and {RUN!r} are the names of the partition columns")
    spark, run = df.sparkSession, uuid.uuid4().hex
    before = versions.current(spark, path) or Version(ts=ts, key_folders=key_folders)
    if before.ts != ts:
        raise ValueError(f"'{path}' is stored by {before.ts!r}")
    district, key = district or before.district, key or before.key
    _stage(df, path, ts, run)
    months = versions.staged_months(spark, path, run)
    if (before.district, before.key) != (district, key) and set(before.months) - set(months):
        _stage(read_incidents(spark, path, sorted(set(before.months) - set(months))).drop(MONTH_PART), path, ts, run)
        months = versions.staged_months(spark, path, run)
    known = json.loads(before.schema)["fields"] if before.schema else []
    fields = json.loads(df.schema.json())["fields"] + [f for f in known if f["name"] not in df.columns]
    schema = json.dumps({"type": "struct", "fields": fields})
    after = versions.replaced(before, months, run, schema=schema, district=district, key=key)
    rows = versions.read_table(spark, path, "data", T.StructType.fromJson(json.loads(schema)), after, months)
    days = day_table(rows, ts, district).withColumn(MONTH_PART, month_of("ds"))
    _append(days.hint("rebalance"), f"{path}/profile", run)
    if key:
        keys = rows.filter(F.col(key).isNotNull()).select(
            F.col(key).cast("string").alias("stored_key"), key_folder(F.col(key), after.key_folders).alias(KEY_FOLDER), MONTH_PART
        )
        _append(keys.hint("rebalance", F.col(KEY_FOLDER)), f"{path}/keys", run, KEY_FOLDER)
    _enter(spark, path, consumed, after.number)
    versions.publish(spark, path, after)


def _stage(df: DataFrame, path: str, ts: str, run: str) -> None:
    rows = df.withColumn(MONTH_PART, month_of(ts)).hint("rebalance", F.col(MONTH_PART))
    _append(rows.sortWithinPartitions(MONTH_PART, ts), f"{path}/data", run, MONTH_PART)


def _append(rows: DataFrame, path: str, run: str, *parts: str) -> None:
    rows.withColumn(RUN, F.lit(run)).write.mode("append").partitionBy(*parts, RUN).parquet(path)


def existing_version(spark: SparkSession, path: str) -> Version:
    version = versions.current(spark, path)
    if version is None:
        raise FileNotFoundError(f"No data at '{path}'. Run the update plan first.")
    return version


def read_incidents(spark: SparkSession, path: str, months: list[str] | None = None) -> DataFrame:
    """The stored table, with its partition column ``MONTH_PART`` for pruning; only ``months`` if given."""
    version = existing_version(spark, path)
    return versions.read_table(spark, path, "data", T.StructType.fromJson(json.loads(version.schema)), version, months)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows per district and day, as ``quality.day_table`` counts them, without a look at the rows."""
    version = existing_version(spark, path)
    return versions.read_table(spark, path, "profile", T.StructType.fromDDL(PROFILE), version).drop(MONTH_PART)


def latest_stored(spark: SparkSession, path: str) -> DataFrame:
    """One row: the latest stored time, where the next pull starts."""
    return read_profile(spark, path).agg(F.max("newest").alias("latest"))


def stored_keys(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The stored keys in the folders that the keys of ``wanted`` fall into, as a column ``key``.

    A store without a key table for this column is read itself, one column of all months.
    """
    version = existing_version(spark, path)
    if version.key != key:
        return read_incidents(spark, path).select(key)
    # At most as many numbers as there are folders.
    folders = [r[0] for r in wanted.filter(F.col(key).isNotNull()).select(key_folder(F.col(key), version.key_folders)).distinct().collect()]
    schema = T.StructType().add("stored_key", "string").add(KEY_FOLDER, T.IntegerType())
    keys = versions.read_table(spark, path, "keys", schema, version).filter(F.col(KEY_FOLDER).isin(folders))
    return keys.select(F.col("stored_key").alias(key))


def clean(spark: SparkSession, path: str, keep: int = KEEP_VERSIONS) -> None:
    """Delete what no version among the newest ``keep`` names, and ledger entries that a later one repeats."""
    oldest = versions.clean(spark, path, keep)
    for number in versions.ledger_numbers(spark, path):
        if number < oldest // LEDGER_WHOLE * LEDGER_WHOLE:
            remove_path(spark, f"{path}/ledger/version={number}")


# Every so many versions the ledger is written whole, so that the number of its files stays bounded.
LEDGER_WHOLE = 32


def _ledger(spark: SparkSession, path: str, upto: int) -> DataFrame | None:
    """Entries of the versions ``upto`` a number; what a version that was never published has left does not count."""
    numbers = [n for n in versions.ledger_numbers(spark, path) if n <= upto]
    if not numbers:
        return None
    return spark.read.parquet(*[f"{path}/ledger/version={n}" for n in numbers]).select("path", "length", "modified")


def _enter(spark: SparkSession, path: str, consumed: DataFrame | None, number: int) -> None:
    """Write the ledger entries of the version ``number``, which is not published yet."""
    before = _ledger(spark, path, number - 1) if number % LEDGER_WHOLE == 0 else None
    entries = consumed if before is None else before if consumed is None else before.unionByName(consumed)
    if entries is None:
        remove_path(spark, f"{path}/ledger/version={number}")
    else:
        entries.distinct().write.mode("overwrite").parquet(f"{path}/ledger/version={number}")



def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a landing folder by name, size and time; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def unread_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The landed files that no published version has consumed. A file that has changed counts as new."""
    files, version = landed_files(spark, folder), versions.current(spark, path)
    ledger = _ledger(spark, path, version.number) if version else None
    return files if ledger is None else files.join(ledger, ["path", "length", "modified"], "left_anti")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Write the one-row nested summary as JSON."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METADATA).json(path)


def dataset_info(spark: SparkSession, metadata_path: str, incidents: DataFrame, ts: str, district: str) -> DataFrame:
    """Saved metadata if there is any, else the same figures from the data."""
    try:
        require_table(spark, metadata_path, "text")
    except FileNotFoundError:
        return dataset_metadata(incidents, ts, district, last_updated=F.lit("Unknown"))
    return load_metadata(spark, metadata_path)


# Folders of a saved result, by a hash of the series, so that their number does not grow with the series.
SERIES_FOLDERS = 64
FOLDER = "series_folder"


def _folder(series: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(series, F.lit(""))), F.lit(SERIES_FOLDERS)).cast("int")


def write_series_outputs(df: DataFrame, path: str, series: str) -> None:
    """Results of all series in one table. The series stays a data column, as text, so that no name changes."""
    named = df.withColumn(series, F.col(series).cast("string"))
    (
        named.withColumn(FOLDER, _folder(F.col(series)))
        .hint("rebalance", F.col(FOLDER))
        .sortWithinPartitions(FOLDER, series)
        .write.mode("overwrite")
        .partitionBy(FOLDER)
        .parquet(path)
    )


def load_series_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Saved results of all series."""
    return require_table(spark, path).drop(FOLDER)


def load_series_output(spark: SparkSession, path: str, series: str, value: str | None) -> DataFrame:
    """Rows of one series; only its folder is read, and there only the row groups that may hold it."""
    wanted = F.lit(value).cast("string")
    here = (F.col(FOLDER) == _folder(wanted)) & F.col(series).eqNullSafe(wanted)
    return require_table(spark, path).filter(here).drop(FOLDER)


def list_series(df: DataFrame, series: str) -> DataFrame:
    return df.select(series).distinct().orderBy(series)


def write_summary(df: DataFrame, path: str) -> None:
    """Metrics of every series as CSV with a header, one row each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model_params(params: DataFrame, path: str, series: str) -> None:
    """Coefficient table of the fitted models, so that scoring later is a read."""
    write_series_outputs(params, path, series)
