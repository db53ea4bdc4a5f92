"""Incremental update: landed pages → merge with the stored table → store and summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyground import schemas
from tallyground.functions.coerce import coerce_timestamp
from tallyground.operators.merge import anti_join_new, dedup_keep_last, later_wins
from tallyground.operators.quality import metadata_of
from tallyground.settings import cut_lineage
from tallyground.sources import landing, store
from tallyground.sources.versions import NO_MONTH


def landed_incidents(spark: SparkSession, path: str | list[str], ts: str = "OCCURRED_ON_DATE") -> DataFrame:
    """The records of landed page files with all their columns and ``row_seq``; the time is typed, the rest stays text."""
    rows = landing.scan_api_pages(landing.read_pages(spark, path, schemas.RAW_INCIDENT))
    return rows.withColumn(ts, coerce_timestamp(F.col(ts)))


def merged_table(
    spark: SparkSession, path: str, batch: DataFrame, key: str, dedup_keys: list[str], row_order: list[str], ts: str
) -> DataFrame:
    """The rows to write for ``batch``, which is read several times: hand it in stored.

    A batch can only change the months of its own rows, since the dedup keys hold the time. The key test opens the folders of
    the batch's own keys; the merge itself reads the touched months, and only those are in the result. The first load is
    deduplicated too, so that untouched months never have duplicates.
    """
    if ts not in dedup_keys:
        raise ValueError(f"dedup keys must hold the time column {ts!r}, or rows could leave their month")
    # Rows that lose within the batch lose before the key test, or they would win when the batch comes again.
    winners = dedup_keep_last(batch, dedup_keys, row_order)
    try:
        known = store.stored_keys(spark, path, batch, key)
    except FileNotFoundError:
        return winners
    # The list of months is as long as the calendar of the batch.
    months = [row.month or NO_MONTH for row in batch.select(store.month_of(ts).alias("month")).distinct().collect()]
    nearby = store.read_incidents(spark, path, months).drop(store.MONTH_PART)
    return later_wins(nearby, anti_join_new(winners, known, key), dedup_keys, row_order)


def update(
    spark: SparkSession,
    path: str,
    metadata_path: str,
    landed: DataFrame,
    key: str = "INCIDENT_NUMBER",
    ts: str = "OCCURRED_ON_DATE",
    district: str = "DISTRICT",
    dedup_keys: tuple[str, ...] = ("OCCURRED_ON_DATE", "DISTRICT", "OFFENSE_CODE"),
    row_order: tuple[str, ...] = ("row_seq",),
    consumed: DataFrame | None = None,
) -> bool:
    """Bring the stored table up to date; False when nothing new has landed.

    Whatever has landed is compared with the stored keys, however late it comes. Rows, profile, keys and the ledger entries of
    ``consumed`` change in one step; the metadata is read from the profile.
    """
    batch = cut_lineage(landed)
    empty = batch.isEmpty()
    if empty and consumed is None:
        return False
    rows = batch if empty else merged_table(spark, path, batch, key, list(dedup_keys), list(row_order), ts)
    store.write_incidents(rows, path, ts, district, key, consumed)
    store.write_metadata(metadata_of(store.read_profile(spark, path), F.lit(datetime.now().isoformat())), metadata_path)
    store.clean(spark, path)
    return not empty


def update_from(
    spark: SparkSession, path: str, metadata_path: str, folder: str, full: bool = False, ts: str = "OCCURRED_ON_DATE", **rules
) -> bool:
    """Update from the page files of a landing folder that no update has read before, or from all of them.

    The ledger of the store remembers what was read; when nothing has landed since, no page is opened. ``rules`` go to
    ``update``.
    """
    files = cut_lineage(store.landed_files(spark, folder) if full else store.unread_files(spark, path, folder))
    # Names of files only, which any scan of them holds on the driver too.
    names = [row.path for row in files.select("path").collect()]
    if not names:
        return False
    return update(spark, path, metadata_path, landed_incidents(spark, names, ts), ts=ts, consumed=files, **rules)
