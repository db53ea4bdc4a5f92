"""Streams of landed incidents.

Late rows beyond the watermark are dropped by Spark, so a stream equals the batch result for rows that
arrive within it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyground.functions.coerce import utc_instant, utc_naive
from tallyground.plans.update import merged_table
from tallyground.settings import cut_lineage, remove_path
from tallyground.sources import store, versions

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """Landed Parquet files as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_merge(
    landed: DataFrame, store_path: str, checkpoint: str, key: str, ts: str, dedup_keys: list[str], row_order: list[str],
    district: str | None = None,
) -> StreamingQuery:
    """Merge every micro-batch into the stored table; only the months it touches are written.

    Replaying a batch changes nothing: rows that won are stored by then, rows that lost lose again, and rows without a key
    fall on their own dedup keys.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        if batch.isEmpty():
            return
        rows = merged_table(batch.sparkSession, store_path, batch, key, dedup_keys, row_order, ts)
        store.write_incidents(rows, store_path, ts, district, key)
        store.clean(batch.sparkSession, store_path)

    return (
        landed.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _with_event_time(landed: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Add ``event_time``, the instant of a zone-free UTC time, with a watermark; those need a TIMESTAMP."""
    return landed.withColumn("event_time", utc_instant(F.col(ts))).withWatermark("event_time", lateness)


def stream_daily_counts(landed: DataFrame, ts: str, by: list[str], lateness: str = "1 day") -> DataFrame:
    """Daily counts that follow every delivery.

    With update output (``keep_current``) open days are there too. With append output (``write_available``) a day comes once,
    when the watermark has closed it, and is final.
    """
    return (
        _with_event_time(landed, ts, lateness)
        .groupBy(F.window("event_time", "1 day").alias("day"), *by)
        .agg(F.count("*").alias("y"))
        .select(*by, F.to_date(utc_naive(F.col("day.start"))).alias("ds"), "y")
    )


# Versions that ``keep_current`` lets gather before it folds them into one.
MOST_VERSIONS = 8


def keep_current(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed counts of every micro-batch as one more version; ``read_current`` sees the last of each key.

    A replayed batch overwrites its own version. Beyond ``MOST_VERSIONS`` the versions are folded into a base, which gets
    its name when it is whole and stands for all batches up to its number; what it holds is then deleted. So the files
    do not grow with the number of deliveries. A replayed batch that the base holds already changes nothing.
    """
    root = path.rstrip("/")

    def put(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        base, newer = _state(spark, root)
        if base is not None and batch_id <= base:
            return
        changed.write.mode("overwrite").parquet(f"{root}/version={batch_id}")
        if len({*newer, batch_id}) > MOST_VERSIONS:
            _fold(spark, root, [c for c in changed.columns if c != "y"], batch_id)

    return (
        _on_disk(counts).writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def _state(spark: SparkSession, root: str) -> tuple[int | None, list[int]]:
    """The last batch that the base holds, and the versions behind it."""
    found = [n.split("=", 1) for n in versions.names(spark, root) if "=" in n]
    base = max((int(n) for kind, n in found if kind == "base"), default=None)
    return base, sorted(int(n) for kind, n in found if kind == "version" and (base is None or int(n) > base))


def _fold(spark: SparkSession, root: str, keys: list[str], upto: int) -> None:
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    read_current(spark, root, [k for k in keys if k != "ds"]).coalesce(1).write.parquet(draft)
    versions.rename(spark, draft, f"{root}/base={upto}")
    for name in versions.names(spark, root):
        kind, _, number = name.partition("=")
        if (kind == "version" and int(number) <= upto) or (kind == "base" and int(number) < upto):
            remove_path(spark, f"{root}/{name}")


def read_current(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The newest count of every key."""
    root = path.rstrip("/")
    base, newer = _state(spark, root)
    parts = [(n, f"{root}/version={n}") for n in newer] + ([(base, f"{root}/base={base}")] if base is not None else [])
    if not parts:
        raise FileNotFoundError(f"No counts at '{path}'.")
    every = [spark.read.parquet(part).withColumn("version", F.lit(n)) for n, part in parts]
    return reduce(DataFrame.unionByName, every).groupBy(*by, "ds").agg(F.max_by("y", "version").alias("y"))


def _on_disk(stream: DataFrame) -> DataFrame:
    """Keep the state of the streams of this session in RocksDB, off the heap, unless the session says otherwise."""
    conf = stream.sparkSession.conf
    if conf.get(STATE_STORE, None) is None:
        conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream


def stream_dedup(landed: DataFrame, ts: str, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """First row per key; the state, one row per key, is dropped once the watermark has passed it."""
    return _with_event_time(landed, ts, lateness).dropDuplicatesWithinWatermark(keys).drop("event_time")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed so far to a Parquet folder, then stop."""
    return (
        _on_disk(stream).writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
