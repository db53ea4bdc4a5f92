"""The streaming jobs, run until the landed files are consumed."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.registry.catalog import query
from tallyground.registry.inputs import oracle, view
from tallyground.settings import scratch_path
from tallyground.sources import store
from tallyground.streaming import feeds


def _land(df, folder):
    """Write ``df`` as one more landed delivery and return the folder."""
    df.write.mode("append").parquet(folder)
    return folder


@query("stream_daily_counts", oracle("SELECT district, CAST(ts AS DATE) AS ds, count(*) AS y FROM {ev} GROUP BY ALL"))
def stream_daily_counts(spark, sf_dir):
    folder, path, progress = (scratch_path(spark, name) for name in ("landed", "daily", "progress"))
    schema = view(spark, sf_dir, "ev").schema
    # Two deliveries, the second one with the days that the first left open.
    for late in (False, True):
        _land(view(spark, sf_dir, "ev").filter((F.col("ts") >= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")) == late), folder)
        counts = feeds.stream_daily_counts(feeds.stream_files(spark, folder, schema), "ts", ["district"])
        feeds.keep_current(counts, path, progress).awaitTermination()
    return feeds.read_current(spark, path, ["district"])


# Days that end a day or more before the latest row are closed; each comes once.
@query("stream_closed_days", oracle("""
    SELECT district, ds, count(*) AS y FROM (SELECT district, CAST(ts AS DATE) AS ds FROM {ev})
    WHERE CAST(ds AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM {ev}) - INTERVAL 1 DAY GROUP BY district, ds"""))
def stream_closed_days(spark, sf_dir):
    folder, path, progress = (scratch_path(spark, name) for name in ("landed", "closed", "progress"))
    schema = view(spark, sf_dir, "ev").schema
    for late in (False, True):
        _land(view(spark, sf_dir, "ev").filter((F.col("ts") >= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")) == late), folder)
        counts = feeds.stream_daily_counts(feeds.stream_files(spark, folder, schema), "ts", ["district"])
        feeds.write_available(counts, path, progress).awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)


# Of what is sent again in the second delivery, rows behind the watermark are late, keys within it are known, and keys whose
# state is gone count as new when they come with a new time.
@query("stream_dedup", oracle("""
    SELECT event_id, ts, district, offense, user_id, value FROM {ev} UNION ALL
    SELECT event_id, ts + INTERVAL 20 DAY, district, offense, user_id, value FROM {ev} WHERE CAST(ts AS DATE) = DATE '2024-01-05'"""))
def stream_dedup(spark, sf_dir):
    folder, path, progress = (scratch_path(spark, name) for name in ("landed", "unique", "progress"))
    rows = view(spark, sf_dir, "ev")
    day = lambda n: F.to_date("ts") == F.lit(f"2024-01-{n:02d}").cast("date")
    older = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    later = lambda n, days: rows.filter(day(n)).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days)))
    again = [rows.filter(day(3)), rows.filter(day(14)), later(14, 1), later(5, 20)]
    for delivery in (rows.filter(older), reduce(DataFrame.unionByName, again, rows.filter(~older))):
        stream = feeds.stream_files(spark, _land(delivery, folder), rows.schema)
        unique = feeds.stream_dedup(stream, "ts", ["event_id", "offense"], "1 day")
        feeds.write_available(unique, path, progress).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query("stream_merge", oracle("SELECT * FROM {merged}"))
def stream_merge(spark, sf_dir):
    def hourly(name):
        rows = view(spark, sf_dir, name)
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
        return rows.select("event_id", hour, "district", "offense", "user_id", "value")

    path, folder, progress = (scratch_path(spark, name) for name in ("incidents", "landed", "progress"))
    store.write_incidents(hourly("existing"), path, "hour", "district", "event_id")
    batch = hourly("batch")
    landed = feeds.stream_files(spark, _land(batch, folder), batch.schema)
    keys = ["hour", "district", "offense"]
    feeds.stream_merge(landed, path, progress, "event_id", "hour", keys, ["event_id"], "district").awaitTermination()
    return store.read_incidents(spark, path).drop(store.MONTH_PART)
